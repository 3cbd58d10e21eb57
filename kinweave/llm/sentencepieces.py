"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

An agenda holds the adjacent symbol pairs whose concatenation is a piece, ordered by the piece's score, the leftmost
first among equals. The best pair is merged, its two neighbour pairs are scored anew, and so on until the agenda is
empty. Symbols that are no piece become byte pieces. Pieces never reach over a space mark that follows something else,
so that a text's stretches between such places are encoded apart; each distinct short stretch is encoded once, many of
one length together as the columns of a matrix (each column is an agenda), and long stretches one by one with a heap.

Every whole text's ids are compared with those of the sentencepiece library, batch by batch; a column tells which agree.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, slices, table, without_cycles

MARK = "▁"
LONG = 64  # characters of a stretch from which on it gets a heap of its own
#: Stretches kept, of two generations: the older goes when the younger is full, and what it held is encoded anew if met again.
CACHED = 150_000
NONE = np.int32(1 << 30)  # rank of a pair that doesn't merge
NOTHING = np.int32((1 << 21) - 1)  # a symbol that merges with none


class MergeVocabulary:
    """The pieces of a model file and the merges between them."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.get_piece_size()
        pieces = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.end = sp.eos_id()
        # A character that is no piece is the symbol size + code point.
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        scores = {i: sp.get_score(i) for i in pieces.values()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        merges = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = (pieces.get(x) if len(x) > 1 else int(self.symbol[ord(x)]) for x in (p[:k], p[k:]))
                if a is not None and b is not None:
                    merges[a << 21 | b] = (order[scores[i]], i)
        self.merges = merges
        self._table(merges)
        # The piece of each rank, -1 where merged pieces have equal scores.
        made = set(merges.values())
        times = np.bincount([rank for rank, _ in made], minlength=len(order)) if made else np.zeros(len(order), np.int64)
        self._piece = np.full(len(order), -1, np.int32)
        for rank, piece in made:
            if times[rank] == 1:
                self._piece[rank] = piece
        inside = {c for p in pieces if len(p) > 1 for c in p}
        # Marks that no piece has after another kind of character: a stretch ends before them, and is met more often.
        follow = {p[k] for p in pieces for k in range(1, len(p)) if p[k - 1] != p[k] and (p[k - 1].isalnum() or p[k - 1] == MARK)}
        apart = "".join(re.escape(c) for c in "\n.,;:!?*%$#&|" if c not in follow or c not in inside)
        self._simple = all(MARK not in p.lstrip(MARK) for p in pieces)
        if not self._simple:
            self.stretch = re.compile(r"(?s).+")
        elif not apart:
            self.stretch = re.compile(rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
        else:
            # Only letters and digits come before such an end, so that no merge reaches over it.
            self.stretch = re.compile(rf"{MARK}*[^\W_]+(?=[{apart}])|{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.cache: dict[str, bytes] = {"": b""}
        self._older: dict[str, bytes] = {}
        # Each id in decimals with a blank after it, filled up with zero bytes to a number of 64 bits.
        self._decimal = np.array([b"%d " % i for i in range(n)], "S8").view(np.uint64)

    def _table(self, merges: dict) -> None:
        """The merges as an open-addressing hash table, looked up for many pairs at once."""
        bits = max(8, (4 * len(merges)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._slots, self._ranks, self._merged = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, NONE), np.zeros((1 << bits) + 64, np.int32)
        self._reach = 0
        for key, (rank, piece) in merges.items():
            at = home = int(self._home(np.array([key]))[0])
            while self._slots[at] >= 0:
                at += 1
            self._slots[at], self._ranks[at], self._merged[at] = key, rank, piece
            self._reach = max(self._reach, at - home)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray, what: np.ndarray, other: int) -> np.ndarray:
        """What the table has for pairs of symbols, ranks or merged pieces; the other for those that don't merge."""
        key = (left.astype(np.int64) << 21 | right).ravel()
        at = self._home(key)
        found = self._slots[at]
        miss = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self._reach):
            if not len(miss):
                break
            at[miss] += 1
            found[miss] = self._slots[at[miss]]
            miss = miss[(found[miss] != key[miss]) & (found[miss] >= 0)]
        return np.where(found == key, what[at], other).reshape(left.shape)

    def _agenda(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
        """Entries of agendas, the least of which merges first: a pair's rank, then its place in so many bits; from NONE on it doesn't merge."""
        return np.minimum(self._pairs(left, right, self._ranks, NONE), NONE >> bits) << bits | place

    def _rows(self, texts: list[str]) -> None:
        """Put the ids of texts of one length, below 512, into the cache; every round pops the best pair of each text's agenda."""
        n, wide = len(texts), len(texts[0])
        bits = wide.bit_length()
        # A row for each place and a column for each text; nothing merges with what lies before the first place and after the last.
        symbols, agenda = np.full((wide + 2, n), NOTHING), np.full((wide + 1, n), NONE)
        symbols[1:-1] = self.symbol[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)].reshape(n, wide).T
        agenda[1:-1] = self._agenda(symbols[1:-2], symbols[2:-1], np.arange(1, wide, dtype=np.int32)[:, None], bits)
        symbol, entry = symbols.reshape(-1), agenda.reshape(-1)
        before, after = np.arange(-n, (wide + 1) * n), np.arange(n, (wide + 3) * n)
        while len(go := np.flatnonzero((best := agenda.min(0)) < NONE)):
            best = best[go]
            place = best & ((1 << bits) - 1)
            left = place * np.int64(n) + go
            right, prior = after[left], before[left]
            then = after[right]
            to = self._piece[best >> bits]
            if len(tied := np.flatnonzero(to < 0)):
                to[tied] = self._pairs(symbol[left[tied]], symbol[right[tied]], self._merged, 0)
            # The pair's first place takes the piece; its second place is left out from now on.
            symbol[left], symbol[right], entry[right] = to, -1, NONE
            after[left], before[then] = then, left
            anew = self._agenda(np.concatenate((symbol[prior], to)), np.concatenate((to, symbol[then])), np.concatenate(((prior // n).astype(np.int32), place)), bits)
            entry[prior], entry[left] = anew[: len(go)], anew[len(go) :]
        self._keep(texts, symbols[1:-1].T)

    def _keep(self, texts: list[str], symbols: np.ndarray) -> None:
        left = symbols >= 0
        ends, flat = [0, *(4 * np.cumsum(left.sum(1))).tolist()], symbols[left].astype("<i4")
        data = flat.tobytes()
        self.cache.update(zip(texts, [data[i:j] for i, j in pairwise(ends)], strict=True))
        if flat.max() >= self.size:  # characters that are no piece
            for k in np.flatnonzero((symbols >= self.size).any(1)).tolist():
                self.cache[texts[k]] = array("i", self._ids(symbols[k][left[k]].tolist())).tobytes()

    def _heap(self, text: str) -> list[int]:
        """Symbols left of a text, with a heap as the agenda."""
        symbols = [int(self.symbol[ord(c)]) for c in text]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := self.merges.get(symbols[i] << 21 | symbols[j])):
                heapq.heappush(agenda, (found[0], i, j, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            push(i, i + 1)
        while agenda:
            _, i, j, a, b, piece = heapq.heappop(agenda)
            if symbols[i] != a or symbols[j] != b or after[i] != j:
                continue
            symbols[i], symbols[j], after[i] = piece, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return [s for s in symbols if s >= 0]

    def _ids(self, symbols: list[int]) -> list[int]:
        if max(symbols) < self.size:
            return symbols
        return [x for s in symbols for x in ([s] if s < self.size else [self.bytes[b] for b in chr(s - self.size).encode()] if self.bytes else [self.lib.unk_id()])]

    def decimals(self, ids: bytes) -> bytes:
        """Ids, as 32-bit numbers, in decimals with a blank between."""
        return self._decimal[np.frombuffer(ids, "<i4")].tobytes().translate(None, b"\0")[:-1]

    def _parts(self, texts: list[str]) -> pa.Array:
        """The stretches of normalised texts, a list for each; some may be empty."""
        apart = next(c for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))) if not any(c in t for t in texts))
        cut = [t.replace(MARK, apart + MARK) if self._simple and MARK + MARK not in t else apart.join(self.stretch.findall(t)) for t in texts]
        return pc.split_pattern(pa.array(cut, pa.large_string()), apart)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without an end id, as 32-bit numbers."""
        if not texts:
            return []
        if len(self.cache) > CACHED:
            self.cache, self._older = {"": b""}, self.cache
        parts = self._parts([self.lib.normalize(t) for t in texts])
        met = parts.flatten().dictionary_encode()
        names, at = met.dictionary.to_numpy(zero_copy_only=False).tolist(), met.indices.to_numpy()
        cache, older, by_length, long = self.cache, self._older, defaultdict(list), {}
        ids = list(map(cache.get, names))
        new = [k for k, x in enumerate(ids) if x is None]
        for k in new:
            p = names[k]
            if (x := older.get(p)) is not None:
                cache[p] = x
            else:
                by_length[min(len(p), LONG)].append(p)
        for p in by_length.pop(LONG, ()):
            long[p] = array("i", self._ids(self._heap(p))).tobytes()
        for group in by_length.values():
            self._rows(group)
        for k in new:
            ids[k] = cache[p] if (p := names[k]) in cache else long[p]
        # The ids of the distinct stretches lie in a row; each stretch met takes its own from there.
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, size = (np.cumsum(size) - size)[at], size[at]
        end = np.cumsum(size)
        flat = np.frombuffer(b"".join(ids), np.int32)[np.repeat(start - end + size, size) + np.arange(end[-1])].tobytes()
        ends = [0, *(4 * end[np.cumsum(pc.list_value_length(parts).to_numpy()) - 1]).tolist()]
        return [flat[i:j] for i, j in pairwise(ends)]


_vocabularies: dict[str, MergeVocabulary] = kept.setdefault("sentencepieces", {})


def vocabulary(path: str) -> MergeVocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = MergeVocabulary(path)
    return _vocabularies[path]


RESULT = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string()), ("agrees", T.BooleanType(), pa.bool_()), ("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))]
BATCH, BATCH_BYTES = 1024, 1_000_000  # texts encoded together, at most, but for single ones that are longer: a batch's parts and lists of ids take some 30 times its bytes


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, agrees[, ids]) of every text, an end id at its end; the decoded text comes from the ids.

    ``agrees``: the ids are those of the sentencepiece library, with which every whole text is compared. Null and empty
    texts have their end id alone. The id may be of any type, null or repeated: every row gives one row. Other columns
    are not read, whatever their names. Texts may be of any length. An empty table gives no rows.
    """
    told = RESULT if with_ids else RESULT[:-1]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t, _ in told)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_cycles("sentencepieces")
        v = vocabulary(model)
        end = array("i", [v.end]).tobytes()
        for batch in batches:
            for some in slices(batch, 1, BATCH, BATCH_BYTES):
                texts = [t or "" for t in some.column(1).to_pylist()]
                data = [x + end for x in v.encode(texts)]
                theirs = v.lib.encode(texts, add_bos=False, add_eos=True, num_threads=1, return_type="numpy")
                agrees = [x.tobytes() == own for x, own in zip(theirs, data, strict=True)]
                decoded = v.lib.decode([np.frombuffer(x, np.int32) for x in data], num_threads=1)
                digest = [hashlib.sha256(v.decimals(x)).hexdigest() for x in data]
                columns = [[len(x) // 4 for x in data], digest, [hashlib.sha256(t.encode()).hexdigest() for t in decoded], agrees]
                if with_ids:
                    flat = np.frombuffer(b"".join(data), np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *columns[0]]), pa.int32()), pa.array(flat)))
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, _, t) in zip(columns, told, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), *arrays], schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
