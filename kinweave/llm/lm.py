"""Language-model scores from an Elias-Fano n-gram trie.

The model has orders 1 to 3 with interpolated absolute discounting: p(w|h) = max(c(hw) - D, 0) / c(h) + g(h) p(w|h'),
over all n-grams, also those seen once; g(h) is the mass that they leave, and the unigram distribution adds 0.1 to each
count. Tokens are words and an end after each text; the end also stands before each text's first word.

Vocabulary: words are 64-bit hashes, sorted, in files by ranges of hashes, with counts. They are numbered by classes of
counts (powers of two, the frequent ones first), then by file, then by hash, so that most numbers that occur are small.
N-grams lie in shards by the hash of their first two words. A shard has three levels: first words; pairs; triples. On a
level, the successors of context number k are stored as k * (vocabulary size) + word, one monotone sequence over all
contexts, in Elias-Fano form: low bits packed, high bits in unary with a directory of counts. So the pointers from
contexts to their successors are monotone and implied by the high bits, and a lookup searches for one value relative to
its context. Probabilities and left-over masses are quantised to a byte, downwards.

Texts are read once, into chunks of numbered tokens. A chunk sends each of its distinct n-grams once to its shard, with
its count in training texts; the task of a shard sums the counts, writes the shard, maps it into memory and looks up
there what all chunks ask; the answers, three bytes an n-gram, go back to the chunks. So a shard is opened by one task,
every n-gram of a shard is searched once, and nothing is held that grows with the corpus.
"""

from __future__ import annotations

import json
import struct
from array import array
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, mix64, open_store, pack, partitions, put, remove, scratch, stored, table, unpack, without_cycles

DISCOUNT = 0.75
ADDED = 0.1
CHUNK_TOKENS = 1_000_000  # tokens numbered together, at most, but for the rest of the last text
END = 0x1D8E4E27C47D124F  # stands for the end among hashes
FLOOR = -10.0  # log10 of the least mass that a byte stands for
STEPS = 255 / -FLOOR
RANGES = 128  # of the vocabulary, at most: files that a worker opens for the words of a chunk
CLASSES = 64
SHARDS = 2  # for each shuffle partition
OPEN_FILES = 64  # files of arrays that a worker keeps open


# Files of arrays.


def arrays_bytes(arrays: dict[str, np.ndarray], **facts) -> list[bytes]:
    head, at = {"facts": facts, "arrays": {}}, 0
    for name, a in arrays.items():
        head["arrays"][name] = [at, a.dtype.str, len(a)]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    out = [struct.pack("<Q", len(text)), text]
    for a in arrays.values():
        out += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
    return out


class Arrays:
    """A file of arrays, memory-mapped where the store is a local or mounted folder, else read. A file holds one shard or one range."""

    def __init__(self, uri: str):
        fs, path = open_store(uri)
        if isinstance(fs, pafs.LocalFileSystem):
            raw = np.memmap(path, np.uint8, "r")
        else:
            with fs.open_input_file(path) as f:
                raw = np.frombuffer(f.read(), np.uint8)
        (n,) = struct.unpack("<Q", raw[:8].tobytes())
        head = json.loads(raw[8 : 8 + n].tobytes())
        self.facts = head["facts"]
        for name, (at, kind, count) in head["arrays"].items():
            size = np.dtype(kind).itemsize * count
            setattr(self, name, raw[8 + n + at : 8 + n + at + size].view(kind))


class Files:
    """The files of arrays that were used last."""

    def __init__(self):
        self._open: OrderedDict[str, Arrays] = OrderedDict()

    def __getstate__(self):
        return {"_open": OrderedDict()}

    def __getitem__(self, path: str) -> Arrays:
        if path not in self._open:
            self._open[path] = Arrays(path)
            while len(self._open) > OPEN_FILES:
                self._open.popitem(last=False)
        self._open.move_to_end(path)
        return self._open[path]


def quantise(mass: np.ndarray) -> np.ndarray:
    """A byte for a mass from 0 to 1: never stands for more."""
    with np.errstate(divide="ignore"):
        return np.floor(np.clip((np.log10(mass) - FLOOR) * STEPS, 0, 255) + 1e-9).astype(np.uint8)


MASS = 10 ** (FLOOR + np.arange(256) / STEPS)
MASS[0] = 0.0


# Elias-Fano sequences.


def elias_fano(values: np.ndarray, universe: int, name: str) -> tuple[dict[str, np.ndarray], int]:
    """Arrays of an increasing sequence of whole numbers below ``universe``, and the width of its low bits."""
    n = len(values)
    bits = max(0, (universe // max(1, n)).bit_length() - 1)
    values = values.astype(np.uint64)
    low = np.zeros(n * bits // 64 + 2, np.uint64)
    if bits:
        part, at = values & np.uint64((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(low, word, part << shift)
        over = shift + np.uint64(bits) > 64
        np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
    high = (values >> np.uint64(bits)).astype(np.int64)
    ones = high + np.arange(n)
    unary = np.zeros(((universe >> bits) + n) // 64 + 2, np.uint64)
    np.bitwise_or.at(unary, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
    before = np.concatenate([[0], np.bitwise_count(unary).cumsum()[:-1]]).astype(np.uint32)
    return {f"{name}_low": low, f"{name}_high": unary, f"{name}_ones": before}, bits


class Sequence:
    def __init__(self, arrays: Arrays, name: str, bits: int):
        self.low, self.high, self.ones, self.bits = getattr(arrays, f"{name}_low"), getattr(arrays, f"{name}_high"), getattr(arrays, f"{name}_ones"), bits
        self._zeros = 64 * np.arange(len(self.high), dtype=np.int64) - self.ones

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of zero number k (from 0) among the high bits."""
        word = np.searchsorted(self._zeros, k, "right") - 1
        left = (k - self._zeros[word]).astype(np.int64)
        bits, place = ~self.high[word], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # halve the part of the word that holds it
            count = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = left >= count
            left = np.where(beyond, left - count, left)
            place += np.where(beyond, width, 0)
            bits = np.where(beyond, bits >> np.uint64(width), bits)
        return 64 * word + place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        over = shift + np.uint64(self.bits) > 64
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & np.uint64((1 << self.bits) - 1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value in the sequence, -1 where it is none of it: the successor of each value, if equal."""
        high, low = x >> self.bits, (x & ((1 << self.bits) - 1)).astype(np.uint64)
        end = self._zero(high) - high
        begin = np.zeros(len(x), np.int64)
        some = np.flatnonzero(high > 0)
        begin[some] = self._zero(high[some] - 1) - high[some] + 1
        lo, hi = begin, end.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < low[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        hit = np.flatnonzero(lo < end)
        out = np.full(len(x), -1, np.int64)
        same = hit[self._low(lo[hit]) == low[hit]]
        out[same] = lo[same]
        return out


# Chunks of tokens.


class _Index(dict):
    """Numbers words in the order in which they are met; the end is number 0."""

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self) + 1
        return k


class Chunk:
    """Tokens of some texts as places in the chunk's sorted word numbers (-1: unknown)."""

    def __init__(self, numbers: np.ndarray, place: np.ndarray, sizes: np.ndarray, train: np.ndarray, end: int):
        self.numbers, self.place, self.sizes, self.begin = numbers, place, sizes, np.cumsum(sizes) - sizes
        self.train, self.end = np.repeat(train, sizes), int(np.searchsorted(numbers, end))
        self.first = np.zeros(len(place), bool)
        self.first[self.begin] = True

    def grams(self, size: int, shards: int) -> tuple:
        """Distinct n-grams by shard: shard, words, training count, whether the pair is a new one; and for each token the n-gram that begins before it.

        An n-gram is a pair, of the token and that before it, with the token after it (size: none, size + 1: unknown).
        Those whose pair holds an unknown word are left out (place -1).
        """
        n, u, numbers = len(self.place), len(self.numbers), self.numbers
        before = np.where(self.first, self.end, np.r_[0, self.place[:-1]][:n])
        after = np.where(np.r_[self.first[1:], True][:n], u, np.r_[self.place[1:], 0][:n])
        go = np.flatnonzero((numbers[before] >= 0) & (numbers[self.place] >= 0))
        pair, after, train = before[go] * u + self.place[go], after[go], self.train[go]
        del before
        if u < 1 << 20:
            key, inverse = np.unique(pair * (u + 1) + after, return_inverse=True)
            pairs, c = np.divmod(key, u + 1)
        else:  # the triple would not fit in 63 bits
            distinct, which = np.unique(pair, return_inverse=True)
            key, inverse = np.unique(which * (u + 1) + after, return_inverse=True)
            pairs, c = np.divmod(key, u + 1)
            pairs = distinct[pairs]
        del pair, after, key
        count = np.bincount(inverse, weights=train, minlength=len(c)).astype(np.int64)
        a, b = np.divmod(pairs, max(1, u))
        a, b, c = numbers[a], numbers[b], np.r_[np.where(numbers < 0, size + 1, numbers), size][c]
        home = _shard(a, b, shards)
        order = np.argsort(home.astype(np.uint16) if shards < 1 << 16 else home, kind="stable")
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        place = np.full(n, -1, np.int64)
        place[go] = where[inverse]
        pairs = pairs[order]
        return home[order], a[order], b[order], c[order], count[order], np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)], place


#: A chunk: ids and flags of its rows, tokens of each, its words (hashes, later numbers, as differences) and each token's place among them.
CHUNK = [("chunk", T.LongType()), ("train", T.ArrayType(T.BooleanType())), ("sizes", T.BinaryType()), ("words", T.BinaryType()), ("place", T.BinaryType())]


def tokenise(docs: DataFrame) -> DataFrame:
    """Chunks of rows (id, train, text), written: ids, which of them train, and their tokens. A null text is empty."""
    id_type = docs.schema["id"].dataType
    schema = T.StructType([*(T.StructField(n, t) for n, t in CHUNK), T.StructField("ids", T.ArrayType(id_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_cycles()
        part, seq, arrow = TaskContext.get().partitionId(), 0, None
        ids, train, sizes, flat, index = [], [], array("q"), array("I"), _Index()

        def close() -> pa.RecordBatch:
            hashes = np.array([END, *map(xxhash.xxh3_64_intdigest, index)], np.uint64)
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            hashes = hashes[order]
            packed = [pack(np.array(sizes, np.int64)), pack(np.diff(hashes, prepend=np.uint64(0)).view(np.int64)), pack(rank[np.array(flat, np.uint32)])]
            chunk = part << 32 | seq
            columns = [pa.array([chunk], pa.int64()), pa.array([train], pa.list_(pa.bool_())), *(pa.array([x], pa.binary()) for x in packed), pa.array([ids], pa.list_(arrow))]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            arrow = batch.column(0).type
            for i, f, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(flat)
                flat.extend(map(index.__getitem__, (t or "").encode().lower().split()))  # on bytes: ASCII letters, and blanks 9-13 and 32
                flat.append(0)
                ids.append(i)
                train.append(bool(f))
                sizes.append(len(flat) - n)
                if len(flat) >= CHUNK_TOKENS:
                    yield close()
                    ids, train, sizes, flat, index, seq = [], [], array("q"), array("I"), _Index(), seq + 1
        if ids:
            yield close()

    return stored(docs.select("id", "train", "text").mapInArrow(run, schema), "lm-chunks")


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, places, sizes and flags of a chunk."""
    words, place, sizes = (unpack(row[c], 1)[0] for c in ("words", "place", "sizes"))
    return np.cumsum(words.view(np.uint64), dtype=np.uint64), place, sizes, np.array(row["train"], bool)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


# Vocabulary.


def _range_of(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64) * n >> 20


def _runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, begin, end) of each run of equal keys."""
    at = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)
    yield from zip(sorted_keys[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_keys)])


def _class(counts: np.ndarray) -> np.ndarray:
    """0 for the greatest counts, one more for each power of two less."""
    return CLASSES - np.frexp(counts.astype(np.float64))[1]


class Vocabulary:
    """The vocabulary files: count and number of words by their hashes, and counts by numbers."""

    def __init__(self, paths: list[str | None], sizes: np.ndarray):
        """``sizes``: words of each file and class."""
        self.paths, self.size, self.files = paths, max(1, int(sizes.sum())), Files()
        self.begin = np.cumsum(sizes, 1) - sizes  # of each class in its file
        flat = sizes.T.ravel()
        self.bases = np.cumsum(flat) - flat  # first number of each class and file
        self.end = int(self.look(np.array([END], np.uint64))[1][0])

    def part(self, k: int) -> Arrays:
        return self.files[self.paths[k]]

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0: unknown) and number (-1: none) of each of some sorted hashes."""
        count, number = np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        for k, a, b in _runs(_range_of(h, len(self.paths))):
            if self.paths[k] is None:
                continue
            f = self.part(k)
            at = np.minimum(np.searchsorted(f.hashes, h[a:b]), len(f.hashes) - 1)
            hit = np.flatnonzero(f.hashes[at] == h[a:b])
            at = at[hit]
            count[a + hit] = f.counts[at]
            number[a + hit] = self.bases[_class(f.counts[at]) * len(self.paths) + k] + f.within[at]
        return count, number

    def places(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(file, begin, end, places in the file's words by class) of runs of increasing numbers."""
        for j, a, b in _runs(np.searchsorted(self.bases, numbers, "right") - 1):
            c, k = divmod(j, len(self.paths))
            yield k, a, b, numbers[a:b] - self.bases[j] + self.begin[k, c]

    def counts_of(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of words by their numbers, in increasing order."""
        out = np.zeros(len(numbers), np.int64)
        for k, a, b, at in self.places(numbers):
            out[a:b] = self.part(k).by_class[at]
        return out


FILE = "part int, path string, words array<long>, tokens long"
PACKED = "bucket int, chunk long, data binary"


def _one(**row) -> pa.Table:
    return pa.Table.from_pydict({k: [v] for k, v in row.items()}, pa.schema([("part", pa.int32()), ("path", pa.string()), ("words", pa.list_(pa.int64())), ("tokens", pa.int64())]))


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, c, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["bucket", "chunk", "data"])


def count_words(chunks: DataFrame, out_dir: str, parts: int) -> DataFrame:
    """Vocabulary files of training texts by ranges of hashes (FILE)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_cycles()
        for row in _rows(batches):
            chunk, (h, place, sizes, train) = row["chunk"], _read(row)
            n = np.bincount(place[np.repeat(train, sizes)], minlength=len(h))
            h, n = h[n > 0], n[n > 0]
            yield _packed([(k, chunk, pack(np.diff(h[a:b], prepend=np.uint64(0)).view(np.int64), n[a:b])) for k, a, b in _runs(_range_of(h, parts))])

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        k, some = key[0].as_py(), [unpack(d, 2) for d in rows.column("data").to_pylist()]
        h, place = np.unique(np.concatenate([np.cumsum(s[0].view(np.uint64), dtype=np.uint64) for s in some]), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([s[1] for s in some])).astype(np.int64)
        path = f"{out_dir}/words-{k:06d}-{TaskContext.get().taskAttemptId()}.bin"
        of, sizes = _class(n), np.bincount(_class(n), minlength=CLASSES)
        order = np.argsort(of, kind="stable")
        within = np.empty(len(h), np.uint32)
        within[order] = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        put(path, arrays_bytes({"hashes": h, "counts": n, "within": within, "by_class": n[order]}))
        return _one(part=k, path=path, words=sizes.tolist(), tokens=int(n.sum()))

    return stored(chunks.select(*(n for n, _ in CHUNK)).mapInArrow(count, PACKED).groupBy("bucket").applyInArrow(write, FILE), "lm-words")


def number_words(chunks: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The chunks with numbers of words in place of hashes, those without a number together; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_cycles()
        for batch in batches:
            words, places = [], []
            for row in batch.select([n for n, _ in CHUNK]).to_pylist():
                h, place, *_ = _read(row)
                numbers, where = np.unique(vocabulary.look(h)[1], return_inverse=True)
                words.append(pack(np.diff(numbers + 1, prepend=0)))
                places.append(pack(where[place]))
            columns = {"words": pa.array(words, pa.binary()), "place": pa.array(places, pa.binary())}
            yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return stored(chunks.mapInArrow(run, chunks.schema), "lm-numbers")


# Shards.


def _shard(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _both(one: bytes, two: bytes) -> bytes:
    return struct.pack("<I", len(one)) + one + two


def _apart(data: bytes) -> tuple[bytes, bytes]:
    (n,) = struct.unpack("<I", data[:4])
    return data[4 : 4 + n], data[4 + n :]


def _chunk(row: dict, vocabulary: Vocabulary) -> Chunk:
    words, *rest = _read(row)
    return Chunk(words.view(np.int64) - 1, *rest, vocabulary.end)


def shard_rows(chunks: DataFrame, vocabulary: Vocabulary, shards: int) -> DataFrame:
    """Each chunk's distinct n-grams, packed by shard (bucket): pairs and how many n-grams each begins; words after them and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_cycles()
        for row in _rows(batches):
            home, a, b, after, n, new, _ = _chunk(row, vocabulary).grams(vocabulary.size, shards)
            out = []
            for k, x, y in _runs(home):
                heads = np.flatnonzero(new[x:y]) + x
                out.append((k, row["chunk"], _both(pack(np.diff(a[heads], prepend=0), b[heads], np.diff(heads, append=y)), pack(after[x:y], n[x:y]))))
            yield _packed(out)

    return chunks.select(*(n for n, _ in CHUNK)).mapInArrow(run, PACKED)


class Asked:
    """What the chunks ask of a shard: distinct pairs and n-grams in order, training counts, and each chunk's places among them."""

    def __init__(self, rows: pa.Table, size: int):
        some = [_apart(d) for d in rows.column("data").to_pylist()]
        pairs, grams = [unpack(x, 3) for x, _ in some], [unpack(x, 2) for _, x in some]
        self.chunks, self.pair_cuts, self.cuts = rows.column("chunk").to_pylist(), np.cumsum([len(x[0]) for x in pairs])[:-1], np.cumsum([len(x[0]) for x in grams])[:-1]
        self.pairs, self.pair_place = np.unique(np.concatenate([np.cumsum(x[0]) * size + x[1] for x in pairs]), return_inverse=True)
        key = np.repeat(self.pair_place, np.concatenate([x[2] for x in pairs])) * (size + 2) + np.concatenate([x[0] for x in grams])
        key, self.place = np.unique(key, return_inverse=True)
        self.pair, self.after = np.divmod(key, size + 2)
        self.count = np.bincount(self.place, weights=np.concatenate([x[1] for x in grams]), minlength=len(key)).astype(np.int64)

    def answers(self, of_pairs: np.ndarray, of_grams: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(chunk, packed columns) of what was found for each of its pairs and n-grams."""
        for chunk, x, y in zip(self.chunks, np.split(self.pair_place, self.pair_cuts), np.split(self.place, self.cuts), strict=True):
            yield chunk, _both(pack(*of_pairs[:, x]), pack(of_grams[y]))


class Shard:
    """A shard of the trie."""

    def __init__(self, arrays: Arrays):
        self.arrays, self.levels = arrays, [Sequence(arrays, f"level{k}", b) for k, b in enumerate(arrays.facts["bits"])]

    def find(self, asked: Asked, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes: for each pair its mass and that which its triples leave (0: no such pair), for each n-gram the mass of the triple."""
        of_pairs, of_grams = np.zeros((2, len(asked.pairs)), np.int64), np.zeros(len(asked.pair), np.int64)
        first, second = np.divmod(asked.pairs, size)
        words, which = np.unique(first, return_inverse=True)
        context = self.levels[0].find(words)[which]
        node = np.full(len(first), -1, np.int64)
        known = np.flatnonzero(context >= 0)
        node[known] = self.levels[1].find(context[known] * size + second[known])
        known = np.flatnonzero(node >= 0)
        of_pairs[:, known] = self.arrays.pair_mass[node[known]], self.arrays.pair_left[node[known]]
        node = node[asked.pair]
        known = np.flatnonzero((node >= 0) & (asked.after < size))
        leaf = self.levels[2].find(node[known] * size + asked.after[known])
        of_grams[known[leaf >= 0]] = self.arrays.triple_mass[leaf[leaf >= 0]]
        return of_pairs, of_grams


#: Rows of three kinds: the path of a shard; for a file of the vocabulary, places of words and how many pairs they begin; a chunk's answers.
MADE = "kind int, bucket int, chunk long, data binary"
SHARD, TYPES, ANSWER = 0, 1, 2


def _made(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    k, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["kind", "bucket", "chunk", "data"])


def write_shards(grams: DataFrame, vocabulary: Vocabulary, out_dir: str, answer: bool) -> DataFrame:
    """Writes the trie's shards (MADE)."""
    size = vocabulary.size

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        without_cycles()
        shard, asked = key[0].as_py(), Asked(rows, size)
        learnt = asked.count > 0
        n, c = asked.count[learnt], asked.after[learnt]
        kept, pair = np.unique(asked.pair[learnt], return_inverse=True)
        pairs, pair_n = asked.pairs[kept], np.bincount(pair, weights=n, minlength=len(kept)).astype(np.int64)
        pa_, pb = np.divmod(pairs, size)
        # Level 0: first words; level 1: pairs; level 2: triples.
        first, context = np.unique(pa_, return_inverse=True)
        mass = quantise((pair_n - DISCOUNT) / vocabulary.counts_of(pa_))
        leaf = c < size
        node = pair[leaf]
        leaf_mass = quantise((n[leaf] - DISCOUNT) / pair_n[node])
        left = DISCOUNT * np.bincount(node, minlength=len(pa_)) / pair_n
        arrays, bits = {}, []
        for k, (values, universe) in enumerate(((first, size), (context * size + pb, len(first) * size), (node * size + c[leaf], len(pa_) * size))):
            more, width = elias_fano(values, max(1, universe), f"level{k}")
            arrays |= more
            bits.append(width)
        path = f"{out_dir}/shard-{shard:06d}-{TaskContext.get().taskAttemptId()}.bin"
        put(path, arrays_bytes(arrays | {"pair_mass": mass, "pair_left": np.where(left > 0, quantise(left), 255).astype(np.uint8), "triple_mass": leaf_mass}, bits=bits))
        types = np.bincount(context, minlength=len(first))
        out = [(SHARD, shard, 0, path.encode())]
        of_file: dict[int, list] = {}
        for k, a, b, at in vocabulary.places(first):  # classes follow each other in a file, as they do in numbers
            of_file.setdefault(k, []).append((at, types[a:b]))
        for k, some in of_file.items():
            at, n = map(np.concatenate, zip(*some, strict=True))
            out.append((TYPES, k, 0, pack(np.diff(at, prepend=0), n)))
        if answer:
            out += [(ANSWER, shard, chunk, data) for chunk, data in asked.answers(*Shard(Arrays(path)).find(asked, size))]
        return _made(out)

    return stored(grams.groupBy("bucket").applyInArrow(write, MADE), "lm-shards")


def ask_shards(grams: DataFrame, model: Model) -> DataFrame:
    """The answers of a model's shards to n-grams (MADE)."""
    size, paths = model.vocabulary.size, model.shards

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        without_cycles()
        shard = key[0].as_py()
        asked = Asked(rows, size)
        found = Shard(Arrays(paths[shard])).find(asked, size) if paths[shard] else (np.zeros((2, len(asked.pairs)), np.int64), np.zeros(len(asked.pair), np.int64))
        return _made([(ANSWER, shard, chunk, data) for chunk, data in asked.answers(*found)])

    return grams.groupBy("bucket").applyInArrow(run, MADE)


def write_left(types: DataFrame, vocabulary: Vocabulary, out_dir: str) -> DataFrame:
    """For each vocabulary file, the masses that its words' pairs leave."""

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        k, some = key[0].as_py(), [unpack(d, 2) for d in rows.column("data").to_pylist()]
        counts = vocabulary.part(k).by_class
        left = DISCOUNT * np.bincount(np.concatenate([np.cumsum(s[0]) for s in some]), weights=np.concatenate([s[1] for s in some]), minlength=len(counts)) / counts
        path = f"{out_dir}/left-{k:06d}-{TaskContext.get().taskAttemptId()}.bin"
        put(path, arrays_bytes({"left": np.where(left > 0, quantise(left), 255).astype(np.uint8)}))
        return _one(part=k, path=path, words=[], tokens=0)

    return stored(types.groupBy("bucket").applyInArrow(write, FILE), "lm-left")


# Scores.


class Model:
    """What the workers need to score: paths and totals; files are opened when first used."""

    def __init__(self, vocabulary: Vocabulary, total: int, distinct: int, left: list[str | None], shards: list[str | None]):
        self.vocabulary, self.total, self.distinct, self.left, self.shards, self.files = vocabulary, total, distinct, left, shards, Files()

    def _left_of(self, numbers: np.ndarray) -> np.ndarray:
        """Mass that the pairs of each word leave, by increasing numbers; 1 for words without a number."""
        out = np.ones(len(numbers))
        known = np.flatnonzero(numbers >= 0)
        for k, a, b, at in self.vocabulary.places(numbers[known]):
            if self.left[k] is not None:
                out[known[a:b]] = MASS[self.files[self.left[k]].left[at]]
        return out

    def score(self, c: Chunk, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, sum of log10 unigram probabilities and log10 probability of each text of a chunk, by what its n-grams' shards answered."""
        *_, new, place = c.grams(self.vocabulary.size, len(self.shards))
        some = [_apart(answers[k]) for k in sorted(answers)]
        of_pairs = np.concatenate([np.zeros((2, 0), np.int64), *(np.stack(unpack(x, 2)) for x, _ in some)], axis=1)
        # The last of each is for place -1.
        pair_mass, pair_left = (np.r_[x[np.cumsum(new) - 1], 0] for x in of_pairs)
        triple_mass = np.r_[np.concatenate([np.zeros(0, np.int64), *(unpack(x, 1)[0] for _, x in some)]), 0]
        known = c.numbers >= 0
        count = np.zeros(len(known), np.int64)
        count[known] = self.vocabulary.counts_of(c.numbers[known])
        one = ((count + ADDED) / (self.total + ADDED * (self.distinct + 1)))[c.place]
        n = len(c.place)
        before = np.where(c.first, c.end, np.r_[0, c.place[:-1]][:n])
        two = self._left_of(c.numbers)[before] * one + MASS[pair_mass[place]]
        # The pair that ends at the token before is this token's context.
        context = np.where(c.first, -1, np.r_[-1, place[:-1]][:n])
        p = np.where(pair_left[context] > 0, MASS[triple_mass[context]] + MASS[pair_left[context]] * two, two)
        add = lambda x: np.add.reduceat(x, c.begin) if n else np.zeros(0)
        return add((count > 0)[c.place].astype(np.int64)), add(np.log10(one)), add(np.log10(p))


def _scores(chunks: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    schema = T.StructType([T.StructField("id", chunks.schema["ids"].dataType.elementType), T.StructField("train", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(key: tuple, rows: pa.Table, answered: pa.Table) -> pa.Table:
        without_cycles()
        c = _chunk(rows.select([n for n, _ in CHUNK]).to_pylist()[0], model.vocabulary)
        known, base, score = model.score(c, dict(zip(answered.column("bucket").to_pylist(), answered.column("data").to_pylist(), strict=True)))
        ids = rows.column("ids").combine_chunks().flatten()
        return pa.table([ids, rows.column("train").combine_chunks().flatten(), pa.array(c.sizes), pa.array(known), pa.array(base), pa.array(score)], schema.names)

    return chunks.groupBy("chunk").cogroup(answers.select("chunk", "bucket", "data").groupBy("chunk")).applyInArrow(run, schema)


def _fit(chunks: DataFrame, out_dir: str, answer: bool) -> tuple[Model, DataFrame, DataFrame]:
    """The model of all training texts of some chunks, the numbered chunks, and the model's answers to them. The driver holds paths and totals of files, at most RANGES of the vocabulary and SHARDS for each shuffle partition.

    ``chunks`` are deleted, as the numbered ones hold what they held.
    """
    shards, parts = SHARDS * partitions(chunks.sparkSession), min(RANGES, partitions(chunks.sparkSession))
    files = {r["part"]: r for r in count_words(chunks, out_dir, parts).collect()}
    words = np.array([files[k]["words"] if k in files else [0] * CLASSES for k in range(parts)])
    vocabulary = Vocabulary([files[k]["path"] if k in files else None for k in range(parts)], words)
    numbered = number_words(chunks, vocabulary)
    forget(chunks)
    made = write_shards(shard_rows(numbered, vocabulary, shards), vocabulary, out_dir, answer)
    paths = {r["bucket"]: bytes(r["data"]).decode() for r in made.where(F.col("kind") == SHARD).collect()}
    left = {r["part"]: r["path"] for r in write_left(made.where(F.col("kind") == TYPES), vocabulary, out_dir).collect()}
    model = Model(vocabulary, sum(r["tokens"] for r in files.values()), int(words.sum()), [left.get(k) for k in range(parts)], [paths.get(k) for k in range(shards)])
    return model, numbered, made.where(F.col("kind") == ANSWER)


def fit_lm(docs: DataFrame, out_dir: str, text_col: str = "text") -> Model:
    """Learn from all rows of ``docs``; null texts are empty. An empty table gives a model that knows nothing."""
    rows = docs.select(F.lit(0).cast("long").alias("id"), F.lit(True).alias("train"), F.col(text_col).alias("text"))
    model, numbered, _ = _fit(tokenise(rows), out_dir, answer=False)
    forget(numbered)
    return model


def score_lm(docs: DataFrame, model: Model) -> DataFrame:
    """(id, train, n_tokens, n_known, base_score, score) of rows (id, train, text).

    One row for each, whatever its id. A null or empty text is one token, its end; texts may be of any length. Other
    columns are not read. An empty table gives no rows.
    """
    chunks = tokenise(docs)
    numbered = number_words(chunks, model.vocabulary)
    forget(chunks)
    return _scores(numbered, ask_shards(shard_rows(numbered, model.vocabulary, len(model.shards)), model), model)


def fit_and_score(docs: DataFrame, out_dir: str, keep_shards: bool = True) -> tuple[Model, DataFrame]:
    """The model of the rows (id, train, text) that train, and the scores of all, in one round of the shards; see ``score_lm``.

    Without ``keep_shards`` the shards are deleted once they have answered: the model then scores no other texts.
    """
    model, numbered, answers = _fit(tokenise(docs), out_dir, answer=True)
    if not keep_shards:
        remove(docs.sparkSession, [p for p in model.shards if p])
    return model, _scores(numbered, answers, model)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 of the id as text, modulo 10, is not 0."""
    train = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10) != 0
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), train.alias("train"), "text")
    model, scores = fit_and_score(docs, scratch(spark, "lm"), keep_shards=False)
    return scores.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
