"""Token ids in files of directly addressable codes.

A file holds the ids of some documents in a row. Ids are cut into chunks of bits, low bits first. Level 0 has the first
chunk of every id, level k the next chunk of those ids that need more than k chunks; a bitmap beside each level but the
last tells which ids go on, and a rank directory (set bits before each block of 512) turns a position on one level into
that on the next. So the id at any place is read from a few words, without decoding what stands before it.

Layout, all little-endian: magic, header length (4 bytes), header (JSON: counts and the offset, kind and shape of each
array), then the arrays: doc_ids, known (0 for null doc ids), starts (first id of each document, and the end), and for
each level the chunks, packed without gaps in 64-bit words, the bitmap and its ranks. The chunk widths are those that
make the file least, found by dynamic programming over the histogram of id lengths.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import open_store, partitions, put, scratch, stored, table

MAGIC = b"KWDAC1\n\0"
BLOCK = 512  # bits for each rank
IDS_PER_FILE = 8_000_000
END_ID = 0


# Codes.


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits without gaps in 64-bit words."""
    n = len(values)
    v = np.zeros((-(-n // 64), 64), np.uint64)
    v.reshape(-1)[:n] = values
    out = np.zeros((len(v), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= v[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
    return out.reshape(-1)


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    w, mask = words.reshape(-1, bits), np.uint64((1 << bits) - 1)
    out = np.empty((len(w), 64), np.uint32)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        v = w[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | (w[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = v & mask
    return out.reshape(-1)[:n]


def level_widths(ids: np.ndarray) -> list[int]:
    """Bits of each level for the least size: an id pays its chunk on each level it reaches, and a bitmap bit (with its share of the ranks) on each but the last."""
    longest = max(1, int(ids.max(initial=0)).bit_length())
    lengths = np.bincount(np.maximum(1, np.frexp(ids.astype(np.float64))[1]), minlength=longest + 1) if len(ids) else np.zeros(longest + 1, int)
    beyond = np.concatenate([lengths[::-1].cumsum()[::-1], [0]])  # ids of at least so many bits
    bit = 1 + 32 / BLOCK
    best = {longest: (0.0, [])}
    for at in range(longest - 1, -1, -1):
        reach = int(beyond[at + 1]) if at else int(lengths.sum())
        best[at] = min((reach * ((end - at) + (bit if end < longest else 0)) + best[end][0], [end - at, *best[end][1]]) for end in range(at + 1, longest + 1))
    return best[0][1]


def encode_file(ids: np.ndarray, doc_ids: list, starts: np.ndarray) -> list[bytes]:
    """The bytes of a file."""
    arrays: dict[str, np.ndarray] = {
        "doc_ids": np.array([x or 0 for x in doc_ids], np.int64), "known": np.array([x is not None for x in doc_ids], np.uint8), "starts": np.asarray(starts, np.uint64),
    }
    widths, rest = level_widths(ids), ids.astype(np.uint32)
    counts = []
    for k, bits in enumerate(widths):
        counts.append(len(rest))
        arrays[f"chunks{k}"] = pack(rest & np.uint32((1 << bits) - 1), bits)
        if k < len(widths) - 1:
            more = (rest >> np.uint32(bits)) > 0
            flags = np.zeros(-(-len(rest) // BLOCK) * BLOCK, bool)
            flags[: len(rest)] = more
            arrays[f"more{k}"] = np.packbits(flags, bitorder="little")
            arrays[f"ranks{k}"] = np.concatenate([[0], flags.reshape(-1, BLOCK).sum(1).cumsum()]).astype(np.uint32)
            rest = rest[more] >> np.uint32(bits)
    header, at = {"widths": widths, "counts": counts, "arrays": {}}, 0
    for name, a in arrays.items():
        header["arrays"][name] = [at, a.dtype.str, len(a)]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(header).encode()
    head += b" " * (-(len(MAGIC) + 4 + len(head)) % 8)
    out = [MAGIC, struct.pack("<I", len(head)), head]
    for a in arrays.values():
        out += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
    return out


class TokenFile:
    """Reads a file of ids; arrays are fetched by ranges of bytes, whole or in part."""

    def __init__(self, uri: str):
        fs, path = open_store(uri)
        self._in = fs.open_input_file(path)
        if self._in.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a file of token ids: {uri}")
        (n,) = struct.unpack("<I", self._in.read_at(4, len(MAGIC)))
        self._base = len(MAGIC) + 4 + n
        self.header = json.loads(self._in.read_at(n, len(MAGIC) + 4))
        self.widths, self.counts = self.header["widths"], self.header["counts"]

    def array(self, name: str, begin: int = 0, end: int | None = None) -> np.ndarray:
        at, kind, n = self.header["arrays"][name]
        size, end = np.dtype(kind).itemsize, n if end is None else min(end, n)
        return np.frombuffer(self._in.read_at((end - begin) * size, self._base + at + begin * size), kind)

    def ids(self) -> np.ndarray:
        """All ids."""
        out = unpack(self.array("chunks0"), self.widths[0], self.counts[0])
        places, shift = None, self.widths[0]
        for k in range(1, len(self.widths)):
            on = np.flatnonzero(np.unpackbits(self.array(f"more{k - 1}"), bitorder="little", count=self.counts[k - 1]))
            places = on if places is None else places[on]
            out[places] |= unpack(self.array(f"chunks{k}"), self.widths[k], self.counts[k]) << np.uint32(shift)
            shift += self.widths[k]
        return out

    def __getitem__(self, i: int) -> int:
        """The id at a place: a word or two and one block of a bitmap from each level that the id reaches."""
        if not 0 <= i < self.counts[0]:
            raise IndexError(i)
        value, shift = 0, 0
        for k, bits in enumerate(self.widths):
            word, low = divmod(i * bits, 64)
            pair = self.array(f"chunks{k}", word, word + 2)
            both = int(pair[0]) | (int(pair[1]) << 64 if len(pair) > 1 else 0)
            value |= (both >> low & (1 << bits) - 1) << shift
            shift += bits
            if k == len(self.widths) - 1:
                break
            block = i // BLOCK
            flags = np.unpackbits(self.array(f"more{k}", block * BLOCK // 8, (block + 1) * BLOCK // 8), bitorder="little")
            if not flags[i % BLOCK]:
                break
            i = int(self.array(f"ranks{k}", block, block + 1)[0]) + int(flags[: i % BLOCK].sum())
        return value


# Texts to ids.

#: Texts of characters from here on go to the library whole: what counts there as a letter or as white space may depend on Unicode versions.
LIMIT = 0x250
#: So do texts with the information separators, which are white space to Python but not to the library.
PLAIN = re.compile(f"[\x1c-\x1f\x7f-\x9f{chr(LIMIT)}-{chr(0x10FFFF)}]")
CACHED = 600_000


def _ranges(kind: str) -> str:
    """A character class of those below LIMIT whose category begins with ``kind``."""
    return "".join(re.escape(c) for c in map(chr, range(LIMIT)) if unicodedata.category(c)[0] == kind)


#: How a byte-level BPE tokenizer parts a text, for characters below LIMIT.
PARTS = re.compile(public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_ranges('L')}{_ranges('N')}]").replace(r"\p{L}", f"[{_ranges('L')}]").replace(r"\p{N}", f"[{_ranges('N')}]"))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Parts(dict):
    """Ids of parts; those of a new part are looked up in the vocabulary when they are first asked for."""

    def __init__(self, model):
        super().__init__()
        self._tokenize, self._letters = model.tokenize, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = array("I", [t.id for t in self._tokenize(part.encode().decode("latin-1").translate(self._letters))]).tobytes()
        return ids


class Encoder:
    """The tokenizers library behind a cache of parts: each distinct part of a plain text is encoded once.

    Byte-level BPE never merges across parts, so that a text's ids are its parts' ids in a row. A text with characters
    that PLAIN finds, or with the string of an added token, is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self._parts = _Parts(self._lib.model)
        self._added = [t.content for t in self._lib.get_added_tokens_decoder().values()]

    def _whole(self, text: str) -> bytes:
        return array("I", self._lib.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        if len(self._parts) > CACHED:
            self._parts.clear()
        ids = self._parts.__getitem__
        return [self._whole(t) if PLAIN.search(t) or any(a in t for a in self._added) else b"".join(map(ids, PARTS.findall(t))) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


FILES = "part long, seq long, path string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, tokenizer: str, out_dir: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Write the ids of every text in ascending id order; returns one row per file (FILES and start: ids in the files before).

    Null ids come first, rows with equal ids follow each other by their text, a null text counts as empty (its end id is
    written all the same). A task writes a range of ids to files of about ``ids_per_file`` ids, so what it holds is
    bounded; a document is never split. Each file is moved into place when whole, under a name of its own for each
    attempt, and only those that the finished tasks name are read. Texts are encoded whole, however long. Ids are whole numbers, or text that spells one; any other is an error.
    Other columns are not read. An empty table gives no files.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        enc, ids, names, seq, held = encoder(tokenizer), [], [], 0, 0
        end = struct.pack("<I", end_id)

        def close() -> pa.RecordBatch:
            path = f"{out_dir}/{part:06d}-{seq:04d}-{attempt}.dac"
            starts = np.cumsum([0, *(len(x) // 4 for x in ids)])
            put(path, encode_file(np.frombuffer(b"".join(ids), "<u4"), names, starts))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "n_docs": [len(names)], "n_ids": [int(starts[-1])]})

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                for name, x in zip(some.column(0).to_pylist(), enc.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids.append(x + end)
                    names.append(name)
                    held += len(x) // 4 + 1
                    if held >= ids_per_file:
                        yield close()
                        ids, names, seq, held = [], [], seq + 1, 0
        if names:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", "text")
    files = stored(rows.mapInArrow(write, FILES), "token-files")
    # One row per file, of millions of ids each.
    return files.withColumn("start", F.sum("n_ids").over(W.orderBy("part", "seq")) - F.col("n_ids"))


def read_token_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read back from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                f = TokenFile(path)
                ids, at = f.ids().astype("<u4", copy=False), f.array("starts").astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                doc_ids = pa.array(f.array("doc_ids"), pa.int64(), mask=f.array("known") == 0)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(at[:-1] + start, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    rows = files.select("path", "start").repartition(4 * partitions(files.sparkSession), "path")
    return rows.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-ids"))
    return read_token_files(files)
