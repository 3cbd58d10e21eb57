"""Near duplicates by an n-gram Jaccard join over prefix trees.

1. Every text's set of word 5-grams is hashed. Blocks of (hash, document) go to hash buckets, packed: there each n-gram
   gets its document count, and only n-grams of two documents or more go back to their documents.
2. N-grams are globally ordered, rare ones first. A document of n n-grams can only be like another if they share one of
   its first n - ceil(0.8 n) + 1; so a document with too few shared n-grams is out, and the others are indexed by those.
3. Documents of one bucket with equal sets are one from here on, so that a group of copies leaves one set a bucket at
   most. Under each indexed n-gram, the first document is paired with all others. Pairs are gathered into blocks around one document, of bounded size, and each block is joined with itself:
   its sets are stored in a trie, a traversal shares the overlap with common beginnings, and bounds by the lengths that
   remain prune subtrees. A block gives the links of a spanning forest.
4. Links make components. Documents of one n-gram that are in different components after that are all paired (with
   bounds by length and position) and joined in the same way, so that no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, pack, partitions, stored, table, unpack, without_cycles

WORDS = 5
#: Two sets are like if SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (4, 5)
CHUNK = 1_000_000  # words packed together
BLOCK = 256  # sets in a block around one document
NO_ID = -(1 << 63)
KEEP_BITS = 44
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


# Sets.


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts (A-Z in lower case), and the index of each one's text; repeats are not removed.

    A text with fewer words has the whole sequence as its only n-gram; one without words has none.
    """
    if len(_words) > 300_000:
        _words.clear()
    words = [t.lower().split() for t in texts]  # on bytes: ASCII letters, and blanks 9-13 and 32
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((h for w in words for h in map(_words.__getitem__, w)), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place
    with np.errstate(over="ignore"):
        full = np.flatnonzero(left >= WORDS)
        h = np.zeros(len(full), np.uint64)
        for k in range(WORDS):
            h += flat[full + k] * _MULTIPLIERS[k]
        short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
        begin = (np.cumsum(sizes) - sizes)[short]
        s = sizes[short].astype(np.uint64) * np.uint64(0x27D4EB2F165667C5)
        for k in range(WORDS - 1):
            has = sizes[short] > k
            s[has] += flat[begin[has] + k] * _MULTIPLIERS[k]
        return mix64(np.concatenate([h, s])), np.concatenate([owner[full], short])


def _deal(bucket: np.ndarray, columns: list[np.ndarray], kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows (bucket, kind, packed columns) of columns that are sorted by bucket."""
    if not len(bucket):
        return
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(at, [*at[1:], len(bucket)], strict=True):
        yield int(bucket[a]), kind, pack(*(c[a:b] for c in columns))


PACKED = "bucket int, kind int, data binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], ["bucket", "kind", "data"])


def _doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) % np.uint64(n)).astype(np.int64)


# Kinds of packed rows: of n-grams (hash in order, as differences; document), and of documents (document, number of n-grams).
GRAMS, SIZES = 0, 1


def pack_sets(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Distinct n-grams of each row, by hash bucket, and each row's number of them."""

    def chunk(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        h, owner = shingles(texts)
        ids = np.array(ids, np.int64)
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
        h, owner = h[new], owner[new]
        low = (h & np.uint64((1 << 20) - 1)).astype(np.int64) * buckets >> 20
        kept = (h >> np.uint64(64 - KEEP_BITS)).astype(np.int64)
        order = np.argsort(low, kind="stable")
        low, kept, doc = low[order], kept[order], ids[owner[order]]
        step = np.diff(kept, prepend=0)
        first = np.flatnonzero(np.diff(low, prepend=-1))
        step[first] = kept[first]
        rows = list(_deal(low, [step, doc], GRAMS))
        sizes, home = np.bincount(owner, minlength=len(ids)), _doc_bucket(ids, buckets)
        order = np.argsort(home, kind="stable")
        return _batch(rows + list(_deal(home[order], [ids[order], sizes[order]], SIZES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_cycles()
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = (t or "").encode()
                ids.append(NO_ID if i is None else i)
                texts.append(t)
                held += len(t)
                if held > 6 * CHUNK:
                    yield chunk(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield chunk(ids, texts)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PACKED)


def shared_grams(packed: DataFrame, homes: int) -> DataFrame:
    """For each bucket of documents: their n-grams that stand in two rows or more, with document counts; sizes pass through."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        without_cycles()
        b = key[0].as_py()
        kinds, data = rows.column("kind").to_pylist(), rows.column("data").to_pylist()
        out = []
        grams = [unpack(d, 2) for k, d in zip(kinds, data, strict=True) if k == GRAMS]
        if grams:
            h, doc = np.concatenate([np.cumsum(g[0]) for g in grams]), np.concatenate([g[1] for g in grams])
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new_h = np.r_[True, h[1:] != h[:-1]]
            new = new_h | np.r_[True, doc[1:] != doc[:-1]]
            at = np.flatnonzero(new)
            times = np.diff(np.r_[at, len(h)])  # above 1 only for rows with equal ids
            h, doc, token = h[at], doc[at], np.cumsum(new_h)[at] - 1
            count, times_of = np.bincount(token), np.bincount(token, weights=times)
            keep = times_of[token] > 1
            h, doc, count, times = h[keep] | b << KEEP_BITS, doc[keep], count[token][keep], times[keep]
            home = _doc_bucket(doc, homes)
            order = np.argsort(home, kind="stable")
            out += _deal(home[order], [doc[order], h[order], count[order], times[order]], GRAMS)
        sizes = [unpack(d, 2) for k, d in zip(kinds, data, strict=True) if k == SIZES]
        if sizes:
            doc, n = (np.concatenate([s[i] for s in sizes]) for i in (0, 1))
            home = _doc_bucket(doc, homes)
            order = np.argsort(home, kind="stable")
            out += _deal(home[order], [doc[order], n[order]], SIZES)
        return pa.Table.from_batches([_batch(out)])

    return packed.groupBy("bucket").applyInArrow(run, PACKED)


SET = "id long, n_rows long, n long, first_places long, rep long, grams array<long>"


def indexed_sets(shared: DataFrame) -> DataFrame:
    """One row (SET) for each document: its number of n-grams and, if it can be like another, its shared n-grams, rarest first.

    ``first_places``: how many of those are to be indexed. ``rep``: the least document of the bucket with an equal set,
    which alone has the n-grams; null if the document can be like no other. Rows with equal ids are one document, with
    the union of their sets.
    """

    def run(rows: pa.Table) -> pa.Table:
        without_cycles()
        kinds, data = rows.column("kind").to_pylist(), rows.column("data").to_pylist()
        sizes = [unpack(d, 2) for k, d in zip(kinds, data, strict=True) if k == SIZES]
        ids, n = (np.concatenate([s[i] for s in sizes]) for i in (0, 1))
        ids, place = np.unique(ids, return_inverse=True)
        n_rows, n = np.bincount(place), np.bincount(place, weights=n).astype(np.int64)
        grams = [unpack(d, 4) for k, d in zip(kinds, data, strict=True) if k == GRAMS] or [[np.zeros(0, np.int64)] * 4]
        doc, h, count, times = (np.concatenate([g[i] for g in grams]) for i in range(4))
        at = np.searchsorted(ids, doc)
        n -= np.bincount(at, weights=times - 1, minlength=len(ids)).astype(np.int64)
        alone = count < 2  # in two rows of one id only
        at, h, count = at[~alone], h[~alone], count[~alone]
        known = np.bincount(at, minlength=len(ids))
        least = -(-SHARE[0] * n // SHARE[1])
        alive = (n > 0) & (known >= least)
        pick = alive[at]
        at, h, count = at[pick], h[pick], count[pick]
        order = np.lexsort((h, count, at))
        at, h = at[order], h[order]
        ends = np.cumsum(np.bincount(at, minlength=len(ids)))
        # Of the first n - least + 1 places, those of n-grams in no other document come before the shared ones.
        places = np.where(alive, known - least + 1, 0)
        reps, sets, seen = [], [], {}
        for i in range(len(ids)):
            s = h[ends[i - 1] if i else 0 : ends[i]] if alive[i] else None
            # Sets with n-grams of their own are equal to no other.
            rep = None if s is None else int(ids[i]) if len(s) < n[i] else seen.setdefault(xxhash.xxh3_128_digest(np.sort(s).tobytes()), int(ids[i]))
            reps.append(rep)
            sets.append(s if rep == ids[i] else None)
        arrays = [pa.array(ids), pa.array(n_rows.astype(np.int64)), pa.array(n), pa.array(places.astype(np.int64)), pa.array(reps, pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(arrays, [x.split()[0] for x in SET.split(", ")])

    return shared.groupBy("bucket").applyInArrow(run, SET)


# The trie join of a block.


class Trie:
    """Sets as sorted arrays of ranks; a node holds a stretch of ranks that all sets below it share."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sizes = sizes
        order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        arranged = [sets[i] for i in order]
        shared = [self._common(a, b) for a, b in zip(arranged, arranged[1:])]
        # Nodes: stretch, last rank, children, sets that end here, least size and greatest length left below.
        self.root = self._node(order, arranged, shared, 0, len(order), 0)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _node(self, order: list[int], sets: list[np.ndarray], shared: list[int], lo: int, hi: int, depth: int) -> tuple:
        todo = [(lo, hi, depth, None)]
        root = None
        while todo:  # no recursion: texts may nest deeply
            lo, hi, depth, parent = todo.pop()
            end = min(shared[lo : hi - 1], default=len(sets[lo]))
            ends = [order[i] for i in range(lo, hi) if len(sets[i]) == end]
            node = (sets[lo][depth:end], [], ends, min(self.sizes[order[i]] for i in range(lo, hi)), max(len(sets[i]) for i in range(lo, hi)) - end)
            if parent is None:
                root = node
            else:
                parent[1].append(node)
            start = lo
            for i in range(lo, hi):
                if i == hi - 1 or shared[i] == end:
                    if len(sets[start]) > end or len(sets[i]) > end:
                        begin = start
                        while len(sets[begin]) == end:
                            begin += 1
                        todo.append((begin, i + 1, end, node))
                    start = i + 1
        return root

    def like(self, own: np.ndarray, size: int, has: np.ndarray) -> list[int]:
        """Sets of this trie that are like a set; ``has`` marks its ranks."""
        a, b = SHARE
        found, todo = [], [(self.root, 0)]
        while todo:
            (stretch, children, ends, least_size, left), overlap = todo.pop()
            if len(stretch):
                overlap += int(np.count_nonzero(has[stretch]))
            for i in ends:
                if (a + b) * overlap >= a * (size + self.sizes[i]):
                    found.append(i)
            if children:
                remaining = min(left, len(own) - overlap)
                if len(stretch):
                    remaining = min(remaining, len(own) - int(np.searchsorted(own, stretch[-1], "right")))
                if (a + b) * (overlap + remaining) >= a * (size + least_size):
                    todo += [(c, overlap) for c in children]
        return found


def block_links(ids: list[int], sizes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between like sets of a block: those of a spanning forest. Within a block, ranks put frequent n-grams first, so that paths are shared."""
    flat = np.concatenate(sets)
    tokens, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -count))] = np.arange(len(tokens))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ranked = [np.sort(r).astype(">i4") for r in np.split(rank[place], cuts)]
    trie = Trie(ranked, sizes)
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links, has = [], np.zeros(len(tokens), bool)
    for i, own in enumerate(ranked):
        has[own] = True
        for j in trie.like(own, sizes[i], has):
            if (x := root(i)) != (y := root(j)):
                parent[x] = y
                links.append((ids[i], ids[j]))
        has[own] = False
    return links


LINK = "u long, v long"


def join_blocks(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among documents that are paired, for distinct ``pairs`` (a, b): blocks of one document a and up to about BLOCK of its partners."""
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)).alias("part"))
    members = dealt.unionByName(dealt.select("a", F.col("a").alias("b"), "part").distinct())
    # A merge join at every size: the side that would be broadcast grows with the corpus.
    rows = members.join(sets.select(F.col("id").alias("b"), "n", "grams").hint("merge"), "b")

    def run(block: pa.Table) -> pa.Table:
        sets = [np.asarray(s.values) for s in block.column("grams").combine_chunks()]
        links = block_links(block.column("b").to_pylist(), block.column("n").to_pylist(), sets)
        u, v = zip(*links, strict=True) if links else ((), ())
        return pa.Table.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.groupBy("a", "part").applyInArrow(run, LINK)


# Components.


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link: the least node it is connected to. Large-star and small-star rounds; each is written before the next."""
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Words are what blanks (32, 9 to 13) part, A-Z in lower case; a text's set are its distinct word 5-grams, with fewer
    words the whole sequence. Rows with Jaccard similarity of 0.8 or more are linked; the component is the least id that
    links reach. Null or empty texts, and those without words, have no n-grams and are linked with nothing. Rows with
    equal ids (null ones too) are one document with the union of their sets, repeated in the result. Other columns are
    not read. Ids are whole numbers, or text that spells one; any other is an error. An empty table gives no rows.
    """
    parts = partitions(docs.sparkSession)
    table_ = stored(indexed_sets(shared_grams(pack_sets(docs, id_col, text_col, 2 * parts), parts)), "ngram-sets")
    sets = table_.where("grams is not null").select("id", "n", "first_places", "grams")
    postings = sets.select("id", "n", F.size("grams").alias("known"), F.posexplode(F.slice("grams", F.lit(1), F.col("first_places").cast("int"))).alias("pos", "gram"))
    # Places are counted from the end: how many n-grams follow.
    postings = stored(postings.select("gram", "id", "n", (F.col("known") - F.col("pos") - 1).alias("after")), "ngram-postings")
    a, b = SHARE
    near_size = (F.greatest("n", "m") * a <= F.least("n", "m") * b)

    # Only n-grams that two sets are indexed by matter from here on; each of their rows knows the first set and its size.
    first = postings.groupBy("gram").agg(F.min_by(F.struct("id", "n"), "id").alias("f"), F.count("*").alias("c")).where("c > 1").select("gram", F.col("f.id").alias("a"), F.col("f.n").alias("m"))
    common = stored(postings.join(first, "gram"), "ngram-common")
    stars = stored(common.where(F.col("id") != F.col("a")).where(near_size).select("a", F.col("id").alias("b")).distinct(), "ngram-stars")
    links = stored(join_blocks(stars, sets), "ngram-links")
    found = components(links)

    placed = common.drop("a", "m").join(found, F.col("id") == F.col("node"), "left").select("gram", "id", "n", "after", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("gram")
    placed = stored(placed.join(mixed, "gram"), "ngram-mixed")
    left, right = placed.select("gram", F.col("id").alias("a"), "n", "after", F.col("component").alias("x")), placed.select("gram", F.col("id").alias("b"), F.col("n").alias("m"), F.col("after").alias("then"), F.col("component").alias("y"))
    enough = (F.least("after", "then") + 1) * (a + b) >= (F.col("n") + F.col("m")) * a
    rest = left.join(right, "gram").where("x < y").where(near_size).where(enough).select("a", "b").distinct()
    more = stored(join_blocks(stored(rest, "ngram-rest"), sets), "ngram-more")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    out = table_.select("id", "n", "n_rows", "rep").join(found, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return out.select(F.nullif("id", F.lit(NO_ID)).alias(id_col), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "id"), F.lit(NO_ID)).alias("component_id"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
