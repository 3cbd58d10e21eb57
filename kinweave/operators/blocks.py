"""Cosine joins in blocks: who reaches a floor, exactly, without a row for each pair that shares a token.

Both sides are cut into chunks of whole rows, kept as files on the shared store, small ones in bundles. A chunk sends each of its distinct tokens
once, and gets their numbers and idf back, so that no worker holds a table of all tokens. Then each chunk of entities meets
each chunk of records in one task, in memory of bounded size; only pairs that reach the floor leave it.

There, bundles of a side are put together and their rows parted by likeness of their frequent tokens, as by language. Of two parts,
tokens that many of their pairs share are multiplied as matrices, others by lists of rows in order of about equal length. These
sums are the cosines but for rounding; where one reaches the floor, or may be among the best k, the pair is computed in full.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
CHUNK = 1_500_000  # occurrences of tokens in a chunk, but for a row that has more
BUNDLE = 800_000  # distinct tokens of rows in the chunks that are joined as one, but for a chunk that has more
GATHER = 1_500_000  # occurrences of tokens in the bundles that meet at once, but for one that has more
DENSE = 0.003  # share of pairs that share a token from which on a matrix product is cheaper
CELLS, STEPS = 1 << 19, 1 << 20  # of sums and of products held at once
SLACK = 1e-4  # more than sums differ from rounded cosines
HELD = 1 << 20  # pairs that wait to be computed in full, at about which ties are settled
PARTS, FEATURES, COMMON = 6, 512, 0.02  # of alike rows; their tokens, and the least share of rows with such a token
WIDTHS = np.unique(np.round(1.25 ** np.arange(90)).astype(np.int64))  # lengths of lists of rows
ROWS = 1 << 17  # of pairs with OVERLAPS handed on at once

VOCABULARY = "chunk long, side string, local int, token string, n int"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or "file://" + tempfile.mkdtemp(prefix="kinweave-")).rstrip("/")


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table to the folder and read it again: what builds on it doesn't compute it anew."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _path(folder: str, number: int) -> str:
    return f"{folder}/{number:016x}"


def _put(folder: str, what: dict) -> int:
    """Write a new file; its number, by which ``_path`` finds it, is told only once it is whole."""
    number = uuid.uuid4().int >> 65
    path = _path(folder, number)
    fs, inside = _store(path)
    raw = pickle.dumps(what, protocol=5)
    fs.create_dir(inside.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inside) as out:
        out.write(len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True))
    return number


def _get(path: str) -> dict:
    fs, inside = _store(path)
    with fs.open_input_stream(inside) as f:
        data = f.read()
    return pickle.loads(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True))


def _cut(docs: DataFrame, side: str, folder: str) -> DataFrame:
    """(VOCABULARY) of (id, tokens, keep[, weights][, group]), whose chunks are written to the folder. n: rows of the chunk with the token, those not kept included."""
    weighted, grouped = "weights" in docs.columns, "group" in docs.columns

    def chunk(ids: list, keep: list, tokens: list, lengths: list, weights: list, group: list) -> pa.RecordBatch | None:
        coded = pa.concat_arrays(tokens).dictionary_encode()
        if not len(coded):
            return None
        names, size = coded.dictionary, len(coded.dictionary)
        key = np.repeat(np.arange(len(ids), dtype=np.int64), np.concatenate(lengths)) * size + coded.indices.to_numpy()
        if weighted:
            key, where = np.unique(key, return_inverse=True)
            value = np.bincount(where, np.concatenate(weights), len(key))
        else:
            key, value = np.unique(key, return_counts=True)
        row, token = key // size, (key % size).astype(np.int32)
        number = _put(folder, {"side": side, "ids": ids, "keep": np.array(keep, bool), "group": group or [None] * len(ids), "row": row.astype(np.int32), "token": token, "value": value.astype(np.float64 if weighted else np.int32)})
        n = np.bincount(token, minlength=size)
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, number)), pa.array([side] * size), pa.array(np.arange(size), pa.int32()), names.cast(pa.string()), pa.array(n, pa.int32())], ["chunk", "side", "local", "token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [], [])
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                tokens = some.column(1)
                lengths = np.diff(tokens.offsets.to_numpy())
                held[0].extend(some.column(0).to_pylist())
                held[1].extend(some.column(2).to_pylist())
                held[2].append(tokens.flatten().cast(pa.large_string()))
                held[3].append(lengths)
                if weighted:
                    held[4].append(some.column("weights").flatten().to_numpy())
                if grouped:
                    held[5].extend(some.column("group").to_pylist())
                size += int(lengths.sum())
                if size >= CHUNK:
                    if (out := chunk(*held)) is not None:
                        yield out
                    held, size = ([], [], [], [], [], []), 0
        if held[0] and (out := chunk(*held)) is not None:
            yield out

    columns = ["id", "tokens", "keep", *(["weights"] if weighted else []), *(["group"] if grouped else [])]
    return docs.where("id is not null and size(tokens) > 0").select(*columns).mapInArrow(run, VOCABULARY)


def _weigh(told: DataFrame, cut: str, folder: str, weighted: bool, rare: float | None = None) -> DataFrame:
    """(side, path, n, size): bundles of chunks with their weights, of (bundle, chunk, local, number, idf); number is null for tokens that no entity has. With ``rare`` also what OVERLAPS needs of a row."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("chunk", "ascending"), ("local", "ascending")])
        chunk = rows["chunk"].to_numpy()
        begin = [*np.flatnonzero(np.diff(chunk, prepend=-1)).tolist(), len(rows)]
        numbers = rows["number"].fill_null(-1).to_numpy()
        idf = None if weighted else rows["idf"].to_numpy()
        ids: list = []
        group: list = []
        parts, whole = [], []
        for low, high in zip(begin, begin[1:], strict=False):
            c = _get(_path(cut, int(chunk[low])))
            row, token, w = c["row"], c["token"] + low, c["value"].astype(np.float64)
            if not weighted:
                w = (1 + np.log(w)) * idf[token]
                w /= np.sqrt(np.bincount(row, w * w, len(c["ids"])))[row]
            use = (numbers[token] >= 0) & c["keep"][row]
            first = np.flatnonzero(np.bincount(row[use], minlength=len(c["ids"])))
            at = np.full(len(c["ids"]), -1, np.int32)
            at[first] = np.arange(len(ids), len(ids) + len(first))
            parts.append((at[row[use]], numbers[token[use]], w[use], *([] if rare is None else [idf[token[use]]])))
            if rare is not None:  # tokens that no entity has count as well
                whole.append([np.bincount(row, v[token], len(c["ids"]))[first] for v in (idf, idf >= rare - 1e-9, numbers < 0)])
            ids += [c["ids"][k] for k in first]
            group += [c["group"][k] for k in first]
        row, number, w, *of = (np.concatenate(x) for x in zip(*parts, strict=True))
        known, one, token = np.unique(number, return_index=True, return_inverse=True)
        more = {} if rare is None else {"idf": of[0][one]} | dict(zip(("sum", "rare", "unseen"), map(np.concatenate, zip(*whole, strict=True)), strict=True))
        path = _path(folder, _put(folder, {"ids": ids, "group": group, "row": row, "token": token.astype(np.int32), "w": w, "number": known} | more))
        return pa.table({"side": [c["side"]], "path": [path], "n": pa.array([len(ids)], pa.int64()), "size": pa.array([len(row)], pa.int64())})

    return told.groupBy("bundle").applyInArrow(run, "side string, path string, n long, size long").where("n > 0")


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def _alike(c: dict) -> np.ndarray:
    """A part for each row, by its frequent tokens: rows of a part share more of them. It is told for speed alone; any will do."""
    n = len(c["ids"])
    kept = np.bincount(c["token"], minlength=len(c["number"]))
    often = np.argsort(-kept, kind="stable")[:FEATURES]
    often = often[kept[often] >= max(2, COMMON * n)]
    if n < 16 * PARTS or len(often) < 2:
        return np.zeros(n, np.int64)
    column = np.full(len(kept), -1)
    column[often] = np.arange(len(often))
    use = np.flatnonzero(column[c["token"]] >= 0)
    m = np.zeros((n, len(often)), np.float32)
    m[c["row"][use], column[c["token"][use]]] = c["w"][use]
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    # To begin with, centres far from each other, of rows with many of the tokens.
    many = (m > 0).sum(1)
    seeds = m[many >= np.median(many)]
    centres = [seeds[(seeds @ m.mean(0)).argmax()]]
    near = seeds @ centres[0]
    for _ in range(PARTS - 1):
        centres.append(seeds[near.argmin()])
        near = np.maximum(near, seeds @ centres[-1])
    centres = np.array(centres)
    for _ in range(5):
        of = (m @ centres.T).argmax(1)
        for g in np.unique(of).tolist():
            centres[g] = m[of == g].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return of


def _gather(paths: list[str]) -> dict:
    """Bundles as one, with where each row and each part of rows begins; rows are in order."""
    cs = [_get(path) for path in paths]
    c = {k: np.concatenate([x[k] for x in cs]) for k in cs[0] if k not in ("side", "ids", "group")}
    c["ids"], c["group"] = [i for x in cs for i in x["ids"]], [g for x in cs for g in x["group"]]
    if len(cs) > 1:
        rows, tokens = (np.cumsum([0, *(len(x[k]) for x in cs)]) for k in ("ids", "number"))
        c["number"], one, to = np.unique(c["number"], return_index=True, return_inverse=True)
        c["row"] = np.concatenate([x["row"] + at for x, at in zip(cs, rows.tolist(), strict=False)])
        c["token"] = np.concatenate([to[x["token"] + at] for x, at in zip(cs, tokens.tolist(), strict=False)]).astype(np.int32)
        if "idf" in c:
            c["idf"] = c["idf"][one]
    of = _alike(c)
    order = np.argsort(of, kind="stable")
    place = np.empty(len(of), np.int32)
    place[order] = np.arange(len(of))
    row = place[c["row"]]
    by = np.argsort(row, kind="stable")
    c |= {"row": row[by], "token": c["token"][by], "w": c["w"][by], "ids": [c["ids"][k] for k in order.tolist()], "group": [c["group"][k] for k in order.tolist()]}
    c |= {k: c[k][order] for k in ("sum", "rare", "unseen") if k in c}
    return c | {"at": np.concatenate([[0], np.cumsum(np.bincount(c["row"], minlength=len(of)))]), "parts": np.unique(np.cumsum([0, *np.bincount(of)])).tolist()}


def _lists(r: np.ndarray, t: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict, dict]:
    """(group, place, rows, weights): each token's rows and their weights stand at a place in its group's matrices; what is over there has the weight 0."""
    order = np.argsort(t, kind="stable")
    r, w = r[order], w[order]
    begin = np.cumsum(n) - n
    group = np.searchsorted(WIDTHS, n).astype(np.uint8)
    place = np.zeros(len(n), np.int64)
    rows, weights = {}, {}
    for g in np.unique(group[n > 0]).tolist():
        of = np.flatnonzero((group == g) & (n > 0))
        place[of] = np.arange(len(of))
        at = begin[of, None] + np.arange(WIDTHS[g])
        over = np.arange(WIDTHS[g]) >= n[of, None]
        at[over] = 0
        rows[g], weights[g] = r[at], np.where(over, 0, w[at])
    return group, place, rows, weights


def best_of(rows: np.ndarray, s: np.ndarray, k: int, *ties: np.ndarray) -> np.ndarray:
    """Where the k best of each row are; ``ties`` decide between equals."""
    order = np.lexsort((*ties, -s, rows))
    new = np.flatnonzero(np.diff(rows[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order))) < k]


def _narrow(held: list, need: np.ndarray, k: int, settle: Callable) -> None:
    """Leave of the pairs held what can be among the k best of a row, and raise what is needed for that."""
    xx, yy, s = (np.concatenate(c) for c in zip(*held, strict=True))
    best = best_of(xx, s, k)
    full = np.bincount(xx[best], minlength=len(need)) >= k
    kth = np.full(len(need), np.inf, np.float32)
    np.minimum.at(kth, xx[best], s[best].astype(np.float32))
    need[full] = np.maximum(need[full], kth[full] - SLACK)
    good = np.flatnonzero(s >= need[xx])
    xx, yy, s = xx[good], yy[good], s[good]
    held[:] = [(xx, yy, s) if len(xx) <= HELD else settle(xx, yy)]


def meet(x: dict, y: dict, floor: float, k: int | None = None, least: np.ndarray | None = None, rank: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, cosine) of at least the floor, in the order of y's rows within what is handed on at once.

    With ``k``, pairs may be missing that k better ones of the same row of x outdo, or equal ones of a lesser ``rank`` of y's row;
    ``least`` has a floor of its own for each row of x.
    """
    least = np.full(len(x["ids"]), floor) if least is None else least
    _, ix, iy = np.intersect1d(x["number"], y["number"], assume_unique=True, return_indices=True)
    if not len(ix):
        return
    size = len(ix)
    sides: tuple[list, list] = ([], [])
    for c, shared, side in zip((x, y), (ix, iy), sides, strict=True):
        code = np.full(len(c["number"]), -1, np.int32)
        code[shared] = np.arange(size)
        c["code"] = code[c["token"]]
        for low, high in zip(c["parts"], c["parts"][1:], strict=False):
            use = c["at"][low] + np.flatnonzero(c["code"][c["at"][low] : c["at"][high]] >= 0)
            t = c["code"][use]
            side.append((low, high - low, c["row"][use].astype(np.int64) - low, t, c["w"][use], np.bincount(t, minlength=size)))
    need = (least - SLACK).astype(np.float32)
    values = np.zeros(max(len(x["number"]), size) + 1)
    rank = np.arange(len(y["ids"])) if rank is None else rank

    def in_full(xx: np.ndarray, yy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(yy, kind="stable")
        xx, yy = xx[order], yy[order]
        found = _in_full(x, y, values, xx, yy)
        good = np.flatnonzero(found >= least[xx])
        return xx[good], yy[good], found[good]

    def settle(xx: np.ndarray, yy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        xx, yy, s = in_full(xx, yy)
        best = best_of(xx, s, k, rank[yy])
        return xx[best], yy[best], s[best]

    held: list = []
    waiting = known = 0
    for xlow, nx, xr, xt, xw, kx in sides[0]:
        group, place, rows, weights = _lists(xr, xt, xw, kx)
        for ylow, ny, yr, yt, yw, ky in sides[1]:
            heavy = np.flatnonzero(kx * ky.astype(np.float64) > DENSE * nx * ny)
            column = np.full(size, -1, np.int32)
            column[heavy] = np.arange(len(heavy))
            dense = []
            for n, r, t, w in ((nx, xr, xt, xw), (ny, yr, yt, yw)):
                m = np.zeros((n, len(heavy)), np.float32)
                at = column[t]
                use = np.flatnonzero(at >= 0)
                m[r[use], at[use]] = w[use]
                dense.append(m)
            light = np.flatnonzero((column[yt] < 0) & (kx[yt] > 0))
            light = light[np.argsort(group[yt[light]], kind="stable")]
            begin = np.searchsorted(group[yt[light]], np.arange(len(WIDTHS) + 1))
            many = max(1, CELLS // nx)
            lists = []
            for g in np.flatnonzero(np.diff(begin)).tolist():
                of = light[begin[g] : begin[g + 1]]
                lists.append((rows[g], weights[g], place[yt[of]], yr[of], yw[of], np.searchsorted(yr[of], np.arange(0, ny + many, many))))
            for step, low in enumerate(range(0, ny, many)):
                sums = dense[1][low : low + many] @ dense[0].T
                flat = sums.reshape(-1)
                keys: list = []
                products: list = []
                steps = 0
                for rs, ws, where, r, w, first in lists:
                    at, last = first[step], first[step + 1]
                    while at < last:
                        to = min(last, at + max(1, STEPS // rs.shape[1]))
                        keys.append((rs[where[at:to]] + ((r[at:to] - low) * nx)[:, None]).reshape(-1))
                        products.append((ws[where[at:to]] * w[at:to, None]).reshape(-1))
                        steps += len(keys[-1])
                        at = to
                        if steps >= STEPS:
                            flat += np.bincount(np.concatenate(keys), np.concatenate(products), len(flat))
                            keys, products, steps = [], [], 0
                if keys:
                    flat += np.bincount(np.concatenate(keys), np.concatenate(products), len(flat))
                cells = np.flatnonzero(sums >= need[xlow : xlow + nx])
                if not len(cells):
                    continue
                yy, xx = np.divmod(cells, nx)
                xx, yy = xx + xlow, yy + ylow + low
                if not k:
                    found = in_full(xx, yy)
                    if len(found[0]):
                        yield found
                    continue
                held.append((xx, yy, flat[cells].astype(np.float64)))
                waiting += len(cells)
                if waiting > max(known, 4 * len(need)):
                    _narrow(held, need, k, settle)
                    waiting, known = 0, len(held[0][0])
    if held:
        _narrow(held, need, k, settle)
        found = in_full(*held[0][:2])
        if len(found[0]):
            yield found


def _in_full(x: dict, y: dict, values: np.ndarray, xx: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Rounded cosines of pairs in the order of y's rows; the weights of each such row are laid out by token in ``values``."""
    out = np.empty(len(xx))
    new = np.flatnonzero(np.diff(yy, prepend=-1)).tolist()
    for low, high in zip(new, [*new[1:], len(yy)], strict=True):
        b, e = y["at"][yy[low]], y["at"][yy[low] + 1]
        mine = y["code"][b:e]
        values[mine] = y["w"][b:e]
        values[-1] = 0  # of tokens without a partner, which have the code -1
        near = xx[low:high]
        length = x["at"][near + 1] - x["at"][near]
        place = _runs(x["at"][near], length)
        out[low:high] = np.add.reduceat(x["w"][place] * values[x["code"][place]], np.cumsum(length) - length)
        values[mine] = 0
    return np.round(out, DIGITS)


#: What two rows' distinct tokens have in common, by idf.
OVERLAPS = "shared_idf_sum double, max_shared_idf double, unshared_idf_sum double, rare_shared long, rare_unshared_ent long, unseen_shared long, unseen_unshared long, weighted_jaccard double"


def overlaps(x: dict, y: dict, xx: np.ndarray, yy: np.ndarray, rare: float) -> list[np.ndarray]:
    """OVERLAPS of pairs that ``meet`` has found, in its order. A token that no entity has is never shared."""
    shared, most, rares = np.empty(len(xx)), np.empty(len(xx)), np.empty(len(xx), np.int64)
    values = np.zeros(len(y["number"]) + 1)
    new = np.flatnonzero(np.diff(yy, prepend=-1)).tolist()
    for low, high in zip(new, [*new[1:], len(yy)], strict=True):
        b, e = y["at"][yy[low]], y["at"][yy[low] + 1]
        mine = y["code"][b:e]
        values[mine] = y["idf"][y["token"][b:e]]
        values[-1] = 0
        near = xx[low:high]
        length = x["at"][near + 1] - x["at"][near]
        common, at = values[x["code"][_runs(x["at"][near], length)]], np.cumsum(length) - length
        shared[low:high], most[low:high] = np.add.reduceat(common, at), np.maximum.reduceat(common, at)
        rares[low:high] = np.add.reduceat((common > 0) & (common >= rare - 1e-9), at, dtype=np.int64)
        values[mine] = 0
    both = x["sum"][xx] + y["sum"][yy]
    ints = [c.astype(np.int64) for c in (x["rare"][xx] - rares, np.zeros(len(xx)), x["unseen"][xx] + y["unseen"][yy])]
    rounded = lambda c: np.round(c, DIGITS) + 0.0  # noqa: E731  no negative zero
    return [rounded(shared), rounded(most), rounded(both - 2 * shared), rares, *ints, rounded(shared / (both - shared))]


def pairs(ent: DataFrame, rec: DataFrame, floor: float, n: int | None = None, k: int | None = None, rare: float | None = None) -> DataFrame:
    """(e, r, s): all pairs with a cosine of at least the floor (over 0), exactly; ``s`` is rounded.

    ``ent`` and ``rec``: (id, tokens, keep), ids unique on each side; only rows to keep are paired. Weights are
    (1 + ln tf) idf by the whole of ``ent``, with ``n`` for its number of rows, or come as a column ``weights`` beside the
    tokens, none negative; rows then have no greater norm than 1. Files and the result lie in the shared folder.

    With ``k``, what is not among its entity's k best (ties by the lesser r) of the records that a task meets can be left out: the k
    best of all are there. Where ``rec`` has a column ``group``, so are the k best of each group of records.

    With ``rare``, an idf, and neither weights nor k, pairs have OVERLAPS as well; the result then isn't stored, but made where it is read.
    """
    spark = ent.sparkSession
    folder = f"{shared_folder(spark)}/kinweave/blocks-{uuid.uuid4().hex}"
    weighted = "weights" in ent.columns
    words = stored(_cut(ent, "e", f"{folder}/cut"), folder, "words-e").unionByName(stored(_cut(rec, "r", f"{folder}/cut"), folder, "words-r"))
    df = words.where("side = 'e'").groupBy("token").agg(F.sum("n").alias("df"))
    df = df.withColumn("number", F.monotonically_increasing_id())
    df = stored(df if weighted else df.withColumn("idf", F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1), folder, "numbers")  # fixed once written
    sizes = words.groupBy("side", "chunk").agg(F.sum("n").alias("n")).collect()  # a row a chunk
    told = words.select("chunk", "local", "token").join(df, "token", "left").drop("token")
    bundles, bundle, held = [], 0, {}
    for x in sorted(sizes):
        if held.get(x["side"], BUNDLE) + x["n"] > BUNDLE:
            bundle, held = bundle + 1, {x["side"]: 0}
        held[x["side"]] += x["n"]
        bundles.append((x["chunk"], bundle))
    told = told.join(F.broadcast(spark.createDataFrame(bundles, "chunk long, bundle int")), "chunk")
    if not weighted:
        told = told.withColumn("idf", F.coalesce("idf", F.log(F.lit(1.0) + n) + 1))
    chunks = stored(_weigh(told, f"{folder}/cut", f"{folder}/weighed", weighted, rare), folder, "chunks")
    sides: dict[str, list] = {"e": [], "r": []}
    held = {}
    for side, path, size in sorted(tuple(c) for c in chunks.select("side", "path", "size").collect()):  # a row a bundle
        if held.get(side, GATHER) + size > GATHER:
            sides[side].append([])
            held[side] = 0
        sides[side][-1].append(path)
        held[side] += size
    many = max(1, len(sides["e"]))
    apart = max(1, min(len(sides["r"]), -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // many)))
    left = spark.createDataFrame([(x,) for x in sides["e"]], "x array<string>")
    right = spark.createDataFrame([(sides["r"][at::apart],) for at in range(apart)], "y array<array<string>>")
    schema = T.StructType([T.StructField("e", ent.schema["id"].dataType), T.StructField("r", rec.schema["id"].dataType), T.StructField("s", T.DoubleType())])
    if rare is not None:
        schema = T.StructType([*schema, *T.StructType.fromDDL(OVERLAPS)])
    grouped = "group" in rec.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, others in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = _gather(a)
                least = np.full(len(x["ids"]), floor)
                top = np.zeros((len(x["ids"]), k or 0))
                for b in others:
                    y = _gather(b)
                    if rare is not None:
                        ids = [pa.array(c["ids"]) for c in (x, y)]
                        for i, j, s in meet(x, y, floor):
                            for at in range(0, len(i), ROWS):
                                some = [c[at : at + ROWS] for c in (i, j, s)]
                                columns = [ids[0].take(pa.array(some[0])), ids[1].take(pa.array(some[1])), some[2], *overlaps(x, y, *some[:2], rare)]
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema.names)
                        continue
                    rank = np.empty(len(y["ids"]), np.int64)
                    rank[sorted(range(len(rank)), key=y["ids"].__getitem__)] = np.arange(len(rank))
                    found = list(meet(x, y, floor, None if grouped else k, least, rank))
                    if not found:
                        continue
                    i, j, s = (np.concatenate(c) for c in zip(*found, strict=True))
                    if k:
                        codes = {g: c for c, g in enumerate(dict.fromkeys(y["group"]))}
                        group = np.array([codes[g] for g in y["group"]])
                        best = best_of(i * len(codes) + group[j], s, k, rank[j])
                        i, j, s = i[best], j[best], s[best]
                    if k and not grouped:  # a later record needs as much as the k-th best so far
                        of, by = np.concatenate([np.repeat(np.arange(len(top)), k), i]), np.concatenate([top.reshape(-1), s])
                        top = by[best_of(of, by, k)].reshape(-1, k)
                        least = np.maximum(least, top[:, -1])
                    columns = [[x["ids"][m] for m in i.tolist()], [y["ids"][m] for m in j.tolist()], s]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema.names)

    found = left.crossJoin(right).repartition(many * apart).mapInArrow(run, schema)
    return found if rare is not None else stored(found, folder, "pairs")
