import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import fingerprints, line_dedup, lm, mixing, ngram_join, quality, sentencepieces, token_files, toxicity, warc

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with all kinds of oddities, and columns whose names the operators use inside."""
    rows = spark.createDataFrame(brute.ROWS, brute.SCHEMA)
    return rows.withColumns({c: F.lit(1) for c in ("id", "row", "k", "h", "key", "bucket", "label", "size", "score", "a", "b", "n")}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Fingerprints.


def own_fingerprint(text):
    def chain(*parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode(), seed=h)
        return h

    lanes = [0] * 73
    for paragraph in text.split("\n"):
        for i in range(4):
            h = chain(f"digest{i}", paragraph)
            lanes[2 * i] += h >> 32
            lanes[2 * i + 1] += h & 0xFFFFFFFF
        words = paragraph.split(" ")
        for pair in [*zip(words, words[1:]), words[-1:]]:
            h = chain(*pair)
            for i in range(32):
                lanes[8 + 2 * i] += h >> 32 + i & 1
                lanes[9 + 2 * i] += h >> i & 1
            lanes[72] += 1
    return "".join(f"{x % 2**32:08x}" for x in lanes[:72]) + f"{lanes[72]:016x}"


def test_op1_is_brute_force(spark, real):
    texts = sorted((r["doc_id"], r["text"]) for r in real.collect())
    rows = {r["doc_id"]: r for r in fingerprints.op1_fingerprints(spark, SF).collect()}
    assert len(rows) == len(texts)
    for k, (i, t) in enumerate(texts):
        after, cut = texts[(k + 1) % len(texts)][1], len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if k % 10 == 0:
            assert (r["fingerprint"], r["edited_fingerprint"]) == (own_fingerprint(t), own_fingerprint(edited))
    assert sum(r["near_edited"] > r["near_next"] for r in rows.values()) > 0.95 * len(rows)


def test_op1_odd_rows(docs, empty):
    rows = fingerprints.tail_edit_fingerprints(docs).collect()
    assert len(rows) == len(brute.ROWS)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert by[1][0]["fingerprint"] == by[2][0]["fingerprint"] == own_fingerprint("")
    assert by[0][0]["fingerprint"] == by[6][0]["fingerprint"]
    assert fingerprints.tail_edit_fingerprints(empty).count() == 0
    alone = fingerprints.tail_edit_fingerprints(docs.where("doc_id = 4").limit(1)).first()
    assert alone["near_next"] == 1


def test_fingerprints_add_and_subtract(spark):
    df = spark.createDataFrame([(0, "a b\nc d"), (1, "c d\na b"), (2, "a b"), (3, "c d")], "doc_id long, text string")
    lanes = {r["doc_id"]: r for r in fingerprints.fingerprints(df).collect()}
    assert lanes[0]["fingerprint"] == lanes[1]["fingerprint"] != lanes[2]["fingerprint"]
    both = spark.createDataFrame([(lanes[2]["lanes"], lanes[3]["lanes"], lanes[0]["lanes"])], "a array<long>, b array<long>, c array<long>")
    r = both.select(fingerprints.combine(F.col("a"), F.col("b")).alias("s"), fingerprints.combine(F.col("c"), F.col("b"), -1).alias("d")).first()
    assert (r["s"], r["d"]) == (lanes[0]["lanes"], lanes[2]["lanes"])


# N-gram join.


def test_op2_is_brute_force(spark):
    random.seed(5)
    base = [" ".join(random.choice("abcdefgh") + str(random.randint(0, 40)) for _ in range(n)) for n in (3, 5, 6, 30, 60, 60)]
    rows = []
    for i in range(150):
        words = random.choice(base).split()
        for _ in range(random.choice([0, 0, 0, 1, 2])):
            words[random.randrange(len(words))] = str(i)
        rows.append((i, " ".join(words)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute.near_duplicates(rows)


def test_op2_odd_rows(docs, empty):
    got = sorted(map(tuple, ngram_join.near_duplicates(docs).collect()), key=str)
    assert got == brute.near_duplicates([(r[0], r[1]) for r in brute.ROWS])
    assert ngram_join.near_duplicates(empty).count() == 0


def test_trie_finds_what_brute_force_finds():
    random.seed(2)
    for _ in range(30):
        sets = [np.array(sorted(random.sample(range(12), random.randint(1, 9)))) for _ in range(14)]
        sizes = [len(s) + random.choice([0, 0, 1]) for s in sets]
        links = ngram_join.block_links(list(range(14)), sizes, sets)
        group = list(range(14))
        for u, v in links:
            group = [group[u] if g == group[v] else g for g in group]
        own = list(range(14))
        for u in range(14):
            for v in range(u):
                common = len(set(sets[u].tolist()) & set(sets[v].tolist()))
                if 5 * common >= 4 * (sizes[u] + sizes[v] - common):
                    own = [own[u] if g == own[v] else g for g in own]
        assert len(set(group)) == len(set(own)) and len(set(zip(group, own))) == len(set(own))


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (105, 101)]
    got = {r["node"]: r["component"] for r in ngram_join.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 105: 100}


# Token files.


def test_op3_is_the_library(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, at = Tokenizer.from_file(path), 0
    files = token_files.write_token_files(docs, path, f"file://{tmp_path}/ids", ids_per_file=500)
    got = sorted(map(tuple, token_files.read_token_files(files).collect()), key=lambda r: r[1])
    expected = []
    for i, text in sorted(((r[0], r[1] or "") for r in brute.ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*lib.encode(text, add_special_tokens=False).ids, 0]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == expected
    assert token_files.read_token_files(token_files.write_token_files(empty, path, f"file://{tmp_path}/none")).count() == 0


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), token_files.Encoder(path)
    random.seed(4)
    texts = ["".join(random.choice("ab'stre llé½² \n\t\x0b\x1c\x85\xa0日!?-_.,09") for _ in range(random.randint(0, 60))) for _ in range(800)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("most", [1, 2, 300, 70_000, 2**32])
def test_codes_round_trip(tmp_path, most):
    rng = np.random.default_rng(most)
    ids = (rng.random(3000) ** 4 * most).astype(np.uint32)
    (tmp_path / "f").write_bytes(b"".join(token_files.encode_file(ids, [1, None], np.array([0, 10, 3000]))))
    f = token_files.TokenFile(f"file://{tmp_path}/f")
    assert (f.ids() == ids).all()
    assert [f[i] for i in range(0, 3000, 37)] == ids[::37].tolist()
    with pytest.raises(IndexError):
        f[3000]


# Quality.


def plain_features(text):
    words, places = brute.WORD.findall(text), collections.defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_op4_counts_and_verdicts(spark, real):
    rows = quality.op4_quality(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in real.collect()}
    for r in rows:
        assert tuple(r[c] for c in quality.COUNTS) == plain_features(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passed = [(r["kept"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(k == bool(q) for k, q in passed) > 0.95 * len(passed)


def test_op4_score_is_the_mean_log_ratio():
    weights = np.zeros(quality.BUCKETS)
    at = quality.buckets("ab")
    assert len(at) == 4 + 3 - 3 + 0 or len(at) > 0
    weights[at] = 2.0
    assert quality.QualityModel(weights).score("ab") == 2.0


def test_op4_verdicts_by_brute_force(spark):
    """Counts in plain loops, and every threshold between two scores tried."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and r["doc_id"] in texts}
    every, trusted = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t in texts.items():
        for b in quality.buckets(t):
            every[b] += 1
            trusted[b] += good.get(i) == 1
    share = lambda c: (c + quality.SMOOTHING) / (c.sum() + quality.SMOOTHING * quality.BUCKETS)
    weights = np.log(share(trusted) / share(every))
    score = {i: float(np.mean([weights[b] for b in quality.buckets(t)])) for i, t in texts.items()}
    sides = [[score[i] for i, y in good.items() if y == k] for k in (0, 1)]
    gain = lambda t: np.mean([s < t for s in sides[0]]) - 5 * np.mean([s < t for s in sides[1]])
    model = quality.fit_quality(docs, labels)
    cuts = sorted(set(sides[0] + sides[1]))
    assert gain(model.threshold) == pytest.approx(max(0.0, *(gain((a + b) / 2) for a, b in zip(cuts, cuts[1:], strict=False))))
    rows = quality.op4_quality(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["quality_score"] == pytest.approx(score[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and score[r["doc_id"]] >= model.threshold)


def test_op4_one_text_an_id_finds_the_threshold(spark):
    rows = [(i, ("good plain words here " if i % 2 else "zzz qqq xxx ") * 9) for i in range(20)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    once, often = (quality.fit_quality(d, labels, sample=10) for d in (docs, docs.unionByName(docs).unionByName(docs)))
    for m in (once, often):
        assert m.score(rows[1][1]) > m.threshold > m.score(rows[0][1])


def test_op4_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (7, 0), (None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.quality(docs.drop("n"), quality.fit_quality(docs, labels)).collect()
    assert len(rows) == len(brute.ROWS)
    for r in rows:
        assert tuple(r[c] for c in quality.COUNTS) == plain_features(r["text"] or "")
    nothing = quality.fit_quality(empty, labels)
    assert quality.quality(empty, nothing).count() == 0


# WARC.


def test_op5_is_brute_force(spark, tmp_path):
    pages = [
        (1, "http://A.example.com/x?b=1", "hello"), (2, "http://a.example.com/x?b=1", "hello"), (3, None, ""), (4, "http://b.org", None), (5, "http://c d.org/ü x\r\n", "žluť"), (6, "bad://[x", "hello"),
        (7, "http://z.net:80/", "x" * 100_000), (None, "http://z.net:80/", "q"), (7, "http://z.net:80/", "x" * 100_000),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))

    def run(least):
        shards = warc.write_index(warc.write_archives(df, f"file://{tmp_path}/a", min_bytes=least, archive_bytes=200), f"file://{tmp_path}/i")
        return shards, sorted((tuple(r)[:5] for r in warc.read_captures(warc.find_captures(shards, df)).collect()), key=str)

    def expected(least):
        best, out = {}, []
        for i, _, h in pages:
            b = (h or "").encode()
            best[b] = max(best.get(b, -1), -1 if i is None else i)
        for i, _, h in pages:
            b = (h or "").encode()
            m = best[b]
            same = len(b) >= least and (-1 if i is None else i) != m
            digest = __import__("base64").b32encode(hashlib.sha1(b).digest()).decode()
            out.append((i, len(b), digest, "revisit" if same else "response", m if same else None))
        return sorted(out, key=str)

    shards, got = run(0)
    assert got == expected(0)
    assert run(3)[1] == expected(3)
    one = spark.createDataFrame([("http://a.example.com/x?b=1",), ("http://nowhere.example/",)], "url string")
    assert sorted(r["page_id"] for r in warc.read_captures(warc.find_captures(shards, one)).collect()) == [1, 2]


def test_op5_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    shards = warc.write_index(warc.write_archives(none, f"file://{tmp_path}/a"), f"file://{tmp_path}/i")
    assert warc.read_captures(warc.find_captures(shards, none)).count() == 0


def test_index_search(tmp_path):
    lines = [(f"k{i // 3:04d}", i, "f", i, 1) for i in range(900)]
    (tmp_path / "s").write_bytes(b"".join(warc.shard_bytes(lines, 64)))
    shard = warc.IndexShard(f"file://{tmp_path}/s")
    for i in range(300):
        assert [x[1] for x in shard.find(f"k{i:04d}")] == [3 * i, 3 * i + 1, 3 * i + 2]
    assert not list(shard.find("k")) and not list(shard.find("z"))


def test_url_keys():
    assert warc.url_key("https://www.Example.com:8080/a b?c") == "com,example,www:8080)/a%20b?c"
    assert warc.url_key(None) == "-"


# Mixing.


def plain_mix(rows, block):
    """{row: (taken, slots, first slot)} of (id, size, source), by walking through the schedule word block by word block."""
    names = sorted({r[2] for r in rows}, key=lambda x: (x is None, x))
    sizes = {x: sum(r[1] for r in rows if r[2] == x) for x in names}
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    target, total, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[x] for x in free)
        full = {x for x in free if weight[x] * level > 2 * sizes[x]}
        target |= {x: 2.0 * sizes[x] for x in full} if full else {x: weight[x] * level for x in free}
        free = free - full if full else set()
    goal = {x: math.floor(target[x]) for x in names}
    out, at, read = {k: [0, 0, None] for k in range(len(rows))}, 0.0, collections.Counter()
    laid = {}
    for x in names:
        order = sorted((hashlib.md5(str(r[0] if r[0] is not None else "").encode()).hexdigest(), r[0] if r[0] is not None else -1, r[1], k) for k, r in enumerate(rows) if r[2] == x)
        laid[x] = [k for *_, k in order for _ in range(rows[k][1])]
    everything = sum(goal.values())
    for slot in range(-(-everything // block)):
        point = slot * 2654435769 % 2**32 / 2**32 * everything
        at = 0
        for x in names:
            at += goal[x]
            if point < at:
                break
        nth, read[x] = read[x], read[x] + 1
        blocks = -(-sizes[x] // block)
        begin = nth % blocks * block
        until = min(begin + block, sizes[x], 2 * sizes[x] - nth // blocks * sizes[x])
        for k, n in collections.Counter(laid[x][begin : max(begin, until)]).items():
            out[k] = [out[k][0] + n, out[k][1] + 1, slot if out[k][2] is None else out[k][2]]
    return out, target


def test_op6_is_the_schedule(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(brute.ROWS)
    plain = [(r[0], len(brute.WORD.findall(r[1] or "")), r[3]) for r in brute.ROWS]
    expected, target = plain_mix(plain, max(1, sum(r[1] for r in plain) // 16384))
    got = collections.Counter((r["doc_id"], r["size"], r["source"], r["taken"], r["slots"], r["first_slots"][0] if r["first_slots"] else None) for r in rows)
    assert got == collections.Counter((*plain[k], *x) for k, x in expected.items())
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["first_slots"] == sorted(r["first_slots"]) and len(r["first_slots"]) <= 2
    taken = collections.Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[x] - t) <= 4 for x, t in target.items())
    assert mixing.mix(empty).count() == 0
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, rows))


def test_op6_takes_near_its_targets(spark):
    taken, target = collections.Counter(), {}
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in rows)
    assert all(abs(taken[x] - t) <= 5 * (total // 16384) for x, t in target.items()), (taken, target)  # blocks


def test_op6_schedule_is_even(spark):
    shares = spark.createDataFrame([("a", 50), ("b", 30), (None, 20)], "source string, goal long")
    slots = mixing.schedule(shares, 10_000).collect()
    count = collections.Counter(r["source"] for r in slots)
    assert len(slots) == 10_000 and all(abs(count[x] - 100 * n) <= 5 for x, n in (("a", 50), ("b", 30), (None, 20)))
    for x in ("a", "b", None):
        own = sorted((r["rank"], r["slot"]) for r in slots if r["source"] == x)
        assert [k for k, _ in own] == list(range(len(own))) and [t for _, t in own] == sorted(t for _, t in own)
    early = sum(r["source"] == "a" for r in slots if r["slot"] < 50)
    assert abs(early - 25) <= 3


# Language model.


def test_sequences_find_every_value():
    rng = np.random.default_rng(0)
    for n, u in ((1, 1), (1, 1000), (1000, 1100), (5000, 10**9), (300, 300)):
        values = np.sort(rng.choice(u, n, replace=False))
        arrays, bits = lm.elias_fano(values, u, "x")
        asked = np.concatenate([values, rng.integers(0, u, 500)])
        at = {x: i for i, x in enumerate(values.tolist())}
        assert lm.Sequence(type("A", (), arrays), "x", bits).find(asked).tolist() == [at.get(x, -1) for x in asked.tolist()]


def test_masses_are_rounded_down():
    m = np.linspace(1e-9, 1, 1000)
    back = lm.MASS[lm.quantise(m)]
    assert (back <= m * (1 + 1e-9)).all() and (back >= m * 0.9).all()


def plain_model(rows):
    """{id: (held out, tokens, known, training tokens, log10 unigram probability, log10 probability)}, by dictionaries of all n-grams."""
    text = [(i, [*brute.WORD.findall(brute.lower(t)), None]) for i, t in rows]
    learn = [w for i, w in text if not brute.held_out(i, 10)]
    c1 = collections.Counter(x for w in learn for x in w)
    c2 = collections.Counter(p for w in learn for p in zip([None, *w], w))
    c3 = collections.Counter(p for w in learn for p in zip([None, *w], w, w[1:]))
    total, distinct = sum(c1.values()), len(c1)
    types1, types2 = collections.Counter(a for a, _ in c2), collections.Counter((a, b) for a, b, _ in c3)
    out = {}
    for i, w in text:
        base = score = 0.0
        for k, x in enumerate(w):
            a, h = w[k - 1] if k else None, (w[k - 2] if k > 1 else None, w[k - 1] if k else None)
            p = (c1[x] + 0.1) / (total + 0.1 * (distinct + 1))
            base += math.log10(p)
            if c1[a]:
                p = max(c2[a, x] - 0.75, 0) / c1[a] + 0.75 * types1[a] / c1[a] * p
            if k and c2[h]:
                p = max(c3[*h, x] - 0.75, 0) / c2[h] + 0.75 * types2[h] / c2[h] * p
            score += math.log10(p)
        out[i] = brute.held_out(i, 10), len(w), sum(c1[x] > 0 for x in w), total, base, score
    return out


@pytest.mark.parametrize("tokens", [2_500_000, 3000])
def test_op7_is_a_plain_model(spark, real, monkeypatch, tokens):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", tokens)
    expected = plain_model([(r["doc_id"], r["text"]) for r in real.collect()])
    for r in lm.op7_lm_scoring(spark, SF).collect():
        held, n, known, total, base, score = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held)
        assert r["base_score"] == pytest.approx(base)
        assert abs(r["score"] - score) <= 0.06 * n  # bytes for masses


def test_op7_odd_rows(spark, docs, empty, tmp_path):
    rows = docs.withColumns({"id": F.col("doc_id"), "train": F.lit(True), "chunk": F.lit(1), "data": F.lit(2)})
    model, scores = lm.fit_and_score(rows, f"file://{tmp_path}/lm")
    got = scores.collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(brute.WORD.findall(r[1] or "")) + 1 for r in brute.ROWS)
    assert sorted(map(str, (r["id"] for r in got))) == sorted(str(r[0]) for r in brute.ROWS)
    again = lm.score_lm(rows, lm.fit_lm(docs, f"file://{tmp_path}/again")).collect()
    rounded = lambda found: sorted((str(r["id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in found)
    assert rounded(again) == rounded(got)
    nothing = lm.fit_lm(empty.select("text"), f"file://{tmp_path}/none")
    assert nothing.total == 0
    assert all(r["base_score"] == pytest.approx(0) and math.isfinite(r["score"]) for r in lm.score_lm(rows, nothing).collect())
    named = rows.withColumn("id", F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    assert {r["id"] for r in lm.score_lm(named, model).collect()} == {None, *(f"x{i}" for i in range(9))}
    assert lm.score_lm(rows.where("false"), model).count() == 0


def test_wide_chunks_have_the_same_ngrams():
    """Where a triple of numbers would not fit in a word, n-grams are numbered in two steps."""
    rng = np.random.default_rng(3)
    numbers, train, sizes = np.r_[-1, np.unique(rng.integers(0, 1 << 20, 500))], np.arange(40) % 3 > 0, np.full(40, 100)
    end, place = int(numbers[7]), rng.integers(0, len(numbers), 4000)
    place[99::100] = 7
    wide = np.arange(-1, 1 << 20)
    one, many = lm.Chunk(numbers, place, sizes, train, end), lm.Chunk(wide, numbers[place] + 1, sizes, train, end)
    for a, b in zip(one.grams(1 << 20, 7), many.grams(1 << 20, 7), strict=True):
        assert (a == b).all()


# Toxicity.


def test_op8_learns(spark):
    random.seed(1)
    plain = lambda: " ".join(random.choice("the of and river stone window garden walking quiet letter morning table answer".split()) + random.choice(["", "s", "ly", "er"]) for _ in range(80))
    def rude():
        words = plain().split()
        for _ in range(6):
            words[random.randrange(80)] = random.choice(["blistering", "numbskull", "scallywag"])
        return " ".join(words)

    model = toxicity.fit([rude() for _ in range(60)], [plain() for _ in range(120)])
    assert (model.scores([rude() for _ in range(40)]) >= 0.5).mean() > 0.9
    assert (model.scores([plain() for _ in range(40)]) >= 0.5).mean() < 0.1


def test_op8_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op8_toxicity(spark, sf).collect()]
    assert all(r["held_out"] == brute.held_out(r["doc_id"], 5) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == y for p, y in held) > 0.93 * len(held)


def test_op8_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (7, 0), (None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, folds=10**9)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == len(brute.ROWS) and all(0 <= r["toxicity"] <= 1 for r in rows)
    unlabelled = toxicity.fit_toxicity(docs, labels.where("false"))
    assert {r["toxicity"] for r in toxicity.score_toxicity(docs, unlabelled).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, model).count() == 0


# SentencePiece.


def test_op9_is_the_library(docs, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentencepieces.encode_pieces(docs, path).collect()
    assert len(rows) == len(brute.ROWS)
    expected = collections.Counter()
    for i, t, *_ in brute.ROWS:
        ids = lib.encode(t or "", add_eos=True)
        expected[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r)[:4] for r in rows) == expected
    assert sentencepieces.encode_pieces(empty, path).count() == 0


def test_agenda_is_the_library():
    v = sentencepieces.vocabulary(P.path("piece_bpe_32k.model"))
    random.seed(1)
    for _ in range(5):
        texts = ["".join(random.choice("abcdeethinsr ▁  \n.,!éü\U0001f600日") for _ in range(random.randint(0, 200))) for _ in range(200)]
        assert [np.frombuffer(x, "<i4").tolist() for x in v.encode(texts)] == v.lib.encode(texts, num_threads=1)
    long = "x" * 300 + "the" * 50
    v._rows([long])
    assert v._ids(v._heap(long)) == np.frombuffer(v.cache.pop(long), "<i4").tolist()


def test_agenda_holds_ranks_alone():
    """Matrices of 32-bit numbers; merged pieces come from their ranks, from the pairs only where scores are equal."""
    v = sentencepieces.MergeVocabulary(P.path("piece_bpe_32k.model"))
    assert v.symbol.dtype == v._ranks.dtype == np.int32 and (v._piece >= 0).any() and (v._piece < 0).any()
    asked = []
    v._pairs = lambda left, right, what, other, f=v._pairs: asked.append(what is v._merged) or f(left, right, what, other)
    texts = ["another small ring", "the first one there", "internationalization  of 1234567 things \u2581\u2581 \U0001f600"]
    once = v.encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in once] == v.lib.encode(texts, num_threads=1)
    few = sum(asked)
    v.cache, asked[:] = {"": b""}, []
    v._piece[:] = -1
    assert v.encode(texts) == once and few < sum(asked)


def test_stretches_outlive_their_generation(monkeypatch):
    v = sentencepieces.MergeVocabulary(P.path("piece_bpe_32k.model"))
    monkeypatch.setattr(sentencepieces, "CACHED", 3)
    texts = ["the first text", "another one here", "the first text again", "", "x" * 70, "the first one"]
    for t in texts + texts:
        assert np.frombuffer(v.encode([t])[0], "<i4").tolist() == v.lib.encode(t)
        assert len(v.cache) <= 3 + 8


def test_stretches_of_a_batch_are_looked_up_once(monkeypatch):
    """However often a batch has a stretch, the cache is asked a few times; ids of one length go there together, not round by round."""

    class Asked(dict):
        times = 0

        def get(self, key, default=None):
            self.times += 1
            return super().get(key, default)

        def __getitem__(self, key):
            self.times += 1
            return super().__getitem__(key)

    v = sentencepieces.MergeVocabulary(P.path("piece_bpe_32k.model"))
    v.cache, put = Asked({"": b""}), []
    monkeypatch.setattr(v, "_keep", lambda texts, symbols, f=v._keep: put.append(len(texts)) or f(texts, symbols))
    texts = ["one word and one more " * 500, "", "word", "more\0 words\0\0 \u2581\u2581\u2581 x\u2581y \U0001f600", "\u65e5" * 100]
    for _ in range(2):
        assert [np.frombuffer(x, "<i4").tolist() for x in v.encode(texts)] == v.lib.encode(texts, num_threads=1)
    assert v.cache.times < 100
    monkeypatch.setattr(v, "_parts", lambda texts: pytest.fail("no texts, no parts"))
    assert v.encode([]) == []
    v._rows(words := ["a", "é", "\u2581", "\U0001f600"])
    assert all(w in v.cache for w in words)
    put.clear()
    v._rows(["internationally", "zzzzzzzzzzzzzzz", "the the the the"])
    assert put == [3]


def test_ids_in_decimals():
    v = sentencepieces.vocabulary(P.path("piece_bpe_32k.model"))
    for ids in ([], [0], [2], [v.size - 1, 0, 10, 999, 10000, 7]):
        assert v.decimals(np.array(ids, "<i4").tobytes()) == " ".join(map(str, ids)).encode()


def test_op9_takes_ids_of_any_type_and_marks_what_differs(spark, monkeypatch):
    path = P.path("piece_bpe_32k.model")
    df = spark.createDataFrame([("a1", "some text", 1), (None, None, 2), ("a1", "some text", 3)], "doc_id string, text string, ids int")
    rows = sentencepieces.encode_pieces(df, path).collect()
    assert [r["doc_id"] for r in rows] == ["a1", None, "a1"] and all(r["agrees"] for r in rows) and rows[1]["n_tokens"] == 1
    assert rows[0]["ids"] == sentencepieces.vocabulary(path).lib.encode("some text", add_eos=True)


# Line dedup.


def test_op10_is_brute_force(spark):
    random.seed(3)
    lines = [" ".join(random.choice("abcdef") for _ in range(random.randint(0, 7))) for _ in range(12)]
    rows = [(i, "\n".join(random.choice(lines) for _ in range(random.randint(1, 12)))) for i in range(60)]
    for least in (1, 4, 10):
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least).collect()}
        # Between two deleted stretches that touch, lines without a word stay.
        worded = lambda texts: {i: [x for x in t.split("\n") if x] for i, t in texts.items()}
        assert worded(got) == worded(brute.dedup_lines(rows, least))


def test_op10_odd_rows(docs, empty):
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == len(brute.ROWS) and set(docs.columns) <= set(rows[0].asDict())
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["text"] is None and by[1]["line_count"] == 0
    assert by[2]["text"] == "" and by[3]["text"] == " \t\n "
    assert by[5]["text"] == "own words" and by[0]["deleted_lines"] == 0
    assert by[6]["deleted_lines"] == 2 and by[6]["text"] == ""
    assert line_dedup.dedup_lines(empty).count() == 0
