"""Vector codes, resampling and quality rules against brute force on hard rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, queries, resampling, vector_codes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VECTORS = "vec_id long, embedding array<float>, label int, code string"


def plain_codes(rows, parts=16, size=64, rounds=2):
    """The contract in Python's whole numbers: {(vec_id, code, error, label_error)}, digest."""
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    cut = []
    for _, v, _ in kept:
        w = [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (parts * width - len(v))
        cut.append([w[p * width : (p + 1) * width] for p in range(parts)])
    books = [[c[p] for c in cut[:size]] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            given = {}
            for c in cut:
                given.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(given[k]) for x in zip(*given[k])] if k in given else e for k, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = Counter()
    for (_, _, lab), e in zip(kept, errors):
        labels[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, labels[lab], digest) for (i, _, lab), f, e in zip(kept, found, errors))


def vectors(n, length, scale=0.15, seed=1):
    random = np.random.default_rng(seed)
    rows = [(i, random.normal(0, scale, length).astype(np.float32).tolist(), int(random.integers(4)) if i % 7 else None) for i in range(n)]
    rows += [(3, rows[3][1], 1), (5, rows[9][1], 1), (None, rows[4][1], 2)]
    rows += [(n + 1, None, 1), (n + 2, [*rows[0][1][:-1], None], 1), (n + 3, [*rows[0][1][:-1], float("nan")], 1), (n + 4, [float("-inf"), *rows[0][1][1:]], 1), (n + 5, [], 1), (n + 6, [1.0], 1)]
    return rows


@pytest.mark.parametrize("n, length, scale, parts, size", [(300, 64, 0.15, 16, 64), (90, 20, 0.002, 16, 64), (40, 7, 900.0, 4, 64), (200, 32, 1e4, 16, 9)])
def test_vector_codes_by_brute_force(spark, n, length, scale, parts, size):
    rows = vectors(n, length, scale)
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(5)
    got = vector_codes.vector_codes(df, parts=parts, size=size)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_codes(rows, parts, size)


def test_nearest_with_ties_and_sizes_that_float32_cannot_tell():
    random = np.random.default_rng(4)
    for high, width in ((2, 4), (50, 4), (1 << 13, 4), (1 << 26, 4), (vector_codes.largest(4), 4), (vector_codes.largest(48), 48)):
        entries = random.integers(-high, high + 1, (64, width))
        entries[40], entries[41] = entries[3], entries[3] + 1
        x = np.concatenate([random.integers(-high, high + 1, (200, width)), entries, entries + 1, (entries + entries[::-1]) // 2])
        x = np.clip(x, -vector_codes.largest(width), vector_codes.largest(width))
        entry, distance = vector_codes.nearest(x, entries)
        whole = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)) for e in entries] for r in x]
        assert distance.tolist() == [min(w) for w in whole] and entry.tolist() == [w.index(min(w)) for w in whole]
    assert 2 * vector_codes.largest(4) == math.isqrt((2**63 - 1) // 4) // 2 * 2


def test_huge_components_count_as_the_largest(spark):
    df = spark.createDataFrame([(0, [1e30, 0.0], 1), (1, [-3e38, 2.0], 1), (2, [0.0, 1.0], None)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in vector_codes.vector_codes(df, parts=1, size=1).collect()}
    assert len(got) == 3 and all(0 <= r["error"] < 2**63 for r in got.values()) and got[2]["label_error"] == got[2]["error"]
    assert got[0]["label_error"] == min(got[0]["error"] + got[1]["error"], 2**63 - 1)


def test_labels_hot_and_cold_get_their_sums(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 0.2)
    df = spark.range(500).select((F.col("id") % 7).alias("error"), F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 1000).otherwise(F.col("id")).cast("int").alias("label"))
    sums = Counter()
    for e, lab in df.collect():
        sums[lab] += e
    got = vector_codes.with_label_error(df).collect()
    assert len(got) == 500 and all(r["label_error"] == sums[r["label"]] for r in got)


def test_codes_decode_to_their_entries(spark):
    rows = [(*r, "x") for r in vectors(120, 30)[:120]]
    df = spark.createDataFrame(rows, VECTORS)
    books = vector_codes.fit_codebooks(vector_codes.usable(df))
    got = vector_codes.encode(vector_codes.usable(df), books, ["vec_id", "embedding"]).withColumn("back", vector_codes.decode("code", books)).collect()
    for r in got:
        x, back = vector_codes.whole(np.array([r["embedding"]]), 16), vector_codes.whole(np.array([r["back"]]), 16)
        assert len(r["back"]) == 30 and ((x - back)[0].ravel()[:30] ** 2).sum() <= r["error"]
    assert vector_codes.vector_codes(df.limit(0)).count() == 0
    assert vector_codes.vector_codes(df.where("vec_id < 0")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


TEXTS = [None, "", " \n\t", "...!!", "Ünï The the THE İ ſ a1b2_c3", "one-two three\x00four", "a" * 70_000, "Alpha beta\x85gamma　delta " * 9, "x y " * 400_000, "x", "x y", "the END. The end; tHE\x0bend"]


def plain_draw(docs, items, percent=25, runs=2, buckets=10_000, least=20, seed=7):
    said = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def found(text):
        w = said(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    every = [found(t) for _, t in docs]
    raw, target = Counter(b for f in every for b in f), Counter(b for t in items for b in found(t))
    s, t = sum(raw.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1.0) * (s + buckets) / ((raw[b] + 1.0) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for (i, text), f in zip(docs, every):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(said(text)) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k for k, r in enumerate(able[: len(able) * percent // 100], 1)}
    return Counter((*r[:4], rank.get(id(r))) for r in rows)


@pytest.mark.parametrize("runs, percent", [(2, 25), (1, 100), (3, 60)])
def test_resampling_by_brute_force(spark, runs, percent):
    random = np.random.default_rng(2)
    texts = TEXTS + [" ".join(random.choice(["the", "of", "Zeta", "é", "b2", "c,d"], random.integers(5, 60))) for _ in range(60)]
    docs = [(i * 3, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (30, texts[-2])]
    items = ["the of the of zeta", None, "é é b2"]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, buckets int").repartition(4)
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id int, text string")
    got = resampling.resampled(df, benchmark, percent, runs)
    assert Counter(map(tuple, got.collect())) == plain_draw(docs, items, percent, runs)


def test_resampling_of_repeats_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(25))
    df = spark.createDataFrame([(4, text), (4, text), (4, text), (1, text)], "doc_id long, text string")
    got = resampling.resampled(df, df.select("text").limit(0), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len({(r["weight"], r["n_features"]) for r in got}) == 1
    assert resampling.resampled(df.limit(0), df).count() == 0


def test_ring_states_are_the_runs_checksums():
    w = [b"a", b"bc", "é".encode(), b"a", b"7"]
    for runs in (1, 2, 3, 5, 9):
        want = Counter(zlib.crc32(b" ".join(w[i : i + k])) for k in range(1, runs + 1) for i in range(len(w) - k + 1))
        assert Counter(resampling.states(w, runs)) == want
    assert resampling.states([], 2) == []


def plain_quality(text):
    text = text or ""
    w, n = re.findall(r"[^\x20\x09-\x0D]+", text), 0
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times = Counter(zip(w, w[1:], w[2:]))
    n = len({i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)})
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w)


def test_quality_base_by_brute_force(spark):
    random = np.random.default_rng(6)
    texts = [None, "", " \n\v\f", "\n\nx\nx\n x\nx", "a b c a b c", "a a a a", "a a a", "a b", "\U0001f600é #*$%&|<> <b>", "a b　c \x1c d", "x" * 60_000, "p q r " * 60_000, "|\n" * 300]
    texts += ["".join(random.choice(["a", "b", "c", " ", "  ", "\n", "#", "\t", "é"], random.integers(1, 400))) for _ in range(80)]
    texts += [" ".join(map(str, random.permutation(90))) for _ in range(3)] + [" ".join(f"w{x}" for x in random.permutation(30_000)) * 2]
    df = spark.createDataFrame([(i, t, True, "r") for i, t in enumerate(texts)], "doc_id int, text string, kept boolean, row string").repartition(3)
    got = {r["row"]["doc_id"]: r for r in quality.quality(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] + (got[i]["base_failed"],) == plain_quality(t), (i, (t or "")[:50])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert quality.quality(df.limit(0)).count() == 0
    assert quality.well_made(df).columns == df.columns


def test_repeated_windows_whose_hashes_meet(spark, monkeypatch):
    monkeypatch.setattr(quality, "PLACE_BITS", 62)  # two bits of hash: nearly all windows look alike
    texts = [" ".join(map(str, range(60))), "a b c d a b c x y z", "q q q q r"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r["row"]["doc_id"]: r["n_repeat_words"] for r in quality.quality(df).collect()}
    assert got == {i: plain_quality(t)[4] for i, t in enumerate(texts)}


def test_quality_rules_and_clean_texts(spark):
    clean = "the report of the committee was written in spring and it describes how water moves through old stone".split()
    body = lambda k: " ".join(np.random.default_rng(k).permutation(clean * 5))
    texts = {
        "clean": body(3), "symbols": body(3).replace("the", "the###"), "shouting": body(3).replace("water", "water!!!!!!!!!!"),
        "few_letters": " ".join(f"{w} {i}" for i, w in enumerate(body(5).split())), "few_stop_words": " ".join(f"word{i}" for i in range(80)),
        "long_words": " ".join(f"the {'x' * 40}{i}" for i in range(60)), "bullets": "\n".join(f"- the item of {i} and {i * 7} words" for i in range(40)),
        "ellipses": "\n".join(f"the item of {i} and words {i * 7}a..." for i in range(40)), "repeated_lines": "the same old line of all\n" * 9 + body(7).replace(" ", " \n", 4),
        "short_words": " ".join(f"a {chr(97 + i % 26)}" if i % 2 else f"{chr(105 + i % 9)} o" for i in range(90)),
    }
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    got = {r["row"]["name"]: r for r in quality.quality(df).collect()}
    assert got["clean"]["kept"] and not got["clean"]["failed"]
    for name in texts:
        assert name == "clean" or name in got[name]["failed"], (name, got[name])
    assert all(r["kept"] for r in quality.quality(df, rules=[]).where("not base_failed").collect())
    assert not quality.quality(df, rules=[quality.Rule("none", "mean_word_chars", least=99)]).where("kept").count()
    plan = quality.quality(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_quality_equals_sql(spark):
    data = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}'")
    result = con.execute(queries.ORACLE_SQL["op13_quality"])
    names = [c[0] for c in result.description]
    got = queries.op13_quality(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select(names).collect())) == sorted(result.fetchall())


def test_quality_keeps_what_is_labelled_good(spark):
    docs = queries.op13_quality(spark, "/root/testdata/sf0.01").where("not base_failed")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    told = {(r["quality"], r["kept"]): r["n"] for r in docs.join(labels, "doc_id").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    good, bad = [told.get((q, k), 0) for q, k in ((1, True), (1, False))], [told.get((q, k), 0) for q, k in ((0, False), (0, True))]
    assert good[0] >= 0.99 * sum(good) and bad[0] >= 0.95 * sum(bad)
