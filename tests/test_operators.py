"""Operators that SQL cannot express, against brute force, and sources and streams."""

import itertools
import math
import os
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, clusters, density, intervals, joins, lines, ranges, ranking, sessions, smoothing, tracks
from tidemark.operators.components import connected_components
from tidemark.operators.filters import matching
from tidemark.sources import files, sinks
from tidemark.streaming import streams
from tidemark.streaming.streams import Framer, framed, upsert_recent


def test_least_cost_is_least_over_all_assignments(spark):
    random = np.random.default_rng(3)
    cost = random.random((6, 4, 4)).round(3)
    data = [(f, i, 10 + j, float(cost[f, i, j])) for f in range(6) for i in range(4) for j in range(4)]
    df = spark.createDataFrame(data, "frame int, left_id long, right_id long, cost double")
    got = {}
    for r in tracks.least_cost_assignment(df, ["frame"], 0.3).collect():
        got.setdefault(r["frame"], []).append(r)
    for f in range(6):
        options = []
        for chosen in itertools.product([None, 0, 1, 2, 3], repeat=4):
            used = [c for c in chosen if c is not None]
            if len(used) == len(set(used)):
                options.append(sum(0.3 if c is None else cost[f, i, c] for i, c in enumerate(chosen)))
        mine = got.get(f, [])
        assert len({r["right_id"] for r in mine}) == len(mine) == len({r["left_id"] for r in mine})
        assert math.isclose(sum(r["cost"] for r in mine) + 0.3 * (4 - len(mine)), min(options), abs_tol=1e-9)


def test_greedy_takes_nearest_pairs_first(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.2), (1, 1, 2, 0.1), (1, 2, 2, 0.15), (1, 2, 1, 0.9)], "frame int, left_id long, right_id long, cost double")
    assert {(r["left_id"], r["right_id"]) for r in tracks.greedy_assignment(df, ["frame"], 0.5).collect()} == {(1, 2)}
    assert {(r["left_id"], r["right_id"]) for r in tracks.greedy_assignment(df, ["frame"], 1.0).collect()} == {(1, 2), (2, 1)}


def test_tracks_end_after_missed_frames(spark):
    df = spark.createDataFrame([("a", f, v, i) for i, (f, v) in enumerate([(0, 1.0), (0, 9.0), (1, 1.4), (3, 1.6), (6, 1.6), (1, 9.1)])], "k string, frame long, v double, id long")
    got = {r["id"]: r["track"] for r in tracks.associate(df, ["k"], "frame", "v", "id", 1.0, 1).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 5: 1, 3: 0, 4: 2}


def test_chains_follow_least_cost_both_ways(spark):
    s = spark.createDataFrame([("a", 1, 0, 10, 5.0, 5.0), ("a", 2, 12, 20, 5.5, 6.0), ("a", 3, 11, 15, 9.0, 9.0), ("a", 4, 22, 30, 6.1, 7.0), ("a", 5, 100, 110, 7.0, 7.0)], "k string, id long, start_t long, end_t long, first_value double, last_value double")
    assert {r["id"]: r["chain"] for r in tracks.chain_links(s, ["k"], 10, 2.0).collect()} == {1: 0, 2: 0, 4: 0, 3: 1, 5: 2}


def test_dbscan_by_brute_force(spark):
    random = np.random.default_rng(5)
    p = np.vstack([random.normal(c, 0.3, (30, 2)) for c in (0, 4, 9)] + [random.uniform(-2, 12, (8, 2))])
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(p)], "k string, id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in density.dbscan(df, ["k"], "x", "y", "id", (1.0, 1.0), 0.5, 4).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    core = (d <= 0.5).sum(axis=1) >= 4
    for i, j in itertools.combinations(np.flatnonzero(core), 2):
        if d[i, j] <= 0.5:
            assert got[i] == got[j]
    reach = d[np.ix_(core, core)] <= 0.5
    for _ in range(7):
        reach = reach @ reach > 0
    assert len({got[i] for i in np.flatnonzero(core)}) == len({tuple(r) for r in reach})


def test_two_means_and_ransac_and_spline_and_filter(spark):
    values = [1.0, 2.0, 1.5, 10.0, 11.0, 10.0]
    df = spark.createDataFrame([("g", i, float(i), v) for i, v in enumerate(values)] + [("one", 9, 0.0, 3.0)], "k string, id long, x double, y double")
    got = {r["k"]: r for r in clusters.two_means(df, ["k"], "y").collect()}
    assert math.isclose(got["g"]["low_mean"], 1.5) and math.isclose(got["g"]["high_mean"], 31 / 3)
    assert got["one"]["low_mean"] == got["one"]["high_mean"] == 3.0
    line = spark.createDataFrame([("g", i, float(i), 2.0 * i + 1 if i % 5 else 90.0) for i in range(40)], "k string, id long, x double, y double")
    fit = lines.ransac_line(line, ["k"], "x", "y", "id", 0.5).first()
    assert math.isclose(fit["slope"], 2, abs_tol=1e-6) and fit["inliers"] == 32
    curve = smoothing.spline_at(df.where("k = 'g'"), ["k"], "x", "y", 1.0).toPandas()
    assert np.allclose(curve["y"], values)
    smooth = smoothing.smooth_constant_velocity(line, ["k"], "x", "y", "id", 1.0, 0.0).orderBy("x").toPandas()
    assert np.isfinite(smooth["smooth"]).all() and len(smooth) == 40


def test_components_of_a_long_chain_and_loops(spark):
    ids = np.random.default_rng(1).permutation(60).tolist()
    edges = list(zip(ids, ids[1:])) + [(100, 101), (7, 7), (200, 200), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "left long, right long")).collect())
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "left long, right long")).count() == 0


def test_sessions_do_not_depend_on_buckets(spark):
    t = np.random.default_rng(2).integers(0, 5000, 300).tolist()
    df = spark.createDataFrame([(i % 2, int(x), i) for i, x in enumerate(t)], "k long, t long, id long")
    few, many = (sessions.sessionise(df, "k", "t", "id", 20, b).orderBy("id").collect() for b in (10**6, 17))
    assert few == many


def test_stretches_do_not_depend_on_buckets(spark):
    random = np.random.default_rng(5)
    rows = [(None if i % 3 == 0 else i % 2, None if i == 40 else int(x), i, None if i % 7 == 0 else float(i % 4)) for i, x in enumerate(random.integers(0, 900, 120))]
    df = spark.createDataFrame(rows, "k long, t long, id long, v double")
    for f in (
        lambda b: sessions.lag_difference(df, ["k"], "t", "id", b).select("id", "gap"),
        lambda b: sessions.run_segments(df, ["k"], "t", "id", "v", b),
        lambda b: sessions.split_on_gap_or_jump(df, ["k"], "t", "id", "v", 15, 0.2, b).select("id", "part"),
    ):
        few, many = (sorted(map(tuple, f(b).collect()), key=repr) for b in (10**6, 17))
        assert few == many
    by_key = {}
    for k, t, i, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        by_key.setdefault(k, []).append((t, i))
    want = {i: None if n == 0 or t is None or found[n - 1][0] is None else t - found[n - 1][0] for found in by_key.values() for n, (t, i) in enumerate(found)}
    assert {r["id"]: r["gap"] for r in sessions.lag_difference(df, ["k"], "t", "id", 17).collect()} == want


@pytest.mark.parametrize(("head", "k"), [(20_000, 4), (3, 4), (2, 40)])
def test_suppression_by_brute_force(spark, monkeypatch, head, k):
    monkeypatch.setattr(ranking, "HEAD", head)
    random = np.random.default_rng(4)
    data = [(int(random.integers(3)), i, float(random.integers(50)), int(s := random.integers(100)), int(s + random.integers(1, 30))) for i in range(60)]
    df = spark.createDataFrame(data, "k long, id long, score double, s long, e long")
    got = sorted((r["k"], r["id"], r["rank"]) for r in ranking.top_k_suppressed(df, ["k"], "score", "id", "s", "e", k, 0.5).collect())
    want = []
    for key in {d[0] for d in data}:
        chosen = []
        for _, i, _, s, e in sorted((d for d in data if d[0] == key), key=lambda d: (-d[2], d[1])):
            over = lambda c: min(e, c[2]) - max(s, c[1]) >= max(0, 0.5 * min(e - s, c[2] - c[1]))  # noqa: B023, E731
            if len(chosen) < k and not any(map(over, chosen)):
                chosen.append((i, s, e))
        want += [(key, c[0], r) for r, c in enumerate(chosen, 1)]
    assert got == sorted(want)


def test_csv_scan_detects_and_types(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("time,lon,lat,名\n2024/1/2 3:04:05,10.5,20,甲\nbad,10,20,乙\n2024-01-02 03:04:05,200,20,丙\n".encode("gbk"))
    path = str(tmp_path / "b.csv")
    assert files.sample_encoding(spark, path) == "GBK"
    df = files.scan_csv(spark, path, "GBK")
    assert [(r["source_file"], r["source_row"]) for r in df.orderBy("source_row").collect()] == [("b.csv", 0), ("b.csv", 1), ("b.csv", 2)]
    kept = files.located_rows(df, "time", "lon", "lat").collect()
    assert len(kept) == 1 and kept[0]["名"] == "甲" and str(kept[0]["time"]) == "2024-01-02 03:04:05"
    assert sinks.original_rows(df, df.where("source_row = 1")).first()["名"] == "乙"
    assert files.detect_format(["﻿Time", "LON"], {"track": [{"time", "ts"}, {"lon", "x"}], "other": [{"a"}]}) == "track"
    assert files.scan_range(df, {"lon": (0, 100)}).count() == 2


def test_byte_order_mark_and_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿old,new\n 1 ,\n,2\n", encoding="utf-8")
    df = files.scan_csv(spark, str(tmp_path / "a.csv"))
    assert files.sample_encoding(spark, str(tmp_path / "a.csv")) == "UTF-8"
    got = files.aliased(df, {"new": ["old"], "none": ["gone"]}).orderBy("source_row").collect()
    assert [(r["new"], r["none"]) for r in got] == [("1", None), ("2", None)]
    (tmp_path / "r.csv").write_text("a,b\n1,2\n3\nx,4\n")
    assert [tuple(r) for r in files.drop_ragged(spark, str(tmp_path / "r.csv"), "a int, b int").collect()] == [(1, 2)]


def test_workbook_first_sheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>n</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="C2"><v>5</v></c></row></sheetData></worksheet>')
    got = files.scan_xlsx(spark, str(tmp_path / "w.xlsx"), ["name", "n", "absent"]).collect()
    assert [tuple(r) for r in got] == [("x", "5", None, "w.xlsx", 0)]


def test_sinks_write_nested_columns(spark, tmp_path):
    df = spark.range(2).withColumn("a", F.array("id", F.lit(7)))
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert sorted(r["a"] for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()) == ["[0,7]", "[1,7]"]
    assert spark.read.json(str(tmp_path / "j")).count() == 2


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_framer_resyncs_and_carries(step):
    packet = lambda b: b"\xaa\x55" + len(b).to_bytes(2, "big") + b
    data = b"noise\xaa" + packet(b"one") + b"\xaa\x55\xff\xff" + packet(b"") + packet(b"two") + packet(b"cut")[:-1]
    framer, got = Framer(b"\xaa\x55", most=1000), []
    for i in range(0, len(data), step):
        got += framer.feed(data[i : i + step])
    assert got == [b"one", b"", b"two"]


def test_framed_files(spark):
    df = spark.createDataFrame([("f", bytearray(b"xM\x00\x01aM\x00\x02bc")), ("empty", bytearray()), ("null", None)], "path string, content binary")
    assert [(r["packet"], bytes(r["body"])) for r in framed(df, b"M").orderBy("packet").collect()] == [(0, b"a"), (1, b"bc")]


def _in_two(spark, df, path):
    """A folder whose two files come one after the other."""
    for part in range(2):
        df.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("buckets", [1, 3])
def test_upsert_keeps_latest_of_each_key(spark, tmp_path, buckets):
    out = str(tmp_path / "out")
    read = lambda most: {tuple(r) for r in streams.read_recent(spark, out, "k long, t long", "t", most).collect()}
    assert read(2) == set()
    rows = [(k, t, part) for part, more in enumerate([[(1, 1), (2, 2), (3, 5), (None, 1)], [(1, 11), (2, 12), (3, 4), (1, 3)]]) for k, t in more]
    stream = _in_two(spark, spark.createDataFrame(rows, "k long, t long, part int"), str(tmp_path / "in"))
    upsert_recent(stream, out, str(tmp_path / "c"), "k", "t", 2, buckets).awaitTermination()
    assert read(2) == {(1, 11), (2, 12)}
    upsert_recent(stream, out, str(tmp_path / "d"), "k", "t", 4, buckets).awaitTermination()  # a new checkpoint goes on
    assert read(4) == {(1, 11), (2, 12), (3, 5), (None, 1)}
    one = _in_two(spark, spark.createDataFrame([(2, 20, 0), (2, 21, 1)], "k long, t long, part int"), str(tmp_path / "more"))
    upsert_recent(one, out, str(tmp_path / "e"), "k", "t", 4, buckets).awaitTermination()
    assert read(1) == {(2, 21)} and read(9) == {(1, 11), (2, 21), (3, 5), (None, 1)}
    names = [p.name for p in (tmp_path / "out").iterdir()]
    assert sum(n.startswith("version-") for n in names) <= 2 * buckets and sum(n.startswith("manifest-") for n in names) == 2
    written = [p for p in (tmp_path / "out").glob("version-*/_bucket=*")]
    assert len({p.name for p in written}) <= buckets and len(written) <= 2 * buckets + 1


def test_gate_over_micro_batches_forgets_quiet_keys(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [(1, 0, 9.0, 0), (1, 5, 9.0, 0), (1, 12, -9.0, 0), (2, 0, 9.0, 0), (2, 4, None, 0), (1, 500, 9.0, 1), (2, 1, 9.0, 1), (3, 2000, 1.0, 1), (1, 3, 9.0, 2), (None, 3000, 9.0, 2), (2, 3001, 9.0, 2), (2, None, 9.0, 2)]
    df = spark.createDataFrame([(k, None if t is None else at(t), v, p) for k, t, v, p in rows], "k long, ts timestamp_ntz, v double, part int")
    for part in range(3):
        df.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    said = streams.gate(stream, "k", "ts", "v", 5.0, 10_000_000, 100_000_000, "10 seconds")
    query = streams.publish(said, str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    zero = int((at(0) - datetime(1970, 1, 1)).total_seconds())
    got = {(r["key"], r["t"] // 1_000_000 - zero): (r["state"], r["edge"]) for r in spark.read.schema(said.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {
        (1, 0): ("holding", False), (1, 5): ("holding", False), (1, 12): ("confirmed", True), (2, 0): ("holding", False), (2, 4): ("stable", False),
        (1, 500): ("holding", False), (2, 1): ("late", False), (3, 2000): ("stable", False), (1, 3): ("late", False), (None, 3000): ("holding", False), (2, 3001): ("holding", False),
    }
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert kept[-1] < max(kept) and sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3


def test_formats_of_files_by_their_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeff"Time",LON\n1,2\n3,4\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("A;x\n")
    (tmp_path / "c.csv").write_text("zzz\n1\n")
    (tmp_path / "d.csv").write_text("")
    rules = {"track": [{"time", "ts"}, {"lon", "x"}], "other": [{"a"}]}
    got = {r["source_file"]: (r["format"], r["rows"]) for r in files.file_formats(spark, str(tmp_path), rules).collect()}
    assert got == {"a.csv": ("track", 2), "b.csv": (None, 0), "c.csv": (None, 1)}
    assert {r["source_file"]: r["format"] for r in files.file_formats(spark, str(tmp_path), rules, ";").collect()}["b.csv"] == "other"


def test_packets_go_on_in_the_next_read(spark, tmp_path):
    packet = lambda b: b"M" + len(b).to_bytes(3, "big") + b
    bodies = [b"one", b"", b"x" * 70_000, b"M\x00", b"last"]
    data = b"?" + b"".join(map(packet, bodies)) + packet(b"cut")[:-1]
    reads = [("s", i, data[i * 999 : i * 999 + 999], int(i > 40)) for i in range(len(data) // 999 + 1)] + [("t", 0, None, 0), ("t", 1, packet(b"t"), 1)]
    stream = _in_two(spark, spark.createDataFrame(reads, "stream string, seq long, content binary, part int"), str(tmp_path / "in"))
    streams.publish(streams.framed_stream(stream, b"M", 3), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = [(r["stream"], r["packet"], bytes(r["body"])) for r in spark.read.schema("stream string, packet long, body binary").parquet(str(tmp_path / "out")).orderBy("stream", "packet").collect()]
    assert got == [("s", i, b) for i, b in enumerate(bodies)] + [("t", 0, b"t")]


def test_batches_begin_at_the_first_record_and_lose_none(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("a", at(5), 1, 0), ("a", at(14), 2, 0), ("a", at(15), 3, 0), ("b", at(0), 4, 0), (None, at(1), 5, 0), ("a", at(2), 6, 1), ("a", at(24), 7, 1), ("a", at(25), 8, 1), ("a", at(90), 9, 1), ("a", None, 10, 1)]
    stream = _in_two(spark, spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, part int"), str(tmp_path / "in"))
    streams.publish(streams.batched_from_first(stream, "k", "ts", "id", 10_000_000), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {r["id"]: r["batch"] for r in spark.read.schema("key string, id long, batch long").parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 1, 7: 1, 8: 2, 9: 3}


def test_a_new_epoch_leaves_the_old_one(spark, tmp_path):
    spark.range(6).withColumn("part", F.col("id") % 2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, part long").parquet(str(tmp_path / "in"))
    for part in (0, 1):
        streams.publish_epoch(stream.where(F.col("part") == part), str(tmp_path / "e")).awaitTermination()
        assert {r["id"] for r in streams.read_epoch(spark, str(tmp_path / "e"), stream.schema).collect()} == {part, part + 2, part + 4}


def test_streamed_association_equals_the_batch(spark, tmp_path):
    random = np.random.default_rng(8)
    rows = [("ab"[i % 2], f, float(random.integers(0, 30)), 100 * f + i) for f in range(8) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, frame long, v double, id long")
    want = {(r["id"], r["track"]) for r in tracks.associate(df, ["k"], "frame", "v", "id", 3.0, 1).collect()}
    for part in range(2):
        df.where(F.floor(F.col("frame") / 4) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.associated(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "k", "frame", "v", "id", 3.0, 1)
    streams.publish(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.schema("key string, frame long, id long, track long").parquet(str(tmp_path / "out")).collect()
    assert {(r["id"], r["track"]) for r in got} == want


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sessions_of_null_keys_and_times(spark):
    rows = [(1, 5, 0), (1, None, 1), (None, 5, 2), (None, 500, 3), (None, None, 4), (1, 100, 5), (1, 8, 6)]
    df = spark.createDataFrame(rows, "k long, t long, id long")
    got = {r["id"]: r["session"] for r in sessions.sessionise(df, "k", "t", "id", 10, 50).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0}


def test_sorted_places_of_all_rows(spark):
    rows = [(i * 7919 % 1009, i % 3, i) for i in range(3000)] + [(None, 0, 9000), (5, None, 9001)]
    df = spark.createDataFrame(rows, "a long, b long, id long").repartition(5)
    got = {r["id"]: r["place"] for r in ranking.sorted_places(df, F.col("b"), F.desc("a"), F.col("id")).collect()}
    low = lambda v: -1 if v is None else v
    want = sorted(rows, key=lambda r: (low(r[1]), -low(r[0]), r[2]))
    assert got == {r[2]: k for k, r in enumerate(want, 1)}
    assert ranking.sorted_places(df.limit(0), F.col("id")).count() == 0


def test_encodings_of_each_file_by_all_of_it(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,名\n1,甲\n".encode())
    (tmp_path / "b.csv").write_bytes("k,名\n".encode() + b"2,plain\n" * 20_000 + "3,乙\n".encode("gbk"))
    path = str(tmp_path)
    assert {r["source_file"]: r["encoding"] for r in files.file_encodings(spark, path).collect()} == {"a.csv": "UTF-8", "b.csv": "GBK"}
    assert files.sample_encoding(spark, path) == "GBK" and files.sample_encoding(spark, str(tmp_path / "a.csv")) == "UTF-8"
    got = files.scan_csv_guessed(spark, path)
    assert got.columns == ["k", "名", "source_file", "source_row"]
    assert {tuple(r) for r in got.where("k <> 2").collect()} == {("1", "甲", "a.csv", 0), ("3", "乙", "b.csv", 20_000)}


def test_nullable_parse(spark):
    df = spark.createDataFrame([("1",), (" 2 ",), ("x",), (" ",), (None,)], "a string")
    assert [tuple(r) for r in df.select(files.parsed("a", "bigint"), files.parsed("a", "bigint", -1)).collect()] == [(1, 1), (2, 2), (None, -1), (None, -1), (None, -1)]


def test_report_filters(spark):
    df = spark.createDataFrame([("Alpha", 1), ("beta", 5), (None, 3), ("alphabet", None)], "name string, n int")
    found = lambda *a: sorted((tuple(r) for r in matching(df, *a).collect()), key=repr)
    assert found({"name": " ALPHA "}) == [("Alpha", 1), ("alphabet", None)]
    assert found({"name": "  "}, {"n": (None, None)}, {"n": []}) == sorted(map(tuple, df.collect()), key=repr)
    assert found(None, {"n": (2, None)}) == [("beta", 5), (None, 3)] and found(None, {"n": (None, 3)}, {"name": ["Alpha", "beta"]}) == [("Alpha", 1)]


def spans(random, n, longest, null=True):
    rows = []
    for i in range(n):
        s = int(random.integers(-500, 500))
        rows.append((None if null and i % 4 == 0 else int(i % 3), s, s + int(random.integers(0, longest if i % 9 else 30 * longest)), i))
    return rows


def test_merged_intervals_by_brute_force(spark):
    rows = spans(np.random.default_rng(3), 150, 12)
    bad = [(1, None, 5, 0), (1, 0, None, 0), (None, None, None, 0), (1, 9, 3, 0)]
    df = spark.createDataFrame(rows + bad, "k int, s long, e long, i int")
    want = []
    for k in {r[0] for r in rows}:
        mine = []
        for _, s, e, _ in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            if mine and s <= mine[-1][2]:
                mine[-1] = k, mine[-1][1], max(mine[-1][2], e), mine[-1][3] + 1
            else:
                mine.append((k, s, e, 1))
        want += mine
    for bucket in (7, 100, 10**6):
        assert sorted(map(tuple, intervals.merge_intervals(df, ["k"], "s", "e", bucket).collect()), key=repr) == sorted(want, key=repr)
    assert intervals.merge_intervals(df.limit(0), ["k"], "s", "e", 5).count() == 0


@pytest.mark.parametrize("closed", [True, False])
def test_overlaps_of_short_and_very_long_intervals(spark, closed):
    random = np.random.default_rng(6)
    a, b = spans(random, 60, 10), [(k, s, e, i) for k, s, e, i in spans(random, 60, 40)] + [(1, -100_000, 100_000, 99), (0, None, 3, 98), (0, 5, 2, 97)]
    left, right = spark.createDataFrame(a + [(2, -10**6, 10**6, 77)], "k int, start_t long, end_t long, i int"), spark.createDataFrame(b, "k int, other_start long, other_end long, j int")
    got = sorted((r["i"], r["j"]) for r in intervals.overlap_join(left, right, ["k"], 5, closed).collect())
    meets = (lambda s, e, x, y: s <= y and x <= e) if closed else (lambda s, e, x, y: s < y and x < e)
    want = sorted((i, j) for k, s, e, i in a + [(2, -10**6, 10**6, 77)] for q, x, y, j in b if k is not None and k == q and x is not None and x <= y and meets(s, e, x, y))
    assert got == want


def test_rows_in_short_and_very_long_windows(spark):
    random = np.random.default_rng(2)
    rows = [(int(t), float(v), i) for i, (t, v) in enumerate(zip(random.integers(0, 3000, 200), random.integers(0, 30, 200)))] + [(None, 1.0, 900), (5, None, 901)]
    windows = [(int(s), int(s + random.integers(0, 30)), float(random.integers(0, 30)), 2.0) for s in random.integers(0, 3000, 12)]
    df = spark.createDataFrame(rows, "t long, v double, id long")
    for more in ([], [(100, 2500, 3.0, 0.5)], [(50, 10, 1.0, 9.0), (None, 10, 1.0, 9.0)]):
        w = spark.createDataFrame(windows + more, "start_t long, end_t long, center double, tolerance double")
        want = {i for t, v, i in rows if t is not None and v is not None and any(s is not None and s <= t <= e and abs(v - c) <= x for s, e, c, x in windows + more)}
        assert {r["id"] for r in joins.range_semi_join(df, w, "t", "v", 20).collect()} == want
    assert joins.range_semi_join(df, w.limit(0), "t", "v", 20).count() == 0


@pytest.mark.parametrize("cell", [2, 3, 64])
def test_anchor_bins_by_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(clusters, "CELL", cell)
    random = np.random.default_rng(cell)
    rows = [(None if k == 3 else k, float(np.round(x, 2))) for k in range(5) for x in (random.uniform(-50, 50, 40) if k % 2 else random.normal(0, 3, 60))]
    rows += [(1, None), (9, 7.0), *[(7, x) for x in (0.0, 0.1, 0.2, 0.3, 100.0, 100.1, 250.0)]]
    df = spark.createDataFrame(rows, "k int, v double")
    for tolerance in (0.0, 0.1, 0.3, 30.0):
        want = {}
        for k in {r[0] for r in rows}:
            anchor = None
            for v in sorted({v for q, v in rows if q == k and v is not None}):
                anchor = v if anchor is None or v - anchor > tolerance else anchor
                want[k, v] = anchor
        assert {(r["k"], r["v"]): r["anchor"] for r in clusters.anchor_bins(df, ["k"], "v", tolerance).collect()} == want
    assert clusters.anchor_bins(df.limit(0), ["k"], "v", 1.0).count() == 0


def test_one_key_of_many_values(spark):
    df = spark.range(64_000).select(F.lit("a").alias("k"), (F.rand(3) * 100).alias("v"), F.lit(None).cast("string").alias("none"))
    anchors = [r["anchor"] for r in clusters.anchor_bins(df, ["k"], "v", 2.5).select("anchor").distinct().orderBy("anchor").collect()]
    assert len(anchors) == 40 and all(b - a > 2.5 for a, b in itertools.pairwise(anchors))
    values = np.sort([r["v"] for r in df.collect()])
    assert aggregates.upper_median(df, ["none"], "v", 0.5).first()["upper_median"] == values[32_000]
    assert aggregates.median(df, ["k"], "v", 0.5).first()["median"] == (values[31_999] + values[32_000]) / 2


def test_results_do_not_depend_on_buckets(spark):
    random = np.random.default_rng(12)
    rows = [(None if i % 3 == 0 else i % 2, None if i % 50 == 7 else int(t), i, None if i % 11 == 0 else float(t % 13), int(t) // 40) for i, t in enumerate(random.permutation(2000)[:150])]
    df = spark.createDataFrame(rows, "k long, t long, id long, v double, part long")
    points = df.where("id % 2 = 0").groupBy("k", "t").agg(F.first("v").alias("v"))
    for f in (
        lambda b: joins.interpolate_at(points, df.where("id % 2 = 1").select("k", "t"), ["k"], "t", "v", b),
        lambda b: ranking.uniform_sample(df, ["k"], 7, "t", "id", b).select("id"),
        lambda b: ranking.stride_sample(df, ["k"], 7, "t", "id", b).select("id"),
        lambda b: aggregates.median(df, ["k"], "v", b / 100),
        lambda b: aggregates.upper_median(df, ["k"], "v", b / 100),
        lambda b: sessions.coalesce_parts(df, ["k"], "t", "part", 15, b),
    ):
        few, many = (sorted(map(tuple, f(b).collect()), key=repr) for b in (10**7, 19))
        assert few == many and len({r[0] for r in few}) >= 1
    got = {(r["k"], r["t"]): r["v"] for r in joins.interpolate_at(points, df.where("id % 2 = 1").select("k", "t"), ["k"], "t", "v", 19).collect()}
    for k in {r[0] for r in rows}:
        p = sorted((r[1], r[3]) for r in rows if r[0] == k and r[2] % 2 == 0 and r[1] is not None and r[3] is not None)
        for q, t in got:
            if q == k:
                assert got[q, t] is None if t is None or not p else got[q, t] == pytest.approx(np.interp(t, *zip(*p)))
    places = sorted(r[2] for r in sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))[:: -(-sum(r[0] == 1 for r in rows) // 7)])
    assert sorted(r["id"] for r in ranking.stride_sample(df, ["k"], 7, "t", "id", 19).where("k = 1").collect()) == places


@pytest.mark.parametrize("most", [1_000_000, 25, 0])
def test_greedy_in_rounds_equals_greedy_in_a_frame(spark, most, monkeypatch):
    monkeypatch.setattr(tracks, "FRAME_PAIRS", most)
    random = np.random.default_rng(9)
    data = [(None if f == 2 else f, int(a), int(b), float(c)) for f in range(3) for a, b, c in zip(random.integers(0, 12, 30 * f + 5), random.integers(20, 32, 30 * f + 5), random.integers(0, 15, 30 * f + 5))]
    df = spark.createDataFrame(data + [(0, None, 1, 0.0), (0, 1, None, 0.0), (0, 1, 2, None)], "frame int, left_id long, right_id long, cost double")
    want = set()
    for f in {d[0] for d in data}:
        left, right = set(), set()
        for c, a, b in sorted((d[3], d[1], d[2]) for d in data if d[0] == f):
            if c <= 11 and a not in left and b not in right:
                left.add(a)
                right.add(b)
                want.add((f, a, b, c))
    assert {tuple(r) for r in tracks.greedy_assignment(df, ["frame"], 11.0).collect()} == want


def test_components_by_brute_force(spark):
    random = np.random.default_rng(2)
    for n, m in ((50, 30), (300, 280)):
        edges, parent = [(int(a), int(b)) for a, b in random.integers(0, n, (m, 2))], {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
        assert dict(connected_components(spark.createDataFrame(edges, "left long, right long")).collect()) == {x: find(x) for x in parent}


NULLS = [(None, 1, 0, 5.0, 2.0), (None, 4, 1, 6.0, 1.0), (None, 4, 1, 6.0, 1.0), (1, None, 2, 7.0, 3.0), (1, 3, 3, None, 4.0), (1, 9, 4, 8.0, None), (1, 3, 5, 5.5, 0.5), (2, None, 6, None, None)]


@pytest.mark.parametrize(
    ("name", "f", "want"),
    [
        ("gap_clusters", lambda d: clusters.gap_clusters(d, ["k"], "v", 0.7).groupBy("k", "cluster").count(), [(1, 0, 1), (1, 1, 1), (1, 2, 1), (None, 0, 1), (None, 1, 2)]),
        ("anchor_bins", lambda d: clusters.anchor_bins(d, ["k"], "v", 1.0).groupBy("k", "anchor").count(), [(1, 5.5, 1), (1, 7.0, 2), (None, 5.0, 3)]),
        ("band_count", lambda d: clusters.band_count(d, ["k"], "v", 1.0), [(1, 2), (None, 1)]),
        ("two_means", lambda d: clusters.two_means(d, ["k"], "v").select("k", "low_mean", "high_mean"), [(1, 5.5, 7.5), (None, 5.0, 6.0)]),
        ("median", lambda d: aggregates.median(d, ["k"], "v", 2.0), [(1, 7.0), (None, 6.0)]),
        ("upper_median", lambda d: aggregates.upper_median(d, ["k"], "v", 2.0), [(1, 7.0), (None, 6.0)]),
        ("mode", lambda d: aggregates.mode_largest(d, ["k"], "v"), [(1, 8.0, 1), (None, 6.0, 2)]),
        ("histogram", lambda d: aggregates.histogram(d, ["k"], "t", 1).groupBy("k").agg(F.sum("n")), [(1, 3), (None, 3)]),
        ("retained", lambda d: aggregates.retained(d, ["k"], "id", "k").select("k"), [(1,), (2,)] + [(None,)]),
        ("mahalanobis", lambda d: aggregates.mahalanobis(d, ["k"], "v", "w").groupBy("k").agg(F.count("*")), [(1, 4), (2, 1), (None, 3)]),
        ("sliding", lambda d: sessions.sliding_windows(d, ["k"], "t", 3, 3).groupBy("k").agg(F.count("*")), [(1, 4), (None, 5)]),
        ("full_span", lambda d: sessions.full_span(d, ["k"], "t"), [(1, 3, 9, 4), (2, None, None, 1), (None, 1, 4, 3)]),
        ("sessionise", lambda d: sessions.sessionise(d, "k", "t", "id", 4, 50).groupBy("k", "session").count(), [(1, 0, 3), (1, 1, 1), (2, 0, 1), (None, 0, 3)]),
        ("lag", lambda d: sessions.lag_difference(d, ["k"], "t", "id", 50).groupBy("k").agg(F.sum("gap")), [(1, 6), (2, None), (None, 3)]),
        ("top_k", lambda d: ranking.top_k(d, ["k"], 1, F.desc("w"), F.col("id")).select("k", "id"), [(1, 3), (2, 6), (None, 0)]),
        ("suppressed", lambda d: ranking.top_k_suppressed(d.withColumn("e", F.col("t") + 1), ["k"], "w", "id", "t", "e", 2, 0.5).select("k", "id", "rank"), [(1, 3, 1), (1, 2, 2), (2, 6, 1), (None, 0, 1), (None, 1, 2)]),
        ("stride", lambda d: ranking.stride_sample(d, ["k"], 1, "t", "id", 50).select("k", "id"), [(1, 2), (2, 6), (None, 0)]),
        ("first_of_key", lambda d: ranking.first_of_key(d, [F.col("k"), F.col("t")], ["id"]).groupBy("k").count(), [(1, 3), (2, 1), (None, 2)]),
        ("associate", lambda d: tracks.associate(d, ["k"], "t", "v", "id", 1.5, 5).groupBy("k", "track").count(), [(1, 0, 1), (1, 1, 1), (1, None, 2), (2, None, 1), (None, 0, 2), (None, 1, 1)]),
        ("merge", lambda d: intervals.merge_intervals(d.withColumn("e", F.col("t") + 2), ["k"], "t", "e", 5), [(1, 3, 5, 2), (1, 9, 11, 1), (None, 1, 3, 1), (None, 4, 6, 2)]),
        ("dbscan", lambda d: density.dbscan(d, ["k"], "t", "v", "id", (1.0, 1.0), 1.0, 2).groupBy("k", "cluster").count(), None),
        ("ransac", lambda d: lines.ransac_line(d, ["k"], "t", "v", "id", 1.0).select("k"), [(1,), (2,), (None,)]),
        ("spline", lambda d: smoothing.spline_at(d, ["k"], "t", "v", 1.0).groupBy("k").count(), None),
        ("smooth", lambda d: smoothing.smooth_constant_velocity(d, ["k"], "t", "v", "id", 1.0, 0.1).groupBy("k").count(), None),
        ("jaccard", lambda d: d.groupBy("k").agg(F.collect_set("t").alias("a")).select("k", aggregates.jaccard(F.col("a"), F.col("a"))), [(1, 1.0), (2, 0.0), (None, 1.0)]),
        ("chains", lambda d: tracks.chain_links(d.where("k = 1 or id = 0").select("k", "id", F.col("t").alias("start_t"), (F.col("t") + 1).alias("end_t"), F.col("v").alias("first_value"), F.col("v").alias("last_value")), ["k"], 9, 5.0).select("id", "chain"), [(0, 0), (2, 1), (3, 2), (4, 0), (5, 0)]),
    ],
)
def test_null_keys_and_values_and_empty_tables(spark, name, f, want):
    df = spark.createDataFrame(NULLS, "k int, t long, id long, v double, w double")
    got = sorted((tuple(r) for r in f(df).collect()), key=repr)
    if want is not None:
        assert got == sorted(want, key=repr)
    assert f(df.limit(0)).count() == 0


def _reference_chains(rows, most_gap, most_step):
    """Chains of one key by plain scans."""
    left, chain, number = sorted(rows, key=lambda r: (r[1], r[0])), {}, 0

    def follow(here, forward):
        best = None
        for r in left:
            a, b = (here, r) if forward else (r, here)
            gap, step = b[1] - a[2], abs(b[3] - a[4])
            if r[0] not in chain and 0 <= gap <= most_gap and step <= most_step:
                best = min(best or (math.inf,), (gap / most_gap + step / most_step, r[0], r))
        return best and best[2]

    for seed in left:
        if seed[0] in chain:
            continue
        chain[seed[0]] = number
        for forward in (True, False):
            here = seed
            while here := follow(here, forward):
                chain[here[0]] = number
        number += 1
    return chain


def test_chains_and_tracks_in_stretches_equal_whole_keys(spark):
    random = np.random.default_rng(11)
    rows = []
    for i in range(120):
        start = int(random.integers(0, 900))
        rows.append((i, start, start + int(random.integers(-2, 9)), float(random.integers(0, 12)), float(random.integers(0, 12))))
    keys = [None, "a"]
    df = spark.createDataFrame([(k, *r) for k in keys for r in rows] + [("a", 500, None, 3, 1.0, 1.0), ("a", 501, 3, 4, None, 1.0), ("b", 7, None, 1, 1.0, 1.0)], "k string, id long, start_t long, end_t long, first_value double, last_value double")
    want = _reference_chains(rows, 10, 6.0)
    assert len(set(want.values())) < 100
    got = {(r["k"], r["id"]): r["chain"] for r in tracks.chain_links(df, ["k"], 10, 6.0).collect()}
    last = max(want.values())
    assert got == {(k, i): c for k in keys for i, c in want.items()} | {("a", 500): last + 1, ("a", 501): last + 2, ("b", 7): 0}

    seen = [(int(f), float(v), i) for i, (f, v) in enumerate(zip(random.integers(0, 300, 200), random.integers(0, 15, 200)))]
    live, count, labels = {}, 0, {}
    for f in sorted({s[0] for s in seen}):
        here = sorted((v, i) for g, v, i in seen if g == f)
        found, live, count = tracks.associate_frame(live, count, f, [v for v, _ in here], 2.0, 1)
        labels |= {i: n for (_, i), n in zip(here, found)}
    df = spark.createDataFrame([(k, *s) for k in keys for s in seen], "k string, f long, v double, id long")
    got = {(r["k"], r["id"]): r["track"] for r in tracks.associate(df, ["k"], "f", "v", "id", 2.0, 1).collect()}
    assert got == {(k, i): n for k in keys for i, n in labels.items()}


def test_least_cost_of_large_frames_by_connected_groups(spark, monkeypatch):
    random = np.random.default_rng(12)
    data = [(k, int(a), int(b), float(c)) for k in (None, 1) for a, b, c in zip(random.integers(0, 40, 90), random.integers(0, 40, 90), random.random(90))]
    df = spark.createDataFrame([*data, (2, 1, 1, 0.9), (2, 1, 2, 0.2)], "frame int, left_id long, right_id long, cost double")
    whole = {tuple(r) for r in tracks.least_cost_assignment(df, ["frame"], 0.7).collect()}
    monkeypatch.setattr(tracks, "FRAME_PAIRS", 5)
    assert {tuple(r) for r in tracks.least_cost_assignment(df, ["frame"], 0.7).collect()} == whole
    assert (2, 1, 2, 0.2) in whole and len(whole) > 20


def test_repeats_are_forgotten_behind_the_watermark(spark, tmp_path):
    hour = 3_600_000_000
    batches = [[(0, "a"), (1, "a"), (2, None)], [(9, "a"), (9, None), (60, "b")], [(61, "b")], [(90, "a"), (90, None), (5, "c")]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(t * hour, k) for t, k in rows], "t long, k string").coalesce(1)
        df.select(F.timestamp_micros("t").alias("ts"), "k").write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*"):
            os.utime(f, (1000 + i, 1000 + i)) if f.stat().st_mtime > 1e6 else None
    stream = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    once = streams.without_repeats(stream, "ts", ["k"], "24 hours").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    once.awaitTermination()
    got = sorted(r["k"] or "" for r in spark.table("once").collect())
    # Keys a and null are forgotten once 60 is seen and count again at 90; b is still known at 61; c is older
    # than the watermark.
    assert got == ["", "", "a", "a", "b"]
    assert sum(op["numRowsRemoved"] for p in once.recentProgress for op in p["stateOperators"]) >= 2
