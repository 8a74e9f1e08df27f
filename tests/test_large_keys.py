"""Operators over a key that no task holds, against the same rows in one task; rows that were wrong."""

import itertools
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, clusters, density, joins, line_assignment, lines, ranges, sessions, smoothing, tracks
from tidemark.plans import queries, staging
from tidemark.sources import files
from tidemark.streaming import streams


@pytest.fixture
def tiny(monkeypatch):
    """Ranges of a few rows."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", 7)
    monkeypatch.setattr(ranges, "HOT_SHARE", 0.3)


def left_over(spark, make) -> int:
    """How many tables are left in the shared folder after a scoped block in which ``make`` is collected."""
    folder = f"{staging.shared_folder(spark).removeprefix('file:')}/tidemark"
    have = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with staging.scoped(spark):
        make().collect()
    return len(set(os.listdir(folder)) - have) if os.path.isdir(folder) else 0


def blobs(random, n=240):
    """Blobs, a dense disc, a line of single points, noise near and far, places that many rows share."""
    rows = [(float(a), float(b)) for c in (0, 3, 9) for a, b in random.normal(c, 0.4, (n // 6, 2))]
    rows += [(float(a), float(b)) for a, b in random.normal(20, 0.05, (n // 3, 2))] + [(20.9, 20.0 + 0.001 * i) for i in range(n // 4)]
    rows += [(30 + 0.45 * i, 5.0) for i in range(12)] + [(float(a), float(b)) for a, b in random.uniform(-60, 60, (20, 2))]
    return rows + [(50.0, 50.0)] * 25 + [(50.0, 50.4), (-40.0, 3.0), (-40.0, 3.0)]


@pytest.mark.parametrize("least, few, radius", [(4, 64, 0.5), (30, 1, 0.8)])
def test_dbscan_over_a_grid_equals_one_task(spark, tiny, monkeypatch, least, few, radius):
    random = np.random.default_rng(least)
    rows = [(k, i, a, b) for k in (None, "b") for i, (a, b) in enumerate(blobs(random))]
    rows += [("c", 1, 0.0, 0.0), ("b", 900, None, 1.0), ("b", 901, 1.0, float("nan")), ("d", 1, None, None)]
    df = spark.createDataFrame(rows, "k string, id long, x double, y double").repartition(6)
    whole = {(r["k"], r["id"]): r["cluster"] for r in density.dbscan(df, ["k"], "x", "y", "id", (1.0, 2.0), radius, least).collect()}
    monkeypatch.setattr(density, "GROUP_ROWS", 50)
    monkeypatch.setattr(density, "SLICE", 9)
    monkeypatch.setattr(density, "FEW", few)
    got = {(r["k"], r["id"]): r["cluster"] for r in density.dbscan(df, ["k"], "x", "y", "id", (1.0, 2.0), radius, least).collect()}
    assert got == whole and len(got) == len(rows) and whole["b", 900] == whole["b", 901] == whole["d", 1] == -1
    assert len(set(whole.values())) >= 2


def test_dbscan_leaves_no_table(spark, monkeypatch):
    monkeypatch.setattr(density, "GROUP_ROWS", 50)
    df = spark.createDataFrame([("a", i, a, b) for i, (a, b) in enumerate(blobs(np.random.default_rng(1)))], "k string, id long, x double, y double")
    assert left_over(spark, lambda: density.dbscan(df, ["k"], "x", "y", "id", (1.0, 1.0), 0.5, 4)) == 0
    with pytest.raises(ValueError, match="radius"):
        density.dbscan(df, ["k"], "x", "y", "id", (1.0, 1.0), 0.0, 4)


def series(random, n=60):
    """Repeated times, null values at the beginning and inside, a null key, a key of one row, no value at all."""
    rows = []
    for k in (None, "a", "b"):
        for i, t in enumerate(np.sort(random.integers(0, 80, n))):
            rows.append((k, float(t), None if i < 9 and k == "a" or i % 7 == 3 else float(random.normal(t / 5, 1)), i))
    return rows + [("one", 1.0, 2.0, 0), ("none", 1.0, None, 0), ("none", 2.0, None, 1), ("a", None, 4.0, 99), ("b", float("nan"), 1.0, 98)]


def test_filter_in_ranges_equals_one_range(spark, monkeypatch):
    rows = series(np.random.default_rng(4))
    df = spark.createDataFrame(rows, "k string, t double, v double, id long").repartition(5)
    found = []
    for size in (10**6, 17, 3):
        monkeypatch.setattr(ranges, "RANGE_ROWS", size)
        got = smoothing.smooth_constant_velocity(df, ["k"], "t", "v", "id", 4.0, 0.3).toPandas().sort_values(["k", "t", "id"], na_position="first", ignore_index=True)
        assert len(got) == len(rows)
        found.append(got)
    assert found[0]["smooth"].notna().sum() == len(rows) - 9 - 2 - 2
    for other in found[1:]:
        pd.testing.assert_frame_equal(found[0], other, rtol=1e-8, atol=1e-8)
    assert left_over(spark, lambda: smoothing.smooth_constant_velocity(df, ["k"], "t", "v", "id", 4.0, 0.3)) == 0


def test_filter_elements_are_associative():
    random = np.random.default_rng(1)
    steps = smoothing._begun(3.0, 2.0).then(smoothing._steps(random.random(1), random.random(1), 2.0, 0.1))
    rest = smoothing._steps(np.append(random.random(20), 0.0), np.where(random.random(21) < 0.3, np.nan, random.normal(size=21)), 2.0, 0.1)
    one = steps.then(rest.together())
    for at in range(len(rest)):
        steps = steps.then(rest[at : at + 1])
    for a, b in zip(one.parts(), steps.parts(), strict=True):
        assert np.allclose(a, b, atol=1e-10)


def test_spline_in_ranges_equals_one_range(spark, monkeypatch):
    random = np.random.default_rng(3)
    rows = [(k, float(x), float(y)) for k, n in ((None, 50), ("a", 15), ("b", 2), ("c", 1), ("d", 3)) for x, y in zip(np.sort(random.uniform(0, 40, n)).round(1), random.normal(0, 3, n))]
    rows += [("a", None, 1.0), ("e", 1.0, None), ("a", 3.0, float("nan")), ("c", rows[-4][1], 2.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(4)
    found = []
    for size in (10**6, 9, 3, 1):
        monkeypatch.setattr(ranges, "RANGE_ROWS", size)
        found.append(smoothing.spline_at(df, ["k"], "x", "y", 0.25).toPandas().sort_values(["k", "x"], na_position="first", ignore_index=True))
    for other in found[1:]:
        pd.testing.assert_frame_equal(found[0], other, rtol=1e-9, atol=1e-9)
    one = found[0][found[0]["k"] == "a"].set_index("x")["y"]
    mean = pd.DataFrame([r for r in rows if r[0] == "a" and r[1] is not None and r[2] == r[2]]).groupby(1)[2].mean()
    assert one.index[0] == mean.index[0] and one.iloc[0] == pytest.approx(mean.iloc[0])
    assert left_over(spark, lambda: smoothing.spline_at(df, ["k"], "x", "y", 0.25)) == 0


def test_line_of_usable_rows_only(spark, tiny):
    rows = [("a", i, float(i), 2.0 * i + 1) for i in range(30)] + [("a", 10 + i, None if i % 2 else 5.0, None if i % 3 else float("nan")) for i in range(397)]
    rows += [("b", 1, 2.0, 3.0), ("b", 2, 2.0, 4.0), (None, 1, 1.0, 1.0), (None, 2, 2.0, 3.0), ("none", 1, None, 1.0)]
    df = spark.createDataFrame([(k, i, x, None if x is None else y) for k, i, x, y in rows], "k string, id long, x double, y double")
    got = {r["k"]: r for r in lines.ransac_line(df, ["k"], "x", "y", "id", 0.5).collect()}
    assert got["a"]["slope"] == pytest.approx(2) and got["a"]["intercept"] == pytest.approx(1) and got["a"]["inliers"] == 30
    assert got[None]["slope"] == pytest.approx(2) and got["b"]["slope"] is None and got["b"]["inliers"] == 0 and got["none"]["inliers"] == 0
    assert left_over(spark, lambda: lines.ransac_line(df, ["k"], "x", "y", "id", 0.5)) == 0


def test_line_by_brute_force(spark, monkeypatch):
    random = np.random.default_rng(9)
    rows = [(k, i, float(x), float(3 * x - 2 + random.normal(0, 0.3) if i % 3 else random.uniform(-50, 50))) for k in (1, 2) for i, x in enumerate(random.integers(0, 30, 80))]
    df = spark.createDataFrame(rows, "k int, id long, x double, y double").repartition(7)
    for size in (10**6, 9):
        monkeypatch.setattr(ranges, "RANGE_ROWS", size)
        got = {r["k"]: r for r in lines.ransac_line(df, ["k"], "x", "y", "id", 1.0, draws=50, seed=3).collect()}
        for k in (1, 2):
            mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1], r[3]))
            best = []
            for d in range(50):
                a, b = (mine[int(len(mine) * lines.drawn(3, d, side))] for side in (0, 1))
                if a[2] != b[2]:
                    inside = [r for r in mine if abs(r[3] - a[3] - (b[3] - a[3]) / (b[2] - a[2]) * (r[2] - a[2])) <= 1]
                    best = inside if len(inside) > len(best) else best
            slope, intercept = np.polyfit([r[2] for r in best], [r[3] for r in best], 1)
            assert got[k]["inliers"] == len(best) and got[k]["slope"] == pytest.approx(slope) and got[k]["intercept"] == pytest.approx(intercept)


def test_places_within_keys(spark, tiny):
    rows = [(None if i % 5 == 0 else i % 3, (i * 37) % 101, i) for i in range(100)]
    got = {r["id"]: r["place"] for r in ranges.in_places(spark.createDataFrame(rows, "k int, v long, id long"), ["k"], ["v", "id"], []).collect()}
    for k in {r[0] for r in rows}:
        assert [got[i] for _, _, i in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:])] == list(range(sum(r[0] == k for r in rows)))


def test_ragged_rows_stay_away_under_any_reader(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n1,2\n3\nx,4\n7,8\n5,6,7\n9,\n")
    df = files.drop_ragged(spark, str(tmp_path), "a int, b int")
    assert sorted(map(tuple, df.collect()), key=repr) == [(1, 2), (7, 8), (9, None)]
    assert df.count() == 3 and sorted(r["a"] for r in df.select("a").collect()) == [1, 7, 9]
    assert df.agg(F.sum("a")).first()[0] == 17 and df.where("b > 2").select("b").collect() == [(8,)]


def test_range_filter_reaches_the_reader(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as double) as v").write.parquet(str(tmp_path / "p"))
    df = files.scan_range(spark.read.parquet(str(tmp_path / "p")), {"id": (3, 9), "v": (4.5, 8.0)})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), IsNotNull(v), GreaterThanOrEqual(id,3)" in plan
    assert sorted(r["id"] for r in df.collect()) == [5, 6, 7, 8]


def test_nearest_of_repeated_and_unknown_rows(spark):
    left = spark.createDataFrame([("a", 5, 1, "x")] * 3 + [(None, 5, 2, "y"), ("a", None, 3, "z"), ("b", 5, 4, "w")], "k string, t long, id long, more string")
    right = spark.createDataFrame([("a", 6, 10), ("a", 9, 11), (None, 5, 12), ("a", None, 13), ("b", 50, 14)], "k string, t long, id long")
    got = joins.nearest_in_time(left, right, ["k"], "t", "id", 3)
    assert got.columns == ["k", "t", "id", "more", "near_t", "near_tie"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 5, 1, "x", 6, 10)] * 3 + [(None, 5, 2, "y", None, None), ("a", None, 3, "z", None, None), ("b", 5, 4, "w", None, None)], key=repr)


def test_nan_is_behind_all_numbers(spark):
    df = spark.createDataFrame([("k", v, i) for i, v in enumerate([float("nan"), 1.0, 2.0, None, float("nan")])], "k string, v double, id long")
    assert aggregates.median(df.where("id < 3"), ["k"], "v", 5.0).first()["median"] == 2.0
    bins = {r["id"]: r["anchor"] for r in clusters.anchor_bins(df, ["k"], "v", 5.0).collect()}
    assert bins[1] == bins[2] == 1.0 and np.isnan(bins[0]) and np.isnan(bins[4]) and len(bins) == 4
    assert clusters.band_count(df, ["k"], "v", 5.0).first()["bands"] == 2
    assert [r["id"] for r in sessions.sessionise(df, "k", "v", "id", 10, 3).where("session = 1").orderBy("id").collect()] == [0]
    assert left_over(spark, lambda: clusters.two_means(df.where("id in (1, 2)"), ["k"], "v")) == 0


def test_scopes_are_a_threads_own(spark):
    from threading import Thread

    with staging.scoped(spark):
        kept = staging.staged(spark.range(3), "outer")

        def other():
            with staging.scoped(spark):
                staging.staged(spark.range(2), "inner").count()

        thread = Thread(target=other)
        thread.start()
        thread.join()
        assert kept.count() == 3


@pytest.mark.parametrize("missed", [0, 2])
def test_association_in_parts_equals_the_whole_key(spark, monkeypatch, missed):
    random = np.random.default_rng(missed)
    rows = [(k, int(f), float(random.integers(0, 25)) / 2, i) for k in (None, "a") for i, f in enumerate(np.sort(random.integers(0, 90, 260)))]
    rows += [("a", 5000 + f, 1.0, 900 + f) for f in range(3)] + [("b", None, 1.0, 1), ("a", 3, None, 990), ("a", 3, float("nan"), 991)]
    df = spark.createDataFrame(rows, "k string, f long, v double, id long").repartition(5)
    whole = {(r["k"], r["id"]): r["track"] for r in tracks.associate(df, ["k"], "f", "v", "id", 1.5, missed).collect()}
    monkeypatch.setattr(ranges, "RANGE_ROWS", 23)
    got = {(r["k"], r["id"]): r["track"] for r in tracks.associate(df, ["k"], "f", "v", "id", 1.5, missed).collect()}
    assert got == whole and whole["b", 1] is whole["a", 990] is whole["a", 991] is None
    for k in (None, "a"):
        live, count, mine = {}, 0, sorted((f, v, i) for q, f, v, i in rows if q == k and v == v and v is not None)
        for f, here in itertools.groupby(mine, key=lambda r: r[0]):
            here = list(here)
            found, live, count = tracks.associate_frame(live, count, f, [v for _, v, _ in here], 1.5, missed)
            assert [whole[k, i] for *_, i in here] == found
    assert left_over(spark, lambda: tracks.associate(df, ["k"], "f", "v", "id", 1.5, missed)) == 0


@pytest.mark.parametrize(("gap", "step", "reach", "most"), [(10, 3.0, 500, 9), (4, 12.0, 150, 60), (0, 5.0, 20, 3)])
def test_chains_in_parts_equal_the_whole_key(spark, monkeypatch, gap, step, reach, most):
    random = np.random.default_rng(gap)
    rows = []
    for k in (None, "a"):
        for i in range(130):
            start = int(random.integers(0, reach))
            long = 0 if random.random() < 0.3 else int(random.integers(0, most))
            rows.append((k, i // 2, start, start + long, *(float(v) for v in random.integers(0, 9, 2))))
    rows += [("a", 900, 5, 300, 1.0, 2.0), ("a", 900, 5, 300, 1.0, 2.0), ("b", 1, None, 3, 1.0, 1.0), ("b", 2, 1, 1, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "k string, id long, start_t long, end_t long, first_value double, last_value double").repartition(5)
    found = lambda: sorted((repr(r) for r in tracks.chain_links(df, ["k"], gap, step).collect()))
    whole = found()
    monkeypatch.setattr(ranges, "RANGE_ROWS", 25)
    with staging.scoped(spark):
        folder = f"{staging.shared_folder(spark).removeprefix('file:')}/tidemark"
        have = set(os.listdir(folder))
        assert found() == whole
    assert not set(os.listdir(folder)) - have


def test_chains_of_segments_that_share_an_id(spark):
    rows = [("a", 1, 0, 10, 5.0, 5.0), ("a", 1, 12, 20, 5.0, 5.0), ("a", 2, 13, 20, 5.0, 5.0), ("a", 1, 100, 101, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, id long, start_t long, end_t long, first_value double, last_value double")
    got = sorted((r["start_t"], r["chain"]) for r in tracks.chain_links(df, ["k"], 10, 2.0).collect())
    assert got == [(0, 0), (12, 0), (13, 1), (100, 2)]
    assert left_over(spark, lambda: tracks.chain_links(df, ["k"], 10, 2.0)) == 0


def test_greedy_over_a_rising_chain_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(tracks, "FRAME_PAIRS", 20)
    rows = [(1, i // 2 + i % 2, i // 2, float(i)) for i in range(60)] + [(2, 1, 1, 0.5), (1, 1, 1, float("nan"))]
    df = spark.createDataFrame(rows, "frame int, left_id long, right_id long, cost double")
    got = {tuple(r)[:3] for r in tracks.greedy_assignment(df, ["frame"], 1e9).collect()}
    assert got == {(1, i, i) for i in range(30)} | {(2, 1, 1)}
    assert left_over(spark, lambda: tracks.greedy_assignment(df, ["frame"], 1e9)) == 0
    assert left_over(spark, lambda: tracks.least_cost_assignment(df, ["frame"], 1e9)) == 0


def test_least_cost_by_all_assignments_of_sparse_links():
    random = np.random.default_rng(5)
    for _ in range(300):
        n, m = (int(x) for x in random.integers(1, 6, 2))
        links = [[(r, float(np.round(random.uniform(-2, 3), 1))) for r in range(m) if random.random() < 0.6] for _ in range(n)]
        given = tracks._matched(links, m, 1.0)
        taken = [r for r in given if r >= 0]
        assert len(taken) == len(set(taken))
        total = sum(1.0 if r < 0 else dict(own)[r] for r, own in zip(given, links, strict=True))
        options = (sum(1.0 if r is None else dict(own)[r] for r, own in zip(c, links, strict=True)) for c in itertools.product(*[[None, *[r for r, _ in own]] for own in links]) if len([r for r in c if r is not None]) == len({r for r in c if r is not None}))
        assert math.isclose(total, min(options), abs_tol=1e-9)


def test_least_cost_of_a_large_group_in_little_memory():
    import tracemalloc

    random = np.random.default_rng(6)
    n = 20_000
    links = [sorted({int(r) % n: float(c) for r, c in zip(i + random.integers(-6, 7, 8), random.random(8))}.items()) for i in range(n)]
    tracemalloc.start()
    given = tracks._matched(links, n, 5.0)
    assert tracemalloc.get_traced_memory()[1] < 50_000_000 and sum(r >= 0 for r in given) > 0.9 * n
    tracemalloc.stop()


@pytest.mark.parametrize("rows", [7, 40, 10**6])
def test_assignment_on_a_line_lists_no_pairs(spark, monkeypatch, rows):
    rng = np.random.default_rng(5)
    side = lambda n: pd.DataFrame({"key": rng.choice([0.0, np.nan], n), "id": rng.permutation(n), "v": np.where(rng.random(n) < 0.05, np.nan, rng.choice([np.round(rng.random(n) * 4, 2), rng.random(n) * 30], 1)[0])})
    a, b = side(140), side(110)
    pairs = a.rename(columns={"id": "left_id"}).merge(b.rename(columns={"id": "right_id"}), on="key")
    pairs["cost"] = (pairs.v_x - pairs.v_y).abs()
    frames = [spark.createDataFrame(f.astype(object).where(f.notna(), None), "key double, id long, v double") for f in (a, b)]
    listed = spark.createDataFrame(pairs[pairs.cost <= 2][["key", "left_id", "right_id", "cost"]].astype(object).where(lambda f: f.notna(), None), "key double, left_id long, right_id long, cost double")
    exact, least = tracks.greedy_assignment(listed, ["key"], 2.0).collect(), tracks.least_cost_assignment(listed, ["key"], 2.0).collect()
    monkeypatch.setattr(ranges, "RANGE_ROWS", rows)
    assert sorted(map(tuple, line_assignment.greedy_on_line(*frames, ["key"], "id", "v", 2.0).collect()), key=repr) == sorted(map(tuple, exact), key=repr)
    found = line_assignment.least_cost_on_line(*frames, ["key"], "id", "v", 2.0).collect()
    total = lambda rows: sum(r.cost - 2.0 for r in rows)
    assert total(found) == pytest.approx(total(least), abs=1e-9)
    assert {(r.key, r.left_id, r.right_id, r.cost) for r in found} <= set(map(tuple, listed.collect()))
    assert all(len({(r.key, r[side]) for r in found}) == len(found) for side in ("left_id", "right_id"))


def test_queries_of_frames_list_no_pairs(spark, tmp_path):
    n = 20_000  # two frames of one value a side: 100,000,000 pairs
    both = spark.range(4 * n).selectExpr("id AS event_id", f"timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, int(id div {2 * n})) AS ts", "1L AS user_id", "if(id % 2 = 0, 'purchase', 'click') AS event_type", "double(id % 2) AS value")
    both.write.parquet(f"{tmp_path}/events.parquet")
    for name in ("greedy_assignment", "least_cost_assignment"):
        query = queries.QUERIES[name](spark, str(tmp_path))
        assert tuple(query.selectExpr("count(*)", "count(DISTINCT left_id)", "count(DISTINCT right_id)", "max(cost)").first()) == (2 * n, 2 * n, 2 * n, 1.0)


def test_association_lists_no_pairs_of_large_frames(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(300):
        live = {k: (int(rng.integers(3, 6)), float(np.round(rng.random() * 4, 1))) for k in range(rng.integers(0, 15))}
        values = sorted(np.round(rng.random(rng.integers(1, 15)) * 4, 1).tolist())
        want = tracks.associate_frame(live, len(live), 6, values, 0.5, 1)
        monkeypatch.setattr(tracks, "LISTED_PAIRS", -1)
        assert tracks.associate_frame(live, len(live), 6, values, 0.5, 1) == want
        monkeypatch.undo()
    n = 30_000  # 900,000,000 pairs are near enough
    labels, live, count = tracks.associate_frame({k: (0, 1.0) for k in range(n)}, n, 1, [1.5] * n, 1.0, 1)
    assert labels == list(range(n)) and count == n and live[5] == (1, 1.5)


@pytest.mark.parametrize("rows", [30, 10**6])
def test_lines_of_many_keys_need_no_row_a_draw(spark, monkeypatch, rows):
    random = np.random.default_rng(7)
    data = [(None if k == 3 else k, float(x), float(2 * x + k + random.normal()) if random.random() < 0.7 else float(random.random() * 90), i) for k in range(6) for i, x in enumerate(random.integers(0, 20 * (k + 1), 12 * (k + 1)))]
    df = spark.createDataFrame([*data, (1, None, 2.0, 99), (8, 1.0, 1.0, 0)], "k long, x double, y double, id long")
    want = {(r.k, round(r.slope, 9), round(r.intercept, 9), r.inliers) if r.slope is not None else (r.k, None, None, r.inliers) for r in _by_drawn_rows(df)}
    monkeypatch.setattr(ranges, "RANGE_ROWS", rows)
    made = []
    monkeypatch.setattr(lines, "_inside_large", lambda *a, f=lines._inside_large: made.append(1) or f(*a))
    got = lines.ransac_line(df, ["k"], "x", "y", "id", 2.0, draws=60).collect()
    assert {(r.k, round(r.slope, 9), round(r.intercept, 9), r.inliers) if r.slope is not None else (r.k, None, None, r.inliers) for r in got} == want
    assert len(made) == (rows == 30)


def _by_drawn_rows(df):
    """slope, intercept and inliers of each key, in Python."""
    from collections import defaultdict
    from types import SimpleNamespace

    groups = defaultdict(list)
    for r in df.collect():
        groups[r.k] += [(r.x, r.id, r.y)] if r.x is not None else []
    for k, held in groups.items():
        held, best = sorted(held), []
        for draw in range(60):
            (x, _, y), (z, _, w) = (held[int(len(held) * lines.drawn(0, draw, side))] for side in (0, 1))
            near = [(a, b) for a, _, b in held if x != z and abs(b - y - (w - y) / (z - x) * (a - x)) <= 2.0]
            best = near if len(near) > len(best) else best
        slope, intercept = np.polyfit(*zip(*best, strict=True), 1) if best else (None, None)
        yield SimpleNamespace(k=k, slope=slope, intercept=intercept, inliers=len(best))


def _plans(spark, make) -> list[str]:
    """The plans of what ``make`` stages."""
    from tidemark.operators import tracks as at

    seen, plain = [], at.staged
    at.staged = lambda df, *a: seen.append(df._jdf.queryExecution().toString()) or plain(df, *a)
    try:
        make()
    finally:
        at.staged = plain
    return seen


def test_chains_of_many_keys_share_a_batch(spark):
    random = np.random.default_rng(11)
    rows = [(None if k == 5 else k, i, int(t), int(t + random.integers(0, 9)), float(random.integers(0, 20)), float(random.integers(0, 20))) for k in range(40) for i, t in enumerate(random.integers(0, 300, 25))]
    df = spark.createDataFrame(rows, "k long, id long, start_t long, end_t long, first_value double, last_value double").coalesce(1)
    chains = lambda: sorted(map(tuple, tracks.chain_links(df, ["k"], 10, 6.0).select("k", "id", "chain").collect()), key=repr)
    one = chains()
    assert not [s for s in _plans(spark, lambda: tracks.chain_links(df, ["k"], 10, 6.0)) if "FlatMapGroupsInPandas" in s]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # stretches that go on over several batches
    try:
        assert chains() == one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = []
    for k in range(40):
        own = [(k, *r[1:]) for r in rows if r[0] == (None if k == 5 else k)]
        alone = spark.createDataFrame(own, df.schema) if k in (0, 5, 17) else None
        wanted += [(None if k == 5 else k, r.id, r.chain) for r in tracks.chain_links(alone, ["k"], 10, 6.0).collect()] if alone else []
    assert set(wanted) <= set(one) and len(wanted) == 75


def test_gate_sets_a_timer_once_a_state():
    from types import SimpleNamespace

    held, timers = [None], []
    gate = streams._Gate(5.0, 10, 1_000_000)
    value = SimpleNamespace(get=lambda: held[0], exists=lambda: held[0] is not None, update=lambda v: held.__setitem__(0, v), clear=lambda: held.__setitem__(0, None))
    gate.handle, gate.state = SimpleNamespace(registerTimer=timers.append, listTimers=lambda: iter(list(timers)), deleteTimer=timers.remove), value
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    for t in (0, 900_000, 1_800_000):
        list(gate.handleInputRows((1,), iter([pd.DataFrame({"t": [t], "value": [9.0]})]), at(0)))
    assert timers == [1001]
    list(gate.handleExpiredTimer((1,), at(1500), None))
    assert timers == [1001, 2801] and held[0][2] == 1_800_000
    list(gate.handleExpiredTimer((1,), at(2801), None))
    assert held == [None] and len(timers) == 2
