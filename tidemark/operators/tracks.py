"""Assignment within a frame and association of a group's rows over frames: order-dependent
work on one group or frame at a time."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import sha256
from heapq import heappop, heappush
from itertools import pairwise
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import is_number
from tidemark.operators import ranges
from tidemark.operators.components import connected_components
from tidemark.operators.intervals import stretches_apart
from tidemark.operators.keys import keyed_join
from tidemark.operators.line_assignment import nearest_first
from tidemark.operators.ranges import fit_a_task, in_places, in_ranges
from tidemark.operators.sessions import running, stretches
from tidemark.plans.staging import drop, new_path, staged


def _pairs(keys: list[str], df: DataFrame) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], T.StructField("left_id", T.LongType()), T.StructField("right_id", T.LongType()), T.StructField("cost", T.DoubleType())])


#: Pairs of a frame that one task takes at once; larger frames are assigned in bands of cost.
FRAME_PAIRS = 1_000_000


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    left, right, kept = set(), set(), []
    for i, a, b in pdf.sort_values(["cost", "left_id", "right_id"])[["left_id", "right_id"]].itertuples():
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            kept.append(i)
    return pdf.loc[kept]


def greedy_assignment(pairs: DataFrame, keys: list[str], most: float) -> DataFrame:
    """One-to-one pairs of each frame by rising cost, up to ``most``: keys, left_id, right_id,
    cost of ``pairs`` with these columns; ties by left_id, right_id. Pairs with a null id or cost, or a
    cost that is NaN, are none, a repeated pair is one with its least cost, a null key is one like others.

    Frames of up to FRAME_PAIRS pairs are taken one to a task. The pairs of larger ones are dealt in
    the order of their cost into bands of about as many, and band after band, of all frames at once,
    what is still free in it is taken one frame to a task. Rounds are the bands of the largest frame,
    whatever its costs, and each reads only its own pairs and what was taken before.
    """
    spark, scratch = pairs.sparkSession, []
    usable = pairs.where((F.col("cost") <= most) & ~F.isnan(F.col("cost").cast("double")) & F.col("left_id").isNotNull() & F.col("right_id").isNotNull())
    once = staged(usable.groupBy(*keys, "left_id", "right_id").agg(F.min("cost").alias("cost")).select(*keys, "left_id", "right_id", "cost"), "pairs", scratch)
    large = once.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > FRAME_PAIRS)
    if large.isEmpty():
        found = staged(once.groupBy(*keys).applyInPandas(_greedy, _pairs(keys, once)), "assigned")
        drop(spark, scratch)
        return found
    large = staged(large, "large", scratch)
    chosen = keyed_join(once, large.drop("_n"), keys, "left_anti").groupBy(*keys).applyInPandas(_greedy, _pairs(keys, once))
    placed = in_places(keyed_join(once, large.drop("_n"), keys, "left_semi"), keys, ["cost", "left_id", "right_id"], scratch, "_place")
    banded = placed.withColumn("_band", F.floor(F.col("_place") / max(1, FRAME_PAIRS))).drop("_place").repartition("_band")
    path = new_path(spark, "bands")
    scratch.append(path)
    banded.write.partitionBy("_band").parquet(path)
    bands, taken = spark.read.schema(T.StructType([*once.schema, T.StructField("_band", T.LongType())])).parquet(path), None
    for band in range(int(large.agg(F.max("_n")).first()[0] - 1) // max(1, FRAME_PAIRS) + 1):
        free = bands.where(F.col("_band") == band).drop("_band")
        for side in ("left_id", "right_id"):
            free = free if taken is None else keyed_join(free, taken.select(*keys, side), [*keys, side], "left_anti")
        won = free.groupBy(*keys).applyInPandas(_greedy, _pairs(keys, once))
        if taken is None:
            folder = new_path(spark, "taken")
            scratch.append(folder)
        won.write.mode("append").parquet(folder)
        taken = spark.read.schema(_pairs(keys, once)).parquet(folder)
    found = staged(chosen.unionByName(taken), "assigned")
    drop(spark, scratch)
    return found


def _matched(links: list[list[tuple[int, float]]], rights: int, unmatched: float) -> list[int]:
    """For each left side the right one it is given, or -1, at the least total cost, where being given
    none costs ``unmatched``. ``links`` has the right sides and costs of each left one.

    Shortest augmenting paths over these lists, by reduced costs: memory goes with the links."""
    price_l, price_r = [0.0] * len(links), [0.0] * rights
    of_left, of_right = [-1] * len(links), [-1] * rights
    for begin, own in enumerate(links):
        price_l[begin] = min([unmatched, *[c - price_r[r] for r, c in own]])
        reach: dict[int, float] = {}
        back: dict[int, int] = {}
        heap: list[tuple[float, int]] = []
        done: set[int] = set()
        lefts = [(begin, 0.0)]
        total, last, alone = unmatched - price_l[begin], -1, begin
        here, so_far = begin, 0.0
        while True:
            for r, c in links[here]:
                way = so_far + c - price_l[here] - price_r[r]
                if r not in done and way < reach.get(r, total):
                    reach[r], back[r] = way, here
                    heappush(heap, (way, r))
            while heap and (heap[0][1] in done or heap[0][0] > reach[heap[0][1]]):
                heappop(heap)
            if not heap or heap[0][0] >= total:
                break
            so_far, r = heappop(heap)
            done.add(r)
            if of_right[r] < 0:
                total, last, alone = so_far, r, -1
                break
            here = of_right[r]
            lefts.append((here, so_far))
            if so_far + unmatched - price_l[here] < total:
                total, last, alone = so_far + unmatched - price_l[here], -1, here
        for left, way in lefts:
            price_l[left] += total - way if way < total else 0
        for r in done:
            price_r[r] -= total - reach[r] if reach[r] < total else 0
        if alone >= 0:  # this left side gives its right one up, unless it is the one to be placed
            last, of_left[alone] = of_left[alone], -1
        while last >= 0:
            left = back[last]
            before, of_left[left], of_right[last] = of_left[left], last, left
            last = before if left != begin else -1
    return of_left


def least_cost_assignment(pairs: DataFrame, keys: list[str], unmatched: float) -> DataFrame:
    """The one-to-one pairs of each frame with the least total cost, where every left id without
    a pair costs ``unmatched``: keys, left_id, right_id, cost. Pairs with a null id or cost, or a cost
    that is NaN, are none, a null key is one like others. A pair that costs more than ``unmatched`` is
    never taken; of assignments of equal cost it is any.

    Frames of up to FRAME_PAIRS pairs are taken one to a task; of larger ones, each group of ids that
    chains of pairs connect. A task holds its pairs as lists, some 200 bytes each, and no matrix:
    20,000 ids in one group with 400,000 pairs take some 100 MB.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["left_id", "right_id"], ignore_index=True)
        left, lefts = pd.factorize(pdf["left_id"], sort=True)
        right, rights = pd.factorize(pdf["right_id"], sort=True)
        links: list[list[tuple[int, float]]] = [[] for _ in lefts]
        for a, b, c in zip(left.tolist(), right.tolist(), pdf["cost"].astype(float).tolist(), strict=True):
            links[a].append((b, c))
        given = np.array(_matched(links, len(rights), unmatched))
        return pdf[given[left] == right]

    spark, scratch = pairs.sparkSession, []
    usable = pairs.where(F.col("left_id").isNotNull() & F.col("right_id").isNotNull() & (F.col("cost") <= unmatched) & ~F.isnan(F.col("cost").cast("double")))
    once = staged(usable.groupBy(*keys, "left_id", "right_id").agg(F.min("cost").cast("double").alias("cost")).select(*keys, "left_id", "right_id", "cost"), "pairs", scratch)
    large = once.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > FRAME_PAIRS).drop("n")
    chosen = keyed_join(once, large, keys, "left_anti").groupBy(*keys).applyInPandas(run, _pairs(keys, once))
    rest = keyed_join(once, large, keys, "left_semi")
    if not rest.isEmpty():
        left, right = (F.struct(*keys, F.lit(side).alias("side"), F.col(f"{side}_id").cast("long").alias("id")) for side in ("left", "right"))
        groups = connected_components(rest.select(left.alias("left"), right.alias("right")))
        grouped = rest.withColumn("id", left).join(groups, "id").drop("id")
        chosen = chosen.unionByName(grouped.groupBy("component").applyInPandas(lambda pdf: run(pdf.drop(columns="component")), _pairs(keys, once)))
    found = staged(chosen, "assigned")
    drop(spark, scratch)
    return found


#: Tracks times values of a frame up to which their near pairs are listed; beyond that neighbours are kept on a heap.
LISTED_PAIRS = 10_000


def associate_frame(live: dict[int, tuple[int, float]], count: int, at: int, values: list[float], reach: float, missed: int) -> tuple[list[int], dict[int, tuple[int, float]], int]:
    """One frame's tracks: their numbers for ``values``, which rise, the tracks alive after it (number
    to last frame and value) and how many there have been. Of equally near pairs that of the track
    with the smaller last value comes first, then the earlier last frame, the smaller number, the
    earlier of ``values``."""
    live = {k: s for k, s in live.items() if at - s[0] - 1 <= missed}
    used, got = set(), {}
    rising = np.array(values)
    if len(live) * len(values) > LISTED_PAIRS and math.isfinite(reach) and rising.dtype.kind in "if" and np.isfinite(rising).all() and np.abs(rising).max() < 2**53:
        order = sorted(live, key=lambda k: (live[k][1], live[k][0], k))
        i, j, _, _ = nearest_first(np.array([live[k][1] for k in order], float), rising.astype(float), reach)
        got = {b: order[a] for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    else:
        near = []
        for k, (frame, value) in live.items():
            i = bisect_left(values, value - reach)
            while i and abs(values[i - 1] - value) <= reach:  # rounding of the difference
                i -= 1
            while i < len(values) and (values[i] <= value or abs(values[i] - value) <= reach):
                if abs(values[i] - value) <= reach:
                    near.append((abs(values[i] - value), value, frame, k, i))
                i += 1
        for *_, k, i in sorted(near):
            if k not in used and i not in got:
                used.add(k)
                got[i] = k
    for i, x in enumerate(values):
        if i not in got:
            got[i], count = count, count + 1
        live[got[i]] = (at, x)
    return [got[i] for i in range(len(values))], live, count


def _numbered(found: DataFrame, keys: list[str], name: str, out: str) -> tuple[DataFrame, DataFrame]:
    """``out``: the numbers ``name`` of a key's stretches (``_stretch``, each numbered from 0) one
    after another; and keys, ``_total``: how many there are. Only one row a stretch meets the
    others."""
    tops = found.groupBy(*keys, "_stretch").agg((F.max(name) + 1).alias("_n"))
    sums = running(tops, keys, "_stretch", [], F.col("_n"), STRETCHES, "_to", "_total")
    offsets = sums.select(*keys, "_stretch", (F.col("_to") - F.col("_n")).alias("_from"))
    numbered = keyed_join(found, offsets, [*keys, "_stretch"]).withColumn(out, F.col(name) + F.col("_from"))
    return numbered, tops.groupBy(*keys).agg(F.sum("_n").alias("_total"))


#: Stretches of a key that one window takes.
STRETCHES = 100_000


def _part_state(pdf: pd.DataFrame) -> dict[int, tuple[int, float]]:
    """The tracks alive before a part of a stretch, numbered from 0 in the order they are told."""
    frames, values = pdf["_frames"].iloc[0], pdf["_values"].iloc[0]
    return {} if frames is None else {k: (int(f), float(v)) for k, (f, v) in enumerate(zip(frames, values, strict=True))}


def _digest(frames: list[int], values: list[float]) -> str:
    """A short name of the tracks alive before a part."""
    return sha256(np.array(frames, np.int64).tobytes() + np.array(values, float).tobytes()).hexdigest()


def associate(df: DataFrame, keys: list[str], frame: str, value: str, tie: str, reach: float, missed: int) -> DataFrame:
    """``track``: number from 0 within the key. In each frame, values go one to one to the live
    tracks whose last value is nearest, up to ``reach``, nearest pairs first (ties as in
    :func:`associate_frame`); the others begin tracks. A track unseen for more than ``missed``
    frames ends. Rows with a null frame or a null or NaN value are in no track; a null key is one
    like others; repeated rows are rows of their own.

    Where a key is quiet for more than ``missed`` frames all its tracks end, so it falls into
    stretches. Those of up to ranges.RANGE_ROWS rows are taken one to a task; where one has more, they
    fall into parts of whole frames of about as many. All parts are taken at once, each from the tracks that were alive before it; where these turn out to be others
    than assumed (at first: none), the part is taken again, until none changes. Only last frames and
    values of live tracks matter for that, not their numbers, so most parts settle soon. Where they do
    not (a round leaves over half as many open as it took), a round takes only the first open part of each stretch, which then is
    settled, so that a part is taken few times in all. Then numbers are handed on from part to part.
    The tracks alive before a part go to its task once, not with its rows.
    """
    spark, scratch = df.sparkSession, []
    known = F.coalesce(F.col(frame).isNotNull() & is_number(value), F.lit(False))
    frames = df.where(known).select(*keys, frame).distinct()
    frames = stretches(frames, keys, frame, frame, [frame], lambda p: F.col(frame) - p[frame] > missed + 1, 16 * (missed + 1), "_stretch")
    rows_of = keyed_join(df.where(known), frames, [*keys, frame])
    if fit_a_task(rows_of, [*keys, "_stretch"]):

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([frame, value, tie], ignore_index=True)
            labels, live, count = [], {}, 0
            for at, here in pdf.groupby(frame, sort=True):
                found, live, count = associate_frame(live, count, int(at), here[value].tolist(), reach, missed)
                labels += found
            return pdf.assign(_track=np.array(labels, np.int64))

        found = staged(rows_of.groupBy(*keys, "_stretch").applyInPandas(whole, T.StructType([*rows_of.schema, T.StructField("_track", T.LongType())])), "tracks")
        tracks, _ = _numbered(found, keys, "_track", "track")
        return tracks.select(*df.columns, "track").unionByName(df.where(~known).withColumn("track", F.lit(None).cast("long")))
    parts = in_ranges(rows_of, [*keys, "_stretch", frame], scratch)
    group, last = [*keys, "_stretch"], []
    part = [*group, "_range"]
    along = Window.partitionBy(*group).orderBy("_range")
    firsts = parts.groupBy(*part).agg(F.min(frame).cast("long").alias("_first"))
    heads = staged(firsts.select(*part, F.lead("_first").over(along).alias("_next"), F.lag("_range").over(along).alias("_before")), "heads", scratch)
    named = [*[df.schema[k] for k in keys], parts.schema["_stretch"], parts.schema["_range"]]
    longs, doubles = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())

    def rows(pdf: pd.DataFrame, state: pd.DataFrame) -> tuple[list[int], dict[int, tuple[int, float]], int]:
        live = _part_state(state)
        labels, count = [], len(live)
        for at, here in pdf.groupby(frame, sort=True):
            found, live, count = associate_frame(live, count, int(at), here[value].tolist(), reach, missed)
            labels += found
        return labels, live, count

    def passed(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        """The tracks alive at the next part's first frame, by last value, frame and number."""
        pdf, assumed, following = pdf.sort_values([frame, value], ignore_index=True), _part_state(state), state["_next"].iloc[0]
        _, live, count = rows(pdf, state)
        on = sorted((v, f, k) for k, (f, v) in live.items() if not pd.isna(following) and following - f - 1 <= missed)
        used, told = (_digest([f for f, _ in t], [v for _, v in t]) for t in (list(assumed.values()), [(f, v) for v, f, _ in on]))
        row = [*pdf[part].iloc[0].tolist(), used, told, [f for _, f, _ in on], [v for v, _, _ in on], [k for _, _, k in on], count - len(assumed)]
        return pd.DataFrame([row], columns=passed_on.fieldNames())

    passed_on = T.StructType([*named, T.StructField("_used", T.StringType()), T.StructField("_told", T.StringType()), T.StructField("_to_frames", longs), T.StructField("_to_values", doubles), T.StructField("_to_numbers", longs), T.StructField("_new", T.LongType())])
    folder = new_path(spark, "passed")
    scratch.append(folder)
    nothing = {"_frames": F.lit(None).cast(longs), "_values": F.lit(None).cast(doubles)}

    def of_rounds(latest: DataFrame) -> DataFrame:
        """What the parts of ``latest`` (part, _round) passed on in these rounds."""
        took = sorted(r["_round"] for r in latest.select("_round").distinct().collect())
        told = reduce(DataFrame.unionByName, [spark.read.schema(passed_on).parquet(f"{folder}/{k}").withColumn("_round", F.lit(k)) for k in took])
        return keyed_join(told, F.broadcast(latest), [*part, "_round"], "left_semi").drop("_round")

    latest, open_, taken, number = None, heads.withColumn("_first", F.lit(1)), 0, 0
    while count := open_.count():
        few = number < 2 or 2 * count <= taken
        take = staged(open_ if few else open_.where("_first = 1"), "take", now := [])
        taken = count
        if latest is None:
            state = take.select(*part, "_next").withColumns(nothing)
        else:
            ahead = keyed_join(take.where("_before is not null").select(*group, F.col("_before").alias("_range"), F.col("_range").alias("_to")), latest.select(*part, "_round"), part)
            came = keyed_join(of_rounds(staged(ahead.select(*part, "_round"), "ahead", now)), ahead.select(*part, "_to"), part)
            came = came.select(*group, F.col("_to").alias("_range"), F.col("_to_frames").alias("_frames"), F.col("_to_values").alias("_values"))
            state = keyed_join(take.select(*part, "_next"), came, part, "left")
        which = [r["_range"] for r in take.select("_range").distinct().collect()]  # one for RANGE_ROWS rows
        here = parts.where(F.col("_range").isin(which)) if not few else parts
        here = keyed_join(here.select(*part, frame, value), F.broadcast(take.select(*part)), part, "left_semi")
        found = here.groupBy(*part).cogroup(state.groupBy(*part)).applyInPandas(passed, passed_on)
        found.write.option("compression", "zstd").parquet(f"{folder}/{number}")
        told = spark.read.schema(passed_on).parquet(f"{folder}/{number}").select(*part, "_used", "_told").withColumn("_round", F.lit(number))
        latest = staged(told if latest is None else told.unionByName(keyed_join(latest, F.broadcast(take.select(*part)), part, "left_anti")), "latest", now)
        assumed = latest.select(*part, "_used", F.coalesce(F.lag("_told").over(along), F.lit(_digest([], []))).alias("_told"))
        still = keyed_join(heads, assumed.where("_used != _told").select(*part), part, "left_semi")
        open_ = staged(still.withColumn("_first", F.row_number().over(along)), "open", now)
        drop(spark, last)
        last, number = now, number + 1
    if latest is None:
        drop(spark, scratch)
        drop(spark, last)
        return df.withColumn("track", F.lit(None).cast("long"))
    ends = staged(of_rounds(latest.select(*part, "_round")), "ends", scratch)

    def handed_on(pdf: pd.DataFrame) -> pd.DataFrame:
        """Numbers of the tracks alive before each part, and how many began before it."""
        pdf, numbers, count, incoming, begun = pdf.sort_values("_range", ignore_index=True), [], 0, [], []
        for at, new in zip(pdf["_to_numbers"], pdf["_new"], strict=True):
            incoming.append(numbers)
            begun.append(count)
            numbers = [numbers[k] if k < len(numbers) else count + k - len(numbers) for k in at.tolist()]
            count += new
        return pdf[part].assign(_numbers=incoming, _begun=begun)

    numbers = ends.select(*part, "_to_numbers", "_new").groupBy(*group).applyInPandas(handed_on, T.StructType([*named, T.StructField("_numbers", longs), T.StructField("_begun", T.LongType())]))
    onward = heads.where("_before is not null").select(*group, F.col("_before").alias("_range"), F.col("_range").alias("_to"))
    came = keyed_join(ends.select(*part, "_to_frames", "_to_values"), onward, part)
    came = came.select(*group, F.col("_to").alias("_range"), F.col("_to_frames").alias("_frames"), F.col("_to_values").alias("_values"))
    states = staged(keyed_join(numbers, came, part, "left"), "states", scratch)

    def labelled(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([frame, value, tie], ignore_index=True)
        labels, _, _ = rows(pdf, state)
        numbers, begun = [int(k) for k in state["_numbers"].iloc[0]], int(state["_begun"].iloc[0])
        tracks = [numbers[k] if k < len(numbers) else begun + k - len(numbers) for k in labels]
        return pdf[columns].assign(_track=np.array(tracks, np.int64))

    columns = [*df.columns, "_stretch"]
    schema = T.StructType([*df.schema, parts.schema["_stretch"], T.StructField("_track", T.LongType())])
    found = staged(parts.groupBy(*part).cogroup(states.groupBy(*part)).applyInPandas(labelled, schema), "tracks", scratch)
    tracks, _ = _numbered(found, keys, "_track", "track")
    tracks = staged(tracks.select(*df.columns, "track"), "tracks")
    drop(spark, scratch)
    drop(spark, last)
    return tracks.unionByName(df.where(~known).withColumn("track", F.lit(None).cast("long")))


def _cost(gap: float, step: float, most_gap: int, most_step: float) -> float:
    """Cost of a link: gap and step in shares of the most that they may be."""
    return (gap / most_gap if most_gap else 0) + (step / most_step if most_step else 0)


#: Kinds of rows of a part's task: its segments, copies of those after it, chains that come to a
#: segment of it, chains whose next segment it chooses, segments after it that a chain holds.
SEGMENT, AHEAD, COMING, CHOOSING, HELD = range(5)


def _walk_part(pdf: pd.DataFrame, most_gap: int, most_step: float) -> tuple[list[int], list[tuple]]:
    """One part of a stretch, given what the parts around it tell: by place, the ranks of its
    segments' chains (the place of the segment that began it), and what it tells:
    (range it is for, kind, rank, place, end, last value, range that claimed it)."""
    kind = pdf["_kind"]
    line = pdf[kind <= AHEAD].sort_values(["_kind", "_place"])
    own = int((line["_kind"] == SEGMENT).sum())
    start, end, first, last, ids, place, due, owner = (line[c].tolist() for c in ("start_t", "end_t", "first_value", "last_value", "id", "_place", "_due", "_owner"))
    at = {k: i for i, k in enumerate(place)}
    here = owner[0]
    held = {at[k]: rank for k, rank in pdf.loc[kind == HELD, ["_place", "_rank"]].itertuples(index=False)}
    chain, claimed, told = [-1] * len(line), [here] * own, []

    def forward(rank: int, since: int, value: float) -> None:
        """Goes on from a segment's end while the next one is this part's to follow."""
        while True:
            best = None
            for k in range(bisect_left(start, since), bisect_right(start, since + most_gap)):
                if chain[k] < 0 and held.get(k, rank) >= rank and abs(first[k] - value) <= most_step:
                    best = min(best or (math.inf,), (_cost(start[k] - since, abs(first[k] - value), most_gap, most_step), ids[k], k))
            if best is None:
                return
            k = best[2]
            chain[k] = rank
            if k >= own:
                told.append((owner[k], COMING, rank, place[k], 0, 0.0, here))
                return
            if due[k] != here:
                told.append((due[k], CHOOSING, rank, 0, end[k], last[k], here))
                return
            since, value = end[k], last[k]

    def follow(k: int) -> None:
        if due[k] != here:
            told.append((due[k], CHOOSING, chain[k], 0, end[k], last[k], here))
        else:
            forward(chain[k], end[k], last[k])

    coming = pdf[(kind == COMING) | (kind == CHOOSING)].sort_values(["_rank", "_kind", "_place", "end_t", "last_value"])
    for what, rank, k, since, value, by in coming[["_kind", "_rank", "_place", "end_t", "last_value", "_by"]].itertuples(index=False):
        if what == CHOOSING:
            forward(rank, since, value)
        elif chain[at[k]] < 0:
            chain[at[k]], claimed[at[k]] = rank, by
            follow(at[k])
    moments: dict[int, list[int]] = {}
    for k in range(own):
        if start[k] == end[k]:
            moments.setdefault(start[k], []).append(k)
    for seed in range(own):
        if chain[seed] >= 0:
            continue
        chain[seed] = place[seed]
        follow(seed)
        back: int | None = seed
        while back is not None:  # only segments that end where they begin can end at an earliest one's start
            near = [(_cost(0, abs(first[back] - last[k]), most_gap, most_step), ids[k], k) for k in moments.get(start[back], []) if chain[k] < 0 and abs(first[back] - last[k]) <= most_step]
            back = min(near)[2] if near else None
            if back is not None:
                chain[back] = place[seed]
    shown = line["_shown"].tolist()
    told += [(here, HELD, chain[k], place[k], 0, 0.0, claimed[k]) for k in range(own) if shown[k]]
    return chain[:own], told


def _chains_in_parts(spans: DataFrame, keys: list[str], most_gap: int, most_step: float) -> DataFrame:
    """``spans`` with ``_chain``, its number from 0 within the key's ``_stretch``, for stretches that
    no task holds; no segment ends before it starts.

    Segments fall by their start into parts of about ranges.RANGE_ROWS rows. A chain's next segment
    is chosen in the part that the end of its last one falls in, which also knows the segments of
    ``most_gap`` after the part. All parts are taken at once, from what the others told of the last
    round: the chains that come into them and who holds the segments after them; those for which
    that changed are taken again, until it does not change. A chain depends on chains begun before
    it only, so the earliest is settled first, then the next, and there is one end.
    """
    spark, scratch, group = spans.sparkSession, [], [*keys, "_stretch"]
    part, order = [*group, "_range"], ["start_t", "id", "end_t", "first_value", "last_value"]
    rows = in_ranges(spans, [*group, "start_t"], scratch)
    along = Window.partitionBy(*group).orderBy("_range")
    heads = rows.groupBy(*part).agg(F.min("start_t").alias("_low"))
    heads = staged(heads.select(*part, "_low", F.lag("_range").over(along).alias("_before"), F.lead("_low").over(along).alias("_next"), F.row_number().over(along).cast("long").alias("_nth")), "heads", scratch)
    place = F.shiftleft(F.col("_range").cast("long"), 33) + F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    rows = staged(keyed_join(rows, heads, part).withColumn("_place", place), "places", scratch)
    # The part that a segment's end falls in: as many parts of the stretch begin up to there.
    far = F.col("end_t") >= F.col("_next")
    marks = rows.where(far).select(*group, "_place", F.col("end_t").alias("_at"), F.lit(0).alias("_one"))
    marks = marks.unionByName(heads.select(*group, F.lit(0).cast("long").alias("_place"), F.col("_low").alias("_at"), F.lit(1).alias("_one")))
    marks = running(marks, group, "_at", ["_place"], F.col("_one"), 16 * max(1, most_gap), "_nth", "_of").where("_one = 0")
    due = keyed_join(marks.select(*group, "_place", F.col("_nth").cast("long").alias("_nth")), heads.select(*group, "_nth", F.col("_range").alias("_due")), [*group, "_nth"])
    shown = F.col("_before").isNotNull() & (F.col("start_t") <= F.col("_low") + most_gap)
    fields = ["_range", "start_t", "end_t", "first_value", "last_value", "id", "_place", "_due", "_owner", "_shown"]
    rows = keyed_join(rows, due.select(*group, "_place", "_due"), [*group, "_place"], "left")
    rows = staged(rows.withColumns({"_due": F.coalesce("_due", "_range"), "_owner": F.col("_range"), "_shown": shown}), "segments", scratch)
    # Copies for the parts before, whose ends are up to most_gap before a segment's start.
    cell = lambda t: F.floor(F.col(t) / (most_gap + 1))
    borders = heads.where(F.col("_before").isNotNull()).select(*group, F.col("_before").alias("_to"), F.col("_low").alias("_border"), cell("_low").alias("_cell"))
    looking = rows.where("_shown").drop("_before", "_next", "_low", "_nth").withColumn("_cell", F.explode(F.array(cell("start_t"), cell("start_t") - 1)))
    seen = keyed_join(looking, borders, [*group, "_cell"]).where(F.col("_border").between(F.col("start_t") - most_gap, F.col("start_t")))
    empty = {"_rank": F.lit(0).cast("long"), "_by": F.lit(0)}
    typed = {"start_t": "long", "end_t": "long", "first_value": "double", "last_value": "double", "id": spans.schema["id"].dataType.simpleString()}
    plain = lambda df, kind: df.withColumns({c: F.col(c).cast(t) for c, t in typed.items()}).withColumns(empty).select(*group, *fields, *empty, F.lit(kind).alias("_kind"))
    ahead = staged(plain(seen.withColumn("_range", F.col("_to")), AHEAD), "ahead", scratch)
    still = plain(rows, SEGMENT).unionByName(ahead)
    shows = ahead.select(*group, "_place", F.col("_range").alias("_to"))
    news = ["_kind", "_rank", "_place", "end_t", "last_value", "_by"]
    named = [still.schema[c] for c in group]
    told_schema = T.StructType([*named, T.StructField("_source", T.IntegerType()), *[still.schema[c] for c in ("_range", *news)]])

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        *own, source = pdf[part].iloc[0].tolist()
        return pd.DataFrame([(*own, source, *t) for t in _walk_part(pdf, most_gap, most_step)[1]], columns=told_schema.fieldNames())

    def beside(state: DataFrame, of: DataFrame | None = None) -> DataFrame:
        """Rows of the parts' tasks, of the parts ``of`` only where given."""
        others = {c: F.lit(0).cast(still.schema[c].dataType) for c in still.columns if c not in (*part, *news, "id")}
        given = still.unionByName(state.withColumns(others | {"id": F.lit(None).cast(still.schema["id"].dataType)}))
        return keyed_join(given, of, part, "left_semi") if of is not None else given

    nothing = still.select(*part, *news).limit(0)
    state, told, open_, last = nothing, None, heads.select(*part), []
    while not open_.isEmpty():
        found = beside(state, open_).groupBy(*part).applyInPandas(tell, told_schema)
        if told is not None:
            closed = keyed_join(told, open_.withColumnRenamed("_range", "_source"), [*group, "_source"], "left_anti")
            found = found.unionByName(closed)
        told = staged(found, "told", now := [])
        held = keyed_join(told.where(F.col("_kind") == HELD), shows, [*group, "_place"]).where("_by != _to").withColumn("_range", F.col("_to"))
        held = held.withColumn("_by", F.lit(0))  # who holds it matters, not whence it came
        fresh = told.where(F.col("_kind") != HELD).select(*part, *news).unionByName(held.select(*part, *news))
        fresh = staged(fresh, "state", now)
        changes = fresh.withColumn("_n", F.lit(1)).unionByName(state.withColumn("_n", F.lit(-1))).groupBy(*part, *news).agg(F.sum("_n").alias("_n"))
        open_ = staged(changes.where("_n != 0").select(*part).distinct(), "open", now)
        drop(spark, last)
        state, last = fresh, now

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["_kind"] == SEGMENT].sort_values("_place", ignore_index=True)
        return own[[*part, "_place"]].assign(_rank=np.array(_walk_part(pdf, most_gap, most_step)[0], np.int64))

    chains = beside(state).groupBy(*part).applyInPandas(ranked, T.StructType([still.schema[c] for c in (*part, "_place", "_rank")]))
    chains = staged(chains, "ranks", scratch)
    seeds = chains.where("_place = _rank")
    before = seeds.groupBy(*part).agg(F.count("*").alias("_seeds")).select(*part, (F.sum("_seeds").over(along) - F.col("_seeds")).alias("_begun"))
    numbers = keyed_join(seeds, before, part).select(*group, "_rank", (F.col("_begun") + F.row_number().over(Window.partitionBy(*part).orderBy("_rank")) - 1).alias("_chain"))
    # A chain's number goes to its parts first, so that one of many rows is not one task's.
    met = keyed_join(chains.select(*part, "_rank").distinct(), numbers, [*group, "_rank"])
    numbered = keyed_join(keyed_join(chains, met, [*part, "_rank"]), rows.drop("_due", "_owner", "_shown", "_low", "_before", "_next", "_nth"), [*part, "_place"])
    result = staged(numbered.select(*spans.columns, "_chain"), "chains")
    drop(spark, scratch)
    drop(spark, last)
    return result


def _walk(start: list, end: list, first: list, last: list, ids: list, most_gap: int, most_step: float) -> list[int]:
    """The chains of a stretch's segments, which come in the order of their start."""
    by_end = sorted(range(len(end)), key=lambda k: (end[k], k))
    ends = [end[k] for k in by_end]
    chain, number = [-1] * len(end), 0

    def follow(here: int, forward: bool) -> int | None:
        if forward:
            near = range(bisect_left(start, end[here]), bisect_right(start, end[here] + most_gap))
        else:
            near = (by_end[k] for k in range(bisect_left(ends, start[here] - most_gap), bisect_right(ends, start[here])))
        best = None
        for k in near:
            if chain[k] >= 0:
                continue
            a, b = (here, k) if forward else (k, here)
            gap, step = start[b] - end[a], abs(first[b] - last[a])
            if step <= most_step:
                best = min(best or (math.inf,), (_cost(gap, step, most_gap, most_step), ids[k], k))
        return best[2] if best else None

    for seed in range(len(end)):
        if chain[seed] >= 0:
            continue
        chain[seed] = number
        for forward in (True, False):
            here: int | None = seed
            while (here := follow(here, forward)) is not None:
                chain[here] = number
        number += 1
    return chain


def chain_links(segments: DataFrame, keys: list[str], most_gap: int, most_step: float) -> DataFrame:
    """``chain`` of ``segments`` (keys, id, start_t, end_t, first_value, last_value): the earliest
    unused segment begins a chain, which goes on forward with the unused segment of least cost
    (gap in shares of ``most_gap`` plus step in shares of ``most_step``), then backward from its
    beginning; ties to the smaller id. Segments that share an id are segments of their own, in the
    order of start, id, end and values. Segments with a null are chains of their own, numbered last
    in the order of their ids; a null key is one like others.

    No chain goes on over a pause of more than ``most_gap`` without segments, so the stretches
    between such pauses are taken apart. Those of up to ranges.RANGE_ROWS segments are taken whole, many
    to a task, where each step looks at the segments within ``most_gap`` only, and larger ones in parts
    (:func:`_chains_in_parts`). A task holds a part, the segments of ``most_gap`` after it and the
    chains that come into it. Only a larger stretch in which a segment ends before it starts is one
    task whole, as its chains go back in time."""
    columns = segments.columns
    nulls = reduce(or_, [F.col(c).isNull() for c in ("id", "start_t", "end_t", "first_value", "last_value")])
    spans = segments.where(~nulls).withColumns({"_low": F.least("start_t", "end_t"), "_high": F.greatest("start_t", "end_t")})
    spark, scratch, group = segments.sparkSession, [], [*keys, "_stretch"]
    apart = staged(stretches_apart(spans, keys, "_low", "_high", most_gap, 16 * max(1, most_gap), "_stretch").drop("_low", "_high"), "apart", scratch)
    large = apart.groupBy(*group).agg(F.count("*").alias("_n"), F.min(F.col("end_t") >= F.col("start_t")).alias("_ahead"))
    large = staged(large.where((F.col("_n") > ranges.RANGE_ROWS) & F.col("_ahead")).select(*group), "large", scratch)
    parts = keyed_join(apart, large, group, "left_anti")

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        """Chains of whole stretches, each of which begins where ``_nth`` is 1."""
        every, chains = [rows[c].tolist() for c in ("start_t", "end_t", "first_value", "last_value", "id")], []
        bounds = [*np.flatnonzero(rows["_nth"].to_numpy() == 1).tolist(), len(rows)]
        for i, j in pairwise(bounds):
            chains += _walk(*[c[i:j] for c in every], most_gap, most_step)
        return rows.drop(columns="_nth").assign(_chain=np.array(chains, np.int64))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            begins = np.flatnonzero(batch["_nth"].to_numpy() == 1)
            if len(begins):
                ended = pd.concat([*held, batch.iloc[: begins[-1]]], ignore_index=True) if held else batch.iloc[: begins[-1]]
                if len(ended):
                    yield whole(ended)
                held, batch = [], batch.iloc[begins[-1] :]
            held.append(batch)
        if held:
            yield whole(pd.concat(held, ignore_index=True))

    # The window leaves a stretch's rows one after the other in their order, many stretches in one batch.
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("start_t", "id", "end_t", "first_value", "last_value"))
    found = parts.withColumn("_nth", nth).mapInPandas(run, T.StructType([*parts.schema, T.StructField("_chain", T.LongType())]))
    if not large.isEmpty():
        found = found.unionByName(_chains_in_parts(keyed_join(apart, large, group, "left_semi"), keys, most_gap, most_step))
    found = staged(found, "chains")
    drop(spark, scratch)
    chains, totals = _numbered(found, keys, "_chain", "chain")
    others = running(segments.where(nulls), keys, "id", ["start_t", "end_t"], F.lit(1), STRETCHES, "_rank", "_all")
    others = keyed_join(others, totals, keys, "left").withColumn("chain", F.coalesce("_total", F.lit(0)) + F.col("_rank") - 1)
    return chains.select(*columns, "chain").unionByName(others.select(*columns, F.col("chain").cast("long")))
