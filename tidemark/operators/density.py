"""DBSCAN: keys of up to GROUP_ROWS rows one to a task, larger ones over a grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import is_number
from tidemark.operators.components import connected_components
from tidemark.operators.keys import keyed_join
from tidemark.operators.ranges import in_places, to_each
from tidemark.plans.staging import broadcast_if_small, drop, staged

#: Rows of a key that one task takes at once; larger keys are clustered over a grid.
GROUP_ROWS = 10_000
#: Sites that one task compares at once with those that ask for them.
SLICE = 10_000
#: Sites of a cell or node that are compared one by one with those of another.
FEW = 64
#: Cells a radius is wide: a little over the square root of 2, so that a cell's sites are near each other.
CELLS = 1.4143
CELL = ["_k", "cx", "cy"]


def dbscan(df: DataFrame, keys: list[str], x: str, y: str, tie: str, scale: tuple[float, float], radius: float, least: int) -> DataFrame:
    """``cluster``: DBSCAN over (x / scale, y / scale); noise joins the cluster of the nearest
    clustered point (of equally near ones the first in the order of ``x``, ``tie``), or is -1 where
    there is none. Clusters are numbered by their first core point in that order, and a point near
    core points of several is in the first. A null or NaN x or y is near nothing and -1; repeated
    rows are points of their own; a null key is one like others. ``radius`` is over 0.

    Keys of up to GROUP_ROWS rows are taken one to a task. Larger ones go by distinct places in
    cells whose places are all near each other: a cell of ``least`` rows is all core; places of
    sparser cells, at most ``least`` a cell, look into the cells around; cells of core points within
    reach are joined and their connected groups are the clusters. No task holds a key or a cell, and
    compared pairs are at most a fixed multiple of ``least`` times the rows.
    """
    if not radius > 0:
        raise ValueError("radius is over 0")
    scratch: list[str] = []
    good = is_number(x) & is_number(y)
    known, apart = df.where(good), df.where(~good).withColumn("cluster", F.lit(-1).cast("long"))
    large = known.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP_ROWS).drop("_n")
    schema = T.StructType([*df.schema, T.StructField("cluster", T.LongType())])
    if large.isEmpty():
        return known.groupBy(*keys).applyInPandas(_in_a_task(x, y, tie, scale, radius, least), schema).unionByName(apart)
    large = staged(large, "large", scratch)
    small = keyed_join(known, large, keys, "left_anti").groupBy(*keys).applyInPandas(_in_a_task(x, y, tie, scale, radius, least), schema)
    found = staged(_over_a_grid(keyed_join(known, large, keys, "left_semi"), keys, x, y, tie, scale, radius, least, scratch).unionByName(small), "clusters")
    drop(df.sparkSession, scratch)
    return found.unionByName(apart)


def _in_a_task(x: str, y: str, tie: str, scale: tuple[float, float], radius: float, least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([x, tie], ignore_index=True)
        p, n = pdf[[x, y]].to_numpy(float) / np.array(scale), len(pdf)
        label, next_label = np.full(n, -1), 0
        left = np.searchsorted(p[:, 0], p[:, 0] - radius)
        right = np.searchsorted(p[:, 0], p[:, 0] + radius, side="right")

        def near(i: int) -> np.ndarray:
            j = np.arange(left[i], right[i])
            return j[((p[j] - p[i]) ** 2).sum(axis=1) <= radius * radius]

        core = np.array([len(near(i)) >= least for i in range(n)], bool)
        for i in np.flatnonzero(core):
            if label[i] >= 0:
                continue
            label[i], stack = next_label, [i]
            while stack:
                for j in near(stack.pop()):
                    if label[j] < 0:
                        label[j] = next_label
                        if core[j]:
                            stack.append(j)
            next_label += 1
        known = np.flatnonzero(label >= 0)
        if len(known):
            for i in np.flatnonzero(label < 0):
                label[i] = label[known[((p[known] - p[i]) ** 2).sum(axis=1).argmin()]]
        return pdf.assign(cluster=label)

    return run


def _square(du: Column, dv: Column) -> Column:
    return du * du + dv * dv


def _least(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Square of the least distance of two boxes; rounding keeps it at most any of their points'."""
    gap = lambda lo, hi: F.greatest(a[lo] - b[hi], b[lo] - a[hi], F.lit(0.0))
    return _square(gap("lu", "hu"), gap("lv", "hv"))


def _most(a: dict[str, Column], b: dict[str, Column]) -> Column:
    far = lambda lo, hi: F.greatest(a[hi] - b[lo], b[hi] - a[lo])
    return _square(far("lu", "hu"), far("lv", "hv"))


def _boxed(sites: DataFrame, by: list[str | Column]) -> DataFrame:
    """The box and the number of sites of each group."""
    return sites.groupBy(*by).agg(F.min("u").alias("lu"), F.max("u").alias("hu"), F.min("v").alias("lv"), F.max("v").alias("hv"), F.count("*").alias("m"))


def _box(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in ("lu", "hu", "lv", "hv")}


def _point(prefix: str = "") -> dict[str, Column]:
    return {"lu": F.col(f"{prefix}u"), "hu": F.col(f"{prefix}u"), "lv": F.col(f"{prefix}v"), "hv": F.col(f"{prefix}v")}


def _near(asks: DataFrame, sites: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """Pairs of ``asks`` (_k, cx, cy, au, av) and ``sites`` within the radius: asks go to the 25 cells
    around that hold sites, and where there are many of these in one, to each of its slices."""
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    to = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in steps]))
    asked = asks.select(F.col("_k"), "au", "av", to.alias("_to")).select("_k", "au", "av", "_to.*")
    slices = cells.select(*CELL, F.ceil(F.col("m") / SLICE).alias("_slices"))
    asked = keyed_join(asked, slices, CELL).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")
    sliced = sites.withColumn("_slice", F.pmod(F.xxhash64("u", "v"), F.ceil(F.col("m") / SLICE)))
    met = keyed_join(sliced, asked, [*CELL, "_slice"]).drop("_slice")
    return met.where(_square(F.col("au") - F.col("u"), F.col("av") - F.col("v")) <= radius * radius)


def _over_a_grid(df: DataFrame, keys: list[str], x: str, y: str, tie: str, scale: tuple[float, float], radius: float, least: int, scratch: list[str]) -> DataFrame:
    side, known = radius / CELLS, F.struct(*keys).alias("_k")
    placed = staged(df.select("*", known, (F.col(x).cast("double") / scale[0] + 0.0).alias("_u"), (F.col(y).cast("double") / scale[1] + 0.0).alias("_v")), "points", scratch)
    at = lambda c: F.floor(F.col(c) / side)
    sites = placed.groupBy("_k", F.col("_u").alias("u"), F.col("_v").alias("v")).agg(F.count("*").alias("n"), F.min(F.struct(F.col(x).alias("x"), F.col(tie).alias("tie"))).alias("first"))
    sites = staged(sites.select("*", at("u").alias("cx"), at("v").alias("cy")), "sites", scratch)
    cells = staged(sites.groupBy(*CELL).agg(F.sum("n").alias("w"), F.count("*").alias("m")), "cells", scratch)
    sited = staged(to_each(sites, cells.withColumn("_n", F.col("m")), CELL), "sites", scratch)

    ask = lambda s: s.select(*CELL, F.col("u").alias("au"), F.col("v").alias("av"))
    site = ["_k", "u", "v"]
    around = _near(ask(sited.where(F.col("w") < least)), sited, cells, radius).groupBy("_k", F.col("au").alias("u"), F.col("av").alias("v")).agg(F.sum("n").alias("_around"))
    counted = keyed_join(sited.where(F.col("w") < least), around, site).withColumn("core", F.col("_around") >= least).drop("_around")
    marked = staged(sited.where(F.col("w") >= least).withColumn("core", F.lit(True)).unionByName(counted), "marked", scratch)

    core = marked.where("core")
    boxes = staged(keyed_join(_boxed(core, CELL), core.groupBy(*CELL).agg(F.min("first").alias("first")), CELL), "boxes", scratch)
    links = _links(core, boxes, side, radius, scratch)
    name = lambda p: F.struct(F.col("_k"), F.col(f"{p}x").alias("cx"), F.col(f"{p}y").alias("cy"))
    groups = connected_components(links.select(name("c").alias("left"), name("o").alias("right")))
    groups = groups.select(F.col("id._k").alias("_k"), F.col("id.cx").alias("cx"), F.col("id.cy").alias("cy"), "component")
    own = keyed_join(boxes.select(*CELL, "first", "m"), groups, CELL, "left").withColumn("component", F.coalesce("component", F.struct("_k", "cx", "cy")))
    own = staged(own, "groups", scratch)
    firsts = own.groupBy("_k", "component").agg(F.min("first").alias("first"))
    numbers = in_places(firsts, ["_k"], ["first", "component"], scratch, "cluster").drop("first")
    of_cell = staged(keyed_join(own, numbers, ["_k", "component"]).select(*CELL, "cluster", F.col("m").alias("_n")), "clusters", scratch)
    labelled = staged(to_each(core, of_cell, CELL), "core", scratch)

    others = marked.where("not core")
    borders = _near(ask(others), labelled, cells, radius).groupBy("_k", F.col("au").alias("u"), F.col("av").alias("v")).agg(F.min("cluster").alias("cluster"))
    others = staged(keyed_join(others, borders, site, "left"), "others", scratch)
    clustered = staged(labelled.select(*site, "n", "first", "cluster").unionByName(others.where("cluster is not null").select(*site, "n", "first", "cluster")), "clustered", scratch)
    noise = others.where("cluster is null").select(*site, "n")
    nearest = _nearest(noise, clustered, side, scratch)
    told = clustered.select(*site, "n", "cluster").unionByName(keyed_join(noise, nearest, site, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long"))))
    told = staged(told.select("_k", F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("n").alias("_n"), "cluster"), "told", scratch)
    return to_each(placed, told, ["_k", "_u", "_v"]).select(*df.columns, "cluster")


def _links(core: DataFrame, boxes: DataFrame, side: float, radius: float, scratch: list[str]) -> DataFrame:
    """_k, cx, cy, ox, oy: pairs of cells with core sites within the radius of each other.

    The cells' boxes decide where all or none of their sites are; a cell of up to FEW sites asks
    those of the other one by one; what is left is cut in halves both ways, until boxes decide."""
    reach = radius * radius
    steps = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]
    to = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("ox"), (F.col("cy") + j).alias("oy")) for i, j in steps]))
    mine = boxes.select(*CELL, *[F.col(c).alias(f"a{c}") for c in ("lu", "hu", "lv", "hv", "m")], to.alias("_to")).select("*", "_to.*").drop("_to")
    theirs = boxes.select("_k", F.col("cx").alias("ox"), F.col("cy").alias("oy"), "lu", "hu", "lv", "hv", "m")
    pair = [*CELL, "ox", "oy"]
    met = keyed_join(mine, theirs, ["_k", "ox", "oy"]).withColumns({"_least": _least(_box("a"), _box()), "_most": _most(_box("a"), _box())})
    met = staged(met.where(F.col("_least") <= reach).select(*pair, "am", "m", "_most"), "pairs", scratch)
    sure, open_ = met.where(F.col("_most") <= reach).select(*pair), met.where(F.col("_most") > reach)

    few = open_.where(F.least("am", "m") <= FEW)
    flipped = F.col("am") > F.col("m")
    asks = few.select(*pair, F.when(flipped, F.col("ox")).otherwise(F.col("cx")).alias("fx"), F.when(flipped, F.col("oy")).otherwise(F.col("cy")).alias("fy"),
                      F.when(flipped, F.col("cx")).otherwise(F.col("ox")).alias("tx"), F.when(flipped, F.col("cy")).otherwise(F.col("oy")).alias("ty"), F.ceil(F.greatest("am", "m") / SLICE).alias("_slices"))
    from_ = core.select("_k", F.col("cx").alias("fx"), F.col("cy").alias("fy"), F.col("u").alias("au"), F.col("v").alias("av"))
    asked = keyed_join(asks, from_, ["_k", "fx", "fy"]).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)))
    sizes = boxes.select(*CELL, F.col("m").alias("_m"), F.col("m").alias("_n"))
    sliced = to_each(core, staged(sizes, "sizes", scratch), CELL).withColumn("_slice", F.pmod(F.xxhash64("u", "v"), F.ceil(F.col("_m") / SLICE)))
    sliced = sliced.select("_k", F.col("cx").alias("tx"), F.col("cy").alias("ty"), "_slice", "u", "v")
    found = keyed_join(sliced, asked, ["_k", "tx", "ty", "_slice"]).where(_square(F.col("au") - F.col("u"), F.col("av") - F.col("v")) <= reach).select(*pair).distinct()
    links = sure.unionByName(found)

    many = open_.where(F.least("am", "m") > FEW).select(*pair)
    if many.isEmpty():
        return links
    cell = lambda x, y: F.struct(F.col(x).alias("nx"), F.col(y).alias("ny"))
    left = staged(many.select(*pair, cell("cx", "cy").alias("a"), cell("ox", "oy").alias("b")), "open", scratch)
    wanted = many.select(*CELL).union(many.select("_k", "ox", "oy")).distinct()
    inside = staged(keyed_join(core, wanted, CELL, "left_semi").select(*CELL, "u", "v"), "inside", scratch)
    level = 0
    while not left.isEmpty():
        level += 1
        node = [F.floor(F.col(c) / F.lit(side * 2.0**-level)).alias(n) for c, n in (("u", "nx"), ("v", "ny"))]
        parts = _boxed(inside.select("_k", "u", "v", *node), ["_k", "nx", "ny"])
        parts = staged(parts.select("_k", F.struct("nx", "ny").alias("node"), F.struct(F.shiftright("nx", 1).alias("nx"), F.shiftright("ny", 1).alias("ny")).alias("up"), "lu", "hu", "lv", "hv"), "parts", scratch)
        both = left.select(*pair, F.col("a").alias("ua"), F.col("b").alias("up"))
        one = keyed_join(both, parts, ["_k", "up"]).drop("up").withColumnsRenamed({"node": "b", "lu": "blu", "hu": "bhu", "lv": "blv", "hv": "bhv", "ua": "up"})
        two = keyed_join(one, parts, ["_k", "up"]).withColumnRenamed("node", "a")
        judged = two.withColumns({"_least": _least(_box(), _box("b")), "_most": _most(_box(), _box("b"))}).where(F.col("_least") <= reach)
        judged = staged(judged.select(*pair, "a", "b", "_most"), "judged", scratch)
        linked = staged(judged.where(F.col("_most") <= reach).select(*pair).distinct(), "linked", scratch)
        links = links.unionByName(linked)
        left = staged(keyed_join(judged.drop("_most"), linked, pair, "left_anti"), "open", scratch)
    return links


def _nearest(asks: DataFrame, sites: DataFrame, side: float, scratch: list[str]) -> DataFrame:
    """_k, u, v, cluster of the nearest of ``sites`` (_k, u, v, first, cluster) to each of ``asks``.

    Sites are in boxes of halving size. Each ask goes down from the largest, keeping of the boxes
    below those it keeps the ones that may hold the nearest: none is nearer, at its nearest, than
    another one is at its farthest. Boxes of up to FEW sites are compared site by site.
    """
    span = sites.agg(F.max(F.greatest(F.abs("u"), F.abs("v")))).first()[0]
    if span is None or asks.isEmpty():
        return asks.select("_k", "u", "v", F.lit(None).cast("long").alias("cluster")).limit(0)
    at = lambda level: F.struct(*[F.floor(F.col(c) / F.lit(side * 2.0**-level)).alias(n) for c, n in (("u", "x"), ("v", "y"))])
    level = -max(0, int(np.ceil(np.log2(span / side + 1))))  # one box a quarter of the plane
    kept = asks.select("_k", F.col("u").alias("au"), F.col("v").alias("av"))
    boxes = _boxed(sites.select("_k", "u", "v", at(level).alias("node")), ["_k", "node"])
    first = True
    while True:
        boxes = staged(boxes, "boxes", scratch)
        boxes = broadcast_if_small(boxes, boxes.count(), 100_000)
        met = keyed_join(kept, boxes, ["_k"] if first else ["_k", "up"]).withColumns({"_least": _least(_point("a"), _box()), "_most": _most(_point("a"), _box())})
        bound = F.min("_most").over(Window.partitionBy("_k", "au", "av"))
        kept = staged(met.withColumn("_bound", bound).where(F.col("_least") <= F.col("_bound")).select("_k", "au", "av", F.col("node").alias("up"), "m"), "kept", scratch)
        if kept.agg(F.max("m")).first()[0] <= FEW:
            break
        first, kept, level = False, kept.drop("m"), level + 2
        up = F.struct(F.shiftright("node.x", 2).alias("x"), F.shiftright("node.y", 2).alias("y"))
        boxes = _boxed(sites.select("_k", "u", "v", at(level).alias("node")), ["_k", "node"]).withColumn("up", up)
    near = sites.select("_k", "u", "v", "first", "cluster", at(level).alias("up"))
    met = keyed_join(kept.drop("m"), near, ["_k", "up"]).withColumn("_d", _square(F.col("au") - F.col("u"), F.col("av") - F.col("v")))
    return met.groupBy("_k", F.col("au").alias("u"), F.col("av").alias("v")).agg(F.min_by("cluster", F.struct("_d", "first")).alias("cluster"))
