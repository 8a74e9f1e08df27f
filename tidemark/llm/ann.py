"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Each of TABLES tables hashes a vector with HASHES functions ``floor((a.x + b) / WIDTH)``, ``a``
drawn from the 2-stable normal distribution. Vectors are first scaled by the largest norm and
given one more component that makes all norms equal, so that the nearest by distance are the
nearest by inner product. A query visits its own bucket and then buckets a step away in some
hashes, in the order of their expected distance, nearest borders first.

Every row is hashed once and goes to its bucket in each table; queries go only where a bucket
that they visit exists. Buckets are dealt to parts of bounded size, and those with more rows
are salted. A part ranks the rows of the visited buckets by the exact product of the
original vectors, and the best of all parts and tables are merged. Queries for which the
buckets held too few rows meet all rows, in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import broadcast_if_small, drop, staged

HASHES, WIDTH, TABLES, PROBES = 10, 3.0, 4, 200
NEAREST = 20
#: Vectors of a part or block, about, on the side of the rows and on that of the queries: 32 MB of
#: 64 double components. The fewer parts a query meets, the fewer lists of its best are merged;
#: it meets no more parts than buckets that it visits, whatever the number of rows.
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 16_384
#: Products held at once by a task.
PRODUCTS = 4_000_000


@lru_cache(maxsize=4)
def probe_sequence(hashes: int, probes: int) -> np.ndarray:
    """The first ``probes`` perturbations, a row each, as 0/1 over the 2 * hashes borders of a
    cell sorted by distance; in the order of the expected sum of squared distances. Row 0 is
    the query's own bucket. No row crosses both borders of one hash."""
    k, j = hashes, np.arange(1, 2 * hashes + 1)
    unit = 4 * (k + 1) * (k + 2)
    far = 2 * k + 1 - j
    cost = np.where(j <= k, j * (j + 1) / unit, 1 - far / (k + 1) + far * (far + 1) / unit)
    chosen, heap = [()], [(cost[0], (0,))]
    while heap and len(chosen) < probes:
        total, borders = heapq.heappop(heap)
        if len({min(b, 2 * k - 1 - b) for b in borders}) == len(borders):
            chosen.append(borders)
        last = borders[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*borders[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*borders, last + 1)))
    rows = np.zeros((len(chosen), 2 * k), np.int64)
    for r, borders in enumerate(chosen):
        rows[r, list(borders)] = 1
    return rows


@lru_cache(maxsize=16)
def _functions(dims: int, table: int, hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, offsets and the weights that make one number of a table's hashes."""
    random = np.random.default_rng([11, dims, table])
    return random.standard_normal((dims + 1, hashes)), random.random(hashes), random.integers(1, 1 << 62, hashes) | 1


def row_buckets(rows: np.ndarray, largest: float, hashes: int = HASHES, width: float = WIDTH, tables: int = TABLES) -> np.ndarray:
    """The bucket of each row in each table."""
    x, out = rows / largest, np.empty((len(rows), tables), np.int64)
    x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]])
    for t in range(tables):
        a, b, weight = _functions(rows.shape[1], t, hashes)
        out[:, t] = (np.floor(x @ a / width + b).astype(np.int64) * weight).sum(axis=1)
    return out


def visited_buckets(queries: np.ndarray, hashes: int = HASHES, width: float = WIDTH, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """The buckets that each query visits: by table, then in order."""
    q = np.hstack([queries / np.sqrt((queries * queries).sum(axis=1))[:, None], np.zeros((len(queries), 1))])
    steps, sign, out = probe_sequence(hashes, probes), np.repeat([-1, 1], hashes), []
    for t in range(tables):
        a, b, weight = _functions(queries.shape[1], t, hashes)
        at = q @ a / width + b
        cell = np.floor(at).astype(np.int64)
        border = np.argsort(np.hstack([at - cell, 1 - at + cell]), axis=1)
        out.append((cell * weight).sum(axis=1)[:, None] + (sign * np.tile(weight, 2))[border] @ steps.T)
    return np.hstack(out)


def _hash(queries: bool, options: dict):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby("dims"):
                x = np.stack(same["v"].to_numpy()).astype(np.float64)
                found = visited_buckets(x, **options) if queries else row_buckets(x, same["largest"].iloc[0], **options)
                yield same.drop(columns="largest").assign(buckets=list(found))

    return run


def _top(scores: np.ndarray, at: np.ndarray, rows: np.ndarray, ids: np.ndarray, query: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and exact products of the best of the rows ``at``, of which ``scores`` are the products
    up to rounding; ties to the smaller id."""
    if len(at) > nearest:  # rounding may not part equal vectors: keep all near the last place
        at = at[scores >= np.partition(scores, -nearest)[-nearest] - 1e-9 * (1 + np.abs(scores).max())]
    exact = (rows[at] * query).sum(axis=1)
    top = np.lexsort((ids[at], -exact))[:nearest]
    return ids[at[top]], exact[top]


def _frame(out: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "query_id": np.repeat(np.array([q for q, _, _ in out], np.int64), [len(i) for _, i, _ in out]),
            "vec_id": np.concatenate([np.empty(0, np.int64), *[i for _, i, _ in out]]),
            "score": np.concatenate([np.empty(0), *[s for _, _, s in out]]),
        }
    )


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["v"].to_numpy()).astype(np.float64)


def _search_part(nearest: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("bucket", kind="stable")
            rows, ids, asked = _vectors(right), right["vec_id"].to_numpy(), left["query_id"].to_numpy()
            keys, begins = np.unique(right["bucket"].to_numpy(), return_index=True)
            sizes = np.diff(np.append(begins, len(rows)))
            queries, visits = _vectors(left), left["buckets"].to_numpy()
            step = max(1, PRODUCTS // len(rows))
            for start in range(0, len(queries), step):
                part = queries[start : start + step]
                mine = [np.flatnonzero(np.isin(keys, v)) for v in visits[start : start + step]]
                # With much of the part to look at, one product of all is cheaper than picking rows.
                whole = 8 * sum(sizes[v].sum() for v in mine) > len(part) * len(rows)
                products = part @ rows.T if whole else None
                for k, (query, v) in enumerate(zip(part, mine, strict=True)):
                    size = sizes[v]
                    at = np.repeat(begins[v] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    at = at[ids[at] != asked[start + k]]
                    if len(at):
                        out.append((asked[start + k], *_top(products[k, at] if whole else rows[at] @ query, at, rows, ids, query, nearest)))
        return _frame(out)

    return run


def _search_block(nearest: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            queries, rows, ids, asked = _vectors(left), _vectors(right), right["vec_id"].to_numpy(), left["query_id"].to_numpy()
            step = max(1, PRODUCTS // len(rows))
            for start in range(0, len(queries), step):
                products = queries[start : start + step] @ rows.T
                for k, query in enumerate(queries[start : start + step]):
                    at = np.flatnonzero(ids != asked[start + k])
                    if len(at):
                        out.append((asked[start + k], *_top(products[k, at], at, rows, ids, query, nearest)))
        return _frame(out)

    return run


FOUND = "query_id long, vec_id long, score double"


def _ranked(found: DataFrame, nearest: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    once = found.repartition("query_id").dropDuplicates()
    return once.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))


def in_blocks(rows: DataFrame, asked: DataFrame, nearest: int, block_rows: int, block_queries: int) -> DataFrame:
    """The exact neighbours: every block of queries meets every block of rows."""
    parts, query_parts = (max(1, -(-df.count() // most)) for df, most in ((rows, block_rows), (asked, block_queries)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    left = asked.select(F.col("vec_id").alias("query_id"), "v", "dims", dealt(query_parts).alias("query_block"), _every(F.lit(parts)).alias("block"))
    right = rows.select("vec_id", "v", "dims", dealt(parts).alias("block"), _every(F.lit(query_parts)).alias("query_block"))
    keys = ["dims", "query_block", "block"]
    # A stated number of partitions: small blocks of much work are not to be merged by their bytes.
    left, right = (side.repartition(2 * parts * query_parts, *keys) for side in (left, right))
    return _ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search_block(nearest), FOUND), nearest)


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, hashes: int = HASHES, width: float = WIDTH, tables: int = TABLES, probes: int = PROBES
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (inner product in double precision) of the
    ``nearest`` rows of ``vectors`` (vec_id, embedding) found for each of ``queries`` (the same
    columns), never those of the query's own vec_id; ties to the smaller vec_id.

    Vectors that are null, empty or zero, or hold a null or non-finite component, and rows
    without vec_id take no part; vectors meet only those of their own length. Equal rows count
    once; other columns are not read. A query whose buckets hold fewer than ``nearest`` rows is
    compared with all rows, so it gets all candidates if there are no more. Empty tables give
    no rows.
    """
    spark, scratch = vectors.sparkSession, []

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.where(F.col("vec_id").isNotNull() & v.isNotNull() & ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.size("embedding").alias("dims")).dropDuplicates()

    rows, asked = usable(vectors), usable(queries)
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    norms = staged(rows.groupBy("dims").agg(F.max(norm).alias("largest"), F.count("*").alias("n")), "norms", scratch)
    total = norms.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    parts = max(1, -(-(total["n"] or 0) // block_rows))
    options = {"hashes": hashes, "width": width, "tables": tables}
    schema = f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, dims int, buckets array<long>"
    scaled = rows.join(broadcast_if_small(norms.drop("n"), total["kinds"]), "dims").select("vec_id", "v", "dims", "largest")
    hashed = staged(scaled.mapInPandas(_hash(False, options), schema), "hashed", scratch)
    bucket = ["dims", "table", "bucket"]
    sizes = hashed.select("dims", F.posexplode("buckets").alias("table", "bucket")).groupBy(*bucket).agg(F.ceil(F.count("*") / block_rows).alias("salts"))
    sizes = staged(sizes, "buckets", scratch)
    hot = sizes.where("salts > 1")
    part = F.pmod(F.xxhash64("bucket", "salt"), F.lit(parts)).cast("int").alias("part")
    salted = F.pmod(F.xxhash64("vec_id", "v"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    homes = hashed.select("vec_id", "v", "dims", F.posexplode("buckets").alias("table", "bucket")).join(broadcast_if_small(hot, hot.count()), bucket, "left")
    homes = homes.select("vec_id", "v", "dims", "table", "bucket", salted).withColumn("part", part)

    seeking = staged(asked.withColumn("largest", F.lit(1.0)).mapInPandas(_hash(True, options | {"probes": probes}), schema), "seeking", scratch)
    who = [F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("which"), "dims"]
    visits = seeking.select(*who, F.posexplode("buckets").alias("place", "bucket")).withColumn("table", F.floor(F.col("place") / probes).cast("int"))
    visits = visits.join(broadcast_if_small(sizes, sizes.count()), bucket).withColumn("salt", _every(F.col("salts")))
    group = ["dims", "table", "part"]
    visits = staged(visits.withColumn("part", part).groupBy(*group, "query_id", "which").agg(F.collect_set("bucket").alias("buckets")), "visits", scratch)
    # Where many queries meet in a part, it is copied and each copy takes a share of them.
    loads = staged(visits.groupBy(*group).agg(F.ceil(F.count("*") / block_queries).alias("copies")), "loads", scratch)
    loads = broadcast_if_small(loads, loads.count())
    left = visits.join(loads, group).withColumn("copy", F.pmod(F.xxhash64("query_id", "which"), F.col("copies")).cast("int")).join(seeking.select(*who, "v"), ["query_id", "which", "dims"])
    right = homes.join(loads, group).withColumn("copy", _every(F.col("copies"))).select("vec_id", "v", "bucket", *group, "copy")
    keys = [*group, "copy"]
    left, right = (side.repartition(2 * parts * tables, *keys) for side in (left.select("query_id", "v", "buckets", *keys), right))
    merged = staged(_ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search_part(nearest), FOUND), nearest), "neighbours")
    drop(spark, scratch)
    enough = merged.where(F.col("rank") == nearest).select("query_id")
    few = asked.join(enough, asked["vec_id"] == enough["query_id"], "left_anti")
    if few.isEmpty():
        return merged
    return merged.join(enough, "query_id", "left_semi").unionByName(in_blocks(rows, few, nearest, block_rows, block_queries))
