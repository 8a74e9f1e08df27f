"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two random permutations of 2**20 places make the whole signature: the first scatters a
shingle to a place, and coordinate k is the least value of the second permutation, shifted
by k, over those places. The shifted values of one shingle lie side by side, so a shingle's
share in all coordinates is one contiguous read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import Memo, claim, slices
from tidemark.operators.components import connected_components
from tidemark.plans.staging import broadcast_if_small, drop, scoped, staged

PLACES = 1 << 20
#: Bands and rows: a pair of similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 32, 5
SHINGLE_WORDS = 5
PERCENT = 80
#: Words whose hashes one Python worker remembers.
CACHE_WORDS = 400_000

_word_hashes = Memo(xxhash.xxh64_intdigest, CACHE_WORDS)


def shingles(text: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words make one shingle."""
    found = text.lower().split() if text else []
    _word_hashes.age()
    h = np.fromiter(map(_word_hashes.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    span = min(words, len(h))
    prime, out = np.uint64(0x9E3779B97F4A7C15), np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        out *= prime
        out += h[k : len(h) - span + 1 + k]
    return np.unique(out)


@lru_cache(maxsize=2)
def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and for each place the second one's next values as one item."""
    random = np.random.default_rng(20_240_229)
    scatter, ranks = (random.permutation(PLACES).astype(np.int32) for _ in range(2))
    ring = np.concatenate([ranks, ranks[:coordinates]])
    return scatter, np.ndarray((PLACES,), f"V{4 * coordinates}", ring, strides=(4,))


def circulant_signature(hashes: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    scatter, shifted = _permutations(coordinates)
    at = scatter[hashes >> np.uint64(44)]
    least = np.full(coordinates, PLACES, np.int32)
    for i in range(0, len(at), 256):
        least = np.minimum(least, shifted[at[i : i + 256]].view(np.int32).reshape(-1, coordinates).min(axis=0))
    return least


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit hash a band, with the band's number in it."""
    x = np.arange(1, bands + 1, dtype=np.uint64)
    for column in signature.astype(np.uint64).reshape(bands, rows).T:
        x = (x ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return x.view(np.int64)


def _sign(words: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for batch in slices(batches):
            ids, sizes, names, out = batch.column(0), [], [], []
            for text in batch.column(1).cast(pa.binary()):
                h = shingles(text.as_py(), words)
                sizes.append(len(h))
                names.append(xxhash.xxh128_digest(h.tobytes()) if len(h) else None)
                out.append(band_hashes(circulant_signature(h, bands * rows), bands, rows) if len(h) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "name", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary())
            for i in range(0, len(texts), 500):
                out = [shingles(t.as_py(), words).view(np.int64) for t in texts[i : i + 500]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 500], pa.array(out, pa.list_(pa.int64()))], names=["id", "items"])

    return run


def _linked(a: Column, b: Column, percent: int) -> Column:
    """Whether two sets reach the similarity; by their sizes alone first."""
    na, nb, both = F.size(a), F.size(b), F.size(F.array_intersect(a, b))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * both >= percent * (na + nb - both))


def _by_prefixes(sets: DataFrame, percent: int, scratch: list[str]) -> DataFrame:
    """Pairs (left < right) among which are all pairs of ``sets`` (id, component, items) that
    reach the similarity and lie in different components.

    With items in one order, rarest first, sets that are similar share one among their first
    ``100 - percent`` in a hundred, and behind the first that they share enough of both is left
    to make up the overlap. Items of one set only take the first places and are never joined.
    """
    items = sets.select("id", "component", F.size("items").alias("n"), F.explode("items").alias("item"))
    common = items.groupBy("item").agg(F.count("*").alias("sets")).where("sets > 1")
    own = Window.partitionBy("id")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("sets", "item")) - 1
    heads = items.join(common, "item").withColumn("place", place).where(F.col("place") * 100 <= (100 - percent) * F.col("n"))
    heads = staged(heads.select("id", "component", "n", "item", "place"), "heads", scratch)
    a, b = heads.alias("a"), heads.alias("b")
    enough = F.expr(f"""a.item = b.item and a.id < b.id and a.component <> b.component
        and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
        and {100 + percent} * least(a.n - a.place, b.n - b.place) >= {percent} * (a.n + b.n)""")
    return a.join(b, enough).select(F.col("a.id").alias("left"), F.col("b.id").alias("right")).distinct()


def near_duplicates(documents: DataFrame, percent: int = PERCENT, words: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents`` (doc_id, text).

    Documents are linked where ``100 * intersection >= percent * union`` of their sets of word
    shingles. component_id is the smallest doc_id reachable over links, kept tells whether it
    is the row's own. Exact copies of a set share one representative. In each bucket of each
    band the representatives are compared to the one in their middle, which links most of any
    group. Where a bucket still holds several components, all its sets go on to an exact join
    by rare shingles, which leaves only pairs of different components that can be similar.
    Pairs inside a component need no comparison. All comparisons are of full sets.

    A null, empty or wordless text has no shingles and is a component of its own. Rows that
    repeat a doc_id are one node. A null doc_id is linked with nothing, its component_id is
    null and it is kept. ``documents`` is read twice and other columns are not read.
    """
    scratch: list[str] = []
    rows_in = documents.select(F.col("doc_id").cast("long"), "text")
    signed = staged(rows_in.mapInArrow(_sign(words, bands, rows), "doc_id long, n_shingles long, name binary, bands array<long>"), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    sets = staged(usable.groupBy("name").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "sets")
    in_bucket = sets.select(F.explode("bands").alias("bucket"), "id")
    shared = in_bucket.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(in_bucket.join(shared, "bucket"), "buckets", scratch)
    # The middle of a group shares the most buckets with the rest of it.
    middle = members.groupBy("id").agg(F.sum("n").alias("weight"))
    first = members.join(middle, "id").groupBy("bucket").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("first"))

    involved = staged(members.select("id").distinct(), "involved", scratch)
    texts = rows_in.join(broadcast_if_small(involved, involved.count()), rows_in["doc_id"] == involved["id"], "left_semi")
    items = staged(texts.mapInArrow(_sets(words), "id long, items array<long>"), "items", scratch)

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (items.select(F.col("id").alias(c), F.col("items").alias(f"{c}_items")) for c in ("left", "right"))
        full = pairs.join(b, "right").join(a, "left")
        return staged(full.select("left", "right", _linked(F.col("left_items"), F.col("right_items"), percent).alias("linked")), "verified", scratch)

    stars = members.join(first, "bucket").where("id <> first").select(F.least("first", "id").alias("left"), F.greatest("first", "id").alias("right"))
    known = verified(stars.distinct())
    component = connected_components(known.where("linked"))
    labelled = members.select("bucket", "id").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_ = staged(labelled.join(split, "bucket").select("id", "component").distinct(), "open", scratch)
    if not open_.isEmpty():
        more = _by_prefixes(items.join(open_, "id"), percent, scratch).join(known, ["left", "right"], "left_anti")
        known = known.unionByName(verified(more))
        component = connected_components(known.where("linked"))

    drop(documents.sparkSession, scratch)  # what follows reads the signatures, sets and components
    groups = sets.select("name", F.col("id").alias("set_id"))
    named = signed.select("doc_id", "n_shingles", F.expr("if(doc_id is null, null, name)").alias("name")).join(groups, "name", "left")
    labelled = named.join(component.select(F.col("id").alias("set_id"), "component"), "set_id", "left")
    return labelled.select("doc_id", "n_shingles", F.coalesce("component", "set_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with one document of each component of :func:`near_duplicates`, the one
    with the smallest doc_id. Rows without a doc_id stay."""
    with scoped(documents.sparkSession):  # only the ids that go outlive it
        dropped = staged(near_duplicates(documents, **options).where("not kept").select("doc_id").distinct(), "dropped", [])
    return documents.join(broadcast_if_small(dropped, dropped.count()), "doc_id", "left_anti").select(documents.columns)
