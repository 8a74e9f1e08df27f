"""Product codes of vectors in whole numbers, with assignments that are exact.

A component x becomes floor(256 * x); vectors are cut into equal parts, and each part is written as
the index of the nearest entry of its position's codebook. Nearest entries are screened by a
float32 matrix product, whose error is bounded; what the bound leaves open is compared in whole
numbers, so codes do not depend on the order in which a machine adds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import drop, staged

#: Rows that are screened together.
ROWS = 2048
#: Half a unit in the last place of float32, relative.
UNIT = 2.0**-24
#: Share of the rows over which a label's sum is sent to all tasks; so there are under 1000 of them.
HOT_SHARE = 0.001


class Codebooks(NamedTuple):
    """entries: whole numbers by part, entry and position within the part; length: of a vector."""

    entries: np.ndarray
    length: int

    def digest(self) -> str:
        """sha256 of all components in order, as decimal numbers with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null or empty and holds finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False)))


def largest(width: int) -> int:
    """The size that whole components are held within, so that a distance over ``width`` of them is
    a long."""
    return math.isqrt((2**63 - 1) // max(1, width)) // 2


def whole(vectors: np.ndarray, parts: int) -> np.ndarray:
    """floor(256 * x) of a matrix of vectors, as (row, part, position); the last parts are filled up
    with zeros where the length is no multiple of ``parts``."""
    width = -(-vectors.shape[1] // parts)
    most = largest(width)
    with np.errstate(over="ignore"):
        floors = np.clip(np.floor(256 * vectors.astype(np.float64)), -most, most).astype(np.int64)
    out = np.zeros((len(vectors), parts * width), np.int64)
    out[:, : vectors.shape[1]] = floors
    return out.reshape(len(vectors), parts, width)


def _screen(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Whether each entry may be the nearest of each row, by |e|^2 - 2 x.e in float32.

    With u = UNIT and d positions, each product x_i * e_i and its sums are off by at most d + 2 units
    of sum |x_i e_i| <= |x| |e| in any order of adding, the rounding of x and e included; |e|^2 and
    the difference add two units of |e|^2 + 2 |x| |e|. A row's radius takes d + 8 units of the
    largest of these over its entries; an entry is open if its interval meets that of the least value.
    """
    squares = (entries.astype(np.float64) ** 2).sum(axis=1)
    top = math.sqrt(squares.max())
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    value = x.astype(np.float32) @ (-2 * entries).astype(np.float32).T
    value += squares.astype(np.float32)
    radius = (x.shape[1] + 8) * UNIT * (2 * norms * top + top * top) * (1 + 1e-6)
    reach = value.min(axis=1).astype(np.float64) + 2 * radius
    return value <= np.nextafter(reach.astype(np.float32), np.float32(np.inf))[:, None]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, the lower index of equally near
    ones: all entries that the screen leaves open are measured in whole numbers."""
    open_ = _screen(x, entries)
    row, entry = np.divmod(np.flatnonzero(open_), len(entries))
    exact = ((x[row] - entries[entry]) ** 2).sum(axis=1)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    least = np.minimum.reduceat(exact, first)
    best = np.flatnonzero(exact == least[row])  # by row, then by index
    winner = best[np.flatnonzero(np.append(True, row[best][1:] != row[best][:-1]))]
    return entry[winner], exact[winner]


def _blocks(batches: Iterable[pa.RecordBatch], length: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches of usable vectors with their whole numbers."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            piece = batch.slice(start, ROWS)
            flat = piece.column(piece.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            yield piece, whole(flat.reshape(-1, length), parts)


def _tallies(books: Codebooks):
    """What one task adds to each entry: part, entry, position, total, n."""
    parts, k, width = books.entries.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for _, x in _blocks(batches, books.length, parts):
            for p in range(parts):
                at, _ = nearest(x[:, p], books.entries[p])
                counts[p] += np.bincount(at, minlength=k)
                for i in range(width):  # whole numbers of up to 2^53 in a block are exact in doubles
                    totals[p, :, i] += np.bincount(at, x[:, p, i], minlength=k).astype(np.int64)
        part, entry, position = np.nonzero(np.broadcast_to(counts[:, :, None] > 0, totals.shape))
        columns = part, entry, position, totals[part, entry, position], counts[part, entry]
        yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "position", "total", "n"])

    return run


def _first(kept: DataFrame, vec_id: str, vector: str, size: int) -> list:
    """The vectors of the ``size`` smallest rows by vec_id, then by vector; a null vec_id is last."""
    order = F.col(vec_id).asc_nulls_last(), F.col(vector)
    return [r[0] for r in kept.select(vector, vec_id).orderBy(*order).limit(size).collect()]


def fit_codebooks(kept: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 16, size: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks of ``usable`` vectors: they begin as the parts of the ``size`` smallest vec_ids; in
    each of ``rounds`` every part is given to its nearest entry, and an entry becomes the floored
    mean of its parts; entries without parts stay. None if there is no vector.

    The length of a vector is that of the smallest vec_id; others are left out. A round is one pass
    over the vectors, from which each task sends a sum for each component of an entry, whatever its
    number of rows; the driver gets one row for each of these, parts * size * width in all.
    """
    begin = _first(kept, vec_id, vector, size)
    if not begin:
        return None
    length = len(begin[0])
    same = kept.where(F.size(vector) == length)
    if any(len(v) != length for v in begin):
        begin = _first(same, vec_id, vector, size)
    books = Codebooks(np.ascontiguousarray(whole(np.array(begin, np.float64), parts).transpose(1, 0, 2)), length)
    for _ in range(rounds):
        told = same.select(vector).mapInArrow(_tallies(books), "part long, entry long, position long, total long, n long")
        told = told.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38, 0)")).alias("total"), F.sum("n").alias("n"))
        entries = books.entries.copy()
        for part, entry, position, total, n in told.collect():
            entries[part, entry, position] = int(total) // n
        books = Codebooks(entries, length)
    return books


def _coded(books: Codebooks, others: int):
    parts = len(books.entries)
    digits = 2 * parts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _blocks(batches, books.length, parts):
            codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                at, distance = nearest(x[:, p], books.entries[p])
                codes[:, p] = at
                error = np.where(error > 2**63 - 1 - distance, 2**63 - 1, error + distance)
            said = codes.tobytes().hex()
            code = pa.array([said[i : i + digits] for i in range(0, len(said), digits)], pa.string())
            yield pa.record_batch([*piece.columns[:others], code, pa.array(error)], [*piece.schema.names[:others], "code", "error"])

    return run


def encode(vectors: DataFrame, books: Codebooks, keep: list[str], vector: str = "embedding") -> DataFrame:
    """``keep``, code (two hex digits a part, in order) and error (squared distances from the entries,
    summed over the parts, at most 2^63 - 1) of ``usable`` vectors of the codebooks' length."""
    same = vectors.where(F.size(vector) == books.length).select(*keep, vector)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in same.schema.fields[:-1])
    return same.mapInArrow(_coded(books, len(keep)), f"{schema}, code string, error long")


def decode(codes: Column | str, books: Codebooks) -> Column:
    """The vectors that codes stand for, as doubles: entries divided by 256; null for a null code."""
    table = F.array(*[F.array(*[F.lit(e.tolist()) for e in part]) for part in books.entries])
    code = F.col(codes) if isinstance(codes, str) else codes
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    flat = F.flatten(F.array(*[F.get(F.get(table, F.lit(p)), at(p)) for p in range(len(books.entries))]))
    return F.when(code.isNotNull(), F.transform(F.slice(flat, 1, books.length), lambda x: x / F.lit(256.0)))


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with label_error: error summed over the rows of an equal label, nulls together.

    Sums go to their rows by a join; a label with over HOT_SHARE of all rows is not dealt to one
    task, but its sum, of which there are under a thousand, is sent to all.
    """
    key = F.struct(F.col(label).alias("label")).alias("_label")
    sums = staged(coded.groupBy(label).agg(F.sum(F.col("error").cast("decimal(38, 0)")).alias("_sum"), F.count("*").alias("_n")).select(key, F.least("_sum", F.lit(2**63 - 1).cast("decimal(38, 0)")).cast("long").alias("label_error"), "_n"), "labels", scratch := [])
    rows = sums.agg(F.sum("_n")).first()[0] or 0
    hot, rest = (sums.where(F.col("_n") > rows * HOT_SHARE), sums.where(F.col("_n") <= rows * HOT_SHARE))
    keyed = coded.select("*", key)
    found = keyed.join(F.broadcast(hot.drop("_n")), "_label", "left")
    done, open_ = found.where("label_error is not null"), found.where("label_error is null").drop("label_error")
    if not rest.isEmpty():
        done = done.unionByName(open_.join(rest.drop("_n"), "_label"))
    out = staged(done.drop("_label"), "label_errors")
    drop(coded.sparkSession, scratch)
    return out


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, size: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector of ``vectors``.

    Vectors that are null or empty, or hold a null or a component that is not finite, are left out,
    and so are those of another length than the smallest vec_id's. Components whose floor(256 * x)
    is over :func:`largest` in size (759,250,124 with four positions a part) count as that; sums of
    error over 2^63 - 1 as that. Repeated rows are rows of their own; a null vec_id comes after
    all others; fewer than ``size`` vectors make smaller codebooks; none give an empty table.
    Other columns play no part. ``size`` is at most 256, as an index has two digits.
    """
    if not 0 < size <= 256:
        raise ValueError("size is from 1 to 256")
    plain = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kept = usable(plain, "vector")
    books = fit_codebooks(kept, "vec_id", "vector", parts, size, rounds)
    if books is None:
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]).limit(0)
    coded = staged(encode(kept, books, ["vec_id", "label"], "vector"), "codes", scratch := [])
    out = with_label_error(coded, "label").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
    drop(vectors.sparkSession, scratch)
    return out
