"""Best-fit packing of token sequences by minimum bin slack.

Only the number of pieces of each length matters to a packing, and there are at most
``capacity`` lengths. That histogram is all the packing itself works on: for each bin, with
the longest piece left fixed, a subset-sum dynamic programme over bitsets finds the fullest
combination of what is left. A combination is repeated while its lengths last, so the number
of programmes run depends on the lengths, not on the rows. Spark then deals the pieces of
each length to the places planned for that length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import CACHE_CHUNKS, codec, slices, vocabulary_path
from tidemark.plans.staging import staged

CAPACITY = 4096
#: Pieces of one length ranked by one task, about.
RANKED_ROWS = 200_000


def fullest(room: int, available: list[tuple[int, int]]) -> dict[int, int]:
    """How many of each length (descending (length, count)) fill ``room`` best.

    Bit s of ``reach`` tells that the sum s can be made; counts enter as powers of two.
    """
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length, count in available:
        if length > room:
            continue
        left, times = min(count, room // length), 1
        while left and not reach >> room & 1:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & mask
            left, times = left - times, times * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + times
            total -= length * times
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, each with the number of bins that use it, for all pieces."""
    left, bins = dict(sorted(((k, n) for k, n in histogram.items() if n > 0), reverse=True)), []
    if left and next(iter(left)) > capacity:
        raise ValueError("a piece is longer than the capacity")
    while left:
        seed = next(iter(left))
        rest = [(k, n - (k == seed)) for k, n in left.items() if n > (k == seed)]
        chosen = fullest(capacity - seed, rest)
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        bins.append((chosen, times))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return bins


def places(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from_rank, to_rank, each, first_bin, offset): pieces of that length with these
    ranks go, ``each`` to a bin, to bins from ``first_bin`` on, at ``offset``."""
    used: dict[int, int] = {}
    out, first = [], 0
    for chosen, times in bins:
        offset = 0
        for length, each in sorted(chosen.items(), reverse=True):
            rank = used.get(length, 0)
            used[length] = rank + each * times
            out.append((length, rank, used[length], each, first, offset))
            offset += each * length
        first += times
    return out


def _cut(vocabulary: str, end_id: int, capacity: int, cache_chunks: int, special_as_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = codec(vocabulary, cache_chunks, special_as_text).encode, int(end_id).to_bytes(4, "little")
        for batch in slices(batches):
            docs, pieces, starts, lengths, parts = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    docs.append(doc)
                    pieces.append(piece)
                    starts.append(at // 4)
                    parts.append(ids[at : at + 4 * capacity])
                    lengths.append(len(parts[-1]) // 4)
                if len(parts) >= 1000:
                    yield _batch(docs, pieces, starts, lengths, parts)
                    docs, pieces, starts, lengths, parts = [], [], [], [], []
            if docs:
                yield _batch(docs, pieces, starts, lengths, parts)

    return run


def _batch(docs, pieces, starts, lengths, parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])


def token_pieces(documents: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = CAPACITY, cache_chunks: int = CACHE_CHUNKS, special_as_text: bool = False) -> DataFrame:
    """Each document's ids, closed by ``end_id`` and cut only where they exceed ``capacity``:
    doc_id, piece, start, length, ids (little-endian unsigned 32-bit integers).

    A null or empty text is the end id alone. Rows sharing a doc_id are documents of their own.
    A Python worker remembers ``cache_chunks`` words, about 200 bytes each. Literals of special
    tokens become their ids, or with ``special_as_text`` those of ordinary text.
    """
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(vocabulary, end_id, capacity, cache_chunks, special_as_text), "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length from 1 to ``capacity``, any others) with sequence_id
    and offset, gapless in each sequence; columns of these two names give way.

    Pieces of one length, also repeated ones, are dealt by a hash of doc_id and piece, then by
    doc_id and piece; a null doc_id is a value like others. ``pieces`` is read three times: give
    a stored table. The driver holds the histogram, at most ``capacity`` rows, and the plan made
    from it, a bounded number of rows for each length; both are independent of the number of
    pieces. Each length is ranked in salted parts, so that a length which many pieces share
    is never in one task. An empty table gives none.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = places(minimum_bin_slack(histogram, capacity))
    salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(histogram.values(), default=0) // RANKED_ROWS))
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    salted = pieces.select(F.struct(*kept).alias("row"), "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).alias("salt"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    in_part = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row.doc_id", "row.piece")) - 1
    placed = salted.withColumn("in_part", in_part).join(sizes.select("length", "salt", before.alias("before")), ["length", "salt"])
    ranked = placed.select("row", "length", (F.col("before") + F.col("in_part")).alias("rank"))
    slots = spark.createDataFrame(plan, "of long, since long, until long, each long, bin long, at long")
    nth = F.col("rank") - F.col("since")
    return ranked.join(F.broadcast(slots), F.expr("length = of and rank >= since and rank < until")).select(
        "row.*",
        (F.col("bin") + F.floor(nth / F.col("each")).cast("long")).alias("sequence_id"),
        (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"),
    )


def pack_documents(documents: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = CAPACITY, cache_chunks: int = CACHE_CHUNKS) -> DataFrame:
    """Pieces of all ``documents`` in sequences: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    The ids are written once to the shared folder; packing moves only their checksum. Use
    :func:`token_pieces`, ``staged`` and :func:`pack` to keep the ids themselves.
    """
    pieces = staged(token_pieces(documents, vocabulary, end_id, capacity, cache_chunks), "pieces")
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
