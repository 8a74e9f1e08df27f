"""Documents drawn in the likeness of a target: importance weights over hashed word runs.

A text's features are its runs of up to ``runs`` words; a feature's bucket is the CRC-32 of its
bytes modulo ``buckets``. One scan of a text keeps the running CRC states of its last starts, so no
feature is ever put together: a word begins a state of its own, and each state before it goes on by
a space and the word.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import sorted_places
from tidemark.plans.staging import drop, staged

#: Bytes to what they count as: digits, a-z and all bytes beyond ASCII as they are, A-Z as a-z, others as spaces.
FOLDED = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Documents whose buckets are held at once.
ROWS = 256


def words(text: bytes) -> list[bytes]:
    """A UTF-8 text's words, A-Z lower-cased."""
    return text.translate(FOLDED).split()


def states(said: list[bytes], runs: int) -> list[int]:
    """CRC-32 of each run of 1 to ``runs`` consecutive words joined by a space, by the run's last word,
    longer runs first: a ring of the states of the last starts, each extended by every word."""
    out: list[int] = []
    if runs == 2:  # the ring of one state, unrolled
        before = None
        for word in said:
            if before is not None:
                out.append(crc32(b" " + word, before))
            before = crc32(word)
            out.append(before)
        return out
    ring: deque[int] = deque(maxlen=max(0, runs - 1))
    for word in said:
        further = b" " + word
        ring = deque([crc32(further, state) for state in ring], runs)
        ring.append(crc32(word))
        out.extend(ring)
        if len(ring) == runs:
            ring.popleft()
    return out


def _scanned(runs: int, buckets: int, least: int):
    """The rows before ``text`` with n_features, enough (whether there are ``least`` words) and
    buckets, as unsigned 32-bit numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                texts = piece.column(piece.num_columns - 1).cast(pa.large_binary())
                n, enough, said = [], [], []
                for text in texts:
                    w = words(text.as_py() or b"")
                    found = (np.array(states(w, runs), np.uint32) % np.uint32(buckets)).astype("<u4")
                    n.append(len(found))
                    enough.append(len(w) >= least)
                    said.append(found.tobytes())
                arrays = [*piece.columns[:-1], pa.array(n, pa.int64()), pa.array(enough), pa.array(said, pa.binary())]
                yield pa.record_batch(arrays, [*piece.schema.names[:-1], "n_features", "enough", "buckets"])

    return run


def scanned(texts: DataFrame, keep: list[str], text: str = "text", runs: int = 2, buckets: int = 10_000, least: int = 20) -> DataFrame:
    """``keep``, n_features, enough (has at least ``least`` words) and buckets (of all features, in
    order, unsigned 32-bit little-endian) of whole texts; a null text has no words."""
    rows = texts.select(*keep, F.col(text).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_scanned(runs, buckets, least), f"{schema + ', ' if schema else ''}n_features long, enough boolean, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many features of ``scanned`` rows lie in each bucket. A task sends one number a bucket,
    whatever its rows; the driver gets ``buckets`` numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for said in batch.column(0):
                counts += np.bincount(np.frombuffer(said.as_py(), "<u4"), minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(likelihood in the target / in the raw texts)) of each bucket, one added to
    every count."""
    n, s, t = len(raw), float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((target[b] + 1.0) * s / ((raw[b] + 1.0) * t))) for b in range(n)], np.int64)


def luck(seed: int, doc_id: object) -> int:
    """A document's own draw from a Gumbel distribution in thousandths, floored."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, enough, said = batch.columns
            weights = [int(gain[np.frombuffer(b.as_py(), "<u4")].sum()) // k if k else 0 for b, k in zip(said, n.to_pylist(), strict=True)]
            scores = [w + luck(seed, "null" if i is None else i) for w, i in zip(weights, ids.to_pylist(), strict=True)]
            yield pa.record_batch([ids, n, pa.array(weights, pa.int64()), pa.array(scores, pa.int64()), enough], ["doc_id", "n_features", "weight", "score", "enough"])

    return run


def resampled(documents: DataFrame, target: DataFrame, percent: int = 25, runs: int = 2, buckets: int = 10_000, least: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``documents`` (doc_id, text): the
    floor(percent * N / 100) highest scores of the N documents with at least ``least`` words are
    drawn, which is a draw without replacement by importance weights. rank is 1, 2, 3... by falling
    score, ties to the smaller doc_id, and null for those not drawn.

    weight is the floored mean gain of a document's features (0 without any) and score adds the
    document's :func:`luck`, which depends on seed and doc_id alone, so the same documents are drawn
    whatever the order or partitioning. A null text has no words; an empty target has no counts;
    a null doc_id counts as ``null`` and comes after all others among equal scores; rows that repeat
    a doc_id are rows of their own, ranked in any order where their scores are equal. Other columns
    play no part.

    Texts are scanned once; what is kept of them is four bytes a feature, from which counts and then
    weights are made. Only ids and scores are sorted, in ranges.
    """
    spark, scratch = documents.sparkSession, []
    docs = documents.select("doc_id", "text")
    found = staged(scanned(docs, ["doc_id"], "text", runs, buckets, least), "features", scratch)
    gain = gains(bucket_counts(found, buckets), bucket_counts(scanned(target.select("text"), [], "text", runs, buckets, least), buckets))
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_features long, weight long, score long, enough boolean"
    scores = staged(found.mapInArrow(_scored(gain, seed), schema).withColumn("row", F.monotonically_increasing_id()), "scores", scratch)
    drawn = int(scores.where("enough").count()) * percent // 100
    ranked = sorted_places(scores.where("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row"))
    columns = "doc_id", "n_features", "weight", "score"
    out = ranked.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    out = staged(out.unionByName(scores.where("not enough").select(*columns, F.lit(None).cast("long").alias("rank"))), "drawn")
    drop(spark, scratch)
    return out
