"""Token ids of documents in Simple-8b files.

A file is Parquet whose rows are chunks of consecutive documents of one range of ``doc_id``:

    part, chunk        the range's number and the chunk's number in it
    first              ids of the range before this chunk
    doc_ids, doc_lens  the documents in order and their numbers of ids
    offsets            for each block of BLOCK ids, the word it begins at
    words              64-bit words, little-endian
    escapes            values too wide for a word

A word's top four bits select how many ids of how many bits fill the other 60, the first id
lowest. No word crosses a block, so any block can be decoded alone, and all words of one
selector are unpacked in one vectorised step. Selector 0 is the escape: the word holds the
place of the value in ``escapes``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import codec, slices, vocabulary_path

BLOCK = 1024
#: A chunk is closed once it holds as many ids.
CHUNK_IDS = 256 * BLOCK
#: Ids in a word for each selector; 60 // count bits each. 0: escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0], np.int64)
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], np.int64)
WIDTHS = np.unique(BITS[1:-1])
ESCAPED = 99
SCHEMA = "part int, chunk int, first long, doc_ids array<long>, doc_lens array<long>, offsets array<int>, words binary, escapes array<long>"


def _width(values: np.ndarray) -> np.ndarray:
    """The number in WIDTHS of the least width that holds each value below 2**60."""
    if len(values) and values.max() < 1 << 16:
        return _SMALL[values]
    return np.searchsorted(np.uint64(1) << WIDTHS.astype(np.uint64), values, side="right").astype(np.uint8)


_SMALL = np.searchsorted(1 << WIDTHS, np.arange(1 << 16), side="right").astype(np.uint8)


def simple8b_encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word each block begins at, and escaped values of unsigned 64-bit integers."""
    values = np.asarray(values, np.uint64)
    n, pad = len(values), int(COUNTS.max())
    blocks = -(-n // BLOCK)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    escapes = flat[flat >> np.uint64(60) != 0]
    # The number of the least width that holds each value; past the last for an escape.
    need = np.zeros((blocks, BLOCK + pad), np.uint8)
    if len(escapes):
        wide = flat >> np.uint64(60) != 0
        flat[wide] = np.arange(len(escapes), dtype=np.uint64)
        need[:, :BLOCK] = np.where(wide, ESCAPED, _width(flat)).reshape(blocks, BLOCK)
    else:
        need[:, :BLOCK] = _width(flat).reshape(blocks, BLOCK)
    grid = np.zeros((blocks, BLOCK + pad), np.uint64)
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    # Over growing windows: where all of the next `count` values fit, that selector is better.
    selector = np.where(need == ESCAPED, 0, 14).astype(np.uint8)
    most, span = need.copy(), 1
    for s in range(13, 0, -1):
        count, limit = int(COUNTS[s]), int(np.searchsorted(WIDTHS, BITS[s]))
        while span < count:
            step = min(span, count - span)
            np.maximum(most[:, :-step], most[:, step:], out=most[:, :-step])
            span += step
        if not (fits := most <= limit).any():
            break  # no longer window can hold narrower values
        np.putmask(selector, fits, s)
    # All blocks take their next word at once.
    at, row = np.zeros(blocks, np.int64), np.arange(blocks)
    steps, begins = COUNTS[selector], np.zeros((blocks, BLOCK), bool)
    while len(row):
        here = at[row]
        begins[row, here] = True
        at[row] = here = here + steps[row, here]
        row = row[here < BLOCK]
    which, where = np.nonzero(begins)
    last = n - (blocks - 1) * BLOCK
    inside = (which < blocks - 1) | (where < last)  # no words for the last block's padding
    which, where = which[inside], where[inside]
    chosen = selector[which, where]
    words, cells = chosen.astype(np.uint64) << np.uint64(60), grid.ravel()
    for s in np.unique(chosen):
        i = np.flatnonzero(chosen == s)
        at, filled = which[i] * grid.shape[1] + where[i], words[i]
        for lane in range(COUNTS[s]):
            filled |= cells[at + lane] << np.uint64(lane * BITS[s])
        words[i] = filled
    return words, np.searchsorted(which, np.arange(blocks)).astype(np.int32), escapes


def simple8b_decode(words: np.ndarray, offsets: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The ``n`` values of words whose blocks begin at ``offsets``; a block alone is decoded
    from its own words with offsets ``[0]``."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    if len(words):
        end = np.append(offsets[1:], len(words)) - 1
        total = np.add.reduceat(count, offsets)
        size = np.minimum(BLOCK, n - np.arange(len(offsets)) * BLOCK)
        count[end] -= total - size  # the last word of a block may hold padding
    begin = np.cumsum(count) - count
    out = np.empty(n, np.uint64)
    for s in np.unique(selector):
        i = np.flatnonzero(selector == s)
        lane = np.arange(COUNTS[s])
        mask = np.uint64((1 << int(BITS[s])) - 1)
        value = (words[i, None] >> (lane * BITS[s]).astype(np.uint64)) & mask
        held = lane < count[i, None]
        out[(begin[i, None] + lane)[held]] = (escapes[value] if s == 0 else value)[held]
    return out


def _encode(vocabulary: str, end_id: int, special_as_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = codec(vocabulary, special_as_text=special_as_text).encode, int(end_id).to_bytes(4, "little")
        part, chunk, first, docs, ids, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            lens = [len(x) // 4 for x in ids]
            words, offsets, escapes = simple8b_encode(np.frombuffer(b"".join(ids), "<u4"))
            row = {"part": part, "chunk": chunk, "first": first, "doc_ids": list(docs), "doc_lens": lens, "offsets": offsets.tolist(), "words": words.astype("<u8").tobytes(), "escapes": escapes.astype(np.int64).tolist()}
            return pa.RecordBatch.from_pylist([row], schema=_arrow())

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                ids.append(encode(text.as_py()) + end)
                held += len(ids[-1]) // 4
                if held >= CHUNK_IDS:
                    yield close()
                    chunk, first, docs, ids, held = chunk + 1, first + held, [], [], 0
        if docs:
            yield close()

    return run


def _arrow() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("words", pa.binary()), ("escapes", pa.list_(pa.int64()))])


def write_tokens(documents: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, special_as_text: bool = False) -> None:
    """Write the ids of all ``documents`` (doc_id long, text string), each closed by ``end_id``,
    in ascending doc_id order.

    A null or empty text has the end id alone. Rows that share a doc_id all stay, ordered by
    their text's hash; a null doc_id comes first. Other columns are not read. An empty table
    gives files without rows. Literals of special tokens become their ids, or with
    ``special_as_text`` those of ordinary text. ``doc_id`` ranges are dealt by Spark's range partitioning; one
    task holds one chunk and one text at a time.
    """
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
    order = ["doc_id", F.xxhash64("text")]
    rows = documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(_encode(vocabulary, end_id, special_as_text), SCHEMA).write.option("compression", "zstd").parquet(path)


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        for row in batch.to_pylist():
            lens = np.array(row["doc_lens"], np.int64)
            ids = simple8b_decode(np.frombuffer(row["words"], "<u8"), np.array(row["offsets"], np.int64), int(lens.sum()), np.array(row["escapes"], np.int64).astype(np.uint64)).astype("<u4")
            ends = np.cumsum(lens)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * len(lens), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - lens), pa.array(lens), pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, lens, strict=True)], pa.binary())],
                names=["part", "doc_id", "at", "n_tokens", "ids"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of files written by :func:`write_tokens`: doc_id, start (ids of all
    documents before it), n_tokens, ids (little-endian unsigned 32-bit integers).

    Only one total for each range is summed across ranges; ids never meet in one task.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    size = F.aggregate("doc_lens", F.lit(0).cast("long"), lambda a, b: a + b)
    totals = files.groupBy("part").agg(F.sum(size).alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    rows = files.mapInArrow(_decode, "part int, doc_id long, at long, n_tokens long, ids binary")
    # One row for each file part, far fewer than a million: the bound is the number of ranges.
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")
