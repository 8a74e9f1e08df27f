"""Benchmark passages in documents by Wu-Manber search over words.

The searched strings are windows of consecutive words of benchmark items. For each length of
window, a shift table tells for a block of two words how far the search may jump when the
block ends there; blocks that end a window lead to the windows that end so, of which those
with the right first words are compared word by word.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.tokens import claim, slices
from tidemark.plans.staging import drop, staged

WINDOW = 13
#: Characters of benchmark texts that are searched for at once: they are broadcast, and each
#: Python worker makes search tables of about 40 bytes a character of them.
PATTERN_CHARS = 4_000_000
#: A-Z to lower case; what is neither a digit, a-z nor beyond ASCII parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Windows of one length in items of numbered words (from 1; 0 is any other word).

    A row is a window with where it lies; rows are in the order of the windows' last and first
    blocks, so that equal windows stand together. ``jumps`` gives for a block how far the search
    may move, or, below zero, the first row that ends with it.
    """

    def __init__(self, items: dict[int, array], length: int, base: int):
        self.items, self.length, self.base, self.block = items, length, base, min(2, length)
        self.jump = length - self.block + 1
        names, begins, blocks, whole, self.jumps = [], [], [], [], {}
        for name, w in items.items():
            ids = np.frombuffer(w, np.uint32).astype(np.uint64)
            n = len(ids) - length + 1
            ends = ids[1:] + ids[:-1] * np.uint64(base) if self.block == 2 else ids
            for k, key in enumerate(ends[: length - self.block].tolist()):  # no window ends here
                self.jumps[key] = min(self.jumps.get(key, self.jump), length - self.block - k)
            mixed = np.zeros(n, np.uint64)
            for k in range(length):
                mixed = (mixed ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            names.append(np.full(n, name, np.int32))
            begins.append(np.arange(n, dtype=np.int32))
            blocks.append(np.stack([ends[length - self.block :], ends[:n]]))
            whole.append(mixed)
        name, begin, block, mixed = np.concatenate(names), np.concatenate(begins), np.concatenate(blocks, axis=1), np.concatenate(whole)
        order = np.lexsort((begin, name, mixed, block[1], block[0]))
        name, begin, block, mixed = name[order], begin[order], block[:, order], mixed[order]
        alike = np.zeros(len(name), bool)
        alike[1:] = (mixed[1:] == mixed[:-1]) & (block[:, 1:] == block[:, :-1]).all(axis=0)
        for r in np.flatnonzero(alike).tolist():  # the hash only proposes
            alike[r] = self._window(name[r], begin[r]) == self._window(name[r - 1], begin[r - 1])
        once = ~alike
        once[1:] |= name[1:] != name[:-1]  # an item's repeated window counts once
        name, begin, block, alike = name[once], begin[once], block[:, once], alike[once]
        firsts = np.flatnonzero(np.append(True, block[0][1:] != block[0][:-1]))
        self.jumps.update(zip(block[0][firsts].tolist(), (-1 - firsts).tolist(), strict=True))
        self.until = dict(zip(firsts.tolist(), np.append(firsts[1:], len(name)).tolist(), strict=True)) if len(firsts) else {}
        self.name, self.begin, self.first, self.alike = (array(code, values.astype(kind).tobytes()) for code, kind, values in (("i", np.int32, name), ("i", np.int32, begin), ("Q", np.uint64, block[1]), ("b", np.int8, alike)))

    def _window(self, name: int, begin: int) -> array:
        return self.items[name][begin : begin + self.length]

    def search(self, found: array) -> Iterator[tuple[int, int]]:
        """Start of each occurrence and the number of each item that holds its window."""
        m, n, base, jumps, jump, two = self.length, len(found), self.base, self.jumps, self.jump, self.block == 2
        at = m
        while at <= n:
            step = jumps.get(found[at - 2] * base + found[at - 1] if two else found[at - 1], jump)
            if step > 0:
                at += step
                continue
            start, low = at - m, -1 - step
            high, here, equal = self.until[low], found[start:at], False
            first = found[start] * base + found[start + 1] if two else found[start]
            for r in range(bisect_left(self.first, first, low, high), high):
                if self.first[r] != first:
                    break
                if not self.alike[r]:
                    equal = self._window(self.name[r], self.begin[r]) == here
                if equal:
                    yield start, self.name[r]
            at += 1


class Searcher:
    """Items with their search tables, which each process makes for itself when first asked."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.items, self.window, self.tables = list(items), window, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    def _make(self) -> None:
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, dict[int, array]] = {}
        for k, (_, text) in enumerate(self.items):
            if w := words(text):
                by_length.setdefault(min(self.window, len(w)), {})[k] = array("I", [self.numbers.setdefault(x, len(self.numbers) + 1) for x in w])
        self.tables = [WuManber(items, length, len(self.numbers) + 1) for length, items in sorted(by_length.items())]

    def find(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, ranges of words in occurrences, items that occur."""
        if self.tables is None:
            self._make()
        number, spans, items = self.numbers.get, set(), set()
        found = array("I", [number(x, 0) for x in words(text)])
        for table in self.tables:
            for start, k in table.search(found):
                spans.add((start, start + table.length))
                items.add(self.items[k][0])
        return len(found), _merge(spans), items


def _merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


ADDED = ["n_words", "spans", "items"]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary())
            sizes, all_spans, all_items = [], [], []
            for text in texts:
                n, spans, items = shared.value.find(text.as_py())
                sizes.append(n)
                all_spans.append([{"start": s, "end": e} for s, e in spans])
                all_items.append(sorted(items))
            kept = batch.schema.names
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(sizes, pa.int64()), pa.array(all_spans, _SPANS), pa.array(all_items, pa.list_(pa.string()))], names=[*kept, *ADDED])

    return run


def find_benchmark(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, pattern_chars: int = PATTERN_CHARS) -> DataFrame:
    """Every row of ``documents`` with n_words, spans (merged ranges of words inside
    occurrences, end exclusive) and items (sorted ids of items with occurring windows); columns
    of these names give way, of the others only ``text`` is looked at.

    The benchmark is counted first. Up to ``pattern_chars`` characters are broadcast as one
    list of items. A larger one is cut into parts of about that size, items that are longer than a
    quarter of it into pieces that share ``window - 1`` words with the next; the documents get a row
    number once, each part is searched for in them by a task of its own that sends on rows with
    occurrences only, and these are put together by row. A null text has no words; items without
    an id or words are passed over; repeated items count once. Rows that repeat an id, or have
    none, stand for themselves; an empty table gives none.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where("item is not null and text is not null").distinct()
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    rows = documents.drop(*ADDED)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    added = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType()))]
    if chars <= pattern_chars:
        return rows.mapInArrow(_search(_sent(spark, items, window)), T.StructType([*rows.schema, *added]))
    scratch: list[str] = []
    pieces = staged(items.mapInArrow(_pieces(window, max(1, pattern_chars // 4)), "item string, text binary"), "pieces", scratch)
    parts = -(-(pieces.agg(F.sum(F.length("text"))).first()[0] or 0) // pattern_chars) or 1
    numbered = staged(rows.select(F.monotonically_increasing_id().alias("row"), F.struct(*rows.columns).alias("doc"), F.col("text").alias("text")), "documents")
    asked, found = numbered.select("row", "text"), None
    for part in range(parts):
        mine = pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        one = asked.mapInArrow(_search(_sent(spark, mine, window)), T.StructType([*asked.schema, *added])).drop("text").where(F.lit(part == 0) | (F.size("items") > 0))
        found = one if found is None else found.unionByName(one)
    lists = [F.collect_list(c).alias(c) for c in ("spans", "items")]
    merged = found.groupBy("row").agg(F.max("n_words").alias("n_words"), *lists).mapInArrow(_put_together, T.StructType([T.StructField("row", T.LongType()), *added]))
    drop(spark, scratch)
    return numbered.drop("text").join(merged, "row").select("doc.*", *ADDED)


def _put_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What several parts found in a row, as if one had."""
    for batch in batches:
        spans = [[{"start": s, "end": e} for s, e in _merge((x["start"], x["end"]) for part in parts for x in part)] for parts in batch.column("spans").to_pylist()]
        items = [sorted({x for part in parts for x in part}) for parts in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n_words"), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=["row", *ADDED])


def _sent(spark: SparkSession, items: DataFrame, window: int):
    """The items of one part, read row by row, sent to all tasks."""
    return spark.sparkContext.broadcast(Searcher(((r["item"], bytes(r["text"])) for r in items.toLocalIterator()), window))


def _pieces(window: int, most: int):
    """Items of over ``most`` bytes in pieces with every window in one of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                said = words(text) if len(text) > most else []
                step = max(1, most * len(said) // max(1, len(text)))
                for piece in [b" ".join(said[at : at + step + window - 1]) for at in range(0, max(1, len(said) - window + 1), step)] if len(said) > window else [text]:
                    names.append(name)
                    texts.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["item", "text"])

    return run


def with_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """:func:`find_benchmark` with n_hit and contaminated: at least a twentieth of a document's
    words, and one at least, lie in windows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return find_benchmark(documents, benchmark, window).withColumn("n_hit", hit).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the item ids, comma-joined),
    contaminated for every row of ``documents``."""
    found = with_contamination(documents.select(F.col("doc_id").cast("long"), "text"), benchmark, window)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
