"""Merkle fixity audits of WARC files.

A file's records are hashed, and the hashes of the records that begin in one range of offsets
are hashed together. Ranges are joined FAN at a time up to one root for a file. Two replicas
are compared root by root; below a root that differs only the children of differing ranges
are compared, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import scoped, staged

#: Bytes of the lowest ranges, and ranges joined into one.
RANGE, FAN = 65_536, 16
#: Pages put into one file.
FILE_PAGES = 1000


def _text(value: Column, length: int = 0) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def warc_records(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """A WARC/1.0 resource record for each of ``pages`` (page_id, url, html): file, page_id,
    tie, length, record (binary).

    ``page_id`` div ``file_pages`` names the file. A null url or html is empty, a null page_id
    goes to file -1. ``tie`` orders rows that repeat a page_id.
    """
    body = F.encode(_text(F.col("html")), "utf-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), _text(F.col("page_id")), F.lit(">\r\nWARC-Target-URI: "), _text(F.col("url")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(
        F.coalesce(F.floor(F.col("page_id") / F.lit(file_pages)), F.lit(-1)).cast("long").alias("file"),
        F.col("page_id").cast("long").alias("page_id"),
        F.xxhash64("url", "html").alias("tie"),
        F.concat(F.encode(head, "utf-8"), body, F.encode(F.lit("\r\n\r\n"), "utf-8")).alias("record"),
    ).withColumn("length", F.length("record").cast("long"))


def placed(records: DataFrame) -> DataFrame:
    """``records`` with offset: they lie in their file by page_id and tie without gaps. Give
    :func:`hashed` ones where their bytes are not needed: all columns are shuffled by file."""
    before = Window.partitionBy("file").orderBy("page_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("offset", F.sum("length").over(before) - F.col("length"))


def hashed(records: DataFrame) -> DataFrame:
    """digest (SHA-256 in hexadecimal) in the place of record; a null record counts as empty."""
    record = F.coalesce("record", F.lit(b""))
    return records.withColumn("length", F.length(record).cast("long")).withColumn("digest", F.sha2(record, 256)).drop("record")


def leaves(records: DataFrame) -> DataFrame:
    """file, offset, length, digest, copies of a replica's records (file, offset and record, or
    length and digest); other columns are not read.

    Equal records at one offset are one leaf with their number.
    """
    known = records if "digest" in records.columns else hashed(records)
    leaf = known.select("file", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"), "digest")
    return leaf.groupBy("file", "offset", "length", "digest").agg(F.count("*").alias("copies"))


def tree(leaf: DataFrame, levels: int, range_bytes: int = RANGE, fan: int = FAN) -> list[DataFrame]:
    """file, node, digest for each level from the lowest ranges to the roots, stored.

    A node's digest covers its children in order: at the lowest level the offset, length,
    digest and copies of each record, above it the number and digest of each node.
    """
    child = F.struct("offset", F.concat_ws(":", "offset", "length", "digest", "copies").alias("said"))
    nodes = leaf.groupBy("file", F.floor(F.col("offset") / range_bytes).alias("node")).agg(F.collect_list(child).alias("c"))
    out = []
    for _ in range(levels):
        digest = F.sha2(F.array_join(F.transform(F.array_sort("c"), lambda x: x["said"]), ","), 256)
        out.append(staged(nodes.select("file", "node", digest.alias("digest")), "merkle"))
        said = F.struct("node", F.concat_ws(":", "node", "digest").alias("said"))
        nodes = out[-1].groupBy("file", F.floor(F.col("node") / fan).alias("parent")).agg(F.collect_list(said).alias("c")).withColumnRenamed("parent", "node")
    return out


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    both = a.select(*keys, F.col("digest").alias("da")).join(b.select(*keys, F.col("digest").alias("db")), keys, "full")
    return both.where(~F.col("da").eqNullSafe(F.col("db"))).select(*keys)


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE, fan: int = FAN) -> DataFrame:
    """The records in which two replicas (as for :func:`leaves`) differ: file, offset,
    first_length, second_length, damage (``changed``, ``missing`` in the second or ``extra``
    in it).

    Both replicas' records are hashed once and stored as digests. A range's group is bounded by
    its bytes, a node's by ``fan``. Files of one replica only are wholly missing or extra. Rows
    with a null file or offset are left out; where several different records claim one offset,
    all of them are compared. Equal or empty replicas give no rows.
    """
    with scoped(first.sparkSession):  # only the result outlives it
        a, b = (staged(leaves(x.where("file is not null and offset is not null")), "leaves") for x in (first, second))
        top = a.select("offset").union(b.select("offset")).agg(F.max("offset").alias("m")).first()["m"] or 0
        levels, span = 1, range_bytes
        while span <= top:
            levels, span = levels + 1, span * fan
        trees = list(zip(tree(a, levels, range_bytes, fan), tree(b, levels, range_bytes, fan), strict=True))
        wrong = staged(_differing(*trees[-1], ["file", "node"]), "differing")
        for x, y in reversed(trees[:-1]):
            parents = wrong.select("file", F.col("node").alias("parent"))
            below = [t.withColumn("parent", F.floor(F.col("node") / fan)).join(parents, ["file", "parent"], "left_semi") for t in (x, y)]
            wrong = staged(_differing(*below, ["file", "node"]), "differing")
        ranges = wrong.select("file", "node")
        x, y = (t.withColumn("node", F.floor(F.col("offset") / range_bytes)).join(ranges, ["file", "node"], "left_semi").drop("node") for t in (a, b))
        keys = ["file", "offset", "length", "digest", "copies"]
        gone, new = x.join(y, keys, "left_anti"), y.join(x, keys, "left_anti")
        gone, new = (t.select("file", "offset", F.col("length").alias(f"{n}_length")) for t, n in ((gone, "first"), (new, "second")))
        kind = F.when(F.col("second_length").isNull(), "missing").when(F.col("first_length").isNull(), "extra").otherwise("changed")
        return staged(gone.join(new, ["file", "offset"], "full").withColumn("damage", kind), "damage", [])
