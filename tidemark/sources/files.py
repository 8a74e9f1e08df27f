"""Tables from delimited text and workbooks whose headers, encodings and times vary."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from functools import reduce
from io import BytesIO
from operator import and_
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

from tidemark.functions.scalars import blank_to_null, flexible_timestamp

BOM = "﻿"
#: Encodings that Spark's reader decodes itself.
KNOWN_ENCODINGS = {"iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8"}
#: Formats that times are tried in, in order.
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyyMMddHHmmss"]


def _numbered(named: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with source_file and source_row: rows are numbered inside each split at once; only
    the splits' sizes meet in a window."""
    named = named.withColumn("_at", F.monotonically_increasing_id())
    split = F.shiftright("_at", 33).alias("_split")
    sizes = named.groupBy("source_file", split).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    offsets = sizes.select("source_file", "_split", (before - F.col("_first")).alias("_offset"))
    return named.withColumn("_split", split).join(offsets, ["source_file", "_split"]).withColumn("source_row", F.col("_at") + F.col("_offset")).select(*columns, "source_file", "source_row")


def _file() -> Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file")


def _bytes(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Every byte of a file as a character of its own."""
    return spark.read.csv(path, header=True, encoding="ISO-8859-1", sep=separator, escape='"', enforceSchema=False, mode="PERMISSIVE")


def _is_utf8(text: Column) -> Column:
    """Whether bytes that were read as characters are valid UTF-8; null is."""
    return F.coalesce(F.is_valid_utf8(F.encode(text, "ISO-8859-1").cast("string")), F.lit(True))


def _decoded(encoding: str):
    return F.pandas_udf(lambda s: s.map(lambda v: v.encode("latin-1").decode(encoding, "replace"), na_action="ignore"), "string")


def file_encodings(spark: SparkSession, path: str, fallback: str = "GBK", separator: str = ",") -> DataFrame:
    """source_file, encoding of each file with rows: UTF-8 if all its rows decode as such, else
    ``fallback``. Files are read in splits by all tasks, never whole by one."""
    rows = _bytes(spark, path, separator)
    valid = F.lit(True)
    for c in rows.columns:
        valid = valid & _is_utf8(F.col(f"`{c}`"))
    return rows.select(_file(), valid.alias("_valid")).groupBy("source_file").agg(F.when(F.bool_and("_valid"), "UTF-8").otherwise(fallback).alias("encoding"))


def scan_csv_guessed(spark: SparkSession, path: str, fallback: str = "GBK", separator: str = ",") -> DataFrame:
    """:func:`scan_csv` of a folder whose files are in UTF-8 or in ``fallback``, each by itself as
    :func:`file_encodings` tells. The header is taken as UTF-8 if it is valid."""
    rows = _bytes(spark, path, separator)

    def header(name: str) -> str:
        raw = name.encode("latin-1", "replace")
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode(fallback, "replace")

    names = [header(c).lstrip(BOM).strip() for c in rows.columns]
    plain = rows.select([F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(rows.columns)] + [_file()])
    numbered = _numbered(plain, [f"_{k}" for k in range(len(names))])
    known, other = numbered.join(file_encodings(spark, path, fallback, separator), "source_file"), _decoded(fallback)
    # ASCII needs no decoding, UTF-8 none in Python.
    texts = [F.when(F.col(f"_{k}").rlike("^[\\x00-\\x7f]*$"), F.col(f"_{k}")).when(F.col("encoding") == "UTF-8", F.encode(f"_{k}", "ISO-8859-1").cast("string")).otherwise(other(f"_{k}")).alias(n) for k, n in enumerate(names)]
    return known.select(*texts, "source_file", "source_row")


def sample_encoding(spark: SparkSession, path: str, fallback: str = "GBK") -> str:
    """UTF-8 if all files decode as such, else ``fallback``; :func:`file_encodings` tells it for each."""
    other = file_encodings(spark, path, fallback).where(F.col("encoding") != "UTF-8")
    return fallback if not other.isEmpty() else "UTF-8"


def scan_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", separator: str = ",") -> DataFrame:
    """All columns of a file or flat folder as text, with source_file and source_row (from 0 in
    the order of the file): the lineage key of a row.

    Encodings that Spark's reader does not know are read byte by byte and decoded in Arrow
    batches, header included; what cannot be decoded becomes a replacement character. A byte
    order mark is dropped from the first header. Rows of another width than the header
    are kept with nulls or cut; use :func:`drop_ragged` before trusting positions.
    """
    if encoding.lower() in KNOWN_ENCODINGS:
        df = spark.read.csv(path, header=True, encoding=encoding, sep=separator, escape='"', enforceSchema=False, mode="PERMISSIVE")
        df = df.select([F.col(f"`{c}`").alias(c.lstrip(BOM).strip()) for c in df.columns])
    else:
        df, decoded = _bytes(spark, path, separator), _decoded(encoding)
        df = df.select([decoded(F.col(f"`{c}`")).alias(c.encode("latin-1").decode(encoding, "replace").strip()) for c in df.columns])
    return _numbered(df.select("*", _file()), df.columns)


def scan_range(df: DataFrame, lows_highs: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows whose columns are numbers in closed ranges; what does not parse goes with nulls, and NaN
    is in no range. Columns of numbers keep their type and are compared as they are, so that the
    reader of the files gets the filter; texts are cast."""
    for name, (low, high) in lows_highs.items():
        if not isinstance(df.schema[name].dataType, NumericType):
            df = df.withColumn(name, F.expr(f"try_cast(`{name}` AS double)"))
        df = df.where(F.col(f"`{name}`").between(low, high))
    return df


def detect_format(header: Iterable[str], rules: dict[str, list[set[str]]]) -> str | None:
    """The first rule of which every set shares a name with the header, case aside."""
    have = {h.lstrip(BOM).strip().lower() for h in header}
    return next((name for name, groups in rules.items() if all(have & {g.lower() for g in group} for group in groups)), None)


def file_formats(spark: SparkSession, path: str, rules: dict[str, list[set[str]]], separator: str = ",") -> DataFrame:
    """source_file, format, rows of each file of a flat folder: the first rule that its header fits, as
    in :func:`detect_format`, null where none does, and its number of lines after the header. Files
    are read in splits by all tasks; a file's header is the first line of its first split. Headers are
    taken as UTF-8, quotes around names and a byte order mark do not count; an empty file is left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_line"))
    first = F.min_by(F.when(F.col("_at") == 0, F.col("value")), F.when(F.col("_at") == 0, F.col("_line")))
    heads = lines.groupBy("source_file").agg(first.alias("_head"), (F.count("*") - 1).alias("rows"))
    names = F.transform(F.split(F.translate("_head", f'{BOM}"', ""), re.escape(separator)), lambda n: F.lower(F.trim(n)))
    said = F.lit(None).cast("string")
    for name, groups in reversed(rules.items()):
        fits = reduce(and_, [F.arrays_overlap("_names", F.array(*[F.lit(g.lower()) for g in sorted(group)])) for group in groups], F.lit(True))
        said = F.when(fits, F.lit(name)).otherwise(said)
    return heads.withColumn("_names", names).select("source_file", said.alias("format"), "rows")


def aliased(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """A text column for each canonical name: the first non-blank of its names in order, of
    those that exist; null where none does."""
    have = {c.strip().lower(): c for c in df.columns}

    def pick(names: list[str]) -> Column:
        found = [blank_to_null(F.col(f"`{have[n.lower()]}`").cast("string")) for n in names if n.lower() in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return df.select(*[pick([name, *others]).alias(name) for name, others in aliases.items()], *[c for c in ("source_file", "source_row") if c in df.columns])


def parsed(name: str, kind: str, default=None) -> Column:
    """A text column as ``kind``; blank or unreadable text gives ``default``."""
    value = blank_to_null(F.col(f"`{name}`")).try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def located_rows(df: DataFrame, time: str, lon: str, lat: str, formats: list[str] | None = None) -> DataFrame:
    """Rows with a readable time and a position on the globe, these three columns typed."""
    typed = df.withColumn(time, flexible_timestamp(time, formats or TIME_FORMATS)).withColumn(lon, F.expr(f"try_cast(`{lon}` AS double)")).withColumn(lat, F.expr(f"try_cast(`{lat}` AS double)"))
    return typed.where(F.col(time).isNotNull() & F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90))


def drop_ragged(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """Rows of exactly the schema's width whose fields are empty or can be cast to its types; all
    others are left out, whichever columns are asked for.

    Fields are read as text with the reader's mark of rows of another width, and the filter on
    that mark and on every cast stands in the plan, so that column pruning cannot pass it by."""
    fields = StructType.fromDDL(schema).fields
    bad = "_ragged"
    while bad in {f.name for f in fields}:
        bad += "_"
    texts = StructType([*[StructField(f.name, StringType()) for f in fields], StructField(bad, StringType())])
    rows = spark.read.schema(texts).option("columnPruning", False).csv(path, header=True, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=bad)
    name = lambda f: F.col(f"`{f.name}`")
    for f in fields:
        rows = rows.where(name(f).isNull() | name(f).try_cast(f.dataType).isNotNull())
    return rows.where(F.col(bad).isNull()).select(*[name(f).try_cast(f.dataType).alias(f.name) for f in fields])


def _sheet(content: bytes) -> list[list[str | None]]:
    """Cells of a workbook's first sheet, in the workbook's own order, as text."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    relation = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(BytesIO(content)) as z:
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        first = None
        if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
            places = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            sheets = [places.get(s.get(relation), "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{space}sheet")]
            first = next((f"xl/{p}" if not p.startswith("/") else p[1:] for p in sheets if p), None)
        if first not in names:  # a workbook without a list of its sheets
            first = min((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        rows = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{space}row"):
            cells: list[str | None] = []
            for cell in row.iter(f"{space}c"):
                column = 0
                for c in "".join(x for x in cell.get("r", "") if x.isalpha()):
                    column = column * 26 + ord(c) - 64
                cells += [None] * (column - 1 - len(cells))
                value = cell.find(f"{space}v")
                inline = "".join(t.text or "" for t in cell.iter(f"{space}t"))
                text = inline or (value.text if value is not None else None)
                cells.append(shared[int(text)] if cell.get("t") == "s" and text else text)
            rows.append(cells)
    return rows


def workbook_rows(workbooks: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the first sheet of each workbook of ``workbooks`` (path, content) as text, by
    the header in its first row, with source_file and source_row. A workbook is read whole by one
    task; one without content has no rows."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                head, *rows = (_sheet(content) if content else None) or [[]]
                at = {(h or "").strip(): i for i, h in enumerate(head)}
                out = [[r[at[c]] if c in at and at[c] < len(r) else None for c in columns] for r in rows]
                if out:
                    yield pd.DataFrame(out, columns=columns, dtype=object).assign(source_file=file.rsplit("/", 1)[-1], source_row=range(len(out)))

    schema = ", ".join(f"`{c}` string" for c in columns) + ", source_file string, source_row long"
    return workbooks.select("path", "content").mapInPandas(run, schema)


def scan_xlsx(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """:func:`workbook_rows` of a file or folder."""
    return workbook_rows(spark.read.format("binaryFile").load(path), columns)
