"""Structured Streaming: framing, sealing by span, duplicates, a gate with a hold time, and
publication of batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.scalars import micros
from tidemark.operators.tracks import associate_frame


class Framer:
    """Packets from a byte stream: a marker, a length of ``length_bytes`` (big-endian, of the
    body), the body. Bytes before a marker are skipped, an unfinished packet waits for more. A
    length over ``most`` cannot be one: the marker is passed over as if it stood there by chance."""

    def __init__(self, marker: bytes, length_bytes: int = 2, most: int = 8 << 20, held: bytes = b""):
        self.marker, self.length_bytes, self.most, self.held = marker, length_bytes, most, held

    def feed(self, data: bytes) -> Iterator[bytes]:
        held, at = self.held + data, 0
        head = len(self.marker) + self.length_bytes
        while True:
            found = held.find(self.marker, at)
            if found < 0:  # the marker may have begun
                at = max(at, len(held) - len(self.marker) + 1)
                break
            at = found
            if len(held) < at + head:
                break
            size = int.from_bytes(held[at + len(self.marker) : at + head], "big")
            if size > self.most:
                at += 1
                continue
            if len(held) < at + head + size:
                break
            yield held[at + head : at + head + size]
            at += head + size
        self.held = held[at:]


def framed(files: DataFrame, marker: bytes, length_bytes: int = 2, most: int = 8 << 20) -> DataFrame:
    """path, packet (number from 0), body of captured byte streams (path, content), streaming
    or not; each file is a stream of its own, and one without content has no packets. ``most``
    is the longest body; see :class:`Framer`."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                bodies = list(Framer(marker, length_bytes, most).feed(bytes(content or b"")))
                if bodies:
                    yield pd.DataFrame({"path": [path] * len(bodies), "packet": range(len(bodies)), "body": bodies})

    return files.select("path", "content").mapInPandas(run, "path string, packet long, body binary")


def _frame(marker: bytes, length_bytes: int, most: int):
    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, count = state.get if state.exists else (b"", 0)
        framer = Framer(marker, length_bytes, most, bytes(held))
        reads = pd.concat(list(batches)).sort_values("seq")
        bodies = [body for content in reads["content"] if content is not None for body in framer.feed(bytes(content))]
        state.update((framer.held, count + len(bodies)))
        yield pd.DataFrame({"stream": [key[0]] * len(bodies), "packet": range(count, count + len(bodies)), "body": bodies})

    return run


def framed_stream(reads: DataFrame, marker: bytes, length_bytes: int = 2, most: int = 8 << 20) -> DataFrame:
    """stream, packet (number from 0), body of a stream of reads (stream, seq, content). What a
    read leaves unfinished is the stream's state and goes on with its next one, also in later
    micro-batches; the reads of a micro-batch are taken by seq, and null contents are skipped."""
    rows = reads.select(F.col("stream").cast("string"), F.col("seq").cast("long"), F.col("content").cast("binary"))
    return rows.groupBy("stream").applyInPandasWithState(_frame(marker, length_bytes, most), "stream string, packet long, body binary", "held binary, count long", "append", GroupStateTimeout.NoTimeout)


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as a stream; the bound on files a trigger is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sealed_by_span(events: DataFrame, ts: str, span: str, late: str) -> DataFrame:
    """n, first_ts, last_ts of each span of event time, sealed once the watermark ``late`` has
    passed it; later records and those without a time are left out. Spans stand at the epoch;
    :func:`batched_from_first` begins them at the first record and loses none."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, span)).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).select(F.col("window.start").alias("span_start"), "n", "first_ts", "last_ts")


def _anchor(span: int):
    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, start = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        numbers, starts = [], []
        for t in rows["t"].tolist():
            if number < 0 or t - start >= span:
                number, start = number + 1, t
            numbers.append(number)
            starts.append(start)
        state.update((number, start))
        yield rows[["t", "id"]].assign(key=key[0], batch=numbers, batch_start=starts)[["key", "t", "id", "batch", "batch_start"]]

    return run


def batched_from_first(events: DataFrame, key: str, ts: str, tie: str, span_micros: int) -> DataFrame:
    """key, t, id, batch (number from 0), batch_start of a stream: a batch opens at its first record
    and takes all until one is ``span_micros`` or more after it, which seals it and opens the
    next. A record from before the open batch's start is written to the open batch: none is lost.
    A micro-batch is taken in the order of time; records without a time are left out. The state
    of a key is its open batch."""
    rows = events.select(F.col(key).cast("string").alias("key"), micros(ts).alias("t"), F.col(tie).cast("long").alias("id")).where("t is not null")
    return rows.groupBy("key").applyInPandasWithState(_anchor(span_micros), "key string, t long, id long, batch long, batch_start long", "number long, start long", "append", GroupStateTimeout.NoTimeout)


def without_repeats(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """One event for each key while the watermark may still see its like: a key is forgotten ``late``
    after its event, and then one like it counts again. Events older than the watermark and those
    without a time are left out; null keys are keys like others; of repeats any one stays."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


#: Fixed value: the state store that timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Gate(StatefulProcessor):
    """The gate of one key: since when its value is over the threshold, whether that is confirmed, and
    its last time. A timer ends it once the watermark is ``idle`` beyond that; it is set when the state
    begins, and again when it goes off too early, so that rows of a key ask the state store twice a micro-batch."""

    def __init__(self, threshold: float, hold: int, idle: int):
        self.threshold, self.hold, self.idle = threshold, hold, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gate", "since long, confirmed boolean, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        since, confirmed, last = held or (None, False, None)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        out = []
        both = [(t, v) for batch in rows for t, v in zip(batch["t"].tolist(), batch["value"].tolist(), strict=True)]
        for t, value in sorted(both, key=lambda r: (r[0], 0.0 if r[1] is None or r[1] != r[1] else r[1])):
            if t < passed:
                out.append((key[0], t, value, "late", False))
                continue
            if last is not None and t - last > self.idle:
                since, confirmed = None, False
            last = t if last is None else max(t, last)
            edge = False
            if value is None or not abs(value) > self.threshold:
                since, confirmed, said = None, False, "stable"
            else:
                since = t if since is None else since
                if t >= since and not confirmed and t - since >= self.hold:
                    confirmed = edge = True
                said = "confirmed" if confirmed else "holding"
            out.append((key[0], t, value, said, edge))
        if last is not None:
            self.state.update((since, confirmed, last))
            if not held:  # a key with a state has a timer, which sees how late it has become
                self.handle.registerTimer(max((last + self.idle) // 1000, passed // 1000) + 1)
        yield pd.DataFrame(out, columns=["key", "t", "value", "state", "edge"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, last = self.state.get() or (None, False, None)
        ends = -1 if last is None else (last + self.idle) // 1000 + 1
        if ends > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(ends)
        else:
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def gate(events: DataFrame, key: str, ts: str, value: str, threshold: float, hold_micros: int, idle_micros: int = 7 * 86_400_000_000, late: str = "1 day") -> DataFrame:
    """key, t, value, state, edge of a stream: ``holding`` while the size of the value is over
    the threshold, ``confirmed`` once it has been for ``hold_micros`` (edge marks that row),
    ``stable`` otherwise, which a null value is too. A micro-batch is taken in order of time; what
    comes from before the start of a hold neither moves nor ends it. A row more than ``idle_micros``
    after its key's last one begins anew, so the state of a key that is quiet for that long is
    deleted by a timer of event time. Rows from before the watermark, ``late`` behind the latest time
    seen, change nothing and come out as ``late``; rows without a time are left out. A null key is one
    like others. The session must use :data:`ROCKS` as its state store, which is set here where none is."""
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    rows = rows.select(F.col(key).cast("long").alias("key"), micros(ts).alias("t"), F.col(value).cast("double").alias("value")).where("t is not null")
    return rows.groupBy("key").transformWithStateInPandas(_Gate(threshold, hold_micros, idle_micros), "key long, t long, value double, state string, edge boolean", "Append", "EventTime")


def _associate(reach: float, missed: int):
    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, ids, frames, values = state.get if state.exists else (0, [], [], [])
        live = {k: (f, v) for k, f, v in zip(ids, frames, values, strict=True)}
        every = pd.concat(list(batches))
        rows = every[every["known"]].sort_values(["frame", "value", "id"])
        labels: list[int] = []
        for at, part in rows.groupby("frame", sort=True):
            found, live, count = associate_frame(live, count, int(at), part["value"].tolist(), reach, missed)
            labels += found
        state.update((count, list(live), [f for f, _ in live.values()], [v for _, v in live.values()]))
        yield pd.DataFrame({"key": key[0], "frame": rows["frame"], "id": rows["id"], "track": labels})
        others = every[~every["known"]]
        yield pd.DataFrame({"key": key[0], "frame": pd.Series(None, others.index, "Int64"), "id": others["id"], "track": pd.Series(None, others.index, "Int64")})

    return run


def associated(events: DataFrame, key: str, frame: str, value: str, tie: str, reach: float, missed: int) -> DataFrame:
    """key, frame, id, track of a stream, as ``tracks.associate`` gives for its rows together;
    a micro-batch holds whole frames and comes after those of smaller ones. Rows with a null frame
    or value, or a NaN, are in no track and have no frame. The state of a key is its live tracks."""
    at, said = F.col(frame).cast("long"), F.col(value).cast("double")
    known = at.isNotNull() & said.isNotNull() & ~F.isnan(said)
    rows = events.select(F.col(key).cast("string").alias("key"), F.when(known, at).otherwise(0).alias("frame"), F.when(known, said).otherwise(0.0).alias("value"), F.col(tie).cast("long").alias("id"), known.alias("known"))
    return rows.groupBy("key").applyInPandasWithState(_associate(reach, missed), "key string, frame long, id long, track long", "count long, ids array<long>, frames array<long>, last array<double>", "append", GroupStateTimeout.NoTimeout)


def publish(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Batches as Parquet: a file counts once the sink's log lists it, so readers see whole
    batches only, and a batch that is tried again counts once. Rows are written as they are, nulls and
    repeats too; an empty batch adds nothing."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def publish_epoch(stream: DataFrame, path: str, mode: str = "append"):
    """:func:`publish` in a new epoch of ``path``: a folder and checkpoint of its own. What an
    earlier epoch left in flight is never read again, as :func:`read_epoch` reads the last one."""
    epoch = max(_epochs(stream.sparkSession, path), default=-1) + 1
    return publish(stream, f"{path}/epoch={epoch}/out", f"{path}/epoch={epoch}/checkpoint", mode)


def _epochs(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return [int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=")]


def read_epoch(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that the last epoch of ``path`` has published."""
    return spark.read.schema(schema).parquet(f"{path}/epoch={max(_epochs(spark, path))}/out")


def upsert_recent(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, most: int, buckets: int = 16):
    """Keeps the latest row of each key, of the ``most`` latest keys, in a table of ``buckets`` of keys of
    which each batch replaces those it has keys of; :func:`read_recent` reads it.

    A bucket keeps its own ``most`` latest keys, so what a batch reads and writes follows the batch and
    ``most``, not the keys ever seen. Its new buckets are written as a version of their own, then a
    manifest is put in place by renaming: it names the version of every bucket. After that, versions
    that neither it nor the manifest before it names are deleted, so that a reader may finish. A
    repeated batch gives the same table, and a new checkpoint goes on with the table that is there. Of
    rows of one key and order the greatest by their columns stays; null keys are one key; rows with a
    null order are older than all others.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = sorted(r["_bucket"] for r in placed.select("_bucket").distinct().collect())  # at most ``buckets``
        if not touched:
            return
        old = _manifest(spark, path)
        for version, mine in _versions({b: v for b, v in old.items() if b in touched}).items():
            placed = placed.unionByName(_read_version(spark, path, version, batch.schema).where(F.col("_bucket").isin(mine)))
        newest = F.max(F.struct(order, *[c for c in batch.columns if c != order]))
        latest = placed.groupBy("_bucket", key).agg(newest.alias("r")).select("_bucket", "r.*")
        kept = latest.withColumn("_place", F.row_number().over(Window.partitionBy("_bucket").orderBy(F.desc(order), key))).where(F.col("_place") <= most).drop("_place")
        name = f"version-{uuid.uuid4().hex}"
        kept.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{name}")
        new = {**old, **dict.fromkeys(touched, name)}
        _put_manifest(spark, path, new)
        _forget(spark, path, {*old.values(), *new.values()})

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(manifest: dict[int, str]) -> dict[str, list[int]]:
    """The buckets that each version holds."""
    found: dict[str, list[int]] = {}
    for bucket, version in sorted(manifest.items()):
        found.setdefault(version, []).append(bucket)
    return found


def _read_version(spark: SparkSession, path: str, version: str, schema) -> DataFrame:
    return spark.read.schema(_with_bucket(schema)).parquet(f"{path}/{version}")


def _with_bucket(schema) -> T.StructType:
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return T.StructType([*fields, T.StructField("_bucket", T.IntegerType())])


def _folder(spark: SparkSession, path: str):
    """The file system of ``path``, the path, and the names in it with their times."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, folder, [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(folder)] if fs.exists(folder) else []


def _manifest(spark: SparkSession, path: str) -> dict[int, str]:
    """Bucket to version, by the manifest of the highest number."""
    _, _, names = _folder(spark, path)
    numbers = [int(n.removeprefix("manifest-")) for _, n in names if n.startswith("manifest-")]
    if not numbers:
        return {}
    rows = spark.read.schema("bucket int, version string").json(f"{path}/manifest-{max(numbers)}").collect()  # one a bucket
    return {r["bucket"]: r["version"] for r in rows}


def _put_manifest(spark: SparkSession, path: str, manifest: dict[int, str]) -> None:
    """Writes the next manifest beside the table and renames it into place."""
    fs, _, names = _folder(spark, path)
    number = max([int(n.removeprefix("manifest-")) for _, n in names if n.startswith("manifest-")], default=-1) + 1
    made = f"{path}/made-{uuid.uuid4().hex}"
    spark.createDataFrame(sorted(manifest.items()), "bucket int, version string").coalesce(1).write.json(made)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    if not fs.rename(at(made), at(f"{path}/manifest-{number}")):
        raise OSError(f"{path}/manifest-{number} could not be put in place")


def _forget(spark: SparkSession, path: str, named: set[str]) -> None:
    """Deletes versions that are not ``named``, and all manifests but the last two."""
    fs, folder, names = _folder(spark, path)
    numbers = sorted(int(n.removeprefix("manifest-")) for _, n in names if n.startswith("manifest-"))
    for _, name in names:
        old = name.startswith("version-") and name not in named or name.startswith("manifest-") and int(name.removeprefix("manifest-")) not in numbers[-2:]
        if old or name.startswith("made-"):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)


def read_recent(spark: SparkSession, path: str, schema, order: str, most: int) -> DataFrame:
    """The ``most`` latest rows of the table that :func:`upsert_recent` keeps; empty before its first
    batch."""
    found = spark.createDataFrame([], schema)
    for version, mine in _versions(_manifest(spark, path)).items():
        found = found.unionByName(_read_version(spark, path, version, schema).where(F.col("_bucket").isin(mine)).drop("_bucket"))
    key = [c for c in found.columns if c != order]
    return found.orderBy(F.desc(order), *key).limit(most)
