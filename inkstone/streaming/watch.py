"""Incremental analysis: changes are settled, the files' facts are replaced, and cross-file rules run over the merged facts.

A change is (path, type, content, ts, seq) with type change or unlink. Facts live in a table cut into buckets of the path, and a batch rewrites
the buckets that it touches only, so its cost follows the change and not the code base. A batch writes new files in a folder of its own and then names
the folder of every bucket in a new version, so that a batch that fails half-way leaves the version before it as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstone.operators import cross
from inkstone.operators import facts as parsing
from inkstone.schema import FACTS
from inkstone.sources.files import IGNORED, kind_of, not_ignored
from inkstone.streaming import memo

NAMES = "name string, defined long, used long"
CHANGES = "path string, type string, content string, ts timestamp, seq long"
BUCKETS = 64


def bursts(times: DataFrame, gap_seconds: float = 0.3) -> DataFrame:
    """ts, burst for distinct times(ts): burst is the first time of a run without a pause of the gap or more.

    The order is global but the work is by hour: hours look at the last time and the last start before them through a table of one row for each hour."""
    seconds = F.col("ts").cast("timestamp").cast("double")
    hourly = times.select("ts").distinct().withColumn("hour", F.floor(seconds / 3600).cast("long"))
    own = Window.partitionBy("hour").orderBy("ts")
    ends = hourly.groupBy("hour").agg(F.max("ts").alias("end")).select("hour", F.lag("end").over(Window.orderBy("hour")).alias("before"))
    near = hourly.withColumn("back", F.lag("ts").over(own)).join(ends, "hour")
    since = seconds - F.coalesce("back", "before").cast("timestamp").cast("double")
    marked = near.withColumn("start", F.when(since.isNull() | (F.round(since, 6) >= gap_seconds), F.col("ts"))).withColumn("here", F.max("start").over(own))
    earlier = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("hour").agg(F.max("start").alias("s")).select("hour", F.max("s").over(earlier).alias("carried"))
    return marked.join(carried, "hour").select("ts", F.coalesce("here", "carried").alias("burst"))


def debounce(changes: DataFrame, gap_seconds: float = 0.3) -> DataFrame:
    """Last change of each path in each burst, with the burst's first time: a burst ends when no path at all has changed for the gap."""
    placed = changes.join(bursts(changes, gap_seconds), "ts")
    last = F.max_by(F.struct(*changes.columns), F.struct("ts", "seq")).alias("e")
    return placed.groupBy("burst", "path").agg(last).select("e.*", "burst")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path of a batch: change then unlink is unlink."""
    return changes.groupBy("path").agg(F.max_by(F.struct("type", "content"), F.struct("ts", "seq")).alias("e")).select("path", "e.type", "e.content")


def bucket(file: str = "file"):
    return F.pmod(F.xxhash64(file), F.lit(BUCKETS)).cast("int")


def replaced(state: DataFrame, changes: DataFrame, globs: tuple[str, ...] = IGNORED, parse: Callable[[DataFrame], DataFrame] = parsing.parse) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a batch of changes does to the fact table: the facts that stay, those of changed and removed files, which go, and those that come."""
    return exchanged(state, latest(changes), globs, parse)


def exchanged(state: DataFrame, last: DataFrame, globs: tuple[str, ...] = IGNORED, parse: Callable[[DataFrame], DataFrame] = parsing.parse) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for a settled batch, last(path, type, content), which is read several times."""
    files = last.select(F.col("path").alias("file"))
    fresh = last.where("type = 'change'").select(F.col("path").alias("file"), "content")
    return state.join(files, "file", "left_anti"), state.join(files, "file", "left_semi"), parse(not_ignored(fresh.where(kind_of(F.col("file")).isNotNull()), globs))


def updated(state: DataFrame, changes: DataFrame, globs: tuple[str, ...] = IGNORED, parse: Callable[[DataFrame], DataFrame] = parsing.parse) -> DataFrame:
    """The fact table after a batch of changes."""
    stays, _, comes = replaced(state, changes, globs, parse)
    return stays.unionByName(comes)


def maintained(names: DataFrame, goes: DataFrame, comes: DataFrame) -> DataFrame:
    """names(name, defined, used), the view of cross.token_names over all facts, after facts went and came: only these are counted anew."""
    signed = names.unionByName(cross.token_names(comes))
    signed = signed.unionByName(cross.token_names(goes).select("name", (-F.col("defined")).alias("defined"), (-F.col("used")).alias("used")))
    return signed.groupBy("name").agg(F.sum("defined").alias("defined"), F.sum("used").alias("used")).where("defined <> 0 or used <> 0")


def apply_batch(spark: SparkSession, table: str, changes: DataFrame, globs: tuple[str, ...] = IGNORED) -> None:
    """Rewrite the touched buckets of the stored fact table, and the counts of its tokens by what went and came; changes are read and settled once, and
    texts that were parsed before are not parsed again. Running a batch again gives the same table."""
    with memo.written(latest(changes), f"{table}/settled") as last:
        touched = {r["b"] for r in last.select(bucket("path").alias("b")).distinct().collect()}  # BUCKETS at most
        if not touched:
            return
        number, places = version(spark, table)
        own = _read(spark, sorted(f for b, f in places.items() if b in touched)).drop("bucket")
        stays, goes, comes = exchanged(own, last, globs, lambda sources: memo.parse(sources, f"{table}/memo", str(number + 1)))
        new = stays.unionByName(comes).withColumn("bucket", bucket())
        maintained(read_names(spark, table, number), goes, comes).write.mode("overwrite").parquet(f"{table}/names/{number + 1}")
        folder = f"{table}/data/{uuid.uuid4().hex}"
        new.withColumn("b", F.col("bucket")).write.partitionBy("b").parquet(folder)
        kept = {b: f for b, f in places.items() if b not in touched}
        names = [status.getPath().getName() for status in _files(spark, folder)]
        _publish(spark, table, number + 1, kept | {int(n[2:]): f"{folder}/{n}" for n in names if n.startswith("b=")})
        _forget(spark, table, number - 1)


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _files(spark: SparkSession, folder: str) -> list:
    system, where = _system(spark, folder)
    return list(system.listStatus(where)) if system.exists(where) else []


def version(spark: SparkSession, table: str, number: int | None = None) -> tuple[int, dict[int, str]]:
    """Number of a version (the last one) and the folder of each of its buckets; 0 and none before the first batch."""
    known = [int(s.getPath().getName()) for s in _files(spark, f"{table}/versions") if s.getPath().getName().isdigit()]
    number = max(known, default=0) if number is None else number
    if number not in known:
        return number, {}
    lines = spark.read.option("wholetext", True).text(f"{table}/versions/{number}").first()
    return number, {int(b): f for b, f in json.loads(lines[0]).items()}


def _publish(spark: SparkSession, table: str, number: int, places: dict[int, str]) -> None:
    """A version appears as a whole, by a rename."""
    system, draft = _system(spark, f"{table}/versions/_{uuid.uuid4().hex}")
    out = system.create(draft)
    out.write(bytearray(json.dumps(places).encode()))
    out.close()
    if not system.rename(draft, _system(spark, f"{table}/versions/{number}")[1]):
        raise RuntimeError(f"version {number} of {table} could not be published")


def _forget(spark: SparkSession, table: str, number: int) -> None:
    """Delete an old version and the buckets that only it names; the one before the last stays for its readers."""
    old = version(spark, table, number)[1]
    used = set(version(spark, table)[1].values()) | set(version(spark, table, number + 1)[1].values())
    for path in [f for f in old.values() if f not in used] + [f"{table}/versions/{number}"] * bool(old):
        system, where = _system(spark, path)
        system.delete(where, True)
    if old:
        system, where = _system(spark, f"{table}/names/{number}")
        system.delete(where, True)


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    schema = f"{FACTS}, bucket int"
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_state(spark: SparkSession, table: str) -> DataFrame:
    """The stored fact table in its last version; empty before the first batch."""
    return _read(spark, sorted(version(spark, table)[1].values()))


def read_names(spark: SparkSession, table: str, number: int | None = None) -> DataFrame:
    """name, defined, used: how often the facts of a version (the last one) define and use each token."""
    number = version(spark, table)[0] if number is None else number
    return spark.read.schema(NAMES).parquet(f"{table}/names/{number}") if number else spark.createDataFrame([], NAMES)


def dead_tokens(spark: SparkSession, table: str) -> DataFrame:
    """What cross.dead_tokens finds in the stored facts, from their maintained counts: only places of unused names are looked up."""
    unused = read_names(spark, table).where("defined > 0 and used = 0").select("name")
    return cross.dead_definitions(cross.definitions(read_state(spark, table)).join(unused, "name", "left_semi"))


def watch(changes: DataFrame, table: str, checkpoint: str, each=None, interval: str = "1 second", globs: tuple[str, ...] = IGNORED) -> StreamingQuery:
    """Start a stream that keeps the fact table; `each(state)` is called after every batch. The trigger's interval settles bursts."""

    def batch(frame: DataFrame, _: int) -> None:
        session = frame.sparkSession
        apply_batch(session, table, frame, globs)
        if each is not None:
            each(read_state(session, table).drop("bucket"))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
