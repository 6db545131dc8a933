"""Tables made of segments, for state and tables that streams keep changing.

A segment is a folder of Parquet files that is never changed. A manifest per version lists the
segments that count, with their bucket, time span and rows, so a writer adds, replaces or
drops some of them and leaves the others where they are, and a reader takes the newest
manifest, or only the segments that it needs. A manifest appears by renaming a finished file;
a batch that runs again starts from the manifest before its own and writes its own anew.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seawake import config as C
from seawake.session import child_ages, child_names, delete_path, path_of

BUCKET = "bucket"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
MANIFESTS, DATA = "_manifests", "data"
OF = "-of-"


class Segment(NamedTuple):
    """``folder`` is below the table. Times are microseconds; -1 where there is no time column."""

    folder: str
    bucket: int
    low: int
    high: int
    rows: int


def bucket_of(*keys: str, buckets: int = C.STATE_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucket_here() -> Column:
    """The bucket of the segment that a row has been read from."""
    return F.regexp_extract("_metadata.file_path", f"/{BUCKET}=([0-9]+)/", 1).cast("int")


# --- manifests ---------------------------------------------------------------
def manifest_versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in child_names(spark, f"{path}/{MANIFESTS}") if n.endswith(".json"))


def segments_of(spark: SparkSession, path: str, before: int | None = None) -> list[Segment]:
    """Segments of the newest version, or of the newest one below ``before``."""
    versions = [v for v in manifest_versions(spark, path) if before is None or v < before]
    if not versions:
        return []
    file, fs = path_of(spark, f"{path}/{MANIFESTS}/{versions[-1]:012d}.json")
    stream = fs.open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [Segment(*s) for s in json.loads(text)]


def commit(spark: SparkSession, path: str, version: int, segments: Iterable[Segment], keep: int = 3, keep_s: int = C.VERSION_KEPT_S) -> None:
    """Makes these segments the version. Older manifests than the last ``keep`` go once they are
    older than ``keep_s``, and with them the folders that no manifest lists any more."""
    name = f"{path}/{MANIFESTS}/{version:012d}.json"
    draft, fs = path_of(spark, f"{name}.{time.time_ns()}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(sorted(segments)).encode()))
    out.close()
    final, _ = path_of(spark, name)
    fs.delete(final, False)
    if not fs.rename(draft, final):
        raise OSError(f"cannot write {name}")
    clean(spark, path, version, keep, keep_s)


def clean(spark: SparkSession, path: str, version: int, keep: int, keep_s: int) -> None:
    ages = child_ages(spark, f"{path}/{MANIFESTS}")
    known = [v for v in manifest_versions(spark, path) if v < version]
    gone = [v for v in known[: -keep or None] if ages.get(f"{v:012d}.json", 0) > keep_s]
    if not gone:
        return
    dropped = {s.folder for v in gone for s in segments_of(spark, path, before=v + 1)}
    for v in gone:
        delete_path(spark, f"{path}/{MANIFESTS}/{v:012d}.json")
    listed = {s.folder for v in manifest_versions(spark, path) for s in segments_of(spark, path, before=v + 1)}
    for folder in dropped - listed:
        delete_path(spark, f"{path}/{folder}")


# --- rows --------------------------------------------------------------------
def read_segments(spark: SparkSession, path: str, segments: list[Segment], schema: T.StructType) -> DataFrame:
    """The rows of these segments; only their folders are opened."""
    folders = [f"{path}/{s.folder}" for s in segments if s.rows]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append_segment(rows: DataFrame, path: str, version: int, ts: str, cluster: list[str] = (), part: str = "") -> list[Segment]:
    """Writes rows as one segment, by as many tasks as they have; its span is observed meanwhile."""
    folder, seen = f"{DATA}/{version:012d}{part}", Observation()
    us = F.unix_micros(ts)
    watched = rows.observe(seen, F.min(us).alias("low"), F.max(us).alias("high"), F.count("*").alias("rows"))
    watched.sortWithinPartitions(*(cluster or [ts])).write.mode("overwrite").parquet(f"{path}/{folder}")
    return [Segment(folder, -1, seen.get["low"], seen.get["high"], seen.get["rows"])] if seen.get["rows"] else []


def write_segments(
    rows: DataFrame,
    path: str,
    version: int,
    ts: str | None = None,
    cluster: list[str] = (),
    by: str = BUCKET,
    part: str = "",
    spread: bool = False,
    dealt: bool = False,
) -> list[Segment]:
    """Writes rows as segments of a version, one per value of the integer column ``by``: a file
    each, or with ``spread`` files of ranges of ``cluster``, so that no value meets in one
    task. Rows that are ``dealt`` already, so that a task has few values, are written by the
    tasks that have them, neither shuffled nor sorted. What was written is counted where it lies."""
    spark, folder = rows.sparkSession, f"{DATA}/{version:012d}{part}"
    writers = spark.conf.get(WRITERS)
    if dealt:
        spark.conf.set(WRITERS, C.STATE_BUCKETS)  # else each task sorts its rows by ``by``
    else:
        rows = (rows.repartitionByRange(by, *cluster) if spread else rows.repartition(by)).sortWithinPartitions(by, *cluster)
    try:
        rows.write.mode("overwrite").partitionBy(by).parquet(f"{path}/{folder}")
    finally:
        spark.conf.set(WRITERS, writers)
    if not [n for n in child_names(spark, f"{path}/{folder}") if n.startswith(f"{by}=")]:
        return []
    span = [F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))] if ts else [F.lit(-1), F.lit(-1)]
    found = spark.read.parquet(f"{path}/{folder}").groupBy(by).agg(*span, F.count("*")).collect()  # a row per segment
    return [Segment(f"{folder}/{by}={r[0]}", r[0], r[1], r[2], r[3]) for r in found]


def upsert(
    rows: DataFrame,
    path: str,
    version: int,
    schema: T.StructType,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    keys: list[str],
    also: set[int] = frozenset(),
    **options,
) -> list[Segment]:
    """Merges rows into a table that is dealt to buckets by ``keys``: ``merge(known, rows)`` gets
    what is known in the buckets that the rows fall into, or that ``also`` names, and only
    these are written anew. Returns the segments written."""
    spark = rows.sparkSession
    known, touched = segments_of(spark, path, before=version), buckets_of(rows, *keys) | also
    if not touched:
        return []
    old = read_segments(spark, path, [s for s in known if s.bucket in touched], schema)
    merged = merge(old, rows).select(*schema.fieldNames()).withColumn(BUCKET, bucket_of(*keys))
    new = write_segments(merged, path, version, cluster=keys)
    commit(spark, path, version, [s for s in known if s.bucket not in touched] + new, **options)
    return new


def buckets_of(rows: DataFrame, *keys: str) -> set[int]:
    """The buckets that the rows fall into: at most a number per bucket comes to the driver."""
    return {r[0] for r in rows.select(bucket_of(*keys)).distinct().collect()}


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, buckets: set[int], before: int | None = None) -> DataFrame:
    return read_segments(spark, path, [s for s in segments_of(spark, path, before) if s.bucket in buckets], schema)


def read_newest(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    return read_segments(spark, path, segments_of(spark, path, before), schema)


def derive(spark: SparkSession, source: str, schema: T.StructType, path: str, version: int, make: Callable[[DataFrame], DataFrame]) -> list[Segment]:
    """Keeps a table of ``make(rows)`` in step with a bucketed one: only what was made of
    segments that the source no longer has is dropped, and only new ones are worked on."""
    there, have = segments_of(spark, source), segments_of(spark, path, before=version)
    made = {s.folder.replace(s.folder[s.folder.index(OF) : s.folder.index("/", len(DATA) + 1)], ""): s for s in have}
    kept, new = [made[s.folder] for s in there if s.folder in made], [s for s in there if s.folder not in made]
    written = []
    for own in sorted({s.folder.split("/")[1] for s in new}):
        some = {s.bucket: s for s in new if s.folder.split("/")[1] == own}
        rows = make(read_segments(spark, source, list(some.values()), schema).withColumn(BUCKET, bucket_here()))
        part = f"{own[12:]}{OF}{version:012d}"
        found = {s.bucket: s for s in write_segments(rows, path, int(own[:12]), part=part, dealt=True)}
        # a segment without rows says that there is nothing to be made of its source
        written += [found.get(b, Segment(f"{DATA}/{own[:12]}{part}/{BUCKET}={b}", b, -1, -1, 0)) for b in some]
    commit(spark, path, version, kept + written)
    return written


# --- tables in time ------------------------------------------------------------
#: Versions of a table in time count batches in these steps; maintenance takes the numbers between.
STEP = 1000


def append_batch(rows: DataFrame, path: str, batch_id: int, ts: str, cluster: list[str]) -> None:
    """Adds the rows of a micro-batch as a segment. A repeated batch writes the same segment and
    manifest again; segments that maintenance has merged meanwhile stay merged."""
    spark, version = rows.sparkSession, (batch_id + 1) * STEP
    known = segments_of(spark, path, before=version)
    commit(spark, path, version, known + append_segment(rows, path, version, ts, cluster))


def read_span(spark: SparkSession, path: str, schema: T.StructType, ts: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows from ``low`` to before ``high``, in microseconds. Segments outside are not opened, and
    of the others the bounds reach the scan."""
    segments = segments_of(spark, path)
    if low is not None:
        segments = [s for s in segments if s.high >= low]
    if high is not None:
        segments = [s for s in segments if s.low < high]
    rows = read_segments(spark, path, segments, schema)
    if low is not None:
        rows = rows.where(F.col(ts) >= F.timestamp_micros(F.lit(low)))
    return rows if high is None else rows.where(F.col(ts) < F.timestamp_micros(F.lit(high)))


def _next(spark: SparkSession, path: str) -> int:
    version = manifest_versions(spark, path)[-1] + 1
    if version % STEP == 0:
        raise RuntimeError(f"maintenance of {path} has run {STEP - 1} times since its last batch")
    return version


def compact(
    spark: SparkSession, path: str, schema: T.StructType, ts: str, cluster: list[str], slice_s: int = C.SLICE_S, small_rows: int = C.SMALL_SEGMENT_ROWS, **options
) -> int:
    """Merges small segments into one per time slice, in files clustered by ``cluster``, so that a
    reader of few ships skips most row groups. One manifest swaps them: a reader sees the
    table before or after. If a batch commits meanwhile, its manifest wins and the merge is
    without effect. Returns the number of segments merged."""
    known = segments_of(spark, path)
    small = [s for s in known if s.rows < small_rows]
    if len(small) < 2:
        return 0
    version, part = _next(spark, path), F.floor(F.unix_micros(ts) / (slice_s * 1_000_000)).cast("int")
    rows = read_segments(spark, path, small, schema).withColumn("slice", part)
    merged = write_segments(rows, path, version, ts, cluster, by="slice", spread=True)
    commit(spark, path, version, [s for s in known if s not in small] + [s._replace(bucket=-1) for s in merged], **options)
    return len(small)


def expire(spark: SparkSession, path: str, schema: T.StructType, ts: str, limit: int, cluster: list[str], keep: int = 0, keep_s: int = C.VERSION_KEPT_S) -> int:
    """Removes rows older than ``limit`` (microseconds). Segments that end before it are dropped as
    a whole; what is left of those around it is written anew, which is little, as segments
    are short. Files go when the manifests that list them do. Returns the segments gone."""
    known = segments_of(spark, path)
    around = [s for s in known if s.low < limit <= s.high]
    gone = [s for s in known if s.high < limit]
    if not gone and not around:
        return 0
    version = _next(spark, path)
    rest = read_segments(spark, path, around, schema).where(F.col(ts) >= F.timestamp_micros(F.lit(limit)))
    new = append_segment(rest, path, version, ts, cluster) if around else []
    commit(spark, path, version, [s for s in known if s.high >= limit and s not in around] + new, keep, keep_s)
    return len(gone) + len(around)
