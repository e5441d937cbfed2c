"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's setting by which the shuffle files of a query go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, on one machine (as in tests)
    a temporary folder is made and set as the checkpoint folder; on a cluster this is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chromatile-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/chromatile-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, rows_per_group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage, and what is not repeatable in ``df`` (row numbers) is fixed from then on,
    also when executors are lost later. Nothing reads the shuffle files of the write any more, so
    they go when it ends; else they would stay until the driver collects its garbage.

    Writers hold a row group in memory, and readers decode one at once. Parquet looks at its size only after 100
    rows, so tables of rows of megabytes name ``rows_per_group``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    groups = {} if rows_per_group is None else {"parquet.block.row.count.limit": str(rows_per_group)}
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**groups).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of what ``materialise`` returned, once nothing that is still to run reads it."""
    spark = table.sparkSession
    for folder in {found[0] for f in table.inputFiles() if (found := re.match(r".*/chromatile-[a-z]+-[0-9a-f]{32}(?=/)", f))}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release() -> None:
    """Give what this Python worker has freed back to the system: a worker lives on for the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, and ``release`` when it ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def sample_by_hash(rows: DataFrame, stratum: str, most: int, *hashed: str) -> DataFrame:
    """One row for each of the ``most`` smallest different hashes of the columns ``hashed`` in each stratum (few values, not null).

    Rows that repeat in ``hashed`` count once, however many there are, and exactly ``most`` rows of a
    stratum are taken where it has as many different ones. The limits are found on different hashes, made
    distinct on the map side first, and only among those low enough that about four times ``most`` of a
    stratum are left, so that no task ranks more than these.
    """
    h = F.xxhash64(*hashed)
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy(stratum).agg(F.count(F.lit(1)), F.approx_count_distinct(h, 0.02)).collect()}
    if not counts:
        return rows.limit(0)
    table = lambda of: F.create_map(*[F.lit(x) for k in counts for x in (k, of(k))])[F.col("_stratum")]
    slim, top, scale = rows.select(F.col(stratum).alias("_stratum"), h.alias("_h")), (1 << 63) - 1, 4
    while True:
        low = {k: min(top, (scale * most << 64) // max(1, n) - (1 << 63)) for k, (_, n) in counts.items()}
        ranked = slim.filter(F.col("_h") <= table(low.get)).distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("_stratum").orderBy("_h"))).filter(F.col("_rank") <= most)
        limits = {r[0]: (r[1], r[2]) for r in ranked.groupBy("_stratum").agg(F.max("_h"), F.count(F.lit(1))).collect()}
        if all(low[k] == top or limits.get(k, (0, 0))[1] == most for k in counts):
            break
        scale *= 8
    near = rows.withColumns({"_stratum": F.col(stratum), "_h": h}).filter(F.col("_h") <= table(lambda k: limits[k][0]))
    return near.dropDuplicates(["_stratum", "_h"]).drop("_stratum", "_h")


def power_of_two(n: float) -> int:
    """The smallest power of two that is at least ``n`` (and at least 1)."""
    return 1 << max(0, int(-(-n // 1)) - 1).bit_length() if n > 1 else 1


def running_sum(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str], value: Column, out: str) -> DataFrame:
    """Running sum of ``value`` along ``order`` within ``keys``, this row included.

    ``bucket`` (a whole number) has to follow ``order`` (all rows of a smaller bucket come first), so
    that a key that holds a large part of all rows is dealt over many tasks: sums run inside (keys,
    bucket), and the totals of the buckets before are added. Totals are summed in two levels, 1024
    buckets at once. ``keys`` and ``bucket`` must not be null.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total")).withColumn("_upper", F.floor(F.col(bucket) / 1024))
    upper = totals.groupBy(*keys, "_upper").agg(F.sum("_total").alias("_sum"))
    below = lambda keys, by, what: F.coalesce(F.sum(what).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upper = upper.select(*keys, "_upper", below(keys, "_upper", "_sum").alias("_lower"))
    offsets = totals.withColumn("_before", below([*keys, "_upper"], bucket, "_total")).join(upper, [*keys, "_upper"])
    offsets = offsets.select(*keys, bucket, (F.col("_before") + F.col("_lower")).alias("_before"))
    return df.withColumn("_inside", F.sum(value).over(inside)).join(offsets, [*keys, bucket]).withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before")
