"""The project store: a Parquet snapshot keyed by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(store: DataFrame, changes: DataFrame, key: str = "id", created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """The store after saving ``changes`` (rows as in the store): creation times stay, update times are those of the changes.

    Of several changes of one id the one with the latest update time counts (ties by a hash of the
    row). A ``color_count`` is the size of the ``palette``, where the store has both.
    """
    latest = Window.partitionBy(key).orderBy(F.col(updated).desc(), F.xxhash64(*changes.columns))
    changes = changes.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank")
    if {"palette", "color_count"} <= set(store.columns):
        changes = changes.withColumn("color_count", F.size("palette"))
    old = store.select(F.col(key), F.col(created).alias("_old"))
    saved = changes.join(old, key, "left").withColumn(created, F.coalesce("_old", F.coalesce(created, updated))).select(*store.columns)
    return store.join(changes.select(key), key, "left_anti").select(*store.columns).unionByName(saved)


def with_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    """New random ids (version 4) where there are none; write the result before it is used twice."""
    return rows.withColumn(key, F.coalesce(F.col(key), F.uuid()))


def delete(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return store.join(ids.select(key), key, "left_anti")


def get(store: DataFrame, key_value: object, key: str = "id") -> DataFrame:
    """Point look-up, pushed down to the scan."""
    return store.filter(F.col(key) == F.lit(key_value))


def listing(store: DataFrame, updated: str = "updated_at", key: str = "id") -> DataFrame:
    """Newest first; equal times by key."""
    return store.orderBy(F.col(updated).desc(), key)


def write_snapshot(store: DataFrame, path: str) -> None:
    """A new snapshot (never over the one that is read), sorted by update time inside its files."""
    store.sortWithinPartitions(F.col("updated_at").desc()).write.parquet(path)


def read_json_projects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON files, one project each; malformed ones are skipped; newest first."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path).orderBy(F.col("updated_at").desc())


def restore(store: DataFrame) -> DataFrame:
    """Projects as results again: the palette with Lab and counts of zero."""
    zero = F.struct(F.lit(0.0).alias("L"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    return store.withColumn("palette", F.transform("palette", lambda c: F.struct(c["colorIdx"].alias("idx"), c["hex"].alias("hex"), zero.alias("lab"), F.lit(0).cast("long").alias("pixel_count"))))


def first_of_each(colors: DataFrame, key: str, order: str = "seq", value: str = "color") -> DataFrame:
    """Custom colours without repeats, the first of each kept."""
    return colors.groupBy(key, value).agg(F.min(order).alias(order))


def preferences(raw: str, defaults: dict[str, object], schema: str):
    """Fields of a JSON text; the default for what is missing or malformed."""
    parsed = F.from_json(F.col(raw), schema)
    return [F.coalesce(parsed.getField(name), F.lit(value)).alias(name) for name, value in defaults.items()]
