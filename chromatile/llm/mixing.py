"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is shuffled (by a hash of ids and texts) and queued ``epochs`` times over. A copy's virtual
finish time is the source's words up to its end divided by the source's weight. All copies are range
sorted by that time; the mix is the prefix that fits the budget: sources advance in proportion to
their weights, and one that is used up leaves its share to the others. Only slim rows are sorted;
sums run inside the slices of the sort, to which the totals of the slices before are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD_CLASS, materialise, power_of_two, running_sum

#: Weights by rank of the source (code point order, null last), repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of runs of other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD_CLASS}+")), F.lit(0)).cast("long")


def _order(name: str, id_col: str, text_col: str, seed: int) -> Column:
    """A shuffled place of a document: 60 bits of the MD5 of its id and text."""
    identity = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(identity), 1, 15), 16, 10).cast("long").alias(name)


def source_targets(sizes: DataFrame, share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From rows (_none, _source, _size), a row per source: its weight, source_size and target.

    Targets share ``share`` times all words by weight, stop at ``epochs`` times the source's size,
    and the excess goes to the others by weight until none is above (water filling in closed form,
    over the sources sorted by the level at which each is used up).
    """
    by_name = Window.orderBy("_none", "_source")
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("double")
    table = sizes.groupBy("_none", "_source").agg(F.sum("_size").alias("source_size")).withColumn("_weight", weight)
    full = F.col("source_size") * float(epochs)
    filling = Window.orderBy(full / F.col("_weight"), "_none", "_source")
    used = F.coalesce(F.sum(full).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(Window.partitionBy()) * share
    level = (budget - used) / left
    table = table.withColumns({"_level": level, "_full": full, "_budget": budget})
    open_ = F.col("_level") <= F.col("_full") / F.col("_weight")
    cut = F.min(F.when(open_, F.struct(F.col("_full") / F.col("_weight"), F.col("_level").alias("level")))).over(Window.partitionBy())
    target = F.least(F.col("_full"), F.col("_weight") * F.coalesce(cut["level"], F.lit(float("inf"))))
    return table.select("_none", "_source", "_weight", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(target).alias("target"))


#: Order of the copies in the queue; the finish time first.
QUEUE = ("finish_time", "_none", "_source", "_place", "_key", "_epoch")


def queue(placed: DataFrame, epochs: int) -> DataFrame:
    """All copies of ``placed`` in global order: rows with finish_time, and end, the words up to the copy's end."""
    finish = (F.col("source_size") * F.col("_epoch") + F.col("_end")) / F.col("_weight")
    copies = placed.filter("_size > 0").select("*", F.explode(F.array(*[F.lit(e) for e in range(epochs)])).alias("_epoch")).withColumn("finish_time", finish)
    slices = materialise(copies.repartitionByRange(*QUEUE).withColumn("_slice", F.spark_partition_id()), "queue")
    return running_sum(slices, [], "_slice", QUEUE, F.col("_size"), "end")


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, share: float, epochs: int, weights: tuple[int, ...], seed: int, rows_per_bucket: int) -> DataFrame:
    """Slim rows of the documents with _end, the words of the source up to the document's end in its shuffled order."""
    slim = docs.select(F.col(id_col).alias("_key"), F.col(source_col).isNull().alias("_none"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"), word_count(F.col(text_col)).alias("_size"), _order("_place", id_col, text_col, seed), F.xxhash64(text_col).alias("_mark"), F.monotonically_increasing_id().alias("_row"))
    slim = materialise(slim, "sizes")
    buckets = max(1024, power_of_two(slim.count() / rows_per_bucket))
    sources = materialise(source_targets(slim, share, epochs, weights), "sources")
    slim = slim.withColumn("_bucket", F.floor(F.col("_place") / (2.0**60 / buckets)))
    placed = running_sum(slim, ["_none", "_source"], "_bucket", ["_place", "_key", "_size", "_row"], F.col("_size"), "_end").join(sources, ["_none", "_source"])
    return materialise(placed.drop("_bucket"), "placed")


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 0, rows_per_bucket: int = 5_000) -> DataFrame:
    """The slim rows of the documents with copies, and the finish times of the first copy and between copies."""
    placed = _placed(docs, id_col, text_col, source_col, share, epochs, weights, seed, rows_per_bucket)
    total = placed.agg(F.sum("_size")).first()[0] or 0
    within = queue(placed, epochs).filter(F.col("end") <= total * share)
    copies = materialise(within.groupBy("_row").agg(F.count(F.lit(1)).cast("int").alias("copies")), "copies")
    taken = placed.join(copies, "_row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return taken.withColumns({"finish_time": F.when(F.col("_size") > 0, F.col("_end") / F.col("_weight")), "_cycle": F.col("source_size") / F.col("_weight")})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, copies, taken (words with repeats) and finish_time.

    Options: ``share`` (1.5) of all words that the mix holds, ``epochs`` (2) at most of any document,
    ``weights`` by rank of the source, ``seed``, ``rows_per_bucket``. A null text has size 0; a null
    source is a source of its own, ranked last. Documents of size 0 are never taken. Rows that repeat
    an id are separate documents; null ids are ids like any other. The mix holds whole documents, so
    the words of a source differ from its target by about one document. finish_time is that of the
    first copy (null for size 0). Reruns give the same rows. An empty table gives an empty result.
    """
    return _taken(docs, id_col, text_col, source_col, **options).select(F.col("_key").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"), "finish_time")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", broadcast_rows: int = 1_000_000, ordered: bool = False, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, 0 to ``epochs`` times.

    Rows that repeat an id and its text are taken as often as the most taken of them. The table of
    what is taken is broadcast up to ``broadcast_rows`` rows; beyond that the documents are shuffled
    by id. With ``ordered``, rows are sorted by finish time, as the queue deals them, which shuffles
    the documents.
    """
    taken = _taken(docs, id_col, text_col, source_col, **options).filter("copies > 0")
    copies = taken.groupBy("_key", "_mark").agg(F.max("copies").alias("_copies"), F.min("finish_time").alias("_first"), F.min("_cycle").alias("_cycle"))
    copies = materialise(copies, "copies")
    copies = F.broadcast(copies) if copies.count() <= broadcast_rows else copies
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.xxhash64(docs[text_col]).alias("_own"))
    joined = held.join(copies, F.col("_doc").getField(id_col).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_mark")))
    out = joined.select("_doc", "_first", "_cycle", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_epoch"))
    return (out.orderBy(F.col("_first") + F.col("_epoch") * F.col("_cycle")) if ordered else out).select("_doc.*")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS place
  FROM documents
), g AS (SELECT none, source, sum(size) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY none, source) - 1) % 3 + 1] AS DOUBLE) AS weight,
             CAST(source_size * 2 AS DOUBLE) AS cap, sum(source_size) OVER () * 1.5 AS budget FROM g),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, none, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, none, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
s AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap, weight * arg_min(level, cap / weight) FILTER (level <= cap / weight) OVER ()) END AS target FROM l),
p AS (SELECT d.*, source_size, weight, target, budget,
             sum(size) OVER (PARTITION BY d.none, d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS fin
      FROM d JOIN s ON d.none = s.none AND d.source = s.source),
q AS (SELECT *, (source_size * e + fin) / weight AS t FROM p, (VALUES (0), (1)) AS x(e) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY t, none, source, place, doc_id, e ROWS UNBOUNDED PRECEDING) AS total FROM q),
k AS (SELECT doc_id, none, source, place, size, count(*) AS copies FROM r WHERE total <= budget GROUP BY ALL)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(coalesce(copies, 0) AS INTEGER) AS copies, CAST(coalesce(copies, 0) * p.size AS BIGINT) AS taken,
       CASE WHEN p.size > 0 THEN fin / weight END AS finish_time
FROM p LEFT JOIN k ON p.doc_id = k.doc_id
"""
