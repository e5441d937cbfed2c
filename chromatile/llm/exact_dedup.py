"""Exact duplicates by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 counts, for a blocked Bloom filter (blocks of 32,768 bits, two bits a row), which bits are hit
by at least two rows; only (block, bit) pairs are shuffled for it, pre-aggregated on the map side.
Pass 2 tests each row: a row of which not both bits are hit twice has no equal and passes straight
through. Only the others are shuffled by their digest. A filter that would be too large to broadcast
is made in rounds, each for one range of digests, so this holds at any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, discard, materialise, new_path, power_of_two

#: Bits in a block: what bitmap_construct_agg holds.
BLOCK_BITS = 32_768


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")


def _bits(df: DataFrame, digest: str, blocks: int) -> DataFrame:
    h, g = F.xxhash64(digest), F.xxhash64(digest, F.lit(1))
    at = lambda shift: F.pmod(F.shiftrightunsigned(g, shift), F.lit(BLOCK_BITS)).cast("int")
    return df.withColumns({"_block": F.pmod(h, F.lit(blocks)), "_p": at(0), "_q": at(32)})


def _range(digest: str, rounds: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(2)), F.lit(rounds)).cast("int")


def _is_set(bitmap: str, position: str) -> Column:
    byte = F.substring(F.col(bitmap), F.expr(f"{position} div 8 + 1"), F.lit(1))
    return F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr(f"shiftleft(1, {position} % 8)")) != 0


def _flagged(df: DataFrame, digest: str, blocks: int) -> DataFrame:
    bits = _bits(df.select(digest), digest, blocks).select("_block", F.explode(F.array_distinct(F.array("_p", "_q"))).alias("_bit"))
    twice = bits.groupBy("_block", "_bit").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    table = twice.repartition("_block").groupBy("_block").agg(F.bitmap_construct_agg(F.col("_bit")).alias("_map"))
    tested = _bits(df, digest, blocks).join(F.broadcast(table), "_block", "left")
    return tested.withColumn("_maybe", F.coalesce(_is_set("_map", "_p") & _is_set("_map", "_q"), F.lit(False))).drop("_block", "_p", "_q", "_map")


def possibly_repeated(df: DataFrame, digest: str, bits_per_row: int = 16, broadcast_limit: int = 64 << 20) -> DataFrame:
    """Add ``_maybe``: false only where no other row of ``df`` has the same ``digest`` (not null).

    The filter takes ``bits_per_row`` bits a row and is broadcast. If its size, known from the number
    of rows, is over ``broadcast_limit`` bytes, there are rounds: each makes and broadcasts the filter
    of one range of digests and writes the flagged rows of that range, so ``df`` should be a slim table.
    """
    size = df.count() * bits_per_row / 8
    rounds = max(1, -int(-size // broadcast_limit))
    blocks = power_of_two(size / rounds / (BLOCK_BITS // 8))
    if rounds == 1:
        return _flagged(df, digest, blocks)
    spark, path = df.sparkSession, new_path(df.sparkSession, "ranges")
    ranged = df.withColumn("_range", _range(digest, rounds))
    files = max(1, broadcast_limit >> 22)  # a range: about 128 MB each
    ranged.repartition(rounds * files, "_range", F.pmod(F.xxhash64(digest, F.lit(3)), F.lit(files))).write.partitionBy("_range").parquet(path)  # a round reads its range alone, a few files
    held = spark.read.schema(df.withColumn("_range", F.lit(0)).schema).parquet(path)
    found = [materialise(_flagged(held.filter(F.col("_range") == k).drop("_range"), digest, blocks), "flagged") for k in range(rounds)]
    discard(held)
    return reduce(DataFrame.unionByName, found)


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, broadcast_limit: int = 64 << 20) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space runs became one space; null counts as empty, so
    null and empty texts are copies of each other. The row with the smallest id stays; null ids come
    last, and of rows that repeat both id and text exactly one has ``kept``. An empty table gives an
    empty result; other columns of ``docs`` are not read.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("_sha"), F.monotonically_increasing_id().alias("_row"))
    slim = materialise(slim, "digests")
    flagged = possibly_repeated(slim, "_sha", bits_per_row, broadcast_limit)
    out = lambda keep, n, kept: [F.col("_id").alias(id_col), keep.alias("keep_id"), n.cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")]
    rest = flagged.filter(~F.col("_maybe")).select(*out(F.col("_id"), F.lit(1), F.lit(True)))
    repeated = flagged.filter("_maybe").select("_id", "_sha", "_row")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    # As a table of its own, the groups get an exchange of their own, so that a skewed join is split.
    groups = materialise(repeated.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")), "groups")
    return rest.unionByName(repeated.join(groups, "_sha").select(*out(F.col("_first.id"), F.col("_n"), F.col("_row") == F.col("_first.row"))))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, broadcast_limit: int = 64 << 20, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the smallest id, null ids last.

    Groups of two or more are found on slim rows, as in ``find_copies``. Their table is broadcast up to
    ``broadcast_rows`` groups, and then no document is shuffled; beyond that, documents that its
    Bloom filter does not hold pass straight through, and the others are joined to it. A filter of more than
    ``broadcast_limit`` bytes is made by ranges of digests: ``docs`` is read once for each range, and tested by the
    filter of that range, which is never fuller than ``bits_per_row`` says. Ties of the id are broken by a hash of the whole row; of rows that repeat
    entirely one stays.
    """
    names = docs.columns
    digest = F.unhex(F.sha2(normalised(docs[text_col]), 256))
    mark = F.xxhash64(F.struct(*[docs[c] for c in names]))
    slim = materialise(docs.select(docs[id_col].alias("_id"), digest.alias("_sha"), mark.alias("_mark")), "digests")
    maybe = possibly_repeated(slim, "_sha", bits_per_row, broadcast_limit).filter("_maybe")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_mark").alias("mark"))
    rows = maybe.groupBy("_sha", order.alias("_order")).agg(F.count(F.lit(1)).alias("_times"))
    groups = rows.groupBy("_sha").agg(F.min(F.struct("_order", "_times")).alias("_first"), F.sum("_times").alias("_n")).filter("_n > 1")
    groups = materialise(groups.select(F.col("_sha").alias("_group"), F.col("_first._order").alias("_kept"), F.col("_first._times").alias("_times")), "groups")
    discard(slim)
    held = docs.select(F.struct(*[docs[c] for c in names]).alias("_doc"), digest.alias("_sha"))
    n, straight = groups.count(), []
    if n > broadcast_rows:
        rounds = max(1, -int(-n * bits_per_row / 8 // broadcast_limit))
        blocks, inside = power_of_two(n * bits_per_row / 8 / rounds / (BLOCK_BITS // 8)), []
        for k in range(rounds):
            own = lambda df, digest, k=k: df.filter(_range(digest, rounds) == k) if rounds > 1 else df
            bits = _bits(own(groups, "_group").select("_group"), "_group", blocks).select("_block", F.explode(F.array("_p", "_q")).alias("_bit"))
            table = bits.repartition("_block").groupBy("_block").agg(F.bitmap_construct_agg(F.col("_bit")).alias("_map"))
            tested = _bits(own(held, "_sha"), "_sha", blocks).join(F.broadcast(table), "_block", "left").withColumn("_in", F.coalesce(_is_set("_map", "_p") & _is_set("_map", "_q"), F.lit(False)))
            straight.append(tested.filter("NOT _in").select("_doc.*"))
            inside.append(tested.filter("_in").select("_doc", "_sha"))
        held = reduce(DataFrame.unionByName, inside)
    found = held.join(groups if n > broadcast_rows else F.broadcast(groups), F.col("_sha") == F.col("_group"), "left")
    identity = F.col("_doc").getField(id_col)
    own = F.struct(identity.isNull().alias("none"), identity.alias("id"), F.xxhash64("_doc").alias("mark"))
    kept = found.filter(F.col("_group").isNull() | (own.eqNullSafe(F.col("_kept")) & (F.col("_times") == 1))).select("_doc.*")
    out = [*straight, kept]
    if groups.filter("_times > 1").take(1):
        again = found.filter(own.eqNullSafe(F.col("_kept")) & (F.col("_times") > 1))
        out.append(again.groupBy("_sha").agg(F.min_by("_doc", F.xxhash64("_doc")).alias("_doc")).select("_doc.*"))
    return reduce(DataFrame.unionByName, out)


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
