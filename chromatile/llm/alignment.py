"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same text.

Both tokenizers encode a text; the running sums of the tokens' byte lengths are where tokens end.
Ends that both have cut the text into groups, and tokens that end together are linked. All of this is
array work on runs of documents in a task. Each document keeps its distinct id pairs with their
numbers of links; these are summed over the corpus in two shuffled stages, the first by pair and a
salt, and each document's links are then weighed by the corpus-wide counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise
from .packing import encoder, token_bytes

#: Texts aligned at once in a task, in bytes; a longer text is aligned alone.
STEP = 1 << 20


@lru_cache(2)
def _tokenizers(byte_level: str, pieces: str):
    """Encoders of both (texts -> ids), the bytes of pieces, byte lengths by id and the texts for digests."""
    import sentencepiece

    encode_a = encoder(byte_level)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    bytes_a = token_bytes(byte_level)
    bytes_b = [_piece_bytes(model.id_to_piece(i)) for i in range(model.get_piece_size())]
    encode_b = lambda texts: [np.array(ids, np.int64) for ids in model.encode(texts, num_threads=1)]
    lengths = [np.array([len(x) for x in table], np.int64) for table in (bytes_a, bytes_b)]
    # For digests: each id with what follows it inside its side of a group, and at the end of that side.
    shown_a = [f"{i}{end}" for i in range(len(bytes_a)) for end in ",|"]
    shown = shown_a + [f"{i}{end}" for i in range(len(bytes_b)) for end in ",;"]
    return encode_a, encode_b, bytes_b, *lengths, shown, len(shown_a)


def _piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: U+2581 stands for a space, <0xHH> for a byte."""
    one = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode()


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends that both have, in order, and how many tokens of each side end there or before."""
    rising = all((np.diff(ends) > 0).all() for ends in (ends_a, ends_b))  # no token without bytes: spares two passes for unique ends
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=rising)
    return cuts, np.searchsorted(ends_a, cuts, "right"), np.searchsorted(ends_b, cuts, "right")


def links_of(ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens (a, b) of every link: all tokens of one side that end at a cut with all of the other side."""
    from_a, from_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    n_b = upto_b - from_b
    pairs = (upto_a - from_a) * n_b
    which = np.repeat(np.arange(len(cuts)), pairs)
    place = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    return from_a[which] + place // n_b[which], from_b[which] + place % n_b[which]


def align_texts(texts: list[str | None], byte_level: str, pieces: str) -> list[dict]:
    """For each text: n_a, n_b, n_groups, n_links, groups_sha256, pair (sorted ids a << 32 | b), times.

    A text that is null, empty, or not given back by both tokenizers with a space in front has no tokens.
    """
    encode_a, encode_b, bytes_b, length_a, length_b, shown, first_b = _tokenizers(byte_level, pieces)
    none = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pair": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
    out, some, a, b, sizes = [none] * len(texts), [], [], [], []
    own = [k for k, text in enumerate(texts) if text]
    for k, ids_b in zip(own, encode_b([texts[k] for k in own]) if own else [], strict=True):
        whole = f" {texts[k]}"
        data, ids_a = whole.encode(), encode_a(whole).astype(np.int64)
        # Byte-level tokens are pieces of the text in order: they give it back whole if they are as long.
        if length_a[ids_a].sum() == len(data) and b"".join(map(bytes_b.__getitem__, ids_b.tolist())) == data:
            some.append(k)
            a.append(ids_a)
            b.append(ids_b)
            sizes.append(len(data))
    if not some:
        return out
    # The texts in a row: each ends where both of its tokenizations end, so no group spans two.
    ids_a, ids_b = np.concatenate(a), np.concatenate(b)
    ends_a, ends_b = np.cumsum(length_a[ids_a]), np.cumsum(length_b[ids_b])
    cuts, upto_a, upto_b = shared_cuts(ends_a, ends_b)
    link_a, link_b = links_of(ends_a, ends_b, cuts, upto_a, upto_b)
    # In digests a token of group g stands after its own side up to it and the other side's groups before (a) or up to g (b).
    closes_a, closes_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    closes_a[upto_a - 1] = closes_b[upto_b - 1] = 1
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    order = np.zeros(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.r_[0, upto_b][group_a]] = 2 * ids_a + closes_a
    order[np.arange(len(ids_b)) + upto_a[group_b]] = first_b + 2 * ids_b + closes_b
    text_ends = np.cumsum(sizes)
    tokens = np.cumsum([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    groups = np.searchsorted(cuts, text_ends, "right")
    links = np.searchsorted(ends_a[link_a], text_ends, "right")
    pair = ids_a[link_a] << 32 | ids_b[link_b]
    for n, k in enumerate(some):
        lead = n - 1
        shown_ids = order[tokens[lead] if n else 0 : tokens[n]]
        found, times = np.unique(pair[links[lead] if n else 0 : links[n]], return_counts=True)
        out[k] = {
            "n_a": len(a[n]), "n_b": len(b[n]), "n_groups": int(groups[n] - (groups[lead] if n else 0)), "n_links": int(links[n] - (links[lead] if n else 0)),
            "groups_sha256": sha256("".join(map(shown.__getitem__, shown_ids.tolist()))[:-1].encode()).hexdigest(), "pair": found, "times": times,
        }
    return out


def aligned(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_a, n_b, n_groups, n_links, groups_sha256, pair array, times array."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < batch.num_rows:
                part, size, end = [], 0, at
                while end < batch.num_rows and size < STEP:
                    part.append(texts[end].as_py())
                    size += len(part[-1] or "")
                    end += 1
                found = align_texts(part, byte_level, pieces)
                offsets = pa.array(np.r_[0, np.cumsum([len(f["pair"]) for f in found])].astype(np.int32))
                columns = [batch.column(0).slice(at, end - at), *[pa.array([f[c] for f in found], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array([f["groups_sha256"] for f in found], pa.string())]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[c] for f in found]))) for c in ("pair", "times")]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "times"])
                at = end

    schema = f"_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, times array<long>"
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def pair_counts(links: DataFrame, salts: int = 16) -> DataFrame:
    """pair, id_a, id_b, count, best: how many links of the corpus hold each id pair, and whether no pair of its b id has more.

    Sums are made on the map side, then by pair and salt (which task they come from), then by pair.
    """
    each = links.select(F.explode(F.arrays_zip("pair", "times")).alias("x"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
    salted = each.groupBy(F.col("x.pair").alias("pair"), "_salt").agg(F.sum("x.times").alias("count"))
    counts = salted.groupBy("pair").agg(F.sum("count").alias("count")).withColumns({"id_a": F.shiftright("pair", 32).cast("int"), "id_b": F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")})
    most = counts.groupBy("id_b").agg(F.max("count").alias("_most"))
    return counts.join(most, "id_b").select("pair", "id_a", "id_b", "count", (F.col("count") == F.col("_most")).alias("best"))


def weigh(links: DataFrame, counts: DataFrame, pairs_per_block: int = 1_000_000) -> DataFrame:
    """``links`` (with ``_row``, a number of their own) with n_best and count_sum instead of their pairs.

    Counts meet the documents in blocks of about ``pairs_per_block`` pairs, each broadcast: no link is shuffled, and
    what tasks add up by document are sums over its links.
    """
    blocks = max(1, -(-counts.count() // pairs_per_block))
    facts = counts.select("pair", "count", "best", F.pmod(F.xxhash64("pair"), F.lit(blocks)).alias("_block"))
    each = links.select("_row", F.explode(F.arrays_zip("pair", "times")).alias("x")).select("_row", "x.pair", "x.times")
    met = [each.join(F.broadcast(facts.filter(F.col("_block") == k).drop("_block")), "pair") for k in range(blocks)]
    sums = reduce(DataFrame.unionByName, met).groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    return links.drop("pair", "times").join(sums, "_row", "left").na.fill(0, ["n_best", "count_sum"])


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, pairs_per_block: int = 1_000_000) -> DataFrame:
    """One row per document: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``byte_level`` (a) is a byte-level BPE file and encodes a space and the text, with added tokens as plain text;
    ``pieces`` (b) is a sentencepiece model that puts that space itself. Null and empty texts, and those that do not come
    back whole from both, have zeros and an empty digest. Rows that repeat count one by one; other columns are not
    read; an empty table gives an empty result.
    """
    links = materialise(aligned(docs, byte_level, pieces, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "links")
    counts = materialise(pair_counts(links, salts), "pairs")
    out = weigh(links, counts, pairs_per_block)
    return out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
