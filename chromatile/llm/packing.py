"""Best-fit packing by patterns: non-negative least squares over the histogram of piece lengths.

Documents are tokenised once; only slim rows (ids, lengths, checksums) go on. The histogram of the
lengths (at most ``capacity`` counts) is all the driver sees: it fits how often each pattern of up to
three lengths that fill a sequence is used, rounds, and packs what is left best-fit. Each piece
then finds its place by its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import freeing, materialise, power_of_two, release, running_sum

# Fixed value: how byte-level BPE splits a text before it merges where its file names no pattern (as published).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _split_of(model: dict) -> str | None:
    """The pattern by which a file of tokenizers splits texts; None for that of byte-level BPE itself."""
    steps = model.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    found = [x["pattern"]["Regex"] for x in steps if x.get("type") == "Split" and "Regex" in x.get("pattern", {})]
    if model.get("normalizer") or len(found) > 1 or any(x.get("type") not in ("Split", "ByteLevel") or x.get("add_prefix_space") for x in steps):
        raise ValueError("only byte-level BPE with at most one pattern and no normalizer is supported")
    return found[0] if found else None


def _vocabulary(path: str) -> tuple[dict[bytes, int], list[dict], str]:
    """Ranks by token, added tokens and the splitting pattern of a file."""
    import json

    if path.endswith(".tiktoken"):
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, [], SPLIT
    model = json.load(open(path, encoding="utf-8"))
    added = {x["content"] for x in model["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {bytes(chars[c] for c in token): k for token, k in model["model"]["vocab"].items() if token not in added}, model["added_tokens"], _split_of(model) or SPLIT


@lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    """By id the bytes of each token; added tokens and free ids have none."""
    ranks = _vocabulary(path)[0]
    out = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        out[k] = token
    return out


@lru_cache(4)
def encoder(path: str, added: bool = False):
    """A byte-level BPE encoder: text -> uint32 ids.

    ``path`` is a ``.json`` file of tokenizers, or the same vocabulary as ``.tiktoken`` ranks. From a
    ``.json`` file the ranks are derived (the id order of merged tokens is their merge order), which
    gives the same ids faster.

    With ``added``, an added token of the file is one id wherever a text holds it, as tokenizers does
    by default (``add_special_tokens=False`` only keeps it from adding any); the operators use this.
    Without, added tokens in a text are ordinary text. Ranks have no added tokens.
    """
    import tiktoken

    ranks, tokens, split = _vocabulary(path)
    special = {x["content"]: x["id"] for x in tokens}
    if added and (any(x.get("single_word") or x.get("lstrip") or x.get("rstrip") or re.search(r"\s", x["content"]) for x in tokens) or any(a != b and b.startswith(a) for a in special for b in special)):
        raise ValueError(f"added tokens that take in or hold white space, need word ends or begin others are not supported: {path}")
    encoding = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens=special if added else {})
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: id, piece, start, length, ids_crc32 (and ids with ``keep_ids``).

    A document is its ids and ``end_id``; null text is the empty text, so each has at least one id.
    One longer than ``capacity`` is cut into pieces of ``capacity``, the first of which may be shorter.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, added=True)
        release()  # what reading the file took
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, cols = [], [[] for _ in range(5)]
                part = batch.slice(at, 256)
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                        start = max(0, end - capacity) if piece else 0
                        data = ids[start:end].tobytes()
                        keys.append(row)
                        for column, x in zip(cols, (piece, start, end - start, zlib.crc32(data), ids[start:end] if keep_ids else None), strict=True):
                            column.append(x)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [part.column(0).take(pa.array(keys, pa.int32())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]]
                if keep_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in cols[4]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["key", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    schema = f"key {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(freeing(cut), schema).withColumnRenamed("key", id_col)


def patterns_of(capacity: int, present: np.ndarray) -> np.ndarray:
    """All (a, b, c), a >= b >= c, of lengths that fill ``capacity`` exactly; 0 stands for none. present: bool by length."""
    a, b = np.meshgrid(np.arange(1, capacity + 1), np.arange(capacity + 1), indexing="ij")
    c = capacity - a - b
    fits = (c >= 0) & (a >= b) & (b >= c)
    out = np.stack([a[fits], b[fits], c[fits]], axis=1)
    have = present.copy()
    have[0] = True
    return out[have[out].all(axis=1)]


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, power: float = 0.0, steps: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, A the pattern matrix: accelerated projected gradient.

    Errors of a length weigh as its ``power``: with 0 all the same, with more the long pieces most.
    """
    size = len(histogram)
    apply = lambda x: np.bincount(patterns.ravel(), np.repeat(x, 3), size)
    weight = (np.arange(size) / size) ** power
    weight[0] = 0.0  # nothing is wanted of the empty slots
    back = lambda r: (r * weight)[patterns].sum(axis=1)
    v = np.ones(len(patterns))
    for _ in range(30):
        v = back(apply(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - back(apply(y) - histogram) / (1.05 * norm))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (last - 1) / t * (new - x)
    return x


#: How errors of the fit are weighted, and what share of the fitted counts is used; the best of these plans counts.
POWERS = (0.0, 1.0, 2.0)
SHARES = (1.0, 0.75, 0.5, 0.25)


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use every piece of the histogram once.

    ``histogram[l]`` counts the pieces of length l, l up to the capacity. Costs depend on the
    capacity, not on the number of pieces. Where short pieces are many, patterns of few pieces would
    use up what fills the gaps beside the long ones: then a smaller share of the fitted counts, and a
    fit that weighs long pieces more, needs fewer sequences.
    """
    patterns = patterns_of(len(histogram) - 1, histogram > 0)
    if not len(patterns):
        return _planned(histogram, patterns, np.zeros(0))
    fits = [fit_counts(patterns, histogram.astype(float), power) for power in POWERS]
    plans = (_planned(histogram, patterns, fitted * share) for share in SHARES for fitted in fits)
    return min(plans, key=lambda found: sum(times for _, times in found))


def _planned(histogram: np.ndarray, patterns: np.ndarray, fitted: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """The rounded counts of patterns as far as there are pieces, most used ones first; then the rest, best-fit."""
    capacity, left = len(histogram) - 1, histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    used = np.flatnonzero(fitted >= 0.5)
    for k in used[np.argsort(-fitted[used], kind="stable")]:
        lengths = tuple(int(x) for x in patterns[k] if x)
        times = min(int(np.rint(fitted[k])), *(int(left[x]) // lengths.count(x) for x in lengths))
        if times > 0:
            out.append((lengths, times))
            for x in lengths:
                left[x] -= times
    space: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            room = min((r for r, groups in space.items() if groups and r >= length), default=None)
            lengths, times = space[room].pop() if room is not None else ((), count)
            now = min(times, count)
            if now < times:
                space[room].append((lengths, times - now))
            space[(capacity if room is None else room) - length].append(((*lengths, length), now))
            count -= now
    return out + [x for _, groups in sorted(space.items()) for x in groups]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, rows_per_bucket: int = 20_000) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there (see ``tokenised``).

    Sequences hold at most ``capacity`` ids, without gaps. Null texts are one piece of ``end_id``;
    null or repeated ids and repeated rows are documents of their own. An empty table gives an empty
    result; other columns are not read.
    """
    pieces = tokenised(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids).withColumn("_row", F.monotonically_increasing_id())
    pieces = materialise(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = pieces.filter(F.col("length") == capacity).select("*", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n if length < capacity else 0
    slots, number = [], 0
    taken = np.zeros(capacity + 1, np.int64)
    for lengths, times in plan(histogram):
        offset = 0
        for length in lengths:
            slots.append((length, int(taken[length]), number, offset))
            taken[length] += times
            offset += length
        number += times
    slots.sort()
    lengths, firsts, numbers, offsets = (np.array([s[k] for s in slots], np.int64) for k in range(4))
    starts = np.searchsorted(lengths, np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.empty(len(rank), np.int64)
            for x in np.unique(length):
                own = length == x
                at[own] = starts[x] + np.searchsorted(firsts[starts[x] : starts[x + 1]], rank[own], "right") - 1
            names = [c for c in batch.schema.names if c != "_rank"]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(numbers[at] + rank - firsts[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    buckets = max(64, power_of_two(sum(counts.values()) / rows_per_bucket))
    rest = pieces.filter(F.col("length") < capacity).withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    ranked = running_sum(rest, ["length"], "_bucket", ["_row"], F.lit(1), "_rank").withColumn("_rank", F.col("_rank") - 1).select(*pieces.columns, "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return full.unionByName(ranked.mapInArrow(place, schema)).drop("_row")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences, from ``pack(keep_ids=True)``: sequence_id and its ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
