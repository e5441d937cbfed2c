"""N-gram Jaccard join: size-banded tiles, bit signatures, exact sorted-array intersection.

Documents are sets of hashed word shingles. Equal sets collapse to one class. Two sets that are
similar enough share a shingle among the first ``n - ceil(t * n) + 1`` of either, in any order common
to all sets (prefix filter). Here frequent shingles come last, so passages that many documents share
rarely lead two classes into one group. A group holds the classes that share such a shingle; its
classes of one size band (and of the next) are compared in tiles, where the bit counts of the
signatures bound the overlap from above before sorted arrays are intersected.

Only what is connected is asked for, so not all pairs are needed. First every class meets the pivot
of its group and band, the class with the smallest key: that costs a row a membership and connects
families of near copies. Then tiles compare what is not yet connected: the classes of the largest
part of a group only with the others, never among themselves. A tile returns the classes that may
have a partner, with the two closest of each; these are tried. Of what is left, a class with few
possible partners in a tile names them all, and a pair is tried once, however many tiles name it; the
sets of the others meet in the tile, which returns a spanning forest of their links: never its pairs.

Links are exact for 64-bit hashes of shingles, and equal sets are told by 64-bit names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, freeing, materialise

WORDS = 5
SIMILARITY = 75  # percent
#: Counters by which frequent shingles are told; a fixed size, whatever the input.
COUNTERS = 1 << 22
_COUNTERS_PER_ROW = 1 << 14
_COUNTER = np.uint64(42)  # a counter's number is the top bits of a hash
#: Parts of a set by which places of shingles are told.
PARTS = 56
#: Classes and shingles in a block of a tile, about.
TILE_ROWS = 256
TILE_SHINGLES = 1 << 20
#: Text that is hashed at once.
SLICE_BYTES = 1 << 21

_U = np.uint64
_FACTORS = [_U(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)]
_BYTE_HASH = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
for _c in range(65, 91):
    _BYTE_HASH[_c] = _BYTE_HASH[_c + 32]
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _hash_slice(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    empty = np.zeros(0, _U)
    docs = len(offsets) - 1
    solid = ~_WHITE[data]
    if not solid.any():
        return [empty] * docs
    before = np.concatenate([[False], solid[:-1]])
    edges = offsets[offsets < len(data)]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    letters = _BYTE_HASH[data[solid]]
    first = np.cumsum(solid)[starts] - 1
    lengths = np.diff(np.append(first, len(letters)))
    powers = np.cumprod(np.full(int(lengths.max()), _FACTORS[5]))
    inside = np.arange(len(letters)) - np.repeat(first, lengths)
    word = _mixed(np.add.reduceat(letters * powers[inside], first) + lengths.astype(_U) * _FACTORS[0])
    bounds = np.searchsorted(starts, offsets)
    padded = np.concatenate([word, np.zeros(words, _U)])
    factors = np.cumprod(np.full(words, _FACTORS[1])) * _FACTORS[2]
    rolled = _mixed(sum(padded[j : j + len(word)] * factors[j] for j in range(words)))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(_mixed((word[a:b] * factors[: b - a]).sum(dtype=_U, keepdims=True) + np.array([b - a], _U) * _FACTORS[3]))
        else:
            out.append(empty)
    return out


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text (null: empty) the sorted 64-bit hashes of its distinct shingles.

    Words are runs of other than white space, with A-Z in lower case; a text of fewer words than a
    shingle has is one shingle, one without words has none.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield from _hash_slice(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], words)
        at = end


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    size = np.array([len(shingles)], _U) * _FACTORS[4]
    total = _mixed(shingles.sum(dtype=_U, keepdims=True) + size)
    parity = _mixed(np.bitwise_xor.reduce(shingles, keepdims=True))
    return int((total * _FACTORS[0] + parity).view(np.int64)[0])


def signature(shingles: np.ndarray) -> bytes:
    """Parities of the shingles that fall to each of n to 2n bits (64 to 65,536).

    The bits in which two signatures of one width differ are at most the shingles that one of the
    sets lacks. Folding one half onto the other (exclusive or) gives the signature of half the width.
    """
    width = min(1 << 16, max(64, 1 << int(len(shingles)).bit_length()))
    bits = np.bincount((shingles & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, to: int) -> np.ndarray:
    while len(bits) > to:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _similar(overlap, a, b, percent: int):
    return (overlap > 0) & (100 * overlap >= percent * (a + b - overlap))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def describe(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """A row per document: _id, _key (of its set), _n, _bits; and rows of counters (_block, _counts) of all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        names = ["_id", "_key", "_n", "_bits", "_block", "_counts"]
        kind = None
        for part in _slices(batches):
            kind = part.column(0).type
            sets = list(shingle_sets(part.column(1), words))
            together = np.concatenate(sets)
            if len(together):
                at, n = np.unique(together >> _COUNTER, return_counts=True)
                counts[at] += n.astype(np.uint32)
            none = len(sets)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names)
        blocks = counts.reshape(-1, _COUNTERS_PER_ROW)
        some = np.flatnonzero(blocks.any(axis=1))
        for at in range(0, len(some), 64):
            own = some[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), kind), *(pa.nulls(len(own), t) for t in (pa.int64(), pa.int64(), pa.binary())), pa.array(own, pa.int32()), pa.array([zlib.compress(np.minimum(blocks[b], 65_535).astype(np.uint16).tobytes(), 1) for b in own], pa.binary())], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(freeing(run), f"_id {kind}, _key long, _n long, _bits binary, _block int, _counts binary")


def frequent(described: DataFrame, deviations: float = 6.0, least: int = 20) -> bytes:
    """The counters that are over what rare shingles alone would make of them, as bits (compressed; a fixed size).

    The limit is the mean, ``deviations`` times its square root and ``least``. Counters are added up
    where they are; what reaches the driver is a bit for each.
    """
    mean = (described.agg(F.sum("_n")).first()[0] or 0) / COUNTERS
    limit = mean + deviations * mean**0.5 + least

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint16).astype(np.int64)
                sums[block] = sums[block] + new if block in sums else new
        found = {b: np.packbits(c > limit).tobytes() for b, c in sums.items() if (c > limit).any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.binary())], ["block", "bits"])

    rows = described.filter("_block IS NOT NULL").select("_block", "_counts").repartition("_block").mapInArrow(freeing(add), "block int, bits binary").collect()
    table = np.zeros((COUNTERS // _COUNTERS_PER_ROW, _COUNTERS_PER_ROW // 8), np.uint8)
    for row in rows:
        table[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return zlib.compress(table.tobytes())


def prefixes(docs: DataFrame, text_col: str, often: bytes, words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """(_key, _n, _token, _at, _often) for the prefix of each document's set: rare shingles by hash, then frequent ones.

    _at is the place of the shingle in that order, in ``PARTS`` parts of the set's size; _often: it
    is a frequent one. A set that comes again in a task is left out there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(np.frombuffer(zlib.decompress(often), np.uint8)).astype(bool)
        seen: set[int] = set()
        for part in _slices(batches):
            keys, sizes, rare, tokens = [], [], [], []
            for s in shingle_sets(part.column(0), words):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(key)
                last = late[(s >> _COUNTER).astype(np.int64)]
                length = len(s) + (-percent * len(s)) // 100 + 1
                keys.append(key)
                sizes.append(len(s))
                rare.append(len(s) - int(last.sum()))
                tokens.append(np.concatenate([s[~last], s[last]])[:length])
            lengths = np.array([len(t) for t in tokens], np.int32)
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rare, pa.int64()), lists], ["_key", "_n", "_rare", "_tokens"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(freeing(run), "_key long, _n long, _rare long, _tokens array<long>")
    return found.select("_key", "_n", "_rare", F.posexplode("_tokens").alias("_place", "_token")).select("_key", "_n", "_token", F.floor(F.col("_place") * PARTS / F.col("_n")).cast("int").alias("_at"), (F.col("_place") >= F.col("_rare")).alias("_often"))


def _fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _early(n: Column, at: Column, smallest: Column, percent: int) -> Column:
    """Whether a shingle at place ``at`` of a set of ``n`` comes early enough for a link with a set of ``smallest``."""
    return (n - at * n / PARTS + 1e-6) * (100 + percent) >= percent * (n + F.greatest(smallest, n * (percent / 100.0)))


def groups(tokens: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """(_group, _key, _n, _at): classes that share a prefix shingle with another of a fitting size.

    Shingles that lead the same classes together make one group, named by a hash of its members;
    _at is then the first place. The classes of a rare shingle (its counter bounds them) meet in one
    window; those of frequent ones are counted with combining on the map side, and joined to that.
    """
    by = Window.partitionBy("_token").orderBy("_n", "_key")
    whole = Window.partitionBy("_token")
    fits = _fits(F.col("_below"), F.col("_n"), percent) | _fits(F.col("_above"), F.col("_n"), percent)
    beside = {"_below": F.lag("_n").over(by), "_above": F.lead("_n").over(by)}
    once = tokens.filter("NOT _often").withColumn("_last", F.lag("_key").over(by)).filter("_last IS NULL OR _last != _key")
    near = once.withColumns(beside).filter(fits)
    near = near.withColumn("_smallest", F.min("_n").over(whole)).filter(_early(F.col("_n"), F.col("_at"), F.col("_smallest"), percent))
    near = near.withColumns(beside).filter(fits)
    name = lambda over: F.xxhash64(over(F.bit_xor(F.xxhash64("_key"))), over(F.count(F.lit(1)))).alias("_group")
    rare = near.select(name(lambda x: x.over(whole)), "_key", "_n", "_at")

    held = materialise(tokens.filter("_often").groupBy("_token", "_key").agg(F.first("_n").alias("_n"), F.min("_at").alias("_at")), "often")
    sizes = materialise(held.groupBy("_token").agg(F.min("_n").alias("_smallest"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c"), "sizes")
    close = materialise(held.join(sizes, "_token").filter(_early(F.col("_n"), F.col("_at"), F.col("_smallest"), percent)).drop("_smallest"), "close")
    discard(held)
    names = materialise(close.groupBy("_token").agg(name(lambda x: x), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c"), "names")
    often = close.join(names, "_token").select("_group", "_key", "_n", "_at")
    return rare.unionByName(often).groupBy("_group", "_key").agg(F.first("_n").alias("_n"), F.min("_at").alias("_at"))


def _banded(members: DataFrame, percent: int) -> DataFrame:
    """Members with _band, in their _own size band and as visitors in the next smaller one: a partner is at most one band away."""
    own = F.floor(F.log("_n") / F.log(F.lit(100.0 / percent)) + 1e-9)
    return members.withColumn("_own", own).withColumn("_band", F.explode(F.array(F.col("_own"), F.col("_own") - 1)))


def pivot_pairs(members: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """(_x, _y): every class with the smallest key of each group and band that it is in."""
    placed = _banded(members, percent)
    pivots = placed.groupBy("_group", "_band").agg(F.min("_key").alias("_pivot"), F.count(F.lit(1)).alias("_rows"), F.min("_own").alias("_low"))
    pivots = materialise(pivots.filter("_rows > 1 AND _low = _band").select("_group", "_band", "_pivot"), "pivots")
    return placed.join(pivots, ["_group", "_band"]).filter("_key != _pivot").select(F.col("_pivot").alias("_x"), F.col("_key").alias("_y")).distinct()


def possible(pairs: DataFrame, bits: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """Those of the pairs (_x, _y) whose sizes and signatures leave a link possible. bits: _key, _n, _bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in (2, 3))
            keep = np.zeros(len(a), bool)
            for k in np.flatnonzero(100 * np.minimum(a, b) >= percent * np.maximum(a, b)):
                p, q = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint8) for c in (4, 5))
                width = min(len(p), len(q))
                differ = int(np.bitwise_count((_folded(p, width) ^ _folded(q, width)).view(_U)).sum())
                keep[k] = _similar((a[k] + b[k] - differ) // 2, a[k], b[k], percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["_x", "_y"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: bits.select(F.col("_key").alias(f"_{c}"), F.col("_n").alias(f"_n{c}"), F.col("_bits").alias(f"_b{c}"))
    both = pairs.join(side("y"), "_y").join(side("x"), "_x").filter(_fits(F.col("_nx"), F.col("_ny"), percent))
    return both.select("_x", "_y", "_nx", "_ny", "_bx", "_by").mapInArrow(freeing(run), "_x long, _y long")


def tiles(members: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """(_tile, _side, _key, _n, _visits, _part, _at): where classes meet that are not yet connected.

    members: _group, _key, _n, _at, _part (what is connected has the same). The classes of a group and
    band are dealt over blocks of about ``TILE_ROWS`` classes and at most about ``TILE_SHINGLES``
    shingles: blocks of the largest part meet those of the others, and the
    others meet each other. In a tile, rows of one _side do not meet (-1: all rows meet). Two classes
    have met as class and pivot, so groups of two do not come again.
    """
    placed = _banded(members, percent)
    parts = placed.groupBy("_group", "_band", "_part").agg(F.count(F.lit(1)).alias("_c"), F.sum("_n").alias("_s"), F.min("_own").alias("_low"))
    most = F.max(F.struct("_c", "_part", "_s"))
    whole = parts.groupBy("_group", "_band").agg(most.alias("_most"), F.sum("_c").alias("_c"), F.sum("_s").alias("_s"), F.count(F.lit(1)).alias("_k"), F.min("_low").alias("_low"))
    blocks = lambda c, s: F.greatest(F.ceil(c / TILE_ROWS), F.ceil(s / TILE_SHINGLES), F.lit(1)).cast("int")
    whole = whole.filter("_c > 2 AND _k > 1 AND _low = _band").select(
        "_group", "_band", F.col("_most._part").alias("_main"), blocks(F.col("_c"), F.col("_s")).alias("_all"),
        blocks(F.col("_most._c"), F.col("_most._s")).alias("_mains"), blocks(F.col("_c") - F.col("_most._c"), F.col("_s") - F.col("_most._s")).alias("_rests"),
    )
    dealt = placed.join(materialise(whole, "crowded"), ["_group", "_band"])
    own = lambda n: F.pmod(F.xxhash64("_key"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda kind, a, b, side: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), side.cast("int").alias("side"))
    zero, block = F.lit(0), own("_rests")
    main = F.transform(upto("_rests"), lambda j: at(1, own("_mains"), j, zero))
    rest = F.concat(
        F.transform(upto("_mains"), lambda j: at(1, j, block, F.lit(1))),
        F.transform(upto("_rests"), lambda j: at(2, F.least(j, block), F.greatest(j, block), F.when(j == block, -1).otherwise((block > j).cast("int")))),
    )
    places = F.when(F.col("_all") == 1, F.array(at(0, zero, zero, F.lit(-1)))).when(F.col("_part") == F.col("_main"), main).otherwise(rest)
    dealt = dealt.withColumn("_place", F.explode(places))
    tile = F.xxhash64("_group", "_band", "_place.kind", "_place.a", "_place.b").alias("_tile")
    return dealt.select(tile, F.col("_place.side").alias("_side"), "_key", "_n", (F.col("_own") > F.col("_band")).alias("_visits"), "_part", "_at")


_TILE = "_tile long, _side int, _key long, _n long, _visits boolean, _part long, _at int"
_TILE_COLUMNS = [c.split()[0] for c in _TILE.split(", ")]


def _hopes(rows: list[tuple], bits: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(differing bits, i, j) of the pairs of a tile that sizes, places and signatures leave possible."""
    _, sides, _, sizes, visits, parts, places, *_ = (np.array(c) for c in zip(*(r[:7] for r in rows), strict=True))
    # Of the shingles that two sets share, the first one must come early enough in both to leave room for the overlap.
    room = sizes - places * sizes / PARTS + 1e-6
    width = min(map(len, bits))
    m = np.stack([_folded(np.frombuffer(b, np.uint8), width) for b in bits]).view(np.uint64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for j in range(1, len(rows)):
        hope = (parts[:j] != parts[j]) & ~(visits[:j] & visits[j]) & ((sides[:j] != sides[j]) | (sides[:j] < 0))
        hope &= 100 * np.minimum(sizes[:j], sizes[j]) >= percent * np.maximum(sizes[:j], sizes[j])
        hope &= np.minimum(room[:j], room[j]) * (100 + percent) >= percent * (sizes[:j] + sizes[j])
        near = np.flatnonzero(hope)
        if len(near):
            differ = np.bitwise_count(m[near] ^ m[j]).sum(axis=1, dtype=np.int64)
            passes = _similar((sizes[near] + sizes[j] - differ) // 2, sizes[near], sizes[j], percent)
            out.append((differ[passes], near[passes], np.full(int(passes.sum()), j)))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([o[k] for o in out]) if out else none for k in range(3))


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _in_tiles(rows: DataFrame) -> DataFrame:
    return rows.repartition("_tile").sortWithinPartitions("_tile")


#: Closest partners that a tile names for each class, first and where classes are still apart.
CLOSEST = 2
FEW = 32


def hopeful(dealt: DataFrame, bits: DataFrame, percent: int = SIMILARITY, most: int = CLOSEST) -> DataFrame:
    """The rows of ``tiles`` whose signature leaves a link with another row of the tile possible.

    _near: the ``most`` closest such rows, by (differing bits, key); _more: there are others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_tile(batches):
            differ, i, j = _hopes(rows, [r[7] for r in rows], percent)
            near: dict[int, list[tuple[int, int]]] = {}
            more: set[int] = set()
            for k in np.argsort(differ, kind="stable"):
                for x, y in ((int(i[k]), int(j[k])), (int(j[k]), int(i[k]))):
                    if len(own := near.setdefault(x, [])) < most:
                        own.append((int(differ[k]), rows[y][2]))
                    else:
                        more.add(x)
            if near:
                columns = [*zip(*(rows[x][:7] for x in near), strict=True), [[{"differ": d, "key": y} for d, y in own] for own in near.values()], [x in more for x in near]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*_TILE_COLUMNS, "_near", "_more"])

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.struct([("differ", pa.int64()), ("key", pa.int64())])), pa.bool_())
    rows = dealt.join(bits.select("_key", "_bits"), "_key").select(*_TILE_COLUMNS, "_bits")
    return _in_tiles(rows).mapInArrow(freeing(run), f"{_TILE}, _near array<struct<differ: long, key: long>>, _more boolean")


def _pairs(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y")]


def closest(rows: DataFrame) -> DataFrame:
    """(_x, _y): each class with its ``CLOSEST`` closest partners over all its tiles."""
    each = rows.select("_key", F.explode("_near").alias("_p")).groupBy("_key", F.col("_p.key").alias("_other")).agg(F.min("_p.differ").alias("_differ"))
    ranked = each.withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy("_differ", "_other"))).filter(F.col("_rank") <= CLOSEST)
    return ranked.select(*_pairs("_key", "_other")).distinct()


def named(rows: DataFrame) -> DataFrame:
    """(_x, _y): the partners that classes with few of them in a tile have there."""
    return rows.filter("NOT _more").select("_key", F.explode("_near.key").alias("_other")).select(*_pairs("_key", "_other")).distinct()


def still_open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``hopeful`` in tiles that still hold several parts, with the parts of now."""
    now = rows.drop("_part").join(roots, "_key", "left").withColumn("_part", F.coalesce("_root", "_key")).select(*_TILE_COLUMNS)
    apart = now.groupBy("_tile").agg(F.min("_part").alias("_a"), F.max("_part").alias("_b")).filter("_a != _b").select("_tile")
    return now.join(apart, "_tile", "left_semi")


def tile_links(rows: DataFrame, sets: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """(_x, _y): links that connect the parts of these rows in each tile as all their links would. sets: _key, _set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_tile(batches):
            arrays = [np.frombuffer(r[7], _U) for r in rows]
            differ, i, j = _hopes(rows, [signature(a) for a in arrays], percent)
            tops: dict[int, int] = {}

            def top(part: int) -> int:
                while part != (above := tops.setdefault(part, part)):
                    tops[part] = part = tops.setdefault(above, above)
                return part

            found = []
            for k in np.argsort(differ, kind="stable"):
                a, b = int(i[k]), int(j[k])
                p, q = top(rows[a][5]), top(rows[b][5])
                if p != q and _linked(arrays[a], arrays[b], percent):
                    tops[max(p, q)] = min(p, q)
                    found.append((rows[a][2], rows[b][2]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["_x", "_y"])

    return _in_tiles(rows.join(sets, "_key").select(*_TILE_COLUMNS, "_set")).mapInArrow(freeing(run), "_x long, _y long")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return bool(_similar(int((both[1:] == both[:-1]).sum()), len(a), len(b), percent))


def class_sets(docs: DataFrame, keys: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int = WORDS, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(_key, _set) of the classes in ``keys``: sorted sets, from the text of one document of each.

    A document that is there many times (same id and text) gives a row a task; that does no harm.
    The ids of these documents are broadcast up to ``broadcast_rows`` of them; beyond that the texts
    are shuffled.
    """
    used = materialise(keys.select("_key").distinct().join(classes, "_key").select("_key", "_first"), "used")
    small = used.count() <= broadcast_rows
    of = lambda *c: F.broadcast(used.select(*c)) if small else used.select(*c)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    texts = texts.join(of(F.col("_first").alias("_wanted")), F.col("_id").eqNullSafe(F.col("_wanted")), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in _slices(batches):
            found = {set_key(s): s.tobytes() for s in shingle_sets(part.column(0), words)}
            new = [k for k in found if k not in seen]
            if len(seen) < 1 << 20:
                seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([found[k] for k in new], pa.binary())], ["_key", "_set"])

    arrays = texts.select("_text").mapInArrow(freeing(sets), "_key long, _set binary").join(of("_key"), "_key", "left_semi")
    return materialise(arrays, "sets")


def links(pairs: DataFrame, sets: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """Those of the pairs (_x, _y) that are linked, by exact intersection of their sorted sets."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(np.frombuffer(p.as_buffer(), _U), np.frombuffer(q.as_buffer(), _U), percent) for p, q in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["_x", "_y"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sets.select(F.col("_key").alias(f"_{c}"), F.col("_set").alias(f"_s{c}"))
    return pairs.join(side("y"), "_y").join(side("x"), "_x").select("_x", "_y", "_sx", "_sy").mapInArrow(freeing(decide), "_x long, _y long")


def components(edges: DataFrame) -> DataFrame:
    """(_key, _root) for every end of an edge (_x, _y): the smallest key of its component.

    Large and small stars take turns until the edges no longer change. Minima combine on the map
    side; edges and roots stay distributed, written anew each round.
    """
    e = materialise(edges.filter("_x != _y").select(F.greatest("_x", "_y").alias("_a"), F.least("_x", "_y").alias("_b")).distinct(), "edges")
    before = None
    while True:
        both = e.select(F.col("_a").alias("_u"), F.col("_b").alias("_v")).unionByName(e.select(F.col("_b").alias("_u"), F.col("_a").alias("_v")))
        # As a table of its own it has an exchange of its own, so that the join is split at a node with many neighbours.
        least = materialise(both.groupBy("_u").agg(F.min("_v").alias("_m")).withColumn("_m", F.least("_u", "_m")), "least")
        large = both.join(least, "_u").filter("_v > _u AND _v != _m").select(F.col("_v").alias("_a"), F.col("_m").alias("_b")).distinct()
        small = large.groupBy("_a").agg(F.min("_b").alias("_m"))
        moved = large.join(small, "_a").filter("_b != _m").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
        e = materialise(moved.unionByName(small.select("_a", F.col("_m").alias("_b"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("_a", "_b"))).first()
        if now == before:
            return e.select(F.col("_a").alias("_key"), F.col("_b").alias("_root")).unionByName(e.select(F.col("_b").alias("_key"), F.col("_b").alias("_root")).distinct())
        before = now


def _resolve(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (_id, _key, _n), classes (_key, _first, _n, _bits, _copies) and roots (_key, _root) of linked classes."""
    described = materialise(describe(docs, id_col, text_col, words), "described")
    often = frequent(described)
    rows = materialise(described.filter("_block IS NULL").select("_id", "_key", "_n"), "rows")
    classes = described.filter("_n > 0").groupBy("_key").agg(F.min("_id").alias("_first"), F.first("_n").alias("_n"), F.first("_bits").alias("_bits"), F.count(F.lit(1)).alias("_copies"))
    classes = materialise(classes, "classes")
    discard(described)
    members = materialise(groups(prefixes(docs, text_col, often, words, percent), percent), "groups")
    bits = classes.select("_key", "_n", "_bits")
    def linked(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "pairs")
        sets = class_sets(docs, pairs.select(F.explode(F.array("_x", "_y")).alias("_key")), classes, id_col, text_col, words)
        found = materialise(links(pairs, sets, percent), "links")
        discard(sets)
        return found

    edges = lambda roots: roots.select(F.col("_key").alias("_x"), F.col("_root").alias("_y"))
    roots = components(linked(possible(pivot_pairs(members, percent), bits, percent)))
    placed = members.join(roots, "_key", "left").withColumn("_part", F.coalesce("_root", "_key")).drop("_root")
    left = materialise(hopeful(tiles(placed, percent), bits, percent), "hopeful")
    roots = components(edges(roots).unionByName(linked(closest(left))))
    left = materialise(hopeful(still_open(left, roots), bits, percent, FEW), "open")
    few = linked(named(left))
    many = left.filter("_more").select(*_TILE_COLUMNS)
    sets = class_sets(docs, many, classes, id_col, text_col, words)
    more = materialise(tile_links(many, sets, percent), "more")
    discard(sets)
    roots = components(edges(roots).unionByName(few).unionByName(more))
    return rows, classes, materialise(roots, "roots")


def find_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links).

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing:
    their component is their own id. Null ids take part, but a component is named by an id that is
    not null, if it has one. Repeated rows are copies; other columns of ``docs`` are not read. An
    empty table gives an empty result.
    """
    rows, classes, roots = _resolve(docs, id_col, text_col, words, percent)
    linked = classes.filter("_copies > 1").select("_key", "_first").join(roots, "_key", "left")
    linked = linked.unionByName(roots.join(classes.filter("_copies = 1").select("_key", "_first"), "_key"), allowMissingColumns=True).withColumn("_root", F.coalesce("_root", "_key"))
    names = linked.groupBy("_root").agg(F.min("_first").alias("_component"))
    labels = materialise(linked.join(names, "_root").select("_key", "_component", F.lit(True).alias("_labelled")), "labels")
    out = rows.join(labels, "_key", "left")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.when(F.col("_labelled") & (F.col("_n") > 0), F.col("_component")).otherwise(F.col("_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = SIMILARITY, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (null ids last).

    Texts without words all stay. Rows that repeat both the kept id and its text count as one. Only
    the rows of components of two or more are looked up; all others pass straight through. The table
    of what goes is broadcast up to ``broadcast_rows`` rows; beyond that the documents are shuffled.
    """
    names = docs.columns
    mark = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    identity = docs.select(F.struct(docs[id_col].alias("id"), mark.alias("mark")).alias("_id"), docs[text_col].alias("_text"))
    rows, classes, roots = _resolve(identity, "_id", "_text", words, percent)
    many = classes.filter("_copies > 1").select("_key").join(roots, "_key", "full").withColumn("_root", F.coalesce("_root", "_key"))
    grouped = rows.filter("_n > 0").join(materialise(many, "many"), "_key")
    order = F.struct(F.col("_id.id").isNull().alias("none"), F.col("_id.id").alias("id"), F.col("_id.mark").alias("mark"))
    first = grouped.groupBy("_root").agg(F.min(order).alias("_kept"))
    go = grouped.join(first, "_root").groupBy("_id").agg(F.max(F.struct(~F.col("_kept.id").eqNullSafe(F.col("_id.id")) | (F.col("_kept.mark") != F.col("_id.mark")))).alias("_gone"), F.count(F.lit(1)).alias("_times"))
    go = materialise(go.select(F.col("_id.id").alias("_gid"), F.col("_id.mark").alias("_gmark"), F.col("_gone.col1").alias("_gone"), "_times").filter("_gone OR _times > 1"), "gone")
    held = docs.select(F.struct(*[docs[c] for c in names]).alias("_doc"), mark.alias("_mark"))
    small = go.count() <= broadcast_rows
    found = held.join(F.broadcast(go) if small else go, F.col("_doc").getField(id_col).eqNullSafe(F.col("_gid")) & (F.col("_mark") == F.col("_gmark")), "left")
    alone = found.filter("_gone IS NULL").select("_doc.*")
    repeated = found.filter("NOT _gone").groupBy("_gid", "_gmark").agg(F.min_by("_doc", F.xxhash64("_doc")).alias("_doc")).select("_doc.*")
    return alone.unionByName(repeated)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), c AS (SELECT s, min(doc_id) AS k, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) WHERE len(s) > 0 GROUP BY s),
t AS (SELECT k, n, unnest(s) AS t FROM c),
e AS (
  SELECT a.k AS x, b.k AS y FROM t a JOIN t b ON a.t = b.t AND a.k < b.k AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r(k, r) AS (
  SELECT k, k FROM c UNION SELECT x.k, r.r FROM r JOIN (SELECT x AS f, y AS k FROM e UNION ALL SELECT y, x FROM e) x ON x.f = r.k
), m AS (SELECT k, min(r) AS r FROM r GROUP BY k)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(m.r, s.doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN m ON c.k = m.k
"""
