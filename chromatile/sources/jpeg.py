"""Baseline JPEG, coded in strips: a picture is many tasks, not one call of a codec.

A strip is a row of 8 x 8 blocks and one restart interval, so strips are transformed, quantised and coded apart. Between
the two passes only the numbers of symbols by image are summed: from them each image gets Huffman codes of its own,
and its strips are coded with these and put together in order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.raster import sizes as sizes_of
from ..operators.settling import settle

# The example quantisation tables of the standard, for brightness and for colour, row by row.
QUANTA = (
    """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
    18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99""",
    """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
    99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99""",
)
#: Places of a block in the order of the zigzag, as row * 8 + column: by diagonals, each one the other way.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_AT = np.arange(8)
#: The cosine transform of eight values.
DCT = np.sqrt(np.where(_AT == 0, 1, 2) / 8)[:, None] * np.cos((2 * _AT + 1) * _AT[:, None] * np.pi / 16)
#: Largest coefficient that has a symbol.
MOST = 1023
#: Symbols by table: first coefficients and others, of brightness and of colour.
TABLES = 4


def quantisers(quality: float) -> np.ndarray:
    """The two tables (2, 64) for a quality of 0 to 1, in zigzag order."""
    q = min(100, max(1, round(quality * 100)))
    scale = 5000 / q if q < 50 else 200 - 2 * q
    base = np.array([[int(v) for v in t.split()] for t in QUANTA])
    return np.clip((base * scale + 50) // 100, 1, 255).astype(np.int64)[:, ZIGZAG]


def blocks_of(strip: np.ndarray) -> np.ndarray:
    """(blocks, 3, 64): the transform of a strip (8, width, 3) of r, g, b, its last columns repeated to whole blocks; in zigzag order."""
    width = strip.shape[1]
    whole = strip[:, np.minimum(np.arange(-(-width // 8) * 8), width - 1)].astype(float)
    r, g, b = np.moveaxis(whole, -1, 0)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = np.stack([y - 128, (b - y) / 1.772, (r - y) / 1.402])  # the second and third are centred by themselves
    cells = planes.reshape(3, 8, -1, 8).transpose(2, 0, 1, 3)
    return (DCT @ cells @ DCT.T).reshape(-1, 3, 64)[:, :, ZIGZAG]


def _bits_of(values: np.ndarray) -> np.ndarray:
    """How many bits the size of each value has."""
    return np.frexp(np.abs(values).astype(float))[1] * (values != 0)


def symbols_of(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of a strip in order: (table, symbol, extra bits, how many). blocks: (n, 3, 64), quantised whole numbers."""
    n = len(blocks)
    flat = blocks.reshape(-1, 64)
    kind = np.tile([0, 1, 1], n)
    first = np.diff(blocks[:, :, 0], axis=0, prepend=0).reshape(-1)
    block, place = np.nonzero(flat[:, 1:])
    place = place + 1
    value = flat[block, place]
    before = np.r_[0, place[:-1]] * np.r_[False, block[1:] == block[:-1]] if len(block) else place
    run = place - before - 1
    long = run // 16
    last = np.zeros(len(flat), np.int64)
    np.maximum.at(last, block, place)
    ends = np.flatnonzero(last < 63)
    size, size0 = _bits_of(value), _bits_of(first)
    extra = lambda v, s: np.where(v < 0, v + (1 << s) - 1, v)
    which = np.repeat(np.arange(len(block)), long)
    parts = [  # block, place within it (runs of 16 come before their value), table, symbol, extra, bits
        (np.arange(len(flat)), np.zeros(len(flat), np.int64), kind * 2, size0, extra(first, size0), size0),
        (block[which], place[which] * 2 - 1, kind[block[which]] * 2 + 1, np.full(len(which), 0xF0), np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)),
        (block, place * 2, kind[block] * 2 + 1, run % 16 * 16 + size, extra(value, size), size),
        (ends, np.full(len(ends), 1000), kind[ends] * 2 + 1, np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)),
    ]
    joined = [np.concatenate([p[k] for p in parts]) for k in range(6)]
    order = np.lexsort((joined[1], joined[0]))
    return tuple(x[order].astype(np.int64) for x in joined[2:])


def code_lengths(counts: dict[int, int], most: int = 16) -> dict[int, int]:
    """Lengths of Huffman codes of at most ``most`` bits by symbol; the code of only ones is left free."""
    heap = [(n, s, (s,)) for s, n in counts.items()] + [(0, 1 << 20, (1 << 20,))]
    length = {s: 0 for _, s, _ in heap}
    heapq.heapify(heap)
    while len(heap) > 1:
        n, _, a = heapq.heappop(heap)
        m, tie, b = heapq.heappop(heap)
        for s in a + b:
            length[s] += 1
        heapq.heappush(heap, (n + m, tie, a + b))
    have = [0] * (max(length.values()) + 2)
    for n in length.values():
        have[n] += 1
    for n in range(len(have) - 1, most, -1):  # two codes that are too long give room by lengthening a shorter one
        while have[n] > 0:
            shorter = max(k for k in range(1, n - 1) if have[k])
            have[n] -= 2
            have[n - 1] += 1
            have[shorter] -= 1
            have[shorter + 1] += 2
    longest = max(k for k, n in enumerate(have) if n)
    have[longest] -= 1  # that of the reserved symbol
    by_use = sorted(counts, key=lambda s: (-counts[s], s))
    lengths = [k for k, n in enumerate(have) for _ in range(n)]
    return dict(zip(by_use, lengths, strict=True))


def codes_of(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code, length) by symbol: codes rise with length, then with the symbol."""
    code, before, out = 0, 0, {}
    for symbol in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[symbol] - before
        before = lengths[symbol]
        out[symbol] = (code, before)
        code += 1
    return out


def coded(symbols: tuple[np.ndarray, ...], lengths: list[dict[int, int]]) -> bytes:
    """The bytes of a strip, filled up with ones; a byte of only ones is followed by a zero."""
    code, size = np.zeros((TABLES, 256), np.int64), np.zeros((TABLES, 256), np.int64)
    for t, table in enumerate(lengths):
        for s, (c, n) in codes_of(table).items():
            code[t, s], size[t, s] = c, n
    table, symbol, extra, bits = symbols
    word, width = code[table, symbol] << bits | extra, size[table, symbol] + bits
    total = int(width.sum())
    start = np.cumsum(width) - width
    shift = np.repeat(width, width) - 1 - (np.arange(total) - np.repeat(start, width))
    stream = np.r_[(np.repeat(word, width) >> shift & 1).astype(np.uint8), np.ones(-total % 8, np.uint8)]
    return np.packbits(stream).tobytes().replace(b"\xff", b"\xff\x00")


def header(width: int, height: int, quality: float, lengths: list[dict[int, int]]) -> bytes:
    """Everything before the first strip."""
    part = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    two = lambda v: v.to_bytes(2, "big")
    out = b"\xff\xd8" + part(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")
    for k, table in enumerate(quantisers(quality)):
        out += part(0xDB, bytes([k, *table.tolist()]))
    out += part(0xC0, b"\x08" + two(height) + two(width) + b"\x03" + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(3)))
    for t, table in enumerate(lengths):
        order = sorted(table, key=lambda s: (table[s], s))
        out += part(0xC4, bytes([t % 2 * 16 + t // 2]) + bytes(sum(n == k for n in table.values()) for k in range(1, 17)) + bytes(order))
    out += part(0xDD, two(-(-width // 8)))
    return out + part(0xDA, b"\x03" + b"".join(bytes([c + 1, min(c, 1) * 0x11]) for c in range(3)) + b"\x00\x3f\x00")


def to_jpeg(pixels: DataFrame, quality: float = 0.92, images: DataFrame | None = None) -> DataFrame:
    """(image_id, jpeg): pixels(image_id, x, y, r, g, b) of whole grids as JPEG files, colour at full resolution.

    ``images`` (image_id, width, height) has the sizes if they are known. A missing pixel is black, a null channel too; the
    last rows are repeated to whole blocks. Sides go up to 65,535; an image beyond that, like one without pixels, gives no row.
    """
    images = (sizes_of(pixels) if images is None else images).select("image_id", "width", "height").filter("width BETWEEN 1 AND 65535 AND height BETWEEN 1 AND 65535")
    kind = pixels.schema["image_id"].dataType.simpleString()
    table = quantisers(quality)[[0, 1, 1]]

    def transform(held: pa.Table) -> pa.Table:
        width, height, strip = (held[c][0].as_py() for c in ("width", "height", "strip"))
        rgb = np.zeros((8, width, 3), np.uint8)
        x, y = held["x"].to_numpy(), held["y"].to_numpy() - strip * 8
        for k, c in enumerate("rgb"):
            rgb[y, x, k] = np.clip(held[c].fill_null(0).to_numpy(), 0, 255)
        rows = min(8, height - strip * 8)
        found = np.clip(np.rint(blocks_of(rgb[np.minimum(np.arange(8), rows - 1)]) / table), -MOST, MOST).astype(np.int16)
        return pa.table({"image_id": held["image_id"].slice(0, 1), "strip": pa.array([strip], pa.int32()), "width": pa.array([width], pa.int32()), "height": pa.array([height], pa.int32()), "blocks": pa.array([found.astype("<i2").tobytes()], pa.binary())})

    inside = pixels.select("image_id", *[F.col(c).cast("int").alias(c) for c in ("x", "y", "r", "g", "b")]).join(images, "image_id").filter("x BETWEEN 0 AND width - 1 AND y BETWEEN 0 AND height - 1")
    strips = inside.withColumn("strip", F.floor(F.col("y") / 8).cast("int")).withColumns({c: F.col(c).cast("int") for c in ("width", "height")}).groupBy("image_id", "strip").applyInArrow(transform, f"image_id {kind}, strip int, width int, height int, blocks binary")
    strips = settle(strips, "strips")
    unpack = lambda data: np.frombuffer(data, "<i2").reshape(-1, 3, 64).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                kinds, symbols, _, _ = symbols_of(unpack(batch.column(1)[row].as_py()))
                found, times = np.unique(kinds * 256 + symbols, return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1).take(pa.array(np.zeros(len(found), np.int64))), pa.array(found.astype(np.int32)), pa.array(times.astype(np.int64))], ["image_id", "symbol", "n"])

    counts = strips.select("image_id", "blocks").mapInArrow(count, f"image_id {kind}, symbol int, n long").groupBy("image_id", "symbol").agg(F.sum("n").alias("n"))
    tables = counts.groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "n")))).alias("counts"))  # at most 1,024 an image

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for strip, width, height, data, used in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                own = [code_lengths({s - 256 * t: n for s, n in used if s // 256 == t}) for t in range(TABLES)]
                body = coded(symbols_of(unpack(data)), own)
                lead = header(width, height, quality, own) if strip == 0 else bytes([0xFF, 0xD0 + (strip - 1) % 8])
                files.append(lead + body + (b"\xff\xd9" if strip == (height - 1) // 8 else b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(files, pa.binary())], ["image_id", "strip", "part"])

    parts = strips.join(tables, "image_id").select("image_id", "strip", "width", "height", "blocks", "counts").mapInArrow(encode, f"image_id {kind}, strip int, part binary")
    ordered = F.array_sort(F.collect_list(F.struct("strip", "part")))
    return parts.groupBy("image_id").agg(F.aggregate(ordered, F.lit(b""), lambda a, s: F.concat(a, s["part"])).alias("jpeg"))
