import numpy as np
import pytest
from pyspark.sql import functions as F

from chromatile.sources import jpeg


def decode(data):
    """A plain decoder of baseline files without subsampling: (height, width, 3) of r, g, b."""
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    at, quanta, codes, size, every = 2, {}, {}, None, 0
    while True:
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        assert data[at] == 0xFF
        at += 2 + n
        if marker == 0xDB:
            quanta[body[0]] = np.frombuffer(body[1:], np.uint8).astype(int)
        elif marker == 0xC0:
            size = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            assert [tuple(body[6 + 3 * k : 9 + 3 * k]) for k in range(3)] == [(1, 0x11, 0), (2, 0x11, 1), (3, 0x11, 1)]
        elif marker == 0xC4:
            code, k, table = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                assert code < 1 << length or not body[length]  # no code of only ones
                code <<= 1
            codes[body[0]] = table
        elif marker == 0xDD:
            every = int.from_bytes(body, "big")
        elif marker == 0xDA:
            break
    height, width = size
    across, down = -(-width // 8), -(-height // 8)
    assert every == across
    order = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
    scan, strips, start = data[at:-2], [], 0
    for k in range(len(scan) - 1):
        if scan[k] == 0xFF and 0xD0 <= scan[k + 1] <= 0xD7:
            assert scan[k + 1] == 0xD0 + len(strips) % 8
            strips.append(scan[start:k])
            start = k + 2
    strips.append(scan[start:])
    assert len(strips) == down
    c = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    planes = np.zeros((3, down * 8, across * 8))
    for row, strip in enumerate(strips):
        bits = "".join(f"{b:08b}" for b in strip.replace(b"\xff\x00", b"\xff"))
        pos = 0

        def symbol(table):
            nonlocal pos
            for n in range(1, 17):
                found = table.get((n, int(bits[pos : pos + n], 2)))
                if found is not None:
                    pos += n
                    return found
            raise AssertionError("no such code")

        def number(n):
            nonlocal pos
            raw = bits[pos : pos + n]
            pos += n
            return 0 if not n else int(raw, 2) if raw[0] == "1" else int(raw, 2) - (1 << n) + 1

        lead = [0, 0, 0]
        for col in range(across):
            for k in range(3):
                z = np.zeros(64)
                lead[k] += number(symbol(codes[min(k, 1)]))
                z[0], i = lead[k], 1
                while i < 64:
                    s = symbol(codes[16 + min(k, 1)])
                    if s == 0:
                        break
                    i += s >> 4
                    if s != 0xF0:
                        z[i] = number(s & 15)
                    i += 1
                block = np.zeros(64)
                block[order] = z * quanta[min(k, 1)]
                planes[k, row * 8 : row * 8 + 8, col * 8 : col * 8 + 8] = c.T @ block.reshape(8, 8) @ c
        assert set(bits[pos:]) <= {"1"} and len(bits) - pos < 8
    y, cb, cr = planes[:, :height, :width]
    y = y + 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.rint(rgb), 0, 255)


def picture(height, width, seed):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    smooth = np.stack([127 + 120 * np.sin(x / 9 + seed), 40 + 2 * y % 200, 255 * ((x // 11 + y // 7) % 2)], axis=-1)
    return np.clip(smooth + rng.normal(0, 3 + 40 * (seed == 2), smooth.shape), 0, 255).astype(int)


@pytest.mark.parametrize("quality,least", [(0.92, 30), (0.3, 20), (1.0, 45)])
def test_files_decode_to_the_picture(spark, quality, least):
    pictures = {i: picture(*size, i) for i, size in enumerate([(64, 48), (37, 29), (40, 41), (1, 1), (5, 200), (90, 3)])}
    rows = [(i, x, y, *map(int, p[y, x])) for i, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    made = jpeg.to_jpeg(spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int").repartition(3), quality)
    files = {r.image_id: r.jpeg for r in made.collect()}
    assert files.keys() == pictures.keys()
    for i, p in pictures.items():
        error = ((decode(bytes(files[i])) - p) ** 2).mean()
        assert error < 1e-9 or 10 * np.log10(255**2 / error) > least - 6 * (i == 2), (i, error)
    if quality < 0.9:
        assert len(files[0]) < 64 * 48  # far below three bytes a pixel


def test_another_decoder_reads_the_files(spark, tmp_path):
    from chromatile.sources import images

    p = picture(50, 70, 1)
    rows = [("one", x, y, *map(int, p[y, x]), 255) for y in range(50) for x in range(70)]
    pixels = spark.createDataFrame(rows, "image_id string, x int, y int, r int, g int, b int, a int")
    (tmp_path / "one.jpg").write_bytes(bytes(jpeg.to_jpeg(pixels).first().jpeg))
    back = np.zeros((50, 70, 3))
    for r in images.read_images(spark, str(tmp_path)).collect():
        back[r.y, r.x] = r.r, r.g, r.b
    assert 10 * np.log10(255**2 / ((back - p) ** 2).mean()) > 30
    small = images.thumbnails(pixels, 32, "jpeg").first()
    assert decode(bytes(small.jpeg)).shape == (23, 32, 3)
    with pytest.raises(ValueError):
        images.thumbnails(pixels, kind="gif")


def test_missing_pixels_and_no_pictures(spark):
    cells = spark.createDataFrame([(1, x, y, None if x == 3 else 255, 255, 255) for x in range(16) for y in range(8)], "image_id int, x int, y int, r int, g int, b int")
    white = decode(bytes(jpeg.to_jpeg(cells.filter("x != 9")).first().jpeg))
    assert white.shape == (8, 16, 3) and (white[:, 6, :] > 230).all() and (white[:, 9, :] < 90).all()
    assert jpeg.to_jpeg(cells.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, 70_000, 2), (2, 0, 5)], "image_id int, width int, height int")
    assert jpeg.to_jpeg(cells, images=nothing).count() == 0
    assert decode(bytes(jpeg.to_jpeg(cells, images=spark.createDataFrame([(1, 8, 8)], "image_id int, width int, height int")).first().jpeg)).shape == (8, 8, 3)


def test_long_codes_are_cut_to_sixteen_bits():
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    lengths = jpeg.code_lengths(dict(enumerate(fibonacci)))
    assert max(lengths.values()) == 16 and sum(2.0**-n for n in lengths.values()) <= 1 - 2.0**-16
    codes = [f"{c:0{n}b}" for c, n in jpeg.codes_of(lengths).values()]
    assert not any(a != b and b.startswith(a) for a in codes for b in codes) and "1" * 16 not in codes
    assert jpeg.code_lengths({7: 3}) == {7: 1} and jpeg.code_lengths({}) == {}
