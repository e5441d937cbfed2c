import hashlib
import re

import numpy as np
import pytest

from chromatile.llm import decontamination

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def occurrences(docs, items, window=10):
    """(row, item, item_at, doc_at, length) of every occurrence of every window."""
    out = []
    for r, (_, text) in enumerate(docs):
        w = words(text)
        for item, passage in items:
            p = words(passage)
            n = min(len(p), window)
            for at in range(len(p) - n + 1 if p else 0):
                out += [(r, item, at, i, n) for i in range(len(w) - n + 1) if w[i : i + n] == p[at : at + n]]
    return out


def plain(docs, items, window=10):
    found, out = occurrences(docs, items, window), []
    for r, (doc, text) in enumerate(docs):
        own = [x for x in found if x[0] == r]
        hit = {i + k for _, _, _, i, n in own for k in range(n)}
        listed = sorted({str(x[1]) for x in own if x[1] is not None})
        out.append((doc, len(words(text)), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made(seed, n_docs=60, n_items=12, vocabulary=9):
    """Random texts over few words, so that windows repeat, overlap and share their terms."""
    rng = np.random.default_rng(seed)
    pool = ["a", "B", "ça", "x1", "日本", "the", "The", "Éa", "z"][:vocabulary]
    text = lambda n: "".join(str(rng.choice(pool)) + str(rng.choice([" ", ", ", "\n", "--"])) for _ in range(n))
    items = [(i % 10, text(int(rng.integers(0, 30)))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        t = text(int(rng.integers(0, 80)))
        if i % 3 == 0:
            t += items[i % n_items][1] + text(3)
        docs.append((i, t))
    return docs, items


EDGES = [(None, None), (1, None), (1, None), (2, ""), (3, "--- ..."), (4, "One two three four five six seven eight nine ten"), (4, "one TWO three four five six seven eight nine ten"), (5, "one two three four five six seven eight nine"), (6, "short")]
ITEMS = [(7, "one two three four five six seven eight nine ten eleven"), (None, "five six seven"), (10, "SHORT"), (2, "short"), (2, "short"), (3, None), (4, ""), (5, "!!")]


def tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS item_id", "1 AS n_words", "2 AS _row", "3 AS places")
    return d.repartition(3), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "1 AS _item")


@pytest.mark.parametrize("docs,items", [made(0), made(1, vocabulary=3), made(2, vocabulary=1), (EDGES, ITEMS), ([], ITEMS), (EDGES, []), (EDGES, [(1, None)])])
def test_counts_equal_plain_ones(spark, docs, items):
    got = decontamination.find_contamination(*tables(spark, docs, items))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def test_blocks_and_segments_change_nothing(spark):
    docs, items = made(3)
    d, b = tables(spark, docs, items)
    index = decontamination.build_index(d, segment_bytes=100)
    assert index.count() > 10
    whole = sorted(map(tuple, decontamination.contamination(decontamination.build_index(d), b).collect()), key=str)
    assert sorted(map(tuple, decontamination.contamination(index, b).collect()), key=str) == whole
    assert sorted(map(tuple, decontamination.contamination(index, b, pieces_per_block=3).collect()), key=str) == whole
    for doc, n, spans, listed in whole:
        hit = {i + k for r, _, _, i, n in occurrences(docs, items) if docs[r][0] == doc for k in range(n)}
        assert {s.at + k for s in spans for k in range(s.length)} == hit and listed == sorted(listed)
        assert all(x.at + x.length < y.at for x, y in zip(spans, spans[1:]))


def test_every_occurrence_of_long_items(spark):
    rng = np.random.default_rng(5)
    passage = " ".join(f"w{int(x)}" for x in rng.integers(0, 400, 700))  # more than one piece
    docs = [(1, "before " + passage + " after"), (2, passage[200:2000]), (3, "nothing of it")]
    d, b = tables(spark, docs, [(9, passage)])
    got = decontamination.phrase_matches(decontamination.build_index(d), b).collect()
    want = [(docs[r][0], *x) for r, *x in occurrences(docs, [(9, passage)])]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 900


def brute_near(w, p, width):
    runs = [(i, j) for i in range(len(w)) for j in range(i, min(len(w), i + width)) if set(p) <= set(w[i : j + 1])]
    return sorted((i, j - i + 1) for i, j in runs if not any((i <= a and b <= j) and (a, b) != (i, j) for a, b in runs))


@pytest.mark.parametrize("seed", range(3))
def test_proximity_equals_all_runs(spark, seed):
    docs, items = made(seed, n_docs=25, n_items=6)
    items = [(i, " ".join(words(t)[:4])) for i, (_, t) in enumerate(items)] + [(50, "ça z a"), (51, "unknown a")]
    d, b = tables(spark, docs, items)
    got = decontamination.proximity_matches(decontamination.build_index(d, segment_bytes=300), b, 7).collect()
    want = [(doc, item, 0, at, n) for doc, t in docs for item, p in items if words(p) for at, n in brute_near(words(t), words(p), 7)]
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_memory_of_a_look_up_does_not_grow_with_the_items():
    """Windows whose rarest term is frequent: all candidates at once were 40 million here."""
    import tracemalloc

    import pyarrow as pa

    from chromatile.llm.decontamination import Block, Segment, _occurrences, _segment

    words = [b"a", b"b"] * 10_000 + [b"a", b"a", b"b"]
    segment = next(Segment.rows([_segment(pa.array([1, 2]), words, np.array([20_000, 3], np.int32))]))[1]
    items = pa.table({"_item": pa.array(range(4000)), "_at": pa.array([0] * 4000, pa.int32()), "_words": [["a", "a", "b"] if k % 1000 == 7 else ["b", "b", "a"] for k in range(4000)]})
    block = Block.of(items, 3)
    tracemalloc.start()
    found = [(int(i), int(at), int(start), length) for item, places, starts, length in _occurrences(segment, block) for i, at, start in zip(item, places, starts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(k, 0, 20_001, 3) for k in (7, 1007, 2007, 3007)]
    assert peak < 60e6
    for bounds in ((1, 1), (3, 25_000), (1 << 20, 1 << 40)):
        assert [x[0].tolist() for x in _occurrences(segment, Block.of(items.slice(0, 10), 3), *bounds) if len(x[0])] == [[7]]


def test_row_groups_of_an_index_are_small(spark, tmp_path):
    """A writer holds a row group, and Parquet looks at its size after 100 rows only: of segments, hundreds of megabytes."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(k, f"w{k} x y z") for k in range(40)], "doc_id long, text string").coalesce(1)
    index = decontamination.materialise(decontamination.build_index(docs, segment_bytes=8), "index", decontamination.SEGMENTS_PER_GROUP)
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in index.inputFiles()]
    groups = [f.metadata.row_group(g).num_rows for f in files for g in range(f.num_row_groups)]
    assert sum(groups) == index.count() > 8 and max(groups) <= decontamination.SEGMENTS_PER_GROUP
