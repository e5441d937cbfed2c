"""Operators that SQL cannot express, against plain versions of themselves."""

import base64
import hashlib
import math
import pathlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromatile.llm import _common, language_id, neighbours, packing, quality, warc
from chromatile.llm.queries import tokenizer_path

LONG = " ".join(f"word{i * 7919 % 5003} and" for i in range(20_000))


def test_samples_are_exact(spark):
    rows = spark.createDataFrame([(1, "same", "a")] * 500 + [(i, f"t{i}", "b") for i in range(40)] + [(None, None, "c")], "id long, text string, kind string").repartition(4)
    got = Counter(r.kind for r in _common.sample_by_hash(rows, "kind", 30, "id", "text").collect())
    assert got == {"a": 1, "b": 30, "c": 1}
    assert _common.sample_by_hash(rows.limit(0), "kind", 30, "id").count() == 0
    first = {r.id for r in _common.sample_by_hash(rows.filter("kind = 'b'"), "kind", 7, "id").collect()}
    assert first == {r.id for r in rows.filter("kind = 'b'").orderBy(F.xxhash64("id")).limit(7).collect()}


def test_copies_of_a_hot_row_weigh_once(spark):
    """A third of all rows are equal and have the lowest hash: they are one row of the sample, and no window ranks them."""
    ids = spark.range(6000).withColumn("h", F.xxhash64(F.col("id").cast("string"))).orderBy("h").limit(1).first()[0]
    rows = spark.range(6000).select(F.when(F.col("id") < 2000, F.lit(str(ids))).otherwise(F.col("id").cast("string")).alias("text"), F.lit("a").alias("kind"), "id").repartition(6)
    for most in (1, 10, 800, 2000, 4500):
        got = [r.text for r in _common.sample_by_hash(rows, "kind", most, "text").collect()]
        different = {r.text for r in rows.select("text").distinct().withColumn("h", F.xxhash64("text")).orderBy("h").limit(most).collect()}
        assert len(got) == len(set(got)) and set(got) == different and str(ids) in got


def test_running_sum_over_many_buckets(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 2).alias("b"), "id")
    got = _common.running_sum(rows, ["k"], "b", ["id"], F.col("id"), "s").collect()
    sums = Counter()
    for r in sorted(got, key=lambda r: r.id):
        sums[r.k] += r.id
        assert r.s == sums[r.k]


def plain_probabilities(model, x):
    """The network written out: convolutions of one-hot bytes, maxima, rectified, softmax."""
    one_hot = np.eye(256)[x]
    tops = []
    for w in language_id.WIDTHS:
        n = x.shape[1] - w + 1
        z = sum(one_hot[:, j : j + n] @ model.filters[w][j].astype(float) for j in range(w))
        tops.append(z.max(axis=1))
    h = np.maximum(np.concatenate(tops, axis=1) + model.bias, 0)
    e = np.exp(h @ model.dense + model.dense_bias)
    return e / e.sum(axis=1, keepdims=True)


def test_language_scores_are_those_of_the_network(spark):
    rng = np.random.default_rng(0)
    words = {"en": ["the", "and", "with", "this"], "ru": ["это", "как", "что", "для"], "el": ["και", "της", "στο", "που"]}
    rows = [(i, " ".join(rng.choice(words[k], int(rng.integers(3, 300)))), k) for i, k in enumerate(list(words) * 60)]
    rows += [(5, "the and", "en")] * 400 + [(999, LONG, "en"), (1000, "", None), (1001, None, None), (1002, "123 !", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, docs_per_language=30)
    assert model.languages == ["el", "en", "ru"]
    x = rng.integers(0, 256, (40, language_id.WINDOW)).astype(np.uint8)
    assert np.allclose(language_id.Scorer(model).probabilities(x), plain_probabilities(model, x), atol=1e-4)
    got = {r.doc_id: r for r in language_id.identify(docs.dropDuplicates(), model).collect()}
    for i in (0, 1, 999):
        windows, sizes = language_id.windows_of(rows[[r[0] for r in rows].index(i)][1].encode())
        p = (plain_probabilities(model, windows) * sizes[:, None]).sum(axis=0) / sizes.sum()
        assert got[i].lang_pred == model.languages[p.argmax()] and got[i].score == pytest.approx(p.max(), abs=1e-4)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    held = [r for i, r in got.items() if i < 180]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_languages_beyond_the_bound_are_not_learned(spark):
    docs = spark.createDataFrame([(i, f"word {i}", f"l{i % 6 if i < 60 else 0}") for i in range(90)], "doc_id long, text string, lang string")
    assert len(language_id.train(docs, most_languages=2).languages) == 2


def test_labellers_are_told_by_their_votes():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    votes = np.full((len(good), 5), quality.NONE)
    hits, alarms = (0.9, 0.8, 0.7, 0.95, 0.6), (0.002, 0.001, 0.0, 0.002, 0.001)
    for k in range(5):
        votes[:, k] = np.where(good, rng.random(len(good)) >= alarms[k], rng.random(len(good)) >= hits[k])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table = quality.fit_labellers(patterns, counts.astype(float))
    assert prior == pytest.approx(good.mean(), abs=0.01)
    assert np.allclose(table[:, 0, quality.BAD], hits, atol=0.03) and np.allclose(table[:, 1, quality.BAD], alarms, atol=0.003)
    post = quality.posterior(patterns, prior, table)
    for pattern, p in zip(patterns, post, strict=True):  # Bayes, written out
        bad, fine = (1 - prior) * math.prod(table[k, 0, v] for k, v in enumerate(pattern)), prior * math.prod(table[k, 1, v] for k, v in enumerate(pattern))
        assert p == pytest.approx(fine / (bad + fine), abs=1e-6)


def test_quality_scores_are_those_of_the_model(spark):
    rng = np.random.default_rng(1)
    prose = [" ".join(rng.choice(["the", "river", "of", "and", "stone", "a", "quiet", "to", "house,", "is."], 80)) for _ in range(80)]
    junk = [" ".join(w + "$$$ %%%" for w in rng.choice(["zzx", "qrt", "BUY"], 80)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate([*prose, *junk])] + [(7, prose[7])] * 300 + [(500, LONG), (501, None), (502, " \n"), (503, "x"), (None, prose[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = quality.train(table, sample_rows=60)
    for r in quality.score(table, model).dropDuplicates(["doc_id"]).collect():
        text = dict(rows)[r.doc_id] or ""
        grams = quality._grams(text.encode())
        z = sum(model.weights[g] for g in grams) / (len(grams) + quality.DAMPING) * 16 + model.bias
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)) if text.strip() else 0.0, abs=1e-6)
        assert r.keep == (r.score >= 0.5) and r.votes == "".join(map(str, quality.votes(text)))


def by_hand(pages):
    """What the archives should say of pages (id, html): equal payloads revisit the one with the largest id."""
    top = {}
    for i, html in pages:
        top[html] = max(top.get(html, i), i)
    seen, out = set(), Counter()
    for i, html in pages:
        digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
        first = i == top[html] and (i, html) not in seen
        seen.add((i, html))
        out[i, len(html), digest, "response" if first else "revisit", None if first else top[html]] += 1
    return out


def test_archives_against_plain_python(spark):
    rng = np.random.default_rng(5)
    bits = ["<p>", "WARC/1.1", "\r\n\r\n", "é", "\n", "\x00", "HTTP/1.1 200 OK\r\n\r\n", "text ", "</p>", "filedesc://x 0"]
    pages = [(i, "http://h/" + "%20 é\t"[: i % 6], "".join(rng.choice(bits, int(rng.integers(0, 6))))) for i in range(300)]
    pages += [(400 + i, "http://common", "the common page") for i in range(200)] + [pages[3], pages[3], (900, None, None), (901, "u", LONG)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = Counter(tuple(r) for r in warc.archive_pages(table).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == by_hand([(i, (h or "").encode()) for i, _, h in pages])


def test_version_blocks_documents_without_http_and_binary_payloads(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    raw = bytes(range(256)) * 3 + b"\xe9t\xe9 latin\r\n\r\n"
    records = [(b"dns:h", b"text/dns", b"20200102030405\nh. 3600 IN A 1.2.3.4\n"), (b"http://a", b"text/html", b"HTTP/1.1 200 OK\r\nX-Page-Id: 1\r\n\r\n" + raw), (b"http://b", b"image/x", b"HTTP/1.1 200 OK\r\nX-Page-Id: 2\r\n\r\n" + raw), (b"ftp://c", b"application/x", raw), (b"dns:h", b"text/dns", b"20200102030405\nh. 3600 IN A 1.2.3.4\n")]
    data = warc._arc_block(1, "x.arc", "20200102030405")
    for url, kind, body in records:
        data += b"\n%s 1.2.3.4 20200102030405 %s %d\n" % (url, kind, len(body)) + body
    (tmp_path / "arc" / "x.arc").write_bytes(data)
    for limit in (0, 200_000):
        out = f"{tmp_path}/warc{limit}"
        warc.convert(spark, f"{tmp_path}/arc", out, broadcast_rows=limit)
        rows = sorted((r.target_uri, r.record_type, r.page_id, bytes(r.payload)) for r in warc.read_warc(spark, out, with_payload=True).collect())
        dns = ("dns:h", "resource", None, records[0][2])
        assert rows == [dns, dns, ("ftp://c", "resource", None, raw), ("http://a", "revisit", 1, b""), ("http://b", "response", 2, raw)]
        whole = b"".join(warc.unzipped(f.read_bytes()) for f in pathlib.Path(out).glob("*.gz"))
        kinds = Counter(h["warc-type"] for h, _ in warc.warc_records(whole))
        assert kinds == {"warcinfo": 1, "resource": 3, "response": 1, "revisit": 1}
        info = next((h, b) for h, b in warc.warc_records(whole) if h["warc-type"] == "warcinfo")
        assert info[0]["content-type"] == "application/warc-fields" and info[0]["warc-filename"] == "x.arc" and b"isPartOf: x.arc" in info[1] and "warc-payload-digest" not in info[0]
        assert {h["content-type"] for h, _ in warc.warc_records(whole) if h["warc-type"] == "resource"} == {"text/dns", "application/x"}


def test_archives_that_are_not_zipped_and_of_either_version(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    for version in (1, 2):
        head, date = warc._arc_block(version, "x.arc", "20200102030405"), "20200102030405"
        fields = [f"http://v{version}", "1.2.3.4", date, "text/html", *(["200", "-", "-", "0", "x.arc"] if version == 2 else [])]
        body = f"HTTP/1.0 200 OK\r\nX: y\r\n\r\npage {version}".encode()
        (tmp_path / "arc" / f"v{version}.arc").write_bytes(head + b"\n" + " ".join(fields).encode() + b" %d\n" % len(body) + body)
    (tmp_path / "arc" / "notes.txt").write_text("no archive")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", chunk_bytes=1)
    rows = warc.read_warc(spark, f"{tmp_path}/warc", with_payload=True).collect()
    assert {(r.target_uri, r.date, bytes(r.payload), r.record_type) for r in rows} == {(f"http://v{v}", "2020-01-02T03:04:05Z", f"page {v}".encode(), "response") for v in (1, 2)}
    assert len([f for f in pathlib.Path(f"{tmp_path}/warc").glob("*.gz")]) == 4  # a record, version blocks included, is larger than a chunk


def best_fit(histogram):
    """Sequences that best fit decreasing takes."""
    capacity, room, used = len(histogram) - 1, Counter(), 0
    for length in range(capacity, 0, -1):
        for _ in range(histogram[length]):
            fits = min((r for r, n in room.items() if n and r >= length), default=None)
            if fits is None:
                used, fits = used + 1, capacity
            else:
                room[fits] -= 1
            room[fits - length] += 1
    return used


@pytest.mark.parametrize("seed", range(6))
def test_plans_take_few_sequences(seed):
    rng = np.random.default_rng(seed)
    capacity = (64, 256)[seed % 2]
    histogram = np.zeros(capacity + 1, np.int64)
    lengths = np.clip((rng.lognormal(3 + seed % 3, 0.9, 3000)).astype(int), 1, capacity)
    np.add.at(histogram, lengths, 1)
    planned = packing.plan(histogram)
    again = np.zeros_like(histogram)
    for parts, times in planned:
        assert sum(parts) <= capacity and times > 0
        for x in parts:
            again[x] += times
    assert (again == histogram).all()
    n = sum(times for _, times in planned)
    assert math.ceil((histogram * np.arange(capacity + 1)).sum() / capacity) <= n <= best_fit(histogram) * 1.01 + 1


def test_ids_are_those_of_the_library_on_all_small_documents(spark):
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(tokenizer_path())
    encode = packing.encoder(tokenizer_path(), added=True)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts:
        assert encode(text).tolist() == real.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("measure", neighbours.MEASURES)
def test_scores_are_exact_in_their_own_precision(spark, kind, measure):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(300, 12))
    rows = [(i, p.tolist(), i) for i, p in enumerate(points)]
    got = neighbours.nearest(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, score int"), F.col("vec_id") % 20 == 0, k=5, measure=measure, queries_per_block=4, rows_per_chunk=50).collect()
    own = points.astype(np.float32).astype(float) if kind == "float" else points
    assert len(got) == 15 * 5
    for r in got:
        a, b = own[r.query_id], own[r.vec_id]
        assert r.score == pytest.approx(a @ b if measure == "inner" else -((a - b) ** 2).sum(), abs=1e-12)
    with pytest.raises(ValueError, match="measure"):
        neighbours.nearest(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, score int"), F.lit(True), measure="other")


@pytest.mark.parametrize("measure", neighbours.MEASURES)
def test_few_are_reranked_and_recall_is_from_the_codes(spark, measure):
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(60, 16))
    points = (centres[rng.integers(0, 60, 4000)] + 0.35 * rng.normal(size=(4000, 16))).astype(np.float32)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    books = neighbours.train(rows, codebooks=8)
    index = neighbours.build_index(rows, books).cache()
    queries = index.filter("_id % 100 = 0").select("_id", "_vector")
    exact = points.astype(float)

    def recall(index, rerank):
        got = neighbours.search(index, queries, books, 10, measure, rerank, queries_per_block=16, rows_per_chunk=700).collect()
        hits = 0
        for q in range(0, 4000, 100):
            score = exact @ exact[q] if measure == "inner" else -((exact - exact[q]) ** 2).sum(axis=1)
            best = {i for i in np.lexsort((np.arange(4000), -score)) if i != q}
            top = [i for i in np.lexsort((np.arange(4000), -score)) if i != q][:10]
            assert best
            hits += len({r.vec_id for r in got if r.query_id == q} & set(top))
        return hits / 400

    assert recall(index, 50) >= 0.9
    shuffled = index.select("_id", "_vector", "_norm").join(index.select((4000 - 1 - F.col("_id")).alias("_id"), "_codes"), "_id")
    assert recall(shuffled.select("_id", "_vector", "_codes", "_norm"), 50) < 0.5
    index.unpersist()


def _other_vectors(kind):
    rng = np.random.default_rng(31)
    points = rng.normal(size=(3000, 24))
    if kind == "lengths":
        return points * (1 + rng.pareto(0.7, size=(3000, 1)))
    if kind == "huge":
        return points * 1e20
    if kind == "tiny":
        return points * 1e-30
    if kind == "rare":  # tight groups of which the sample may hold little, far from the rest
        return np.where(rng.random((3000, 1)) < 0.1, 5 * rng.normal(size=24) + 1e-3 * points, points / 8)
    return rng.normal(size=24) + 1e-4 * points


@pytest.mark.parametrize("measure", neighbours.MEASURES)
@pytest.mark.parametrize("kind", ["lengths", "huge", "tiny", "rare", "tight"])
def test_no_neighbour_is_missed_whatever_the_rows_are(spark, kind, measure):
    points = _other_vectors(kind).astype(np.float32)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    books = neighbours.train(rows, sample_rows=300, codebooks=4)
    index = neighbours.build_index(rows, books)
    queries = index.filter("_id % 100 = 0").select("_id", "_vector")
    got = neighbours.search(index, queries, books, 20, measure, 25, queries_per_block=16, rows_per_chunk=900).collect()
    exact = points.astype(float)
    for q in range(0, 3000, 100):
        score = (exact * exact[q]).sum(axis=1) if measure == "inner" else -((exact - exact[q]) ** 2).sum(axis=1)
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.vec_id, r.score) for r in own] == [(i, score[i]) for i in np.lexsort((np.arange(3000), -score)) if i != q][:20]


def test_equal_vectors_of_different_chunks_tie_by_id(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 24)).astype(np.float32)
    rows = [(i, base[(i * 7) % 40].tolist()) for i in range(400)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=15, rows_per_chunk=37, queries_per_block=6).collect()
    score = {q: [sum(float(a) * float(b) for a, b in zip(rows[q][1], rows[i][1])) for i in range(400)] for q in range(0, 400, 20)}
    for q in range(0, 400, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in own] == sorted((i for i in range(400) if i != q), key=lambda i: (-round(score[q][i], 9), i))[:15]


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_drop_copies_by_ranges_shuffles_no_unrepeated_document(spark):
    from chromatile.llm import exact_dedup

    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") < 3000, F.col("id") % 1500).otherwise(F.col("id")).cast("string")).alias("text"), F.lit("x").alias("source")).repartition(5)
    want = sorted(r.doc_id for r in exact_dedup.drop_copies(rows).collect())
    assert want == [*range(1500), *range(3000, 4000)]
    ranged = exact_dedup.drop_copies(rows, broadcast_limit=1500, broadcast_rows=0)
    assert sorted(r.doc_id for r in ranged.collect()) == want and ranged.columns == rows.columns
    # The union's branches without a join by digest are the documents that pass straight through: nearly all of the unrepeated ones, however small the limit.
    plan = ranged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") >= 2


def plain_pieces(value, ranks):
    """Every segment of a value by its definition."""
    from chromatile.llm import secrets as S

    lower = value.lower()
    plain = lower.translate(S._LEET)
    card = lambda c: np.log10(S._cardinality(c))
    for start in range(len(value)):
        yield "brute", start, start + 1, card(value[start])
        for end in range(start + 2, len(value) + 1):
            part = value[start:end]
            rank = ranks.get(lower[start:end]) or ranks.get(plain[start:end])
            if 3 <= end - start <= S.LONGEST_WORD and rank:
                yield "word", start, end, np.log10(rank * 2 ** ((part != lower[start:end]) + (plain[start:end] != lower[start:end]))) + 0.5
            if end - start >= 3 and all((lower[k], lower[k + 1]) in S._BESIDE for k in range(start, end - 1)) and (start == 0 or (lower[start - 1], lower[start]) not in S._BESIDE):
                yield "walk", start, end, np.log10(len(S._BESIDE) * (end - start))
            if end - start >= 3 and len(set(part)) == 1 and (start == 0 or value[start - 1] != part[0]):
                yield "repeat", start, end, np.log10(S._cardinality(part[0]) * (end - start))
            for width in range(2, 17):
                times = (end - start) // width
                if times >= 2 and times * width == end - start and part == part[:width] * times and (times == 64 or start < width or value[start - width : start] != part[:width]):
                    if times <= 64:
                        yield "repeat", start, end, sum(map(card, part[:width])) + np.log10(times)
            if 4 <= end - start <= 10 and part[0].isdigit() and part[-1].isdigit() and S._DATE.fullmatch(part):
                yield "date", start, end, np.log10(365 * 100 if end - start > 4 else 100)


def test_segments_of_values_equal_plain_ones():
    from chromatile.llm import secrets as S

    rng = np.random.default_rng(6)
    parts = ["password", "P4ssw0rd", "qwerty", "asdf", "2024-05-01", "1999", "abcabcabc", "aaaa", "xyxyxyxyxy", "zQ9!", "é", "7", "ß", "hunter2", "20240131", "İ"]
    for _ in range(60):
        value = "".join(rng.choice(parts) for _ in range(int(rng.integers(1, 7))))
        want = sorted(plain_pieces(value, S.RANK)) if "İ" not in value else None
        got = sorted((kind, start, end, cost) for end, found in enumerate(S.pieces(value), 1) for kind, start, cost in found)
        if want is not None:
            assert [g[:3] for g in got] == [w[:3] for w in want]
            assert np.allclose([g[3] for g in got], [w[3] for w in want])
        whole = S.segments(value)
        assert "".join(value[s:e] for _, s, e, _ in whole) == value


def test_very_long_values_take_time_in_proportion():
    import time

    from chromatile.llm import secrets as S

    rng = np.random.default_rng(1)
    value = "".join(rng.choice(list("abcdef0123456789XYZ+/"), 200_000))
    began = time.time()
    spans = S.scan(f"token={value} and password = 'ab'")
    took = time.time() - began
    assert spans[0][:3] == ("assign", 0, 6 + len(value)) and spans[0][3] > 100_000 and {s[0] for s in spans[1:]} <= {"hex"} and took < 30
    began = time.time()
    assert S.guess_cost("ab" * 100_000) < S.guess_cost(value[:10_000]) and time.time() - began < 30
