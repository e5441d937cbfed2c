import hashlib
import pathlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromatile.llm import _common, exact_dedup, language_id, mixing, neighbours, ngram_join, packing, quality, secrets, token_counts, warc
from chromatile.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, _key string, length string, votes string, key string"
LONG = " ".join(f"word{i * 7919 % 5003} and" for i in range(20_000))
TEXTS = [
    "the quick brown fox jumps over the lazy dog and then runs off to the old quiet wood",
    "the quick brown fox jumps over the lazy dog and then runs off to the old quiet wood",
    "The quick  brown fox jumps over the lazy dog and then runs off to the old quiet\twood",
    "the quick brown fox jumps over the lazy dog and then runs off to the old quiet forest",
    "", None, " \t\n", "one two", "One two", "12345 6789", LONG, LONG + " end", "password = 'hunter2hunter2' pwd: zQ9!kf83Lm2x",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, ("b", None, "a")[i % 3], "x", "y", "z", "w") for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, TEXTS[0], None, "a", "x", "y", "z", "w"), (None, None, None, None, "x", "y", "z", "w")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, nothing):
    rows = exact_dedup.find_copies(docs).collect()
    assert len(rows) == 16 and sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert {r.group_size for r in rows if r.keep_id == 0} == {4} and {r.group_size for r in rows if r.keep_id == 4} == {3}
    assert exact_dedup.drop_copies(docs).count() == sum(r.kept for r in rows) and exact_dedup.drop_copies(docs).columns == docs.columns
    once = exact_dedup.drop_copies(docs, broadcast_limit=1, broadcast_rows=0)
    assert sorted(str(r.doc_id) for r in once.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    for limit in (12, 64 << 20):  # rounds over ranges of digests
        assert sorted(map(str, exact_dedup.find_copies(docs, broadcast_limit=limit).collect())) == sorted(map(str, rows))
        for few in (0, 1_000_000):
            stay = exact_dedup.drop_copies(docs, broadcast_limit=limit, broadcast_rows=few)
            assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert exact_dedup.find_copies(nothing).count() == 0 and exact_dedup.drop_copies(nothing).count() == 0


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 16 and all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    assert all(r.target <= 2 * r.source_size for r in rows) and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    unique = docs.filter("doc_id > 0")
    copies, times = Counter(), {}
    for r in mixing.mix(unique).collect():
        copies[r.doc_id] = r.copies
        times[r.doc_id] = r.finish_time
    order = [r.doc_id for r in mixing.mixed(unique, ordered=True).collect()]
    assert Counter(order) == +copies and set(copies.values()) == {0, 1, 2} and order == in_queue(unique.select("doc_id", "text", "source").collect())
    first = list(dict.fromkeys(order))
    assert first == sorted(first, key=times.get)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    sets, top = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) and top[i] != top[j]:
                a, b = sorted((top[i], top[j]))
                top = [a if t == b else t for t in top]
    return top


def test_ngram_join(docs, nothing):
    rows = ngram_join.find_groups(docs).collect()
    assert len(rows) == 16
    want = components(TEXTS)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(shingles(TEXTS[r.doc_id])), want[r.doc_id])
    assert {r.component_id for r in rows if r.doc_id is None} == {0, None}
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 4, 5, 6, 7, 9, 10, 12]
    assert ngram_join.find_groups(nothing).count() == 0 and ngram_join.drop_near_copies(nothing).count() == 0


def test_ngram_join_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        base = [f"w{v}" for v in rng.integers(0, 400, rng.integers(5, 90))]
        for _ in range(int(rng.integers(1, 12))):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 3)):
                copy[at] = f"v{rng.integers(0, 9)}"
            texts.append(" ".join(copy + ["a shared passage of some words that is in all"] * int(rng.integers(0, 2))))
    rows = ngram_join.find_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.component_id for r in sorted(rows)] == components(texts)


def test_ngram_join_of_hot_groups(spark, monkeypatch):
    """A family of near copies, and texts that share a passage and are not linked, in tiles of many blocks."""
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 8)
    rng = np.random.default_rng(4)
    passage, base = [f"p{i}" for i in range(24)], [f"b{i}" for i in range(140)]
    texts = [" ".join(passage + [f"o{i}x{k}" for k in range(4)]) for i in range(90)]
    for _ in range(90):
        copy = list(base)
        for at in rng.integers(0, len(copy), rng.integers(1, 4)):
            copy[at] = f"v{rng.integers(0, 10_000)}"
        texts.append(" ".join(copy))
    want = components(texts)
    assert len(set(want[:90])) == 90 and len(set(want[90:])) < 45
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in sorted(ngram_join.find_groups(table).collect())] == want
    often = ngram_join.frequent(ngram_join.describe(table, "doc_id", "text"))
    members = ngram_join.groups(ngram_join.prefixes(table, "text", often))
    assert ngram_join.pivot_pairs(members).count() <= 2 * members.count()
    dealt = ngram_join.tiles(members.withColumn("_part", F.col("_key")))
    sizes = [r["count"] for r in dealt.groupBy("_tile").count().collect()]
    assert max(sizes) <= 4 * 8 and len(sizes) > 20


def test_token_counts(docs, nothing):
    encode = packing.encoder(tokenizer_path())
    trees = token_counts.build_trees(docs, tokenizer_path())
    assert all(r.n_tokens == len(encode(r.text)) for r in trees.collect()) and token_counts.build_trees(nothing, tokenizer_path()).count() == 0
    edited = token_counts.apply_edits(token_counts.pattern_edits(trees, "[0-9]{3,}|quick ", "<n>"), tokenizer_path())
    for r in edited.collect():
        assert r.n_tokens == len(encode(r.text)) and not re.search("[0-9]{3,}|quick ", r.text)


def test_edits_against_counting_again():
    encode = packing.encoder(tokenizer_path())
    count = lambda s: len(encode(s))
    rng = np.random.default_rng(1)
    alphabet = ["word", " ", "  ", "\n", "don't", "é", "42", "!!", " a", "\t x", " "]
    for _ in range(40):
        text = "".join(rng.choice(alphabet, rng.integers(0, 400)))
        tree = token_counts.CountTree.build(text, count, 32)
        for _ in range(3):
            edits = [(int(a), int(a + rng.integers(0, 40)), "".join(rng.choice(alphabet, rng.integers(0, 6)))) for a in rng.integers(-2, len(text) + 3, rng.integers(0, 5))]
            text, _, _ = tree.edit(text, edits, count)
            assert tree.count == count(text) and tree.chars[1] == len(text)


def test_packing(docs, nothing):
    encode = packing.encoder(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path(), 256, keep_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for group in by.values():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == [sum(x.length for x in group[:k]) for k in range(len(group))] and sum(r.length for r in group) <= 256
    own = sorted((r for r in rows if r.doc_id == 10), key=lambda r: r.piece)
    assert [i for r in own for i in r.ids] == [*encode(LONG), 2] and {r.length for r in own[1:]} == {256}
    assert packing.pack(nothing, tokenizer_path()).count() == 0


def test_encoder_is_that_of_the_file():
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(tokenizer_path())
    real.encode_special_tokens = True
    for text in [t or "" for t in TEXTS] + ["Ünï  çødé\n\n x <|endoftext|> 日本語 don't"]:
        assert list(packing.encoder(tokenizer_path())(text)) == real.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(tokenizer_path())
    ids = lambda t: real.encode(t, add_special_tokens=False).ids
    end = "<|endoftext|>"
    assert ids(f"a {end} b") == [64, 220, 50256, 275]
    texts = [f"a {end} b", end, f"{end}{end}  {end}\n x{end}y", f"don't {end[:-1]} {end.upper()}", f"word  {end} and " * 300, "a <|end 42oftext|> b", f"x {end[:6]}123{end[6:]} y"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.pack(table, tokenizer_path(), 4096, keep_ids=True).collect():
        own = [*ids(texts[r.doc_id]), 2]
        assert (list(r.ids), r.length, r.ids_crc32) == (own, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    trees = token_counts.build_trees(table, tokenizer_path())
    assert all(r.n_tokens == len(ids(r.text)) for r in trees.collect())
    edited = token_counts.apply_edits(token_counts.pattern_edits(trees, " ?[0-9]+|d> a", ""), tokenizer_path()).collect()  # makes and breaks added tokens
    assert len(edited) == len(texts) and all(r.n_tokens == len(ids(r.text)) for r in edited) and any(end in r.text for r in edited if r.doc_id >= 5)


def test_secrets(docs, nothing):
    found = {r.doc_id: r for r in secrets.digests(secrets.find_secrets(docs)).collect()}
    assert found[12].n_assign == 1 and found[12].n_guess == 1 and found[12].spans.startswith("assign:0:") and found[5].spans == ""
    assert secrets.guess_cost("password1234") < 6 < 12 < secrets.guess_cost("zQ9!kf83Lm2x")
    assert secrets.scan("AKIA" + "A" * 12)[0][:3] == ("access", 0, 16) and secrets.scan("0" * 31) == [] and secrets.scan("") == []
    assert "hunter2" not in secrets.redacted(docs).filter("doc_id = 12").first().text
    assert secrets.find_secrets(nothing).count() == 0


def test_secrets_that_base_spans_touch_in_part(spark):
    text = "x secret: hunter22hunter!@#tail y"
    assert [s[:3] for s in secrets.scan(text)] == [("assign", 2, 24), ("guess", 10, 31)]
    assert secrets.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == "x [secret] y"
    ((kind, _, _, cost),) = secrets.scan("password = 'zQ9kf83Lm2x7'")
    assert kind == "assign" and cost == secrets.guess_cost("zQ9kf83Lm2x7")  # covered wholly
    for user in ("", "u" * 65):
        at = len(f"redis://{user}:")
        assert [s[:3] for s in secrets.scan(f"redis://{user}:zQ9!kf83Lm2x@host")] == [("guess", at, at + 12)]


def test_guess_costs_against_all_segmentations():
    rng = np.random.default_rng(6)
    parts = ["password", "P4ssw0rd", "qwer", "abc", "2024", "19991231", "aaaa", "xyxy", "!", "Zk", "7", "river"]
    ranks = {**secrets.RANK, "river": 500}

    def cheapest(found, end):
        return min((cheapest(found, start) + cost for _, start, cost in found[end - 1]), default=0.0) if end else 0.0

    for _ in range(60):
        value = "".join(rng.choice(parts, rng.integers(1, 4)))[:14]
        assert secrets.guess_cost(value, ranks) == pytest.approx(cheapest(list(secrets.pieces(value, ranks)), len(value)))
        own = secrets.segments(value, ranks)
        assert [s[1] for s in own] == [0, *(s[2] for s in own[:-1])] and own[-1][2] == len(value)


def test_base_secrets_against_plain_patterns(spark, nothing):
    rng = np.random.default_rng(7)
    bits = ["password", "Token", "api_key", "apikey", "=", ": ", " ", "'", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "hunter22", "é", "\n", "deadbeef" * 4, "x"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 40))) for _ in range(300)] + [None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.digests(secrets.find_secrets(table)).collect():
        text = texts[r.doc_id] or ""
        base = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
        base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(base))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, _, k, _ in base) for kind in ("assign", "access", "hex"))
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("guess")) == line
    words = spark.createDataFrame([(0, "Lantern lantern LANTERN meadow meadow once"), (1, None)], "doc_id long, text string")
    assert {w: k for w, k in secrets.word_ranks(words, least=2).items() if w not in secrets.RANK} == {"lantern": len(secrets.RANK) + 1, "meadow": len(secrets.RANK) + 2}
    assert {w for w in secrets.word_ranks(words, most=1, least=2) if w not in secrets.RANK} == {"lantern"}
    assert secrets.word_ranks(nothing) == secrets.RANK


def test_language_id(spark, docs, nothing):
    rows = language_id.identify(docs, language_id.train(docs)).collect()
    assert len(rows) == 16 and all(r.lang_pred == ("en" if r.text and re.search("[a-zA-Z]", r.text) else "und") for r in rows)
    assert language_id.identify(nothing, language_id.train(nothing)).count() == 0
    pieces = {"en": ["the", "and", "with", "this"], "de": ["der", "und", "nicht", "mit"]}
    rng = np.random.default_rng(0)
    made = [(i, " ".join(rng.choice(pieces[k], 60)), k) for i, k in enumerate(["en", "de"] * 150)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    out = language_id.identify(table, language_id.train(table)).filter(language_id.held_out(F.col("doc_id")))
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(v) for v in rng.normal(size=16)], 0) for i in range(600)]
    rows += [(600 + i, rows[20][1], 0) for i in range(40)]
    rows += [(700, None, 0), (701, [0.0] * 16, 0), (702, [float("nan")] * 16, 0), (703, [1.0] * 15 + [None], 0), (704, [1.0], 0), (None, rows[1][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, _id int")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    ids, points = np.arange(640), np.array([r[1] for r in rows[:640]], np.float32).astype(float)
    hits = total = 0
    for q in range(0, 640, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        score = points @ points[q]
        best = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(r.score == pytest.approx(score[r.vec_id]) for r in own)
        hits, total = hits + len({r.vec_id for r in own} & set(best)), total + 20
    assert hits >= 0.9 * total and {r.vec_id for r in got if r.query_id == 620} <= set(range(640)) and not any(r.query_id > 640 for r in got)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_quality(spark, docs, nothing):
    assert len(quality.score(docs, quality.train(docs)).collect()) == 16 and quality.score(nothing, quality.train(nothing)).count() == 0
    rng = np.random.default_rng(0)
    prose = [" ".join(rng.choice(["the", "river", "of", "and", "stone", "a", "quiet", "to", "house,", "is."], 80)) for _ in range(200)]
    junk = [" ".join(w + "$$$ %%%" for w in rng.choice(["zzx", "qrt", "BUY"], 80)) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(prose + junk)), "doc_id long, text string")
    keep = {r.doc_id: r.keep for r in quality.score(table, quality.train(table)).collect()}
    assert all(keep[i] for i in range(200)) and not any(keep[i] for i in range(200, 260))


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/x y", "<p>one</p>", 0), (2, None, "<p>one</p>", 0), (3, "http://b", None, 0), (4, "http://c", "", 0), (5, "http://d", "é\r\n\r\nü", 0), (1, "http://a", "<p>one</p>", 0)]
    got = sorted(warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")).collect())
    assert [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got] == [(1, "revisit", 2, 10), (1, "revisit", 2, 10), (2, "response", None, 10), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 8)]
    assert got[4].payload_digest == warc.base32_sha1(b"")
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mixing", "packing"]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= {0, 7, 10, 12} and all(r.length <= 1024 for r in rows)


def in_queue(rows):
    """Ids of rows (id, text, source), ids unique, as the queue of the mix deals them, sorted whole."""
    found = [(s is None, s or "", int(hashlib.md5(f"0:{i}:{t or ''}".encode()).hexdigest()[:15], 16), i, len(words(t))) for i, t, s in rows]
    queue, total = [], sum(d[4] for d in found)
    for rank, source in enumerate(sorted({d[:2] for d in found})):
        own = sorted(d for d in found if d[:2] == source)
        size = sum(d[4] for d in own)
        for epoch in range(2):
            done = size * epoch
            for d in own:
                done += d[4]
                queue += [(done / (5, 2, 1)[rank % 3], *d[:4], epoch, d[4])] * (d[4] > 0)
    out, taken = [], 0
    for entry in sorted(queue):
        taken += entry[-1]
        if taken > 1.5 * total:
            break
        out.append(entry[4])
    return out


def mixed_by_hand(rows):
    return Counter(in_queue(rows))


def test_pipeline_against_plain_python(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    real = Tokenizer.from_file(tokenizer_path())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    first = {}
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        if re.search("[a-zA-Z]", r.text or ""):
            first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r.text), (r.doc_id, r.text, r.source))
    left = list(first.values())
    kept = [left[k] for k in sorted(set(components([t for _, t, _ in left])))]
    assert [d for d, _, _ in kept] == [0, 7, 10, 12]
    copies, want = mixed_by_hand(kept), Counter()
    for i, text, _ in kept:
        ids = [*real.encode(text, add_special_tokens=False).ids, 2]
        ends = [*range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            want[i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += copies[i]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == +want and len(+want) > 10
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 1024


def test_language_stage_without_labels(spark, docs):
    import corpus_pipeline

    lettered = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect() if re.search("[a-zA-Z]", r.text or ""))
    held = F.when(language_id.held_out(F.col("doc_id")), "en")
    for lang in (F.lit(None).cast("string"), held, F.lit("en")):
        kept = corpus_pipeline.language_id_stage(spark, docs.withColumn("lang", lang), "")
        assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == lettered


def test_tables_between_steps(spark):
    before = spark.conf.get(_common.SHUFFLE_CLEANUP)
    table = _common.materialise(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert spark.conf.get(_common.SHUFFLE_CLEANUP) == before
    assert table.agg(F.sum("count")).first()[0] == 100
    folder = pathlib.Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists()
    _common.discard(table)
    assert not folder.exists()
    _common.discard(spark.range(3))  # of no file: nothing to delete
