"""The registered queries that SQL cannot express, over the smallest given tables, against plain versions of their contracts."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chromatile.llm import queries
from chromatile.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_op4_counts_before_and_after_the_edits(spark, documents):
    real = _tokenizer()
    count = lambda text: len(real.encode(text, add_special_tokens=False).ids)
    rows = queries.op4_token_counts(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        text = documents[r.doc_id]
        assert (r.n_tokens_before, r.n_tokens_after) == (count(text), count(re.sub("[0-9]{3,}", "000", text))), r.doc_id
        assert r.n_edits == len(re.findall("[0-9]{3,}", text))


def test_op5_pieces_and_places(spark, documents):
    real = _tokenizer()
    ids = {k: [*real.encode(t, add_special_tokens=False).ids, 2] for k, t in documents.items()}
    rows, sequences = queries.op5_packing(spark, SF).collect(), defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for k, own in by_doc.items():
        at = 0
        for n, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and (len(ids[k]) <= 1024) <= (len(own) == 1)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + r.length], "<u4").tobytes()) and (n == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids[k])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * (sum(map(len, ids.values())) / 1024) + 2


def test_op6_base_spans(spark):
    larger = SF.replace("0.001", "0.01")  # the smallest table holds no secret
    documents = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text").collect()}
    patterns = (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
    )
    rows = queries.op6_secrets(spark, larger).collect()
    assert len(rows) == len(documents)
    for r in rows:
        found = [(m.start(), k, kind, m.end()) for k, (kind, p, flags, holds) in enumerate(patterns) for m in re.finditer(p, documents[r.doc_id], flags) if holds(m)]
        line = [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[2] == kind for f in found) for kind, *_ in patterns)
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest() and set(line) <= set(r.spans.split(","))
    assert any(r.spans for r in rows)


def test_op7_languages(spark, documents):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op7_language_id(spark, SF).collect()
    assert {r.doc_id for r in rows} == truth.keys() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in documents[r.doc_id])) for r in rows)
    judged = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(judged) > 20 and sum(judged) >= 0.85 * len(judged)


def test_op8_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, points = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in queries.op8_nearest_neighbours(spark, SF).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    asked = [i for i, v in enumerate(ids) if v % 20 == 0 and points[i].any()]
    assert got.keys() == {ids[i] for i in asked}
    hits = 0
    for i in asked:
        score = points @ points[i]
        best = [ids[j] for j in np.lexsort((ids, -score)) if j != i][:20]
        own = sorted(got[ids[i]])
        assert [r for r, _, _ in own] == list(range(1, 21)) and [s for _, _, s in own] == sorted((s for _, _, s in own), reverse=True)
        assert all(s == pytest.approx(score[ids == v][0], abs=1e-9) for _, v, s in own)
        hits += len(set(best) & {v for _, v, _ in own})
    assert hits >= 0.9 * 20 * len(asked)


def test_op9_scores_follow_the_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op9_quality(spark, SF).collect()
    good = [r.keep for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.keep for r in rows if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_op10_records(spark):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    top = {}
    for i, html in pages:
        top[html] = max(top.get(html, i), i)
    want = sorted((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if i == top[h] else "revisit", -1 if i == top[h] else top[h]) for i, h in pages)
    got = queries.op10_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((*r[:4], -1 if r[4] is None else r[4]) for r in map(tuple, got)) == want


def test_op11_alignment(spark, documents):
    import public_tokenizers
    import sentencepiece

    one = _tokenizer()
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    piece = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", two.id_to_piece(i)) else two.id_to_piece(i).replace("▁", " ").encode()
    facts, counts = {}, Counter()
    for k, text in documents.items():
        e = one.encode(" " + text, add_special_tokens=False)
        a = [(i, len(bytes(chars[c] for c in t))) for i, t in zip(e.ids, e.tokens, strict=True)] if text else []
        b = [(i, piece(i)) for i in two.encode(text)] if text else []
        if b"".join(t for _, t in b) != (" " + text).encode():
            a, b = [], []
        groups, links, x, y, at, bt, left = [], [], 0, 0, [], [], list(b)
        for i, n in a:
            x += n
            at.append(i)
            while left and y < x:
                j, t = left.pop(0)
                y += len(t)
                bt.append(j)
            if x == y:
                links.append((at[-1], bt[-1]))
                groups.append(f"{','.join(map(str, at))}|{','.join(map(str, bt))}")
                at, bt = [], []
        counts.update(links)
        facts[k] = (len(a), len(b), len(groups), links, ";".join(groups))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    rows = queries.op11_alignment(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        n_a, n_b, n_groups, links, shown = facts[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (n_a, n_b, n_groups, len(links))
        assert (r.n_best, r.count_sum) == (sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links))
        assert r.groups_sha256 == (hashlib.sha256(shown.encode()).hexdigest() if shown else "")
