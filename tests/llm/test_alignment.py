import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest

from chromatile.llm import alignment
from chromatile.llm.queries import tokenizer_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "The quick brown fox jumps over the lazy dog.", "the the the the the", "naïve café — Ünïcode, 日本語 and 😀 emoji",
    "", None, " ", "two  spaces", "line\nbreak", "tab\there", "<|endoftext|> is plain", "<s> also </s> <unk> <0x41>", "▁", "a", " ", "é", "x" * 3000, "lorem ipsum dolor " * 2000, "ﬁ ligature", "﻿bom", "\x00 nul", "़ mark",
]


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_path())
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    out, counts = [], Counter()
    for _, text in rows:
        a = b = []
        if text:
            e = one.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(chars[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
            b = [(i, piece(i)) for i in two.encode(text)]
            if not b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + text).encode():
                a = b = []
        ends = []
        for side in (a, b):
            at, found = 0, []
            for i, t in side:
                at += len(t)
                found.append((at, i))
            ends.append(found)
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        links = [(i, j) for e, i in ends[0] for f, j in ends[1] if e == f] if len(cuts) < 2000 else [(dict(ends[0])[c], dict(ends[1])[c]) for c in cuts]
        counts.update(links)
        shown, low = [], 0
        for c in cuts:
            shown.append("|".join(",".join(str(i) for e, i in side if low < e <= c) for side in ends) if len(cuts) < 2000 else None)
            low = c
        out.append((a, b, cuts, links, ";".join(shown) if None not in shown else None))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (doc, len(a), len(b), len(cuts), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if shown else "" if shown == "" else None)
        for (doc, _), (a, b, cuts, links, shown) in zip(rows, out, strict=True)
    ]


def got(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS pair", "1 AS _id", "2 AS n_a", "3 AS _row").repartition(3)
    return [tuple(r) for r in alignment.align(docs, tokenizer_path(), PIECES, **more).collect()]


@pytest.mark.parametrize("more", [{}, {"salts": 1, "pairs_per_block": 7}])
def test_equal_to_plain(spark, more):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[0]), (0, TEXTS[0]), (None, None)]
    want = plain(rows)
    assert sum(w[1] > 0 for w in want) > 10 and sum(w[1] == 0 for w in want) > 2
    blank = lambda rows, known: sorted((r if known[k][-1] is not None else r[:-1] + (None,) for k, r in enumerate(rows)), key=str)
    found = sorted(got(spark, rows, **more), key=lambda r: str(r[:-1]))
    want = sorted(want, key=lambda r: str(r[:-1]))
    assert blank(found, want) == blank(want, want)


def test_empty_table_and_texts_without_tokens(spark):
    assert got(spark, []) == []
    assert sorted(got(spark, [(1, None), (2, "")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_texts_of_a_run_do_not_touch():
    together = alignment.align_texts(TEXTS, tokenizer_path(), PIECES)
    for text, found in zip(TEXTS, together, strict=True):
        alone = alignment.align_texts([text], tokenizer_path(), PIECES)[0]
        assert {k: list(v) if hasattr(v, "tolist") else v for k, v in alone.items()} == {k: list(v) if hasattr(v, "tolist") else v for k, v in found.items()}
