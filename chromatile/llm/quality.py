"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
over the counts of vote patterns (of all documents; at most 3 ** labellers patterns) estimates how
accurate each labeller is, without any label. The posterior of a document's votes is its soft label;
on a bounded sample of documents it trains a linear scorer over hashed byte n-grams, which then
scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise, sample_by_hash

GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("symbols", "capitals", "shouting", "bars", "function_words", "punctuation", "repeated_lines", "word_length", "repeated_words")
BUCKETS = 1 << 16
GRAM = 4

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """the of and to a in is it that for on with as was be by this are from or an not but at
    der die das und in zu den von mit ist im nicht ein eine auf für des sich dem als auch es an
    le la les de des un une et à il elle que qui dans pour par sur ne pas est du au ou
    el los las y en que un una por con para no se su al lo como es del""".split()
)
_CLASS = {"upper": range(65, 91), "lower": range(97, 123), "high": range(128, 256), "digit": range(48, 58), "white": (9, 10, 11, 12, 13, 32), "bars": (124, 9), "stops": (46, 44, 59, 58, 63), "quotes": (39, 34, 45, 40, 41), "bang": (33,)}
_MEMBER = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASS.items()}


def votes(text: str) -> list[int]:
    """What each labeller says on a text; nothing on a text without words."""
    words = text.split()
    if not words:
        return [NONE] * len(LABELLERS)
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(data, minlength=256)
    n = {k: int(counts[m].sum()) for k, m in _MEMBER.items()}
    solid, letters, many = max(1, len(data) - n["white"]), max(1, n["upper"] + n["lower"] + n["high"]), len(words)
    plain = n["upper"] + n["lower"] + n["high"] + n["digit"] + n["stops"] + n["quotes"] + n["bang"]

    def say(value: float, good: bool, bad: bool) -> int:
        return BAD if bad else GOOD if good else NONE

    odd = 1 - min(solid, plain) / solid
    capital, bang, bars, stops = n["upper"] / letters, n["bang"] / many, n["bars"] / many, n["stops"] / many
    frequent = sum(w.strip(".,;:!?").lower() in FUNCTION_WORDS for w in words) / many
    lines = [x for x in (x.strip() for x in text.split("\n")) if x]
    again = 1 - len(set(lines)) / len(lines)
    mean = letters / many
    echo = sum(a == b for a, b in zip(words, words[1:], strict=False)) / many
    return [
        say(odd, odd < 0.03, odd > 0.12),
        say(capital, capital < 0.15, capital > 0.4),
        say(bang, bang < 0.03, bang > 0.2),
        say(bars, bars < 0.01, bars > 0.1),
        say(frequent, frequent > 0.15, frequent < 0.03 and many >= 20),
        say(stops, 0.03 < stops < 0.4, many >= 50 and (stops < 0.01 or stops > 0.8)),
        say(again, len(lines) >= 3 and again < 0.1, len(lines) >= 4 and again > 0.4),
        say(mean, 2.5 < mean < 9, mean > 16 or mean < 1.5),
        say(echo, echo < 0.06, echo > 0.2),
    ]


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, anchor: float = 0.002, free_rounds: int = 1) -> tuple[float, np.ndarray]:
    """(share of good documents, P(vote | class) as (labeller, class, vote)) by EM, first taking any vote for bad as right.

    patterns: (n, labellers) of votes; counts: documents of each. Votes are independent given the
    class, and a labeller that says nothing does not count. Until EM has settled, labellers are taken
    to call bad at most ``anchor`` of the good documents, which ties the two classes to their names;
    then ``free_rounds`` rounds estimate these rates too (one: from documents judged with the bound).
    """
    n, k = patterns.shape
    one_hot = np.eye(3)[patterns]
    post = np.where((patterns == BAD).any(axis=1), 0.05, 0.95)
    prior, table, left = 0.5, np.full((k, 2, 3), 1 / 3), rounds
    free = False
    while left:
        left -= 1
        weight = np.stack([(1 - post) * counts, post * counts])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        table = np.einsum("cn,nkv->kcv", weight, one_hot) + 0.5
        table /= table[:, :, :NONE].sum(axis=2, keepdims=True)
        if not free:
            table[:, 1, BAD] = np.minimum(table[:, 1, BAD], anchor)
            table[:, 1, GOOD] = 1 - table[:, 1, BAD]
        table[:, :, NONE] = 1.0  # saying nothing tells nothing
        new = posterior(patterns, prior, table)
        if not free and (not left or np.abs(new - post).max() < 1e-9):
            free, left = True, free_rounds
        post = new
    return float(prior), table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """P(good | votes) of patterns (n, labellers)."""
    k = np.arange(patterns.shape[1])
    bad, good = np.log(table[k, 0, patterns]).sum(axis=1), np.log(table[k, 1, patterns]).sum(axis=1)
    return 1 / (1 + np.exp(np.clip(bad - good + np.log((1 - prior) / prior), -50, 50)))


def accuracies(table: np.ndarray, prior: float) -> dict[str, float]:
    """How often each labeller is right when it votes."""
    right = (1 - prior) * table[:, 0, BAD] + prior * table[:, 1, GOOD]
    wrong = (1 - prior) * table[:, 0, GOOD] + prior * table[:, 1, BAD]
    return {name: float(r / (r + w)) for name, r, w in zip(LABELLERS, right, wrong, strict=True)}


@dataclass
class Model:
    prior: float
    table: np.ndarray
    weights: np.ndarray
    bias: float


#: Added to the number of n-grams, so that a short text is not judged by a few of them.
DAMPING = 64
#: Bucket for a word that equals the one before it.
ECHO = 1


def _grams(data: bytes) -> np.ndarray:
    """Bucket of each n-gram of a text's bytes, blanks around it, and of each repeated word."""
    words = data.split()
    echoes = sum(a == b for a, b in zip(words, words[1:], strict=False))
    x = np.frombuffer(b" " + data + b" " * (GRAM - 1), np.uint8).astype(np.uint32)
    h = np.zeros(len(x) - GRAM + 1, np.uint32)
    for j in range(GRAM):
        h = h * np.uint32(0x01000193) ^ x[j : j + len(h)] * np.uint32(0x9E3779B1)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)
    return np.append(h, np.full(echoes, ECHO, np.uint32))


def fit_scorer(texts: list[bytes], labels: np.ndarray, epochs: int = 8, rate: float = 0.5, seed: int = 0) -> tuple[np.ndarray, float]:
    """Logistic regression on n-gram shares with soft labels, by Adagrad; both classes weigh the same."""
    weights, bias, seen, seen_bias = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    rows = []
    for t in texts:
        at, n = np.unique(_grams(t), return_counts=True)
        rows.append((at, n / (n.sum() + DAMPING) * 16))
    good = max(labels.mean(), 1e-3)
    balance = labels / good + (1 - labels) / max(1 - good, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            g = (1 / (1 + np.exp(-np.clip(weights[at] @ x + bias, -30, 30))) - labels[i]) * balance[i]
            step = g * x
            seen[at] += step * step
            weights[at] -= rate * step / np.sqrt(seen[at])
            seen_bias += g * g
            bias -= rate * g / np.sqrt(seen_bias)
    return weights, float(bias)


def score_text(data: bytes, model: Model) -> float:
    """P(good) of a whole text by the linear scorer."""
    grams = _grams(data)
    z = model.weights[grams].sum() / (len(grams) + DAMPING) * 16 + model.bias
    return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000, seed: int = 0) -> Model:
    """Estimate the labellers on all documents, then fit the scorer.

    The scorer is fitted on at most ``sample_rows`` whole documents, half of them likely bad as far as
    there are so many, chosen by a hash of the text, so that copies count once.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("_text"))
    mark = F.xxhash64("_text", F.lit(seed))
    voted = materialise(_with_votes(texts.select(mark.alias("_mark"), "_text")), "votes")
    rows = voted.groupBy(F.col("_votes").alias("votes")).agg(F.count(F.lit(1)).alias("n")).collect()
    k = len(LABELLERS)
    rows = sorted((r["votes"], r["n"]) for r in rows if r["votes"] != str(NONE) * k)
    if not rows:
        return Model(0.5, np.full((k, 2, 3), 1 / 3), np.zeros(BUCKETS), 0.0)
    patterns, counts = np.array([[int(c) for c in v] for v, _ in rows]), np.array([n for _, n in rows], float)
    prior, table = fit_labellers(patterns, counts)
    post = posterior(patterns, prior, table)
    bad = [v for (v, _), p in zip(rows, post, strict=True) if p < 0.5]
    is_bad = F.col("_votes").isin(bad) if bad else F.lit(False)
    likely = voted.filter(F.col("_votes") != str(NONE) * k).withColumn("_bad", is_bad)
    marks = sample_by_hash(likely, "_bad", sample_rows // 2, "_mark")
    marks = materialise(marks.select("_mark", "_votes"), "sample")  # at most sample_rows
    found = texts.withColumn("_mark", mark).join(F.broadcast(marks), "_mark").select("_text", "_votes", "_mark")
    got = sorted((r["_text"].encode(), r["_votes"]) for r in found.dropDuplicates(["_mark"]).select("_text", "_votes").collect())
    discard(voted)
    soft = dict(zip((v for v, _ in rows), post, strict=True))
    weights, bias = fit_scorer([d for d, _ in got], np.array([soft[v] for _, v in got]), seed=seed)
    return Model(prior, table, weights, bias)


def _with_votes(texts: DataFrame) -> DataFrame:
    """(_mark, _votes) of rows (_mark, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                codes = ["".join(map(str, votes(t or ""))) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.string())], ["_mark", "_votes"])

    return texts.mapInArrow(run, "_mark long, _votes string")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, score (of the scorer), weak_label (posterior of the votes), votes, keep.

    Texts without words (null, empty, white space) have score 0 and are not kept. Ids may be null or
    repeat; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                said = [votes(t) for t in texts]
                weak = posterior(np.array(said), model.prior, model.table)
                scores = [score_text(t.encode(), model) if t.strip() else 0.0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(weak), pa.array(["".join(map(str, v)) for v in said]), pa.array([s >= threshold for s in scores], pa.bool_())], ["key", "score", "weak_label", "votes", "keep"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(id_col, F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"key {kind}, score double, weak_label double, votes string, keep boolean").withColumnRenamed("key", id_col)
