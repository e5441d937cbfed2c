"""Secret scans: fixed patterns, and guess-cost analysis of values in credential contexts.

The base kinds are found by their patterns. The method adds the kind ``guess``: a value after a
credential word, in the user part of a URL or after an authorisation scheme, whose guess cost is high.
The cost is that of the cheapest segmentation into words, dates, repeats, keyboard walks and
brute-force spans, found by dynamic programming over the value. Words are common password words and
the most frequent words of the scanned corpus. Values of the base kind ``assign`` get a cost too.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise

KINDS = ("assign", "access", "hex", "guess")

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

# Credential contexts beyond the base kinds; group 1 is the value.
CONTEXTS = (
    re.compile(r"""(?:pwd|pass(?:phrase|code)?|credentials?|auth|private_?key|access_?key|client_?secret|password|passwd|secret|token|api_?key)["']?[\x20\t]*[:=][\x20\t]*["']?([^\s"'<>,;]{8,})""", re.I | re.A),
    re.compile(r"""\b(?:bearer|basic)\x20+([A-Za-z0-9+/_.=-]{16,})""", re.I | re.A),
    re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s/:@]*:([^\s/@]{6,})@""", re.I | re.A),
)
_TRIGGERS = re.compile(r"p(?:wd|ass)|credential|auth|key|secret|token|bearer|basic|://|AKIA", re.I | re.A)

# Common password words, most common first.
WORDS = """password qwerty admin welcome monkey dragon letmein login master hello freedom whatever
trustno shadow sunshine princess football baseball iloveyou superman batman michael jordan jennifer
hunter harley ranger buster soccer hockey killer george charlie andrew michelle love secret summer
winter spring autumn test user guest root default changeme example token pass key temp demo server
data base cloud access public private service system company house money world computer internet
january february march april june july august september october november december monday friday""".split()
RANK = {word: k + 1 for k, word in enumerate(WORDS)}
#: Letters of a word of the corpus.
SHORTEST_WORD, LONGEST_WORD = 4, 16

#: Rows of a keyboard; a walk is a run of neighbours along a row, in either direction.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_BESIDE = {(a, b) for row in ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))}
_DATE = re.compile(r"(?:(?:19|20)\d\d[-./_]?(?:0?[1-9]|1[0-2])[-./_]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-./_]?(?:0?[1-9]|[12]\d|3[01])[-./_]?(?:19|20)\d\d|(?:19|20)\d\d)", re.A)
_LEET = str.maketrans("4@3017$5", "aaeoltss")


SEGMENTS = ("brute", "word", "walk", "repeat", "date")


def _cardinality(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


@lru_cache(1 << 16)
def _log_cardinality(c: str) -> float:
    return math.log10(_cardinality(c))


#: Longest unit of a repeat, and most times it counts.
UNIT, TIMES = 16, 64


def pieces(value: str, ranks: dict[str, int] = RANK) -> Iterator[list[tuple[str, int, float]]]:
    """For each end 1 to len(value) the segments that can end there: (kind, start, log10 of the guesses).

    Work and memory for an end do not depend on the length of the value.
    """
    n, lower = len(value), value.lower()
    lower = lower if len(lower) == n else "".join(c if len(c.lower()) > 1 else c.lower() for c in value)
    plain = lower.translate(_LEET)
    walk = repeat = 0  # where the walk and the repeat that end here begin
    runs = [0] * (UNIT + 1)  # by width: how many characters up to here equal the one that far before
    costs = array("d", [0.0])  # of brute force from the beginning
    for end in range(1, n + 1):
        here = _log_cardinality(value[end - 1])
        costs.append(costs[-1] + here)
        found = [("brute", end - 1, here)]
        for start in range(max(0, end - LONGEST_WORD), end - 2):
            rank = ranks.get(lower[start:end]) or ranks.get(plain[start:end])
            if rank:
                changed = (value[start:end] != lower[start:end]) + (plain[start:end] != lower[start:end])
                found.append(("word", start, math.log10(rank * 2**changed) + 0.5))
        if end > 1 and (lower[end - 2], lower[end - 1]) not in _BESIDE:
            walk = end - 1
        if end - walk >= 3:
            found.append(("walk", walk, math.log10(len(_BESIDE) * (end - walk))))
        if end > 1 and value[end - 2] != value[end - 1]:
            repeat = end - 1
        if end - repeat >= 3:
            found.append(("repeat", repeat, math.log10(_cardinality(value[end - 1]) * (end - repeat))))
        for width in range(2, min(UNIT, end - 1) + 1):
            if value[end - 1] != value[end - 1 - width]:
                runs[width] = 0
                continue
            runs[width] += 1
            if runs[width] >= width:
                times = min(TIMES, 1 + runs[width] // width)
                found.append(("repeat", end - times * width, costs[end] - costs[end - width] + math.log10(times)))
        for width in range(4, min(10, end) + 1):
            if value[end - width].isdigit() and value[end - 1].isdigit() and _DATE.fullmatch(value, end - width, end):
                found.append(("date", end - width, math.log10(365 * 100 if width > 4 else 100)))
        yield found


def segments(value: str, ranks: dict[str, int] = RANK) -> list[tuple[str, int, int, float]]:
    """The cheapest segmentation of ``value``: (kind, start, end, log10 of the guesses)."""
    total, origin, kinds, own = array("d", [0.0]), array("q", [0]), array("b", [0]), array("d", [0.0])
    for found in pieces(value, ranks):
        whole, start, kind, cost = min((total[start] + cost, start, kind, cost) for kind, start, cost in found)
        total.append(whole)
        origin.append(start)
        kinds.append(SEGMENTS.index(kind))
        own.append(cost)
    out, end = [], len(value)
    while end:
        out.append((SEGMENTS[kinds[end]], origin[end], end, own[end]))
        end = origin[end]
    return out[::-1]


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses that the cheapest segmentation takes."""
    return sum(s[3] for s in segments(value, ranks))


def word_ranks(docs: DataFrame, text_col: str = "text", most: int = 20_000, least: int = 20) -> dict[str, int]:
    """Ranks of words: the common password words first, then words of letters a-z by how often the whole corpus has them.

    At most ``most`` words come from the corpus, and none that it has fewer than ``least`` times, so
    that a password does not become a word by being there once. Counts combine on the map side; the
    driver sees how many words each level of counts has (16 levels a doubling), and then the words of
    the highest levels that together have at most ``most``.
    """
    words = F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(rf"(?<![a-z])[a-z]{{{SHORTEST_WORD},{LONGEST_WORD}}}(?![a-z])"), F.lit(0))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    counts = materialise(counts.withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "words")
    room, lowest = most, None
    for row in sorted(counts.groupBy("level").agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        room -= row["k"]
        if room < 0:
            break
        lowest = row["level"]
    found = [] if lowest is None else sorted((-r["n"], r["word"]) for r in counts.filter(F.col("level") >= lowest).select("n", "word").collect())
    discard(counts)
    return RANK | {word: k + 1 + len(RANK) for k, word in enumerate(w for _, w in found if w not in RANK)}


def scan(text: str, threshold: float = 10.0, ranks: dict[str, int] = RANK) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, cost) of every secret in a text, by start, then kind; places are code points.

    The base kinds come from their patterns alone; cost is that of the value, for ``assign`` and
    ``guess``. A value in a credential context is of the kind ``guess`` if its cost is at least
    ``threshold`` and no base span covers the whole of it.
    """
    spans: list[tuple[str, int, int, float | None]] = [("hex", *m.span(), None) for m in HEX.finditer(text)]
    if _TRIGGERS.search(text):
        spans += [("assign", *m.span(), guess_cost(m[2], ranks)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        spans += [("access", *m.span(), None) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
        base = list(spans)
        values = {m.span(1) for pattern in CONTEXTS for m in pattern.finditer(text)}
        open_ = [(a, b) for a, b in values if not any(s <= a and b <= e for _, s, e, _ in base)]
        spans += [("guess", a, b, cost) for a, b in open_ if (cost := guess_cost(text[a:b], ranks)) >= threshold]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 10.0, ranks: dict[str, int] | None = None) -> DataFrame:
    """One row per row of ``docs``: its id and ``secrets``, array of (kind, start, end, value, cost).

    Whole texts are scanned; a null text is empty and has none. Ids may be null or repeat. ``ranks``
    (see ``word_ranks``) are counted on ``docs`` if not given.
    """
    ranks = word_ranks(docs, text_col) if ranks is None else ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("cost", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [[{"kind": k, "start": s, "end": e, "value": t[s:e], "cost": c} for k, s, e, c in scan(t, threshold, ranks)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["key", "secrets"])

    schema = f"key {docs.schema[id_col].dataType.simpleString()}, secrets array<struct<kind: string, start: long, end: long, value: string, cost: double>>"
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("key", id_col)


def redacted(docs: DataFrame, text_col: str = "text", threshold: float = 10.0, mask: str = "[secret]", ranks: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with the span of every secret (of an assignment: its key too) replaced by ``mask``; all columns stay."""
    ranks = word_ranks(docs, text_col) if ranks is None else ranks
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        for start, end in reversed(_merged(scan(text, threshold, ranks))) if text else ():
            text = text[:start] + mask + text[end:]
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    flat = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return flat.mapInArrow(run, flat.schema)


def _merged(spans: list[tuple]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for _, start, end, _ in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def digests(found: DataFrame, id_col: str = "doc_id", threshold: float = 10.0) -> DataFrame:
    """From ``find_secrets``: counts by kind, n_weak (assigned values that cost less than ``threshold``), base_sha256 and spans as text."""
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *[count(k) for k in KINDS], F.size(F.filter("secrets", lambda s: (s["kind"] == "assign") & (s["cost"] < threshold))).cast("long").alias("n_weak"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))
