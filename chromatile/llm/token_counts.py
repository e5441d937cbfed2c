"""Edit-aware token counts: a segment tree of pre-token runs per document.

A leaf is a run of whole pre-tokens of about ``LEAF`` characters; every node holds the characters and
tokens below it. Text is cut only before a blank that follows something else: there a pre-token ends
whatever surrounds it, and no added token holds a blank, so counts of leaves add up to the count of the text. An edit finds its leaves
by the characters in the subtrees, takes one character more on either side as context, encodes only
those leaves again and updates the sums above them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import encoder

LEAF = 256
Edit = tuple[int, int, str]


def leaves(text: str, size: int = LEAF) -> list[int]:
    """Places at which ``text`` is cut: 0, then as often as ``size`` characters later there is a place, then its end."""
    cuts, at = [0], size
    while at < len(text):
        at = text.find(" ", at)
        if at < 0:
            break
        if not text[at - 1].isspace():
            cuts.append(at)
            at += size
        else:
            at += 1
    if len(text) > cuts[-1]:
        cuts.append(len(text))
    return cuts


class CountTree:
    """Sums of characters and tokens in a perfect binary tree: node 1 is the root, node ``half`` the first leaf."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens, self.half = chars, tokens, len(chars) // 2

    @classmethod
    def build(cls, text: str, count: Callable[[str], int], size: int = LEAF) -> CountTree:
        cuts = leaves(text, size)
        parts = [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        half = 1 << max(0, len(parts) - 1).bit_length()
        chars, tokens = np.zeros(2 * half, np.int64), np.zeros(2 * half, np.int64)
        chars[half : half + len(parts)] = [len(p) for p in parts]
        tokens[half : half + len(parts)] = [count(p) for p in parts]
        level = half
        while level > 1:
            for sums in (chars, tokens):
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level //= 2
        return cls(chars, tokens)

    @property
    def count(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """Leaf that holds the character at ``place`` (the nearest one beyond the ends), and where the leaf begins."""
        place, node, start = max(0, min(place, int(self.chars[1]) - 1)), 1, 0
        while node < self.half:
            node *= 2
            if place - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.half, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.half + leaf
        more, many = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += many
            node //= 2

    def edit(self, text: str, edits: Sequence[Edit], count: Callable[[str], int]) -> tuple[str, int, int]:
        """Apply edits (start, end, replacement), places in ``text`` before any of them; update the sums.

        Places beyond the text are taken as its end. An edit that begins before the end of one with a
        smaller start is skipped. Returns the new text, the characters encoded again, and the edits
        applied.
        """
        length, kept, last = len(text), [], 0
        for start, end, new in sorted(edits):
            start, end = min(max(start, 0), length), min(max(start, end, 0), length)
            if start >= last or not kept:
                kept.append((start, end, new))
                last = max(end, start)
        ranges: list[list] = []  # first leaf, last leaf, where they begin and end, edits
        for edit in kept:
            first, begin = self.leaf_at(edit[0] - 1)
            final, at = self.leaf_at(edit[1])
            stop = at + int(self.chars[self.half + final])
            if ranges and first <= ranges[-1][1]:
                ranges[-1][1], ranges[-1][3] = max(ranges[-1][1], final), max(ranges[-1][3], stop)
                ranges[-1][4].append(edit)
            else:
                ranges.append([first, final, begin, stop, [edit]])
        parts, done, encoded = [], 0, 0
        for first, final, begin, stop, own in ranges:
            pieces, at = [], begin
            for start, end, new in own:
                pieces += [text[at:start], new]
                at = end
            region = "".join(pieces) + text[at:stop]
            parts += [text[done:begin], region]
            done = stop
            encoded += len(region)
            self._set(first, len(region), count(region))
            for leaf in range(first + 1, final + 1):
                self._set(leaf, 0, 0)
        return "".join(parts) + text[done:], encoded, len(kept)


_TREE = "chars array<long>, tokens array<long>"


def _lists(trees: list[CountTree]) -> list[pa.Array]:
    offsets = pa.array(np.append(0, np.cumsum([len(t.chars) for t in trees])), pa.int32())
    flat = lambda name: np.concatenate([getattr(t, name) for t in trees]) if trees else np.zeros(0, np.int64)
    return [pa.ListArray.from_arrays(offsets, pa.array(flat(n))) for n in ("chars", "tokens")]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def build_trees(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text (null as empty), n_tokens, and its tree (chars, tokens by node).

    Ids may be null or repeat; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, added=True)
        for part in _parts(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            trees = [CountTree.build(t, lambda s: len(encode(s))) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([t.count for t in trees], pa.int64()), *_lists(trees)], ["key", "text", "n_tokens", "chars", "tokens"])

    schema = f"key {docs.schema[id_col].dataType.simpleString()}, text string, n_tokens long, {_TREE}"
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("key", id_col).withColumnRenamed("text", text_col)


def apply_edits(trees: DataFrame, tokenizer: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trees after their edits: id, new text, n_tokens, tree, and n_edits, n_chars_encoded.

    ``trees`` is what ``build_trees`` (or this function) returns, with an array of (start, end,
    replacement) as ``edits_col``; null is none. See ``CountTree.edit`` for overlaps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, added=True)
        for part in _parts(batches):
            texts, done, encoded, new = [], [], [], []
            for text, chars, tokens, edits in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True):
                tree = CountTree(np.array(chars, np.int64), np.array(tokens, np.int64))
                text, again, n = tree.edit(text, [(e["start"], e["end"], e["replacement"] or "") for e in edits or []], lambda s: len(encode(s)))
                texts.append(text)
                encoded.append(again)
                done.append(n)
                new.append(tree)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([t.count for t in new], pa.int64()), *_lists(new), pa.array(done, pa.int64()), pa.array(encoded, pa.int64())], ["key", "text", "n_tokens", "chars", "tokens", "n_edits", "n_chars_encoded"])

    schema = f"key {trees.schema[id_col].dataType.simpleString()}, text string, n_tokens long, {_TREE}, n_edits long, n_chars_encoded long"
    picked = trees.select(id_col, text_col, "chars", "tokens", edits_col)
    return picked.mapInArrow(run, schema).withColumnRenamed("key", id_col).withColumnRenamed("text", text_col)


def with_edits(trees: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``trees`` with the edits of a table (id, start, end, replacement) as the array ``edits``.

    The edits of a document are in one row, like its text; documents without any have null.
    """
    packed = edits.groupBy(id_col).agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))
    return trees.join(packed, id_col, "left")


def pattern_edits(docs: DataFrame, pattern: str, replacement: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``edits``: every match of a regular expression replaced. A column ``edits`` that is there gives way."""
    docs = docs.drop("edits")
    compiled = re.compile(pattern)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("replacement", pa.string())]))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = [[{"start": m.start(), "end": m.end(), "replacement": replacement} for m in compiled.finditer(t or "")] for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, "edits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, edits array<struct<start: long, end: long, replacement: string>>")
