"""Benchmark passages in a training corpus, by a distributed positional inverted index.

The index is partitioned by document: a segment is a run of documents of one task, and its postings
(for each term the places where it stands, in order) are one row of a table. A phrase is looked up
where its documents are: of its terms the one with the shortest postings gives the candidate starts,
each further term, from rare to common, keeps those whose place is in its own postings shifted by the
term's offset. All phrases of a block are intersected at once. No posting is shuffled, so frequent
terms are no hot keys; documents do not touch in a segment, so no phrase spans two of them.

Test items are cut into overlapping pieces and come in blocks of bounded size; each block is sent to
all segments. What several blocks find in one document is united afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import freeing, materialise, running_sum

# The bytes of a word (lower-case letters, digits, all bytes beyond ASCII), A-Z in lower case; the rest parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Segments in a row group of an index that is written down: a segment is megabytes long.
SEGMENTS_PER_GROUP = 4
#: How many windows are looked up, and about how many candidates of theirs are held, at once.
WINDOWS, CANDIDATES = 1 << 14, 1 << 18


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8."""
    return text.translate(WORD_BYTES).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 4 << 20) -> DataFrame:
    """One row a segment: ids and word counts of its documents, its terms, the length of each term's postings, and all postings.

    A posting is a place in the segment, a 32-bit number: documents follow each other with one free
    place between them. A segment ends once its texts pass ``segment_bytes``; a longer text is in one
    segment with what comes before it, as a whole. Null texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = min(batch.num_rows, 1 + int(np.searchsorted(size, (size[at - 1] if at else 0) + segment_bytes)))
                words, counts = [], []
                for text in texts.slice(at, end - at).to_pylist():
                    own = words_of(text) if text else []
                    counts.append(len(own))
                    words += own
                yield _segment(batch.column(0).slice(at, end - at), words, np.array(counts, np.int32))
                at = end

    schema = f"ids array<{docs.schema[id_col].dataType.simpleString()}>, words array<int>, terms array<binary>, lengths array<int>, places binary"
    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(freeing(run), schema)


def _segment(ids: pa.Array, words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    coded = pa.array(words, pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy()
    places = np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(codes, kind="stable")
    lists = [
        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int32())),
        pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary),
        pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), pa.array(np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32))),
        pa.array([places[order].astype("<i4").tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(lists, ["ids", "words", "terms", "lengths", "places"])


@dataclass
class Segment:
    """A segment of the index in a task."""

    ids: pa.Array
    words: np.ndarray  # of each document
    starts: np.ndarray  # place of each document's first word
    terms: pa.Array
    lengths: np.ndarray
    begins: np.ndarray  # where each term's postings begin
    places: np.ndarray
    size: int  # one more than the last place

    @classmethod
    def rows(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Segment]]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                part = lambda name, row=row: row.column(row.schema.get_field_index(name)).flatten()
                words, lengths = part("words").to_numpy().astype(np.int64), part("lengths").to_numpy().astype(np.int64)
                places = np.frombuffer(row.column(row.schema.get_field_index("places"))[0].as_buffer(), "<i4")
                yield row, cls(part("ids"), words, np.cumsum(words + 1) - words - 1, part("terms"), lengths, np.cumsum(lengths) - lengths, places, int((words + 1).sum()))

    def find(self, vocabulary: pa.Array) -> np.ndarray:
        """The number of each term of ``vocabulary`` in this segment; -1 for none."""
        return pc.fill_null(pc.index_in(vocabulary, self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def postings(self, term: int) -> np.ndarray:
        return self.places[self.begins[term] : self.begins[term] + self.lengths[term]]

    @cached_property
    def keys(self) -> np.ndarray:
        """(term, place) of all postings as one sorted array of numbers."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths) * self.size + self.places

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def phrases(segment: Segment, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, place of its first word) of all occurrences. terms: (phrases, words), numbers of terms the segment has."""
    by_rarity = np.argsort(segment.lengths[terms], axis=1, kind="stable")
    rank = lambda k: terms[np.arange(len(terms)), by_rarity[:, k]]
    rarest = rank(0)
    n = segment.lengths[rarest]
    phrase = np.repeat(np.arange(len(terms)), n)
    start = segment.places[np.repeat(segment.begins[rarest], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] - by_rarity[phrase, 0]
    for k in range(1, terms.shape[1]):
        place = start + by_rarity[phrase, k]
        wanted = rank(k)[phrase] * segment.size + place
        at = np.minimum(np.searchsorted(segment.keys, wanted), len(segment.keys) - 1)
        # A place outside the segment is in no postings; as a key it would read as a place of another term.
        kept = (segment.keys[at] == wanted) & (place >= 0) & (place < segment.size)
        phrase, start = phrase[kept], start[kept]
    return phrase, start


def within(segment: Segment, terms: np.ndarray, width: int) -> list[tuple[int, int]]:
    """First and last place of the shortest runs of at most ``width`` words of a document that hold all ``terms`` (numbers, in any order).

    A run is reported only if it holds no shorter one. Candidates come from the rarest term: every
    further term needs a place less than ``width`` away.
    """
    terms = np.unique(terms)
    if not len(terms) or terms[0] < 0:
        return []
    lists = [segment.postings(t) for t in terms[np.argsort(segment.lengths[terms], kind="stable")]]
    near = lists[0]
    for other in lists[1:]:
        low, high = np.searchsorted(other, near - width, "right"), np.searchsorted(other, near + width)
        near = near[high > low]
    if not len(near):
        return []
    # All places of the terms that lie near a candidate, in order; then one sweep with the latest place of each term.
    merged, which = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(merged, kind="stable")
    merged, which = merged[order], which[order]
    at = np.searchsorted(near, merged)
    gap = np.minimum(np.abs(near[np.minimum(at, len(near) - 1)] - merged), np.abs(near[np.maximum(at - 1, 0)] - merged))
    merged, which = merged[gap < width], which[gap < width]
    latest, found = np.full(len(lists), -1, np.int64), []
    for place, term in zip(merged.tolist(), which.tolist(), strict=True):
        latest[term] = place
        first = int(latest.min())
        if first >= 0 and place - first < width and segment.doc_of(np.array([first]))[0] == segment.doc_of(np.array([place]))[0]:
            if found and found[-1][0] == first:
                continue  # the run that began there and ended sooner lies inside this one
            found.append((first, place))
    return found


def item_pieces(items: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text", piece_words: int = 256) -> DataFrame:
    """_item, _at, _words: items in pieces of at most ``piece_words`` windows; an item of fewer words than a window is one piece.

    Neighbouring pieces share ``window - 1`` words, so that each window lies in just one piece. ``_at`` is the place of a
    piece's first word in its item. Texts that are null or have no word give nothing.
    """
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.col(item_col).alias("_item"), F.regexp_extract_all(lower, F.lit(f"({WORD_PATTERN})")).alias("_all")).filter(F.size("_all") > 0)
    last = F.greatest(F.size("_all") - window, F.lit(0))
    cut = words.withColumn("_at", F.explode(F.sequence(F.lit(0), last, F.lit(piece_words))))
    return cut.select("_item", "_at", F.slice("_all", F.col("_at") + 1, piece_words + window - 1).alias("_words"))


@dataclass
class Block:
    """Test pieces as a task gets them."""

    vocabulary: pa.Array
    codes: np.ndarray  # the words of all pieces, as numbers in ``vocabulary``
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: where each window begins in ``codes``, its item (a number in ``items``, -1 for null), its place in its item
    items: pa.Array

    @classmethod
    def of(cls, table: pa.Table, window: int) -> Block:
        items = table["_item"].combine_chunks().dictionary_encode()
        number = pc.fill_null(items.indices, -1).to_numpy(zero_copy_only=False).astype(np.int32)
        column = table["_words"].combine_chunks()
        coded = column.flatten().dictionary_encode()
        sizes = pc.list_value_length(column).to_numpy().astype(np.int64)
        begins, at, windows = np.cumsum(sizes) - sizes, table["_at"].to_numpy(), {}
        for length in np.unique(np.minimum(sizes, window)).tolist():
            own = np.flatnonzero(np.minimum(sizes, window) == length)
            n = sizes[own] - length + 1
            shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            windows[length] = tuple(x.astype(np.int32) for x in (np.repeat(begins[own], n) + shift, np.repeat(number[own], n), np.repeat(at[own], n) + shift))
        return cls(coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int32), windows, items.dictionary)

    def names(self, number: np.ndarray) -> pa.Array:
        """The ids of items by their numbers."""
        if not len(self.items):
            return pa.nulls(len(number), self.items.type)
        return self.items.take(pa.array(number, mask=number < 0))


def _blocks(pieces: DataFrame, window: int, pieces_per_block: int) -> tuple[int, Iterator[Block]]:
    """How many blocks of at most ``pieces_per_block`` pieces there are, and the blocks one by one."""
    n = pieces.count()
    if n <= pieces_per_block:
        numbered = pieces.withColumn("_number", F.lit(1))
    else:
        dealt = pieces.withColumn("_deal", F.pmod(F.xxhash64("_item", "_at", "_words"), F.lit(1 + n // 1024)))
        numbered = materialise(running_sum(dealt, [], "_deal", ["_item", "_at", "_words"], F.lit(1), "_number"), "pieces")
    part = lambda k: numbered.filter((F.col("_number") > k * pieces_per_block) & (F.col("_number") <= (k + 1) * pieces_per_block))
    blocks = -(-n // pieces_per_block)
    return blocks, (Block.of(part(k).select("_item", "_at", "_words").toArrow(), window) for k in range(blocks))


Emit = Callable[[pa.RecordBatch, Segment, Block], Iterator[pa.RecordBatch]]


def _search(index: DataFrame, blocks: Iterable[Block | None], emit: Emit, schema: str) -> DataFrame:
    spark, out = index.sparkSession, None
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for row, segment in Segment.rows(batches):
                yield from emit(row, segment, sent.value)

        found = index.mapInArrow(freeing(run), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _occurrences(segment: Segment, block: Block, windows: int = WINDOWS, candidates: int = CANDIDATES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each length of windows: item number, place in the item, place in the segment of every occurrence, and the length.

    At most ``windows`` windows are looked up at once, and no more than have ``candidates`` candidates together (or one
    window), so that memory does not grow with the items. What is found comes in as many parts.
    """
    local = segment.find(block.vocabulary)[block.codes]
    absent = np.r_[0, np.cumsum(local < 0)]
    for length, (begin, item, at) in block.windows.items():
        here = np.flatnonzero(absent[begin + length] == absent[begin])  # the segment has all their terms
        for first in range(0, len(here), windows):
            some = here[first : first + windows]
            terms = local[begin[some][:, None] + np.arange(length)]
            starts = np.cumsum(segment.lengths[terms].min(axis=1))  # candidates up to each window
            low = 0
            while low < len(some):
                high = max(low + 1, int(np.searchsorted(starts, (starts[low - 1] if low else 0) + candidates, "right")))
                which, start = phrases(segment, terms[low:high])
                yield item[some[low:high]][which], at[some[low:high]][which], start, length
                low = high


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", pieces_per_block: int = 4096) -> DataFrame:
    """Every occurrence of every window of ``window`` words of the items: document id, item id, item_at, doc_at, length (in words).

    Places count words from 0. An item of fewer words is one window. Items without a word take no part.
    """
    ids, kinds = index.schema["ids"].dataType.elementType.simpleString(), items.schema[item_col].dataType.simpleString()
    pieces = materialise(item_pieces(items, window, item_col, text_col), "pieces")

    def emit(row: pa.RecordBatch, segment: Segment, block: Block) -> Iterator[pa.RecordBatch]:
        for item, at, start, length in _occurrences(segment, block):
            doc = segment.doc_of(start)
            columns = [segment.ids.take(pa.array(doc)), block.names(item), pa.array(at.astype(np.int32)), pa.array((start - segment.starts[doc]).astype(np.int32)), pa.array(np.full(len(item), length, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["_doc", "_item", "item_at", "doc_at", "length"])

    found = _search(index, _blocks(pieces, window, pieces_per_block)[1], emit, f"_doc {ids}, _item {kinds}, item_at int, doc_at int, length int")
    return found.withColumnsRenamed({"_doc": id_col, "_item": item_col})


def proximity_matches(index: DataFrame, items: DataFrame, width: int, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", pieces_per_block: int = 4096, piece_words: int = 16) -> DataFrame:
    """Runs of at most ``width`` words of a document that hold all words of a piece of an item, in any order: document id, item id, item_at, doc_at, length.

    Items are cut into pieces of ``piece_words`` words, the last one may be shorter. A run that holds a shorter one is left out.
    """
    ids, kinds = index.schema["ids"].dataType.elementType.simpleString(), items.schema[item_col].dataType.simpleString()
    pieces = materialise(item_pieces(items, 1, item_col, text_col, piece_words), "pieces")

    def emit(row: pa.RecordBatch, segment: Segment, block: Block) -> Iterator[pa.RecordBatch]:
        words = segment.find(block.vocabulary)[block.codes]
        _, item, at = block.windows[1]
        begins = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(item) != 0) | (at[1:] % piece_words == 0)])
        doc, which, spans = [], [], []
        for begin, end in zip(begins, np.r_[begins[1:], len(words)], strict=True):
            for first, last in within(segment, words[begin:end], width):
                doc.append(segment.doc_of(np.array([first]))[0])
                which.append(begin)
                spans.append((first, last - first + 1))
        if doc:
            doc, which = np.array(doc), np.array(which)
            first, length = np.array(spans).T
            columns = [segment.ids.take(pa.array(doc)), block.names(item[which]), pa.array(at[which].astype(np.int32)), pa.array((first - segment.starts[doc]).astype(np.int32)), pa.array(length.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["_doc", "_item", "item_at", "doc_at", "length"])

    found = _search(index, _blocks(pieces, 1, pieces_per_block)[1], emit, f"_doc {ids}, _item {kinds}, item_at int, doc_at int, length int")
    return found.withColumnsRenamed({"_doc": id_col, "_item": item_col})


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of True and one more than its last."""
    edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return edges[::2], edges[1::2]


def contamination(index: DataFrame, items: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", pieces_per_block: int = 4096) -> DataFrame:
    """One row per document of the index: its id, n_words, spans (array of first place and length, in words, of runs of hit words), items.

    A word inside any occurrence of a window of an item is hit. ``items`` are the different ids of items with a window
    that occurs, sorted as text; an item without an id hits words and is not listed. Items that repeat are one. Tables
    without rows give no rows, or documents without hits.
    """
    ids = index.schema["ids"].dataType.elementType.simpleString()
    pieces = materialise(item_pieces(items, window, item_col, text_col), "pieces")
    n_blocks, blocks = _blocks(pieces, window, pieces_per_block)
    several = n_blocks > 1
    named = "_segment" in index.columns  # a name of each segment, written down with the index
    held = materialise(index.withColumn("_segment", F.monotonically_increasing_id()), "index", SEGMENTS_PER_GROUP) if several and not named else index

    def emit(row: pa.RecordBatch, segment: Segment, block: Block | None) -> Iterator[pa.RecordBatch]:
        cover, pairs = np.zeros(segment.size + 1, np.int64), []
        for item, _, start, length in _occurrences(segment, block) if block else ():
            np.add.at(cover, start, 1)
            np.add.at(cover, start + length, -1)
            pairs.append(np.unique(np.stack([segment.doc_of(start), item], 1)[item >= 0], axis=0))
        n = len(segment.words)
        first, end = _runs(np.cumsum(cover)[:-1] > 0)
        doc = segment.doc_of(first)
        span = pa.StructArray.from_arrays([pa.array((first - segment.starts[doc]).astype(np.int32)), pa.array((end - first).astype(np.int32))], ["at", "length"])
        offsets = lambda of: pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        names = block.names(pairs[:, 1]).cast(pa.string()) if block else pa.array([], pa.string())
        columns = [segment.ids, pa.array(segment.words), pa.ListArray.from_arrays(offsets(doc), span), pa.ListArray.from_arrays(offsets(pairs[:, 0]), names)]
        if several:
            columns += [pa.array(np.repeat(row.column(row.schema.get_field_index("_segment")).to_numpy(), n)), pa.array(np.arange(n, dtype=np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["_doc", "n_words", "spans", "items", "_segment", "_row"][: len(columns)])

    schema = f"_doc {ids}, n_words long, spans array<struct<at:int,length:int>>, items array<string>" + ", _segment long, _row int" * several
    found = _search(held, blocks if n_blocks else [None], emit, schema)
    if several:
        parts = found.groupBy("_segment", "_row").agg(F.first("_doc").alias("_doc"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        found = parts.select("_doc", "n_words", _united(F.array_sort("spans")).alias("spans"), "items")
    return found.select(F.col("_doc").alias(id_col), "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def _united(spans: Column) -> Column:
    """Sorted spans with those that overlap or touch made one."""
    end = lambda s: s["at"] + s["length"]
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("length"))
    kept = F.expr("array()").cast("array<struct<at:int,length:int>>")

    def step(held: Column, s: Column) -> Column:
        last = held["last"]
        grown = F.struct(last["at"].alias("at"), (F.greatest(end(last), end(s)) - last["at"]).alias("length"))
        joins = (last["at"] >= 0) & (s["at"] <= end(last))
        done = F.when(joins | (last["at"] < 0), held["done"]).otherwise(F.concat(held["done"], F.array(last)))
        return F.struct(F.when(joins, grown).otherwise(s).alias("last"), done.alias("done"))

    return F.aggregate(spans, F.struct(start.alias("last"), kept.alias("done")), step, lambda held: F.when(held["last"]["at"] < 0, held["done"]).otherwise(F.concat(held["done"], F.array(held["last"]))))


def digests(found: DataFrame) -> DataFrame:
    """The result of ``contamination`` with counts: document id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    listed = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select(found.columns[0], "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (n > 0).alias("contaminated"))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The counts of ``digests`` for all documents: index them, then look up all windows of the items."""
    index = materialise(build_index(docs, id_col, text_col).withColumn("_segment", F.monotonically_increasing_id()), "index", SEGMENTS_PER_GROUP)
    return digests(contamination(index, items, window, item_col, item_text_col, id_col))


OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
q AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
p AS MATERIALIZED (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
f AS MATERIALIZED (
  SELECT p.r, p.i, q.n, q.item_id
  FROM p JOIN q ON p.w[p.i] = q.g[1] AND list_slice(p.w, p.i, p.i + q.n - 1) = q.g
),
h AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS k FROM f) GROUP BY r),
t AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM f WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
