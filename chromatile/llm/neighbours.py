"""Nearest neighbours by additive quantisation.

A direction is the sum of one codeword from each of several codebooks, all of full dimension. Codebooks
start as k-means of residuals and are refined together on a bounded sample; encoding is a beam search
over the codebooks. Every row is indexed. Queries in blocks meet rows in chunks, where scores are read
from look-up tables by the stored codes and norms. What the codes leave over is stored too, so that
they also bound each score from above: the rows best by codes are scored on the original vectors,
then all others whose bound reaches the k-th best of these. So nothing is missed, whatever the
rows are; rows that the codes describe badly only cost time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int, dtype=np.float32) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(dtype or column.type.value_type.to_pandas_dtype(), copy=False)


def _stored(vectors: DataFrame, vector_col: str) -> Column:
    """The vector with its own components: float stays float, any other number is double."""
    own = vectors.schema[vector_col].dataType.simpleString()
    return F.col(vector_col).cast("array<float>" if own == "array<float>" else "array<double>")


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and the lengths, of vectors x (n, dim) without zero vectors; in double precision."""
    top = np.abs(x).max(axis=1, keepdims=True).astype(float)
    x = x / top  # squares of very large or small components would not fit
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / length, (length * top)[:, 0]


def encode(x: np.ndarray, books: np.ndarray, beam: int = 4) -> np.ndarray:
    """Codes (n, number of codebooks) of vectors x (n, dim) by beam search."""
    n = len(x)
    rest = x[:, None, :].astype(np.float32)
    codes = np.zeros((n, 1, 0), np.uint8)
    rows = np.arange(n)[:, None]
    for book in books:
        width, k = rest.shape[1], len(book)
        cost = (rest * rest).sum(axis=2)[:, :, None] - 2 * (rest.reshape(-1, x.shape[1]) @ book.T).reshape(n, width, k) + (book * book).sum(axis=1)
        cost = cost.reshape(n, width * k)
        keep = min(beam, width * k)
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, 1), axis=1, kind="stable"), 1)
        origin, word = best // k, best % k
        rest = rest[rows, origin] - book[word]
        codes = np.concatenate([codes[rows, origin], word[:, :, None].astype(np.uint8)], axis=2)
    return codes[:, 0]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def fit(sample: np.ndarray, codebooks: int = 32, words: int = 256, rounds: int = 4, sweeps: int = 1, seed: int = 0) -> np.ndarray:
    """Codebooks (codebooks, words, dim) for vectors ``sample`` (n, dim), n at least 1; repeatable."""
    rng = np.random.default_rng(seed)
    rest, k = sample.astype(np.float32), min(words, len(sample))
    books = []
    for _ in range(codebooks):
        book = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(rounds):
            at = (rest @ book.T - (book * book).sum(axis=1) / 2).argmax(axis=1)
            _recentre(book, rest, at)
        at = (rest @ book.T - (book * book).sum(axis=1) / 2).argmax(axis=1)
        rest = rest - book[at]
        books.append(book)
    books = np.stack(books)
    for _ in range(sweeps):  # each codebook in turn, given the codes and the other codebooks
        codes = encode(sample, books)
        rest = sample - decode(codes, books)
        for m in range(codebooks):
            own = rest + books[m][codes[:, m]]
            _recentre(books[m], own, codes[:, m])
            rest = own - books[m][codes[:, m]]
    return books


def _recentre(book: np.ndarray, points: np.ndarray, at: np.ndarray) -> None:
    n = np.bincount(at, minlength=len(book))
    sums = np.zeros_like(book)
    order = np.argsort(at, kind="stable")
    some = np.flatnonzero(n)
    sums[some] = np.add.reduceat(points[order], np.cumsum(n)[some] - n[some], axis=0)
    book[some] = sums[some] / n[some, None]


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 8192, **options) -> np.ndarray | None:
    """Fit the codebooks on the directions of ``sample_rows`` usable rows, chosen by a hash of id and vector; None without any."""
    rows = vectors.filter(usable(F.col(vector_col))).select(_stored(vectors, vector_col).alias("v"), F.xxhash64(id_col, vector_col).alias("h"))
    got = rows.orderBy("h").limit(sample_rows).select("v").collect()
    return fit(_directions(np.array([r["v"] for r in got], float))[0].astype(np.float32), **options) if got else None


def _norms(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> pa.StructArray:
    """NORMS of vectors x (n, dim) with these codes."""
    unit, length = _directions(x)
    decoded = sum(book[codes[:, m]].astype(float) for m, book in enumerate(books))
    size = np.sqrt((decoded * decoded).sum(axis=1))
    size[size == 0] = 1
    decoded /= size[:, None]
    along = np.clip((unit * decoded).sum(axis=1), -1, 1)
    across = np.sqrt(((unit - along[:, None] * decoded) ** 2).sum(axis=1))
    return pa.StructArray.from_arrays([pa.array(length)] + [pa.array(a.astype(np.float32)) for a in (size, along, across)], ["length", "decoded", "along", "across"])


#: Of a row: its length, the length of what its codes decode to, and the parts of its direction along that and across it.
NORMS = "struct<length: double, decoded: float, along: float, across: float>"


def build_index(vectors: DataFrame, books: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = 4) -> DataFrame:
    """Every usable row: _id, _vector (float or double, as it came), _codes (of its direction), _norm (``NORMS``)."""
    dim = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _matrix(part.column(1), dim, float)
                codes = encode(_directions(x)[0].astype(np.float32), books, beam)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), _norms(x, codes, books)], ["_id", "_vector", "_codes", "_norm"])

    rows = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).cast("long"), _stored(vectors, vector_col).alias("_v"))
    return rows.mapInArrow(run, f"_id long, _vector {rows.schema['_v'].dataType.simpleString()}, _codes binary, _norm {NORMS}")


MEASURES = ("inner", "euclidean")


def _chunk(held: pa.Table, books: np.ndarray) -> dict[str, np.ndarray]:
    """The rows of one chunk as arrays; ``slack`` is what the rounding of a score from the tables may add to a cosine."""
    dim = books.shape[2]
    chunk = {name: held["_norm"].combine_chunks().field(name).to_numpy(zero_copy_only=False) for name in ("length", "decoded", "along", "across")}
    chunk["ids"] = held["_id"].to_numpy()
    chunk["vectors"] = _matrix(held["_vector"].combine_chunks(), dim, None)
    codes = chunk["codes"] = np.frombuffer(b"".join(held["_codes"].to_pylist()), np.uint8).reshape(held.num_rows, len(books)).T.astype(np.intp)
    words = sum(np.sqrt((book.astype(float) ** 2).sum(axis=1))[codes[m]] for m, book in enumerate(books))
    chunk["slack"] = ((dim + len(books) + 8) * 2.0**-24 * words / chunk["decoded"]).astype(np.float32)
    return chunk


def _from_codes(units: np.ndarray, sizes: np.ndarray, chunk: dict[str, np.ndarray], books: np.ndarray, euclidean: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores of queries (directions, lengths) with the rows of a chunk as their codes have them, and upper bounds of the true ones.

    With an angle t between query and decoded row, and e between row and decoded row, the cosine of query and row is at most cos(t - e).
    """
    tables = [book @ units.T for book in books]
    sums = np.zeros((len(chunk["ids"]), len(units)), np.float32)
    for at in range(0, len(sums), 4096):  # so that it stays in the cache
        for table, codes in zip(tables, chunk["codes"][:, at : at + 4096], strict=True):
            sums[at : at + 4096] += np.take(table, codes, axis=0, mode="clip")
    cosine = np.ascontiguousarray(sums.T)
    cosine /= chunk["decoded"]
    guess = cosine * chunk["along"]
    cosine += chunk["slack"]
    np.clip(cosine, -1, chunk["along"], out=cosine)  # t is not below e: there the bound is 1
    bound = np.sqrt((1 - cosine) * (1 + cosine))
    bound *= chunk["across"]
    cosine *= chunk["along"]
    bound += cosine
    bound += np.float32(1e-6)
    size, length = sizes[:, None], chunk["length"]
    if not euclidean:
        return guess * length, size * (bound * length)
    rounded = 1e-14 * (size * size + length * length)
    return 2 * size * (guess * length) - length * length, 2 * size * (bound * length) - length * length - size * size + rounded


def _exact(q: np.ndarray, x: np.ndarray, euclidean: bool) -> np.ndarray:
    """Scores of q with the rows of x in double precision: products are summed row by row, alike in every row."""
    terms = np.ascontiguousarray((q - x.astype(float)) ** 2 if euclidean else q * x.astype(float))
    return (-1.0 if euclidean else 1.0) * terms.sum(axis=1)


def search(index: DataFrame, queries: DataFrame, books: np.ndarray, k: int = 20, measure: str = "inner", rerank: int = 400, queries_per_block: int = 16_384, rows_per_chunk: int = 32_768) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``index``.

    Nearest by ``inner`` is the largest inner product; by ``euclidean`` the smallest distance, scored
    as its negative square.

    queries: _id, _vector. A row is no neighbour of queries with its own id. Of rows with equal
    vectors only the k + 1 with the smallest ids can be among the nearest, so the others are not
    scored. In each chunk the ``rerank`` rows (at least k) of the best scores by codes are scored exactly, then all
    rows whose bound by codes reaches the k-th best of them; the chunk offers its best k, equal ones by id. Exact scores
    are in double precision and one order of components, so that equal vectors score alike. Blocks and chunks
    have bounded sizes (of long vectors they hold fewer); all of them meet, so the work is
    queries times rows, and a row is shuffled once for every ``queries_per_block`` queries.
    """
    if measure not in MEASURES:
        raise ValueError(f"measure {measure!r} is none of {MEASURES}")
    euclidean, rerank, dim = measure == "euclidean", max(rerank, k), books.shape[2]
    queries_per_block, rows_per_chunk = (max(1, min(n, (1 << 23) // dim)) for n in (queries_per_block, rows_per_chunk))
    copies = Window.partitionBy("_vector").orderBy("_id")
    rows = materialise(index.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k + 1).drop("_copy"), "index")
    queries = materialise(queries.withColumn("_ask", F.monotonically_increasing_id()), "queries")
    blocks, chunks = max(1, -(-queries.count() // queries_per_block)), max(1, -(-rows.count() // rows_per_chunk))
    deal = lambda n: F.pmod(F.xxhash64("_id", "_vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(deal(blocks).alias("_block"), every(chunks).alias("_chunk"), "_ask", "_id", "_vector")
    right = rows.select(every(blocks).alias("_block"), deal(chunks).alias("_chunk"), "_id", "_vector", "_codes", "_norm")

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if asked.num_rows and held.num_rows:
            chunk = _chunk(held, books)
            ids, vectors = chunk["ids"], chunk["vectors"]
            points = _matrix(asked["_vector"].combine_chunks(), dim, float)
            units, sizes = _directions(points)
            units, names, own_ids = units.astype(np.float32), asked["_ask"].to_numpy(), asked["_id"].to_numpy()
            step, first = max(1, (1 << 20) // len(ids)), min(rerank + 1, len(ids))
            for at in range(0, len(names), step):
                guess, bound = _from_codes(units[at : at + step], sizes[at : at + step], chunk, books, euclidean)
                for row, (q, name, own) in enumerate(zip(points[at : at + step], names[at : at + step], own_ids[at : at + step], strict=True)):
                    best = np.argpartition(guess[row], len(ids) - first)[len(ids) - first :]
                    best = best[ids[best] != own]
                    score = _exact(q, vectors[best], euclidean)
                    least = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
                    bound[row, best] = np.nan  # done
                    more = np.flatnonzero(bound[row] >= least)
                    more = more[ids[more] != own]
                    best, score = np.concatenate([best, more]), np.concatenate([score, _exact(q, vectors[more], euclidean)])
                    top = np.lexsort((ids[best], -score))[:k]
                    out.append((np.full(len(top), name), np.full(len(top), own), ids[best[top]], score[top]))
        return pa.table({c: pa.array(np.concatenate(a)) for c, a in zip(("_ask", "query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    offered = left.groupBy("_block", "_chunk").cogroup(right.groupBy("_block", "_chunk")).applyInArrow(run, "_ask long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("_ask").orderBy(F.col("score").desc(), "vec_id"))
    return offered.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, **options) -> DataFrame:
    """The nearest rows of each row for which ``is_query`` holds; see ``search``.

    Vectors that are null, zero, not finite, or of another length than most rows have take no part;
    neither do rows without an id. Queries of one id are one query each only if their vectors differ.
    Float vectors are held as float, others as double; scores are in double precision.
    An empty table gives an empty result.
    """
    lengths = vectors.filter(usable(F.col(vector_col))).groupBy(F.size(vector_col).alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), is_query.alias("_asks")).filter((F.size("embedding") == lengths[0]["dim"]) & F.col("vec_id").isNotNull())
    books = train(vectors)
    queries = vectors.filter(F.col("_asks") & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("_id"), _stored(vectors, "embedding").alias("_vector")).dropDuplicates()
    return search(build_index(vectors, books), queries, books, k, **options)
