"""Product quantisation of integer vectors, with entries ruled out by segment-mean lower bounds.

Vectors are scaled to integers and cut into equal parts; every part position has a codebook of a few entries that is
improved by rounds of assignment and averaging. To find a part's nearest entry, part and entries are first seen as
block means and residual norms. For blocks of m components with sums s and t and squared norms A and B

    m * distance >= (s - t)^2 + (sqrt(m A - s^2) - sqrt(m B - t^2))^2

(Cauchy-Schwarz on the parts orthogonal to the mean). One block, the whole part, comes first, then halves, then quarters;
entries whose bound, less a margin for rounding, exceeds an exact distance already known are out. What is left
gets its distance in integers, so the result is that of comparing everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm._common import discard, fresh, look_up, release, stored


@dataclass(frozen=True)
class CodeParams:
    """scale: integers are floor(scale * component). parts: equal parts of a vector. entries: of a codebook. rounds: of
    assignment and averaging."""

    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6


def limit(dim: int) -> int:
    """Integer components are held within this, so that distances and errors of vectors of that size fit in 64 bits."""
    return 1 << (62 - max(1, dim - 1).bit_length()) // 2 - 1


def to_integers(values: np.ndarray, scale: int) -> np.ndarray:
    most = limit(values.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -most, most).astype(np.int64)


def _views(x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(m, block sums, norms of the residuals times sqrt(m)) of rows, from one block down to blocks of two."""
    d, out, blocks = x.shape[1], [], 1
    while d and d % blocks == 0 and d // blocks >= 2 and blocks <= 4:
        m = d // blocks
        cut = x.reshape(len(x), blocks, m).astype(np.float64)
        s = cut.sum(2)
        out.append((m, s, np.sqrt(np.maximum(0.0, m * (cut * cut).sum(2) - s * s))))
        blocks *= 2
    return out


#: Relative and absolute margin for what doubles round in a bound: 2^-53 for each of a few dozen operations, and the
#: square root of a difference of large numbers, whose own rounding is at most about 2^-25 of the block's norm.
_MARGIN = 1e-6


def _least(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first least value, that value) of each of n rows; rows ascend, and each has a value."""
    if not n:
        return np.zeros(0, np.int64), values
    begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    least = np.minimum.reduceat(values, begins)
    hit = np.flatnonzero(values == least[rows])
    return hit[np.concatenate([[True], rows[hit][1:] != rows[hit][:-1]])], least


class NearestEntry:
    """Exact nearest entries of a codebook; ties go to the lower index. `compared` counts exact distances."""

    def __init__(self, book: np.ndarray):
        self.book, self.views, self.compared = book, _views(book), 0
        self.norms = np.sqrt((book.astype(np.float64) ** 2).sum(1))

    def distances(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.compared += len(at)
        d = x - self.book[at]
        return np.einsum("ij,ij->i", d, d)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) for each row."""
        n = len(x)
        rows, entries = np.divmod(np.arange(n * len(self.book)), max(1, len(self.book)))
        own, best = _views(x), None
        slack = _MARGIN * (np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None] + self.norms) ** 2 + 1e-3
        for (m, s, r), (_, t, q) in zip(own, self.views):
            if best is None:  # all entries at once
                bound = ((s - t.T) ** 2 + (r - q.T) ** 2) / m - slack
                likely = bound.argmin(1)
                best = self.distances(x, likely).astype(np.float64)
                rows, entries = np.nonzero(bound <= best[:, None])
            else:
                bound = (((s[rows] - t[entries]) ** 2 + (r[rows] - q[entries]) ** 2).sum(1)) / m - slack[rows, entries]
                likely = entries[_least(rows, bound, n)[0]]
                best = np.minimum(best, self.distances(x, likely))
                keep = bound <= best[rows]
                rows, entries = rows[keep], entries[keep]
        exact = self.distances(x[rows], entries)
        first, least = _least(rows, exact, n)
        return entries[first], least


@dataclass(frozen=True)
class Codebooks:
    """entries[part]: an array of integer vectors; a vector has dim components, zeros after its own."""

    dim: int
    entries: list[np.ndarray]
    scale: int

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[NearestEntry]]:
        """(codes, squared distances) by row and part, and the searches."""
        size = self.dim // len(self.entries)
        codes, errors, searches = [], [], [NearestEntry(e) for e in self.entries]
        for p, search in enumerate(searches):
            c, e = search(np.ascontiguousarray(x[:, p * size : (p + 1) * size]))
            codes.append(c)
            errors.append(e)
        return np.stack(codes, 1), np.stack(errors, 1), searches

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for, in the scale of the originals."""
        return np.concatenate([e[codes[:, p]] for p, e in enumerate(self.entries)], axis=1) / self.scale

    def digest(self) -> str:
        from hashlib import sha256

        return sha256(",".join(str(v) for e in self.entries for v in e.reshape(-1).tolist()).encode()).hexdigest()


def kept_vectors(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and holds only finite numbers."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of an Arrow list column, short ones filled up with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), flat.dtype if len(flat) else np.float64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


#: Rows that a task looks at together.
_ROWS = 2048


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", params: CodeParams = CodeParams()) -> Codebooks:
    """Codebooks from all kept vectors: the first entries are those with the smallest ids, then rounds of averaging.

    A round is one pass in which every task sums its parts by entry, in integers; the driver gets one row for each part, entry
    and component. Null ids come last, equal ids are ordered by their vectors. With fewer vectors than entries the
    codebooks are smaller; without vectors they are empty.
    """
    p = params
    kept = kept_vectors(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v")
    longest = kept.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    dim = -(-longest // p.parts) * p.parts
    size = dim // p.parts
    first = [r["v"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(p.entries).select("v").collect()]
    start = np.zeros((len(first), dim), np.float64)
    for i, v in enumerate(first):
        start[i, : len(v)] = v
    # components as the column has them, so that floor sees the same numbers everywhere
    books = Codebooks(dim, [e for e in to_integers(start, p.scale).reshape(len(first), p.parts, size).transpose(1, 0, 2)], p.scale)

    def sums(books: Codebooks):
        def run(it):
            import pyarrow as pa

            total = np.zeros((p.parts, len(first), size), np.int64)
            count = np.zeros((p.parts, len(first)), np.int64)
            for b in it:
                column = b.column(0)
                for i in range(0, len(column), _ROWS):
                    x = to_integers(_matrix(column.slice(i, _ROWS), dim), p.scale)
                    codes, _, _ = books.encode(x)
                    for k in range(p.parts):
                        np.add.at(total[k], codes[:, k], x[:, k * size : (k + 1) * size])
                        count[k] += np.bincount(codes[:, k], minlength=len(first))
            part, entry, at = np.indices(total.shape).reshape(3, -1)
            used = count[part, entry] > 0
            columns = [part, entry, at, total.reshape(-1), count[part, entry]]
            yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in columns], ["part", "entry", "at", "total", "n"])

        return run

    for _ in range(p.rounds if len(first) and size else 0):
        done = kept.select("v").mapInArrow(sums(books), "part long, entry long, at long, total long, n long")
        entries = [e.copy() for e in books.entries]
        for r in done.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            entries[r["part"]][r["entry"], r["at"]] = r["total"] // r["n"]
        books = Codebooks(dim, entries, p.scale)
    return books


def encode_vectors(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", out: str = "codes") -> DataFrame:
    """Kept vectors with a struct `out`: code (two hex digits a part), error (squared distances of integers, summed).

    Other columns stay, whatever they are called. Rows whose vector is null or holds null or non-finite components go.
    Shorter vectors are filled up with zeros; longer ones than the codebooks' are an error.
    """

    @F.arrow_udf("struct<code: string, error: bigint>")
    def run(column):
        import pyarrow as pa

        release()
        codes, errors = [], []
        for i in range(0, len(column), _ROWS):
            x = to_integers(_matrix(column.slice(i, _ROWS), books.dim), books.scale)
            c, e, _ = books.encode(x)
            digits = c.astype(np.uint8).tobytes().hex()
            codes += [digits[j : j + 2 * c.shape[1]] for j in range(0, len(digits), 2 * c.shape[1])]
            errors.append(e.sum(1))
        flat = np.concatenate(errors) if errors else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(flat, pa.int64())], ["code", "error"])

    return kept_vectors(vectors, vector_col).withColumn(out, run(F.col(vector_col)))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", params: CodeParams = CodeParams()) -> tuple[DataFrame, Codebooks]:
    """((id, group, code, error, group_error), codebooks): error sums over rows of one group, null groups together.

    Repeated rows stay. A group may hold any share of the rows: sums are taken before the shuffle and brought back by a
    join that spreads large groups. Empty input gives no rows.
    """
    books = fit_codebooks(vectors, id_col, vector_col, params)
    slim = vectors.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), F.col(vector_col).alias("v"))
    coded = encode_vectors(slim, books, "v", "c").select("id", "group", "c.code", "c.error", F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("")).alias("key"))
    coded = stored(coded, "vector-codes")
    sums = stored(coded.groupBy("key").agg(F.sum("error").alias("group_error"), F.count("*").alias("n")), "group-errors")
    return look_up(coded, sums, "key", "n", "id").drop("key"), books
