"""Vector search: a query set against all vectors in blocks of queries, or against the inverted lists near each query."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillage.session import kept, scratch

#: Queries multiplied with the vectors at a time: the bound of what a task holds besides its batch.
BLOCK = 4096


#: Products of queries with vectors that a task holds at a time: 32 MB.
PRODUCTS = 4 << 20


class Best:
    """The k best (score, then smaller id) of each of some queries, as arrays; vectors are added in chunks of bounded size."""

    def __init__(self, queries: int, k: int, products: int = PRODUCTS):
        self.k, self.products = k, products
        self.scores, self.ids, self.held = np.full((queries, k), -1.0), np.zeros((queries, k), np.int64), np.zeros(queries, np.int64)

    def add(self, who: np.ndarray, ids: np.ndarray, q: np.ndarray, x: np.ndarray, score: str = "cosine") -> None:
        """who: the numbers of the queries q; ids and x: the vectors. Scores are held at 0 and rounded to nine places."""
        if not len(who):
            return
        step = max(1, self.products // len(who))
        by_id = np.argsort(ids, kind="stable")
        for i in range(0, len(ids), step):
            at = by_id[i : i + step]
            self._add(who, ids[at], q @ x[at].T, score)

    def _add(self, who: np.ndarray, ids: np.ndarray, s: np.ndarray, score: str) -> None:
        if score != "cosine":
            s *= 2
            s -= 1
        np.round(np.maximum(s, 0.0, out=s), 9, out=s)
        # what is below a query's k-th score so far, or below the chunk's own k-th, is out; of those equal to it, and many scores
        # are 0, only the first k can matter: ids ascend
        least = self.scores[who, -1]
        low = np.flatnonzero(self.held[who] < self.k)
        kth = s.shape[1] - self.k
        least[low] = [np.partition(s[r], kth)[kth] if kth > 0 else 0.0 for r in low]
        equal = s == least[:, None]
        equal &= np.cumsum(equal, axis=1, dtype=np.int32) <= self.k
        equal |= s > least[:, None]
        row, at = np.nonzero(equal)
        hit = np.unique(row)
        old = np.arange(self.k)[None, :] < self.held[who[hit]][:, None]
        r0, c0 = np.nonzero(old)
        rows = np.concatenate([hit[r0], row])
        values = np.concatenate([self.scores[who[hit]][r0, c0], s[row, at]])
        names = np.concatenate([self.ids[who[hit]][r0, c0], ids[at]])
        order = np.lexsort((names, -values, rows))
        rows, values, names = rows[order], values[order], names[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = place < self.k
        to = who[rows[top]], place[top]
        self.scores[to], self.ids[to] = values[top], names[top]
        self.held[who[hit]] = np.minimum(np.bincount(rows, minlength=len(who))[hit], self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, score) of all that is held."""
        at = np.nonzero(np.arange(self.k)[None, :] < self.held[:, None])
        return at[0], self.ids[at], self.scores[at]


def top_vectors(
    vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding",
    score: str = "cosine"
) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of each query.

    score `cosine`: max(0, cosine); `l2`: max(0, 1 - squared distance of the unit vectors). Tasks keep
    their own best k before the shuffle, so what is shuffled is queries x k rows for each task.
    """
    ids = [q for q, _ in queries]
    numbers = np.array(ids, np.int64)
    blocks = [np.asarray([v for _, v in queries[i : i + BLOCK]], float) for i in range(0, len(queries), BLOCK)]
    blocks = [b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300) for b in blocks]

    def run(it):
        import pyarrow as pa

        best = Best(len(ids), k)
        for batch in it:
            own = batch.column(0).to_numpy()
            if not len(own):
                continue
            x = _units(_matrix(batch.column(1)))
            for n, b in enumerate(blocks):
                best.add(np.arange(n * BLOCK, n * BLOCK + len(b)), own, b, x, score)
        who, found, scores = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(numbers[who], pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], ["query_id", id_col, "score"])

    found = vectors.select(F.col(id_col).cast("long").alias(id_col), vector_col).where(F.col(vector_col).isNotNull()).mapInArrow(run, f"query_id long, {id_col} long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def top_vectors_of_set(
    vectors: DataFrame, queries: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", score: str = "cosine",
    block: int = BLOCK
) -> DataFrame:
    """top_vectors for a query table (query_id, vector) of any size: one block of queries after the other.

    The driver and the tasks hold one block at a time; each block's result is kept in the shared folder.
    """
    blocks = -(-queries.count() // block)
    if blocks <= 1:
        rows = queries.select("query_id", "vector").toArrow()
        return top_vectors(vectors, list(zip(rows["query_id"].to_pylist(), rows["vector"].to_pylist())), k, id_col, vector_col, score)
    spark, at = vectors.sparkSession, scratch(vectors.sparkSession)
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "vector").toArrow()
        found = top_vectors(vectors, list(zip(part["query_id"].to_pylist(), part["vector"].to_pylist())), k, id_col, vector_col, score)
        found.write.mode("append").parquet(at)
    return spark.read.parquet(at)


@dataclass(frozen=True)
class ListParams:
    """lists: inverted lists, by default the square root of the vectors' number, at most 4096. sample: vectors that the
    centroids are fitted on. rounds: of k-means."""

    lists: int | None = None
    sample: int = 50_000
    rounds: int = 8
    seed: int = 17


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit_lists(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", params: ListParams = ListParams()) -> np.ndarray:
    """Centroids of unit vectors: k-means over a sample, by hash of id, whose rounds are sums that tasks return.

    The sample is a bounded number of vectors, about; the index itself covers every row. The driver holds the centroids.
    """
    p = params
    known = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    n = known.count()
    lists = p.lists or max(1, min(4096, int(n**0.5)))
    share = F.lit(min(1.0, p.sample / max(n, 1)) * (1 << 30))
    draw = F.pmod(F.xxhash64(F.lit(p.seed), "id"), F.lit(1 << 30))
    sample = kept(known.where(draw < share).select("v", draw.alias("draw")))
    first = [r["v"] for r in sample.orderBy("draw").limit(lists).select("v").collect()]
    if not first:
        return np.zeros((0, 0))
    centres = _units(np.array(first, float))

    def sums(centres: np.ndarray):
        def run(it):
            import pyarrow as pa

            total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for b in it:
                if len(b.column(0)):
                    x = _units(_matrix(b.column(0)))
                    at = (x @ centres.T).argmax(1)
                    np.add.at(total, at, x)
                    count += np.bincount(at, minlength=len(centres))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], ["list", "total"])

        return run

    for _ in range(p.rounds):
        part = sample.select("v").mapInArrow(sums(centres), "list long, total array<double>").select("list", F.posexplode("total").alias("at", "x"))
        moved = centres.copy()
        for r in part.groupBy("list", "at").agg(F.sum("x").alias("x")).collect():  # lists times components
            moved[r["list"], r["at"]] = r["x"]
        centres = _units(moved)
    return centres


def write_lists(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", params: ListParams = ListParams()) -> np.ndarray:
    """Writes every vector into the folder of its nearest centroid's list; returns the centroids. Null vectors are left out."""
    centres = fit_lists(vectors, vector_col, id_col, params)

    @F.arrow_udf("int")
    def nearest(column):
        import pyarrow as pa

        return pa.array((_units(_matrix(column)) @ centres.T).argmax(1) if len(column) else np.zeros(0), pa.int32())

    known = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias(vector_col))
    placed = known.withColumn("list", nearest(vector_col) if len(centres) else F.lit(0))
    placed.repartition("list", F.pmod(F.xxhash64(id_col), F.lit(16))).write.partitionBy("list").parquet(path)
    return centres


def _lists(spark: SparkSession, path: str, id_col: str, vector_col: str) -> DataFrame:
    return spark.read.schema(f"{id_col} long, {vector_col} array<double>, list int").parquet(path)


def search_lists(
    spark: SparkSession, path: str, centres: np.ndarray, queries: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", probes: float = 0.3, block: int = BLOCK
) -> DataFrame:
    """(query_id, id, score, rank): the k best by cosine among the vectors of each query's nearest lists.

    queries is (query_id, vector), of any number: one block after the other. Only folders that some query of the block looks
    into are read; a task multiplies a list's rows with the queries that look there and keeps its own best k.
    With probes 1 all lists are read and the result is exact.
    """
    count = max(1, int(np.ceil(probes * len(centres))))
    numbered = queries.select("query_id", "vector")
    blocks = max(1, -(-numbered.count() // block))
    at = scratch(spark)
    for number in range(blocks):
        part = numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).toArrow()
        ids = part["query_id"].to_pylist()
        q = _units(np.array(part["vector"].to_pylist(), float).reshape(len(ids), -1))
        chosen = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :count] if len(ids) and len(centres) else np.zeros((len(ids), 0), int)
        asking = {int(c): np.flatnonzero((chosen == c).any(1)) for c in np.unique(chosen)}

        def run(it, ids=ids, q=q, asking=asking):
            import pyarrow as pa

            best = Best(len(ids), k)
            for b in it:
                own, lists = b.column(0).to_numpy(), b.column(2).to_numpy()
                if not len(own):
                    continue
                x = _units(_matrix(b.column(1)))
                for c in np.unique(lists).tolist():
                    rows, who = np.flatnonzero(lists == c), asking[c]
                    best.add(who, own[rows], q[who], x[rows])
            who, found, scores = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[who], pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], ["query_id", id_col, "score"])

        read = _lists(spark, path, id_col, vector_col).where(F.col("list").isin(sorted(asking))).select(id_col, vector_col, "list")
        read.mapInArrow(run, f"query_id long, {id_col} long, score double").write.mode("append").parquet(at)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return spark.read.parquet(at).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def probes_for(
    spark: SparkSession, path: str, centres: np.ndarray, recall: float = 0.95, k: int = 8, sample: int = 200, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 23
) -> float:
    """The share of lists to look into so that searches find `recall` of the true best k.

    About `sample` vectors of the index, by hash, are searched in full; the place of each true neighbour's list among the lists nearest to
    its query says how far a search must look. Vectors without structure need many lists, clustered ones few.
    """
    rows = _lists(spark, path, id_col, vector_col)
    share = min(1.0, sample / max(rows.count(), 1)) * (1 << 30)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) < F.lit(share)).select(id_col, vector_col).orderBy(id_col).limit(2 * sample).collect()
    if not drawn or not len(centres):
        return 1.0
    asked = {r[id_col]: r[vector_col] for r in drawn}
    exact = top_vectors(rows, list(asked.items()), k, id_col, vector_col)
    found = exact.join(rows.select(id_col, "list"), id_col).select("query_id", "list").collect()  # sample times k rows
    ids = list(asked)
    near = np.argsort(-(_units(np.array([asked[i] for i in ids], float)) @ centres.T), axis=1, kind="stable")
    place = {i: {int(c): n for n, c in enumerate(row)} for i, row in zip(ids, near)}
    deep = np.sort([place[r["query_id"]][r["list"]] for r in found])
    return float(deep[min(len(deep) - 1, int(np.ceil(recall * len(deep))) - 1)] + 1) / len(centres)
