"""A stored lexical index: positional postings in blocks, searched by terms, phrases and upper bounds.

Postings lie in folders by segment and by a hash of the term, ordered by term, a row for each term and chunk of documents, so a
search reads the folders of its terms and, inside them, the row groups that hold them. A row also has the largest
count and the smallest length in it, which bounds what any of its documents can score. A chunk's row of the empty term lists its
documents, with and without words, and their lengths. An update is a new segment;
ids that were removed or replaced are listed with the last segment that they are gone from.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.text import fold, tokens
from tillage.functions.words import split
from tillage.operators.lexical import best, idf, saturation
from tillage.session import kept


@dataclass(frozen=True)
class IndexParams:
    """parts: folders that terms are dealt to by hash. files: of a folder and segment. chunk: documents that share their
    blocks, at most. A large corpus takes more folders and files."""

    parts: int = 16
    files: int = 4
    chunk: int = 1024


def _part(term, parts: int):
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


#: Bytes of text that share their blocks, at most, unless one text is longer.
CHUNK_BYTES = 8 << 20
#: The term of the row that lists all documents of a chunk; no word is empty.
ALL = ""


def _chunks(texts, most: int):
    """(from, to): rows of a batch that share their blocks."""
    import pyarrow.compute as pc

    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, "right"))
        to = min(max(to, at + 1), at + most)
        yield at, to
        at = to


def _blocks(chunk: int):
    """Documents (id, folded text) of a task as blocks: for each chunk of them and each term there, which of the chunk's words it is.

    A chunk's words are numbered through all its documents; its row of the empty term tells them apart."""

    def run(it):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        names = ["chunk", "term", "words", "ids", "dls", "n", "max_tf", "min_dl"]
        for b in it:
            for at, to in _chunks(b.column(1), chunk):
                ids, texts = b.column(0).slice(at, to - at), b.column(1).slice(at, to - at)
                words, dl = split(texts)
                coded = words.dictionary_encode()
                term = coded.indices.to_numpy()
                # words ascend already, so ordering terms alone orders all; few terms sort faster
                word = np.argsort(term.astype(np.uint16) if len(coded.dictionary) <= 1 << 16 else term, kind="stable")
                doc, term = np.repeat(np.arange(len(dl)), dl)[word], term[word]
                # where a document of a term begins, and where a term does
                held = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])[: len(term)])
                first = np.flatnonzero(np.concatenate([[True], term[held][1:] != term[held][:-1]])[: len(held)])
                most = np.maximum.reduceat(np.diff(held, append=len(term)), first) if len(first) else first
                least = np.minimum.reduceat(dl[doc[held]], first) if len(first) else first
                lists = lambda begin, values: pa.ListArray.from_arrays(pa.array(begin, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(first), number)), coded.dictionary.take(pa.array(term[held[first]])).cast(pa.string()),
                    lists(np.append(held[first], len(term)), pa.array(word, pa.int32())), pa.nulls(len(first), pa.list_(ids.type)), pa.nulls(len(first), pa.list_(pa.int32())),
                    pa.array(np.diff(first, append=len(held)), pa.int64()), pa.array(most, pa.int32()), pa.array(least, pa.int32())
                ], names)
                whole, zero = [0, len(ids)], pa.array([0], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([ALL]), pa.nulls(1, pa.list_(pa.int32())), lists(whole, ids), lists(whole, pa.array(dl, pa.int32())), pa.array([len(ids)]), zero, zero
                ], names)
                number += 1

    return run


def _owners(it):
    """Rows (words, ids, dls, seg, term, ...) of blocks with their chunk's documents as rows (id, dl, places, seg, term, ...) of those that hold the term."""
    import pyarrow as pa

    for b in it:
        for i in range(b.num_rows):
            words, ids, dls = (b.column(c)[i].values for c in range(3))
            word, dl = words.to_numpy(), dls.to_numpy().astype(np.int64)
            ends = np.cumsum(dl)
            doc = np.searchsorted(ends, word, "right")
            held = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)])
            own = doc[held]
            places = pa.ListArray.from_arrays(pa.array(np.append(held, len(doc)), pa.int32()), pa.array(word - (ends - dl)[doc], pa.int32()))
            more = [b.column(c).take(pa.array(np.full(len(own), i))) for c in range(3, b.num_columns)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), pa.array(dl[own], pa.int32()), places, *more], ["id", "dl", "places", *b.schema.names[3:]])


def _schema(kind: str) -> str:
    return f"chunk long, term string, words array<int>, ids array<{kind}>, dls array<int>, n long, max_tf int, min_dl int"


def _write_segment(docs: DataFrame, path: str, number: int, id_col: str, text_col: str, p: IndexParams) -> None:
    folded = docs.select(F.col(id_col).alias("id"), fold(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    # chunks are made where the documents are; only their blocks are dealt to the terms' folders
    rows = folded.mapInArrow(_blocks(p.chunk), _schema(kind)).withColumn("part", _part(F.col("term"), p.parts))
    dealt = rows.repartition("part", F.pmod(F.xxhash64("chunk"), F.lit(p.files)))
    dealt.sortWithinPartitions("part", "term", "chunk").write.partitionBy("part").parquet(f"{path}/postings/seg={number}")


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", params: IndexParams = IndexParams()) -> None:
    """Writes docs as segment 0 of a new index. Null texts are documents without words; ids are taken as unique."""
    spark = docs.sparkSession
    spark.createDataFrame([(params.parts, params.files, params.chunk)], "parts int, files int, chunk int").coalesce(1).write.parquet(f"{path}/meta")
    kind = docs.schema[id_col].dataType
    spark.range(1).select(F.lit(None).cast(kind).alias("id"), F.lit(-1).alias("upto")).write.parquet(f"{path}/gone/seg=0")  # no id is gone yet
    _write_segment(docs, path, 0, id_col, text_col, params)


def update_index(spark: SparkSession, path: str, fresh: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Adds a segment with the rows of fresh, which replace what the index held for their ids, and takes the ids of removed out of
    the earlier segments. Work grows with what changes, not with the index."""
    meta = spark.read.parquet(f"{path}/meta").first()
    last = spark.read.parquet(f"{path}/gone").agg(F.max("seg")).first()[0]
    ids = fresh.select(F.col(id_col).alias("id")).union(removed.select(F.col(id_col))).distinct()
    _write_segment(fresh, path, last + 1, id_col, text_col, IndexParams(meta["parts"], meta["files"], meta["chunk"]))
    ids.withColumn("upto", F.lit(last)).write.parquet(f"{path}/gone/seg={last + 1}")


class Index:
    """An index as it is now."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.parts = spark.read.parquet(f"{path}/meta").first()["parts"]
        kind = spark.read.parquet(f"{path}/gone").schema["id"].dataType.simpleString()
        # a segment without words has no files to take the schema from
        self.postings = spark.read.schema(f"{_schema(kind)}, seg int, part int").parquet(f"{path}/postings")
        # what an id is gone from counts up to its latest removal
        gone = spark.read.parquet(f"{path}/gone").where("upto >= 0")
        self.gone = None if gone.isEmpty() else gone.groupBy(F.col("id").alias("_id")).agg(F.max("upto").alias("_upto"))
        # the documents of a chunk, a row each
        self.chunks = self.blocks([ALL]).select("seg", "chunk", "ids", "dls")
        whole = self.alive(self.chunks.select("seg", F.explode(F.arrays_zip("ids", "dls")).alias("d")).select("seg", F.col("d.ids").alias("id"), F.col("d.dls").alias("dl")))
        whole = whole.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        self.n, self.average = whole["n"], whole["avgdl"] or 0.0

    def alive(self, rows: DataFrame) -> DataFrame:
        """rows (id, seg, ...) without those that were removed later."""
        if self.gone is None:
            return rows
        return rows.join(self.gone, (F.col("id") == F.col("_id")) & (F.col("seg") <= F.col("_upto")), "left_anti")

    def blocks(self, terms: list[str]) -> DataFrame:
        """The rows of some terms, from their folders alone."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string").select(_part(F.col("term"), self.parts).alias("part"))
        parts = sorted({r["part"] for r in asked.collect()})  # the caller's few terms
        return self.postings.where(F.col("part").isin(parts) & F.col("term").isin(list(terms)))

    def documents(self, blocks: DataFrame, *more: str) -> DataFrame:
        """Blocks as rows (id, seg, term, dl, places) of the documents that are there."""
        wanted = blocks.select("seg", "chunk", "words", "term", *more).join(self.chunks, ["seg", "chunk"]).select("words", "ids", "dls", "seg", "term", *more)
        types = {f.name: f.dataType.simpleString() for f in wanted.schema}
        rest = "".join(f", {c} {types[c]}" for c in ("seg", "term", *more))
        return self.alive(wanted.mapInArrow(_owners, f"id {types['ids'].removeprefix('array<').removesuffix('>')}, dl int, places array<int>{rest}"))

    def idfs(self, terms: list[str]) -> dict[str, float]:
        blocks = self.blocks(terms)
        counted = blocks.groupBy("term").agg(F.sum("n").alias("df")) if self.gone is None else self.documents(blocks).groupBy("term").agg(F.count("*").alias("df"))
        df = {r["term"]: r["df"] for r in counted.collect()}  # a row a term
        return {t: idf(self.n, df.get(t, 0)) for t in terms}


def search_index(
    spark: SparkSession, path: str, queries: list[tuple[int, str]], k: int = 100, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id", first: int = 4
) -> DataFrame:
    """(query_id, id, score, rank): the rows of `lexical.bm25` from a stored index.

    Blocks are bounded first, without their documents. The few chunks of a query with the highest bounds are scored, and the
    score that the k-th document has there is a threshold: a chunk whose bound is below it cannot hold one of the best k
    and is not read. Among scores equal to the k-th the smallest ids count, so bounds equal to the threshold pass.
    """
    index = Index(spark, path)
    words = spark.createDataFrame(queries, "query_id long, query string").select("query_id", F.explode(tokens(F.col("query"))).alias("term"))
    times = words.groupBy("query_id", "term").count().collect()  # the caller's few queries
    terms = sorted({r["term"] for r in times})
    worth = index.idfs(terms)
    weights = F.broadcast(spark.createDataFrame([(r["query_id"], r["term"], r["count"] * worth[r["term"]]) for r in times], "query_id long, term string, weight double"))
    blocks = index.blocks(terms)
    most = F.col("weight") * saturation(F.col("max_tf"), F.col("min_dl"), index.average, k1, b)
    bounds = kept(blocks.select("seg", "chunk", "term", "max_tf", "min_dl").join(weights, "term").groupBy("query_id", "seg", "chunk").agg((F.sum(most) + 1e-8).alias("score")))

    def scored(chunks: DataFrame) -> DataFrame:
        wanted = blocks.join(weights, "term").join(chunks.select("query_id", "seg", "chunk"), ["query_id", "seg", "chunk"])
        each = index.documents(wanted, "query_id", "weight")
        part = F.col("weight") * saturation(F.size("places"), F.col("dl"), index.average, k1, b)
        return best(each.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score")), "id", k)

    likely = best(bounds.withColumn("at", F.struct("seg", "chunk")), "at", first)
    floor = scored(likely).where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("floor"))
    # one row a query
    left = bounds.join(F.broadcast(floor), F.col("query_id") == F.col("_q"), "left").where(F.col("score") >= F.coalesce("floor", F.lit(0.0)))
    return scored(left).select("query_id", F.col("id").alias(id_col), "score", "rank")


@dataclass(frozen=True)
class TextQuery:
    """words add to the score; must: words that a document has to hold, and that add, too; without: words that it must not
    hold; phrases: words that have to stand in a row. With neither must nor phrases one of the words is enough."""

    query_id: int
    words: str = ""
    must: str = ""
    without: str = ""
    phrases: list[str] = field(default_factory=list)


def search_phrases(spark: SparkSession, path: str, queries: list[TextQuery], k: int = 100, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id") -> DataFrame:
    """(query_id, id, score, rank) for queries with required and excluded words and phrases.

    A phrase scores like a word that occurs where the whole phrase does and weighs what its words weigh together.
    Positions are met by their differences: a start that all words of a phrase agree on is an occurrence.
    """
    index = Index(spark, path)
    sides = [(q.query_id, kind, i, text) for q in queries for kind, texts in (("words", [q.words]), ("must", [q.must]), ("without", [q.without]), ("phrase", q.phrases)) for i, text in enumerate(texts)]
    split = spark.createDataFrame(sides, "query_id long, kind string, number int, text string").select("query_id", "kind", "number", F.posexplode(tokens(F.col("text"))).alias("at", "term"))
    split = split.collect()  # the caller's few queries
    terms = sorted({r["term"] for r in split})
    worth = index.idfs(terms)
    rows = [(r["query_id"], r["kind"], r["number"], r["at"], r["term"], worth[r["term"]]) for r in split]
    asked = F.broadcast(spark.createDataFrame(rows, "query_id long, kind string, number int, at int, term string, weight double"))
    each = kept(index.documents(index.blocks(terms)).join(asked, "term"))
    single = each.where("kind <> 'phrase'").groupBy("query_id", "id", "kind", "term").agg(F.sum("weight").alias("weight"), F.any_value(F.size("places")).alias("tf"), F.any_value("dl").alias("dl"))
    starts = each.where("kind = 'phrase'").select("query_id", "id", "number", "dl", "weight", "at", F.explode("places").alias("place"))
    agreed = starts.groupBy("query_id", "id", "number", "dl", (F.col("place") - F.col("at")).alias("start")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    sizes: dict[tuple[int, int], int] = {}
    needs: dict[int, tuple[int, int]] = {}
    for r in split:
        if r["kind"] == "phrase":
            sizes[r["query_id"], r["number"]] = sizes.get((r["query_id"], r["number"]), 0) + 1
    for q in queries:
        needs[q.query_id] = len({r["term"] for r in split if r["query_id"] == q.query_id and r["kind"] == "must"}), sum(1 for i, _ in sizes if i == q.query_id)
    long = F.broadcast(spark.createDataFrame([(q, n, s) for (q, n), s in sizes.items()], "query_id long, number int, size long"))
    found = agreed.join(long, ["query_id", "number"]).where("n = size").groupBy("query_id", "id", "number").agg(F.any_value("weight").alias("weight"), F.count("*").alias("tf"), F.any_value("dl").alias("dl"))
    both = single.select("query_id", "id", "kind", "weight", "tf", "dl").unionByName(found.select("query_id", "id", F.lit("phrase").alias("kind"), "weight", "tf", "dl"))
    part = F.col("weight") * saturation(F.col("tf"), F.col("dl"), index.average, k1, b)
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(kind)
    summed = both.groupBy("query_id", "id").agg(F.round(F.sum(F.when(F.col("kind") != "without", part)), 9).alias("score"), count("must"), count("phrase"), count("without"))
    wanted = F.broadcast(spark.createDataFrame([(q, m, p) for q, (m, p) in needs.items()], "query_id long, musts long, whole long"))
    ok = summed.join(wanted, "query_id").where("must = musts and phrase = whole and without = 0").select("query_id", "id", "score")
    return best(ok, "id", k).select("query_id", F.col("id").alias(id_col), "score", "rank")
