"""Sinks: fragments by document bucket, the lexical index as tables, vectors, late rows of a stream counted."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tillage.functions.text import safe_name, tokens
from tillage.operators.lexical import postings, replaced
from tillage.session import kept


def write_fragments(fragments: DataFrame, path: str, buckets: int = 64, id_col: str = "doc_id") -> None:
    """Parquet in folders by a hash of the document, so that one document's fragments can be replaced by folder."""
    fragments.withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")).write.partitionBy("bucket").parquet(path)


def numbered(fragments: DataFrame, doc: str, order: list[str], text_col: str = "text") -> DataFrame:
    """fragments with what the store adds: a random id, the number inside the document, the length in characters."""
    seq = F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1
    return fragments.withColumns({
        "fragment_id": F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), "seq": seq,
        "char_count": F.length(F.coalesce(F.col(text_col), F.lit("")))
    })


def stored_name(seconds: Column, name: Column) -> Column:
    """The name under which an uploaded file is kept: a time and the safe form of its own."""
    return F.concat(seconds.cast("string"), F.lit("__"), safe_name(name))


def upsert_vectors(spark: SparkSession, path: str, fresh: DataFrame, target: str, id_col: str = "vec_id") -> None:
    """Writes the collection at path with fresh rows in place of those with their ids to a new place."""
    replaced(spark.read.parquet(path), fresh, id_col).write.parquet(target)


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Postings ordered by term (row groups prune by it) and the documents' lengths."""
    # stored first: ranges are found in a pass of their own, which would count the words of all texts again
    kept(postings(docs, id_col, text_col)).repartitionByRange("term").sortWithinPartitions("term", id_col).write.parquet(f"{path}/postings")
    docs.select(id_col, F.size(tokens(F.col(text_col))).alias("dl")).write.parquet(f"{path}/lengths")


class LateRows(StreamingQueryListener):
    """Counts rows that came behind the watermark, over all stateful operators of all queries."""

    def __init__(self) -> None:
        self.dropped = self.started = self.ended = 0

    def onQueryStarted(self, event) -> None:
        self.started += 1

    def onQueryProgress(self, event) -> None:
        self.dropped += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        self.ended += 1

    def settle(self, seconds: float = 20.0) -> None:
        """Waits until the news of every query that has started is in, which comes a little after its end."""
        until = time.time() + seconds
        while self.ended < self.started and time.time() < until:
            time.sleep(0.05)
