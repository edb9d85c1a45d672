"""Training-data pipeline over `documents`: language, quality, near duplicates, benchmarks, mixing.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all rows its
predecessor kept and returns a DataFrame, which is written and reread before the next one. All but the
last return the columns of documents; the last adds `rate` and `copies`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm._common import discard, fresh, stored, table
from tillage.llm.decontaminate import decontaminate
from tillage.llm.language_id import fit_field, held_out, identify
from tillage.llm.mixing import mix
from tillage.llm.quality_rules import judge_quality
from tillage.llm.simhash import SimilarParams, deduplicate

#: Share of the posterior mass a document's language must have.
MIN_LANGUAGE_SHARE = 0.4
#: Domains of the labelled table, and their target shares of all tokens.
TARGETS = {"clean": 0.99, "toxic": 0.01}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (`und`), null and empty ones among them, and texts in which no language has
    a clear share. Learns from rows with id, text and lang; with none of them every text is `und` and goes.
    Repeated rows are judged alike; columns stay, whatever they are called."""
    field = fit_field(docs.where(~held_out(F.col("doc_id"))))
    out = fresh(docs, "language")
    found = identify(docs, field, out=out)
    return found.where((F.col(f"{out}.lang") != "und") & (F.col(f"{out}.score") >= MIN_LANGUAGE_SHARE)).drop(out)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rule, null and empty texts among them, or that the voting rules find
    bad. Repeated rows are judged alike; columns stay, whatever they are called."""
    out = fresh(docs, "quality")
    return judge_quality(docs, out=out).where(f"{out}.kept").drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of texts that share 0.8 of their five-word shingles.

    Texts without words, null ones among them, are one text; rows with a null id stay; of rows that repeat
    the kept id the one with the smallest text stays.
    """
    return deduplicate(docs, params=SimilarParams())


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects contaminated documents; texts without words are clean, and an empty benchmark contaminates nothing."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates that bring the domains to their target shares; rows whose copies come to none go.

    Null and empty texts have no tokens and the rate of an average text. Without labelled documents all rates
    are 1 and every row stays. The columns `rate` and `copies` are added under names that docs does not have.
    """
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("domain"))
    out, rate, copies = fresh(docs, "mix"), fresh(docs, "rate"), fresh(docs, "copies")
    found, _ = mix(docs, labelled, TARGETS, out=out)
    kept = found.where(F.col(f"{out}.copies") > 0)
    return kept.select(*docs.columns, F.col(f"{out}.rate").alias(rate), F.col(f"{out}.copies").alias(copies))


STAGES = [
    ("language ID", language),
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmarks),
    ("mixing sources to target weights", mixture),
]

#: Forward-backward, expectation-maximisation, fingerprints and projected gradients are beyond SQL. tests/llm compares what each
#: stage keeps with its operator's verdicts, and the operators with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage has read is deleted once its own result is stored."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i}")
            discard(before)
    return docs
