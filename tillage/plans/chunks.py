"""Queries of the greedy packers: sentences, lines and paragraphs into chunks, blocks and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillage.functions import chunking as C
from tillage.functions import text as T
from tillage.plans import sqlparts as S
from tillage.plans.catalogue import REGISTRY
from tillage.plans.texts import SENTENCES
from tillage.session import table

add = REGISTRY.add
TEXT = "coalesce(text, '')"
_WORDS = r"len(list_filter(string_split_regex(ss[i], '\s+'), lambda w: w <> ''))"
_LINES = f"list_filter(string_split({TEXT}, chr(10)), lambda s: trim(s) <> '')"
_PARAGRAPHS = rf"list_filter(string_split_regex({TEXT}, '\n\s*\n+'), lambda s: trim(s) <> '')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _listed(df, chunks):
    """(doc_id, n, n_chars, digest) of the chunks."""
    out = df.select("doc_id", F.posexplode(chunks).alias("n", "chunk"))
    return out.select("doc_id", "n", F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("digest"))


_SHOW = "SELECT doc_id, n, CAST(length(chunk) AS BIGINT) AS n_chars, md5(chunk) AS digest FROM"


@add("char_chunks", f"WITH RECURSIVE {S.packed(SENTENCES, 'length(ss[i])', 900, 1, repr(' '))} {_SHOW} k")
def char_chunks(spark, sf_dir):
    return _listed(_docs(spark, sf_dir), C.pack(T.sentences(F.col("text")), 900))


_BY_WORDS = S.packed(SENTENCES, _WORDS, 110, 0, repr(" "))


@add(
    "chunk_overlap",
    f"WITH RECURSIVE {_BY_WORDS}, o AS (SELECT doc_id, n, CASE WHEN n = 0 THEN chunk ELSE right(lag(chunk) OVER (PARTITION BY doc_id ORDER BY n), 80) || ' ' || chunk END AS chunk FROM k) {_SHOW} o"
)
def chunk_overlap(spark, sf_dir):
    """The last eighty characters of the chunk before."""
    base = _docs(spark, sf_dir).select("doc_id", C.pack(T.sentences(F.col("text")), 110, unit="words").alias("chunks"))
    return _listed(base, C.with_previous_tail(F.col("chunks"), 80))


@add(
    "chunk_token_overlap",
    rf"""WITH RECURSIVE {_BY_WORDS}, w AS (SELECT doc_id, n, chunk, lag(string_split_regex(chunk, '\s+')) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM k),
o AS (SELECT doc_id, n, CASE WHEN b IS NULL THEN chunk ELSE array_to_string(b[greatest(1, len(b) - 19) : len(b)], ' ') || ' ' || chunk END AS chunk FROM w) {_SHOW} o""",
)
def chunk_token_overlap(spark, sf_dir):
    """The last twenty words of the chunk before."""
    base = _docs(spark, sf_dir).select("doc_id", C.pack(T.sentences(F.col("text")), 110, unit="words").alias("chunks"))
    return _listed(base, C.with_previous_words(F.col("chunks"), 20))


@add("word_pages", f"WITH RECURSIVE {S.packed(_PARAGRAPHS, _WORDS, 500, 0, 'chr(10) || chr(10)')} {_SHOW} k")
def word_pages(spark, sf_dir):
    """Pages of up to 500 words that keep paragraphs whole."""
    return _listed(_docs(spark, sf_dir), C.pack(T.paragraphs(F.col("text")), 500, "\n\n", unit="words"))


@add("line_blocks", f"WITH RECURSIVE {S.packed(_LINES, 'length(ss[i])', 1200, 1, 'chr(10)')} {_SHOW} k")
def line_blocks(spark, sf_dir):
    """Whole lines packed into blocks of up to 1,200 characters."""
    return _listed(_docs(spark, sf_dir), C.pack(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1200, "\n"))
