"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm._common import table
from tillage.llm.chat_format import canonical_turns, format_turns, read_loss, read_turns, records_of_rows
from tillage.llm.decontaminate import contamination
from tillage.llm.gru_lm import score_documents
from tillage.llm.html_extract import extract
from tillage.llm.language_id import fit_field, held_out, identify
from tillage.llm.mixing import mix
from tillage.llm.quality_rules import judge_quality
from tillage.llm.simhash import near_duplicates
from tillage.llm.token_alignment import AlignParams, align_tokens
from tillage.llm.token_files import token_files
from tillage.llm.url_filter import judge_urls
from tillage.llm.vector_codes import vector_codes
from tillage.llm.warc import captures

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


#: Fixed values of the query: rule, verdict.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = judge_quality(docs, out="q", keep_text=False)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    return q.select("doc_id", *[F.col(f"q.{n}").alias(n) for n in names])


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


ORACLE_SQL["op10_benchmark_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bi)),
dg AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dg JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False, out="b")
    ids = F.sha2(F.array_join(F.array_sort("b.items"), ","), 256)
    return hits.select("doc_id", "b.n_words", "b.n_hit", F.size("b.items").cast("long").alias("n_items"), ids.alias("items_sha256"), "b.contaminated")


ORACLE_SQL["op4_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM m
"""


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = captures(table(spark, sf_dir, "pages"), with_payload=False)
    field = lambda n: F.try_element_at(F.col("metadata.fields"), F.lit(n)).try_cast("long")
    digest = F.when(F.col("response.type") == "revisit", F.substring_index("response.declared_digest", ":", -1)).otherwise(F.col("response.payload_digest"))
    size = F.when(F.col("response.type") == "revisit", field("payload-bytes")).otherwise(F.col("response.payload_bytes"))
    return found.select(
        field("page-id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("response.type").alias("record_type"),
        F.regexp_extract("response.refers_to", "urn:capture:(-?[0-9]+):", 1).try_cast("long").alias("refers_to"),
    )


ORACLE_SQL["op9_chat_format"] = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS safe_text,
         replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS safe_role
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(3 + length(safe_role) + 1 + length(safe_text) + 4) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = records_of_rows(table(spark, sf_dir, "conversations"))
    hard = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(hard.alias("prompt"), hard.alias("completion"))).alias("record"))
    done = format_turns(canonical_turns(own.unionByName(extra), "record"))
    read, loss = read_turns(F.col("formatted")), read_loss(F.col("formatted"), F.col("loss_mask"))
    back = done.select("conv_id", read.alias("read"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    text = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    field = fit_field(docs.where(~out))
    found = identify(docs.select("doc_id", "text"), field)
    return found.select("doc_id", out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


@query
def op6_gru_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    found = score_documents(docs, ~out)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Domains by label, and their target shares of all tokens.
MIX_WEIGHTS = {"clean": 0.9, "low": 0.08, "toxic": 0.02}


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean")
    labelled = table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, fit = mix(docs, labelled, MIX_WEIGHTS, keep_text=False)
    post = [F.coalesce(F.get("mix.posteriors", i), F.lit(0.0)).alias(f"p_{d}") for i, d in enumerate(fit.domains)]
    missed = max((abs(m) for m in fit.missed().values()), default=0.0)
    return found.select("doc_id", "mix.n_tokens", *post, "mix.rate", "mix.copies", F.lit(missed).alias("target_missed"))


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_files(docs, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def _codes_sql(rounds: int = 6) -> str:
    """Rounds of assignment and averaging as a chain of tables: b0 to b6 are codebooks, a0 to a6 assignments."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, p, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS d
  FROM (SELECT vec_id, p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts JOIN b{i} USING (p))
  GROUP BY vec_id, p)""")
        if i < rounds:
            steps.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.c, b.c) AS c
  FROM b{i} b LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c
    FROM (SELECT p, e, j, sum(x[j]) AS s, count(*) AS n FROM a{i} JOIN parts USING (vec_id, p), range(1, 9) r(j) GROUP BY p, e, j)
    GROUP BY p, e
  ) n ON b.p = n.p AND b.e = n.e)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT vec_id, p, v[8 * p + 1 : 8 * p + 8] AS x FROM kept, range(8) r(p)),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 16),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) FROM (SELECT p, e, j, c[j] AS v FROM b{rounds}, range(1, 9) r(j))) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


ORACLE_SQL["op12_vector_codes"] = _codes_sql()


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", F.col("group_error").alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = AlignParams(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), with_groups=False)
    found, _ = align_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), params)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("n_best_a").alias("n_best"), "count_sum", "groups_sha256")
