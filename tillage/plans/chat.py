"""Queries of the assistant: contexts, routing, questions to the documents, answer gates, answers, recommendations.

Conversations are the messages, their user the conversation's number modulo fifty; customers are the crops,
their owner the customer's number modulo fifty.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillage.operators import assistant as A
from tillage.plans import sqlparts as S
from tillage.plans.catalogue import REGISTRY
from tillage.plans.texts import CHAT, INTENT_CASE
from tillage.session import table

add = REGISTRY.add
NAMES = ["the", "with", "der", "les", "para", "maiz"]
CATALOGUE = ["that", "with", "les", "maiz"]
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _crops(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (k % len(NAMES)).cast("int"))
    status = F.when(k % 7 == 0, "inactivo").when(k % 7 != 1, "activo")
    return table(spark, sf_dir, "customer").select(
        (k % 50).alias("user_id"), k.alias("crop_id"), name.alias("crop_name"), F.lit("").alias("display_name"), status.alias("status"),
        k.alias("created")
    )


def _messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("user_id"), "conv_id", "turn", "text")
    return c.withColumn("intent", A.intent(F.col("text")))


def _contexts(spark, sf_dir, **lists):
    """Contexts with what a query makes of a user's list of crops."""
    return A.contexts(_messages(spark, sf_dir), _crops(spark, sf_dir), CATALOGUE, lists)


_CONTEXT = f"""{CHAT}, m AS (SELECT z.conv_id % 50 AS user_id, z.conv_id, z.turn, n, text, CASE {INTENT_CASE} ELSE 'unknown' END AS intent FROM z JOIN conversations c ON c.conv_id = z.conv_id AND c.turn = z.turn),
k AS (SELECT c_custkey % 50 AS user_id, c_custkey AS crop_id, {_LIST(NAMES)}[c_custkey % {len(NAMES)} + 1] AS crop_name FROM customer WHERE c_custkey % 7 <> 0),
l AS (SELECT user_id, count(*) AS n_active, list(upper(crop_name[1]) || crop_name[2:] ORDER BY crop_id DESC) AS active, any_value(crop_id) AS only_id, any_value(crop_name) AS only_name FROM k GROUP BY user_id),
f AS (SELECT conv_id, turn, crop_id, crop_name, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(crop_name) DESC, crop_id DESC) AS i FROM m JOIN k USING (user_id) WHERE contains(n, crop_name)),
r AS (SELECT conv_id, turn, list_filter(list_sort(list_transform({_LIST(CATALOGUE)}, lambda x: CASE WHEN contains(n, x) THEN 100 - length(x) ELSE 999 END || '|' || x)), lambda y: NOT starts_with(y, '999'))[1] AS best FROM m),
u AS (SELECT m.*, coalesce(n_active, 0) AS n_active, coalesce(active, []) AS active, f.crop_id AS named_id, coalesce(f.crop_id, CASE WHEN n_active = 1 AND intent IN {_IN(A.FALLBACK_INTENTS)} THEN only_id END) AS target_id,
      coalesce(f.crop_name, CASE WHEN n_active = 1 AND intent IN {_IN(A.FALLBACK_INTENTS)} THEN only_name END) AS target, nullif(split_part(best, '|', 2), '') AS requested,
      CASE WHEN f.crop_id IS NOT NULL THEN 'explicit' WHEN n_active = 1 AND intent IN {_IN(A.FALLBACK_INTENTS)} THEN 'fallback_single_crop' ELSE 'none' END AS source
      FROM m LEFT JOIN l USING (user_id) LEFT JOIN f ON f.conv_id = m.conv_id AND f.turn = m.turn AND f.i = 1 JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn),
y1 AS (SELECT *, requested IS NOT NULL AND named_id IS NULL AS conflict, CASE WHEN intent = 'library_question' OR n_active = 0 THEN 'biblioteca' ELSE 'parcela' END AS mode FROM u)"""


@add(
    "chat_context",
    f"{_CONTEXT} SELECT conv_id, turn, intent, array_to_string(active, ',') AS active, CAST(n_active AS INT) AS n_active, target_id, target, requested, source, conflict FROM y1"
)
def chat_context(spark, sf_dir):
    """What is known about a message's user: active crops, the crop in question, a crop that is not grown."""
    c = _contexts(spark, sf_dir, active=lambda names: F.array_join(names, ","))
    return c.select("conv_id", "turn", "intent", "active", "n_active", "target_id", "target", "requested", "source", "conflict")


_DOCUMENTS = f"intent <> 'garbage' AND intent NOT IN {_IN(A.READING_INTENTS)} AND (mode = 'biblioteca' OR intent IN {_IN(A.DOCUMENT_INTENTS)})"


@add("assistant_routing", f"{_CONTEXT} SELECT conv_id, turn, intent, mode, {_DOCUMENTS} AS documents FROM y1")
def assistant_routing(spark, sf_dir):
    """Mode and document gate of every message."""
    c = _contexts(spark, sf_dir)
    c = c.withColumn("mode", A.mode(F.col("intent"), F.lit("auto"), F.col("n_active")))
    return c.select("conv_id", "turn", "intent", "mode", A.needs_documents(F.col("intent"), F.col("mode")).alias("documents"))


_RAW = S.strip("coalesce(text, '')")
_TOPIC = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.TOPICS.items()) + " END"


@add(
    "clean_query",
    f"""{_CONTEXT}, q AS (SELECT *, {_RAW} AS raw, {_TOPIC} AS topic, coalesce(target, requested) AS crop FROM y1)
SELECT conv_id, turn, CASE WHEN mode = 'biblioteca' THEN coalesce(nullif(raw, ''), 'consulta agricola de biblioteca')
WHEN topic IS NOT NULL THEN CASE WHEN crop IS NOT NULL THEN {S.strip("topic || ' en cultivo de ' || crop || ': ' || raw")} WHEN n_active > 0 THEN {S.strip("topic || ' para cultivos activos (' || array_to_string(active, ', ') || '): ' || raw")} ELSE {S.strip("topic || ': ' || raw")} END
WHEN requested IS NOT NULL AND target IS NULL THEN coalesce(nullif(raw, ''), 'informacion tecnica sobre ' || crop) ELSE coalesce(nullif(raw, ''), 'consulta agricola') END AS query,
CASE WHEN requested IS NOT NULL AND (target IS NULL OR mode = 'biblioteca') THEN requested ELSE target END AS crop_focus,
CASE WHEN requested IS NOT NULL OR target IS NOT NULL THEN 'crop_boost' ELSE 'global' END AS retrieval_scope,
CASE WHEN requested IS NOT NULL AND (target IS NULL OR mode = 'biblioteca') THEN NULL ELSE target_id END AS user_crop_id FROM q""",
)
def clean_query(spark, sf_dir):
    """The query that a message sends to the documents, and the focus that goes with it."""
    c = _contexts(spark, sf_dir, active=lambda names: F.array_join(names, ", "))
    c = c.withColumn("mode", A.mode(F.col("intent"), F.lit("auto"), F.col("n_active")))
    query = A.clean_query(F.col("text"), F.col("intent"), F.col("mode"), F.col("target"), F.col("requested"), F.col("n_active"), F.col("active"))
    scope = A.query_scope(F.col("mode"), F.col("target"), F.col("target_id"), F.col("requested"))
    return c.select("conv_id", "turn", query.alias("query"), scope.alias("s")).select("conv_id", "turn", "query", "s.*")


#: Answers in all states, dealt to the messages by number.
_ANSWERS = [
    "", "<p> </p>", "No hay información suficiente aquí", "Eres el componente documental", "Soy Asistente de Prueba", "Pasos y recomendaciones para «Eres un", "El riego es útil.",
    "La historia del cultivo", "<p>Aplicar<br>agua &amp; abono</p>",
]
#: The prompt mark that the query's caller adds.
_OWN = ["asistente de prueba"]
_HOLDS = lambda c, marks: "(" + " OR ".join(f"contains({c}, {S.repr_sql(m)})" for m in sorted({A.plain_mark(m) for m in marks})) + ")"
_CHAT_NORM = lambda c: rf"trim(regexp_replace(regexp_replace(translate({S.fold(c)}, '¿?¡!', '    '), '[^a-z0-9%°\s\-_/.,]', ' ', 'g'), '\s+', ' ', 'g'))"
_BARE = r"trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(a, '(?i)<br\s*/?>|</p>', chr(10), 'g'), '(?i)<li[^>]*>', '- ', 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"


@add(
    "answer_gate",
    f"""{CHAT}, g AS (SELECT conv_id, turn, n, ({_LIST([a.replace("'", "''") for a in _ANSWERS])})[(conv_id + turn) % {len(_ANSWERS)} + 1] AS a, conv_id % 9 = 0 AS poor, CASE WHEN turn % 2 = 0 THEN 'biblioteca' ELSE 'parcela' END AS mode, CASE WHEN conv_id % 2 = 0 THEN 'teocintle' ELSE 'suelo' END AS ev FROM z),
h AS (SELECT *, {_BARE} AS p FROM g), i AS (SELECT *, {_CHAT_NORM('p')} AS pn, {_CHAT_NORM("p || ' ' || ev")} AS en FROM h)
SELECT conv_id, turn, CASE WHEN poor THEN 'rag_insufficient_evidence' WHEN p = '' THEN 'rag_empty_answer' WHEN contains(pn, 'no hay informacion suficiente') THEN 'rag_declared_insufficient'
WHEN {_HOLDS('pn', [*A.LEAKS, *_OWN])} THEN 'rag_prompt_leak' WHEN {_HOLDS('pn', A.GENERIC)} THEN 'rag_generic_or_unrelated_answer'
WHEN mode = 'biblioteca' AND {_HOLDS('n', A.HISTORY_QUESTIONS)} AND NOT {_HOLDS('en', A.HISTORY_SUPPORT)} THEN 'rag_no_history_support' ELSE 'ok' END AS gate FROM i""",
)
def answer_gate(spark, sf_dir):
    """The first reason against an answer; the answers are dealt to the messages by number."""
    i = F.col("conv_id") + F.col("turn")
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.get(
            F.array(*[F.lit(a) for a in _ANSWERS]), (i % len(_ANSWERS)).cast("int")
        ).alias("answer"), (F.col("conv_id") % 9 == 0).alias("poor"),
        F.when(F.col("turn") % 2 == 0, "biblioteca").otherwise("parcela").alias("mode"), F.when(F.col("conv_id") % 2 == 0, "teocintle").otherwise("suelo").alias("evidence"),
    )
    return c.select("conv_id", "turn", A.quality_gate(F.col("answer"), F.col("poor"), F.col("text"), F.col("mode"), F.col("evidence"), _OWN).alias("gate"))


_LINES = "array_to_string(list_transform(active, lambda x: '- ' || x), chr(10))"
_Q = S.repr_sql


def _text_sql(v: str) -> str:
    return _Q(v).replace("\n", "' || chr(10) || '")


_NEEDS = " ".join(
    f"WHEN intent = '{k}' THEN {_text_sql(intro + chr(10) * 2 + 'Cultivos activos:' + chr(10))} || {_LINES} || {_text_sql(chr(10) * 2 + checks + A.NEEDS_CROP_END)}" for k,
    (intro, checks) in A.NEEDS_CROP.items()
)


@add(
    "answer_cascade",
    f"""{_CONTEXT}, d AS (SELECT *, CASE WHEN turn % 3 = 0 THEN 'texto ' || turn END AS doc FROM y1)
SELECT conv_id, turn, CASE WHEN intent = 'garbage' THEN {_Q(A.NOT_UNDERSTOOD)} WHEN conflict AND mode <> 'biblioteca' THEN {_Q(A.CONFLICT[0])} || requested || {_Q(A.CONFLICT[1])} || coalesce(chr(10) || chr(10) || 'Información de biblioteca:' || chr(10) || doc, {_Q(A.CONFLICT_EMPTY)})
WHEN mode = 'biblioteca' THEN coalesce(doc, {_Q(A.NO_LIBRARY)}) WHEN n_active = 0 THEN {_Q(A.NO_CROPS)} WHEN intent = 'water_balance' AND target IS NULL THEN 'agua: ' || n_active
WHEN intent IN {_IN(A.PARCEL_INTENTS)} AND target IS NULL THEN 'medida ' || intent WHEN target IS NOT NULL THEN 'cultivo ' || target {_NEEDS}
ELSE {_text_sql(A.SEVERAL[0] + chr(10) * 2 + 'Cultivos activos:' + chr(10))} || {_LINES} || {_text_sql(A.SEVERAL[1])} END AS answer FROM d""",
)
def answer_cascade(spark, sf_dir):
    """The answer of the first case that fits; every third message finds something in the documents."""
    c = _contexts(spark, sf_dir, lines=A.crop_lines)
    c = c.withColumn("mode", A.mode(F.col("intent"), F.lit("auto"), F.col("n_active")))
    found = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("texto "), F.col("turn").cast("string")))
    parts = {n: F.col(n) for n in ("intent", "mode", "requested", "conflict", "n_active", "target")}
    parts |= {"library": found, "documents": found, "crop_lines": F.col("lines"), "water": F.concat(F.lit("agua: "), F.col("n_active").cast("string"))}
    parts |= {"metric": F.concat(F.lit("medida "), "intent"), "crop_answer": F.concat(F.lit("cultivo "), "target")}
    return c.select("conv_id", "turn", A.answer(parts).alias("answer"))


@add(
    "recent_recommendations",
    """WITH a AS (SELECT max(o_orderdate) AS as_of FROM orders)
SELECT o_custkey AS crop_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS action FROM orders, a
WHERE o_orderstatus = 'O' AND o_orderdate >= as_of - INTERVAL 4320 HOUR GROUP BY o_custkey""",
)
def recent_recommendations(spark, sf_dir):
    """Orders stand for recommendations, open ones are pending; half a year stands for six hours."""
    o = table(spark, sf_dir, "orders")
    as_of = o.agg(F.max("o_orderdate").alias("as_of"))
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("crop_id"), F.col("o_orderpriority").alias("action"),
        F.when(F.col("o_orderstatus") == "O", "pendiente").otherwise("hecho").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created")
    )
    dated = rows.crossJoin(F.broadcast(as_of))  # one row
    return A.recent_recommendations(dated, F.col("as_of").cast("timestamp"), 4320).select("crop_id", "id", "action")
