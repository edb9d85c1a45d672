"""Queries over texts: folding, sentences, chunks, entities, labels, answers, chat."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillage.functions import chunking as C
from tillage.functions import text as T
from tillage.operators import assistant as A
from tillage.operators import entities as E
from tillage.operators import synthesis as Y
from tillage.plans import sqlparts as S
from tillage.plans.catalogue import REGISTRY
from tillage.plans.sqlparts import ascii_only
from tillage.session import table

add = REGISTRY.add
TEXT = "coalesce(text, '')"
#: A small dictionary of words that the test corpus does hold.
WORDS = {"ARTICULO": ["the", "les", "der"], "ENLACE": ["and", "und"], "PAR": ["of the", "in the"]}
RENAMED = {"the and": "both", "und": "and", "dans les": "inside"}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")


_STOP = ", ".join(f"'{w}'" for w in sorted(set(T.ANSWER_STOPWORDS)))


@add(
    "keyword_extract",
    f"WITH k AS (SELECT doc_id, list_filter(regexp_extract_all({S.fold(TEXT)}, '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})) AS ks FROM documents) SELECT doc_id, CAST(len(ks) AS BIGINT) AS n, CAST(len(list_distinct(ks)) AS BIGINT) AS n_distinct FROM k"
)
def keyword_extract(spark, sf_dir):
    k = T.keywords(F.col("text"), sorted(set(T.ANSWER_STOPWORDS)))
    return _docs(spark, sf_dir).select("doc_id", F.size(k).cast("long").alias("n"), F.size(F.array_distinct(k)).cast("long").alias("n_distinct"))


SENTENCES = rf"list_filter(list_transform(string_split_regex(regexp_replace({TEXT}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 6)"


@add(
    "sentence_split",
    f"WITH s AS (SELECT doc_id, {SENTENCES} AS ss FROM documents) SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, CAST(coalesce(list_max(list_transform(ss, lambda s: length(s))), 0) AS BIGINT) AS longest, md5(array_to_string(ss, '|')) AS digest FROM s"
)
def sentence_split(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return _docs(spark, sf_dir).select(
        "doc_id", F.size(s).cast("long").alias("n_sentences"),
        F.coalesce(F.array_max(F.transform(s, lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"),
        F.md5(F.array_join(s, "|")).alias("digest")
    )


@add(
    "relevant_sentences",
    f"""WITH s AS (SELECT doc_id, {SENTENCES} AS ss FROM documents),
u AS (SELECT doc_id, i, ss[i] AS sent, len(list_filter(['the', 'with', 'les', 'und'], lambda t: contains({S.fold('ss[i]')}, t))) AS n FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n > 0 THEN -n ELSE 0 END, i) AS k, max(n) OVER (PARTITION BY doc_id) AS best FROM u)
SELECT doc_id, k AS place, sent FROM r WHERE (n > 0 AND k <= 2) OR (best = 0 AND k = 1)""",
)
def relevant_sentences(spark, sf_dir):
    terms = F.array(*[F.lit(w) for w in ("the", "with", "les", "und")])
    picked = Y.relevant_sentences(F.col("text"), terms, F.lit(2))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(picked).alias("p", "sent")).select("doc_id", (F.col("p") + 1).cast("long").alias("place"), "sent")


def _marker_sql() -> str:
    n = {lang: " + ".join(f"CAST(contains(lower({TEXT}), '{m}') AS INT)" for m in marks) for lang, marks in T.LANGUAGE_MARKERS.items()}
    cols = ", ".join(f"{v} AS n_{k}" for k, v in n.items())
    pick = " ".join(f"WHEN n_{k} = first THEN '{k}'" for k in n)
    return f"""WITH m AS (SELECT doc_id, length({TEXT}) AS size, {cols} FROM documents),
r AS (SELECT *, list_sort([{', '.join('n_' + k for k in n)}], 'DESC') AS l FROM m), f AS (SELECT *, l[1] AS first, l[2] AS second FROM r)
SELECT doc_id, CAST(first AS BIGINT) AS markers, CASE WHEN size >= 80 AND first >= 4 AND first >= 2 * second THEN CASE {pick} END END AS lang FROM f"""


@add("language_markers", _marker_sql())
def language_markers(spark, sf_dir):
    c = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", F.array_max(F.array(*T.marker_counts(c).values())).cast("long").alias("markers"), T.marker_language(c).alias("lang")
    )


@add(
    "html_strip",
    r"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?i)<br\s*/?>|</p>', chr(10), 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)<li[^>]*>', '- ', 'g'), '(?i)</li>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM a),
c AS (SELECT page_id, trim(regexp_replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM b)
SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest FROM c""",
)
def html_strip(spark, sf_dir):
    t = T.strip_html(F.coalesce("html", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"))


@add(
    "html_strip_lines",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)<li[^>]*>', '- ', 'g'), '(?i)</li>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM b)
SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest FROM c""",
)
def html_strip_lines(spark, sf_dir):
    t = T.strip_html(F.coalesce("html", F.lit("")), lines=True)
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"))


@add(
    "href_neutralise",
    r"""WITH a AS (SELECT page_id, coalesce(html, '') || '<a href="' || coalesce(url, '') || '">x</a>' AS h FROM pages) SELECT page_id, md5(regexp_replace(h, '(?i)href=["'']https?://[^"'']+["'']', 'href="#"', 'g')) AS digest FROM a"""
)
def href_neutralise(spark, sf_dir):
    h = F.concat(F.coalesce("html", F.lit("")), F.lit('<a href="'), F.coalesce("url", F.lit("")), F.lit('">x</a>'))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.neutral_links(h)).alias("digest"))


def _allowed_sql(c: str) -> str:
    """The allow-list on one text: pieces of markup and text, each kept, rewritten or dropped."""
    quoted = lambda name: rf"""regexp_extract(p, '(?is)\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)'')', 1)"""
    single = lambda name: rf"""regexp_extract(p, '(?is)\s{name}\s*=\s*''([^'']*)''', 1)"""
    given = lambda name: f"coalesce(nullif({quoted(name)}, ''), nullif({single(name)}, ''))"
    name = "lower(regexp_extract(p, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1))"
    cited = " || ".join(f"""coalesce(' {x}="' || {given(x)} || '"', '')""" for x in T.LINK_DATA)
    href = given("href")
    link = rf"""'<a href="' || CASE WHEN regexp_matches({href}, '^(?:/[^/]|/$|#|\?|\.{{1,2}}/)') THEN {href} ELSE '#' END || '"' || {cited} || '>'"""
    tags = ", ".join(f"'{t}'" for t in T.ALLOWED_TAGS)
    piece = f"""CASE WHEN {name} = '' THEN CASE WHEN p = '<' THEN '&lt;' ELSE p END WHEN {name} NOT IN ({tags}) THEN '' WHEN starts_with(p, '</') THEN '</' || {name} || '>'
WHEN {name} = 'a' THEN {link} WHEN {name} = 'br' THEN '<br />' ELSE '<' || {name} || '>' END"""
    bare = rf"regexp_replace({c}, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g')"
    pieces = rf"""regexp_extract_all({bare}, '(?s)</?[a-zA-Z](?:"[^"]*"|''[^'']*''|[^''">])*>|[^<]+|<')"""
    return f"array_to_string(list_transform({pieces}, lambda p: {piece}), '')"


#: Links of all kinds, put behind every page.
_TAIL = """">x</a><A HREF='/docs/a?b' data-page='3'>y</A><a href="//other/x">z</a><br/><script>1 < 2</script> 1 < 2"""
_LINKED = "coalesce(html, '') || '<a data-cite=\"c' || page_id || '\" onclick=\"x\" href=\"' || coalesce(url, '') || " + S.repr_sql(_TAIL)


@add("allowed_markup", f"WITH a AS (SELECT page_id, {_LINKED} AS h FROM pages), b AS (SELECT page_id, {_allowed_sql('h')} AS t FROM a) SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM b")
def allowed_markup(spark, sf_dir):
    """Pages reduced to the elements, attributes and addresses that answers may show."""
    none = F.lit("")
    h = F.concat(F.coalesce("html", none), F.lit('<a data-cite="c'), "page_id", F.lit('" onclick="x" href="'), F.coalesce("url", none), F.lit(_TAIL))
    t = table(spark, sf_dir, "pages").select("page_id", T.allowed_html(h).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


_NORM = rf"trim(regexp_replace(translate({S.fold('trim(' + TEXT + ')')}, '¿?¡!', '    '), '[^a-z0-9%°\s\-_/.,]', ' ', 'g'))"
_NORMAL = rf"trim(regexp_replace({_NORM}, '\s+', ' ', 'g'))"
_SHORT = ", ".join(f"'{w}'" for w in A.SHORT_VALID)
_ODD = f"((length(s) >= 5 AND v = 0) OR (length(s) >= 8 AND v / greatest(length(s), 1) < 0.18) OR (length(s) >= 6 AND replace(s, s[1], '') = '') OR regexp_matches(s, '{A.SMASH}') OR regexp_matches(s, '[bcdfghjklmnpqrstvwxyz]{{6,}}'))"
CHAT = rf"""WITH c AS (SELECT conv_id, turn, {_NORMAL} AS n FROM conversations),
x AS (SELECT *, regexp_replace(n, '\s+', '', 'g') AS s, len(regexp_extract_all(regexp_replace(n, '\s+', '', 'g'), '[aeiou]')) AS v, len(regexp_extract_all(n, '[a-z]')) / greatest(length(n), 1) AS letters FROM c),
y AS (SELECT *, n = '' OR (s NOT IN ({_SHORT}) AND NOT regexp_matches(n, '{A.DOMAIN}') AND {_ODD}) AS smash FROM x),
z AS (SELECT *, n = '' OR (NOT (n IN ({_SHORT}) OR regexp_matches(n, '{A.DOMAIN}')) AND (letters < 0.4 OR (length(n) <= 3 AND NOT regexp_matches(n, '\d')) OR smash)) AS low FROM y)"""


@add("garbage_detector", f"{CHAT} SELECT conv_id, turn, smash, low FROM z")
def garbage_detector(spark, sf_dir):
    norm = T.chat_text(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", norm.alias("n")).select(
        "conv_id", "turn", A.keyboard_smash(F.col("n")).alias("smash"), A.low_confidence(F.col("n")).alias("low")
    )


INTENT_CASE = " ".join(
    f"WHEN regexp_matches(n, '{p}') THEN '{k}'" for k, p in A.METRIC_INTENTS
) + " WHEN low THEN 'garbage' " + " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{k}'" for k, p in A.OTHER_INTENTS)


@add("intent_cascade", f"{CHAT} SELECT conv_id, turn, CASE {INTENT_CASE} ELSE 'unknown' END AS intent FROM z")
def intent_cascade(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.intent(F.col("text")).alias("intent"))


def ner_sql(text: str, more: str = "0 AS start") -> str:
    terms = [(t, v) for t, vs in WORDS.items() for v in vs]
    return rf"""t AS (SELECT doc_id, {text} AS t FROM documents),
p AS (SELECT doc_id, regexp_extract_all(t, '[a-z0-9_]+|[^a-z0-9_]+') AS w FROM t),
o AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM p),
e AS (SELECT doc_id, type, value, {more} FROM o, (VALUES {S.values(terms)}) x(type, value) WHERE w[i] = string_split(value, ' ')[1] AND array_to_string(w[i : i + 2 * len(string_split(value, ' ')) - 2], '') = value)"""


_START = "length(array_to_string(w[1 : i - 1], '')) AS start"
_PLACED = f"WITH {ner_sql(S.squeeze(TEXT), _START)}"


@add("dict_ner", f"{_PLACED} SELECT doc_id, type, value, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts FROM e GROUP BY ALL")
def dict_ner(spark, sf_dir):
    found = E.entities(_docs(spark, sf_dir), WORDS)
    return found.groupBy("doc_id", "type", "value").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


@add(
    "entity_coverage",
    f"WITH {ner_sql(S.squeeze(TEXT))}, g AS (SELECT doc_id, count(DISTINCT value) FILTER (value IN ('the', 'and', 'of the')) AS n FROM e GROUP BY doc_id) SELECT doc_id, CAST(round(coalesce(n, 0) / 3, 4) AS DOUBLE) AS coverage FROM documents LEFT JOIN g USING (doc_id)",
)
def entity_coverage(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    found = E.entities(docs, WORDS).groupBy("doc_id").agg(F.collect_set("value").alias("found"))  # at most the dictionary's size
    asked = F.array(*[F.lit(v) for v in ("the", "and", "of the")])
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", E.coverage(asked, F.coalesce("found", F.array().cast("array<string>"))).alias("coverage")
    )


def _rename_sql(text: str) -> str:
    for k, v in sorted(RENAMED.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        text = rf"regexp_replace({text}, '\b{k}\b', '{v}', 'g')"
    return text


@add("synonym_rewrite", f"SELECT doc_id, md5({_rename_sql(S.ascii_only(S.squeeze(TEXT)))}) AS digest FROM documents")
def synonym_rewrite(spark, sf_dir):
    """Letters that do not fold to ASCII count as blanks: engines differ on word boundaries next to them."""
    t = ascii_only(T.squeeze(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.synonyms_applied(t, RENAMED)).alias("digest"))


_LAB = ", ".join(f"CASE WHEN regexp_matches({S.squeeze(TEXT)}, '{p}') THEN '{n}' END" for n, p in E.LABEL_PATTERNS)


@add(
    "label_classifier",
    f"WITH l AS (SELECT doc_id, list_filter([{_LAB}], lambda x: x IS NOT NULL) AS l FROM documents) SELECT doc_id, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE 'DATO' END AS labels FROM l"
)
def label_classifier(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(E.labels(F.col("text")), ",").alias("labels"))


@add(
    "token_windows",
    f"""WITH d AS (SELECT doc_id, {S.tokens('text')} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 88)) AS s FROM d)
SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(len(w[s + 1 : s + 110]) AS BIGINT) AS n, md5(array_to_string(w[s + 1 : s + 110], ' ')) AS digest FROM s""",
)
def token_windows(spark, sf_dir):
    w = _docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.posexplode(C.token_windows(F.col("w"), 110, 0.2)).alias("i", "x")).select(
        "doc_id", (F.col("i") * 88).cast("long").alias("start"), F.size("x").cast("long").alias("n"),
        F.md5(F.array_join("x", " ")).alias("digest")
    )


@add(
    "fragment_uid",
    f"SELECT doc_id, sha1(concat_ws('|', doc_id, source, lang, sha1(substr({TEXT}, 1, 64)))) AS uid, CAST(greatest(1, floor((length({TEXT}) + 3) / 4)) AS BIGINT) AS approx_tokens FROM documents"
)
def fragment_uid(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", C.fragment_uid(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("text")).alias("uid"),
        C.approximate_tokens(F.col("text")).alias("approx_tokens")
    )


@add(
    "repeating_lines",
    f"""WITH l AS (SELECT source, lang, trim(unnest(string_split({TEXT}, chr(10)))) AS line FROM documents),
n AS (SELECT source, count(DISTINCT lang) AS pages FROM documents GROUP BY source)
SELECT source, line, count(DISTINCT lang) AS on_pages FROM l JOIN n USING (source) WHERE line <> '' GROUP BY source, line, pages HAVING count(DISTINCT lang) >= 2 AND count(DISTINCT lang) / pages >= 0.5""",
)
def repeating_lines(spark, sf_dir):
    """Lines on at least half of a document's pages: the source is the document, the language the page."""
    docs = _docs(spark, sf_dir)
    pages = docs.groupBy("source").agg(F.count_distinct("lang").alias("pages"))
    lines = docs.select("source", "lang", F.explode(F.split("text", "\n")).alias("l")).select("source", "lang", F.trim("l").alias("line")).where("line <> ''")
    return lines.groupBy("source", "line").agg(F.count_distinct("lang").alias("on_pages")).join(pages, "source").where("on_pages >= 2 and on_pages / pages >= 0.5").select("source", "line", "on_pages")


_TYPES = " ".join(f"WHEN regexp_matches({S.ascii_only(S.fold(TEXT))}, '{p}') THEN '{n}'" for n, p in Y.QUESTION_TYPES)


@add("question_type", f"SELECT conv_id, turn, CASE {_TYPES} ELSE 'general' END AS question_type FROM conversations")
def question_type(spark, sf_dir):
    t = ascii_only(T.fold(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Y.question_type(t).alias("question_type"))


@add(
    "faithfulness",
    rf"""WITH s AS (SELECT conv_id, turn, {SENTENCES} AS ss FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.ss, {S.fold("coalesce(b.text, '')")} AS body FROM s a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1),
w AS (SELECT conv_id, turn, len(ss) AS n, body, list_transform(ss, lambda x: list_filter(regexp_extract_all({S.fold('x')}, '[a-z]+'), lambda y: length(y) > 3)) AS ws FROM p)
SELECT conv_id, turn, CASE WHEN n > 0 THEN CAST(round(len(list_filter(ws, lambda x: len(x) >= 3 AND len(list_filter(x, lambda y: contains(body, y))) >= 3)) / n, 4) AS DOUBLE) ELSE 0.0 END AS faithfulness FROM w""",
)
def faithfulness(spark, sf_dir):
    """Each message against the one before it in its conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("body"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", Y.faithfulness(F.col("text"), F.array("body")).alias("faithfulness"))
