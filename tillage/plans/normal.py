"""Queries over text in need of repair: Unicode forms, extracted pages, units, equations, names, glossaries, metadata."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillage.functions import text as T
from tillage.plans import sqlparts as S
from tillage.plans.catalogue import REGISTRY
from tillage.session import table

add = REGISTRY.add
TEXT = "coalesce(text, '')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")


#: Marks that are not composed, and ligatures, for the end of every text.
LOOSE = " nin\u0303o stra\u00dfe \u0153uvre "


def _loose(c):
    """The text with e and a combining acute for every é, and some more marks."""
    return F.concat(F.replace(c, F.lit("\u00e9"), F.lit("e\u0301")), F.lit(LOOSE))


_LOOSE_SQL = f"(replace({TEXT}, '\u00e9', 'e\u0301') || '{LOOSE}')"
_LOOSE_TOKENS = f"regexp_extract_all({S.fold(_LOOSE_SQL)}, '[a-z0-9_]+')"


@add("fold_tokens", f"SELECT doc_id, CAST(len({_LOOSE_TOKENS}) AS BIGINT) AS n_tokens, md5(array_to_string({_LOOSE_TOKENS}, ' ')) AS digest FROM documents")
def fold_tokens(spark, sf_dir):
    """Marks that are not composed fold as well, and ligatures become two letters."""
    t = T.tokens(_loose(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


_CLEAN = [(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "), (r"[ \t\x{A0}]+", " "), (r"\n{3,}", "\n\n")]


@add(
    "normalize_text_chain",
    f"WITH a AS (SELECT doc_id, {S.strip(S.chain(f'nfc_normalize({_LOOSE_SQL})', _CLEAN))} AS t FROM documents) SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest FROM a"
)
def normalize_text_chain(spark, sf_dir):
    """Every text with accents that are not composed, which the first step composes."""
    t = T.normalize_text(_loose(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@add(
    "sentence_variants",
    rf"""WITH t AS (SELECT doc_id, {TEXT} AS t FROM documents)
SELECT doc_id, CAST(1 + len(regexp_extract_all(t, '[.!?]\s+[A-ZÁÉÍÓÚÑ¿¡]')) AS INT) AS before_capital,
CAST(len(list_filter(string_split_regex(regexp_replace(regexp_replace(t, '([.!?:;])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS INT) AS and_lines,
CAST(len(list_filter(string_split_regex(replace(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), ' - ', chr(1)), chr(1)), lambda s: length(trim(s)) > 20)) AS INT) AS or_dashes,
CAST(len(list_filter(string_split_regex(t, '\n\s*\n+'), lambda s: trim(s) <> '')) AS INT) AS paragraphs FROM t""",
)
def sentence_variants(spark, sf_dir):
    c = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", F.size(T.sentences_before_capital(c)).alias("before_capital"), F.size(T.sentences_and_lines(c)).alias("and_lines"),
        F.size(T.sentences_or_dashes(c)).alias("or_dashes"), F.size(T.paragraphs(c)).alias("paragraphs"),
    )


_UNITS = " 5 KG / HA y 3 l/HA 20 °  c 4 PPM 2 G/ l"


@add(
    "unit_spellings",
    rf"SELECT doc_id, md5(trim(regexp_replace({S.chain(f'({TEXT} || {S.repr_sql(_UNITS)})', T.UNITS)}, '\s+', ' ', 'g'))) AS digest FROM documents"
)
def unit_spellings(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.canonical_units(F.concat("text", F.lit(_UNITS)))).alias("digest"))


_EQUATIONS = r" y = 3x + 2; $a^2$ ≤ \(b\) "


@add(
    "equation_protection",
    f"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all({TEXT} || {S.repr_sql(_EQUATIONS)}, '{T.EQUATION}'))) AS BIGINT) AS n_equations, true AS restored FROM documents",
)
def equation_protection(spark, sf_dir):
    """Equations become sentinels and come back: how many there are, and whether the text is the same again."""
    base = _docs(spark, sf_dir).select("doc_id", F.concat("text", F.lit(_EQUATIONS)).alias("t"))
    kept, pairs = T.protect_equations(F.col("t"))
    base = base.select("doc_id", "t", kept.alias("kept"), pairs.alias("pairs"))
    return base.select(
        "doc_id", F.size("pairs").cast("long").alias("n_equations"),
        (T.restore_equations(F.col("kept"), F.col("pairs")) == F.col("t")).alias("restored")
    )


@add(
    "safe_names",
    r"""SELECT doc_id, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS compact, regexp_replace(regexp_replace('a/b/' || source || ' ñ.pdf', '^.*[\\/]', ''), '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM documents""",
)
def safe_names(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", T.compact_name(F.col("source")).alias("compact"),
        T.safe_name(F.concat(F.lit("a/b/"), "source", F.lit(" ñ.pdf"))).alias("safe")
    )


_FURNITURE = "\nPage 3 of 9\n17\npág. 4\nPage three"
_FURNITURE_SQL = "' || chr(10) || '".join(_FURNITURE.split("\n"))


@add(
    "page_furniture",
    f"SELECT doc_id, CAST(len(list_filter(string_split({TEXT} || '{_FURNITURE_SQL}', chr(10)), lambda x: regexp_matches(trim(x), '{T.FURNITURE[0]}') OR regexp_matches(trim(x), '{T.FURNITURE[1]}'))) AS BIGINT) AS n_furniture FROM documents",
)
def page_furniture(spark, sf_dir):
    lines = F.split(F.concat("text", F.lit(_FURNITURE)), "\n")
    return _docs(spark, sf_dir).select("doc_id", F.size(F.filter(lines, lambda x: T.page_furniture(x))).cast("long").alias("n_furniture"))


_BROKEN = "\r\npalab-\nra ABC_DEF\nGHI_JKL cafe\u0301\u00adx a-  \n b\n\n\n\nz"
_BROKEN_SQL = "'" + _BROKEN.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"


@add(
    "extracted_text",
    f"""WITH a AS (SELECT doc_id, replace(replace(nfc_normalize({TEXT} || {_BROKEN_SQL}), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
b AS (SELECT doc_id, {S.strip(S.chain('t', T.EXTRACTED))} AS t FROM a) SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest FROM b""",
)
def extracted_text(spark, sf_dir):
    t = T.normalize_extracted(F.concat("text", F.lit(_BROKEN)))
    return _docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@add(
    "clipped_at_word",
    rf"SELECT doc_id, CASE WHEN length({TEXT}) <= 900 THEN {TEXT} ELSE regexp_replace(substr({TEXT}, 1, 900), '\s+\S*$', '') || '…' END AS clipped FROM documents"
)
def clipped_at_word(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clip_at_word(F.col("text")).alias("clipped"))


_MEASURES = " 12,5 km/h y 30 °C, 5 kg/ha, 7 zz, -4 mm y 50%"


@add(
    "magnitudes",
    rf"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all({TEXT} || '{_MEASURES}', '{T.MAGNITUDE}')) AS m FROM documents),
p AS (SELECT doc_id, CAST(replace(regexp_extract(m, '{T.MAGNITUDE}', 1), ',', '.') AS DOUBLE) AS v, lower(regexp_extract(m, '{T.MAGNITUDE}', 2)) AS u FROM m),
a AS (SELECT doc_id, v, coalesce(alias, u) AS u FROM p LEFT JOIN (VALUES {S.values(list(T.UNIT_ALIASES.items()))}) t(name, alias) ON name = u)
SELECT doc_id, unit_si, count(*) AS n, round(sum(v * f + o), 6) AS total FROM a JOIN (VALUES {S.values(T.SI_UNITS)}) s(unit, unit_si, f, o) ON unit = u GROUP BY ALL""",
)
def magnitudes(spark, sf_dir):
    """Numbers with units, in SI units."""
    m = _docs(spark, sf_dir).select("doc_id", F.explode(T.magnitudes(F.concat("text", F.lit(_MEASURES)))).alias("m"))
    return m.groupBy("doc_id", F.col("m.unit_si").alias("unit_si")).agg(F.count("*").alias("n"), F.round(F.sum("m.value_si"), 6).alias("total"))


_GLOSSARY = [T.Term("the", "el"), T.Term("and", keep=True), T.Term("with", "con")]


@add(
    "glossary",
    rf"""WITH m AS (SELECT doc_id, text, regexp_replace(regexp_replace({S.ascii_only(S.squeeze(TEXT))}, '(?i)\bthe\b', 'el', 'g'), '(?i)\bwith\b', 'con', 'g') AS t FROM documents)
SELECT doc_id, md5(t) AS digest, CAST(round((CAST(regexp_matches(t, '\bel\b') AS INT) + CAST(regexp_matches(t, '\bcon\b') AS INT)) / 2, 4) AS DOUBLE) AS consistency,
sha1(lower({S.strip(f"substr({TEXT}, 1, 200)")})) AS memory_key FROM m""",
)
def glossary(spark, sf_dir):
    """Masked, put back, translated by the glossary; the share of its terms that occur; the key of the memory."""
    plain = S.ascii_only(T.squeeze(F.col("text")))
    done = T.glossary_applied(T.unmasked(T.masked(plain, _GLOSSARY), _GLOSSARY), _GLOSSARY)
    base = _docs(spark, sf_dir).select("doc_id", "text", done.alias("t"))
    return base.select(
        "doc_id", F.md5("t").alias("digest"), T.glossary_consistency(F.col("t"), _GLOSSARY).alias("consistency"),
        T.context_hash(F.col("text")).alias("memory_key")
    )


_COMPACT = "regexp_replace(lower(x), '[^a-z0-9]', '', 'g')"


@add(
    "rival_lines",
    rf"""WITH l AS (SELECT doc_id, {S.ascii_only(TEXT)} AS a, list_filter(string_split({S.ascii_only(TEXT)}, chr(10)), lambda x: NOT contains({_COMPACT}, 'dans') AND NOT contains({_COMPACT}, 'nicht')) AS ls FROM documents),
j AS (SELECT doc_id, a, {S.strip("array_to_string(ls, chr(10))")} AS t FROM l), c AS (SELECT doc_id, CASE WHEN t <> '' THEN t ELSE a END AS t FROM j)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '(?i)\bdans\b', '', 'g'), '(?i)\bnicht\b', '', 'g')) AS digest, 'dans,nicht' AS blocked FROM c""",
)
def rival_lines(spark, sf_dir):
    """Lines that name another word of the catalogue than the target go."""
    catalogue = ["that", "dans", "nicht"]
    base = _docs(spark, sf_dir).select("doc_id", S.ascii_only(F.col("text")).alias("a"))
    return base.select(
        "doc_id", F.md5(T.without_rivals(F.col("a"), F.lit("That"), catalogue)).alias("digest"),
        F.array_join(T.blocked_names(F.lit("That"), catalogue), ",").alias("blocked")
    )


@add(
    "metadata_precedence",
    r"""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' T' || doc_id ELSE '  ' END AS t, CASE WHEN doc_id % 4 = 0 THEN 'found ' || source WHEN doc_id % 4 = 1 THEN '' END AS ft,
CASE doc_id % 5 WHEN 0 THEN 'Usuario' WHEN 1 THEN source END AS fa, 1970 + doc_id % 60 AS yr, 'dir/' || source || CASE WHEN doc_id % 2 = 0 THEN '.v1.PDF' ELSE '.txt' END AS file, doc_id % 2 = 0 AS pdf FROM documents)
SELECT doc_id, coalesce(nullif(trim(t), ''), CASE WHEN pdf THEN nullif(trim(ft), '') END, regexp_replace(regexp_replace(file, '^.*/', ''), '(.)\.[^.]*$', '\1')) AS title,
CASE WHEN pdf AND lower(trim(fa)) NOT IN ('usuario', 'user', 'author') THEN fa END AS author, CASE WHEN pdf AND yr BETWEEN 1980 AND 2100 THEN yr END AS year FROM m""",
)
def metadata_precedence(spark, sf_dir):
    """The form's values before those of the file before its name."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    found = {
        "title": F.when(i % 4 == 0, F.concat(F.lit("found "), "source")).when(i % 4 == 1, ""),
        "author": F.when(i % 5 == 0, "Usuario").when(i % 5 == 1, F.col("source")),
        "year": T.pdf_year(F.concat(F.lit("D:"), (1970 + i % 60).cast("string"), F.lit("0101")), none),
    }
    form = {"title": F.when(i % 3 == 0, F.concat(F.lit(" T"), i.cast("string"))).otherwise("  "), "author": none, "year": F.lit(None).cast("int")}
    file = F.concat(F.lit("dir/"), "source", F.when(i % 2 == 0, ".v1.PDF").otherwise(".txt"))
    return _docs(spark, sf_dir).select("doc_id", T.merged_metadata(form, found, file).alias("m")).select(
        "doc_id", "m.title", "m.author", F.col("m.year").cast("long").alias("year")
    )


@add(
    "file_types",
    r"""WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a.b.PDF' WHEN 1 THEN 'plain' WHEN 2 THEN source || '.md' ELSE 'end.' END AS f FROM documents)
SELECT doc_id, coalesce(nullif(lower(regexp_extract(f, '\.([^.]*)$', 1)), ''), 'desconocido') AS file_type FROM f""",
)
def file_types(spark, sf_dir):
    """What stands after the last dot."""
    i = F.col("doc_id") % 4
    name = F.when(i == 0, "a.b.PDF").when(i == 1, "plain").when(i == 2, F.concat("source", F.lit(".md"))).otherwise("end.")
    return _docs(spark, sf_dir).select("doc_id", T.file_type(name).alias("file_type"))


_LINES = "\n```\n# code\n```\n## Title\n - one\n2) two"
_LINES_SQL = "'" + _LINES.replace("\n", "' || chr(10) || '") + "'"


@add(
    "markdown_lines",
    rf"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS x FROM (SELECT doc_id, string_split({TEXT} || {_LINES_SQL}, chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, n, CASE WHEN regexp_matches(x, '^#{{1,6}}\s+') THEN 'heading' WHEN regexp_matches(x, '^\s*([-*+]|\d+[.)])\s+') THEN 'list' WHEN regexp_matches(x, '^\s*```') THEN 'fence' WHEN trim(x) = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM l),
f AS (SELECT *, sum(CASE WHEN kind = 'fence' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS inside FROM k)
SELECT doc_id, CASE WHEN inside AND kind <> 'fence' THEN 'code' ELSE kind END AS kind, count(*) AS n FROM f GROUP BY ALL""",
)
def markdown_lines(spark, sf_dir):
    text = F.concat("text", F.lit(_LINES))
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("kind", T.line_kind(F.col("line")))
    inside = F.sum(F.when(F.col("kind") == "fence", 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("n")) % 2 == 1
    return lines.withColumn(
        "kind", F.when(inside & (F.col("kind") != "fence"), "code").otherwise(F.col("kind"))
    ).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@add(
    "string_hash_rollout",
    """WITH RECURSIVE s AS (SELECT doc_id, source || '-' || doc_id AS s FROM documents), h AS (SELECT doc_id, s, 0 AS i, 0::BIGINT AS h FROM s
UNION ALL SELECT doc_id, s, i + 1, ((h * 31 + ascii(substr(s, i + 1, 1)) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 FROM h WHERE i < length(s))
SELECT doc_id, abs(h) AS hash, abs(h) % 100 < 25 AS rollout FROM h WHERE i = length(s)""",
)
def string_hash_rollout(spark, sf_dir):
    """A quarter of the sessions by the 32-bit hash of their names."""
    h = T.string_hash32(F.concat_ws("-", "source", F.col("doc_id").cast("string")))
    return _docs(spark, sf_dir).select("doc_id", h.alias("hash")).select("doc_id", "hash", (F.col("hash") % 100 < 25).alias("rollout"))
