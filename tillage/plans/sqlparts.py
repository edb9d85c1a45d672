"""Pieces of oracle SQL that several queries share."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillage.functions.text import MARKED, PAIRS, PLAIN


def fold(c: str) -> str:
    out = rf"lower(translate(regexp_replace({c}, '\p{{M}}+', '', 'g'), '{MARKED}', '{PLAIN}'))"
    for letter, plain in PAIRS.items():
        out = f"replace({out}, '{letter}', '{plain}')"
    return out


def ascii_only(c):
    """Other letters as blanks, for a column or in SQL: engines differ on word boundaries next to them."""
    if isinstance(c, str):
        return rf"regexp_replace({c}, '[^\x00-\x7F]', ' ', 'g')"
    return F.regexp_replace(c, r"[^\x00-\x7F]", " ")


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def chain(c: str, rules: list[tuple[str, str]]) -> str:
    """Replacements in order; line breaks are written as chr(10)."""
    for pattern, by in rules:
        by = by.replace("$1", "\\1").replace("$2", "\\2")
        c = f"regexp_replace({c}, '{pattern}', {'chr(10) || chr(10)' if by == chr(10) * 2 else repr_sql(by)}, 'g')"
    return c


def repr_sql(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def packed(pieces: str, size: str, most: int, between: int, joiner: str) -> str:
    """CTEs ending in k(doc_id, n, chunk): pieces (a list for each document) packed greedily, by recursion."""
    grown = f"r.held + s.size + {between}"
    return f"""a AS (SELECT doc_id, {pieces} AS ss FROM documents),
s AS (SELECT doc_id, i, ss[i] AS piece, {size} AS size FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM a)),
r AS (SELECT doc_id, i, size AS held, 0 AS n FROM s WHERE i = 1
      UNION ALL SELECT s.doc_id, s.i, CASE WHEN {grown} > {most} THEN s.size ELSE {grown} END, CASE WHEN {grown} > {most} THEN r.n + 1 ELSE r.n END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1),
k AS (SELECT doc_id, n, string_agg(piece, {joiner} ORDER BY i) AS chunk FROM r JOIN s USING (doc_id, i) GROUP BY doc_id, n)"""


def squeeze(c: str) -> str:
    return rf"trim(regexp_replace({fold(c)}, '\s+', ' ', 'g'))"


def tokens(c: str) -> str:
    return f"regexp_extract_all({fold(f'coalesce({c}, chr(32))')}, '[a-z0-9_]+')"


def values(rows: list[tuple]) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)


def bm25(queries: list[tuple[int, str]], k: int = 100, keep: str = "true", k1: float = 1.5, b: float = 0.75) -> str:
    """CTEs ending in `lex(query_id, doc_id, score, rank)`."""
    return f"""
q AS (SELECT * FROM (VALUES {values(queries)}) t(query_id, query)),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM q) GROUP BY ALL),
d AS (SELECT doc_id, {tokens('text')} AS toks, coalesce({keep}, false) AS keep FROM documents),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
tf AS (SELECT doc_id, keep, dl, term, count(*) AS tf FROM (SELECT doc_id, keep, len(toks) AS dl, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 9) AS score
       FROM tf JOIN qt USING (term) JOIN df USING (term), st WHERE keep GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})"""


def dense(vectors: str, k: int = 8, where: str = "true", score: str = "c") -> str:
    """CTEs ending in `den(query_id, doc_id, score, rank)`; vectors names a CTE (query_id, v DOUBLE[])."""
    unit = lambda x: f"list_transform({x}, lambda y: y / sqrt(list_dot_product({x}, {x})))"
    return f"""
dc AS (SELECT query_id, vec_id AS doc_id, list_dot_product({unit('v')}, {unit('CAST(embedding AS DOUBLE[])')}) AS c FROM embeddings, {vectors} WHERE {where}),
den AS (SELECT * FROM (SELECT query_id, doc_id, round(greatest(0, {score}), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(0, {score}), 9) DESC, doc_id) AS rank FROM dc) WHERE rank <= {k})"""


def hashed(text: str, size: int) -> str:
    raw = f"list_transform(range({size}), lambda i: CAST(('0x' || substr(sha1({text} || '|' || i), 1, 8)) AS UBIGINT) / 4294967296.0 - 0.5)"
    return raw


def fusion(runs: list[str], k: int = 60) -> str:
    """CTE `rrf(query_id, doc_id, rrf_score, rank)`."""
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, 1.0 / ({k} + rank) AS part FROM {r}" for r in runs)
    return f"""
fu AS (SELECT query_id, doc_id, round(sum(CAST(part AS DOUBLE)), 9) AS rrf_score FROM ({union}) GROUP BY ALL),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM fu)"""
