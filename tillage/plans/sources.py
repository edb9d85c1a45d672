"""Queries over sources: generated files and values go through the readers, sinks and layout rules."""

from __future__ import annotations

import io
import json
import zipfile
import zlib

from pyspark.sql import functions as F

from tillage.functions import text as T
from tillage.operators import lexical
from tillage.plans import sqlparts as S
from tillage.plans.catalogue import REGISTRY
from tillage.session import put, scratch, table
from tillage.sources import layout, pdf, sinks
from tillage.sources import readers as X

add = REGISTRY.add
TEXT = "coalesce(text, '')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")


def _folder(spark, files: dict[str, bytes]) -> str:
    at = scratch(spark)
    for name, content in files.items():
        put(spark, f"{at}/{name}", content)
    return at


@add(
    "dataset_generator",
    """WITH g AS (SELECT CAST(id // 24 AS INT) AS crop, CAST(id % 24 AS INT) AS week FROM range(72) t(id)), s AS (SELECT *, week + crop * 3 AS seed FROM g)
SELECT crop, week, CAST(44 + (seed % 8) * 3 AS DOUBLE) AS soil_moisture, CAST(round(19 + (seed % 9) * 1.7, 1) AS DOUBLE) AS air_temp, CAST(round(42 + (seed % 10) * 3.1, 1) AS DOUBLE) AS air_humidity,
CAST(round(58 + (seed % 9) * 3.2, 1) AS DOUBLE) AS light, CASE WHEN seed % 5 = 0 THEN 6.8 ELSE 0.0 END::DOUBLE AS precipitation, CAST(round(5.5 + (seed % 6) * 0.8, 1) AS DOUBLE) AS wind_speed FROM s""",
)
def dataset_generator(spark, sf_dir):
    return X.monitoring_weeks(spark)


@add(
    "global_generator",
    """SELECT CAST(w AS INT) AS week, CAST(round(18 + (w % 8) * 1.1, 1) AS DOUBLE) AS soil_temp, CAST(round(20 + (w % 10) * 1.4, 1) AS DOUBLE) AS air_temp, CAST(round(6.2 + (w % 5) * 0.1, 2) AS DOUBLE) AS ph,
CAST(round(0.9 + (w % 4) * 0.15, 2) AS DOUBLE) AS conductivity, CASE WHEN w % 4 = 0 THEN 8.2 ELSE 0.0 END::DOUBLE AS precipitation FROM range(24) t(w)""",
)
def global_generator(spark, sf_dir):
    return X.global_weeks(spark).select("week", "soil_temp", "air_temp", "ph", "conductivity", "precipitation")


#: Lines that end every text: cells with blanks, empty cells, a quoted cell with a delimiter and doubled quotes.
_ROWS = ' a ;b;"c;d"\n1;; "e ""f"" g" \n'


@add(
    "delimited_rows",
    """WITH d AS (SELECT doc_id FROM documents) SELECT doc_id, 'a|b|c;d' AS head, '1||e "f" g' AS last, CAST(2 AS BIGINT) AS n_rows, CAST('x' || doc_id || '|y' AS VARCHAR) AS by_comma FROM d""",
)
def delimited_rows(spark, sf_dir):
    """The delimiter is found in the first line; quoted cells may hold it."""
    rows = X.delimited(F.lit(_ROWS))
    comma = X.delimited(F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit(" , y\n")))
    line = lambda r, i: F.array_join(F.get(r, i), "|")
    return _docs(spark, sf_dir).select(
        "doc_id", line(rows, 0).alias("head"), line(rows, 1).alias("last"), F.size(rows).cast("long").alias("n_rows"),
        line(comma, 0).alias("by_comma")
    )


@add("sheet_zero_as_null", "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem")
def sheet_zero_as_null(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_discount").cast("string").alias("l_discount"), F.col("l_tax").cast("string").alias("l_tax")
    )
    return X.sheet(li, ["l_discount", "l_tax"])


_SHEETS = {
    "cultivos": "nombre,variedad,progreso\nMaiz,Criollo,45\n,sin nombre,1\nFrijol,,0\n",
    "sensores": "cultivo,humedad,temp\nMaiz,44,19.5\nFrijol,0,x\n",
    "nutrientes": "cultivo,n,p\nMaiz,1.5,0\n",
    "riego": "cultivo,litros\nMaiz,40\n",
    "global": "lugar,ph\ngeneral,6.2\n",
}


@add(
    "workbook",
    "SELECT * FROM (VALUES ('cultivos', 2, 45.0::DOUBLE), ('sensores', 2, 63.5), ('nutrientes', 1, 1.5), ('riego', 1, 40.0), ('global', 1, 6.2)) t(sheet, n, total)"
)
def workbook(spark, sf_dir):
    """Five sheets, one file each: rows without a name are left out, numbers that are 0 or no numbers are missing."""
    at = _folder(spark, {f"{name}.csv": body.encode() for name, body in _SHEETS.items()})
    return X.workbook(spark, at).groupBy("sheet").agg(F.count("*").cast("int").alias("n"), F.sum("total").alias("total"))


_TEXTS = {
    "a.txt": "uno\fdos\n---\ntres".encode("utf-8-sig"), "b.txt": "ca\xf1a\r\nverde".encode("latin-1"), "c.md": b"# Uno\nx\n\n# Dos\ny\n## Otro\nz", "d.md": b"```\n# no\n```\n# si",
}


@add(
    "text_pages",
    r"SELECT * FROM (VALUES (1, 'uno'), (2, 'dos'), (3, 'tres'), (1, 'caña' || chr(10) || 'verde'), (1, '# Uno' || chr(10) || 'x'), (2, '# Dos' || chr(10) || 'y' || chr(10) || '## Otro' || chr(10) || 'z'), (1, '```' || chr(10) || '# no' || chr(10) || '```' || chr(10) || '# si')) t(page, text)"
)
def text_pages(spark, sf_dir):
    """Texts in three encodings, parted by marks or by headings."""
    return X.text_pages(spark, _folder(spark, _TEXTS)).select("page", "text")


def _word_file() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def p(text, style="", extra=""):
        named = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{named}<w:r>{extra}<w:t>{text}</w:t></w:r></w:p>"

    cells = "".join(f"<w:tc>{p(c)}</w:tc>" for c in ("a", "b"))
    body = p("Título", "Heading1") + p("Texto") + p("", extra='<w:br w:type="page"/>') + f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>" + p("palabra " * 500) + p("fin")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@add(
    "word_documents",
    "SELECT * FROM (VALUES (0, 1, 'heading', 6), (1, 1, 'paragraph', 5), (2, 2, 'table', 5), (3, 2, 'paragraph', 3999), (4, 3, 'paragraph', 3)) t(n, page, kind, n_chars)"
)
def word_documents(spark, sf_dir):
    found = X.word_documents(spark, _folder(spark, {"a.docx": _word_file()}))
    return found.select("n", "page", "kind", F.length("text").alias("n_chars"))


def _pdf_file() -> bytes:
    """Two pages: a packed one whose font has a map to Unicode, and a thin one in plain bytes, whose page comes second
    in the tree though its object comes first."""
    show = b"BT /F1 12 Tf 72 700 Td [(Ma) -20 (\\(z) -400 (y)] TJ 0 -14 Td <0102> Tj T* (fin de la p\\341gina, con bastante texto y palabras) ' ET"
    cmap = b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfchar <01> <00F1> <02> <006F> endbfchar 1 beginbfrange <20> <e1> <0020> endbfrange"
    bodies = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [5 0 R 3 0 R] /Count 2 /Resources << /Font << /F1 7 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        4: b"<< /Length 30 >>\nstream\nBT (thin \\251) Tj ET\nendstream",
        5: b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>",
        6: b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(show) + b"\nendstream",
        7: b"<< /Type /Font /Subtype /Type1 /ToUnicode 8 0 R >>",
        8: b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(cmap) + b"\nendstream",
    }
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in bodies.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


@add(
    "pdf_pages",
    "SELECT * FROM (VALUES (1, 'Ma(z y' || chr(10) || 'ño' || chr(10) || 'fin de la página, con bastante texto y palabras', false), (2, 'thin ©', true)) t(page, text, by_ocr)"
)
def pdf_pages(spark, sf_dir):
    """The text layer of a PDF's pages, and which pages need their image read."""
    return pdf.pdf_pages(spark, _folder(spark, {"a.pdf": _pdf_file(), "b.pdf": b"no pdf"})).select("page", "text", "by_ocr")


@add("taxonomy_files", "SELECT * FROM (VALUES ('CULTIVO', 'chile verde'), ('CULTIVO', 'maiz'), ('sinonimo', 'elote=maiz')) t(kind, value)")
def taxonomy_files(spark, sf_dir):
    """A list of names and a map of synonyms, both normalised, each value once, what is empty left out."""
    at = _folder(spark, {"n.csv": "name\nMaíz\nmaiz\n Chile  Verde\n".encode(), "s.json": json.dumps({"Elote": "Maíz", "x": ""}).encode()})
    names = X.name_list(spark, f"{at}/n.csv", "CULTIVO").select(F.col("type").alias("kind"), "value")
    pairs = X.synonym_map(spark, f"{at}/s.json").select(F.lit("sinonimo").alias("kind"), F.concat_ws("=", "synonym", "canonical").alias("value"))
    return names.unionByName(pairs)


@add("json_lines", "SELECT * FROM (VALUES ('a', 1), ('b', 0)) t(query, n)")
def json_lines(spark, sf_dir):
    at = _folder(spark, {"g.jsonl": b'{"query": "a", "gold_ids": ["x"]}\n\n  \n{"query": "b", "gold_ids": []}\n'})
    return X.json_lines(spark, f"{at}/g.jsonl", X.GOLD).select("query", F.size("gold_ids").alias("n"))


def _soil(mean: str) -> str:
    return '{"properties": {"layers": [{"name": "clay", "depths": [{"range": {"top_depth": 0, "bottom_depth": 5}, "values": {"mean": ' + mean + ', "Q0.5": null}}, {"range": {"top_depth": 1, "bottom_depth": 9}, "values": {"mean": 1.0}}]}]}}'


@add(
    "soil_service",
    """SELECT part, CASE part % 4 WHEN 0 THEN 1 ELSE 0 END AS n, CASE WHEN part % 4 = 0 THEN part * 1.0 END::DOUBLE AS value,
CASE part % 4 WHEN 1 THEN 'empty response' WHEN 2 THEN 'no properties in response' WHEN 3 THEN 'no layers in response' END AS _error FROM (SELECT p_partkey AS part FROM part)""",
)
def soil_service(spark, sf_dir):
    """Responses of a soil service, three in four of them of no use, which a column says."""
    k = F.col("p_partkey")
    head, tail = _soil("@").split("@")
    response = F.when(
        k % 4 == 0, F.concat(F.lit(head), k.cast("string"), F.lit(tail))
    ).when(k % 4 == 1, " ").when(k % 4 == 2, '{"detail": "down"}').otherwise('{"properties": {}}')
    rows = X.soil_rows(table(spark, sf_dir, "part").select(k.alias("part"), response.alias("response")))
    return rows.select("part", F.size("rows").alias("n"), F.get("rows", 0)["value"].alias("value"), "_error")


@add(
    "stored_files",
    f"SELECT doc_id, sha256({TEXT}) AS file_id, '1717200000__' || regexp_replace(source || ' ñ.txt', '[^A-Za-z0-9._-]+', '_', 'g') AS stored_name FROM documents",
)
def stored_files(spark, sf_dir):
    """Files go by the hash of what they hold, under a time and a safe name."""
    return _docs(spark, sf_dir).select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_id"),
        sinks.stored_name(F.lit(1717200000), F.concat("source", F.lit(" ñ.txt"))).alias("stored_name")
    )


@add(
    "fragment_sink",
    f"""WITH f AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq, length({TEXT}) AS char_count FROM documents)
SELECT source, count(*) AS n, count(DISTINCT seq) AS seqs, CAST(sum(char_count) AS BIGINT) AS chars, CAST(count(*) AS BIGINT) AS ids FROM f GROUP BY source""",
)
def fragment_sink(spark, sf_dir):
    """Fragments written by document and read back: ids, sequence numbers and lengths are the sink's."""
    at = f"{scratch(spark)}/fragments"
    rows = _docs(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    sinks.write_fragments(sinks.numbered(rows, "doc_id", ["page"]), at)
    back = spark.read.parquet(at)
    return back.groupBy(F.col("doc_id").alias("source")).agg(
        F.count("*").alias("n"), F.count_distinct("seq").alias("seqs"), F.sum("char_count").cast("long").alias("chars"),
        F.count_distinct("fragment_id").alias("ids")
    )


@add(
    "index_sink",
    f"""WITH d AS (SELECT doc_id, {S.tokens('text')} AS toks FROM documents WHERE {S.strip(TEXT)} <> ''), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY ALL)
SELECT count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens, (SELECT count(*) FROM d) AS documents, (SELECT max(toks) FROM (SELECT len(toks) AS toks FROM d)) AS longest FROM p""",
)
def index_sink(spark, sf_dir):
    """The lexical index rebuilt in order without empty texts, written and read back."""
    at = f"{scratch(spark)}/index"
    sinks.write_index(lexical.indexable(_docs(spark, sf_dir), "text", ["doc_id"]), at)
    postings, lengths = spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/lengths")
    a = postings.agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))
    return a.crossJoin(F.broadcast(lengths.agg(F.count("*").alias("documents"), F.max("dl").alias("longest"))))  # one row each


@add(
    "reindex",
    f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'nuevo texto nuevo' ELSE {TEXT} END AS text FROM documents WHERE doc_id % 5 <> 1 OR doc_id % 3 = 0)
SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({S.tokens('text')}) AS term FROM d) GROUP BY term""",
)
def reindex(spark, sf_dir):
    """Some documents leave the index, others come back with a new text."""
    docs = _docs(spark, sf_dir)
    index = lexical.postings(docs, "doc_id", "text")
    fresh = lexical.postings(docs.where("doc_id % 3 = 0").withColumn("text", F.lit("nuevo texto nuevo")), "doc_id", "text")
    kept = lexical.without(index, docs.where("doc_id % 5 = 1"), "doc_id")
    return lexical.document_frequency(lexical.replaced(kept, fresh, "doc_id"), "doc_id")


@add(
    "vector_sink",
    """WITH b AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 4 <> 0 UNION ALL SELECT vec_id, 100 + label FROM embeddings WHERE vec_id % 4 = 0 UNION ALL SELECT vec_id + 1000000000, label FROM embeddings WHERE vec_id % 10 = 0)
SELECT vec_id, label FROM b WHERE vec_id % 7 <> 2""",
)
def vector_sink(spark, sf_dir):
    """Vectors added, replaced and deleted in a stored collection."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    at = scratch(spark)
    first, second = f"{at}/1", f"{at}/2"
    e.write.parquet(first)
    fresh = e.where("vec_id % 4 = 0").withColumn("label", F.col("label") + 100).unionByName(e.where("vec_id % 10 = 0").withColumn("vec_id", F.col("vec_id") + 1000000000))
    sinks.upsert_vectors(spark, first, fresh, second)
    return lexical.without(
        spark.read.parquet(second), e.unionByName(fresh).where("vec_id % 7 = 2"), "vec_id"
    ).select("vec_id", F.col("label").cast("long").alias("label"))


#: Blocks of pages: lines of orders dealt to two or three columns, every fifth across the page.
_BLOCKS = """b AS (SELECT l_orderkey AS page, l_linenumber AS i, l_orderkey % 3 AS kind FROM lineitem),
k AS (SELECT page, i, CASE WHEN i % 5 = 3 THEN 20.0 WHEN kind = 0 THEN 30.0 WHEN kind = 1 THEN 30.0 + 250 * (i % 2) ELSE 20.0 + 160 * (i % 3) END AS x0, 40.0 * (i // 2) + 3 * (page % 4) * (i % 2) AS y0,
      CASE WHEN i % 5 = 3 THEN 480.0 WHEN kind = 0 THEN 300.0 WHEN kind = 1 THEN 250.0 + 240 * (i % 2) ELSE 160.0 + 165 * (i % 3) END AS x1 FROM b)"""


def _blocks(spark, sf_dir):
    i, page = F.col("l_linenumber"), F.col("l_orderkey")
    across, kind = i % 5 == 3, page % 3
    x0 = F.when(across, 20.0).when(kind == 0, 30.0).when(kind == 1, 30.0 + 250 * (i % 2)).otherwise(20.0 + 160 * (i % 3))
    x1 = F.when(across, 480.0).when(kind == 0, 300.0).when(kind == 1, 250.0 + 240 * (i % 2)).otherwise(160.0 + 165 * (i % 3))
    y0 = 40.0 * F.floor(i / 2) + 3 * (page % 4) * (i % 2)
    return table(spark, sf_dir, "lineitem").select(
        page.alias("page"), i.alias("i"), x0.alias("x0"), y0.cast("double").alias("y0"), x1.alias("x1"),
        (y0 + 10).cast("double").alias("y1")
    )


_CUTS = """c AS (SELECT page, list_sort(list((x0 + x1) / 2)) AS c, stddev_samp((x0 + x1) / 2) AS sp FROM k GROUP BY page),
g AS (SELECT page, c, sp, list_sort(list_transform(range(1, len(c)), lambda i: {'less': c[i] - c[i + 1], 'at': (c[i] + c[i + 1]) / 2})) AS g FROM c),
u AS (SELECT page, CASE WHEN len(c) >= 6 AND sp >= 50 AND -g[2].less >= 40 THEN list_sort([g[1].at, g[2].at]) WHEN len(c) >= 4 AND sp >= 50 AND -g[1].less >= 40 THEN [g[1].at] ELSE [] END AS cuts FROM g)"""


@add("column_cuts", f"WITH {_BLOCKS}, {_CUTS} SELECT page, CAST(len(cuts) AS INT) AS n, round(coalesce(list_sum(cuts), 0), 6) AS places FROM u")
def column_cuts(spark, sf_dir):
    """Where pages of 500 points part into columns."""
    cuts = layout.column_cuts(_blocks(spark, sf_dir), 500.0)
    return cuts.select("page", F.size("cuts").alias("n"), F.round(F.aggregate("cuts", F.lit(0.0), lambda a, x: a + x), 6).alias("places"))


@add(
    "reading_order",
    f"""WITH {_BLOCKS}, {_CUTS}, w AS (SELECT k.*, cuts, x1 - x0 >= 390 AND len(cuts) > 0 AS wide, len(list_filter(cuts, lambda c: (x0 + x1) / 2 >= c)) AS col FROM k JOIN u USING (page)),
s AS (SELECT page, len(any_value(cuts)) = 0 OR count(DISTINCT CASE WHEN NOT wide THEN col END) <= len(any_value(cuts)) AS single FROM w GROUP BY page),
o AS (SELECT w.*, single, (SELECT count(*) FROM w v WHERE v.page = w.page AND v.wide AND v.y0 <= w.y0) AS above, (SELECT count(*) FROM w v WHERE v.page = w.page AND v.wide AND (v.y0, v.x0, v.i) <= (w.y0, w.x0, w.i)) AS nth FROM w JOIN s USING (page))
SELECT page, i, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN single THEN 0 WHEN wide THEN 2 * nth - 1 ELSE 2 * above END, CASE WHEN single OR wide THEN 0 ELSE col END, y0, x0, i) AS place FROM o""",
)
def reading_order(spark, sf_dir):
    return layout.reading_order(_blocks(spark, sf_dir), 500.0, tie="i").select("page", "i", F.col("place").cast("long").alias("place"))


@add("union_boxes", f"WITH {_BLOCKS} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y0) + 10 AS y1 FROM k GROUP BY page")
def union_boxes(spark, sf_dir):
    return layout.union_box(_blocks(spark, sf_dir), ["page"])


@add(
    "column_gaps",
    f"""WITH {_BLOCKS}, e AS (SELECT DISTINCT page, x0 FROM k), n AS (SELECT page, x0, lead(x0) OVER (PARTITION BY page ORDER BY x0) AS nx FROM e),
r AS (SELECT page, nx - x0 AS gap, (nx + x0) / 2 AS "at", row_number() OVER (PARTITION BY page ORDER BY nx - x0 DESC, (nx + x0) / 2) AS i FROM n WHERE nx - x0 > 40) SELECT page, gap, "at" FROM r WHERE i < 3""",
)
def column_gaps(spark, sf_dir):
    return layout.column_gaps(_blocks(spark, sf_dir), 3, 500.0)


@add(
    "table_texts",
    """WITH t AS (SELECT l_orderkey, count(*) AS n, string_agg(l_linestatus || CASE WHEN l_linenumber % 2 = 0 THEN ' | ' || l_returnflag ELSE '' END, chr(10) ORDER BY l_linenumber, l_linestatus, l_returnflag) AS body FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, '[Tabla lattice ' || n || 'x2]' || chr(10) || 'Tabla (encabezado): modo | marca' || chr(10) || body AS text FROM t""",
)
def table_texts(spark, sf_dir):
    """Tables of cells as lines to be searched."""
    row = F.struct("l_linenumber", F.array(F.concat(F.lit(" "), "l_linestatus"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag"))).alias("cells"))
    tables = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"]).alias("rows"))
    return tables.select("l_orderkey", T.table_text(F.col("rows"), "lattice", F.array(F.lit("modo"), F.lit("marca "))).alias("text"))


@add(
    "ocr_codes",
    "SELECT doc_id, CASE lang WHEN 'es' THEN 'spa' WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' ELSE 'spa+eng' END AS code, lang IN ('es', 'en') AS ready FROM documents"
)
def ocr_codes(spark, sf_dir):
    """Languages as codes of the recogniser, of those that are installed."""
    code = T.ocr_language(F.col("lang"), ("spa", "eng", "fra"))
    return _docs(spark, sf_dir).select("doc_id", code.alias("code"), code.isin("spa", "eng").alias("ready"))


@add(
    "ocr_decision",
    rf"""WITH p AS (SELECT doc_id, length(regexp_replace({TEXT}, '\s', '', 'g')) AS n, length({TEXT}) AS c FROM documents)
SELECT doc_id, n < 40 AS by_ocr, CAST(round(CASE WHEN c > 0 THEN n / c ELSE 0 END, 4) AS DOUBLE) AS coverage FROM p""",
)
def ocr_decision(spark, sf_dir):
    """Pages with too few characters go to the recogniser; the share of characters that are no blanks."""
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", X.needs_ocr(t).alias("by_ocr"), F.round(X.text_coverage(t), 4).alias("coverage"))
