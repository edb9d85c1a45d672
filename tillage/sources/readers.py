"""Sources: plain and markdown texts, office documents, dictionaries, JSON lines, delimited texts, sheets, soil profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.chunking import pack
from tillage.functions.text import paragraphs, squeeze
from tillage.operators.dashboard import GUIDE
from tillage.operators.relational import zero_as_null

GOLD = "query string, gold_ids array<string>, query_entities array<string>"
PREDICTION = "query string, pred_ids array<string>, pred_entities array<array<string>>, faithfulness double"
#: The depth layers in centimetres, and the order in which a layer's statistics are preferred.
SOIL_LAYERS = [(0, 5), (5, 15), (15, 30), (30, 60), (60, 100), (100, 200)]
SOIL_STATISTICS = ("Q0.5", "M", "mean")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_id, bytes, length): files with their SHA-256 as id."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.sha2("content", 256).alias("doc_id"), F.col("content").alias("bytes"), "length")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, with or without a byte order mark, else Latin-1."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(F.regexp_replace(utf8, "^﻿", ""), F.decode(content, "ISO-8859-1"))


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, text): pages end at a form feed or a line of three or more dashes; pages count from 1.

    A markdown file without such marks ends a page before every heading of the first level that is not the
    first thing on its page; any other file without marks has pages of up to 500 words in whole paragraphs.
    """
    t = files(spark, path).select(
        "doc_id", F.regexp_replace(decoded(F.col("bytes")), "\r\n?", "\n").alias("t"),
        F.lower("path").rlike(r"\.(md|markdown)$").alias("markdown")
    )
    mark = r"\f|(?m:^[ \t]*-{3,}[ \t]*$)"
    plain, marked = ~F.col("markdown"), F.col("t").rlike(mark)
    headed = F.regexp_replace(F.col("t"), r"(?<=\S)([ \t]*\n(?:[ \t]*\n)*)(?=#[ \t]+\S)", "\f")
    by_words = pack(F.when(plain & ~marked, paragraphs(F.col("t"))), 500, "\n\n", unit="words")
    parted = F.split(F.when(~marked & ~F.contains("t", F.lit("```")), headed).otherwise(F.col("t")), mark)
    pages = F.transform(F.coalesce(by_words, parted), lambda p: F.regexp_replace(p, r"^\n+|\n+$", ""))
    return t.select("doc_id", F.posexplode(pages).alias("p", "text")).where(F.trim("text") != "").select("doc_id", (F.col("p") + 1).alias("page"), "text")


def needs_ocr(text: Column, least: int = 40) -> Column:
    """Whether a page's own text has fewer characters than that, blanks aside, so that its image must be read."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) < least


def text_coverage(text: Column) -> Column:
    """Share of a page's characters that are no blanks; 0 without any."""
    all_of = F.length(F.coalesce(text, F.lit("")))
    return F.when(all_of > 0, F.length(F.regexp_replace(text, r"\s", "")) / all_of).otherwise(0.0)


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, name, cells, total) of a workbook whose sheets are CSV files in one folder.

    Every sheet's first column names its rows, and rows without a name are left out; the other cells are in a
    map, and total adds up those that are numbers. 0 counts as missing, as at the origin.
    """
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.csv").select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1).alias("sheet"), delimited(F.col("value")).alias("rows")
    )
    rows = raw.select("sheet", F.get("rows", 0).alias("head"), F.explode(F.slice("rows", 2, F.size("rows"))).alias("cells"))
    named = rows.select(
        "sheet", F.get("cells", 0).alias("name"),
        F.map_from_arrays(F.slice("head", 2, F.size("head")), F.transform(F.sequence(F.lit(1), F.size("head") - 1), lambda i: F.get("cells", i))).alias("cells")
    ).where("name <> ''")
    numbers = F.filter(F.transform(F.map_values("cells"), lambda v: zero_as_null(v.try_cast("double"))), lambda v: v.isNotNull())
    return named.withColumn("total", F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x))


def word_documents(spark: SparkSession, path: str, words_to_page: int = 500) -> DataFrame:
    """(doc_id, n, page, kind, text) of .docx files: headings, lists, paragraphs and table rows in body order.

    A page ends at an explicit break or after `words_to_page` words.
    """

    def read(content: bytes):
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
        page, words, n = 1, 0, 0
        for e in body if body is not None else ():
            if e.tag == f"{w}p":
                style = e.find(f"{w}pPr/{w}pStyle")
                name = "" if style is None else style.get(f"{w}val", "")
                kind = "heading" if re.match(r"(?i)heading|t[ií]tulo|title", name) else "list" if e.find(f"{w}pPr/{w}numPr") is not None else "paragraph"
                rows = [(kind, "".join(t.text or "" for t in e.iter(f"{w}t")))]
                broken = any(b.get(f"{w}type") == "page" for b in e.iter(f"{w}br"))
            elif e.tag == f"{w}tbl":
                rows = [("table", " | ".join("".join(t.text or "" for t in c.iter(f"{w}t")) for c in r.iter(f"{w}tc"))) for r in e.iter(f"{w}tr")]
                broken = False
            else:
                continue
            for kind, text in rows:
                if text.strip():
                    yield n, page, kind, text.strip()
                    n, words = n + 1, words + len(text.split())
            if broken or words >= words_to_page:
                page, words = page + 1, 0

    def run(it):
        import pyarrow as pa

        for b in it:
            out = [(i, *row) for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for row in read(c)]
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n", "page", "kind", "text"])

    return files(spark, path).select("doc_id", "bytes").mapInArrow(run, "doc_id string, n int, page int, kind string, text string")


def name_list(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(type, value) of a CSV with column `name`: normalised, each value once."""
    names = spark.read.option("header", "true").csv(path)
    return names.select(F.lit(kind).alias("type"), squeeze(F.col("name")).alias("value")).where("value <> ''").dropDuplicates()


def synonym_map(spark: SparkSession, path: str) -> DataFrame:
    """(synonym, canonical) of a JSON object of texts; both sides normalised, other values left out."""
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    return pairs.select(squeeze(F.col("k")).alias("synonym"), squeeze(F.col("v")).alias("canonical")).where("synonym <> '' and canonical <> ''")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def delimited(text: Column) -> Column:
    """Rows of trimmed cells of a delimited text: the delimiter is the most frequent of comma, semicolon and tab in
    its first line. A cell in double quotes may hold delimiters; doubled quotes inside are one."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")
    head = F.coalesce(F.get(lines, 0), F.lit(""))
    n = {d: F.regexp_count(head, F.lit(p)) for d, p in ((",", ","), (";", ";"), ("\t", "\t"))}
    best = F.when((n[";"] > n[","]) & (n[";"] >= n["\t"]), ";").when((n["\t"] > n[","]) & (n["\t"] > n[";"]), "\t").otherwise(",")

    def cells(line: Column, mark: str) -> Column:
        # an empty match at the end of a line that does not end in the delimiter is no cell
        found = F.regexp_extract_all(F.concat(line, F.lit(mark)), F.lit(rf'\s*("(?:[^"]|"")*"|[^{mark}]*?)\s*{mark}'), F.lit(1))
        return F.transform(
            found,
            lambda c: F.when(
                c.startswith('"') & c.endswith('"') & (F.length(c) > 1),
                F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
            ).otherwise(F.trim(c))
        )

    return F.transform(lines, lambda x: F.when(best == ";", cells(x, ";")).when(best == "\t", cells(x, "\t")).otherwise(cells(x, ",")))


def sheet(rows: DataFrame, numbers: list[str], quirk: bool = True) -> DataFrame:
    """A sheet's rows with typed numbers; with quirk a 0 is missing, as at the origin."""
    typed = {c: F.col(c).try_cast("double") for c in numbers}
    return rows.withColumns({c: zero_as_null(v) if quirk else v for c, v in typed.items()})


def soil_profile(response: Column) -> Column:
    """array<struct<name, top, bottom, value>> of a soil service's JSON: only known layers, the preferred statistic."""
    layer = "array<struct<name: string, depths: array<struct<range: struct<top_depth: int, bottom_depth: int>, values: map<string, double>>>>>"
    parsed = F.from_json(response, f"properties struct<layers: {layer}>")["properties"]["layers"]
    known = lambda d: F.array_contains(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SOIL_LAYERS]),
        F.struct(d["range"]["top_depth"].alias("a"), d["range"]["bottom_depth"].alias("b"))
    )
    value = lambda d: F.coalesce(*[F.try_element_at(d["values"], F.lit(s)) for s in SOIL_STATISTICS])
    rows = F.transform(
        parsed,
        lambda x: F.transform(
            F.filter(x["depths"], known),
            lambda d: F.struct(
                x["name"].alias("name"), d["range"]["top_depth"].alias("top"), d["range"]["bottom_depth"].alias("bottom"),
                value(d).alias("value")
            )
        )
    )
    return F.coalesce(F.flatten(rows), F.array().cast("array<struct<name: string, top: int, bottom: int, value: double>>"))


def soil_rows(responses: DataFrame, response: str = "response") -> DataFrame:
    """responses with `rows` (soil_profile) and `_error`: what is wrong with a response that is no soil profile."""
    parsed = F.from_json(F.col(response), "properties map<string,string>")
    error = F.when(F.trim(F.coalesce(F.col(response), F.lit(""))) == "", "empty response").when(
        parsed.isNull() | parsed["properties"].isNull(), "no properties in response"
    ).when(parsed["properties"]["layers"].isNull(), "no layers in response")
    return responses.withColumn("rows", soil_profile(F.col(response))).withColumn("_error", error)


def monitoring_weeks(spark: SparkSession, crops: int = 3, weeks: int = 24) -> DataFrame:
    """A deterministic data set of weekly readings from modular arithmetic on the week and the crop's place."""
    seed = F.col("week") + F.col("crop") * 3
    one = lambda c: F.round(c, 1).cast("double")
    base = spark.range(crops * weeks).select(F.expr(f"id div {weeks}").cast("int").alias("crop"), (F.col("id") % weeks).cast("int").alias("week"))
    return base.select(
        "crop", "week", one(44 + (seed % 8) * 3).alias("soil_moisture"), one(19 + (seed % 9) * 1.7).alias("air_temp"), one(42 + (seed % 10) * 3.1).alias("air_humidity"), one(58 + (seed % 9) * 3.2).alias("light"),
        F.when(seed % 5 == 0, 6.8).otherwise(0.0).alias("precipitation"), one(5.5 + (seed % 6) * 0.8).alias("wind_speed"),
    )


def global_weeks(spark: SparkSession, weeks: int = 24) -> DataFrame:
    """The location's weekly readings that go with monitoring_weeks."""
    w = F.col("week")
    at = lambda c, n=1: F.round(c, n).cast("double")
    return spark.range(weeks).select(F.col("id").cast("int").alias("week")).select(
        "week", at(18 + (w % 8) * 1.1).alias("soil_temp"), at(20 + (w % 10) * 1.4).alias("air_temp"), at(45 + (w % 9) * 2.8).alias("air_humidity"), at(40 + (w % 10) * 2.9).alias("soil_moisture"),
        F.when(w % 4 == 0, 8.2).otherwise(0.0).alias("precipitation"), at(6 + (w % 6) * 0.7).alias("wind_speed"), at(6.2 + (w % 5) * 0.1, 2).alias("ph"), at(0.9 + (w % 4) * 0.15, 2).alias("conductivity"),
    )


def guideline(spark: SparkSession) -> DataFrame:
    """The guideline's thresholds as one row of structs."""
    return spark.range(1).select(*[F.struct(*[F.lit(v).alias(name) for name, v in bounds.items()]).alias(k) for k, bounds in GUIDE.items()])


#: Schemas of the domain tables, for readers that must not infer.
SCHEMAS = {
    "fragments": "fragment_id string, doc_id string, section_id string, page_start int, page_end int, text string, source string, created_at timestamp, entities array<struct<type: string, value: string>>, seq int, bbox array<double>, char_count int",
    "sensor_readings": "id long, user_crop_id long, soil_moisture double, air_temp double, air_humidity double, light double, precipitation double, wind_speed double, created_at timestamp",
    "crop_profiles": "crop_name string, variety string, optimal_temp_min double, optimal_temp_max double, optimal_soil_moisture_min double, optimal_soil_moisture_max double, optimal_air_humidity_min double, optimal_air_humidity_max double, optimal_ph_min double, optimal_ph_max double, cycle_days int",
    "calendar_rules": "crop_name string, event_type string, day_offset int, title_template string, description_template string, trigger_condition string, rationale string, source_doc_hint string, priority int",
}
