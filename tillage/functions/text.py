"""Text functions as Column expressions: folding, tokens, sentences, patterns, formatting."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their plain forms, place by place: the Latin letters that Unicode decomposes into an
# ASCII letter and marks, and those below that it does not decompose.
# Letters that become one or two plain ones.
_OWN = {"ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ð": "d", "Ð": "d", "ł": "l", "Ł": "l", "ħ": "h", "Ħ": "h", "ı": "i", "Æ": "æ", "Œ": "œ", "Þ": "þ", "ẞ": "ß"}
PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}


def _plain_letters() -> dict[str, str]:
    found = dict(_OWN)
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii():
            found[c] = base.lower()
    return found


_LETTERS = _plain_letters()
MARKED, PLAIN = "".join(_LETTERS), "".join(_LETTERS.values())
#: Words without weight in a query (ranking), and in answers (synthesis).
RANK_STOPWORDS = "de el la los las un una es en del al por para que qué cuál cuáles cómo a y o u e".split()
ANSWER_STOPWORDS = (
    "de la el las los un una unos unas y o u e en del al por para que qué como cómo cuándo cuando cuál cual cuáles cuales es son ser "
    "estar esta este esto se su sus lo le les mi tu con sin sobre ya más mas menos muy porque pero"
).split()
#: Markers that speak for a language when they occur.
LANGUAGE_MARKERS = {
    "es": [
        "el ", "la ", " de ", " los ", " las ", " y ", " una ", " para ", " con ", "ión", "ción", "ación", " del ", " al ", " es ", " en ",
        "se ", " que ", " no ", " por ", "ñ", "á", "é", "í", "ó", "ú"
    ],
    "en": [" the ", " and ", " of ", " to ", " in ", " is ", " that ", " for ", " with ", " as ", " on ", " by ", " be ", " this ", " an "],
    "pt": [" o ", " a ", " os ", " as ", " de ", " do ", " da ", " que ", " não ", "ção", "ões", "ã", "õ"],
    "fr": [" le ", " la ", " les ", " de ", " des ", " du ", " et ", " un ", " une ", " que ", "œ", "ç", "à", "é", "è", "ê"],
}
#: Language to OCR language code.
OCR_CODES = {"es": "spa", "en": "eng", "pt": "por", "fr": "fra", "it": "ita", "de": "deu", "ca": "cat", "gl": "glg"}
#: What is mended in extracted text, in order.
EXTRACTED = [
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""),
    (r"[\x{AD}\x{200B}-\x{200D}\x{FEFF}]", ""),
    (r"(?i)([a-záéíóúñ])-\n([a-záéíóúñ])", "$1$2"),
    (r"(?i)([a-z])-\s*\n\s*([a-z])", "$1$2"),
    (r"([A-Z0-9_]{3,})\n([A-Z0-9_]{3,})", "$1$2"),
    (r"[ \t\x{A0}]+", " "),
    (r"\n{3,}", "\n\n"),
]
#: What counts as an equation, and as a page's footer or number.
EQUATION = r"\$[^$]+\$|\\\[[\s\S]+?\\\]|\\\([\s\S]+?\\\)|[∑∏√≈≃≤≥±×÷]|[A-Za-z]\s*=\s*[^;\n]+"
FURNITURE = [r"(?i)^(?:page|pag|p[áa]g\.?|p\.?)\s*\d+\s*(?:/|\s*de\s*|\s*of\s*)?\s*\d*\s*$", r"^\d{1,4}$"]
#: Number and unit, other names of units, and unit to SI unit with factor and offset.
MAGNITUDE = r"([-+]?\d+(?:[.,]\d+)?)\s*([a-zA-Zµ°/%]+(?:[/.\-][a-zA-Z]+)*)"
UNIT_ALIASES = {"km/h": "kilometer / hour", "kmh": "kilometer / hour", "m/s": "meter / second", "kph": "kilometer / hour", "°c": "degC", "°f": "degF"}
SI_UNITS = [
    ("kilometer / hour", "m/s", 1 / 3.6, 0.0),
    ("meter / second", "m/s", 1.0, 0.0),
    ("degC", "K", 1.0, 273.15),
    ("degF", "K", 5 / 9, 459.67 * 5 / 9),
    ("km", "m", 1000.0, 0.0),
    ("m", "m", 1.0, 0.0),
    ("cm", "m", 0.01, 0.0),
    ("mm", "m", 0.001, 0.0),
    ("kg", "kg", 1.0, 0.0),
    ("g", "kg", 0.001, 0.0),
    ("mg", "kg", 1e-6, 0.0),
    ("l", "m³", 0.001, 0.0),
    ("ml", "m³", 1e-6, 0.0),
    ("ha", "m²", 10000.0, 0.0),
    ("h", "s", 3600.0, 0.0),
    ("min", "s", 60.0, 0.0),
    ("s", "s", 1.0, 0.0),
    ("%", "", 0.01, 0.0),
    ("kg/ha", "kg/m²", 0.0001, 0.0),
    ("l/ha", "m", 1e-7, 0.0),
    ("g/l", "kg/m³", 1.0, 0.0),
]
#: Unit spellings and their canonical form.
UNITS = [(r"(?i)\bkg\s*/\s*ha\b", "kg/ha"), (r"(?i)\bl\s*/\s*ha\b", "L/ha"), (r"(?i)\bg\s*/\s*l\b", "g/L"), (r"(?i)°\s*C\b", "°C"), (r"(?i)\bppm\b", "ppm")]


def fold(c: Column) -> Column:
    """Marks removed, composed or not, lower case, ligatures as two letters: the form in which words are compared."""
    plain = F.lower(F.translate(F.regexp_replace(c, r"\p{M}+", ""), MARKED, PLAIN))
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), PAIRS.items(), plain)


def composed(c: Column) -> Column:
    """Unicode normal form C. Spark has no function for it; only texts that hold a character whose composition
    is not certain travel to Python, all others as nulls."""

    @F.arrow_udf("string")
    def run(texts):
        import pyarrow as pa

        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    doubtful = c.rlike(r"[^\x{0}-\x{2FF}\x{2010}-\x{2027}]")
    return F.coalesce(run(F.when(doubtful, c)), c)


def once(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """fold with runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(fold(c), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Words of letters, digits and underscore, folded; null gives none."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def normalize_text(c: Column) -> Column:
    """Composed, control characters to blanks, blanks collapsed, at most one empty line, trimmed; null is empty."""
    t = F.regexp_replace(composed(F.coalesce(c, F.lit(""))), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    t = F.regexp_replace(t, r"[ \t\x{A0}]+", " ")
    return stripped(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def normalize_extracted(c: Column) -> Column:
    """Text from page layouts: composed, line ends unified, invisible characters out, words joined that a line end split."""
    t = F.replace(F.replace(composed(F.coalesce(c, F.lit(""))), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for pattern, by in EXTRACTED:
        t = F.regexp_replace(t, pattern, by)
    return stripped(t)


def chat_text(c: Column) -> Column:
    """Chat messages: folded, question and exclamation marks and unusual characters as blanks."""
    t = F.translate(fold(F.trim(F.coalesce(c, F.lit("")))), "¿?¡!", "    ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9%°\s\-_/.,]", " "), r"\s+", " "))


def compact_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def canonical_units(c: Column) -> Column:
    out = reduce(lambda t, u: F.regexp_replace(t, u[0], u[1]), UNITS, c)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def protect_equations(c: Column) -> tuple[Column, Column]:
    """The text with each equation replaced by a sentinel, and the map to restore it from."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(EQUATION), F.lit(0)))
    pairs = F.transform(found, lambda e: F.struct(F.concat(F.lit("⟦EQN_"), F.substring(F.sha1(e), 1, 10), F.lit("⟧")).alias("key"), e.alias("value")))
    longest = F.array_sort(pairs, lambda a, b: F.length(b["value"]) - F.length(a["value"]))
    return F.aggregate(longest, c, lambda t, p: F.replace(t, p["value"], p["key"])), F.map_from_entries(pairs)


def restore_equations(c: Column, kept: Column) -> Column:
    return F.aggregate(F.map_entries(kept), c, lambda t, e: F.replace(t, e["key"], e["value"]))


def sentences(c: Column, least: int = 6) -> Column:
    """Split after . ! ? and white space; pieces of at least so many characters, trimmed."""
    pieces = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))
    return F.filter(pieces, lambda s: F.length(s) >= least)


def sentences_before_capital(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ¿¡])")


def sentences_and_lines(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?:;])\s+|\n+"), lambda s: F.trim(s) != "")


def sentences_or_dashes(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+| - "), lambda s: F.trim(s)), lambda s: F.length(s) > 20)


def paragraphs(c: Column) -> Column:
    return F.filter(F.split(c, r"\n\s*\n+"), lambda s: F.trim(s) != "")


def keywords(c: Column, stop: list[str], least: int = 3) -> Column:
    """Letters-only words of at least so many characters outside the stop list; repeats stay."""
    words = F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*[x for x in stop]))


def contained(terms: Column, text: Column) -> Column:
    """How many of the terms occur in the text as substrings."""
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def strip_html(c: Column, lines: bool = False) -> Column:
    """Text without markup: list items with a dash, two entities decoded; white space as single blanks, or with
    lines the breaks of lines, items and paragraphs kept, at most one empty line."""
    rules = [(r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"(?i)<li[^>]*>", "- "), (r"(?i)</li>", "\n"), (r"<[^>]+>", "")]
    t = reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, c)
    t = F.replace(F.replace(t, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return stripped(F.regexp_replace(t, r"\n{3,}", "\n\n")) if lines else F.trim(F.regexp_replace(t, r"\s+", " "))


def neutral_links(c: Column) -> Column:
    return F.regexp_replace(c, r"""(?i)href=["']https?://[^"']+["']""", 'href="#"')


# Elements that may stay, attributes of links that may, and how addresses inside begin.
ALLOWED_TAGS = ("a", "em", "strong", "ul", "ol", "li", "p", "br", "code", "pre")
LINK_DATA = ("data-cite", "data-page", "data-bbox", "data-table", "data-row", "data-col")
INSIDE = r"^(?:/(?!/)|#|\?|\.{1,2}/)"


def allowed_html(c: Column, tags: tuple[str, ...] = ALLOWED_TAGS) -> Column:
    """Only the named elements stay, without attributes; links keep an address inside, `#` in place of any other,
    and what they cite. Scripts, styles and comments go with what they hold."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    pieces = F.regexp_extract_all(t, F.lit(r"""(?s)</?[a-zA-Z](?:"[^"]*"|'[^']*'|[^'">])*>|[^<]+|<"""), F.lit(0))
    value = lambda p, name: F.regexp_extract(p, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    single = lambda p, name: F.regexp_extract(p, rf"""(?is)\s{name}\s*=\s*'([^']*)'""", 1)
    given = lambda p, name: F.coalesce(F.nullif(value(p, name), F.lit("")), F.nullif(single(p, name), F.lit("")))

    def kept(p: Column) -> Column:
        name = F.lower(F.regexp_extract(p, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
        href = given(p, "href")
        link = F.concat(F.lit('<a href="'), F.when(href.rlike(INSIDE), href).otherwise("#"), F.lit('"'))
        for x in LINK_DATA:
            link = F.concat(link, F.coalesce(F.concat(F.lit(f' {x}="'), given(p, x), F.lit('"')), F.lit("")))
        opened = F.when(name == "a", F.concat(link, F.lit(">"))).when(name == "br", "<br />").otherwise(F.concat(F.lit("<"), name, F.lit(">")))
        tag = F.when(~name.isin(*tags), "").when(p.startswith("</"), F.concat(F.lit("</"), name, F.lit(">"))).otherwise(opened)
        return F.when(name != "", tag).when(p == "<", "&lt;").otherwise(p)

    return F.array_join(F.transform(pieces, kept), "")


def clip(c: Column, most: int = 240) -> Column:
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("…")))


def clip_at_word(c: Column, most: int = 900) -> Column:
    """At most `most` characters: a longer text ends before its last white space, with an ellipsis."""
    head = F.substring(c, 1, most)
    # not $: that also holds before a line end, so a word in front of one would go too
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(head, r"[ \t\n\f\r]+[^ \t\n\f\r]*\z", ""), F.lit("…")))


def fill_template(c: Column, values: dict[str, Column]) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1], F.lit(""))), values.items(), c)


def safe_name(c: Column) -> Column:
    """File names: anything but letters, digits, dot, dash and underscore becomes an underscore."""
    return F.regexp_replace(F.regexp_replace(c, r"^.*[\\/]", ""), r"[^A-Za-z0-9._-]+", "_")


def line_kind(c: Column) -> Column:
    """Kinds of markdown lines; fences are told apart from code by the caller's running parity."""
    return F.when(c.rlike(r"^#{1,6}\s+"), "heading").when(c.rlike(r"^\s*([-*+]|\d+[.)])\s+"), "list").when(c.rlike(r"^\s*```"), "fence").when(F.trim(c) == "", "blank").otherwise("paragraph")


def page_furniture(c: Column) -> Column:
    """Page footers and lone page numbers."""
    t = F.trim(c)
    return t.rlike(FURNITURE[0]) | t.rlike(FURNITURE[1])


def marker_counts(c: Column) -> dict[str, Column]:
    t = F.lower(c)
    return {lang: reduce(lambda a, b: a + b, [F.when(F.contains(t, F.lit(m)), 1).otherwise(0) for m in marks]) for lang, marks in LANGUAGE_MARKERS.items()}


def marker_language(c: Column, least: int = 4, shortest: int = 80) -> Column:
    """The language with most markers, if at least `least` and twice the runner-up; else null."""
    n = marker_counts(c)
    ranked = F.sort_array(F.array(*n.values()), asc=False)
    first, second = F.get(ranked, 0), F.get(ranked, 1)
    best = F.coalesce(*[F.when(v == first, lang) for lang, v in n.items()])
    return F.when((F.length(c) >= shortest) & (first >= least) & (first >= 2 * second), best)


def ocr_language(lang: Column, installed: tuple[str, ...] = tuple(OCR_CODES.values())) -> Column:
    """The recogniser's code of a language if it is installed; else Spanish and English, of those what is installed."""
    table = F.create_map(*[F.lit(x) for kv in OCR_CODES.items() if kv[1] in installed for x in kv]) if installed else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, lang), F.lit("+".join(c for c in ("spa", "eng") if c in installed) or "eng"))


def string_hash32(c: Column) -> Column:
    """The 31-multiplier hash in 32-bit arithmetic, absolute value."""
    codes = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("bigint"))
    wrap = lambda x: F.pmod(x + 2147483648, F.lit(4294967296)) - 2147483648
    return F.abs(F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, x: wrap(h * 31 + x)))


def table_text(rows: Column, kind: str, header: Column | None = None) -> Column:
    """Rows of cells as searchable lines under a title with the table's size; empty cells and rows are left out."""
    title = F.concat(
        F.lit(f"[Tabla {kind} "), F.size(rows).cast("string"), F.lit("x"),
        F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)).cast("string"), F.lit("]")
    )
    filled = lambda r: F.array_join(F.filter(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != ""), " | ")
    lines = F.filter(F.transform(rows, filled), lambda x: x != "")
    if header is not None:
        names = F.array_join(F.transform(header, lambda c: F.trim(c)), " | ")
        lines = F.concat(
            F.when(
                F.replace(F.replace(names, F.lit("|"), F.lit("")), F.lit(" "), F.lit("")) != "",
                F.array(F.concat(F.lit("Tabla (encabezado): "), names))
            ).otherwise(F.array().cast("array<string>")),
            lines
        )
    return F.array_join(F.concat(F.array(title), lines), "\n")


def table_signature(rows: Column, lines: int = 8, columns: int = 4, cells: int = 16) -> Column:
    """Key of a table of cells (array of arrays): its size and its first cells that hold something, squeezed."""
    shown = F.flatten(F.transform(F.slice(rows, 1, lines), lambda r: F.slice(r, 1, columns)))
    plain = F.transform(shown, lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    first = F.slice(F.filter(plain, lambda c: c != ""), 1, cells)
    width = F.coalesce(F.size(F.get(rows, 0)), F.lit(0))
    return F.sha1(F.concat(F.size(rows).cast("string"), F.lit("x"), width.cast("string"), F.lit("|"), F.array_join(first, "|")))


def synonyms_applied(text: Column, synonyms: dict[str, str]) -> Column:
    """Whole-word rewriting, longest first and ties by text; later rules see earlier output.

    A rule's pattern is looked for only in texts that contain its words, which is far cheaper to find out."""
    if not synonyms:
        return text
    ordered = sorted(synonyms.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    rules = F.array(*[F.struct(F.lit(k).alias("words"), F.lit(rf"\b{re.escape(k)}\b").alias("pattern"), F.lit(_literally(v)).alias("by")) for k, v in ordered])
    return F.aggregate(rules, text, lambda t, r: F.when(F.contains(t, r["words"]), F.regexp_replace(t, r["pattern"], r["by"])).otherwise(t))


def _literally(by: str) -> str:
    return by.replace("\\", "\\\\").replace("$", "\\$")


def magnitudes(c: Column) -> Column:
    """Numbers with a known unit, in order: array of struct(value, unit, value_si, unit_si); a comma is a decimal
    point, units compare in lower case, and what names no known unit is left out."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MAGNITUDE), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in UNIT_ALIASES.items() for x in kv])
    si = F.create_map(*[
        x for u, name, factor,
        offset in SI_UNITS for x in (F.lit(u), F.struct(F.lit(name).alias("unit"), F.lit(factor).alias("factor"), F.lit(offset).alias("offset")))
    ])

    def parts(m: Column) -> Column:
        value = F.replace(F.regexp_extract(m, MAGNITUDE, 1), F.lit(","), F.lit(".")).cast("double")
        unit = F.lower(F.regexp_extract(m, MAGNITUDE, 2))
        known = F.coalesce(F.try_element_at(names, unit), unit)
        to = F.try_element_at(si, known)
        return F.struct(value.alias("value"), known.alias("unit"), (value * to["factor"] + to["offset"]).alias("value_si"), to["unit"].alias("unit_si"))

    return F.filter(F.transform(found, parts), lambda m: m["unit_si"].isNotNull())


def without_rivals(detail: Column, target: Column, catalogue: list[str]) -> Column:
    """Lines that name another crop of the catalogue go, then its name wherever it is left as a word; if no line
    stays, all do. Without a target or a text nothing changes."""
    key = compact_name(F.trim(target))
    others = [(c, compact(c)) for c in catalogue if compact(c)]
    named = lambda x: reduce(lambda a, b: a | b, [(key != k) & F.contains(compact_name(x), F.lit(k)) for _, k in others], F.lit(False))
    left = stripped(F.array_join(F.filter(F.split(detail, "\r\n|[\n\r]"), lambda x: ~named(x)), "\n"))
    clean = F.when(left != "", left).otherwise(detail)
    for c, k in others:
        clean = F.when(key == k, clean).otherwise(F.regexp_replace(clean, rf"(?i)\b{re.escape(c)}\b", ""))
    return F.when((F.coalesce(detail, F.lit("")) == "") | (F.coalesce(key, F.lit("")) == ""), F.coalesce(detail, F.lit(""))).otherwise(clean)


def compact(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.strip().lower())


def blocked_names(target: Column, catalogue: list[str]) -> Column:
    """The catalogue without the target, compared as compact names."""
    names = [c for c in catalogue if compact(c)]
    return F.filter(F.array(*[F.lit(c) for c in names]), lambda c: compact_name(c) != compact_name(F.trim(F.coalesce(target, F.lit("")))))


def file_type(name: Column) -> Column:
    """What follows the last dot, in lower case; `desconocido` without any."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(F.trim(name), r"\.([^.]*)$", 1)), F.lit("")), F.lit("desconocido"))


def pdf_year(created: Column, modified: Column) -> Column:
    """The year of the first date `D:YYYY…` that lies in 1980 to 2100."""
    year = lambda c: F.regexp_extract(F.trim(c), r"^D:(\d{4})", 1).try_cast("int")
    valid = lambda c: F.when(year(c).between(1980, 2100), year(c))
    return F.coalesce(valid(created), valid(modified))


def merged_metadata(form: dict[str, Column], found: dict[str, Column], file_name: Column) -> Column:
    """struct(title, author, year): the form's values, else those found in a PDF, else the file's stem; generic
    author names count as none, and a file that is no PDF has nothing to be found in."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    is_pdf = F.lower(F.substring_index(F.coalesce(file_name, F.lit("")), ".", -1)) == "pdf"
    author = F.when(~F.lower(F.trim(found["author"])).isin("usuario", "user", "author"), given(found["author"]))
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(file_name, F.lit("doc")), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.struct(
        F.coalesce(given(form["title"]), F.when(is_pdf, given(found["title"])), given(stem), F.lit("documento")).alias("title"),
        F.coalesce(given(form["author"]), F.when(is_pdf, author)).alias("author"),
        F.coalesce(form["year"], F.when(is_pdf, found["year"])).alias("year"),
    )


@dataclass(frozen=True)
class Term:
    """A glossary entry; `keep`: the source term is not translated."""

    source: str
    target: str = ""
    keep: bool = False


def masked(text: Column, terms: list[Term]) -> Column:
    """Terms to be kept as placeholders numbered by their place in the glossary."""
    for i, t in enumerate(terms):
        if t.keep:
            text = F.regexp_replace(text, rf"(?i){re.escape(t.source)}", f"⟦DNT_{i}⟧")
    return text


def unmasked(text: Column, terms: list[Term]) -> Column:
    for i, t in enumerate(terms):
        if t.keep:
            text = F.replace(text, F.lit(f"⟦DNT_{i}⟧"), F.lit(t.source))
    return text


def glossary_applied(text: Column, terms: list[Term]) -> Column:
    """Source terms as whole words become target terms, one after the other."""
    for t in terms:
        if not t.keep:
            text = F.regexp_replace(text, rf"(?i)\b{re.escape(t.source)}\b", _literally(t.target))
    return text


def glossary_consistency(text: Column, terms: list[Term]) -> Column:
    """Share of the target terms that occur, four places; 1 without any."""
    wanted = [t for t in terms if not t.keep]
    if not wanted:
        return F.lit(1.0)
    hits = reduce(lambda a, b: a + b, [F.when(text.rlike(rf"(?i)\b{re.escape(t.target)}\b"), 1).otherwise(0) for t in wanted])
    return F.round(hits / len(wanted), 4)


def context_hash(text: Column, window: int = 200) -> Column:
    """Key of a text in a translation memory."""
    return F.sha1(F.lower(stripped(F.substring(text, 1, window))))
