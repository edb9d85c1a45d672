"""Dictionary entities: taxonomy, synonyms, whole-word matches with offsets, coverage, labels, crop hints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.functions.text import once, squeeze, synonyms_applied
from tillage.functions.words import occurrences

# The agronomic dictionaries.
TAXONOMY = {
    "CULTIVO": "maiz frijol calabaza trigo tomate chile jitomate cebolla nopal aguacate amaranto sorgo avena".split(),
    "PLAGA": [
        "roya", "pulgon", "gusano cogollero", "minador", "mosca blanca", "chapulin", "gallina ciega", "chinche verde", "arana roja",
        "cenicilla", "tizon tardio", "fusarium", "antracnosis"
    ],
    "NUTRIENTE": [
        "n", "p", "k", "nitrogeno", "fosforo", "potasio", "calcio", "magnesio", "azufre", "hierro", "zinc", "boro", "manganeso", "cobre",
        "molibdeno", "materia organica"
    ],
    "FENOFASE": [
        "germinacion", "emergencia", "macollaje", "desarrollo vegetativo", "floracion", "polinizacion", "llenado", "maduracion", "cosecha",
        "poscosecha"
    ],
    "LUGAR": [
        "oaxaca", "puebla", "veracruz", "jalisco", "guanajuato", "chiapas", "guerrero", "michoacan", "tlaxcala", "estado de mexico",
        "hidalgo", "morelos", "tabasco"
    ],
    "PARAM_AMBIENTAL": [
        "temperatura", "humedad suelo", "humedad aire", "precipitacion", "ph", "luminosidad", "velocidad viento", "radiacion solar",
        "evapotranspiracion", "conductividad electrica", "salinidad"
    ],
}
SYNONYMS = {
    "zea mays": "maiz", "elote": "maiz", "phaseolus vulgaris": "frijol", "ejote": "frijol", "cucurbita": "calabaza", "capsicum": "chile",
    "serrano": "chile", "habanero": "chile", "jalapeno": "chile", "jitomate": "tomate", "lycopersicon": "tomate", "cucumis sativus": "pepino",
    "cucumis": "pepino", "pepinillo": "pepino", "cohombro": "pepino", "opuntia": "nopal", "persea americana": "aguacate",
    "roya amarilla": "roya", "roya anaranjada": "roya", "trips": "minador", "gusano barrenador": "gusano cogollero",
    "spodoptera frugiperda": "gusano cogollero", "oidio": "cenicilla", "phytophthora": "tizon tardio", "nitrogen": "nitrogeno",
    "potassium": "potasio", "phosphorus": "fosforo", "macollage": "macollaje", "humedad del suelo": "humedad suelo",
    "temperatura ambiente": "temperatura", "temp": "temperatura", "lluvia": "precipitacion", "ph del suelo": "ph",
}
LABEL_PATTERNS = [
    ("RECOMENDACION", r"\b(se recomienda|aplique|aplicar|dose|dosis|debe|deberia)\b"),
    ("DATO", r"\b(porcentaje|tabla|figura|promedio|media|desviacion|medicion|datos?)\b"),
    ("RESULTADO", r"\b(resultado|ensayo|rendimiento|incremento|disminucion|comparado con)\b"),
]


def entities(docs: DataFrame, taxonomy: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", normal: Column | None = None) -> DataFrame:
    """(id, type, value, start): every whole-word occurrence on the normalised text, start counted from 0.

    A text is normalised once and its words are met with the dictionary, a bounded list given by the caller, where it is;
    only occurrences leave the scan's stage. The work is linear in the text.
    """
    terms = [(t, v) for t, vs in taxonomy.items() for v in vs]
    text = squeeze(F.coalesce(F.col(text_col), F.lit(""))) if normal is None else normal
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"))

    def run(it):
        import pyarrow as pa

        for b in it:
            for rows, numbers, starts in occurrences(b.column(1), [v for _, v in terms]):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(numbers), pa.array(starts)], ["id", "term", "start"])

    found = slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, term int, start long")
    named = lambda i: F.get(F.array(*[F.lit(t[i]) for t in terms]).cast("array<string>"), F.col("term"))
    return found.select(F.col("id").alias(id_col), named(0).alias("type"), named(1).alias("value"), "start")


def with_phrases(found: DataFrame, phrases: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """found (id, type, value, start) and those of `phrases` that mark a span of that type not marked yet.

    A second recogniser's hits add to the first's: of both, one for each (type, start, end), the first's where both have one.
    Both come from one shuffle by span, so neither is worked out twice.
    """
    marked = lambda df, by: df.withColumn("_end", F.col("start") + F.length("value")).withColumn("_by", F.lit(by))
    span = Window.partitionBy(id_col, "type", "start", "_end").orderBy("_by", "value")
    both = marked(found, 0).unionByName(marked(phrases, 1)).withColumn("_n", F.row_number().over(span))
    return both.where("_n = 1").select(*found.columns)


def extract(
    docs: DataFrame, taxonomy: dict[str, list[str]] = TAXONOMY, synonyms: dict[str, str] = SYNONYMS, id_col: str = "doc_id",
    text_col: str = "text"
) -> DataFrame:
    """Normalise, rewrite synonyms, find entities: (id, type, value, start on the rewritten text)."""
    return entities(docs, taxonomy, id_col, text_col, synonyms_applied(squeeze(F.coalesce(F.col(text_col), F.lit(""))), synonyms))


def coverage(asked: Column, found: Column) -> Column:
    """Share of the asked entities that were found, four places; nothing asked gives 0."""
    q = F.array_distinct(asked)
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, found)) / F.size(q), 4)).otherwise(0.0)


def labels(text: Column) -> Column:
    """Labels of a fragment in fixed order; DATO where none fits."""
    found = once(squeeze(text), lambda t: F.array_compact(F.array(*[F.when(t.rlike(p), name) for name, p in LABEL_PATTERNS])))
    return once(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("DATO"))))


def crop_hints(text: Column, crops: list[str], stored: Column | None = None) -> Column:
    """Crops named in the text or in stored entities, sorted, each once."""
    named = once(squeeze(text), lambda t: F.array_compact(F.array(*[F.when(t.rlike(rf"\b{re.escape(c)}\b"), c) for c in crops if len(c) >= 3])))
    return F.array_sort(F.array_distinct(named if stored is None else F.array_union(named, stored)))
