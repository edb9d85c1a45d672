"""Assistant rules over chat messages: intent, noise, mode, target, answer quality."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.functions.text import chat_text, once, strip_html, stripped

# Short messages that are valid, words of the domain, and the intents in their order.
SHORT_VALID = ["ph", "p h", "npk", "n", "p", "k", "agua", "riego", "viento", "clima", "lluvia", "luz", "maiz", "frijol", "chile", "tomate"]
DOMAIN = (
    r"\b(agua|humedad|riego|temperatura|viento|lluvia|precipitacion|clima|luz|ph|conductividad|suelo|salinidad|cultivo|maiz|frijol|calabaza|tomate|chile|"
    r"plaga|plagas|fertiliz|abono|cosecha|historia|origen|biblioteca|manual|documento|nutriente|nitrogeno|fosforo|potasio)\b"
)
METRIC_INTENTS = [
    ("air_humidity_status", r"\b(humedad\s+(ambiental|relativa|del\s+aire|aire)|hr)\b"),
    ("water_balance", r"\b(agua|humedad\s+del\s+suelo|humedad\s+suelo|riego|riegos|regar|hidrico)\b|^humedad$"),
    ("temperature_status", r"\b(temperatura|calor|frio|helada|termico)\b"),
    ("wind_status", r"\b(viento|racha|rachas)\b"),
    ("precipitation_status", r"\b(lluvia|precipitacion|llovio)\b"),
    ("light_status", r"\b(luz|radiacion|solar|luminosidad)\b"),
    ("climate_status", r"\b(clima|climatolog|meteorolog|condiciones\s+(climaticas|ambientales))\b"),
    ("soil_condition", r"\b(suelo|ph|conductividad|salinidad|edafolog|materia\s+organica|textura)\b"),
]
OTHER_INTENTS = [
    (
        "library_question",
        r"\b(historia|origen|origenes|domesticacion|que\s+es|definicion|biblioteca|manual|documento|referencia|bibliograf|autor|fuente|cita|citas)\b"
    ),
    ("harvest_date", r"\b(cuando\s+(cosech|recolect)|fecha\s+de\s+cosech|proxima\s+cosech|falta\s+para\s+cosech|cosecha\s+estimada)\b"),
    ("pest_or_disease", r"\b(plaga|plagas|gusano|insecto|hongo|hongos|mildiu|tizon|roya|enfermedad)\b"),
    ("fertilization", r"\b(fertiliz|abono|nutri|nutricion|nitrogeno|fosforo|potasio|npk)\b"),
    ("crop_status", r"\b(estado|resumen|avance|progreso|salud|como\s+va|condicion)\b"),
]
SMASH = r"^(asdf|qwerty?|zxcv|xxxxx|aaaaa|dadad|abab|jaja{4,}|jeje{4,})"
# Intents that documents answer, that readings answer, that fall back to the only active crop.
DOCUMENT_INTENTS = ("library_question", "pest_or_disease", "fertilization", "soil_condition")
READING_INTENTS = ("water_balance", "temperature_status", "wind_status", "precipitation_status", "air_humidity_status", "light_status", "climate_status")
PARCEL_INTENTS = (*READING_INTENTS[1:], "soil_condition")
FALLBACK_INTENTS = ("water_balance", *PARCEL_INTENTS, "crop_status", "unknown", "harvest_date", "pest_or_disease", "fertilization")
# Technical topics by intent.
TOPICS = {
    "pest_or_disease": "plagas enfermedades manejo sanitario control prevencion",
    "fertilization": "fertilizacion nutricion abonado requerimientos manejo",
    "soil_condition": "suelo pH conductividad salinidad humedad materia organica manejo",
}
# Marks of leaked prompts, of generic answers, of questions about history and of support for them.
LEAKS = ["eres el componente documental", "no debes desplazar", "salud calculada", "pregunta del agricultor", "devuelve solo manejo tecnico"]
GENERIC = ["pasos y recomendaciones para «eres", 'pasos y recomendaciones para "eres', "parametros agronomicos relevantes para «recomendaciones"]
HISTORY_QUESTIONS = ["historia", "origen", "origenes", "domesticacion"]
HISTORY_SUPPORT = ["historia", "origen", "originario", "originaria", "domesticacion", "prehispanico", "ancestral", "mesoamerica", "teocintle"]
# What an answer says when it has nothing to say.
NOT_UNDERSTOOD = (
    "No entendí tu mensaje. Prueba con el nombre de un cultivo activo o una consulta como "
    "'¿cómo estoy de agua?', 'temperatura', 'viento' o 'plagas en el maíz'."
)
NO_LIBRARY = "No tengo información suficiente en la biblioteca para procesar esa solicitud."
NO_CROPS = "Aún no tienes cultivos registrados. Agrega uno en Configuración para recibir diagnóstico de parcela."
CONFLICT = ("Aviso: preguntaste por '", "', pero no es un cultivo activo en tu parcela.")
CONFLICT_EMPTY = " No puedo hacer diagnóstico personalizado y no encontré información suficiente en la biblioteca para esa solicitud."
SEVERAL = (
    "Tienes varios cultivos activos y no detecté uno específico en tu pregunta.",
    "\n\nPregunta por uno en particular, por ejemplo: '¿cómo va mi maíz?' o 'plagas en mi frijol'."
)
NEEDS_CROP = {
    "pest_or_disease": (
        "Para revisar plagas o enfermedades necesito el cultivo específico, porque no se manejan igual en cada cultivo.",
        "Por ahora revisa señales generales: hojas mordidas o manchadas, insectos en el envés, tallos débiles, frutos dañados y humedad alta que favorezca hongos.",
    ),
    "fertilization": (
        "Para fertilización necesito el cultivo específico y, si existe, nutrientes reales cargados.",
        "Sin análisis de N, P, K o materia orgánica solo puedo dar orientación preventiva, no dosis exactas.",
    ),
}
NEEDS_CROP_END = "\n\nPregunta por uno en particular, por ejemplo: 'plagas en mi tomate' o 'fertilización en maíz'."
NO_SUPPORT = "No encontré información suficiente en los documentos para respaldar esa parte de la consulta."


def keyboard_smash(norm: Column) -> Column:
    """Messages that look typed at random: few vowels, one repeated letter, long consonant runs."""
    s = F.regexp_replace(norm, r"\s+", "")
    n, vowels = F.length(s), F.regexp_count(s, F.lit("[aeiou]"))
    odd = ((n >= 5) & (vowels == 0)) | ((n >= 8) & (vowels / F.greatest(n, F.lit(1)) < 0.18)) | s.rlike(r"^(.)\1{5,}$") | s.rlike(SMASH) | s.rlike("[bcdfghjklmnpqrstvwxyz]{6,}")
    return (norm == "") | (~s.isin(*SHORT_VALID) & ~norm.rlike(DOMAIN) & odd)


def low_confidence(norm: Column) -> Column:
    letters = F.regexp_count(norm, F.lit("[a-z]")) / F.greatest(F.length(norm), F.lit(1))
    known = norm.isin(*SHORT_VALID) | norm.rlike(DOMAIN)
    return (norm == "") | (~known & ((letters < 0.4) | ((F.length(norm) <= 3) & ~norm.rlike(r"\d")) | keyboard_smash(norm)))


def intent(message: Column) -> Column:
    """The first intent whose pattern fits: metrics, then noise, then the others; else unknown."""

    def cascade(norm: Column) -> Column:
        out = F.lit("unknown")
        for name, pattern in reversed(OTHER_INTENTS):
            out = F.when(norm.rlike(pattern), name).otherwise(out)
        out = F.when(low_confidence(norm), "garbage").otherwise(out)
        for name, pattern in reversed(METRIC_INTENTS):
            out = F.when(norm.rlike(pattern), name).otherwise(out)
        return out

    return once(chat_text(message), cascade)


def mode(intent_col: Column, asked: Column, n_active: Column) -> Column:
    """`asked` unless it is null or auto; then library for library questions and where no crop is active, else parcel."""
    auto = F.when((intent_col == "library_question") | (F.coalesce(n_active, F.lit(0)) <= 0), "biblioteca").otherwise("parcela")
    return F.when(asked.isNotNull() & (asked != "auto"), asked).otherwise(auto)


def needs_documents(intent_col: Column, mode_col: Column) -> Column:
    """Noise and what readings answer never ask the documents; library mode always does."""
    never = (intent_col == "garbage") | intent_col.isin(*READING_INTENTS)
    return ~never & ((mode_col == "biblioteca") | intent_col.isin(*DOCUMENT_INTENTS))


def named_crop(message: Column, names: Column) -> Column:
    """The longest of the names (array, at least two characters) that the message holds; the first among equals."""
    return once(chat_text(message), lambda norm: _longest_of(norm, names))["name"]


def _longest_of(norm: Column, names: Column) -> Column:
    """struct(norm, name) of named_crop for a message that is chat text."""
    plain = F.transform(names, lambda n: F.struct(chat_text(n).alias("norm"), n.alias("name")))
    nothing = F.lit(None).cast("struct<norm: string, name: string>")
    held = F.filter(plain, lambda n: (F.length(n["norm"]) >= 2) & F.contains(norm, n["norm"]))
    return F.aggregate(held, nothing, lambda best, n: F.when(best.isNull() | (F.length(n["norm"]) > F.length(best["norm"])), n).otherwise(best))


def target_crop(message: Column, crops: list[str], active: Column) -> Column:
    """The longest crop named in the message, else the only active one."""
    return F.coalesce(named_crop(message, F.array(*[F.lit(c) for c in crops])), F.when(F.size(active) == 1, F.get(active, 0)))


def holds_any(text: Column, marks: list[str]) -> Column:
    """Whether a text holds one of the marks, both compared as chat text."""
    norm = chat_text(text)
    return reduce(lambda a, b: a | b, [F.contains(norm, F.lit(m)) for m in sorted({plain_mark(m) for m in marks})])


def plain_mark(mark: str) -> str:
    """A mark in the form that chat_text gives texts."""
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9%°\s\-_/.,]", " ", mark)).strip()


def quality_gate(answer: Column, insufficient: Column, message: Column, mode_col: Column, evidence: Column, own_marks: list[str] = ()) -> Column:
    """`ok`, or the first reason against an answer. evidence: the texts and titles it rests on, as one string.
    own_marks: marks of the caller's own prompts, such as an assistant's name, that an answer must not repeat either."""
    plain = strip_html(F.coalesce(answer, F.lit("")))
    unsupported = (mode_col == "biblioteca") & holds_any(message, HISTORY_QUESTIONS) & ~holds_any(F.concat_ws(" ", plain, evidence), HISTORY_SUPPORT)
    return (
        F.when(F.coalesce(insufficient, F.lit(False)), "rag_insufficient_evidence")
        .when(plain == "", "rag_empty_answer")
        .when(F.contains(chat_text(plain), F.lit("no hay informacion suficiente")), "rag_declared_insufficient")
        .when(holds_any(plain, [*LEAKS, *own_marks]), "rag_prompt_leak")
        .when(holds_any(plain, GENERIC), "rag_generic_or_unrelated_answer")
        .when(unsupported, "rag_no_history_support")
        .otherwise("ok")
    )


def clean_query(message: Column, intent_col: Column, mode_col: Column, target: Column, requested: Column, n_active: Column, active: Column) -> Column:
    """The query sent to the documents: never a long prompt, never readings.

    target: the crop in question; requested: a crop of the catalogue that the message names; active: display
    names of the active crops, in one string. Library mode sends the message alone.
    """
    raw = stripped(F.coalesce(message, F.lit("")))
    crop = F.coalesce(F.nullif(target, F.lit("")), F.nullif(requested, F.lit("")))
    topic = F.lit(None).cast("string")
    for name, words in TOPICS.items():
        topic = F.when(intent_col == name, words).otherwise(topic)
    # topics begin and raw ends without white space, so only an empty message leaves some at the end
    end = F.when(raw == "", ":").otherwise(F.concat(F.lit(": "), raw))
    technical = F.when(crop.isNotNull(), F.concat(topic, F.lit(" en cultivo de "), crop, end))
    technical = technical.when(n_active > 0, F.concat(topic, F.lit(" para cultivos activos ("), active, F.lit(")"), end)).otherwise(F.concat(topic, end))
    conflict = requested.isNotNull() & target.isNull()
    own = F.nullif(raw, F.lit(""))
    return (
        F.when(mode_col == "biblioteca", F.coalesce(own, F.lit("consulta agricola de biblioteca")))
        .when(topic.isNotNull(), technical)
        .when(conflict, F.coalesce(own, F.concat(F.lit("informacion tecnica sobre "), crop)))
        .otherwise(F.coalesce(own, F.lit("consulta agricola")))
    )


def query_scope(mode_col: Column, target: Column, target_id: Column, requested: Column) -> Column:
    """struct(crop_focus, retrieval_scope, user_crop_id) of the request to the documents."""
    scope = lambda focus, name, crop: F.struct(
        focus.cast("string").alias("crop_focus"), F.lit(name).alias("retrieval_scope"), crop.cast("long").alias("user_crop_id")
    )
    none = F.lit(None)
    by_request = requested.isNotNull() & (target.isNull() | (mode_col == "biblioteca"))
    return F.when(by_request, scope(requested, "crop_boost", none)).when(target.isNotNull(), scope(target, "crop_boost", target_id)).otherwise(scope(none, "global", none))


def contexts(messages: DataFrame, crops: DataFrame, catalogue: list[str], lists: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """messages with their user's context: n_active, named_id, target_id, target, requested, source, conflict, and `lists`.

    messages: user_id, text, intent; crops: user_id, crop_id, crop_name, display_name, status, created. A
    crop counts as active unless its status is `inactivo`; newest first. The target is the active crop that
    the message names best; else the only active crop, for intents that allow it; never the first of several.
    requested is the crop of the catalogue that the message names.

    lists: columns made of the array of a user's active display names, by default `active`, the array itself. They are made once
    a user and joined last. Messages are compared with a user's different names only, each in the form of its newest crop.
    """
    lists = {"active": lambda a: a} if lists is None else lists
    alive = crops.where(F.coalesce("status", F.lit("activo")) != "inactivo")
    entry = F.struct(
        F.col("created"), F.col("crop_id"), F.col("crop_name"),
        F.coalesce(F.nullif("display_name", F.lit("")), F.initcap("crop_name")).alias("display")
    )
    owned = alive.select(F.col("user_id").alias("_user"), entry.alias("_e"))
    counted = owned.groupBy("_user").agg(F.count("*").cast("int").alias("_n"), F.max("_e").alias("_newest"))
    # a name stands for the newest crop that has it, as its own name rather than as the shown one
    called = F.explode(F.array(F.struct(F.col("_e.crop_name").alias("name"), F.lit(1).alias("own")), F.struct(F.col("_e.display").alias("name"), F.lit(0).alias("own"))))
    names = owned.select("_user", "_e", called.alias("_c")).groupBy("_user", F.col("_c.name").alias("_name")).agg(F.max(F.struct("_e", "_c.own")).alias("_best"))
    plain = names.withColumn("_plain", chat_text(F.col("_name"))).where(F.length("_plain") >= 2).groupBy("_user", "_plain").agg(F.max("_best").alias("_best"))
    ranked = F.sort_array(F.collect_list(F.struct(F.length("_plain").alias("size"), F.col("_best").alias("best"), F.col("_plain").alias("plain"))), asc=False)
    known = counted.join(plain.groupBy(F.col("_user").alias("_of")).agg(ranked.alias("_names")), F.col("_user") == F.col("_of"), "left").drop("_of")
    joined = messages.join(known, F.col("user_id") == F.col("_user"), "left").withColumn("_norm", chat_text(F.col("text")))
    held = F.filter("_names", lambda n: F.contains(F.col("_norm"), n["plain"]))
    joined = joined.withColumns({"_found": F.get(held, 0)["best"]["_e"], "_asked": _longest_of(F.col("_norm"), F.array(*[F.lit(c) for c in catalogue]))["name"]})
    found, requested = F.col("_found"), F.col("_asked")
    only = F.when((F.col("_n") == 1) & F.col("intent").isin(*FALLBACK_INTENTS), F.col("_newest"))
    target = F.coalesce(found, only)
    source = F.when(found.isNotNull(), "explicit").when(only.isNotNull(), "fallback_single_crop").otherwise("none")
    out = joined.select(
        *messages.columns, F.coalesce("_n", F.lit(0)).alias("n_active"), found["crop_id"].alias("named_id"), target["crop_id"].alias("target_id"),
        target["crop_name"].alias("target"), requested.alias("requested"), source.alias("source"), (requested.isNotNull() & found.isNull()).alias("conflict"),
    )
    if not lists:
        return out
    shown = owned.groupBy("_user").agg(F.sort_array(F.collect_list("_e"), asc=False).alias("_crops")).select("_user", F.transform("_crops", lambda c: c["display"]).alias("_shown"))
    made = shown.select("_user", *[make(F.col("_shown")).alias(n) for n, make in lists.items()])
    nothing = F.array().cast("array<string>")
    return out.join(made, F.col("user_id") == F.col("_user"), "left").select(*out.columns, *[F.coalesce(n, make(nothing)).alias(n) for n, make in lists.items()])


def recent_recommendations(recommendations: DataFrame, as_of: Column, hours: int = 6) -> DataFrame:
    """Of each crop the newest pending recommendation of the last hours: one row a crop, to be used again.

    recommendations: id, crop_id, action, status, created and whatever else; ties go to the larger id.
    """
    young = recommendations.where((F.col("status") == "pendiente") & (F.col("created") >= as_of - F.make_interval(hours=F.lit(hours))))
    newest = young.groupBy("crop_id").agg(F.max_by(F.struct(*[c for c in recommendations.columns if c != "crop_id"]), F.struct("created", "id")).alias("_r"))
    return newest.select("crop_id", "_r.*")


def crop_lines(names: Column) -> Column:
    """One line a crop, in one string."""
    return F.array_join(F.transform(names, lambda x: F.concat(F.lit("- "), x)), "\n")


def answer(c: dict[str, Column]) -> Column:
    """The answer cascade: the first case that fits decides.

    c: intent, mode, requested, conflict, library (cleaned library text or null), documents (cleaned answer of
    the documents or null), n_active, crop_lines (crop_lines() of the active crops), target, water, metric and
    crop_answer (the texts of those cases).
    """
    lines = c["crop_lines"]
    conflict = F.concat(F.lit(CONFLICT[0]), c["requested"], F.lit(CONFLICT[1]))
    with_library = F.concat(conflict, F.lit("\n\nInformación de biblioteca:\n"), c["documents"])
    out = F.concat(F.lit(SEVERAL[0] + "\n\nCultivos activos:\n"), lines, F.lit(SEVERAL[1]))
    for name, (intro, checks) in NEEDS_CROP.items():
        out = F.when(c["intent"] == name, F.concat(F.lit(f"{intro}\n\nCultivos activos:\n"), lines, F.lit(f"\n\n{checks}{NEEDS_CROP_END}"))).otherwise(out)
    no_target = c["target"].isNull()
    return (
        F.when(c["intent"] == "garbage", NOT_UNDERSTOOD)
        .when(c["conflict"] & (c["mode"] != "biblioteca"), F.coalesce(with_library, F.concat(conflict, F.lit(CONFLICT_EMPTY))))
        .when(c["mode"] == "biblioteca", F.coalesce(c["library"], F.lit(NO_LIBRARY)))
        .when(c["n_active"] <= 0, NO_CROPS)
        .when((c["intent"] == "water_balance") & no_target, c["water"])
        .when(c["intent"].isin(*PARCEL_INTENTS) & no_target, c["metric"])
        .when(~no_target, c["crop_answer"])
        .otherwise(out)
    )
