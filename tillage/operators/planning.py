"""Calendars: rules to dated events, rolling visits, what comes next, plans by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.functions.text import fill_template
from tillage.operators.agronomy import plan_base
from tillage.operators.relational import with_wildcard

EARLY = ("establecimiento", "vegetativo", "floración", "fructificación")
#: Kind, stages, days ahead, title and query of the activities that are planned with evidence.
ACTIVITIES = [
    (
        "irrigation", EARLY, 4, "Riego programado — {crop_display}",
        "calendario de riego del cultivo de {crop_name} en etapa {stage} frecuencia litros volumen por evento humedad de suelo óptima"
    ),
    (
        "fertilization", EARLY[:3], 10, "Fertilización — {crop_display}",
        "fertilización del cultivo de {crop_name} en etapa {stage} macronutrientes nitrógeno fósforo potasio dosis"
    ),
    (
        "pest", EARLY[1:], 7, "Inspección de plagas — {crop_display}",
        "manejo integrado de plagas del cultivo de {crop_name} etapa {stage} monitoreo umbrales control biológico"
    ),
    (
        "monitoring", (*EARLY, "cosecha"), 3, "Visita de campo — {crop_display}",
        "monitoreo agronómico semanal del cultivo de {crop_name} en etapa {stage} humedad suelo malezas plagas fenología"
    ),
    (
        "harvest", ("fructificación", "cosecha"), 14, "Ventana de cosecha — {crop_display}",
        "ventana de cosecha del cultivo de {crop_name} indicadores de madurez color firmeza grados brix tiempo desde floración"
    ),
]


def planned_activities(crops: DataFrame, today: Column) -> DataFrame:
    """(crop_id, event_type, stage, title, suggested_date, query) of the activities that fit each crop's stage.

    crops: crop_id, crop_name, display, planted, stage. Dates count from planting if that is ahead, else today.
    """
    base = plan_base(F.col("planted"), today)
    rows = []
    for kind, stages, days, title, query in ACTIVITIES:
        filled = {"crop_display": F.col("display"), "crop_name": F.col("crop_name"), "stage": F.col("stage")}
        entry = F.struct(
            F.lit(kind).alias("event_type"), fill_template(F.lit(title), filled).alias("title"),
            F.date_add(base, days).alias("suggested_date"), fill_template(F.lit(query), filled).alias("query")
        )
        rows.append(F.when(F.col("stage").isin(*stages), entry))
    return crops.select("crop_id", "stage", F.explode(F.array_compact(F.array(*rows))).alias("a")).select("crop_id", "stage", "a.*")


def with_evidence(activities: DataFrame, best: DataFrame) -> DataFrame:
    """activities with the best fragment found for their query: evidence, source_doc, score and the rationale.

    best: query, doc_id, title, page, text, score; one row a query. Without text there is no evidence.
    """
    shown = best.select(
        "query", F.col("doc_id").alias("source_doc"), F.col("title").alias("_title"), F.col("page").alias("_page"),
        F.substring("text", 1, 480).alias("_text"), "score"
    )
    joined = activities.join(shown, "query", "left")
    has = F.trim(F.coalesce("_text", F.lit(""))) != ""
    cited = F.concat_ws(", ", F.nullif("_title", F.lit("")), F.concat(F.lit("p. "), F.col("_page").cast("string")))
    # The sentences.
    with_text = F.concat(
        F.lit("<p>"), "_text", F.lit("</p><p class='small text-muted mb-0'>Fuente RAG"),
        F.when(cited != "", F.concat(F.lit(" — "), cited)).otherwise(""), F.lit("</p>")
    )
    without = "<p class='text-muted small mb-0'>Sin evidencia suficiente en la biblioteca para esta etapa. La actividad queda como sugerencia operativa basada en la fenología.</p>"
    return joined.select(
        *activities.columns, has.alias("evidence"), F.when(has, F.col("source_doc")).alias("source_doc"),
        F.when(has, F.col("score")).alias("score"), F.when(has, with_text).otherwise(without).alias("rationale")
    )


def expand_rules(crops: DataFrame, rules: DataFrame, existing: DataFrame, today: Column, include_past: bool = False, force: bool = False) -> DataFrame:
    """Events due by rule: (crop_id, event_date, title, event_type), past ones and those that exist left out.

    crops: crop_id, crop_name, display, planted; rules: crop_name (`*`: any), event_type, day_offset,
    title_template; existing: crop_id, title, event_date. Without a planting date today is the base.
    """
    due = with_wildcard(crops, rules, "crop_name").withColumn("event_date", F.date_add(F.coalesce("planted", today), F.col("day_offset")))
    title = fill_template(F.col("title_template"), {"crop_display": F.col("display"), "crop_name": F.col("crop_name")})
    if not include_past:
        due = due.where(F.col("event_date") >= today)
    events = due.withColumn("title", title).select("crop_id", "event_date", "title", "event_type")
    return events if force else events.join(existing.select("crop_id", "title", "event_date"), ["crop_id", "title", "event_date"], "left_anti")


def rolling_visits(crops: DataFrame, existing: DataFrame, today: Column, offsets: tuple[int, ...] = (0, 7, 14), horizon: int = 21) -> DataFrame:
    """A visit to each crop on the given days within the horizon, unless it is planned already."""
    days = [d for d in offsets if d <= horizon]
    visits = crops.select(
        "crop_id", F.concat(F.lit("Visita de campo — "), "display").alias("title"),
        F.explode(F.array(*[F.date_add(today, d) for d in days])).alias("event_date")
    )
    return visits.join(existing.select("crop_id", "title", "event_date"), ["crop_id", "title", "event_date"], "left_anti")


def urgency(start: Column, status: Column, today: Column) -> Column:
    """0 overdue (up to 14 days), 1 future, 2 done; null for cancelled and older ones."""
    late = F.datediff(today, start)
    return F.when(status == "cancelado", None).when(status == "completado", 2).when(late <= 0, 1).when(late <= 14, 0)


def next_tasks(events: DataFrame, n: int = 10) -> DataFrame:
    """The n most urgent events: events has `urgency`, `start` and `id`."""
    return events.where("urgency is not null").orderBy("urgency", "start", "id").limit(n)
