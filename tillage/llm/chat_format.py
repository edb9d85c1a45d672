"""Chat formatting: records of many layouts become canonical turns, turns become one training text.

The nested field paths of a JSON record that any layout knows are hashed; the hash selects the
declarative mapping to turns. Only DataFrame functions are used.

Template: every turn is `<s>` role newline text `</s>`. Inside role and text the characters that
control strings begin with are escaped (`&` to `&amp;`, `<` to `&lt;`, `[` to `&#91;`, and a newline in
a role to `&#10;`), so no text can open or close a turn, and undoing the four in reverse order gives
the text back. The loss mask is a run-length list over the formatted text, three runs to a turn.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm._common import check_absent, fresh

OPEN, CLOSE = "<s>", "</s>"
#: What the from/value layout calls the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
TURNS = "array<struct<role: string, text: string>>"
_JSON = {"maxStringLen": "2147483647"}
_RECORD = (
    "messages array<struct<role: string, content: string>>, conversations array<struct<`from`: string, value: string>>, "
    "turns array<struct<role: string, text: string>>, system string, prompt string, completion string, response string, "
    "instruction string, input string, output string, question string, answer string"
)


@dataclass(frozen=True)
class Layout:
    """Field paths that are required and that may be there, and what becomes of them: the name of a list
    with its role and text fields, or (role, field names whose texts are joined by a blank line).
    renamed: whether ROLE_NAMES applies to the list's roles; other layouts' roles stay as they are."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    listed: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    renamed: bool = False


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), ("system",), listed=("messages", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), ("system",), listed=("conversations", "from", "value"), renamed=True),
    Layout("role_text", ("turns[].role", "turns[].text"), ("system",), listed=("turns", "role", "text")),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", ("question", "answer"), ("system",), fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def _print_of(paths) -> Column:
    return F.xxhash64(F.lit(",".join(sorted(paths))))


def schema_fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the record's nested field paths, of those that some layout names; list elements are `name[]`."""
    known = sorted({p for x in layouts for p in (*x.required, *x.optional)})
    top = F.map_entries(F.from_json(record, "map<string,string>", _JSON))
    inner = lambda e: F.flatten(F.transform(
        F.coalesce(F.from_json(e["value"], "array<map<string,string>>", _JSON), F.expr("array()")),
        lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    ))
    lists = sorted({p.partition("[]")[0] for p in known if "[]" in p})
    paths = F.flatten(F.transform(
        top,
        lambda e: F.when(
            e["key"].isin(lists), F.transform(F.array_distinct(inner(e)), lambda n: F.concat(e["key"], F.lit("[]."), n))
        ).otherwise(F.array(e["key"]))
    ))
    return F.xxhash64(F.array_join(
        F.array_sort(F.array_intersect(F.coalesce(paths, F.array().cast("array<string>")), F.array(*[F.lit(p) for p in known]))), ","
    ))


def _turns(layout: Layout, r: Column) -> Column:
    turn = lambda role, text: F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if layout.listed:
        name, role, text = layout.listed
        names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
        known = lambda m: F.try_element_at(names, m[role]) if layout.renamed else F.lit(None)
        body = F.transform(r[name], lambda m: turn(F.coalesce(known(m), m[role], F.lit("")), m[text]))
    else:
        body = F.array(*[turn(F.lit(role), F.concat_ws("\n\n", *[F.when(r[f] != "", r[f]) for f in fields])) for role, fields in layout.fields])
    if "system" in layout.optional:
        body = F.when(r["system"].isNotNull(), F.concat(F.array(turn(F.lit("system"), r["system"])), body)).otherwise(body)
    return body.cast(TURNS)


def canonical_turns(records: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS, out: str = "turns", layout_out: str = "layout") -> DataFrame:
    """records with `layout` (name, null for an unknown or malformed record) and `turns` (null likewise).

    Unknown fields are ignored; two layouts' fields in one record are an unknown layout, to be
    registered as one. Null texts are empty. Other columns pass through, whatever they are called;
    `layout_out` and `out` must not be among them.
    """
    check_absent(records, layout_out, out)
    print_col, record_name = fresh(records, "print"), fresh(records, "record")
    record = F.col(record_name)
    chosen, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        variants = [(*x.required, *extra) for n in range(len(x.optional) + 1) for extra in combinations(x.optional, n)]
        hit = F.lit(False)
        for v in variants:
            hit = hit | (F.col(print_col) == _print_of(v))
        chosen = F.when(hit, x.name).otherwise(chosen)
        turns = F.when(hit, _turns(x, record)).otherwise(turns)
    marked = records.withColumn(print_col, schema_fingerprint(F.col(record_col), layouts)).withColumn(record_name, F.from_json(F.col(record_col), _RECORD, _JSON))
    return marked.withColumn(layout_out, chosen).withColumn(out, turns).drop(print_col, record_name)


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(c: Column) -> Column:
    return F.replace(
        F.replace(F.replace(F.replace(c, F.lit("&#10;"), F.lit("\n")), F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")),
        F.lit("&amp;"), F.lit("&")
    )


def format_turns(
    records: DataFrame, turns_col: str = "turns", learned: tuple[str, ...] = ("assistant",), out: str = "formatted",
    mask_out: str = "loss_mask"
) -> DataFrame:
    """records with the formatted text and its loss mask, array<struct<length, learn>> over code points.

    No turns (null or empty) give an empty text and mask. `out` and `mask_out` must not be columns.
    """
    check_absent(records, out, mask_out)
    turns = F.coalesce(F.col(turns_col), F.array().cast(TURNS))
    head = lambda t: F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    text = F.array_join(F.transform(turns, lambda t: F.concat(head(t), escape(t["text"]), F.lit(CLOSE))), "")
    run = lambda n, on: F.struct(n.cast("int").alias("length"), on.alias("learn"))
    mask = F.flatten(F.transform(
        turns,
        lambda t: F.array(
            run(F.length(head(t)), F.lit(False)), run(F.length(escape(t["text"])), t["role"].isin(*learned)),
            run(F.lit(len(CLOSE)), F.lit(False))
        )
    ))
    return records.withColumn(out, text).withColumn(mask_out, mask)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    pieces = F.split(formatted, CLOSE, -1)
    body = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, len(OPEN) + 1, 2147483647))
    return F.transform(
        body,
        lambda p: F.struct(unescape(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"))
    )


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, in order, unescaped."""
    pieces = F.split(formatted, CLOSE, -1)
    bodies = F.slice(pieces, 1, F.size(pieces) - 1)
    under = F.transform(
        bodies, lambda p,
        i: F.when(F.get(mask, i * 3 + 1)["learn"], F.substr(p, F.get(mask, i * 3)["length"] + 1, F.get(mask, i * 3 + 1)["length"])).otherwise(F.lit(""))
    )
    return unescape(F.array_join(under, ""))


def records_of_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, record): rows by turn gathered into one JSON record of layout `messages` for each id.

    Rows order by turn, then role and text, so that tied turns have one order; null roles and texts
    are empty, a null id is an id. A conversation is one training text, so its rows meet in one row.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    listed = F.transform(F.sort_array(F.collect_list(row)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.groupBy(F.col(id_col).alias("conv_id")).agg(listed.alias("messages")).select("conv_id", F.to_json(F.struct("messages")).alias("record"))
