"""Operator 3, chat formatting: schema fingerprints choose declarative mappings to canonical turns.

A layout is a set of nested field paths. Their hash selects a mapping, for a whole table (from its
schema) or row by row (from a JSON record). Turns are then rendered by one template whose control
strings all begin with "<" or "["; in roles and texts each of < [ \\ is followed by an inserted
backslash, so no control string of this template or of another that begins so survives in a text,
and one left-to-right pass restores it. Everything is native Column work.

Cases: null role or text is empty; turns are ordered by turn (null first), then role, then text;
repeated rows are turns of their own; rows of a null conversation id form one conversation; an
empty table gives an empty result; columns outside the layout that is taken are ignored, those of other layouts' names
too; a JSON record of unknown layout, or that isn't JSON, gives a row with layout null and no turns; an input column named
fingerprint, layout or turns is replaced. A conversation is
one record, so it must fit in a task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from surfacelab.llm.shared import column, new_path, table, unused

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
FORMATTED = "conv_id long, formatted string, loss_spans array<struct<start:int,length:int>>"


@dataclass(frozen=True)
class Layout:
    """paths: the layout's field paths; turns: (role or its path, text path) of each turn.

    kind "rows": one row per turn; "list": turns[0] are paths inside the elements of an array;
    "fields": turns are fields of the record, of which optional ones may be empty.
    """

    name: str
    kind: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    roles: tuple[tuple[str, str], ...] = ()
    joined: str | None = None


#: In order of priority: the first layout whose paths are all there is taken, whatever else there is.
LAYOUTS = (
    Layout("turn_rows", "rows", ("role", "text", "turn"), (("role", "text"),)),
    Layout("messages", "list", ("messages[].content", "messages[].role"), (("role", "content"),)),
    Layout("from_value", "list", ("conversations[].from", "conversations[].value"), (("from", "value"),), (("human", "user"), ("gpt", "assistant"))),
    Layout("prompt_completion", "fields", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", "fields", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("instruction_input", "fields", ("input", "instruction", "output"), (("user", "instruction"), ("assistant", "output")), joined="input"),
    Layout("instruction", "fields", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
)
KNOWN = tuple(sorted({p for x in LAYOUTS for p in x.paths}))


def fingerprint(paths) -> str:
    """SHA-256 of the sorted field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x.paths): x for x in LAYOUTS}


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested leaf paths of a type; [] stands for an array's elements."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def layout_of(df: DataFrame) -> Layout:
    """The first mapping whose fingerprint the schema's paths give, of those paths that the mapping names."""
    paths = set(field_paths(df.schema))
    for x in LAYOUTS:
        found = BY_FINGERPRINT.get(fingerprint(paths & set(x.paths)))
        if found is x:
            return x
    raise ValueError(f"no mapping for a schema with the paths {sorted(paths)}")


def _role(x: Column, layout: Layout) -> Column:
    for old, new in layout.roles:
        x = F.when(x == old, new).otherwise(x)
    return F.coalesce(x.cast("string"), F.lit(""))


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def _fields(layout: Layout, get) -> Column:
    """Turns of a record of kind "fields"; get(path) gives a field as a string."""
    turns = []
    for k, (role, path) in enumerate(layout.turns):
        text = _text(get(path))
        if k == 0 and layout.joined:
            more = _text(get(layout.joined))
            text = F.when(more == "", text).otherwise(F.concat(text, F.lit("\n\n"), more))
        turns.append(F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text")))
    return F.array(*turns)


def _items(items: Column, layout: Layout, role: str, text: str) -> Column:
    """Turns of an array of variants."""
    def get(m: Column, name: str) -> Column:
        return F.try_variant_get(m, "$." + name, "string")

    return F.transform(items, lambda m, i: F.struct(i.cast("long").alias("turn"), _role(get(m, role), layout).alias("role"), _text(get(m, text)).alias("text")))


def turn_rows(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text rows of a table in any known layout."""
    layout = layout_of(df)
    if layout.kind == "rows":
        role, text = layout.turns[0]
        return df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _role(F.col(role), layout).alias("role"), _text(F.col(text)).alias("text"))
    if layout.kind == "list":
        role, text = layout.turns[0]
        turns = F.transform(F.col(layout.paths[0].split("[")[0]), lambda x, i: F.struct(i.cast("long").alias("turn"), _role(x[role], layout).alias("role"), _text(x[text]).alias("text")))
    else:
        turns = _fields(layout, F.col)
    return df.select(F.col(conv_id).cast("long").alias("conv_id"), turns.alias("turns")).select("conv_id", F.inline("turns"))


def json_turns(df: DataFrame, record: str = "record") -> DataFrame:
    """df with fingerprint, layout and turns of a column of JSON records of mixed layouts."""
    name = unused([*df.columns, "fingerprint", "layout", "turns"], "variant_")
    v = F.try_parse_json(column(record))
    has = {p: F.when(F.try_variant_get(column(name), "$." + p.replace("[]", "[0]"), "variant").isNotNull(), F.lit(p)) for p in KNOWN}

    def of(paths) -> Column:
        return F.sha2(F.array_join(F.array_compact(F.array(*[has[p] for p in sorted(paths)])), "\n"), 256)

    # The fingerprint of the first layout whose paths are all there, or of all known paths that are.
    first = F.coalesce(*[F.when(of(x.paths) == fingerprint(x.paths), fingerprint(x.paths)) for x in LAYOUTS], of(KNOWN))
    df = df.withColumn(name, v).withColumn("fingerprint", first)
    record_of, layout, turns = column(name), F.lit(None).cast("string"), F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
    for x in LAYOUTS:
        here = F.col("fingerprint") == fingerprint(x.paths)
        if x.kind == "fields":
            got = _fields(x, lambda p: F.try_variant_get(record_of, "$." + p, "string"))
        elif x.kind == "list":
            role, text = x.turns[0]
            items = F.try_variant_get(record_of, "$." + x.paths[0].split("[")[0], "array<variant>")
            got = _items(items, x, role, text)
        else:
            role, text = x.turns[0]
            got = F.array(F.struct(F.try_variant_get(record_of, "$.turn", "bigint").alias("turn"), _role(F.try_variant_get(record_of, "$." + role, "string"), x).alias("role"), _text(F.try_variant_get(record_of, "$." + text, "string")).alias("text")))
        layout, turns = F.when(here, x.name).otherwise(layout), F.when(here, got).otherwise(turns)
    return df.withColumns({"layout": layout, "turns": turns}).drop(name)


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"([<\[\\])", r"$1\\")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"([<\[\\])\\", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of turn rows: the assistants' texts are the spans (code points)."""
    piece = turns.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("head") + F.length("body") + len(END)
    placed = piece.withColumns({"at": F.row_number().over(order), "stop": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    span = F.when(F.col("role") == "assistant", F.struct((F.col("stop") - len(END) - F.length("body")).cast("int").alias("start"), F.length("body").alias("length")))
    parts = placed.select("conv_id", F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span")).alias("p"))
    rows = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return rows.select("conv_id", F.array_join(F.col("p.piece"), "").alias("formatted"), F.array_compact(F.col("p.span")).alias("loss_spans"))


def parse_chats(df: DataFrame) -> DataFrame:
    """df with turns (array of role and text) and loss_text restored from formatted and loss_spans."""
    def quoted(x: str) -> str:
        return x.replace("|", r"\|")

    pieces = F.slice(F.split("formatted", quoted(TURN)), F.lit(2), F.greatest(F.size(F.split("formatted", quoted(TURN))), F.lit(1)))

    def turn(p: Column) -> Column:
        two = F.split(p, quoted(TEXT))
        text = F.get(two, F.lit(1))
        return F.struct(unescape(F.get(two, F.lit(0))).alias("role"), unescape(F.substr(text, F.lit(1), F.length(text) - len(END))).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return df.withColumns({"turns": F.transform(pieces, turn), "loss_text": F.array_join(loss, "")})


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    added = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(says).alias("prompt"), F.lit(says).alias("response"))
    turns = turn_rows(table(spark, sf_dir, "conversations")).unionByName(turn_rows(added))
    path = new_path(spark, "chats")
    format_chats(turns).write.parquet(path)
    back = parse_chats(spark.read.schema(FORMATTED).parquet(path))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_sql() -> str:
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(t))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(TURN) + len(TEXT) + len(END)} + length(regexp_replace(role, '([<\\[\\\\])', '\\1-', 'g'))
           + length(regexp_replace(text, '([<\\[\\\\])', '\\1-', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
