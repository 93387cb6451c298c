"""Chat formatting: schema fingerprints pick a declarative mapping to canonical turns, turns become marked text.

A layout is the set of its nested field paths ("messages[].role"). Its fingerprint is the SHA-256 of its sorted
paths, less those that no mapping names, so that an id or a name beside them changes nothing. A table has one
fingerprint, from its schema; a column of JSON records has one for each record, from the record itself. Either selects
the mapping that turns the layout into `turns array<struct<role, text>>`.

The template writes a turn as START role SEP text END. Control strings inside a role or a text get one backslash more
after their first character, which takes as many away again on reading back, so any text survives the round trip.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rideledger.llm.common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What may follow the first character of a control string: this template's marks, and those of other chat formats.
_REST = r"((?:\|im_start\||\|im_sep\||\|im_end\||\|endoftext\||\|startoftext\||/?s|unk)>|/?INST\]|</?SYS>>)"
_PLAIN, _ESCAPED = r"([<\[])(\\*)" + _REST, r"([<\[])\\(\\*)" + _REST
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A layout's field paths and how its turns are read: a list field with its role and text names, or (role, field) in
    order. roles says what a list's own names of roles are here; others stay as they are."""

    name: str
    paths: tuple[str, ...]
    each: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths) -> str:
    """Hex SHA-256 of nested field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Layout("messages_text", ("messages[].role", "messages[].text"), each=("messages", "role", "text")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), each=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))),
    Layout("no_messages", ("messages[]",)),
    Layout("no_conversations", ("conversations[]",)),
    Layout("prompt_response", ("prompt", "response"), fixed=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("prompt", "completion"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt_response", ("system", "prompt", "response"), fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction_output", ("instruction", "output"), fixed=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input_output", ("instruction", "input", "output"), fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question_answer", ("question", "answer"), fixed=(("user", "question"), ("assistant", "answer"))),
)
#: The fields that hold lists, and all paths that a mapping names.
_LISTS = tuple(sorted({x.each[0] for x in LAYOUTS if x.each}))
_NAMED = tuple(sorted({p for x in LAYOUTS for p in x.paths}))


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type; [] marks a list's elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else [at]


def json_paths(record: Column) -> Column:
    """The nested field paths of a JSON object, sorted; an empty list of messages is a path that ends in []. Null for anything else."""
    parsed = F.try_parse_json(record)
    items = lambda name: F.try_variant_get(parsed, f"$.{name}", "array<map<string,variant>>")

    def inside(name: str) -> Column:
        keys = F.array_distinct(F.flatten(F.transform(items(name), F.map_keys)))
        return F.when(F.size(items(name)) == 0, F.array(F.lit(f"{name}[]"))).otherwise(F.transform(keys, lambda k: F.concat(F.lit(f"{name}[]."), k)))

    def paths(key: Column) -> Column:
        out = F.array(key)
        for name in _LISTS:
            out = F.when((key == name) & items(name).isNotNull(), inside(name)).otherwise(out)
        return out

    top = F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>"))
    return F.array_sort(F.flatten(F.transform(top, paths)))


def json_fingerprint(record: Column) -> Column:
    """A JSON record's fingerprint; null where it isn't a JSON object."""
    named = F.filter(json_paths(record), lambda p: p.isin(*_NAMED))
    return F.when(named.isNotNull(), F.sha2(F.array_join(named, "\n"), 256))


def _role(role: Column, layout: Layout) -> Column:
    out = F.coalesce(role, F.lit(""))
    for theirs, ours in layout.roles:
        out = F.when(role == theirs, F.lit(ours)).otherwise(out)
    return out


def _turns(layout: Layout, get) -> Column:
    turn = lambda role, text: F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if layout.each:
        name, role, text = layout.each
        return F.coalesce(F.transform(get(name), lambda m: turn(_role(m[role], layout), m[text])), F.array().cast(TURNS))
    return F.array(*[turn(F.lit(role), get(name)) for role, name in layout.fixed]).cast(TURNS)


def canonical_table(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, layout and turns of a table whose other columns are one of LAYOUTS, whatever more there are.

    An unknown layout is an error that names its paths: a table that nobody has mapped must not pass as empty.
    Null texts are empty; a null list of messages has no turns. Columns kept under these two names give way to them.
    """
    keep = tuple(c for c in keep if c not in ("layout", "turns"))
    paths = [p for f in df.schema.fields if f.name not in keep for p in schema_paths(f.dataType, f.name)]
    layout = {x.fingerprint: x for x in LAYOUTS}.get(fingerprint_of(p for p in paths if p in _NAMED))
    if layout is None:
        raise ValueError(f"no mapping for a layout of {sorted(paths)}")
    return df.select(*[F.col(f"`{c}`") for c in keep], F.lit(layout.name).alias("layout"), _turns(layout, F.col).alias("turns"))


def canonical_json(df: DataFrame, record: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, fingerprint, layout and turns of a column of JSON records, each of its own layout.

    A record that isn't a JSON object has a null fingerprint; one of an unknown layout has a fingerprint but no layout.
    Both have null turns, for the caller to set aside. Fields that no mapping names say nothing; an empty or null list
    has no turns; null and absent texts and roles are empty. Columns kept under one of the three names give way to it.
    """
    keep = tuple(c for c in keep if c not in ("fingerprint", "layout", "turns"))
    fields: dict = {}
    for layout in LAYOUTS:
        if layout.each:
            name, role, text = layout.each
            fields.setdefault(name, set()).update((role, text))
        for _, name in layout.fixed:
            fields.setdefault(name, None)
    schema = ", ".join(f"{n} " + (f"array<struct<{', '.join(f'`{x}`: string' for x in sorted(k))}>>" if k else "string") for n, k in sorted(fields.items()))
    parsed = F.from_json(F.col(f"`{record}`"), schema, {"maxStringLen": str(2**31 - 1)})
    rows = df.select(*[F.col(f"`{c}`") for c in keep], json_fingerprint(F.col(f"`{record}`")).alias("fingerprint"), F.struct(parsed.alias("parsed")).alias("turns"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        hit = F.col("fingerprint") == layout.fingerprint
        name = F.when(hit, F.lit(layout.name)).otherwise(name)
        turns = F.when(hit, _turns(layout, lambda n: F.col("turns")["parsed"][n])).otherwise(turns)
    return rows.select(*[F.col(f"`{c}`") for c in keep], "fingerprint", name.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_turns(df: DataFrame) -> DataFrame:
    """df (turns, ...) with formatted and loss_mask instead of turns.

    loss_mask has a start and a length for each turn, in code points from that turn's start mark: the assistant's
    text, or nothing (length 0) for other roles. No turns give an empty text and an empty mask.
    """
    safe = F.transform(F.col("turns"), lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    mask = lambda t: F.struct(
        (F.length(t["role"]) + len(START) + len(SEP)).alias("start"),
        F.when(t["role"] == "assistant", F.length(t["text"])).otherwise(F.lit(0)).alias("length"),
    )
    return (
        df.withColumn("__safe", safe)
        .withColumn("formatted", F.array_join(F.transform("__safe", lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END))), ""))
        .withColumn("loss_mask", F.transform("__safe", mask))
        .drop("__safe", "turns")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    raw = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda s: s != "")
    part = lambda s, i: unescape(F.split(F.substring(s, len(START) + 1, 2**31 - 1), r"<\|im_sep\|>")[i])
    return F.transform(raw, lambda s: F.struct(part(s, 0).alias("role"), part(s, 1).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    raw = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda s: s != "")
    under = F.zip_with(raw, mask, lambda s, m: unescape(F.substr(s, m["start"] + 1, m["length"])))
    return F.array_join(under, "")


def records(conversations: DataFrame) -> DataFrame:
    """conv_id and messages of a table with a row for each turn.

    Turns with equal numbers go by role, then text; null numbers come first. A conversation is one record, so its
    turns meet in one task; nothing else of the table does.
    """
    rows = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = F.sort_array(F.collect_list(rows))
    return (
        conversations.groupBy("conv_id")
        .agg(listed.alias("m"))
        .select("conv_id", F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("messages"))
    )


def as_json(conversations: DataFrame) -> DataFrame:
    """conv_id and record: each conversation of records() as a JSON record, in one of the layouts that hold it, by its id."""
    m = F.col("messages")
    role, text, at = lambda i: F.get(m, F.lit(i))["role"], lambda i: F.get(m, F.lit(i))["text"], lambda n: F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(n))
    theirs = lambda r: F.when(r == "user", F.lit("human")).when(r == "assistant", F.lit("gpt")).otherwise(r)
    listed = lambda name, *fields: F.to_json(F.struct(F.transform(m, lambda t: F.struct(*[x(t).alias(k) for k, x in fields])).alias(name)))
    plain, r = {k: (lambda t, k=k: t[k]) for k in ("role", "text")}, lambda t: theirs(t["role"])
    messages = listed("messages", ("role", plain["role"]), ("content", plain["text"]))
    with_text = listed("messages", ("role", plain["role"]), ("text", plain["text"]))
    with_from = listed("conversations", ("from", r), ("value", plain["text"]))
    flat = lambda *fields: F.to_json(F.struct(*[x.alias(k) for k, x in fields]))
    pair = (F.size(m) == 2) & (role(0) == "user") & (role(1) == "assistant")
    three = (F.size(m) == 3) & (role(0) == "system") & (role(1) == "user") & (role(2) == "assistant")
    usual = F.forall(m, lambda t: t["role"].isin("user", "assistant", "system"))
    record = (
        F.when(pair & (at(5) == 0), flat(("prompt", text(0)), ("response", text(1))))
        .when(pair & (at(5) == 1), flat(("instruction", text(0)), ("output", text(1)), ("id", F.col("conv_id"))))
        .when(pair & (at(5) == 2), flat(("question", text(0)), ("answer", text(1))))
        .when(three & (at(2) == 0), flat(("system", text(0)), ("prompt", text(1)), ("response", text(2))))
        .when(usual & (at(3) == 0), with_from)
        .when(at(2) == 0, messages)
        .otherwise(with_text)
    )
    return conversations.select("conv_id", record.alias("record"))


#: A conversation made of control strings, in a layout of its own.
PLANTED = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every conversation and conversation -1, as JSON records of many layouts, formatted; digests of what is read back."""
    own = as_json(records(table(spark, sf_dir, "conversations")))
    both = F.to_json(F.struct(F.lit(PLANTED).alias("prompt"), F.lit(PLANTED).alias("completion")))
    planted = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), both.alias("record"))
    turns = canonical_json(own.unionByName(planted), "record", ("conv_id",))
    out = format_turns(turns).withColumn("read", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_mask")))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same in SQL, from the turns themselves.
ORACLE = rf"""
WITH rows AS (
  SELECT conv_id, false AS planted, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, true, 0, 'user', '{PLANTED}'
  UNION ALL SELECT -1, true, 1, 'assistant', '{PLANTED}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length(regexp_replace(role, '{_PLAIN}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '{_PLAIN}', '\1\\\2\3', 'g'))
      + {len(START) + len(SEP) + len(END)})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id, planted
"""
