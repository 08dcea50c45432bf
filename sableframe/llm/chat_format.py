"""Chat formatting by schema fingerprints (DataFrame functions only).

A record is JSON text. Its *fingerprint* is a hash of its nested field paths, whatever the scalar values
and their types; fields of names that no layout knows (an ``id``, a ``name``) are left out of it, to a depth of
``DEEP`` levels. A registry of declarative :class:`Layout` objects, each known by an example record, is
selected by equal fingerprints and turns the record into canonical turns (role, text). ``format_turns``
writes turns in one template with all control strings inside texts escaped; ``read_turns`` is its exact
inverse, and ``loss_text`` reads the text under the loss mask.

Defined results: null or malformed records, unknown layouts and records above the size that Spark parses
(between 17 and 21 million characters) give null turns and a null layout (they are kept; ``survey`` counts
their fingerprints); ``op4_chat_format`` takes the turns of such conversations from their rows. Null roles and texts are empty. An empty list of turns
formats to an empty string. Columns of the input are kept; ``layout``, ``turns``, ``formatted`` and
``loss_spans`` replace columns of those names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sableframe.llm.tables import let, table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that models take as control tokens; none is left unescaped inside a text.
CONTROL = (
    START, SEP, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
#: Names that layouts use for the three roles.
ROLE_ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LOSS_ROLE, DEEP = "assistant", 4


@dataclass(frozen=True)
class Layout:
    """How records of one shape become turns.

    ``example`` is a JSON record with all field paths of the shape. Either ``fields`` lists (role, paths)
    in the order of the turns, the texts at several paths being joined by a blank line, or ``items``
    is the path of a list of messages with their ``role`` and ``text`` fields.
    """

    name: str
    example: str
    fields: Sequence[tuple[str, tuple[str, ...]]] = ()
    items: str = ""
    role: str = "role"
    text: str = "content"
    aliases: dict = field(default_factory=dict, hash=False)


LAYOUTS = (
    Layout("messages", '{"messages":[{"role":"","content":""}]}', items="$.messages"),
    Layout("conversations", '{"conversations":[{"from":"","value":""}]}', items="$.conversations", role="from", text="value", aliases=ROLE_ALIASES),
    Layout("prompt_completion", '{"prompt":"","completion":""}', (("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Layout("prompt_response", '{"prompt":"","response":""}', (("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Layout("instruction", '{"instruction":"","output":""}', (("user", ("$.instruction",)), ("assistant", ("$.output",)))),
    Layout("instruction_input", '{"instruction":"","input":"","output":""}', (("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("question_answer", '{"question":"","answer":""}', (("user", ("$.question",)), ("assistant", ("$.answer",)))),
    Layout("system_question_response", '{"system_prompt":"","question":"","response":""}', (("system", ("$.system_prompt",)), ("user", ("$.question",)), ("assistant", ("$.response",)))),
)


def field_paths(record: Column) -> Column:
    """The nesting of a JSON record's fields, with every scalar type written as ``_``; null if malformed."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(shape, r"(?<=[:<] ?)(?!OBJECT|ARRAY)[A-Z][A-Z_ ]*(\(\d+, ?\d+\))?(?=[,>]|$)", "_")


def _names(layouts: Sequence[Layout]) -> str:
    """All field names of the layouts, as alternatives of a pattern."""
    found = {n for x in layouts for n in re.findall(r'"([^"]+)":', x.example)}
    return "|".join(map(re.escape, sorted(found)))


def known_paths(record: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """The field paths without fields whose names no layout has, from the innermost outwards."""
    other = rf"(?!(?:{_names(layouts)}):)[^:<>,]+: (?:_|VOID|OBJECT<>|ARRAY<(?:_|VOID|OBJECT<>)?>)"
    paths = field_paths(record)
    for _ in range(DEEP):
        paths = F.regexp_replace(F.regexp_replace(paths, rf", {other}(?=[,>])", ""), rf"(?<=<){other}(?:, |(?=>))", "")
    return paths


def fingerprint(record: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of a JSON record's known field paths; null if it is malformed."""
    paths = known_paths(record, layouts)
    return F.when(paths.isNotNull(), F.xxhash64(paths))


def _turns(record: Column, layout: Layout) -> Column:
    v = F.try_parse_json(record)
    text = lambda c: F.coalesce(c, F.lit(""))
    if layout.items:
        kind = f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>"

        def turn(m: Column) -> Column:
            role = text(m[layout.role])
            for alias, name in layout.aliases.items():
                role = F.when(m[layout.role] == alias, F.lit(name)).otherwise(role)
            return F.struct(role.alias("role"), text(m[layout.text]).alias("text"))

        return F.transform(F.try_variant_get(v, layout.items, kind), turn)
    made = []
    for role, paths in layout.fields:
        parts = F.filter(F.array(*[text(F.try_variant_get(v, p, "string")) for p in paths]), lambda x: x != "")
        made.append(F.struct(F.lit(role).alias("role"), F.array_join(parts, "\n\n").alias("text")))
    return F.array(*made)


def canonical_turns(df: DataFrame, record: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` and ``turns`` (array of role and text), selected by each record's fingerprint."""
    mark, name, turns = fingerprint(F.col(record), layouts), None, None
    for x in layouts:
        same = F.col("_mark") == fingerprint(F.lit(x.example), layouts)
        made = _turns(F.col(record), x)
        name = F.when(same, F.lit(x.name)) if name is None else name.when(same, F.lit(x.name))
        turns = F.when(same, made) if turns is None else turns.when(same, made)
    return df.withColumn("_mark", mark).withColumns({"layout": name, "turns": turns}).drop("_mark")


def survey(df: DataFrame, record: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Rows by field paths and layout: what a registry still lacks shows as a null layout."""
    return canonical_turns(df, record, layouts).groupBy(field_paths(F.col(record)).alias("paths"), "layout").count()


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of every control string."""
    quote = lambda s: "".join(c if c.isalnum() else "\\" + c for c in s)
    rest = "|".join(quote(s) for s in CONTROL)
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"(?=(?:{rest}))([<\\[])", "$1\\\\")


def unescape(text: Column) -> Column:
    """The exact inverse of :func:`escape`."""
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def format_turns(df: DataFrame, turns: str = "turns", loss_role: str = LOSS_ROLE) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``: start (from 0) and length, in code points, of each text under the loss mask."""
    piece = lambda t: F.struct(
        F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss")
    )
    step = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["head"])
        span = F.array(F.struct(start.alias("start"), F.length(p["body"]).cast("long").alias("length")))
        spans = F.when(p["loss"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((start + F.length(p["body"]) + len(END)).alias("at"), spans.alias("spans"))

    whole = df.withColumn("_pieces", F.transform(turns, piece))
    written = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return whole.withColumns({"formatted": written, "loss_spans": F.aggregate("_pieces", step, add)["spans"]}).drop("_pieces")


def read_turns(formatted: Column) -> Column:
    """The turns written in ``formatted``, with their texts unescaped."""
    literal = lambda s: "".join(c if c.isalnum() else "\\" + c for c in s)
    ended = F.filter(F.split(formatted, literal(END), -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        pair = F.split(F.substring(x, len(START) + 1, 2**31 - 1), literal(SEP), -1)
        return let(pair, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))

    return F.transform(ended, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    part = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, part), "")


def _said(rows: DataFrame) -> DataFrame:
    """(conv_id, said): the messages of each conversation by turn (nulls first), then by role and text."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("said"))


def _record() -> Column:
    return F.to_json(F.struct(F.transform("said", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")))


def dealt_record() -> Column:
    """A conversation's record in one of the layouts that can hold it, chosen by the hash of its conv_id.

    All layouts take part: those of two and three turns where the roles are theirs, ``instruction_input`` where the
    first text has a blank line to part it; some records carry fields that no layout knows.
    """
    turn, drawn = F.xxhash64("conv_id"), lambda k: F.pmod(F.xxhash64("conv_id", F.lit(k)), F.lit(k))
    roles = F.array_join(F.transform("said", lambda m: m["role"]), "\n")
    text = lambda i: F.get(F.col("said"), i)["content"]
    record = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    listed = lambda role, said, **more: F.transform("said", lambda m: F.struct(*[f.alias(k) for k, f in more.items()], role(m["role"]), said(m["content"])))
    plain = listed(lambda r: r.alias("role"), lambda t: t.alias("content"))
    named = listed(lambda r: r.alias("role"), lambda t: t.alias("content"), name=F.lit("n"), tool=F.struct(F.lit(1).alias("v")))
    spoken = listed(lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r).alias("from"), lambda t: t.alias("value"))
    blank = F.position(F.lit("\n\n"), text(0))
    parted = (blank > 1) & (F.length(text(0)) > blank + 1)
    two = [record(prompt=text(0), completion=text(1)), record(prompt=text(0), response=text(1)), record(id=turn, instruction=text(0), output=text(1)), record(question=text(0), answer=text(1), tags=F.array(F.lit("x")))]
    out = F.when((roles == "user\nassistant") & parted & (drawn(2) == 0), record(instruction=F.substring(text(0), F.lit(1), blank - 1), input=F.substring(text(0), blank + 2, F.length(text(0))), output=text(1)))
    for k, made in enumerate(two):
        out = out.when((roles == "user\nassistant") & (drawn(6) == k), made)
    out = out.when((roles == "system\nuser\nassistant") & (drawn(3) == 0), record(system_prompt=text(0), question=text(1), response=text(2)))
    aliased = F.exists("said", lambda m: m["role"].isin(list(ROLE_ALIASES)))
    out = out.when(~aliased & (drawn(5) < 2), record(conversations=spoken)).when(drawn(7) == 0, record(id=turn, messages=named))
    return out.otherwise(record(messages=plain))


def conversation_records(rows: DataFrame) -> DataFrame:
    """One ``messages`` record per conv_id; rows by turn (nulls first), then by role and text."""
    return _said(rows).select("conv_id", _record().alias("record"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, as records of all layouts, formatted and read back from the output."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    parsed = canonical_turns(_said(rows).withColumn("record", dealt_record()), "record")
    # A record above the parser's size has no turns, though it is well formed: its rows are taken as they are.
    same = F.transform("said", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("text")))
    made = format_turns(parsed.withColumn("turns", F.when(F.try_parse_json("record").isNull(), same).otherwise(F.col("turns"))))
    back = made.withColumns({"_back": read_turns(F.col("formatted")), "_loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("_back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle() -> str:
    """DuckDB SQL for :func:`op4_chat_format`; the length of an escaped text follows from counts."""
    probe = "</s>[INST] ok [/INST]"
    quote = lambda s: "".join(c if c.isalnum() else "\\" + c for c in s)
    hits = "|".join(quote(s) for s in CONTROL)
    escaped = lambda c: f"(length({c}) + length({c}) - length(replace({c}, '\\', '')) + len(regexp_extract_all({c}, '{hits}')))"
    return f"""
    WITH said AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{probe}'
      UNION ALL SELECT -7, 1, 'assistant', '{probe}')
    SELECT conv_id, count(*)::BIGINT AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum({len(START) + len(SEP) + len(END)} + {escaped('role')} + {escaped('text')})::BIGINT AS formatted_chars
    FROM said GROUP BY conv_id"""
