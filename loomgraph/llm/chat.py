"""Chat formatting by schema fingerprints (DataFrame functions only).

A record is a variant.  Its schema is the set of its nested field paths, over
all elements of its lists: every message has a shape of its own (its fields,
and those of its parts), and the record has its fields and the set of its
messages' shapes.  That is hashed to a fingerprint, and a literal map from
fingerprints to layouts selects the declarative mapping that yields canonical
turns (role, text); each message is mapped by its own shape.  Fields in IGNORED
carry no text and do not matter.  A record with any other set of paths is
refused rather than mapped in part: its layout is null, it has no turns, and
unknown_paths lists those of its paths that no layout names (none, where the
paths are known but do not come together in any layout).  A list of no messages
is a conversation of no turns.

A template writes turns to one string.  Control strings inside roles and texts
are escaped: the escape character becomes `\\0`, the n-th control string `\\` and
a letter.  No control string holds the escape character, so the replacements
can neither make nor hide one another and read_back() undoes them exactly.
The loss mask holds a span (start and length in code points) over the text of
each turn of the assistant.

A conversation's turns come together in one row, which is the result itself;
offsets are running sums over a window, so work grows with the turns alone.

Cases: null texts and roles are empty; turns are ordered by number, then role
and text, nulls first, so ties and repeated rows keep a fixed order and count
as turns; null conversation ids form one conversation; an empty table gives an
empty table; other columns are ignored by format_turns(); canonical() keeps
them, but for those named fingerprint, layout, turns and unknown_paths, which
its own replace; a null record is refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import free_name

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    start: str = "<|start|>"
    middle: str = "<|message|>"
    end: str = "<|end|>"
    #: Other tokenizers' control strings, which must not stand unescaped in a text either.
    others: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    assistant: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[tuple[str, str]]:
        strings = [self.start, self.middle, self.end, *self.others]
        return [(s, ESCAPE + chr(ord("a") + i)) for i, s in enumerate(strings)]

    def escape(self, text: Column) -> Column:
        text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
        for string, code in self.controls:
            text = F.replace(text, F.lit(string), F.lit(code))
        return text

    def unescape(self, text: Column) -> Column:
        for string, code in self.controls:
            text = F.replace(text, F.lit(code), F.lit(string))
        return F.replace(text, F.lit(ESCAPE + "0"), F.lit(ESCAPE))

    def write(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.start), self.escape(role), F.lit(self.middle), self.escape(text), F.lit(self.end))


def _get(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _pair(user: str, assistant: str):
    return lambda v: F.array(_turn(F.lit("user"), _get(v, f"$.{user}")), _turn(F.lit("assistant"), _get(v, f"$.{assistant}")))


def _text(m: Column) -> Column:
    """The content of a message: a string, or the texts of its parts joined."""
    parts = F.try_variant_get(m, "$.content", "array<variant>")
    one = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.try_variant_get(p, "$", "map<string,variant>").isNull(), F.try_variant_get(p, "$", "string")), F.lit(""))
    return F.when(parts.isNotNull(), F.array_join(F.transform(parts, one), "")).otherwise(_get(m, "$.content"))


def _messages(v: Column) -> Column:
    return F.transform(F.try_variant_get(v, "$.messages", "array<variant>"), lambda m: _turn(_get(m, "$.role"), _text(m)))


def _from_value(v: Column) -> Column:
    def one(m: Column) -> Column:
        name = _get(m, "$.from")
        return _turn(F.when(name == "human", "user").when(name == "gpt", "assistant").otherwise(name), _get(m, "$.value"))

    return F.transform(F.try_variant_get(v, "$.conversations", "array<variant>"), one)


def _instruction(v: Column) -> Column:
    given = _get(v, "$.input")
    user = F.when(given == "", _get(v, "$.instruction")).otherwise(F.concat(_get(v, "$.instruction"), F.lit("\n"), given))
    return F.array(_turn(F.lit("user"), user), _turn(F.lit("assistant"), _get(v, "$.output")))


#: Fields of records, messages and parts that carry no text of the conversation.
IGNORED = ("id", "ids", "source", "dataset", "lang", "language", "type")
#: Shapes of messages: sorted fields; [] marks a list, [].x a field of its objects and []= its plain values.
CHAT = ("content,role", "content[],role", "content[],content[].text,role", "content[],content[]=,role", "content[],content[].text,content[]=,role")
SHARE = ("from,value",)
#: layout: (fields it needs, fields it may have, shapes of its messages, mapping to turns)
LAYOUTS = {
    "row_text": (("role", "text"), (), (), lambda v: F.array(_turn(_get(v, "$.role"), _get(v, "$.text")))),
    "row_content": (("role", "content"), (), (), lambda v: F.array(_turn(_get(v, "$.role"), _get(v, "$.content")))),
    "messages": (("messages[]",), ("system",), CHAT, _messages),
    "from_value": (("conversations[]",), ("system",), SHARE, _from_value),
    "instruction": (("instruction", "output"), ("input", "system"), (), _instruction),
    "prompt_completion": (("prompt", "completion"), ("system",), (), _pair("prompt", "completion")),
    "prompt_response": (("prompt", "response"), ("system",), (), _pair("prompt", "response")),
    "question_answer": (("question", "answer"), ("system",), (), _pair("question", "answer")),
}


def _some(items: tuple[str, ...]):
    return chain.from_iterable(combinations(items, n) for n in range(len(items) + 1))


def _schemas(need: tuple[str, ...], may: tuple[str, ...], shapes: tuple[str, ...]):
    """All sets of paths and message shapes that a layout stands for."""
    return ([*need, *fields, *(f"{need[0]}{{{s}}}" for s in some)] for fields in _some(may) for some in _some(shapes))


#: Every path that some layout names, without the braces around shapes.
KNOWN_PATHS = sorted(
    {f for need, may, *_ in LAYOUTS.values() for f in (*need, *may)} | {f"{need[0]}.{f}" for need, _, shapes, _ in LAYOUTS.values() for s in shapes for f in s.split(",")}
)


def _hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def _fields(v: Column) -> Column:
    """(key, value) of an object's fields that matter, or null for anything else."""
    return F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: ~e["key"].isin(*IGNORED))


def _below(e: Column, in_list) -> Column:
    """The paths of a field: a list with what in_list says of it, an object with its keys, or the field alone."""
    key, items, inner = e["key"], F.try_variant_get(e["value"], "$", "array<variant>"), _fields(e["value"])
    listed = F.concat(F.array(F.concat(key, F.lit("[]"))), F.array_distinct(in_list(key, items)))
    nested = F.transform(inner, lambda x: F.concat(key, F.lit("."), x["key"]))
    return F.when(items.isNotNull(), listed).when(F.size(nested) > 0, nested).otherwise(F.array(key))


def _part_paths(key: Column, items: Column) -> Column:
    """Paths of the objects of a list inside a message, and []= for its plain values."""
    one = lambda p: F.coalesce(F.transform(_fields(p), lambda x: F.concat(key, F.lit("[]."), x["key"])), F.array(F.concat(key, F.lit("[]="))))
    return F.flatten(F.transform(items, one))


def shape(message: Column) -> Column:
    """A message's sorted field paths in one string, or = for a plain value."""
    paths = F.flatten(F.transform(_fields(message), lambda e: _below(e, _part_paths)))
    return F.coalesce(F.array_join(F.array_sort(paths), ","), F.lit("="))


def _shapes(key: Column, items: Column) -> Column:
    return F.transform(items, lambda m: F.concat(key, F.lit("[]{"), shape(m), F.lit("}")))


def schema(record: Column) -> Column:
    """A record's paths, and the shapes of its lists' elements; null for what is no object."""
    return F.flatten(F.transform(_fields(record), lambda e: _below(e, _shapes)))


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant, over all elements of its lists."""
    return _hash(F.coalesce(schema(record), F.array().cast("array<string>")))


def _flat(paths: Column) -> Column:
    """The paths of a schema one by one, shapes taken apart."""
    one = lambda p: F.when(F.contains(p, F.lit("{")), F.transform(F.split(F.regexp_extract(p, r"\{(.*)\}$", 1), ","), lambda f: F.concat(F.substring_index(p, "{", 1), F.lit("."), f))).otherwise(F.array(p))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(paths, one))))


def canonical(records: DataFrame, record: Column) -> DataFrame:
    """The records with columns fingerprint, layout, turns (array of role and text) and unknown_paths."""
    known = [x for name, (need, may, shapes, _) in LAYOUTS.items() for paths in _schemas(need, may, shapes) for x in (_hash(F.array(*map(F.lit, paths))), F.lit(name))]
    at, paths = free_name(records, "record"), free_name(records, "schema_paths")
    empty = F.array().cast("array<string>")
    out = records.withColumn(at, record).withColumn(paths, F.coalesce(schema(F.col(at)), empty)).withColumn("fingerprint", _hash(F.col(paths)))
    out = out.withColumn("layout", F.element_at(F.create_map(*known), F.col("fingerprint")))
    v = F.col(at)

    def turns_of(layout: Column) -> Column:
        turns = F.array().cast("array<struct<role:string,text:string>>")
        for name, (_, may, _, make) in LAYOUTS.items():
            made = make(v)
            if "system" in may:
                system = _get(v, "$.system")
                made = F.when(system != "", F.concat(F.array(_turn(F.lit("system"), system)), made)).otherwise(made)
            turns = F.when(layout == name, made).otherwise(turns)
        return turns

    # The layout is bound to a variable, or each branch would work it out anew.
    turns = F.get(F.transform(F.array("layout"), turns_of), F.lit(0))
    unknown = F.when(F.col("layout").isNull(), F.array_except(_flat(F.col(paths)), F.array(*map(F.lit, KNOWN_PATHS)))).otherwise(empty)
    return out.withColumn("turns", turns).withColumn("unknown_paths", unknown).drop(at, paths)


def format_turns(turns: DataFrame, *, conv_col: str = "conv_id", order: tuple[str, ...] = ("turn",), template: Template = Template()) -> DataFrame:
    """One row per conversation: the id, n_turns, formatted and loss (a span for each turn, null outside the mask) from rows with role and text.

    A span has its start in the string, its length, and its offset in the turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(F.col(conv_col), *order, role.alias("role"), text.alias("text"))
    rows = rows.withColumn("escaped", template.escape(F.col("text"))).withColumn("head", F.concat(F.lit(template.start), template.escape(F.col("role")), F.lit(template.middle)))
    by = Window.partitionBy(conv_col).orderBy(*order, "role", "text")
    whole = F.length("head") + F.length("escaped") + len(template.end)
    rows = rows.withColumn("no", F.row_number().over(by)).withColumn("at", F.sum(whole).over(by.rowsBetween(Window.unboundedPreceding, 0)) - whole)
    span = F.when(F.col("role").isin(*template.assistant), F.struct((F.col("at") + F.length("head")).cast("bigint").alias("start"), F.length("escaped").cast("bigint").alias("length"), F.length("head").cast("bigint").alias("offset")))
    parts = F.array_sort(F.collect_list(F.struct("no", F.concat("head", "escaped", F.lit(template.end)).alias("part"), span.alias("span"))))
    grouped = rows.groupBy(conv_col).agg(parts.alias("parts"))
    return grouped.select(
        conv_col, F.size("parts").cast("bigint").alias("n_turns"), F.array_join(F.col("parts.part"), "").alias("formatted"), F.col("parts.span").alias("loss")
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """Turns (role, text) of a formatted string."""
    quoted = lambda s: "\\Q" + s + "\\E"
    pieces = F.split(formatted, quoted(template.end))

    def one(piece: Column) -> Column:
        halves = F.split(F.substring(piece, F.lit(len(template.start) + 1), F.length(piece)), quoted(template.middle))
        return _turn(template.unescape(F.get(halves, 0)), template.unescape(F.get(halves, 1)))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), one)


def masked_text(formatted: Column, loss: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped and joined; turn by turn, so that the work is linear in the string."""
    pieces = F.split(formatted, "\\Q" + template.end + "\\E")
    texts = F.zip_with(F.slice(pieces, F.lit(1), F.size(loss)), loss, lambda p, s: F.when(s.isNotNull(), F.substring(p, (s["offset"] + 1).cast("int"), s["length"].cast("int"))))
    return template.unescape(F.array_join(F.array_compact(texts), ""))
