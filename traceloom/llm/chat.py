"""Chat formatting with schema fingerprints. Native: DataFrame functions only.

A record in any layout (flat prompt columns, instruction columns, nested message arrays) becomes a VARIANT.
Its schema is walked level by level, which gives every field's whole path from the root at any depth; their
sorted list is hashed to the record's fingerprint. Those of the paths that some layout names are hashed again,
and that hash is looked up among the layouts' own fingerprints: it selects the declarative mapping that reads
canonical turns (role, text) out of the record. ``fingerprint_table`` lists the fingerprints of a table of
records with the layouts that they select.
The template marks turns as

    <|im_start|>role\\ntext<|im_end|>\\n

and escapes what texts hold of it: a backslash goes between ``<`` and ``|`` wherever a text has ``<``, any
number of backslashes and ``|``, so that no text holds ``<|``; taking one backslash out again restores it.

Defined cases: a null role or text is empty; records whose paths fit no mapping, null records and those that
are no objects give no turns (an empty array); fields beside or within others that no mapping names at their
whole path change the fingerprint, but not the turns; an array of objects and other values has no paths within;
rows of a conversation are ordered by turn (null last), then role, then text, so that ties and
repeated rows have one order; a null conversation id is a conversation; columns that no mapping names are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """How canonical turns are read out of a record: either (role, path) pairs, or an array and its two fields."""

    name: str
    flat: tuple[tuple[str, str], ...] = ()
    array: str = ""
    role: str = ""
    text: str = ""
    #: Names of roles in this layout that have another canonical name.
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        if self.array:
            return tuple(sorted((f"{self.array}[].{self.role}", f"{self.array}[].{self.text}")))
        return tuple(sorted(path for _, path in self.flat))


LAYOUTS = (
    Layout("messages", array="messages", role="role", text="content"),
    Layout("turns", array="turns", role="role", text="text"),
    Layout("conversations", array="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("instruction", flat=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", flat=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt", flat=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", flat=(("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt", flat=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question", flat=(("user", "question"), ("assistant", "answer"))),
)


def fingerprint_of(paths: Column) -> Column:
    """Hash of sorted paths."""
    return F.xxhash64(F.array_join(paths, "\n"))


def field_paths(record: Column) -> Column:
    """The sorted whole paths of a VARIANT's fields: a, a.b, a[].b (in any element); odd names stay in backticks."""
    # The schema of a VARIANT reads OBJECT<a: ARRAY<OBJECT<b: STRING>>, c: BIGINT>; names and brackets are its walk.
    steps = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"(?:`(?:[^`]|``)*`|[^\s<>,:`]+): |OBJECT<|ARRAY<|>"), F.lit(0))
    texts = F.array().cast("array<string>")
    start = F.struct(texts.alias("open"), F.lit("").alias("at"), texts.alias("paths"))

    def walk(state: Column, step: Column) -> Column:
        """``open``: the paths of the brackets around this place, innermost last; ``at``: the path of the last name."""
        outer = F.coalesce(F.try_element_at(state["open"], F.lit(-1)), F.lit(""))
        name = F.concat(outer, F.when(outer == "", "").otherwise("."), F.regexp_replace(step, ": $", ""))
        inner = F.when(step == "ARRAY<", F.concat(state["at"], F.lit("[]"))).otherwise(state["at"])
        closed = F.struct(F.slice(state["open"], F.lit(1), F.greatest(F.lit(0), F.size(state["open"]) - 1)).alias("open"), state["at"].alias("at"), state["paths"].alias("paths"))
        opened = F.struct(F.array_append(state["open"], inner).alias("open"), inner.alias("at"), state["paths"].alias("paths"))
        named = F.struct(state["open"].alias("open"), name.alias("at"), F.array_append(state["paths"], name).alias("paths"))
        return F.when(step == ">", closed).when(step.isin("OBJECT<", "ARRAY<"), opened).otherwise(named)

    return F.coalesce(F.array_sort(F.aggregate(steps, start, walk, lambda state: state["paths"])), texts)


def selector(paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of those of a record's paths that some layout names; equal to the fingerprint of the layout that fits."""
    known = F.array(*(F.lit(path) for path in sorted({path for layout in layouts for path in layout.paths})))
    return fingerprint_of(F.array_sort(F.array_intersect(paths, known)))


def declared(layout: Layout) -> Column:
    return fingerprint_of(F.array(*(F.lit(path) for path in layout.paths)))


def layout_name(selected: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The layout that a selector names; null if there is none."""
    return F.coalesce(*(F.when(selected == declared(layout), F.lit(layout.name)) for layout in layouts))


def fingerprint_table(records: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(fingerprint, paths, layout, n_records): each schema of the records, and the mapping that it selects (null: none)."""
    paths = records.select(field_paths(F.col(record_col)).alias("paths")).select(fingerprint_of(F.col("paths")).alias("fingerprint"), "paths")
    counted = paths.groupBy("fingerprint", "paths").agg(F.count(F.lit(1)).alias("n_records"))
    return counted.select("fingerprint", "paths", layout_name(selector(F.col("paths"), layouts), layouts).alias("layout"), "n_records")


def canonical_turns(record: Column, selected: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """array<struct<role, text>> by the mapping that the selector names."""
    kind = "array<struct<role:string,text:string>>"
    chosen = F.lit(None).cast(kind)
    for layout in reversed(layouts):
        if layout.array:
            rows = F.try_variant_get(record, f"$.{layout.array}", f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
            turns = F.transform(rows, _reader(layout))
        else:
            turns = F.array(*(F.struct(F.lit(role).alias("role"), F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit("")).alias("text")) for role, path in layout.flat))
        chosen = F.when(selected == declared(layout), turns.cast(kind)).otherwise(chosen)
    return F.coalesce(chosen, F.array().cast(kind))


def _reader(layout: Layout):
    return lambda t: F.struct(_renamed(t[layout.role], layout.roles).alias("role"), F.coalesce(t[layout.text], F.lit("")).alias("text"))


def _renamed(role: Column, names: tuple[tuple[str, str], ...]) -> Column:
    role = F.coalesce(role, F.lit(""))
    for old, new in names:
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return role


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """Like texts; a line break, which ends a role, is written as a backslash and n."""
    return escape(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), r"\n", r"\\n"))


def unescape_role(role: Column) -> Column:
    # A line break is an n behind an odd number of backslashes; then every pair of backslashes is one.
    broken = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.regexp_replace(broken, r"\\\\", r"\\")


def render(turns: Column) -> Column:
    """The formatted conversation."""
    marked = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, marked), "")


def parse(formatted: Column) -> Column:
    """Read turns back from a formatted conversation: array<struct<role, text>>, texts unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.greatest(F.lit(0), F.size(F.split(formatted, r"<\|im_start\|>")) - 1))

    def turn(piece: Column) -> Column:
        body = F.substring_index(piece, END, 1)
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(body.substr(F.length(role) + 2, F.length(body))).alias("text"))

    return F.transform(pieces, turn)


def format_records(records: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``fingerprint``, ``turns`` and ``formatted`` to a table with a VARIANT column of records."""
    paths = records.withColumn("fingerprint", field_paths(F.col(record_col)))
    prints = paths.withColumn("fingerprint", F.struct(fingerprint_of(F.col("fingerprint")).alias("own"), selector(F.col("fingerprint"), layouts).alias("selected")))
    turns = prints.withColumn("turns", canonical_turns(F.col(record_col), F.col("fingerprint.selected"), layouts)).withColumn("fingerprint", F.col("fingerprint.own"))
    return turns.withColumn("formatted", render(F.col("turns")))


def conversations_as_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one record a conversation, in layouts that take turns.

    A question and its answer go into flat layouts as well as into arrays; other conversations into arrays. Which one
    of those that can hold a conversation it is follows from a hash of its id."""
    turn = F.struct(
        F.col("turn").isNull().alias("last"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("rows"))
    as_array = lambda role, text: F.transform("rows", lambda t: F.struct(t["role"].alias(role), t["content"].alias(text)))
    named = F.transform(
        "rows",
        lambda t: F.struct(F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"]).alias("from"), t["content"].alias("value")),
    )
    first, second = (F.element_at("rows", k)["content"] for k in (1, 2))
    record = lambda **fields: F.to_variant_object(F.struct(*(value.alias(name) for name, value in fields.items())))
    arrays = [record(messages=as_array("role", "content")), record(turns=as_array("role", "text")), record(conversations=named)]
    flat = [record(instruction=first, output=second), record(prompt=first, completion=second), record(prompt=first, response=second), record(question=first, answer=second)]
    # Roles that the third array renames can't be told from the renamed ones.
    plain = ~F.exists("rows", lambda t: t["role"].isin("human", "gpt"))
    pair = (F.size("rows") == 2) & (F.get("rows", F.lit(0))["role"] == "user") & (F.get("rows", F.lit(1))["role"] == "assistant")
    at = lambda n: F.pmod(F.xxhash64("conv_id"), n)
    kinds = F.when(pair, at(F.lit(len(arrays) + len(flat)))).when(plain, at(F.lit(len(arrays)))).otherwise(at(F.lit(len(arrays) - 1)))
    chosen = F.when(F.col("_kind") == 0, arrays[0])
    for k, own in enumerate([*arrays[1:], *flat], 1):
        chosen = chosen.when(F.col("_kind") == k, own)
    return ordered.withColumn("_kind", kinds).select("conv_id", chosen.alias("record"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text holds, read back from it: turns, and the text under the loss mask."""
    back = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("back"))
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under_loss = F.array_join(F.transform(F.filter("back", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(under_loss).cast("long").alias("loss_chars"),
        F.sha2(under_loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
