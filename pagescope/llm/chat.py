"""Chat formatting: layouts recognised by a fingerprint of their nested field paths, one template, loss spans."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import tidy

#: Strings that mark turns here or in common templates. Fixed values.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "[TURN]", "[/TURN]")
#: A turn is "[TURN]role[/TURN]text</s>".
OPEN, NAMED, CLOSE = "[TURN]", "[/TURN]", "</s>"
_REST = "|".join(c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROLS)


def escape(text: Column) -> Column:
    """No control string is left in the result: backslashes are doubled, and each control string gets a backslash
    after its first character."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?={_REST})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths with their leaf kinds: `messages[].role:string`."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [f"{at}:{'integer' if isinstance(kind, T.IntegralType) else kind.typeName()}"]


def fingerprint(found: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """A layout of records. key: the field of the conversation's id, or None where a row is a conversation without one;
    turns: SQL of an array of (turn, role, text), its fields after `{at}`, or None where rows are turns of columns turn,
    role and text."""

    name: str
    fields: tuple[str, ...]
    key: str | None
    turns: str | None


def _list(items: str, role: str, text: str) -> str:
    return f"transform({{at}}{items}, (m, i) -> named_struct('turn', cast(i as bigint), 'role', m.{role}, 'text', m.{text}))"


def _pair(first: str, then: str, system: str | None = None) -> str:
    texts = ([("system", f"{{at}}{system}")] if system else []) + [("user", first), ("assistant", f"{{at}}{then}")]
    turns = [f"named_struct('role', '{r}', 'text', {t})" for r, t in texts]
    return f"transform(filter(array({', '.join(turns)}), t -> t.role <> 'system' or t.text <> ''), (m, i) -> named_struct('turn', cast(i as bigint), 'role', m.role, 'text', m.text))"


LAYOUTS = (
    Layout("turn_rows", ("conv_id:integer", "turn:integer", "role:string", "text:string"), "conv_id", None),
    Layout("messages", ("messages[].role:string", "messages[].content:string"), None, _list("messages", "role", "content")),
    Layout("id_messages", ("id:integer", "messages[].role:string", "messages[].content:string"), "id", _list("messages", "role", "content")),
    Layout("from_value", ("conversations[].from:string", "conversations[].value:string"), None, _list("conversations", "from", "value")),
    Layout("instruction", ("instruction:string", "input:string", "output:string"), None, _pair(r"if(coalesce({at}input, '') = '', {at}instruction, concat({at}instruction, '\n\n', {at}input))", "output")),
    Layout("instruction_only", ("instruction:string", "output:string"), None, _pair("{at}instruction", "output")),
    Layout("prompt_completion", ("prompt:string", "completion:string"), None, _pair("{at}prompt", "completion")),
    Layout("prompt_response", ("system:string", "prompt:string", "response:string"), None, _pair("{at}prompt", "response", "system")),
    Layout("question_answer", ("question:string", "answer:string"), None, _pair("{at}question", "answer")),
)
#: Names that layouts use for the same role. Fixed values.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fitting(found: list[str], layouts: tuple[Layout, ...] = LAYOUTS) -> list[Layout]:
    """The layout whose fingerprint is that of the field paths; else those whose fingerprint is that of the paths without
    the fields that the layout doesn't know, of these the ones with the most fields. A list without elements, whose path
    ends with `[]`, stands for the fields of its elements."""
    by_print = {fingerprint(list(x.fields)): x for x in layouts}
    if exact := by_print.get(fingerprint(found)):
        return [exact]
    empty = tuple(p for p in found if p.endswith("[]"))
    own = [(x, [f for f in x.fields if f in found or empty and f.startswith(empty)]) for x in layouts]
    fits = [x for x, fields in own if by_print.get(fingerprint(fields)) is x]
    return [x for x in fits if len(x.fields) == max(len(y.fields) for y in fits)]


def layout_of(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    """The one layout that fits the schema; none and more than one are errors."""
    found = paths(schema)
    best = fitting(found, layouts)
    if len(best) != 1:
        raise ValueError(f"{'several layouts fit' if best else 'no layout fits'} the fields {sorted(found)}")
    return best[0]


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows (layout, id, turns). Records without an id get a hash of layout, turns and place
    among equal records, so that each is a conversation by itself."""
    alone = turns.where("id is null").withColumn("same", F.xxhash64("layout", "turns"))
    nth = F.row_number().over(W.partitionBy("same").orderBy("same"))
    named = alone.withColumn("nth", nth).withColumn("id", F.when(F.col("nth") == 1, F.col("same")).otherwise(F.xxhash64("same", "nth")))
    whole = turns.where("id is not null").select("id", "turns").unionByName(named.select("id", "turns"))
    return whole.select(F.col("id").alias("conv_id"), F.inline("turns"))


def _plain(rows: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    role = F.coalesce(F.col("role"), F.lit(""))
    return rows.select("conv_id", "turn", F.coalesce(names[role], role).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def canonical(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text of any known layout. Records without an id are conversations by themselves, also equal
    ones. Null texts and roles become empty; role names of other layouts become system, user and assistant."""
    layout = layout_of(df.schema, layouts)
    if layout.turns is None:
        return _plain(df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
    key = F.col(layout.key) if layout.key else F.lit(None)
    return _plain(_numbered(df.select(F.lit(layout.name).alias("layout"), key.cast("long").alias("id"), F.expr(layout.turns.format(at="")).alias("turns"))))


def canonical_json(df: DataFrame, column: str = "json", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """`canonical` for JSON records of mixed layouts, by one scan: each record's field paths select its layout, by the rule
    that layout_of has, and that the schema to parse it with. Records that no layout fits, or several, come back in no row
    (see `unknown_json`)."""
    known = [x for x in layouts if x.turns]
    rows = df.select(json_layout(known)(F.col(column)).alias("layout"), F.col(column).alias("text"))
    parsed = [F.when(F.col("layout") == x.name, F.from_json("text", _schema(x.fields))).alias(f"r{i}") for i, x in enumerate(known)]
    turns, key = None, None
    for i, x in enumerate(known):
        of, own = F.col("layout") == x.name, F.expr(x.turns.format(at=f"r{i}."))
        turns = F.when(of, own) if turns is None else turns.when(of, own)
        if x.key:
            one = F.when(of, F.col(f"r{i}.{x.key}"))
            key = one if key is None else F.coalesce(key, one)
    id_ = (F.lit(None) if key is None else key).cast("long").alias("id")
    return _plain(_numbered(rows.where("layout is not null").select("layout", *parsed).select("layout", id_, turns.alias("turns"))))


def unknown_json(df: DataFrame, column: str = "json", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    return df.where(json_layout([x for x in layouts if x.turns])(F.col(column)).isNull())


def _schema(fields: tuple[str, ...]) -> T.StructType:
    tree: dict = {}
    for field in fields:
        path, _, kind = field.rpartition(":")
        node = tree
        *over, leaf = path.split(".")
        for step in over:
            node = node.setdefault(step, {})
        node[leaf] = T.LongType() if kind == "integer" else T.StringType()

    def build(node: dict) -> T.StructType:
        return T.StructType([T.StructField(k.removesuffix("[]"), v if not isinstance(v, dict) else T.ArrayType(build(v)) if k.endswith("[]") else build(v)) for k, v in node.items()])

    return build(tree)


def json_paths(record: object, at: str = "") -> Iterator[str]:
    """Nested field paths of a JSON value, as `paths`; those of empty lists end with `[]`, null counts as text."""
    if isinstance(record, dict):
        for k, v in record.items():
            yield from json_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(record, list):
        for v in record:
            yield from json_paths(v, f"{at}[]")
        if not record:
            yield f"{at}[]"
    else:
        yield f"{at}:{'boolean' if isinstance(record, bool) else 'integer' if isinstance(record, int) else 'double' if isinstance(record, float) else 'string'}"


def json_layout(layouts: list[Layout]) -> Callable[[Column], Column]:
    """Name of the one layout that fits each JSON record; null for others and for what is no JSON object."""

    @F.pandas_udf(T.StringType())
    def layout(texts: pd.Series) -> pd.Series:
        known: dict[tuple[str, ...], str | None] = {}

        def one(text: str | None) -> str | None:
            try:
                record = json.loads(text)
            except (TypeError, ValueError):
                return None
            found = tuple(sorted(set(json_paths(record)))) if isinstance(record, dict) else ()
            if found not in known:
                fits = fitting(list(found), tuple(layouts))
                known[found] = fits[0].name if len(fits) == 1 else None
            return known[found]

        return texts.map(one)

    return layout


def formatted(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, piece (the turn as the template writes it), loss_start and
    loss_length (code points within piece under the loss mask; length 0: none). A conversation's formatted text is
    its pieces in the order of turn, role, text, without anything between. Rows stay turns, so that no
    conversation, however long, has to fit in one value."""
    named = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(NAMED))
    text = escape(F.col("text"))
    loss = F.col("role") == "assistant"
    return turns.select("conv_id", "turn", "role", "text", F.concat(named, text, F.lit(CLOSE)).alias("piece"), F.when(loss, F.char_length(named)).otherwise(0).cast("long").alias("loss_start"), F.when(loss, F.char_length(text)).otherwise(0).cast("long").alias("loss_length"))


def read_back(pieces: DataFrame) -> DataFrame:
    """role, text and loss text of each piece, from the piece and its loss span only; columns got_*."""
    body = F.substring("piece", F.lit(len(OPEN) + 1), F.char_length("piece") - len(OPEN) - len(CLOSE))
    split = F.locate(NAMED, body)
    role, text = F.substring(body, F.lit(1), split - 1), F.substring(body, split + len(NAMED), F.char_length(body))
    return pieces.withColumns({"got_role": unescape(role), "got_text": unescape(text), "got_loss": unescape(F.substring("piece", F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int")))})


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(pieces: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, read back from its pieces. Rows are dealt by conversation and sorted by turn;
    each task reads them as a stream and holds three counts and two running hashes, whatever a conversation's
    length. Null conv_id is a conversation of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [f.split()[0] for f in DIGESTS.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, started = None, False
        n = loss = chars = 0
        turns_hash = loss_hash = hashlib.sha256()
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return batch

        for batch in batches:
            for conv, role, text, masked, size in zip(*(batch[c].to_pylist() for c in ("conv_id", "got_role", "got_text", "got_loss", "size")), strict=True):
                if not started or conv != now:
                    if started:
                        out.append((now, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars))
                    now, started, n, loss, chars = conv, True, 0, 0, 0
                    turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                n, loss, chars = n + 1, loss + len(masked), chars + size
                turns_hash.update(f"{role}\n{text}\n".encode())
                loss_hash.update(masked.encode())
            if len(out) >= 10_000:
                yield flush()
        if started:
            out.append((now, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars))
            yield flush()

    slim = read_back(pieces).select("conv_id", "turn", "got_role", "got_text", "got_loss", F.char_length("piece").cast("long").alias("size"))
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "got_role", "got_text").mapInArrow(tidy(run), DIGESTS)


def chat(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """`formatted` of `canonical`: the schema's fingerprint selects the mapping, the template writes the turns.

    Null text or role: empty. Turns of equal number: by role, then text; null turn numbers first. Repeated rows
    are turns by themselves. Empty table: no rows. Other columns are ignored, whatever their names, unless the
    schema then fits several layouts, which is an error."""
    return formatted(canonical(df, layouts))
