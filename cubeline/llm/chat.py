"""Chat formatting by schema fingerprints.

A record is a JSON object in one of several layouts: prompt and completion,
instruction with input and output, a list of messages, or one message a record.
Its nested field paths (list items as ``[]``), as far as any layout speaks of them,
are sorted and hashed; the hash is looked up in a registry of declarative mappings
that yield canonical turns ``(conv_id, turn, role, text, conv_key)``. The registry
is filled beforehand with the fingerprints of every layout: its required paths with
each choice of its optional ones. Only a fingerprint that is in none of these, as
of a record that mixes layouts, is registered when first met, with the first layout
whose required paths it holds.

Turns are written as ``<|im_start|>role\\ntext<|im_end|>\\n``. A backslash in a
text is doubled and ``<|`` becomes ``<\\|``, so no text can hold a control string,
and the escapes are undone exactly; in roles a line feed becomes ``\\n`` as well.
The loss mask covers the escaped text of each assistant turn.

Formatted conversations come in parts of whole turns, in order, so that one
conversation may hold any number of turns: no group is gathered anywhere, rows
are sorted by conversation and turn (on disk, if need be) and stream through. One
conversation is one task's work, as its digests are of its turns in order.

Defined cases: a null text or role is empty; turns of equal number are in order
of role and text, and repeated rows stay; a null conversation id is a
conversation of its own. An id that is a whole number of 64 bits, or text of one, is
``conv_id``; other text is ``conv_key``, with a null ``conv_id``. Rejected, with a
reason, are records that are no JSON object (``malformed``), of no known layout
(``layout``), with an id (``id``) or number of a turn (``turn``) of another kind,
with messages that are no list or an item that is no object (``messages``), and
null ones (``null``). An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "conv_id long, turn long, role string, text string"
PARTS = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:long,end:long>>, conv_key string"
#: Characters of a part, if a single turn is not longer.
PART_CHARS = 1 << 18


@dataclass(frozen=True)
class Layout:
    """Where turns are: either a list of messages, or fields that are one turn each.

    turns: (role, paths joined by blank lines). messages: path of the list, with
    the fields of role and text and the canonical names of roles. optional: paths
    that a record of this layout may lack, beside those of its id.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    conv_id: tuple[str, ...] = ("conv_id", "id")
    turn: str | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    messages: str | None = None
    role: str | None = None
    text: str | None = None
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))


#: In order of precedence.
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), messages="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), messages="conversations", role="from", text="value"),
    Layout("message", ("role", "text"), ("turn",), turn="turn", role="role", text="text"),
    Layout("instruction", ("instruction", "output"), ("system", "input"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt", ("prompt", "completion"), ("system",), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ("question", "answer"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
)


def field_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else str(k))} or {at}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, at + "[]")} or {at + "[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _heads(layout: Layout) -> tuple[str, ...]:
    """The required paths and, of a list of messages, the list without items."""
    return (*layout.required, f"{layout.messages}[]") if layout.messages else layout.required


def choose_layout(paths: set[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    return next((x for x in layouts if paths.issuperset(x.required) or x.messages and not paths.isdisjoint((f"{x.messages}[]", x.messages))), None)


class Rejected(ValueError):
    """reason: why a record yields no turns."""


class Registry:
    """Fingerprints and their mappings."""

    MOST = 10_000

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.layouts = layouts
        self.known = frozenset(p for x in layouts for p in (*_heads(x), *x.optional, *x.conv_id, *filter(None, (x.messages,))))
        self.mappings: dict[str, Callable | None] = {}
        for layout in layouts:
            may = (*layout.conv_id, *layout.optional)
            heads = [layout.required, *([_heads(layout)[-1:]] if layout.messages else [])]
            for head in heads:
                for chosen in range(1 << len(may)):
                    self.register({*head, *(p for k, p in enumerate(may) if chosen >> k & 1)})

    def own(self, paths: set[str]) -> set[str]:
        """The paths that a layout speaks of; what is nested deeper counts as the field that holds it."""
        found = set()
        for path in paths:
            while path not in self.known and (cut := max(path.rfind("."), path.rfind("["))) > 0:
                path = path[:cut]
            if path in self.known:
                found.add(path)
        # a list or its items count only if no path within is known
        return {p for p in found if not any(q != p and q.startswith((f"{p}.", f"{p}[")) for q in found)}

    def register(self, paths: set[str]) -> Callable | None:
        """The mapping of these paths, from now on found by their fingerprint."""
        if len(self.mappings) > self.MOST:
            self.mappings.clear()
        own = self.own(paths)
        found = choose_layout(own, self.layouts)
        mapping = self.mappings[fingerprint(own)] = found and compile_layout(found)
        return mapping

    def turns(self, record: str | None) -> list[tuple]:
        """Canonical turns of a record; raises Rejected."""
        if record is None:
            raise Rejected("null")
        try:
            value = json.loads(record)
        except (ValueError, RecursionError):
            raise Rejected("malformed") from None
        if not isinstance(value, dict):
            raise Rejected("malformed")
        paths = self.own(field_paths(value))
        mark = fingerprint(paths)
        mapping = self.mappings[mark] if mark in self.mappings else self.register(paths)
        if mapping is None:
            raise Rejected("layout")
        return mapping(value)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _whole(value) -> int | None:
    """A whole number of 64 bits, or text of one; else None."""
    if isinstance(value, bool) or not isinstance(value, int | str):
        return None
    if isinstance(value, str):
        if not re.fullmatch(r"-?(0|[1-9][0-9]{0,18})", value) or value == "-0":
            return None
        value = int(value)
    return value if -(1 << 63) <= value < 1 << 63 else None


def compile_layout(layout: Layout) -> Callable[[dict], list[tuple]]:
    """record -> [(conv_id, turn, role, text, conv_key)]."""
    roles = dict(layout.roles)

    def key(record: dict) -> tuple[int | None, str | None]:
        found = next((record[k] for k in layout.conv_id if record.get(k) is not None), None)
        number = _whole(found)
        if found is not None and number is None and not isinstance(found, str):
            raise Rejected("id")
        return number, found if number is None else None

    if layout.messages:

        def said(record):
            listed = record.get(layout.messages) or []
            if not isinstance(listed, list) or not all(isinstance(m, dict) for m in listed):
                raise Rejected("messages")
            return [(k, roles.get(_text(m.get(layout.role)), _text(m.get(layout.role))), _text(m.get(layout.text))) for k, m in enumerate(listed)]

    elif layout.turns:

        def said(record):
            out = [(role, [record[p] for p in paths if record.get(p) not in (None, "")], any(p in record for p in paths)) for role, paths in layout.turns]
            out = [(role, "\n\n".join(map(_text, values))) for role, values, there in out if values or there and role != "system"]
            return [(k, *x) for k, x in enumerate(out)]

    else:

        def said(record):
            role, at = _text(record.get(layout.role)), record.get(layout.turn)
            number = 0 if at is None else _whole(at)
            if number is None:
                raise Rejected("turn")
            return [(number, roles.get(role, role), _text(record.get(layout.text)))]

    def turns(record):
        number, text = key(record)
        return [(number, *x, text) for x in said(record)]

    return turns


def read_records(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """TURNS and conv_key of JSON records, in any mixture of layouts, and ``record`` and ``reason``: null, but for a row for each rejected record."""
    ready = Registry(layouts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(0).to_pylist():
                try:
                    out += [(*x, None, None) for x in ready.turns(value)]
                except Rejected as e:
                    out.append((None,) * 5 + (value, str(e)))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), *(pa.string(),) * 5)
            yield pa.RecordBatch.from_arrays([pa.array(_sound(c) if t == pa.string() else c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "role", "text", "conv_key", "record", "reason"])

    return records.select(F.col(f"`{record}`").alias("r")).mapInArrow(rows, f"{TURNS}, conv_key string, record string, reason string")


def _sound(column) -> list:
    """Texts without half surrogate pairs, which JSON escapes can make and no column can hold; they become U+FFFD."""
    return [t if t is None or t.isascii() else t.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for t in column]


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, strict: bool = True) -> DataFrame:
    """TURNS and conv_key of JSON records. A rejected record (but a null one) raises an error or, unless strict, yields no turns."""
    read = read_records(records, record, layouts)
    if strict:
        said = F.concat(F.lit("record rejected, "), "reason", F.lit(": "), F.substring("record", 1, 200))
        read = read.withColumn("reason", F.when(F.col("reason") == "null", "null").when(F.col("reason").isNotNull(), F.raise_error(said)))
    return read.filter("reason is null").drop("record", "reason")


def rejected_records(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(record, reason)."""
    return read_records(records, record, layouts).filter("reason is not null").select("record", "reason")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unrole(role: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turns(turns: DataFrame, roles_in_loss: tuple[str, ...] = ("assistant",), part_chars: int = PART_CHARS) -> DataFrame:
    """PARTS of canonical turns (TURNS, conv_key if there): formatted text and, in code points within the part, its loss mask.

    Within a partition the parts of a conversation follow each other in order.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, n, size, out, loss = None, -1, 0, 0, [], []
        begun = False
        done: list[tuple] = []

        def flush():
            nonlocal n, size, out, loss
            if n:
                done.append((conv[0], part, n, "".join(out), loss, conv[1]))
            n, size, out, loss = 0, 0, [], []

        for batch in batches:
            for c, text_id, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                head, body = f"{START}{_role(role or '')}\n", escape(text or "")
                if not begun or (c, text_id) != conv:
                    flush()
                    conv, part, begun = (c, text_id), 0, True
                elif size + len(head) + len(body) > part_chars:
                    flush()
                    part += 1
                if (role or "") in roles_in_loss:
                    loss.append({"start": size + len(head), "end": size + len(head) + len(body)})
                out.append(f"{head}{body}{END}\n")
                n += 1
                size += len(out[-1])
                if len(done) >= 256:
                    yield _part_batch(done)
                    done = []
        flush()
        if done:
            yield _part_batch(done)

    if "conv_key" not in turns.columns:
        turns = turns.withColumn("conv_key", F.lit(None).cast("string"))
    said = turns.select("conv_id", "conv_key", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # the number of a turn is only needed for the order
    sorted_ = said.repartition("conv_id", "conv_key").sortWithinPartitions("conv_id", "conv_key", "turn", "role", "text")
    return sorted_.select("conv_id", "conv_key", "role", "text").mapInArrow(rows, PARTS)


def _part_batch(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["conv_id", "part", "n_turns", "formatted", "loss", "conv_key"])


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def parse_formatted(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, unescaped."""
    return [(_unrole(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, conv_key string"


def formatted_digests(parts: DataFrame, ordered: bool = False) -> DataFrame:
    """DIGESTS: what is read back from PARTS, a row for each conversation; parts stream through.

    ordered: parts come straight from format_turns, whose order is used; else they are
    brought into order by a shuffle.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, done = None, None, []

        def close():
            if now:
                done.append((key[0], now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4], key[1]))

        for batch in batches:
            for conv, formatted, loss, text_id in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if not now or (conv, text_id) != key:
                    close()
                    key, now = (conv, text_id), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_formatted(formatted):
                    now[0] += 1
                    now[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    text = unescape(formatted[span["start"] : span["end"]])
                    now[2] += len(text)
                    now[3].update(text.encode("utf-8", "surrogatepass"))
                now[4] += len(formatted)
            if len(done) >= 4096:
                yield _digest_batch(done)
                done = []
        close()
        yield _digest_batch(done)

    if not ordered:
        parts = parts.select("conv_id", "part", "formatted", "loss", "conv_key").repartition("conv_id", "conv_key").sortWithinPartitions("conv_id", "conv_key", "part")
    return parts.select("conv_id", "formatted", "loss", "conv_key").mapInArrow(rows, DIGESTS)


def _digest_batch(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
    columns = list(zip(*done, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in DIGESTS.split(", ")])
