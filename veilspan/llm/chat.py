"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed to a fingerprint, which selects a declarative mapping from its
layout to canonical turns (position, role, text). Turns are then rendered with a template whose control
strings cannot occur inside texts: they are escaped reversibly, and the loss mask marks assistant texts.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Role names of other layouts and their canonical names.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """How one layout becomes turns.

    ``fields`` are (role, path) pairs in the order of the turns; ``each`` is (list path, role key, text key)
    for lists of messages, where a role is translated by ROLES. ``optional`` paths may be missing.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        own = [p for _, p in self.fields]
        if self.each:
            own += [f"{self.each[0]}[].{self.each[1]}", f"{self.each[0]}[].{self.each[2]}"]
        return own


LAYOUTS: tuple[Layout, ...] = (
    Layout("messages", (("system", "system"),), ("messages", "role", "content"), ("system",)),
    Layout("conversations", (("system", "system"),), ("conversations", "from", "value"), ("system",)),
    Layout("instruction", (("system", "system"), ("user", "instruction"), ("user+", "input"), ("assistant", "output")), None, ("system", "input")),
    Layout("prompt_completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), None, ("system",)),
    Layout("prompt_response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), None, ("system",)),
    Layout("question_answer", (("user", "question"), ("assistant", "answer")), None, ()),
    Layout("turn", (("role", "text"),), None, ("role",)),
)


def field_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value; list elements are ``[]``. Null fields count as present."""
    if isinstance(value, dict):
        out = set()
        for k, v in value.items():
            p = f"{prefix}.{k}" if prefix else k
            out |= field_paths(v, p) or {p}
        return out
    if isinstance(value, list):
        out = set()
        for v in value:
            out |= field_paths(v, f"{prefix}[]")
        return out or {f"{prefix}[]"}
    return {prefix} if prefix else set()


def fingerprint(paths) -> int:
    """64-bit hash of a set of paths."""
    return int.from_bytes(hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).digest(), "little", signed=True)


@lru_cache(maxsize=1)
def registry() -> tuple[dict[int, Layout], frozenset[str]]:
    """Fingerprints of every layout with each choice of its optional paths, and all paths that count."""
    known: dict[int, Layout] = {}
    for layout in LAYOUTS:
        paths = layout.paths() + (["role"] if layout.name == "turn" else [])
        for k in range(len(layout.optional) + 1):
            for out in itertools.combinations(layout.optional, k):
                known.setdefault(fingerprint([p for p in paths if p not in out]), layout)
    counted = {p for x in LAYOUTS for p in x.paths()} | {"role"}
    return known, frozenset(counted)


def _said(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def turns_of(record) -> tuple[int, str | None, list[tuple[str, str]]]:
    """(fingerprint, layout name or None, turns) of one record. Fields that no layout names are ignored; a
    record that fits no layout has no turns."""
    if not isinstance(record, dict):
        return 0, None, []
    known, counted = registry()
    mark = fingerprint(field_paths(record) & counted)
    layout = known.get(mark)
    if layout is None:
        return mark, None, []
    if layout.name == "turn":
        return mark, layout.name, [(_said(record.get("role")), _said(record["text"]))]
    turns: list[tuple[str, str]] = []
    for role, path in layout.fields:
        if path not in record:
            continue
        text = _said(record[path])
        if role == "user+":
            if text:
                turns[-1] = (turns[-1][0], f"{turns[-1][1]}\n\n{text}")
        else:
            turns.append((role, text))
    if layout.each:
        where, r, t = layout.each
        for m in record[where]:
            if isinstance(m, dict):
                role = _said(m.get(r))
                turns.append((ROLES.get(role, role), _said(m.get(t))))
    return mark, layout.name, turns


# Strings that steer common chat models.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END, ESCAPE = "<|im_start|>", "<|im_end|>\n", "␛"

_guard = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROL))))
_escaped = re.compile(f"{ESCAPE}(.)", re.DOTALL)


def escape(text: str) -> str:
    """Double the escape sign and put one after the first character of every control string."""
    return _guard.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the loss mask: code point ranges of the assistant texts."""
    out, at, loss = [], 0, []
    for role, text in turns:
        head = f"{START}{escape(role).replace(chr(10), ESCAPE + 'n')}\n"
        body = escape(text)
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), loss


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for piece in formatted.split(START)[1:]:
        head, _, rest = piece.partition("\n")
        turns.append((unescape(head), unescape(rest.removesuffix(END))))
    return turns


def to_turns(records: DataFrame, id_col: str, json_col: str, order_col: str | None = None) -> DataFrame:
    """(id, place, n, role, text, layout, fingerprint): canonical turns of JSON records.

    ``place`` is the record's ``order_col`` (0 without one) and n counts turns within the record. A record
    that is null, not JSON or of no known layout gives one row with null layout, role and text.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(6)]
            rows = []
            for i, s in enumerate(b.column(2).to_pylist()):
                try:
                    record = json.loads(s) if s is not None else None
                except ValueError:
                    record = None
                mark, name, turns = turns_of(record)
                for n, (role, text) in enumerate(turns) if name else [(0, (None, None))]:
                    rows.append(i)
                    for c, v in zip(cols, (n, role, text, name, mark, None), strict=True):
                        c.append(v)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())],
                ["_id", "place", "n", "role", "text", "layout", "fingerprint"],
            )

    place = F.col(order_col).cast("long") if order_col else F.lit(0).cast("long")
    rows = records.select(F.col(id_col).alias("_id"), place.alias("_place"), F.col(json_col).cast("string").alias("_json"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, place bigint, n int, role string, text string, layout string, fingerprint bigint")


def format_chats(turns: DataFrame) -> DataFrame:
    """(_id, n_turns, formatted, loss): one row per conversation; ``loss`` is array<struct<start,end>> in code
    points. Turns are ordered by (place, n), ties by role and text; rows without a layout are left out.

    A conversation is one output row, so it has to fit one; that is the only bound on a group.
    """
    import pyarrow as pa

    grouped = turns.where(F.col("layout").isNotNull()).groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("place", "n", "role", "text"))).alias("_turns"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = [render([(t["role"], t["text"]) for t in ts]) for ts in part.column(1).to_pylist()]
                spans = [[{"start": a, "end": e} for a, e in loss] for _, loss in made]
                sizes = pa.array([len(t) for t in part.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array([f for f, _ in made], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["_id", "n_turns", "formatted", "loss"])

    kind = turns.schema["_id"].dataType.simpleString()
    return grouped.mapInArrow(run, f"_id {kind}, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>")


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from ``formatted`` and ``loss`` alone: _id, n_turns,
    turns_sha256 (role, newline, text, newline per turn), loss_chars, loss_sha256, formatted_chars."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            for s, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(s)
                loss = "".join([unescape(s[x["start"] : x["end"]]) for x in spans])
                whole = "".join([f"{r}\n{t}\n" for r, t in turns])
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(s)))
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = chats.schema["_id"].dataType.simpleString()
    return chats.select("_id", "formatted", "loss").mapInArrow(run, f"_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
