"""Whole streamed replies: blocks of server-sent events in, restored blocks out, with their framing kept.

A block is an event's lines without the blank line that ends it. Comments, ``[DONE]`` and data that is no JSON object
pass as they are; of other events only the data line changes. What is held back at the end of a content block, of a
choice or of the stream comes out before it. The two event protocols are planned in the JVM (``events.plan``); what
is left for Python is the state of a stream: the held text of each of its channels.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilspan.operators.gateway import THINKING
from veilspan.operators.restore import restore_tree
from veilspan.sources.requests import MESSAGE_FIELDS
from veilspan.sources.sse import data_of, format_event
from veilspan.streaming import events as E
from veilspan.streaming.restore import LAST, Holdback

#: Protocols whose chunks hold choices; the others are planned by ``events.plan``.
CHOICES = ("chat", "completions")
#: Fields of a choice that carry no payload of their own.
_FRAME = ("index", "delta", "finish_reason")
_PLANNED = "stream_id string, seq long, part int, block string, channel string, rest string"


class Reply:
    """The state of one stream."""

    def __init__(self, mapping: dict[str, str], protocol: str, held: dict[str, str] | None = None, model: str = ""):
        self.mapping, self.protocol, self.model = mapping, protocol, model
        self.held = dict(held or {})
        self._tables: dict[bool, Holdback] = {}

    def say(self, channel: str, text: str, is_json: bool) -> str:
        if is_json not in self._tables:
            self._tables[is_json] = Holdback(self.mapping, "", is_json)
        table = self._tables[is_json]
        table.held = self.held.get(channel, "")
        out = table.feed(text)
        self.held[channel] = table.held
        return out

    def rest(self, channels: Iterable[str] | None = None) -> list[tuple[str, str]]:
        """(channel, held text) of the channels that hold some (None: of all), emptied, in order of appearance."""
        names = list(self.held) if channels is None else [c for c in channels if c in self.held]
        return [(c, t) for c in names if (t := self.held.pop(c))]

    def _slots(self, choice: dict) -> Iterator[tuple[str, dict, str, bool]]:
        """(channel, holder, key, is JSON source) of the text places a choice has now."""
        i = choice.get("index") or 0
        if self.protocol == "completions":
            yield f"{i}:text", choice, "text", False
            return
        delta = choice["delta"]
        for name in ("content", *MESSAGE_FIELDS):
            yield f"{i}:{name}", delta, name, False
        if isinstance(delta.get("audio"), dict):
            yield f"{i}:audio", delta["audio"], "transcript", False
        for call in delta.get("tool_calls") or []:
            if isinstance(call, dict) and isinstance(call.get("function"), dict):
                yield f"{i}:tool:{call.get('index') or 0}", call["function"], "arguments", True
        if isinstance(delta.get("function_call"), dict):
            yield f"{i}:function", delta["function_call"], "arguments", True

    def _chunk_of(self, channel: str, rest: str) -> dict:
        """A chunk that says no more than what a channel held."""
        i, kind, *sub = channel.split(":")
        choice: dict = {"index": int(i), "finish_reason": None}
        if kind == "text":
            return {"object": "text_completion", "model": self.model, "choices": [{**choice, "text": rest}]}
        said = {"tool": {"tool_calls": [{"index": int(sub[0]) if sub else 0, "function": {"arguments": rest}}]}, "function": {"function_call": {"arguments": rest}}, "audio": {"audio": {"transcript": rest}}}
        return {"object": "chat.completion.chunk", "model": self.model, "choices": [{**choice, "delta": said.get(kind, {kind: rest})}]}

    def _visible(self, choice: dict, fed: bool) -> bool:
        """False where all that a choice had was text, and all of it is held back."""
        if not fed or choice.get("finish_reason") or self.protocol == "completions":
            return True
        more = any(v not in (None, "", []) for v in choice["delta"].values())
        return more or any(v is not None for k, v in choice.items() if k not in _FRAME)

    def chunk(self, data: dict) -> tuple[list[dict], bool]:
        """Restores a chunk of choices in place: the chunks that go before it, and whether it goes out itself."""
        self.model = data["model"] if isinstance(data.get("model"), str) else self.model
        before, visible = [], data.get("usage") is not None
        for choice in data["choices"]:
            if not isinstance(choice, dict):
                visible = True
                continue
            if self.protocol == "chat" and not isinstance(choice.get("delta"), dict):
                choice["delta"] = {}
            fed = False
            for channel, holder, key, is_json in list(self._slots(choice)):
                if isinstance(holder.get(key), str) and holder[key]:
                    holder[key] = self.say(channel, holder[key], is_json)
                    fed |= key == "content"
            if choice.get("finish_reason"):
                before += self._finish(choice)
            visible |= self._visible(choice, fed)
        return before, visible

    def _finish(self, choice: dict) -> list[dict]:
        """What a choice still holds joins its last chunk where that has, or may get, the place for it."""
        slots, apart = {c: (holder, key) for c, holder, key, _ in self._slots(choice)}, []
        mine = f"{choice.get('index') or 0}:"
        for channel, rest in self.rest([c for c in self.held if c.startswith(mine)]):
            if channel in slots:
                holder, key = slots[channel]
                holder[key] = (holder.get(key) or "") + rest
            elif channel.endswith(":audio"):
                choice["delta"]["audio"] = {"transcript": rest}
            else:
                apart.append(self._chunk_of(channel, rest))
        return apart

    def block(self, row) -> list[tuple[str | None, str | None, str | None]]:
        """(block, channel, rest) of what a block becomes; a rest without a block is worded by its protocol later."""
        lines = row.block.split("\n")
        at = [i for i, x in enumerate(lines) if x.startswith("data:")]
        payload = "\n".join(lines[i][5:].removeprefix(" ") for i in at)
        if payload.strip() == "[DONE]":
            return [*self.drain(), (row.block, None, None)]
        try:
            data = json.loads(payload) if at else None
        except ValueError:
            data = None
        if not isinstance(data, dict):
            return [(row.block, None, None)]

        def framed(new) -> str:
            if new == json.loads(payload):
                return row.block
            text = "data: " + json.dumps(new, ensure_ascii=False)
            return "\n".join(text if i == at[0] else x for i, x in enumerate(lines) if i == at[0] or i not in at)

        if self.protocol in CHOICES:
            if not isinstance(data.get("choices"), list) or not data["choices"]:
                return [(row.block, None, None)]
            before, visible = self.chunk(data)
            return [*[(_said(b), None, None) for b in before], *([(framed(data), None, None)] if visible else [])]
        out = [(None, c, t) for c, t in self.rest(None if row.flush_all else row.flush)]
        if row.action == "delta":
            # The place of a delta's text: inside an object of that name, or the value of that name itself.
            holder = data["delta"] if isinstance(data.get("delta"), dict) else data
            key = next((k for k in ("text", "partial_json", "delta") if isinstance(holder.get(k), str)), None)
            if key is not None:
                holder[key] = self.say(row.channel, holder[key], bool(row.is_json))
        elif row.action == "restore":
            data = restore_tree(data, self.mapping, THINKING)
        return [*out, (framed(data), None, None)]

    def drain(self) -> list[tuple[str | None, str | None, str | None]]:
        """The end of the stream, for channels that nothing closed."""
        rests = self.rest()
        return [(_said(self._chunk_of(c, t)), None, None) for c, t in rests] if self.protocol in CHOICES else [(None, c, t) for c, t in rests]


def _said(data: dict) -> str:
    return "data: " + json.dumps(data, ensure_ascii=False)


def _planned(blocks: DataFrame) -> DataFrame:
    cols = ["stream_id", "seq", "block", "protocol", "mapping"]
    plan = E.plan(blocks.select(*cols).withColumn("_data", data_of(F.col("block"))), "_data", "protocol")
    # An object whose JSON is broken has no plan; it is passed by all the same.
    return plan.select(*cols, "action", "channel", "is_json", "flush", F.coalesce("flush_all", F.lit(False)).alias("flush_all"))


def _worded(rows: DataFrame) -> DataFrame:
    event = E.flush_event(F.col("channel"), F.col("rest"))
    worded = F.regexp_replace(format_event(event, F.get_json_object(event, "$.type")), "\n+$", "")
    return rows.select("stream_id", "seq", "part", F.coalesce("block", worded).alias("block"))


def _rows(stream: str, seq: int, out: list, first: int = 0) -> list[tuple]:
    return [(stream, seq, first + i, *x) for i, x in enumerate(out)]


def restore_replies(blocks: DataFrame) -> DataFrame:
    """(stream_id, seq, part, block) of finished streams (stream_id, seq, block, protocol, mapping).

    ``protocol`` is chat, completions, messages or responses; ``mapping`` is a JSON object of fakes to originals,
    needed on a stream's first row, and a stream without one passes as it is. Null blocks are left out. A chunk whose
    text is all held back gives no row; held text that nothing closed comes after the last block.
    """

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        given = [m for m in rows["mapping"] if isinstance(m, str)]
        reply, out, seq = Reply(json.loads(given[0]) if given else {}, rows["protocol"].iloc[0]), [], 0
        for row in rows.itertuples():
            seq = row.seq
            out += _rows(key[0], seq, reply.block(row))
        last = sum(1 for x in out if x[1] == seq)
        out += _rows(key[0], seq, reply.drain(), last)
        return pd.DataFrame(out, columns=["stream_id", "seq", "part", "block", "channel", "rest"])

    return _worded(_planned(blocks.where("block is not null")).groupBy("stream_id").applyInPandas(run, _PLANNED))


def restore_replies_stream(blocks: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """The same over a streaming frame. Blocks are put in order of ``seq`` within a micro-batch. A stream without
    blocks for ``idle_ms`` is drained (its last rows have the ``seq`` LAST) and its state removed."""

    def run(key, batches, state: GroupState):
        columns = ["stream_id", "seq", "part", "block", "channel", "rest"]
        kept = json.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(_rows(key[0], LAST, Reply(**kept).drain()), columns=columns)
            return
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        given = [m for m in rows["mapping"] if isinstance(m, str)]
        reply = Reply(**kept) if kept else Reply(json.loads(given[0]) if given else {}, rows["protocol"].iloc[0])
        out = [x for row in rows.itertuples() for x in _rows(key[0], row.seq, reply.block(row))]
        state.update((json.dumps({"mapping": reply.mapping, "protocol": reply.protocol, "held": reply.held, "model": reply.model}),))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=columns)

    planned = _planned(blocks.where("block is not null"))
    return _worded(planned.groupBy("stream_id").applyInPandasWithState(run, _PLANNED, "kept string", "append", GroupStateTimeout.ProcessingTimeTimeout))
