"""Restoring streamed replies: placeholders may be split over fragments.

The state of a channel is the text it holds back. A fragment is emitted up to the longest tail that could
still become a placeholder; a flush row, or the end of the stream, empties the channel.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stream_id string, channel string, seq long, text string"
STATE = "held string, mapping string"
#: The place of what a drained channel held.
LAST = 2**62


def json_escaped(text: str) -> str:
    """How a text reads inside a JSON string."""
    return json.dumps(text, ensure_ascii=False)[1:-1]


class Holdback:
    """Longest match first at each place; what may still become a fake is held."""

    def __init__(self, mapping: dict[str, str], held: str = "", is_json: bool = False):
        table = {f: o for f, o in mapping.items() if f}
        self.table = {json_escaped(f): json_escaped(o) for f, o in table.items()} if is_json else table
        self.by_first: dict[str, list[str]] = {}
        for f in sorted(self.table, key=len, reverse=True):
            self.by_first.setdefault(f[0], []).append(f)
        self.held = held

    def feed(self, fragment: str) -> str:
        text, out, at = self.held + fragment, [], 0
        while at < len(text):
            near = self.by_first.get(text[at])
            if near is None:
                end = at + 1
                while end < len(text) and text[end] not in self.by_first:
                    end += 1
                out.append(text[at:end])
                at = end
                continue
            rest = len(text) - at
            # The longest fake that is there is taken at once, even if the text may still become a longer one.
            hit = next((f for f in near if text.startswith(f, at)), None)
            if hit is not None:
                out.append(self.table[hit])
                at += len(hit)
            elif any(len(f) > rest and f.startswith(text[at:]) for f in near):
                break
            else:
                out.append(text[at])
                at += 1
        self.held = text[at:]
        return "".join(out)

    def flush(self) -> str:
        out, self.held = self.held, ""
        return out


def _run(idle_ms: int | None, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, mapping = state.get if state.exists else ("", "{}")
    if state.hasTimedOut:
        # The stream has gone quiet: what is held can't become a placeholder any more.
        state.remove()
        yield pd.DataFrame([(key[0], key[1], LAST, held)] if held else [], columns=["stream_id", "channel", "seq", "text"])
        return
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    out, tables = [], {}
    for r in rows.itertuples():
        if isinstance(r.mapping, str):
            mapping = r.mapping
        known = mapping, bool(r.is_json)
        if known not in tables:
            tables[known] = Holdback(json.loads(mapping), "", known[1])
        h = tables[known]
        h.held = held
        said = h.feed(r.fragment if isinstance(r.fragment, str) else "")
        if r.flush:
            said += h.flush()
        held = h.held
        if said:
            out.append((key[0], key[1], r.seq, said))
    state.update((held, mapping))
    if idle_ms is not None:
        state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame(out, columns=["stream_id", "channel", "seq", "text"])


def restore_stream(fragments: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Restored fragments of a streaming frame (stream_id, channel, seq, fragment, is_json, flush, mapping).

    ``mapping`` is a JSON object of fakes to originals, needed on a channel's first row. Fragments are put in
    order of ``seq`` within a micro-batch; a pure hold-back gives no row. With ``idle_ms`` a channel without
    fragments for that long is drained (its last row has the ``seq`` LAST) and its state removed, so a stream that
    breaks off loses no text and leaves nothing behind; the query then runs batches without data, too.
    """
    def run(key, batches, state):
        return _run(idle_ms, key, batches, state)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return fragments.groupBy("stream_id", "channel").applyInPandasWithState(run, OUT, STATE, "append", timeout)


def restore_batch(fragments: DataFrame) -> DataFrame:
    """The same over a finished table: (stream_id, channel, text), channels drained at their end."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        given = [m for m in rows["mapping"] if isinstance(m, str)]
        h = Holdback(json.loads(given[0]) if given else {}, "", bool(rows["is_json"].iloc[0]))
        said = "".join([h.feed(f or "") + (h.flush() if end else "") for f, end in zip(rows["fragment"], rows["flush"], strict=True)])
        return pd.DataFrame({"stream_id": [key[0]], "channel": [key[1]], "text": [said + h.flush()]})

    return fragments.groupBy("stream_id", "channel").applyInPandas(run, "stream_id string, channel string, text string")
