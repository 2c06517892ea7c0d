"""Chat requests as rows of text leaves."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.operators.leaves import leaves, parse, path_text

#: Largest body that is accepted, in bytes.
MAX_BODY = 10_000_000


def within_limit(df: DataFrame, body_col: str, limit: int = MAX_BODY) -> DataFrame:
    return df.where(F.octet_length(body_col) <= limit)


def message_rows(df: DataFrame, request: str, body_col: str) -> DataFrame:
    """(request, ordinal, role, content) of the messages of chat bodies, in order; unknown fields are ignored."""
    schema = "struct<messages:array<struct<role:string,content:string>>>"
    rows = df.select(F.col(request), F.from_json(body_col, schema).alias("_b"))
    return rows.select(request, F.posexplode("_b.messages").alias("ordinal", "_m")).select(request, "ordinal", F.col("_m.role").alias("role"), F.col("_m.content").alias("content"))


def forwarded_fields(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns only; a column that is neither allowed nor all null is refused by name."""
    extra = [c for c in df.columns if c not in allowed]
    refused = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in extra] or [F.lit(None).cast("string")]), lambda x: x.isNotNull()), ", ")
    return df.select(*[c for c in df.columns if c in allowed], refused.alias("refused"))


#: Text fields of a message beside its content; replies carry them back in later requests.
MESSAGE_FIELDS = ("reasoning_content", "reasoning", "refusal")

Leaf = tuple  # scope, path, kind, text


class UnsupportedContent(ValueError):
    """Content of a shape that strict mode refuses; the message says where, never what."""


def _content(content, path: tuple, strict: bool) -> Iterator[tuple]:
    """A string, nothing, or a list of strings and typed parts. Text parts are scanned and other typed parts
    relayed; anything else is walked, or refused in strict mode."""
    if isinstance(content, list):
        for i, part in enumerate(content):
            at = (*path, i)
            if isinstance(part, dict) and isinstance(part.get("type"), str):
                if isinstance(part.get("text"), str):
                    yield from leaves(part["text"], (*at, "text"))
                elif strict and part["type"] in ("text", "input_text"):
                    raise UnsupportedContent(path_text(at))
            elif strict and not isinstance(part, str):
                raise UnsupportedContent(path_text(at))
            else:
                yield from leaves(part, at)
    elif isinstance(content, str) or (content is not None and not strict):
        yield from leaves(content, path)
    elif content is not None:
        raise UnsupportedContent(path_text(path))


def _chat(body: dict, system: bool, tools: bool, strict: bool) -> Iterator[Leaf]:
    for i, m in enumerate(body.get("messages") or []):
        at = ("messages", i)
        if not isinstance(m, dict) or (system and m.get("role") == "system"):
            continue
        found = [_content(m.get("content"), (*at, "content"), strict)]
        found += [leaves(m[f], (*at, f)) for f in MESSAGE_FIELDS if isinstance(m.get(f), str)]
        if isinstance(m.get("audio"), dict) and isinstance(m["audio"].get("transcript"), str):
            found.append(leaves(m["audio"]["transcript"], (*at, "audio", "transcript")))
        if not tools:
            calls = m.get("tool_calls") if isinstance(m.get("tool_calls"), list) else []
            named = [(c.get(k), (*at, "tool_calls", j, k)) for j, c in enumerate(calls) if isinstance(c, dict) for k in ("function", "custom")]
            for call, where in [*named, (m.get("function_call"), (*at, "function_call"))]:
                if isinstance(call, dict):
                    found += [leaves(call[f], (*where, f)) for f in ("arguments", "input") if call.get(f) is not None]
        for part in found:
            yield from ((0, *leaf) for leaf in part)
    prediction, search = body.get("prediction"), body.get("web_search_options")
    if isinstance(prediction, dict):
        yield from ((0, *leaf) for leaf in leaves(prediction.get("content"), ("prediction", "content")))
    if isinstance(search, dict):
        yield from ((0, *leaf) for leaf in leaves(search.get("user_location"), ("web_search_options", "user_location")))


def _completions(body: dict, *_) -> Iterator[Leaf]:
    """All prompts and the suffix share one mapping."""
    for name in ("prompt", "suffix"):
        yield from ((0, *leaf) for leaf in leaves(body.get(name), (name,)) if name == "prompt" or isinstance(body[name], str))


def _embeddings(body: dict, *_) -> Iterator[Leaf]:
    """Each input has a mapping of its own."""
    given = body.get("input")
    for i, x in enumerate(given if isinstance(given, list) else [given]):
        path = ("input", i) if isinstance(given, list) else ("input",)
        yield from ((i, *leaf) for leaf in leaves(x, path))


WALKS: dict[str, Callable[..., Iterator[Leaf]]] = {"chat": _chat, "completions": _completions, "embeddings": _embeddings}


def _walk(text: str | None, endpoint: str, options: tuple) -> tuple[dict | None, list[Leaf], str | None]:
    """(body, leaves, why it is refused)."""
    try:
        body = parse(text) if text is not None else None
        if not isinstance(body, dict):
            return None, [], "body"
        return body, list(WALKS[endpoint](body, *options)), None
    except UnsupportedContent as e:
        return None, [], str(e)
    except ValueError:
        return None, [], "body"


def request_leaves(df: DataFrame, key: str, body_col: str, endpoint: str, passthrough_system: bool = False, passthrough_tools: bool = False, strict: bool = False) -> DataFrame:
    """(key, scope, ordinal, path, kind, text, refused): the texts of a request that are scanned, in the order in
    which they count. Leaves of one ``scope`` share a mapping. A body that is no JSON object, or that strict mode
    refuses, gives one row with the place in ``refused`` and no text."""
    import pyarrow as pa

    options = (passthrough_system, passthrough_tools, strict)
    names = ["scope", "ordinal", "path", "kind", "text", "refused"]
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())

    def run(batches):
        for b in batches:
            take, rows = [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                _, found, refused = _walk(s, endpoint, options)
                mine = [(0, 0, None, None, None, refused)] if refused else [(scope, j, path_text(p), k, t, None) for j, (scope, p, k, t) in enumerate(found)]
                rows += mine
                take += [i] * len(mine)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["_key", *names])

    rows = df.select(F.col(key).alias("_key"), F.col(body_col).cast("string").alias("_body"))
    return rows.mapInArrow(run, f"_key {rows.schema[0].dataType.simpleString()}, scope int, ordinal int, path string, kind string, text string, refused string").withColumnRenamed("_key", key)


def _put(tree, path: tuple, text: str):
    """``tree`` with ``text`` at ``path``; a step "$json" goes into a string that holds JSON."""
    if not path:
        return text
    if path[0] == "$json":
        return json.dumps(_put(json.loads(tree), path[1:], text), ensure_ascii=False)
    tree[path[0]] = _put(tree[path[0]], path[1:], text)
    return tree


def put_leaves(df: DataFrame, changed: DataFrame, key: str, body_col: str, endpoint: str, passthrough_system: bool = False, passthrough_tools: bool = False, strict: bool = False, out: str = "body") -> DataFrame:
    """(key, body): each request with the leaves of ``changed`` (key, ordinal, new_text) put in; everything else
    is as it was. A refused request has a null body."""
    options = (passthrough_system, passthrough_tools, strict)
    new = changed.groupBy(F.col(key).alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "new_text"))).alias("_new"))

    @F.pandas_udf("string")
    def build(text: pd.Series, texts: pd.Series) -> pd.Series:
        done = []
        for s, m in zip(text, texts, strict=True):
            body, found, refused = _walk(s, endpoint, options)
            table = {j: t for j, t in (dict(m) if m is not None else {}).items() if t != found[j][3]} if not refused else {}
            for j, t in table.items():
                body = _put(body, found[j][1], t)
            done.append(None if refused else s if not table else json.dumps(body, ensure_ascii=False))
        return pd.Series(done, dtype=object)

    joined = df.join(new, F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.select(key, build(F.col(body_col), F.col("_new")).alias(out))
