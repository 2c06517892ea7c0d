"""Text leaves of JSON documents: walking them out, and putting changed ones back.

Leaves are visited depth first in document order. Keys are never changed. A number is scanned as text when
it has seven digits or more; booleans and nulls are not. A string that holds JSON where the layout says so
(tool-call arguments) is walked inside, and falls back to plain text when it does not parse.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Digits from which a number is scanned.
MIN_DIGITS = 7
#: Keys whose string value is JSON.
JSON_KEYS = frozenset({"arguments"})

Path = tuple  # of keys and indexes; "$json" steps into a string that holds JSON


def parse(text: str):
    """JSON with the digits of long numbers kept."""
    return json.loads(text)


def leaves(value, path: Path = (), json_keys: frozenset[str] = JSON_KEYS) -> Iterator[tuple[Path, str, str]]:
    """(path, kind, text) of the leaves that are scanned."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, (*path, k), json_keys)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, (*path, i), json_keys)
    elif isinstance(value, str):
        if path and path[-1] in json_keys:
            try:
                inner = parse(value)
            except ValueError:
                inner = None
            if isinstance(inner, (dict, list)):
                yield from leaves(inner, (*path, "$json"), json_keys)
                return
        if value:
            yield path, "string", value
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        said = str(value)
        if sum(c.isdigit() for c in said) >= MIN_DIGITS:
            yield path, "number", said


def replace_leaves(value, change: Callable[[Path, str], str], path: Path = (), json_keys: frozenset[str] = JSON_KEYS):
    """The document with every scanned leaf replaced by ``change``; a number stays one unless it changed."""
    if isinstance(value, dict):
        return {k: replace_leaves(v, change, (*path, k), json_keys) for k, v in value.items()}
    if isinstance(value, list):
        return [replace_leaves(v, change, (*path, i), json_keys) for i, v in enumerate(value)]
    if isinstance(value, str):
        if path and path[-1] in json_keys:
            try:
                inner = parse(value)
            except ValueError:
                inner = None
            if isinstance(inner, (dict, list)):
                new = replace_leaves(inner, change, (*path, "$json"), json_keys)
                return value if new == inner else json.dumps(new, ensure_ascii=False)
        return change(path, value) if value else value
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        said = str(value)
        if sum(c.isdigit() for c in said) >= MIN_DIGITS:
            new = change(path, said)
            return value if new == said else new
    return value


def path_text(path: Path) -> str:
    """A readable path: keys with dots, indexes in brackets."""
    return re.sub(r"^\.", "", "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path))


def walk(df: DataFrame, keys: list[str], json_col: str, json_keys: frozenset[str] = JSON_KEYS) -> DataFrame:
    """(keys, ordinal, path, kind, text): a row per scanned leaf. Text that isn't JSON is one leaf at the root."""
    import pyarrow as pa

    n = len(keys)

    def run(batches):
        for b in batches:
            take, ordinal, path, kind, text = [], [], [], [], []
            for i, s in enumerate(b.column(n).to_pylist()):
                if s is None:
                    continue
                try:
                    found = list(leaves(parse(s), (), json_keys))
                except ValueError:
                    found = [((), "string", s)]
                for j, (p, k, t) in enumerate(found):
                    take.append(i)
                    ordinal.append(j)
                    path.append(path_text(p))
                    kind.append(k)
                    text.append(t)
            at = pa.array(take, pa.int64())
            cols = [b.column(c).take(at) for c in range(n)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ordinal, pa.int32()), pa.array(path, pa.string()), pa.array(kind, pa.string()), pa.array(text, pa.string())], [*keys, "ordinal", "path", "kind", "text"])

    rows = df.select(*keys, F.col(json_col).cast("string").alias("_json"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:n])
    return rows.mapInArrow(run, f"{kinds}, ordinal int, path string, kind string, text string")


def put_back(df: DataFrame, changed: DataFrame, keys: list[str], json_col: str, out: str = "document", json_keys: frozenset[str] = JSON_KEYS) -> DataFrame:
    """``df``'s keys and the document with the leaves of ``changed`` (keys, ordinal, new_text) put in."""
    new = changed.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "new_text"))).alias("_new"))

    @F.pandas_udf("string")
    def build(doc: pd.Series, new_texts: pd.Series) -> pd.Series:
        out_ = []
        for s, m in zip(doc, new_texts, strict=True):
            table = dict(m) if m is not None else {}
            if s is None or not table:
                out_.append(s)
                continue
            count = iter(range(1 << 60))
            try:
                tree = parse(s)
            except ValueError:
                out_.append(table.get(0, s))
                continue
            out_.append(json.dumps(replace_leaves(tree, lambda _, t, c=count, table=table: table.get(next(c), t), (), json_keys), ensure_ascii=False))
        return pd.Series(out_, dtype=object)

    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if on is None else on & same
    return df.join(new, on, "left").select(*keys, build(F.col(json_col), F.col("_new")).alias(out))
