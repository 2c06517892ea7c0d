"""Server-sent events as rows, and rows as server-sent events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def data_of(block: Column) -> Column:
    """The data lines of a block, joined."""
    return F.array_join(F.transform(F.filter(F.split(block, "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")


def blocks(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """(keys, seq, block): the events of event-stream texts as they stand; line ends may be \\n or \\r\\n."""
    found = F.filter(F.split(F.regexp_replace(text_col, "\r\n", "\n"), "\n\n"), lambda b: b != "")
    return df.select(*keys, F.posexplode(found).alias("seq", "block")).withColumn("seq", F.col("seq").cast("long"))


def events(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """(key, seq, event, data, is_json) of event-stream texts. Comments and [DONE] keep their data verbatim and
    are not JSON; line ends may be \\n or \\r\\n."""
    rows = blocks(df, text_col, [key])
    event = F.regexp_extract("block", r"(?m)^event: ?(.*)$", 1)
    data = data_of(F.col("block"))
    return rows.select(key, "seq", event.alias("event"), data.alias("data"), F.coalesce(data.rlike(r"^\s*[{\[]") & ~data.startswith("[DONE]"), F.lit(False)).alias("is_json"))


def format_event(data: Column, event: Column | None = None) -> Column:
    """One event as text."""
    lines = F.concat(F.lit("data: "), F.replace(data, F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n"))
    return lines if event is None else F.concat(F.when(F.coalesce(event, F.lit("")) == "", "").otherwise(F.concat(F.lit("event: "), event, F.lit("\n"))), lines)


DONE = "data: [DONE]\n\n"
