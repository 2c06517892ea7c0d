"""Merging of overlapping spans.

Two forms of one operator: ``merge_column`` folds a document's array in place, with every resolution;
``merge_rows`` works on exploded rows with windows, for the default resolution, where an island's label is
an argmax. Adjacent spans (end == start) stay apart; the merged span is the union of its members.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.functions.spans import SPAN_DDL

RESOLUTIONS = ("highest_score", "longest_span", "presidio_priority")


def type_priorities(blocked=(), irreversible=()) -> dict[str, int]:
    """Blocked types outrank irreversible ones, which outrank the rest."""
    return {**{t: 1 for t in irreversible}, **{t: 2 for t in blocked}}


def priority_of(entity_type: Column, priorities: Mapping[str, int] | None) -> Column:
    out = F.lit(0)
    for t, p in (priorities or {}).items():
        out = F.when(entity_type == t, F.lit(p)).otherwise(out)
    return out


def _ordered(spans: Column) -> Column:
    """By start, longer first, then in detectors' order."""
    keyed = F.transform(spans, lambda e, i: F.struct(e["start"].alias("a"), (-e["end"]).alias("b"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(F.transform(keyed, lambda x: x)), lambda x: x["e"])


def _first_wins(a: Column, b: Column, resolution: str, priorities: Mapping[str, int] | None) -> Column:
    """True where the span so far keeps its label against the next one."""
    score = a["score"] >= b["score"]
    if resolution == "longest_span":
        rule = (a["end"] - a["start"]) >= (b["end"] - b["start"])
    elif resolution == "presidio_priority":
        own_a, own_b = a["source"] == "presidio", b["source"] == "presidio"
        rule = F.when(own_a != own_b, own_a).otherwise(score)
    else:
        rule = score
    pa, pb = priority_of(a["entity_type"], priorities), priority_of(b["entity_type"], priorities)
    return F.when(a["entity_type"] == b["entity_type"], score).when(pa != pb, pa > pb).otherwise(rule)


def merge_column(spans: Column, text: Column, strategy: str = "union", resolution: str = "highest_score", priorities: Mapping[str, int] | None = None) -> Column:
    """The merged spans of one text.

    ``intersection`` first keeps only spans that overlap one of another source, and always resolves by score.
    """
    if resolution not in RESOLUTIONS:
        raise ValueError(f"unknown resolution {resolution!r}")
    if strategy == "intersection":
        spans, resolution = confirmed(spans), "highest_score"
    elif strategy != "union":
        raise ValueError(f"unknown strategy {strategy!r}")
    state = f"struct<done:array<{SPAN_DDL}>,last:{SPAN_DDL}>"
    start = F.from_json(F.lit('{"done":[]}'), state)

    def step(a, e):
        last = a["last"]
        label = F.when(_first_wins(last, e, resolution, priorities), last).otherwise(e)
        end = F.greatest(last["end"], e["end"])
        joined = F.struct(
            label["entity_type"].alias("entity_type"), F.substring(text, last["start"] + 1, end - last["start"]).alias("text"), last["start"].alias("start"),
            end.alias("end"), label["score"].alias("score"), label["source"].alias("source"),
        )
        apart = last.isNull() | (e["start"] >= last["end"])
        done = F.when(last.isNotNull() & (e["start"] >= last["end"]), F.concat(a["done"], F.array(last))).otherwise(a["done"])
        return F.struct(done.alias("done"), F.when(apart, e).otherwise(joined).alias("last")).cast(state)

    return F.aggregate(_ordered(spans), start, step, lambda a: F.when(a["last"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["last"]))))


def confirmed(spans: Column) -> Column:
    """Spans that overlap a span of a different source."""
    return F.filter(spans, lambda e: F.exists(spans, lambda o: (o["source"] != e["source"]) & (o["start"] < e["end"]) & (e["start"] < o["end"])))


def merge_rows(rows: DataFrame, keys: list[str], priorities: Mapping[str, int] | None = None) -> DataFrame:
    """Islands of overlapping rows (keys, ord, entity_type, start, end, score, source) with their label.

    The running maximum of ends opens an island; its label is the argmax of (priority, score, first).
    """
    order = [F.col("start"), F.col("end").desc(), F.col("ord")]
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(w))
    rank = F.struct(priority_of(F.col("entity_type"), priorities).alias("p"), F.col("score").alias("s"), (-F.col("_n")).alias("n"))
    label = F.max_by(F.struct("entity_type", "score", "source"), rank)
    out = marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), label.alias("_l"))
    return out.select(*keys, F.col("_l.entity_type").alias("entity_type"), "start", "end", F.col("_l.score").alias("score"), F.col("_l.source").alias("source"))
