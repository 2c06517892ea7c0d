"""Replacing spans: methods by type, numbered placeholders, mapping table, rebuilt texts.

Within a request the order of numbering is texts in order and, inside a text, from its end to its start.
The same original has one placeholder in a request, whatever types it was found under.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.operators.fakes import fake_table

# Fixed value: the shape of a placeholder literal.
PLACEHOLDER = r"<[^<>]{1,100}?_[0-9]+>"
IRREVERSIBLE = ("mask", "redact")
METHODS = ("placeholder", "fake_replacement", *IRREVERSIBLE)


@dataclass(frozen=True)
class Method:
    method: str = "placeholder"
    masking_char: str = "*"


@dataclass(frozen=True)
class Policy:
    """The method for all types and the overrides by type."""

    default: Method = Method()
    overrides: Mapping[str, Method] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if {m.method for m in (self.default, *self.overrides.values())} - set(METHODS):
            raise ValueError("methods are " + ", ".join(METHODS))

    def method_of(self, entity_type: Column) -> Column:
        out = F.lit(self.default.method)
        for t, m in self.overrides.items():
            out = F.when(entity_type == t, m.method).otherwise(out)
        return out

    def char_of(self, entity_type: Column) -> Column:
        out = F.lit(self.default.masking_char)
        for t, m in self.overrides.items():
            out = F.when(entity_type == t, m.masking_char).otherwise(out)
        return out


SHIPPED = Policy(overrides={"CREDIT_CARD": Method("mask"), "SECRET": Method("redact")})


def reserved_numbers(texts: DataFrame, request: str, text_col: str = "text") -> DataFrame:
    """(request, type, numbers): numbers of placeholder-shaped strings already in the request, by type.

    A type's numbers are collected once each; leading zeros keep a literal apart from an issued placeholder.
    """
    found = texts.select(request, F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(PLACEHOLDER), F.lit(0)))).alias("_p"))
    parts = found.select(F.col(request).alias("_rr"), F.regexp_extract("_p", r"^<(.*)_([0-9]+)>$", 1).alias("_rt"), F.regexp_extract("_p", r"^<(.*)_([0-9]+)>$", 2).alias("_rn"))
    short = parts.where((F.length("_rn") <= 9) & ~F.col("_rn").startswith("0"))
    return short.groupBy("_rr", "_rt").agg(F.sort_array(F.collect_set(F.col("_rn").cast("int"))).alias("_taken"))


def kth_free(k: Column, taken: Column) -> Column:
    """The k-th positive integer that is not in the sorted array ``taken``."""
    return F.aggregate(taken, k.cast("int"), lambda n, r: F.when(r <= n, n + 1).otherwise(n))


def mapping_table(rows: DataFrame, request: str, ordinal: str, policy: Policy = SHIPPED, reserved: DataFrame | None = None) -> DataFrame:
    """(request, original, entity_type, fake): what a request's reversible spans are replaced by.

    First occurrences come from an aggregation on (request, original), so a repeated value costs one row per
    map task; numbering is a window over a request's distinct originals only.
    """
    method = policy.method_of(F.col("entity_type"))
    back = rows.where(~method.isin(*IRREVERSIBLE))
    place = F.struct(F.col(ordinal).alias("o"), (-F.col("start")).alias("s"))
    first = back.groupBy(request, F.col("text").alias("original")).agg(F.min_by("entity_type", place).alias("entity_type"), F.min(place).alias("_first"))
    k = F.row_number().over(W.partitionBy(request, "entity_type").orderBy("_first"))
    numbered = first.withColumn("_k", k)
    if reserved is not None:
        numbered = numbered.join(reserved, F.col(request).eqNullSafe(F.col("_rr")) & (F.col("entity_type") == F.col("_rt")), "left")
        index = F.when(F.col("_taken").isNull(), F.col("_k")).otherwise(kth_free(F.col("_k"), F.col("_taken")))
    else:
        index = F.col("_k")
    placeholder = F.concat(F.lit("<"), "entity_type", F.lit("_"), index.cast("string"), F.lit(">"))
    if not any(m.method == "fake_replacement" for m in (policy.default, *policy.overrides.values())):
        return numbered.select(request, "original", "entity_type", placeholder.alias("fake"))
    # Stand-ins are drawn within a request, so that no two of its values share one.
    realistic = fake_table(back.where(method == "fake_replacement"), request, ordinal).select(F.col("request").alias("_fr"), F.col("original").alias("_fo"), F.col("fake").alias("_ff"))
    numbered = numbered.select(request, "original", "entity_type", placeholder.alias("_p"))
    joined = numbered.join(realistic, F.col(request).cast("string").eqNullSafe(F.col("_fr")) & (F.col("original") == F.col("_fo")), "left")
    return joined.select(request, "original", "entity_type", F.when(policy.method_of(F.col("entity_type")) == "fake_replacement", F.col("_ff")).otherwise(F.col("_p")).alias("fake"))


def replacements(rows: DataFrame, request: str, ordinal: str, policy: Policy = SHIPPED, reserved: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``fake``."""
    names = rows.columns
    table = mapping_table(rows, request, ordinal, policy, reserved).select(F.col(request).alias("_mr"), F.col("original").alias("_mo"), F.col("fake").alias("_mf"))
    kind = policy.method_of(F.col("entity_type"))
    joined = rows.join(table, F.col(request).eqNullSafe(F.col("_mr")) & (F.col("text") == F.col("_mo")), "left")
    mask = F.repeat(policy.char_of(F.col("entity_type")), F.length("text"))
    fake = F.when(kind == "mask", mask).when(kind == "redact", F.concat(F.lit("["), "entity_type", F.lit("]"))).otherwise(F.col("_mf"))
    return joined.select(*names, fake.alias("fake"))


def rebuild(text: Column, swaps: Column) -> Column:
    """``text`` with array<struct<start,end,fake>> put in; swaps must not overlap."""
    ordered = F.array_sort(swaps)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate(
        ordered, state,
        lambda a, x: F.struct(x["end"].cast("int").alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, x["start"] - a["at"]), x["fake"])).alias("out")),
    )
    rest = F.substring(text, walked["at"] + 1, F.length(text))
    return F.when(swaps.isNull() | (F.size(swaps) == 0), text).otherwise(F.concat(F.array_join(walked["out"], ""), rest))


def anonymize(texts: DataFrame, rows: DataFrame, request: str, ordinal: str, policy: Policy = SHIPPED, text_col: str = "text", reserve: bool = True) -> DataFrame:
    """``texts`` with ``anonymized`` and ``n_spans``; ``rows`` are merged spans keyed by (request, ordinal).

    Without ``reserve`` literals of the input are not kept apart.
    """
    reserved = reserved_numbers(texts, request, text_col) if reserve else None
    swapped = replacements(rows, request, ordinal, policy, reserved)
    per_text = swapped.groupBy(F.col(request).alias("_tr"), F.col(ordinal).alias("_to")).agg(F.collect_list(F.struct("start", "end", "fake")).alias("_swaps"))
    names = texts.columns
    joined = texts.join(per_text, F.col(request).eqNullSafe(F.col("_tr")) & F.col(ordinal).eqNullSafe(F.col("_to")), "left")
    return joined.select(*names, rebuild(F.col(text_col), F.col("_swaps")).alias("anonymized"), F.coalesce(F.size("_swaps"), F.lit(0)).cast("long").alias("n_spans"))


def type_counts(rows: DataFrame, request: str, ordinal: str) -> DataFrame:
    """(request, entity_type, n): each distinct original counts once, under the type it was first found as."""
    place = F.struct(F.col(ordinal).alias("o"), (-F.col("start")).alias("s"))
    once = rows.groupBy(request, "text").agg(F.min_by("entity_type", place).alias("entity_type"))
    return once.groupBy(request, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def _first_numbers(originals: Column, types: Column, reserved: Column) -> Column:
    """The number of each distinct original of one text among those of its type, passing over reserved ones."""
    def number(t, i):
        k = F.size(F.filter(F.slice(types, F.lit(1), i + 1), lambda x: x == t))
        taken = F.sort_array(F.transform(F.filter(reserved, lambda r: r["t"] == t), lambda r: r["n"]))
        return kth_free(k, taken)

    return F.transform(types, number)


def anonymize_column(text: Column, spans: Column, policy: Policy = SHIPPED, reserve: bool = True) -> Column:
    """struct<text, originals, types, fakes> of a text that is a request of its own; ``spans`` are merged.

    Everything happens inside the row, so nothing is shuffled. Numbers are given from the text's end to its
    start, the same original has one placeholder, and literals already in the text are not issued again.
    Stand-ins need a table: see ``anonymize``.
    """
    if any(m.method == "fake_replacement" for m in (policy.default, *policy.overrides.values())):
        raise ValueError("fake_replacement goes by a table of its request's values")
    back = F.reverse(F.filter(spans, lambda e: ~policy.method_of(e["entity_type"]).isin(*IRREVERSIBLE)))
    texts = F.transform(back, lambda e: e["text"])
    none = F.array().cast("array<struct<t:string,n:int>>")
    literal = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))), lambda p: F.struct(
        F.regexp_extract(p, r"^<(.*)_([0-9]+)>$", 1).alias("t"), F.regexp_extract(p, r"^<(.*)_([0-9]+)>$", 2).alias("s")))
    short = F.transform(F.filter(literal, lambda x: (F.length(x["s"]) <= 9) & ~x["s"].startswith("0")), lambda x: F.struct(x["t"].alias("t"), x["s"].cast("int").alias("n")))
    taken = F.when(F.contains(text, F.lit("<")), short).otherwise(none) if reserve else none
    # Each step is an element of an array of one, so that it is computed once and named in the next.
    with_ = lambda value, f: F.get(F.transform(F.array(value), f), 0)

    def numbered(o):
        types = F.transform(o["originals"], lambda x: F.get(o["back"], (F.array_position(o["texts"], x) - 1).cast("int"))["entity_type"])
        return F.struct(o["originals"].alias("originals"), types.alias("types"))

    def faked(n):
        fakes = F.transform(F.arrays_zip(n["types"].alias("t"), _first_numbers(n["originals"], n["types"], taken).alias("k")), lambda x: F.concat(F.lit("<"), x["t"], F.lit("_"), x["k"].cast("string"), F.lit(">")))
        return F.struct(n["originals"].alias("originals"), n["types"].alias("types"), fakes.alias("fakes"))

    def built(m):
        def swap(e):
            kind = policy.method_of(e["entity_type"])
            own = F.get(m["fakes"], (F.array_position(m["originals"], e["text"]) - 1).cast("int"))
            fake = F.when(kind == "mask", F.repeat(policy.char_of(e["entity_type"]), F.length(e["text"]))).when(kind == "redact", F.concat(F.lit("["), e["entity_type"], F.lit("]"))).otherwise(own)
            return F.struct(e["start"].alias("start"), e["end"].alias("end"), fake.alias("fake"))

        return F.struct(rebuild(text, F.transform(spans, swap)).alias("text"), m["originals"].alias("originals"), m["types"].alias("types"), m["fakes"].alias("fakes"))

    start = F.struct(back.alias("back"), texts.alias("texts"), F.array_distinct(texts).alias("originals"))
    changed = with_(with_(with_(start, numbered), faked), built)
    empty = F.array().cast("array<string>")
    return F.when(F.size(spans) > 0, changed).otherwise(F.struct(text.alias("text"), empty.alias("originals"), empty.alias("types"), empty.alias("fakes")))


def session_key(session: Column, salt: str) -> Column:
    """Sessions are known by a salted hash only."""
    return F.sha2(F.concat(F.lit(salt), session.cast("string")), 256)
