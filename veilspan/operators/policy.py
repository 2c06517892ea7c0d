"""What happens to detected spans: allow list, block gate and known-value propagation."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Longest value that an allow rule may let through.
MAX_ALLOWED = 1024
# Samples of personal data that no allow pattern may match as a whole.
CANARIES = (
    "jane.doe@example.org",
    "Jane Doe",
    "+1 415 555 0132",
    "4111 1111 1111 1111",
    "DE89 3704 0044 0532 0130 00",
    "078-05-1120",
    "203.0.113.7",
    "1984-03-12",
    "https://example.org/profile/jane",
)
#: Detectors whose finds are known for certain and looked for again.
KNOWN_SOURCES = ("secret_rules",)
#: Types that a rule must name to let them through, beside those of the block gate.
PROTECTED = ("SECRET",)


@dataclass(frozen=True)
class AllowRule:
    """Exactly one of ``value`` and ``pattern``. A rule with ``entity_types`` holds for these; one without holds
    for every type but the protected ones."""

    value: str | None = None
    pattern: str | None = None
    entity_types: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if (self.value is None) == (self.pattern is None):
            raise ValueError("an allow rule has a value or a pattern, not both")
        if not (self.value or self.pattern):
            raise ValueError("an allow rule must not be empty")
        if self.entity_types is not None and not self.entity_types:
            raise ValueError("entity_types must not be empty")
        if self.pattern is not None:
            try:
                compiled = re.compile(self.pattern)
            except re.error:
                raise ValueError("an allow pattern does not compile") from None
            if compiled.fullmatch("") or any(compiled.fullmatch(c) for c in CANARIES):
                raise ValueError("an allow pattern is too broad")

    def allows(self, entity_type: Column, text: Column, protected: Iterable[str] = ()) -> Column:
        said = text == self.value if self.value is not None else text.rlike(rf"^(?:{self.pattern.replace('(?P<', '(?<')})\z")
        of_type = entity_type.isin(*self.entity_types) if self.entity_types is not None else ~entity_type.isin(*{*PROTECTED, *protected})
        return said & (F.length(text) <= MAX_ALLOWED) & of_type


def allowed(entity_type: Column, text: Column, rules: Iterable[AllowRule], protected: Iterable[str] = ()) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | r.allows(entity_type, text, protected)
    return F.coalesce(out, F.lit(False))


def allow_verdicts(merged: DataFrame, raw: DataFrame, keys: list[str], rules: Iterable[AllowRule], protected: Iterable[str] = ()) -> DataFrame:
    """``merged`` rows with ``let_through``: some raw detection overlaps and all overlapping ones are allowed.

    The interval match is an equality join on the document with the overlap as its condition, so work is
    bounded by a document's own detections; verdicts combine in the map tasks.
    """
    r = raw.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("start").alias("_a"), F.col("end").alias("_e"), allowed(F.col("entity_type"), F.col("text"), rules, protected).alias("_ok"))
    on = (F.col("_a") < F.col("end")) & (F.col("start") < F.col("_e"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    names = merged.columns
    return merged.join(r, on, "left").groupBy(*names).agg(F.coalesce(F.bool_and("_ok"), F.lit(False)).alias("let_through"))


def let_through(span: Column, raw: Column, rules: Iterable[AllowRule], protected: Iterable[str] = ()) -> Column:
    """The same for one merged span against its text's array of raw spans."""
    rules, protected = list(rules), list(protected)
    under = lambda r: (r["start"] < span["end"]) & (span["start"] < r["end"])
    met = F.filter(raw, under)
    return (F.size(met) > 0) & F.forall(met, lambda r: allowed(r["entity_type"], r["text"], rules, protected))


def not_allowed(merged: Column, raw: Column, rules: Iterable[AllowRule], protected: Iterable[str] = ()) -> Column:
    """The raw spans that no rule allows under a merged span that holds an allowed one: why a listed value is still
    replaced. Both are arrays of one text's spans; the order is that of ``raw``."""
    rules, protected = list(rules), list(protected)
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    ok = lambda r: allowed(r["entity_type"], r["text"], rules, protected)
    held = F.filter(merged, lambda m: F.exists(raw, lambda r: meet(r, m) & ok(r)))
    return F.filter(raw, lambda r: ~ok(r) & F.exists(held, lambda m: meet(r, m)))


def block_gate(rows: DataFrame, request: str, ordinal: str, blocked: Iterable[str]) -> DataFrame:
    """(request, blocked_types): requests with a blocked type, with the types of their first offending text only."""
    hit = rows.where(F.col("entity_type").isin(*blocked)).groupBy(request, ordinal).agg(F.sort_array(F.collect_set("entity_type")).alias("_types"))
    return hit.groupBy(request).agg(F.min_by("_types", ordinal).alias("blocked_types"))


def pass_gate(df: DataFrame, rows: DataFrame, request: str, ordinal: str, blocked: Iterable[str]) -> DataFrame:
    """``df`` without the requests that the gate refuses."""
    return df.join(block_gate(rows, request, ordinal, blocked).select(request), request, "left_anti")


def token_shaped(value: Column) -> Column:
    """8 characters or more with a digit, and not a bare number."""
    return (F.length(value) >= 8) & value.rlike(r"(?U)\d") & ~value.rlike(r"(?U)^\d+\z")


def known_values(rows: DataFrame, request: str, ordinal: str, sources: Iterable[str] = KNOWN_SOURCES) -> DataFrame:
    """(request, value, entity_type, since): credentials a structured rule identified, from their first text on."""
    first = F.struct(F.col(ordinal), F.col("start"))
    picked = rows.where(F.col("source").isin(*sources) & token_shaped(F.col("text")))
    return picked.groupBy(request, F.col("text").alias("value")).agg(F.min_by("entity_type", first).alias("entity_type"), F.min(ordinal).alias("since"))


def copies_of_known(texts: DataFrame, known: DataFrame, request: str, ordinal: str, text_col: str = "text") -> DataFrame:
    """Rows of spans (source ``known``, score 1.0) of exact, free-standing copies in the same and later texts.

    The join is on the request; ``contains`` in its condition drops pairs before anything is split.
    """
    k = known.select(F.col(request).alias("_r"), "value", F.col("entity_type").alias("_type"), "since")
    met = texts.join(k, (F.col(request) == F.col("_r")) & (F.col(ordinal) >= F.col("since")) & F.contains(F.col(text_col), F.col("value")))
    # Pieces between occurrences give the offsets; split takes the value literally.
    quoted = F.concat(F.lit(r"\Q"), F.replace("value", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pieces = F.split(F.col(text_col), quoted, F.lit(-1))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * F.length("value"))
    found = met.withColumn("start", F.explode(starts)).withColumn("end", F.col("start") + F.length("value"))
    around = lambda at: F.when(at < 1, F.lit("")).otherwise(F.substring(F.col(text_col), at, F.lit(1)))
    alone = ~around(F.col("start")).rlike(r"(?U)[\p{L}\p{N}]") & ~around(F.col("end") + 1).rlike(r"(?U)[\p{L}\p{N}]")
    return found.where(alone).select(request, ordinal, F.col("_type").alias("entity_type"), F.col("value").alias("text"), "start", "end", F.lit(1.0).alias("score"), F.lit("known").alias("source"))


def known_in_text(text: str | None, spans) -> list[dict]:
    """Spans of further free-standing copies, in one text, of the credentials that a structured rule found there;
    copies inside a given span are left out."""
    if text is None or spans is None:
        return []
    out, taken = [], [(s["start"], s["end"]) for s in spans]
    values: dict[str, str] = {}
    for s in spans:
        value = s["text"]
        if s["source"] in KNOWN_SOURCES and len(value) >= 8 and any(c.isdigit() for c in value) and not value.isdigit():
            values.setdefault(value, s["entity_type"])
    for value, kind in values.items():
        at = text.find(value)
        while at >= 0:
            end = at + len(value)
            alone = not text[max(0, at - 1) : at].isalnum() and not text[end : end + 1].isalnum()
            if alone and not any(a <= at and end <= z for a, z in taken):
                out.append({"entity_type": kind, "text": value, "start": at, "end": end, "score": 1.0, "source": "known"})
            at = text.find(value, end)
    return out


def repeats_in_text(text: str | None, spans) -> list | None:
    """The merged ``spans`` of a text and, in their order, a span of source ``known`` for every other copy of one of
    their values, even inside a longer word: the longest value first, then from left to right."""
    if text is None or spans is None:
        return spans
    out = [dict(s) for s in spans]
    # What has been found is blotted out by a character that the text doesn't hold, so places stay.
    blot = next(c for c in map(chr, range(0x110000)) if c not in text)
    parts, at = [], 0
    for s in out:
        parts += [text[at : s["start"]], blot * (s["end"] - s["start"])]
        at = s["end"]
    rest = "".join([*parts, text[at:]])
    kinds: dict[str, str] = {}
    for s in reversed(out):
        if s["text"]:
            kinds.setdefault(s["text"], s["entity_type"])
    for value in sorted(kinds, key=len, reverse=True):
        at = rest.find(value)
        if at < 0:
            continue
        while at >= 0:
            out.append({"entity_type": kinds[value], "text": value, "start": at, "end": at + len(value), "score": 1.0, "source": "known"})
            at = rest.find(value, at + len(value))
        rest = rest.replace(value, blot * len(value))
    return sorted(out, key=lambda s: s["start"])
