"""Rule detectors: a table of patterns evaluated over one scan of the text.

``detect`` adds an array of spans built from built-in expressions only, so a query that reads two columns
scans two columns and needs no Python worker. Detectors union by concatenation; order is rule order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.functions import spans as S


@dataclass(frozen=True)
class Rule:
    """A pattern and what its matches are.

    ``prefix`` is matched but not part of the span, and so is ``suffix``. ``langs`` limits the rule to texts
    of those languages (None: all). ``check`` is a column predicate over the span's text. ``trim`` shortens
    the span's text from the right. ``needs`` is a string that every match holds: texts without it are passed
    over by a byte search instead of the pattern.
    """

    name: str
    entity_type: str
    pattern: str
    score: float = 0.85
    source: str = "rules"
    prefix: str = ""
    suffix: str = ""
    langs: tuple[str, ...] | None = None
    check: Callable[[Column], Column] | None = None
    trim: Callable[[Column], Column] | None = None
    own: bool = False
    needs: str = ""

    @property
    def whole(self) -> str:
        return f"({self.prefix})({self.pattern})({self.suffix})" if self.prefix or self.suffix else self.pattern

    def spans(self, text: Column) -> Column:
        found = S.matches(F.when(F.contains(text, F.lit(self.needs)), text) if self.needs else text, self.whole)
        grouped = bool(self.prefix or self.suffix)

        def one(x):
            value, at = x["m"], x["at"]
            if grouped:
                # Groups are read from the match alone: a prefix and a suffix must not hold groups.
                value, at = F.regexp_extract(x["m"], self.whole, 2), at + F.length(F.regexp_extract(x["m"], self.whole, 1))
            if self.trim:
                value = self.trim(value)
            return S.make_span(self.entity_type, value, at, self.score, self.source)

        out = F.filter(F.transform(found, one), lambda e: e["text"] != "")
        return F.filter(out, lambda e: F.coalesce(self.check(e["text"]), F.lit(False))) if self.check else out


#: Detectors of common shapes. Scores are this library's own constants.
COMMON: tuple[Rule, ...] = (
    Rule("email", "EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0, needs="@"),
    Rule("card", "CREDIT_CARD", r"[0-9](?:[ -]?[0-9]){12,18}", 1.0, check=S.luhn_ok),
    Rule("ip", "IP_ADDRESS", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", 0.6, check=S.octets_ok, needs="."),
    Rule("phone", "PHONE_NUMBER", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.75, needs="+"),
    Rule("ssn", "US_SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.5, needs="-"),
    Rule("url", "URL", r"https?://[^\s<>\"'`]*[^\s<>\"'`.,;:!?)\]}]", 0.6, needs="://"),
    Rule("iban", "IBAN_CODE", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?", 1.0, check=S.iban_ok),
    Rule("nhs", "UK_NHS", r"[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}", 1.0, check=S.nhs_ok),
)
BY_NAME = {r.name: r for r in COMMON}


def custom_rule(entity_type: str, pattern: str, score: float = 0.9, value: tuple[str, str, str] | None = None) -> Rule:
    """An operator's own type. ``value`` is (before, value, after) when only a part of the match is the span.
    Patterns are case-insensitive; Python's ``(?P<`` becomes ``(?<``."""
    fold = lambda p: p.replace("(?P<", "(?<")
    if value:
        a, b, c = map(fold, value)
        return Rule(f"custom:{entity_type}", entity_type, f"(?iu:{b})", score, "custom", f"(?iu:{a})", f"(?iu:{c})" if c else "", own=True)
    return Rule(f"custom:{entity_type}", entity_type, f"(?iu:{fold(pattern)})", score, "custom", own=True)


TOKEN_RULE = Rule("token", "SECRET", r"[0-9a-f]{40}", 0.9, "custom", prefix=r'token = "', suffix='"', own=True, needs='token = "')


def detect_column(text: Column, rules: Iterable[Rule] = COMMON, lang: Column | None = None) -> Column:
    """All spans of all rules that apply, in rule order."""
    parts = []
    for r in rules:
        found = r.spans(text)
        if r.langs is not None:
            found = F.when(lang.isin(*r.langs), found).otherwise(S.no_spans()) if lang is not None else S.no_spans()
        parts.append(found)
    return F.concat(*parts) if parts else S.no_spans()


def detect(df: DataFrame, rules: Iterable[Rule] = COMMON, text_col: str = "text", lang_col: str | None = None, out: str = "spans") -> DataFrame:
    """``df`` with the array of detected spans. Null and empty texts have none."""
    return S.computed_once(df, detect_column(F.col(text_col), rules, F.col(lang_col) if lang_col else None), out)


def keep_types(spans: Column, types: Iterable[str], own_sources: Iterable[str] = ("custom",)) -> Column:
    """The allowlist of entity types; an operator's own rules are exempt."""
    types, own = list(types), list(own_sources)
    return F.filter(spans, lambda e: e["entity_type"].isin(*types) | e["source"].isin(*own))


def keep_primary(spans: Column, lang: Column, primary: str, sources: Iterable[str]) -> Column:
    """Spans of the ``sources`` that read a whole language's names only count in texts of the primary language."""
    bound = list(sources)
    return F.filter(spans, lambda e: ~e["source"].isin(*bound) | F.coalesce(lang == primary, F.lit(False)))


def without_values(spans: Column) -> Column:
    """The spans without their texts, for keeping them apart from what they were found in."""
    return F.transform(spans, lambda e: F.struct(*[e[n].alias(n) for n in ("entity_type", "start", "end", "score", "source")]))


def with_values(bare: Column, text: Column) -> Column:
    """The spans again, with their texts cut from the text they were found in."""
    return F.transform(bare, lambda e: S.make_span(e["entity_type"], F.substring(text, e["start"] + 1, e["end"] - e["start"]), e["start"], e["score"], e["source"]))


def above(spans: Column, threshold: float) -> Column:
    return F.filter(spans, lambda e: e["score"] >= threshold)


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of spans with equal (start, end, entity_type) under ``keys``: the first by ``order`` stays."""
    w = W.partitionBy(*keys, "start", "end", "entity_type").orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def span_rows(df: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """One row per span, with its position in the detectors' order as ``ord``."""
    return df.select(*keys, F.posexplode(spans).alias("ord", "_s")).select(*keys, "ord", "_s.*")


def with_merged(df: DataFrame, merged: Column, spans: str = "spans") -> DataFrame:
    """``df``'s rows that have spans, with ``merged`` in their place, computed once."""
    return S.computed_once(df.where(F.size(spans) > 0), merged, spans)


def detect_distinct(df: DataFrame, rules: Iterable[Rule], key: str, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """``df``'s key and spans, each distinct (text, language) detected once and joined back.

    The join goes over 128 bits of hash, so texts move once; copies of a text cost a lookup.
    """
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    keyed = df.select(key, F.col(text_col).alias("_text"), lang.alias("_lang")).withColumn("_h", F.struct(F.xxhash64("_text", "_lang").alias("a"), F.xxhash64(F.lit(1), "_lang", "_text").alias("b")))
    once = keyed.groupBy(F.col("_h").alias("_k")).agg(F.first("_text").alias("_text"), F.first("_lang").alias("_lang"))
    found = detect(once, rules, "_text", "_lang" if lang_col else None).select("_k", "spans")
    return keyed.select(key, "_h").join(found, F.col("_h") == F.col("_k")).select(key, "spans")
