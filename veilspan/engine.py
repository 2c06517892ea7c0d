"""One call from texts and a policy to what may be sent on.

Each row is a request of its own, and every step works inside the row: detect, drop what the policy doesn't look
for, fit to the syntax, merge, let allowed values through, find further copies of known credentials (on request, of
every found value), hold against the block list, replace. A plan of it is one scan with Python steps for the fitting of texts that have spans, for string
literals that hold options and for copies of credentials.
Requests of several rows go by the tables of ``operators.anonymize``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.config import Config
from veilspan.functions.spans import SPANS, computed_once
from veilspan.operators import anonymize as A
from veilspan.operators.detect import COMMON, Rule, above, detect_column, keep_types
from veilspan.operators.merge import merge_column, type_priorities
from veilspan.operators.policy import AllowRule, known_in_text, let_through, repeats_in_text
from veilspan.operators.refine import refine
from veilspan.operators.secrets import OPTION_RULES, literal_spans, with_literals

#: What ``refused`` says of a text that a detector failed on.
FAILED = "DETECTION_FAILED"


@dataclass(frozen=True)
class Protection:
    """What is looked for and what becomes of it."""

    rules: tuple[Rule, ...] = COMMON
    policy: A.Policy = A.SHIPPED
    allow: tuple[AllowRule, ...] = ()
    blocked: tuple[str, ...] = ()
    types: tuple[str, ...] | None = None
    threshold: float = 0.0
    strategy: str = "union"
    resolution: str = "highest_score"
    fit: bool = True
    propagate: bool = True
    #: Every further copy of a found value is replaced too, wherever it stands; so ``leaks`` finds nothing.
    repeats: bool = False
    on_error: str = "block"
    irreversible: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        every = {r.entity_type for r in self.rules}
        method = lambda t: self.policy.overrides.get(t, self.policy.default).method
        object.__setattr__(self, "irreversible", tuple(sorted(t for t in every if method(t) in A.IRREVERSIBLE)))

    @staticmethod
    def of(config: Config) -> Protection:
        return Protection(config.rules(), config.policy(), config.allow_rules(), config.block_types, None, 0.0, config.strategy, config.resolution, on_error=config.on_error)


@F.pandas_udf(SPANS)
def _repeats(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([repeats_in_text(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)


@F.pandas_udf(SPANS)
def _known_copies(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([known_in_text(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)


def find(df: DataFrame, protection: Protection, text_col: str = "text", lang_col: str | None = None, out: str = "spans", more: Iterable[str] = ()) -> DataFrame:
    """``df`` with the merged spans of each text that the policy does not let through. ``more`` names columns of spans
    that other detectors found; they go through the same steps."""
    text, p = F.col(f"`{text_col}`"), protection
    merge = lambda spans: merge_column(spans, text, p.strategy, p.resolution, type_priorities(p.blocked, p.irreversible))
    parts = [detect_column(text, p.rules, F.col(f"`{lang_col}`") if lang_col else None)]
    nested = bool(set(OPTION_RULES) & set(p.rules))
    if nested:
        df = with_literals(df, text_col, "_literals")
        parts.append(literal_spans(text, F.col("_literals")))
    parts += [F.coalesce(F.col(f"`{c}`"), F.array().cast(SPANS)) for c in more]
    raw = above(F.concat(*parts), p.threshold)
    if p.types is not None:
        raw = keep_types(raw, p.types)
    found = computed_once(df, raw, out)
    if nested:
        found = found.drop("_literals")
    if p.fit:
        found = computed_once(found, refine(text, F.col(out)), out)
    merged = merge(F.col(out))
    if p.allow:
        merged = F.filter(merged, lambda m: ~let_through(m, F.col(out), p.allow, p.blocked))
    found = computed_once(found, F.when(F.size(out) > 0, merged).otherwise(F.col(out)), out)
    if p.propagate:
        # Copies join the spans around them like any other detection.
        secret = F.exists(out, lambda e: e["entity_type"] == "SECRET")
        found = computed_once(found, F.when(secret, _known_copies(text, F.col(out))).otherwise(F.array().cast(SPANS)), "_copies")
        found = computed_once(found, F.when(F.size("_copies") > 0, merge(F.concat(out, "_copies"))).otherwise(F.col(out)), out).drop("_copies")
    if p.repeats:
        found = computed_once(found, F.when(F.size(out) > 0, _repeats(text, F.col(out))).otherwise(F.col(out)), out)
    return found


def protect(df: DataFrame, protection: Protection | Config, text_col: str = "text", lang_col: str | None = None, more: Iterable[str] = (), failed: str | None = None) -> DataFrame:
    """``df`` with ``anonymized`` (null where the request is refused), ``refused`` (the blocked types found),
    ``n_spans``, and ``originals``, ``types`` and ``fakes`` for putting the reversible ones back.

    A null text stays null and has no spans. A refused request gives nothing away: its arrays are empty. ``more``
    names columns of further detectors' spans, and ``failed`` the column that says where one of them failed: such a
    text is refused as FAILED, or goes out raw where the policy's ``on_error`` is "allow". The block list wins.
    """
    p = Protection.of(protection) if isinstance(protection, Config) else protection
    found = find(df, p, text_col, lang_col, "_spans", more)
    blocked = list(p.blocked)
    refused = F.array_sort(F.array_distinct(F.filter(F.transform("_spans", lambda e: e["entity_type"]), lambda t: t.isin(*blocked) if blocked else F.lit(False))))
    if failed is not None:
        fell = F.coalesce(F.col(f"`{failed}`"), F.lit(False))
        if p.on_error == "allow":
            found = found.withColumn("_spans", F.when(fell & (F.size(refused) == 0), F.array().cast(SPANS)).otherwise(F.col("_spans")))
        else:
            refused = F.when(fell & (F.size(refused) == 0), F.array(F.lit(FAILED))).otherwise(refused)
    found = found.withColumn("refused", refused)
    done = computed_once(found, A.anonymize_column(F.col(f"`{text_col}`"), F.col("_spans"), p.policy), "_done")
    passed, none = F.size("refused") == 0, F.array().cast("array<string>")
    return done.select(
        *[F.col(f"`{c}`") for c in df.columns], F.when(passed, F.col("_done.text")).alias("anonymized"), "refused", F.size("_spans").cast("long").alias("n_spans"),
        *[F.when(passed, F.col(f"_done.{c}")).otherwise(none).alias(c) for c in ("originals", "types", "fakes")],
    )


def restore(df: DataFrame, text_col: str, originals: str = "originals", fakes: str = "fakes", out: str = "restored") -> DataFrame:
    """``df`` with the originals of a row's own placeholders put back."""
    from veilspan.operators.restore import restore_column

    return df.withColumn(out, restore_column(F.col(f"`{text_col}`"), F.map_from_arrays(fakes, originals)))


def leaks(df: DataFrame, text_col: str = "anonymized", values: str = "originals") -> DataFrame:
    """The rows whose text still holds one of their values: what a verification has to find empty."""
    return df.where(F.exists(values, lambda v: F.contains(F.col(f"`{text_col}`"), v)))


def count_types(df: DataFrame, by: Iterable[str] = (), types: str = "types") -> DataFrame:
    """(by, entity_type, n): distinct values of each type, each request's counted once."""
    by = list(by)
    return df.select(*by, F.explode(types).alias("entity_type")).groupBy(*by, "entity_type").agg(F.count(F.lit(1)).alias("n"))
