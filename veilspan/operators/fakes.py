"""Realistic stand-ins for values, always the same for the same value.

The stand-ins are this library's own: a value's hash picks from small vocabularies, so no generator library
and no state is needed. Two values of a request never share one, and none equals its original.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Variants tried before a request is refused.
VARIANTS = 10
_FIRST = "Alex Robin Camille Sacha Jordan Morgan Charlie Noa Andrea Kim Lou Jamie".split()
_LAST = "Martin Berg Rossi Silva Jansen Novak Lindt Moreau Costa Weber Dumont Keller".split()
_CITY = "Lyon Porto Graz Ghent Turin Leiden Bilbao Rouen Kassel Parma Breda Braga".split()


class StandInsExhausted(RuntimeError):
    """No usable stand-in for a value; the message names its type only."""


def stand_in(entity_type: str, original: str, variant: int = 0) -> str:
    h = int.from_bytes(hashlib.sha256(f"{original.lower().strip()}{variant}".encode()).digest()[:16], "big")
    digits = f"{h % 10**20:020d}"
    pick = lambda words, at: words[(h >> at) % len(words)]
    made = {
        "PERSON": f"{pick(_FIRST, 3)} {pick(_LAST, 11)}",
        "EMAIL_ADDRESS": f"{pick(_FIRST, 3)}.{pick(_LAST, 11)}{digits[:4]}@example.net".lower(),
        "PHONE_NUMBER": f"+1 (555) {digits[:3]}-{digits[3:7]}",
        "LOCATION": pick(_CITY, 5),
        "DATE_TIME": f"{h % 28 + 1:02d}/{h // 28 % 12 + 1:02d}/{1950 + h // 400 % 60}",
        "CREDIT_CARD": digits[:16],
        "IP_ADDRESS": f"192.0.2.{h % 254 + 1}",
        "URL": f"https://{digits[:6]}.example.org/",
        "US_SSN": f"9{digits[:2]}-{digits[2:4]}-{digits[4:8]}",
        "IBAN_CODE": f"XX{digits[:18]}",
        "FINANCIAL": digits[:14],
        "SECRET": "[REDACTED]",
    }
    return made.get(entity_type) or f"[{entity_type}_{h:x}"[: len(entity_type) + 10] + "]"


def assign(values: list[tuple[str, str]]) -> dict[str, str]:
    """Original to stand-in for a request's (type, original) pairs in their order."""
    out: dict[str, str] = {}
    used: set[str] = set()
    for kind, original in values:
        if original in out:
            continue
        fake = next((f for v in range(VARIANTS + 1) if (f := stand_in(kind, original, v)) != original and f not in used), None)
        if fake is None:
            raise StandInsExhausted(f"no stand-in left for type {kind}")
        out[original] = fake
        used.add(fake)
    return out


def fake_table(rows: DataFrame, request: str, ordinal: str) -> DataFrame:
    """(request, original, entity_type, fake) by stand-ins; a request's distinct values are one group."""
    place = F.struct(F.col(ordinal).alias("o"), (-F.col("start")).alias("s"))
    first = rows.groupBy(F.col(request).cast("string").alias("request"), F.col("text").alias("original")).agg(F.min_by("entity_type", place).alias("entity_type"), F.min(place).alias("p")).select("request", "original", "entity_type", "p.o", "p.s")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["o", "s"], kind="stable")
        table = assign(list(zip(group["entity_type"], group["original"], strict=True)))
        return pd.DataFrame({"request": group["request"], "original": group["original"], "entity_type": group["entity_type"], "fake": group["original"].map(table)})

    return first.groupBy("request").applyInPandas(run, "request string, original string, entity_type string, fake string")
