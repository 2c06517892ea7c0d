"""Putting originals back: the inverse of anonymisation."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.operators.anonymize import PLACEHOLDER
from veilspan.operators.leaves import JSON_KEYS


def request_maps(mapping: DataFrame, request: str) -> DataFrame:
    """(request, _map): fake to original, one map per request."""
    return mapping.groupBy(F.col(request).alias("_mreq")).agg(F.map_from_entries(F.collect_list(F.struct("fake", "original"))).alias("_map"))


def restore_column(text: Column, table: Column) -> Column:
    """One pass over placeholder-shaped strings; unknown ones and everything restored are left alone."""
    found = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    gaps = F.split(text, PLACEHOLDER, -1)
    parts = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("f")), lambda x: F.concat(x["g"], F.coalesce(F.element_at(table, x["f"]), x["f"], F.lit(""))))
    return F.when(table.isNull() | text.isNull() | ~F.contains(text, F.lit("<")), text).otherwise(F.array_join(parts, ""))


def restore(df: DataFrame, mapping: DataFrame, request: str, text_col: str, out: str = "restored") -> DataFrame:
    """``df`` with the originals of its request's numbered placeholders. A request without a map passes as is."""
    names = df.columns
    joined = df.join(request_maps(mapping, request), F.col(request).eqNullSafe(F.col("_mreq")), "left")
    return joined.select(*names, restore_column(F.col(text_col), F.col("_map")).alias(out))


#: Tables that a worker keeps ready.
TABLES = 64
# Fixed value: sentence punctuation that may surround a retyped value.
_EDGES = ".,;:!?\"'()[]{}«»…"


def restore_any(text: str, table: dict[str, str]) -> str:
    """Exact restore of arbitrary fakes: longest first at each place, in one pass."""
    fakes = sorted((f for f in table if f), key=len, reverse=True)
    return re.sub("|".join(map(re.escape, fakes)), lambda m: table[m[0]], text) if fakes else text


def is_placeholder(said: str) -> bool:
    """An ASCII name, an underscore and a number in angle brackets."""
    name, _, number = said[1:-1].rpartition("_")
    plain = said.isascii() and name[:1].isalpha() and name.replace("_", "a").isalnum()
    return plain and number.isdigit() and said[0] == "<" and said[-1] == ">"


class Fakes:
    """The fakes of one table made ready for many texts: what one word is near to is worked out once."""

    #: Words whose answers are kept.
    KEPT = 100_000

    def __init__(self, table: dict[str, str], threshold: float):
        self.table, self.threshold = table, threshold
        fakes = sorted((f for f in table if f), key=len, reverse=True)
        self.exact = re.compile("|".join(map(re.escape, fakes))) if fakes else None
        # By words and length: the most that any of the fakes holds of each character, and the fakes.
        self.groups: dict[int, dict[int, tuple[Counter, list]]] = {}
        for rank, fake in enumerate(sorted((f for f in table if f.strip()), key=len, reverse=True)):
            low = fake.lower()
            count = Counter(low)
            most, of = self.groups.setdefault(len(fake.split()), {}).setdefault(len(low), (Counter(), []))
            most |= count
            of.append((rank, fake, count, SequenceMatcher(None, "", low)))
        self.known: dict[tuple[int, str], list[tuple[int, str]]] = {}
        # Lengths of a single word at which the ratio to any fake of one word can reach the threshold.
        sizes = self.groups.get(1, {})
        longest = int(2 * max(sizes, default=0) / threshold) + 2 if threshold > 0 else 0
        self.lengths = frozenset(n for n in range(longest) if any(2.0 * min(n, size) / (n + size) >= threshold for size in sizes)) if threshold > 0 else None

    def restored(self, text: str) -> str:
        return self.exact.sub(lambda m: self.table[m[0]], text) if self.exact else text

    def near(self, width: int, said: str) -> list[tuple[int, str]]:
        """(rank, original) of the fakes of ``width`` words that ``said`` nearly spells."""
        if (width, said) not in self.known:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            self.known[width, said] = self._near(width, said)
        return self.known[width, said]

    def _near(self, width: int, said: str) -> list[tuple[int, str]]:
        if said in self.table or is_placeholder(said):
            return []
        plain = " ".join(said.split()).lower()
        count, out = Counter(plain), []
        shared = lambda other: sum(min(n, other[c]) for c, n in count.items())
        for size, (most, fakes) in self.groups[width].items():
            # SequenceMatcher's ratio is at most twice the characters in common by both lengths. Each quotient here is
            # formed as SequenceMatcher forms its own, so none is rounded differently.
            both = len(plain) + size
            if 2.0 * min(len(plain), size) / both < self.threshold or 2.0 * shared(most) / both < self.threshold:
                continue
            for rank, fake, held, matcher in fakes:
                if said != self.table[fake] and 2.0 * shared(held) / both >= self.threshold:
                    matcher.set_seq1(plain)
                    if matcher.ratio() >= self.threshold:
                        out.append((rank, self.table[fake]))
        return out

    def near_misses(self, text: str) -> list[tuple[int, int, str]]:
        cores = []
        for m in re.finditer(r"\S+", text):
            word = m[0].lstrip(_EDGES)
            cores.append((m.end() - len(word), m.start() + len(m[0].rstrip(_EDGES))))
        found = []
        for width in self.groups:
            for (lo, _), (_, hi) in zip(cores, cores[width - 1 :], strict=False):
                said = text[lo:hi]
                if lo >= hi or (width == 1 and self.lengths is not None and len(said.lower()) not in self.lengths):
                    continue
                found += [(rank, lo, hi, original) for rank, original in self.near(width, said)]
        # The chosen runs don't overlap, so their order by start is that by end.
        chosen: list[tuple[int, int, str]] = []
        for _, lo, hi, original in sorted(found):
            at = bisect_left(chosen, (lo,))
            if (at == 0 or chosen[at - 1][1] <= lo) and (at == len(chosen) or hi <= chosen[at][0]):
                chosen.insert(at, (lo, hi, original))
        return chosen

    def restored_nearly(self, text: str) -> str:
        text, out, at = self.restored(text), [], 0
        for lo, hi, original in self.near_misses(text):
            out += [text[at:lo], original]
            at = hi
        return "".join([*out, text[at:]])


def near_misses(text: str, table: dict[str, str], threshold: float) -> list[tuple[int, int, str]]:
    """(start, end, original) of runs of words that nearly spell a fake and don't overlap: the longest fake has
    its choice first, then the leftmost place. Placeholder shapes, fakes and originals themselves are no misses."""
    return Fakes(table, threshold).near_misses(text)


def restore_fuzzy(text: str, table: dict[str, str], threshold: float = 0.85) -> str:
    """Exact restore, then the near misses."""
    return Fakes(table, threshold).restored_nearly(text)


def restore_fuzzy_df(df: DataFrame, mapping: DataFrame, request: str, text_col: str, threshold: float = 0.85, out: str = "restored") -> DataFrame:
    """``restore`` with arbitrary fakes and near misses, in Arrow batches."""
    @F.pandas_udf(T.StringType())
    def run(text: pd.Series, table: pd.Series) -> pd.Series:
        done = []
        for t, m in zip(text, table, strict=True):
            if t is None or not m:
                done.append(t)
                continue
            key = tuple(dict(m).items())
            if key not in ready:
                if len(ready) >= TABLES:
                    ready.clear()
                ready[key] = Fakes(dict(key), threshold)
            done.append(ready[key].restored_nearly(t))
        return pd.Series(done, dtype=object)

    ready: dict[tuple, Fakes] = {}
    names = df.columns
    joined = df.join(request_maps(mapping, request), F.col(request).eqNullSafe(F.col("_mreq")), "left")
    return joined.select(*names, run(F.col(text_col), F.col("_map")).alias(out))


def restore_tree(value, table: dict[str, str], skip_types: frozenset[str] = frozenset()):
    """Every string leaf restored, but for blocks whose ``type`` is in ``skip_types``. A string of JSON under a key
    of JSON_KEYS is restored on its parsed tree, so that quotes in an original can't break it."""
    if isinstance(value, dict):
        if isinstance(value.get("type"), str) and value["type"] in skip_types:
            return value
        return {k: _restore_json(v, table) if k in JSON_KEYS and isinstance(v, str) else restore_tree(v, table, skip_types) for k, v in value.items()}
    if isinstance(value, list):
        return [restore_tree(v, table, skip_types) for v in value]
    return restore_any(value, table) if isinstance(value, str) else value


def _restore_json(text: str, table: dict[str, str]) -> str:
    plain = restore_any(text, table)
    if plain == text:
        return text
    try:
        tree = json.loads(text)
    except ValueError:
        return plain
    return json.dumps(restore_tree(tree, table), ensure_ascii=False)


def restore_documents(df: DataFrame, mapping: DataFrame, request: str, json_col: str, skip_types=frozenset(), out: str = "restored") -> DataFrame:
    """``df`` with the reply in ``json_col`` restored as a tree by its request's mapping; text that isn't JSON is
    restored as text."""
    skip = frozenset(skip_types)

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series, table: pd.Series) -> pd.Series:
        done = []
        for t, m in zip(text, table, strict=True):
            if t is None or not m:
                done.append(t)
                continue
            try:
                tree = json.loads(t)
            except ValueError:
                done.append(restore_any(t, dict(m)))
                continue
            new = restore_tree(tree, dict(m), skip)
            done.append(t if new == tree else json.dumps(new, ensure_ascii=False))
        return pd.Series(done, dtype=object)

    names = df.columns
    joined = df.join(request_maps(mapping, request), F.col(request).eqNullSafe(F.col("_mreq")), "left")
    return joined.select(*names, run(F.col(json_col), F.col("_map")).alias(out))
