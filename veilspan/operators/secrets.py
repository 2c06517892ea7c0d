"""Structured credentials, by rules over their surroundings.

The rules are this library's own: assignments of credential names, opaque values of upper-case variables,
URI passwords, authorization headers, documented key formats, private key blocks, web tokens and
command-line options. The span is the value only.

Commands inside string literals are read with their quotes and backslashes decoded, two layers deep; what is found
there is placed in the text as it stands.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.functions.spans import SPAN_DDL, computed_once
from veilspan.operators.detect import Rule, detect_column

SOURCE = "secret_rules"
_NAMES = r"(?<![A-Za-z0-9-])(?:[A-Za-z0-9]*_)*(?:api_?key|access_?token|refresh_?token|auth_?token|client_?secret|password|passwd|smtp_?secret|presented_?key)"
_LINE = r"(?m:^)[ \t]*(?:[0-9]+[:|\t→][ \t]*)?(?:[+-][ \t]*)?(?:(?:export|env|ENV|ARG)[ \t]+)?"
_EQ = r"[ \t]*[=:][ \t]*"
_Q = r"(?:[^\"\\\n]|\\.)+"
_Q1 = r"(?:[^'\\\n]|\\.)+"
_BARE = r"[^\s\"'][^\s]*"
_OPTION = r"--(?:[a-z]+-)*(?:password|passwd|api-key|client-secret|(?:access-|auth-|refresh-)?token|mot-de-passe)"


def _opaque(text):
    """16 characters or more with a letter and a digit, no path and no variable."""
    return (F.length(text) >= 16) & text.rlike("[A-Za-z]") & text.rlike("[0-9]") & ~text.rlike(r"^[$./~]|^%|/.*/")


def _is_value(text):
    """Not a metavariable, a variable reference or a plain word."""
    return ~text.rlike(r"^(?:<.*>|\$.*|[A-Z][A-Z_]*|[a-z]{1,12}|\[.*\])[.,;)]?$")


def _rule(name, pattern, prefix="", suffix="", check=None, score=0.95, needs=""):
    return Rule(name, "SECRET", pattern, score, SOURCE, prefix, suffix, check=check, needs=needs)


SECRET_RULES: tuple[Rule, ...] = (
    _rule("assignment, double quotes", _Q, rf"(?i:{_NAMES})[\"']?{_EQ}\"", r"\""),
    _rule("assignment, single quotes", _Q1, rf"(?i:{_NAMES})[\"']?{_EQ}'", "'"),
    _rule("assignment", _BARE, rf"(?i:{_NAMES}){_EQ}"),
    _rule("variable", _BARE, rf"{_LINE}[A-Z][A-Z0-9_]*(?:TOKEN|SECRET|KEY){_EQ}", check=_opaque),
    _rule("variable, quoted", _Q, rf"{_LINE}[A-Z][A-Z0-9_]*(?:TOKEN|SECRET|KEY){_EQ}\"", r"\"", check=_opaque),
    _rule("pass variable", _BARE, rf"{_LINE}(?:[A-Z][A-Z0-9_]*PASS|[A-Z][A-Z0-9_]*_PWD){_EQ}"),
    _rule("uri password", r"[^\s/@\"'<>]+", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@\"'<>]*:", "@", needs="://"),
    _rule("authorization", r"[A-Za-z0-9._~+/=-]{6,}", r"(?i:authorization)[\"']?\]?[ \t]*[:=][ \t]*[\"']?(?i:bearer|basic)[ \t]+"),
    _rule("provider key", r"(?:sk-[A-Za-z0-9_-]{20,}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|xox[a-z]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|hf_[A-Za-z0-9]{30,})"),
    _rule("private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", needs="PRIVATE KEY-----"),
    _rule("web token", r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]*)?", needs="eyJ"),
    # A backslash right before a quote or a space belongs to the literal around the command, not to the value.
    _rule("option", r"(?:[^\s\"'`\\]|\\++(?![\s\"'`]|\z))+", rf"{_OPTION}(?:=|[ \t]+)", check=_is_value, needs="--"),
    _rule("option, double quotes", _Q, rf"{_OPTION}(?:=|[ \t]+)\"", r"\"", needs="--"),
    _rule("option, single quotes", _Q1, rf"{_OPTION}(?:=|[ \t]+)'", "'", needs="--"),
)

#: The rules that are read inside literals.
OPTION_RULES = tuple(r for r in SECRET_RULES if r.name.startswith("option"))
LAYERS = 2
_LITERAL = re.compile(r"""(?<!\w)(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')""")
_UNIT = re.compile(r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\.|[^\\]", re.DOTALL)
# The escapes that JSON and JavaScript share.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_DECODED = T.ArrayType(T.StructType([T.StructField("inner", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType()))]))


def _unescaped(unit: str) -> str:
    if unit[0] != "\\":
        return unit
    return chr(int(unit[2:], 16)) if len(unit) > 2 else _ESCAPES.get(unit[1], unit[1])


def decoded_literals(text: str | None, layers: int = LAYERS) -> list[tuple[str, list[int]]]:
    """(decoded, places) of the literals of a text that hold a backslash and an option, and of those inside them.
    ``places`` has where each decoded character starts in the text, and where the last one ends."""
    out, level = [], [(text, None)] if text else []
    for _ in range(layers):
        inner = []
        for said, places in level:
            for m in _LITERAL.finditer(said):
                body = m[0][1:-1]
                if "\\" not in body or "--" not in body:
                    continue
                units = list(_UNIT.finditer(body))
                at = [m.start() + 1 + u.start() for u in units] + [m.end() - 1]
                inner.append(("".join(_unescaped(u[0]) for u in units), at if places is None else [places[i] for i in at]))
        out += inner
        level = inner
    return out


@F.pandas_udf(_DECODED)
def _literals(text: pd.Series) -> pd.Series:
    return pd.Series([[{"inner": s, "at": at} for s, at in decoded_literals(t)] for t in text], dtype=object)


def with_literals(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with the decoded literals of each text; only texts with a backslash and an option go to Python."""
    text = F.col(f"`{text_col}`")
    none = F.array().cast("array<struct<inner:string,at:array<int>>>")
    return computed_once(df, F.coalesce(_literals(F.when(F.contains(text, F.lit("\\")) & F.contains(text, F.lit("--")), text)), none), out)


def literal_spans(text: Column, literals: Column) -> Column:
    """Spans of options inside decoded literals, at their places in the text and with its characters."""

    def placed(x, s):
        start, end = F.element_at(x["at"], s["start"] + 1), F.element_at(x["at"], s["end"] + 1)
        piece = F.substring(text, start + 1, end - start)
        return F.struct(s["entity_type"].alias("entity_type"), piece.alias("text"), start.alias("start"), end.alias("end"), s["score"].alias("score"), s["source"].alias("source"))

    found = F.flatten(F.transform(literals, lambda x: F.transform(detect_column(x["inner"], OPTION_RULES), lambda s: placed(x, s))))
    return F.when(F.size(literals) > 0, found).otherwise(F.array()).cast(f"array<{SPAN_DDL}>")
