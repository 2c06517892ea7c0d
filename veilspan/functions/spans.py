"""Column functions that turn text into spans.

A span is ``struct<entity_type:string,text:string,start:int,end:int,score:double,source:string>`` with
half-open code point offsets. Everything here is a built-in expression, so detection stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)
SPANS = T.ArrayType(SPAN)
SPAN_DDL = "struct<entity_type:string,text:string,start:int,end:int,score:double,source:string>"


def computed_once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with ``value`` as a column that later filters can't pull in and compute again: conditions on what a
    generator gives stay above it, and one of an array of one element adds no row and drops none."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN_DDL}>")


def make_span(entity_type, text: Column, start: Column, score, source) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(entity_type).alias("entity_type"),
        text.alias("text"),
        start.cast("int").alias("start"),
        (start + F.length(text)).cast("int").alias("end"),
        lit(score).cast("double").alias("score"),
        lit(source).alias("source"),
    )


def matches(text: Column, pattern: str) -> Column:
    """Non-overlapping matches of a whole pattern, left to right: array<struct<m:string,at:int>>.

    The pieces between matches and the matches themselves tile the text, so an offset is a running sum of
    lengths; both lists come from one scan each, whatever the number of matches. A pattern must not match
    the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,at:int>>").alias("out"))
    walked = F.aggregate(
        F.arrays_zip(found.alias("m"), gaps.alias("g")),
        start,
        lambda a, x: F.struct(
            (a["at"] + F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(x["m"].isNull(), a["out"])
            .otherwise(F.concat(a["out"], F.array(F.struct(x["m"].alias("m"), (a["at"] + F.length(x["g"])).cast("int").alias("at")))))
            .alias("out"),
        ),
    )
    none = F.array().cast("array<struct<m:string,at:int>>")
    return F.when(text.isNull() | ~F.coalesce(text.rlike(pattern), F.lit(False)), none).otherwise(walked["out"])


def luhn_ok(digits: Column) -> Column:
    """The mod 10 checksum of payment card numbers, separators ignored."""
    return F.call_function("luhn_check", F.regexp_replace(digits, "[^0-9]", ""))


def octets_ok(ip: Column) -> Column:
    """Every dotted part is at most 255."""
    return F.forall(F.split(ip, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))


def iban_ok(iban: Column) -> Column:
    """The ISO 7064 mod 97-10 checksum: first four characters moved last, letters as 10 to 35."""
    bare = F.upper(F.regexp_replace(iban, r"[ -]", ""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    code = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(((a * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97).cast("int")))
    return rest == 1


def nhs_ok(number: Column) -> Column:
    """The mod 11 check digit of a ten-digit health number."""
    d = F.split(F.regexp_replace(number, "[^0-9]", ""), "(?<=.)(?=.)")
    total = F.aggregate(F.sequence(F.lit(0), F.lit(8)), F.lit(0), lambda a, i: a + (10 - i) * F.coalesce(F.get(d, i).try_cast("int"), F.lit(0)))
    return (F.size(d) == 10) & (((11 - total % 11) % 11) == F.get(d, F.lit(9)).try_cast("int"))
