"""A check that can gate a release: planted values protected, searched for on the way out, and put back.

``python -m veilspan.verify [--config FILE] [--texts PARQUET --column NAME]`` exits with 0 when nothing leaked and
everything came back, and with 1 otherwise. It prints one JSON line of counts, never a value.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan import engine
from veilspan.config import Config, load
from veilspan.operators.anonymize import Policy
from veilspan.session import build_session, ship_package

#: Made values, each with the text around it; every one has to be found.
PLANTED = (
    ("write to {} today", "nora.field@mail.test"), ("pay with {} now", "4111 1111 1111 1111"), ("host {} is up", "192.168.17.4"), ("call {} again", "+1 (555) 010-4477"),
    ('api_key = "{}"', "q7Lw2-made-Up-91"), ("postgres://app:{}@db.test/app", "Zt81-made-up"), ("tool --password {} -v", "mK55-made-up"), ('run("tool --api-key \\"{}\\" -v")', "xx81-made-up"),
)


def planted(spark: SparkSession) -> DataFrame:
    """(id, text, value): the made values in their texts."""
    return spark.createDataFrame([(i, t.replace("{}", v), v) for i, (t, v) in enumerate(PLANTED)], "id int, text string, value string")


def verdict(df: DataFrame, protection: engine.Protection, text_col: str = "text", value_col: str | None = None) -> DataFrame:
    """One row: texts, spans, leaks (texts sent with a value still in them), missed (planted values that were sent),
    unlike (texts that didn't come back as they were) and ok. A refused text is sent nowhere.

    The policy has to be reversible: what it can't put back counts as unlike.
    """
    names = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate([text_col] + ([value_col] if value_col else []))]
    sent = engine.restore(engine.protect(df.select(*names), protection, "_0"), "anonymized")
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    out = sent.agg(
        F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("n_spans"), F.lit(0)).alias("spans"),
        count(F.exists("originals", lambda v: F.contains("anonymized", v))).alias("leaks"),
        (count(F.contains("anonymized", F.col("_1"))) if value_col else F.lit(0).cast("long")).alias("missed"),
        count((F.size("refused") == 0) & ~F.col("restored").eqNullSafe(F.col("_0"))).alias("unlike"),
    )
    return out.withColumn("ok", (F.col("leaks") == 0) & (F.col("missed") == 0) & (F.col("unlike") == 0))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = argparse.ArgumentParser(prog="veilspan.verify")
    args.add_argument("--config")
    args.add_argument("--texts")
    args.add_argument("--column", default="text")
    given = args.parse_args(argv)
    spark = spark or build_session("verify")
    ship_package(spark)
    protection = engine.Protection.of(load(given.config) if given.config else Config(preset="light"))
    # Held against a policy that can be taken back, whatever the configured one does with the values.
    protection = engine.Protection(**{f: getattr(protection, f) for f in ("rules", "allow", "blocked", "strategy", "resolution")}, policy=Policy())
    rows = {"planted": verdict(planted(spark), protection, "text", "value")}
    if given.texts:
        rows["texts"] = verdict(spark.read.parquet(given.texts), protection, given.column)
    told = {name: df.first().asDict() for name, df in rows.items()}
    print(json.dumps(told))
    return 0 if all(t["ok"] for t in told.values()) else 1


if __name__ == "__main__":
    sys.exit(main())
