"""Session statistics over a stream of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.operators.anonymize import session_key


def session_counts(detections: DataFrame, salt: str, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(session, entity_type, first_seen, last_seen, n) of a streaming frame (session, ts, entity_type).

    A session ends after ``gap`` without activity, like an entry that expires; rows later than ``late`` are
    dropped by the watermark, so state stays bounded.
    """
    keyed = detections.withWatermark("ts", late).select(session_key(F.col("session"), salt).alias("session"), "ts", "entity_type")
    out = keyed.groupBy(F.session_window("ts", gap).alias("w"), "session", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select("session", "entity_type", F.col("w.start").alias("first_seen"), F.col("w.end").alias("last_seen"), "n")
