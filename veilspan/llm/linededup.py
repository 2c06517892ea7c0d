"""Cross-site line dedup: lines that spread over many distinct sites are boilerplate.

Every line hash gets a HyperLogLog sketch of the sites it was seen on. Sketches merge by aggregation, in the
map tasks first, so a line that a third of all documents carry costs one small sketch per task. Estimates
far from the threshold decide at once; lines near it are counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import BLANKS

#: Distinct sites from which a line counts as boilerplate.
MIN_SITES = 10
#: log2 of the sketch's buckets.
LG_K = 10
#: Half width of the band around the threshold, in standard errors of the sketch.
BAND_SIGMAS = 6.0
#: Parts that each line hash is dealt into where lines meet the few hashes that matter.
SALTS = 32
#: Without ``keep_first``: a document of which more than this share (percent of its line characters) is
#: boilerplate is a copy of other documents, not a page with boilerplate; it is left whole for document dedup.
MAX_SHARE = 50
#: Names of the counts that ``dedup_lines`` appends.
COUNTS = ("_n_lines", "_n_boiler", "_n_cut")


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def _site(col: Column) -> Column:
    """Null is a site of its own, unlike any string."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), col.cast("string")))


def document_key(id_: Column, text: Column) -> Column:
    """128 bits for a document: rows that agree in them are the same text under the same id."""
    return F.struct(F.xxhash64(F.lit(31), id_, text).alias("a"), F.xxhash64(F.lit(32), text, id_).alias("b"))


def site_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(_id, _doc, _site, _h): one row for each distinct line with a word of each document; _doc is a hash of the
    id and the text, so rows without an id are no group."""
    lines = F.array_distinct(F.transform(F.filter(F.split(F.col(text_col), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), _line_hash))
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), document_key(F.col(id_col), F.col(text_col)).alias("_doc"), _site(F.col(site_col)).alias("_site"), F.explode(lines).alias("_h"))


def _lines_of(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows of ``lines`` (_doc, _h, ...) whose hash is in ``hashes`` (_h, unique), with its other columns. A line that very many documents hold
    is dealt into SALTS parts by document; the few hashes are repeated instead."""
    more = [c for c in hashes.columns if c != "_h"]
    wanted = hashes.select(F.col("_h").alias("_wh"), *more, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_ws"))
    part = F.pmod(F.col("_doc.a"), F.lit(SALTS)).cast("int")
    return lines.join(wanted, (F.col("_h") == F.col("_wh")) & (part == F.col("_ws")), "inner" if more else "left_semi").drop("_wh", "_ws")


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, first: bool = False) -> DataFrame:
    """(_h): hashes of the lines seen on ``min_sites`` distinct sites or more; with ``first`` also _first, the
    smallest id that holds the line.

    ``lines`` has (_id, _doc, _site, _h). The sketch decides outside the band; inside it the distinct (line, site) pairs
    of the near lines are counted. The band is BAND_SIGMAS standard errors wide on each side.
    """
    error = BAND_SIGMAS * 1.04 / math.sqrt(1 << lg_k)
    low, high = min_sites / (1 + error) - 0.5, min_sites * (1 + error) + 0.5
    names = ["_h", "_first"] if first else ["_h"]
    spread = lines.groupBy("_h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(lg_k))).alias("_est"), *[F.min("_id").alias("_first")] * first)
    spread = spread.where(F.col("_est") >= low)
    sure = spread.where(F.col("_est") > high).select(*names)
    near = spread.where(F.col("_est") <= high).select("_h")
    pairs = _lines_of(lines, near).groupBy("_h", "_site").agg(F.count(F.lit(1)).alias("_c"), *[F.min("_id").alias("_first")] * first)
    exact = pairs.groupBy("_h").agg(F.count(F.lit(1)).alias("_sites"), *[F.min("_first").alias("_first")] * first).where(F.col("_sites") >= min_sites).select(*names)
    return sure.unionByName(exact)


def dedup_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    max_share: int = MAX_SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    lg_k: int = LG_K,
    keep_first: bool = True,
) -> DataFrame:
    """The columns of ``docs`` with boilerplate lines cut from the text, then COUNTS (the last three columns,
    under a name with a number where ``docs`` has a column of that name).

    Lines are split at \\n and compared without surrounding white space; lines without a word are never
    counted or cut. A null text stays null, an empty one empty, and both count 0 lines. Rows that share an id
    are cut by the same global set of lines, each on its own text; a null id is an id. An empty table gives no
    rows.

    A boilerplate line stays in the document of the smallest id that holds it, and its other occurrences go from
    every document that keeps some text, however much goes. Copies don't erase each other then, since each line
    stays somewhere; a document of which nothing would stay is left whole for document dedup. ``_n_boiler``
    counts the lines that could go.

    Without ``keep_first`` every occurrence goes, unless more than ``max_share`` percent of a document's line
    characters would: it is left whole then.
    """
    names = docs.columns
    packed = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{site_col}`").alias("_source"), F.struct(*[F.col(f"`{c}`") for c in names if c != text_col] or [F.lit(0).alias("none")]).alias("_row"))
    lines = site_lines(packed, "_id", "_text", "_source")
    hits = _lines_of(lines.select("_id", "_doc", "_h"), boilerplate_lines(lines, min_sites, lg_k, keep_first))
    if keep_first:
        hits = hits.where(~F.col("_id").eqNullSafe(F.col("_first")))
    per_doc = hits.groupBy(F.col("_doc").alias("_hit")).agg(F.collect_set("_h").alias("_bad"))
    joined = packed.join(per_doc, document_key(F.col("_id"), F.col("_text")) == F.col("_hit"), "left")
    split = joined.withColumn("_lines", F.transform(F.split(F.coalesce("_text", F.lit("")), "\n"), lambda x: F.struct(x.alias("x"), F.btrim(x, F.lit(BLANKS)).alias("t"))))
    tagged = split.withColumn("_tagged", F.when(F.col("_bad").isNotNull(), F.transform("_lines", lambda e: F.struct(e["x"].alias("x"), F.length(e["t"]).alias("n"), ((e["t"] != "") & F.array_contains(F.col("_bad"), F.xxhash64(e["t"]))).alias("b")))))
    total = lambda keep: F.aggregate(F.filter("_tagged", keep), F.lit(0).cast("long"), lambda a, e: a + e["n"])
    count = F.size(F.filter("_tagged", lambda e: e["b"])).cast("long")
    out = tagged.withColumn("_n_boiler", F.when(F.col("_tagged").isNull(), F.lit(0).cast("long")).otherwise(count))
    going, whole = total(lambda e: e["b"]), total(lambda e: e["n"] > 0)
    out = out.withColumn("_cut", (F.col("_n_boiler") > 0) & (going < whole if keep_first else 100 * going <= max_share * whole))
    kept = F.array_join(F.transform(F.filter("_tagged", lambda e: ~e["b"]), lambda e: e["x"]), "\n")
    out = out.withColumn("_new", F.when(F.col("_cut"), kept).otherwise(F.col("_text")))
    out = out.withColumn("_n_lines", F.size(F.filter("_lines", lambda e: e["t"] != "")).cast("long"))
    cols = [F.col("_new").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in names]
    cut = F.when(F.col("_cut"), F.col("_n_boiler")).otherwise(F.lit(0).cast("long"))
    free = [c if c not in names else next(f"{c}_{i}" for i in range(2, len(names) + 3) if f"{c}_{i}" not in names) for c in COUNTS]
    return out.select(*cols, F.col("_n_lines").alias(free[0]), F.col("_n_boiler").alias(free[1]), cut.alias(free[2]))
