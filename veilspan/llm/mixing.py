"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Rows fall into hash blocks of their source. A source's target is a number of whole passes over its blocks, more
whole blocks in a permuted order, and, in the one block that the target cuts, single rows: two exact quotas, of
block draws and of row draws. The tree splits the quotas of all sources among the output shards: at each node the
left half's share of every quota is one multivariate hypergeometric draw, so quotas add up exactly at every
level. A shard owns a range of each source's permuted blocks and rows, disjoint from all others, and its documents
are ordered by a hash within it. What a row is taken for is read off these draws: one for each shard it went to.

Sources may be very many: their order, targets and quotas are tables. The tree first splits the totals of GROUPS
groups of sources on the driver, then each group's share among its own sources in a task; drawing in two steps
gives the same distribution as drawing at once. A source with a third of all rows is spread over its blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.llm.common import drop_table, stage_table, words_of
from veilspan.session import ship_package

#: Rows of a block in the largest source, on average, and the least number of blocks of a source.
BLOCK_ROWS, LEAST_BLOCKS = 1024, 256
#: Rows after the cut from which the largest that fit are taken; they bring a source nearer to its target.
FILL = 256
#: Groups of sources that the driver splits.
GROUPS = 256
#: A document is taken at most this often.
MAX_COPIES = 3
#: Weights by the sources' code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Items that one hypergeometric draw may cover.
MOST_DRAWN = 500_000_000


def _in_order(sources: DataFrame) -> DataFrame:
    """``sources`` with ``_rank``, 0 for the first by code point, null last, without one task that sorts all:
    ranges of sources are numbered inside and moved by the sizes of the ranges before."""
    cut = sources.repartitionByRange(F.col("_source").isNull(), F.col("_source")).withColumn("_p", F.spark_partition_id())
    ranges = stage_table(cut, "mix-ranges")
    before = F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    first = ranges.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_first"))
    inside = F.row_number().over(W.partitionBy("_p").orderBy(F.col("_source").asc_nulls_last()))
    return ranges.join(first, F.col("_p") == F.col("_q")).withColumn("_rank", F.col("_first") + inside - 1).drop("_p", "_q", "_first")


def source_targets(base: DataFrame, weights=WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(_s, source_size, _rows, target) of the sources of ``base`` (_source, _size).

    Sources share the total by weight; a share stops at ``most`` times its source's size and the excess is shared
    again by weight among the others. A round is one aggregate over the sources; it ends when no more are full.
    """
    totals = base.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = stage_table(_in_order(totals).withColumn("_weight", weight).drop("_rank"), "mix-sources")
    limit = most * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    unit, full = 0.0, -1
    while True:
        over = F.lit(unit) * F.col("_weight") > limit
        r = sources.agg(F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("_weight"))), F.count_if(over)).first()
        if r[2] == full or not r[1]:
            break
        unit, full = (total - (r[0] or 0)) / r[1], r[2]
    target = F.least(F.lit(unit) * F.col("_weight"), limit.cast("double"))
    return sources.select(F.col("_source").alias("_s"), "source_size", "_rows", target.alias("target"))


def _draw(rng: np.random.Generator, quotas: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` draws without replacement fall on each quota. Beyond MOST_DRAWN items, equal bundles of
    items and what is left over are drawn apart, which keeps every total exact."""
    total = int(quotas.sum())
    if not n or not total:
        return quotas * 0
    size = -(-total // MOST_DRAWN) * 2
    if total <= MOST_DRAWN or quotas.max() < size:
        return rng.multivariate_hypergeometric(quotas, n, method="marginals")
    bundles, rest = np.divmod(quotas, size)
    # One bundle is opened, so that what bundles can't make up is always there.
    bundles[quotas.argmax()] -= 1
    rest[quotas.argmax()] += size
    b, r = int(bundles.sum()), int(rest.sum())
    k = max(min(n * b // total, b, n // size), -(-max(0, n - r) // size))
    return _draw(rng, bundles, k) * size + _draw(rng, rest, n - k * size)


def split_quotas(quotas: list[int], shards: int, seed, totals: list[int] | None = None) -> np.ndarray:
    """(shards, quotas) draws: the tree's leaves. Every node's halves add up to the node. ``totals`` are the
    draws of each shard; by default they are as even as can be."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.array(quotas, np.int64))]
    while todo:
        first, n, q = todo.pop()
        if n == 1:
            out[first] = q
            continue
        left = n // 2
        part = _draw(rng, q, int(q.sum()) * left // n if totals is None else sum(totals[first : first + left]))
        todo += [(first + left, n - left, q - part), (first, left, part)]
    return out


def _shard_ends(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """(_rs, _block_ends, _row_ends) of ``draws`` (_s, _blocks, _singles): after which block and row draw of a
    source each shard's range ends."""
    grouped = draws.withColumn("_group", F.pmod(F.xxhash64(F.lit(23), "_s"), F.lit(GROUPS)).cast("int"))
    sums = {r[0]: int(r[1]) for r in grouped.groupBy("_group").agg(F.sum(F.col("_blocks") + F.col("_singles"))).collect()}
    order = sorted(sums)
    leaves = split_quotas([sums[g] for g in order], shards, seed)
    share = {g: leaves[:, i].tolist() for i, g in enumerate(order)}

    def run(rows):
        import pyarrow as pa

        rows = rows.sort_by("_s")  # bytes of UTF-8 are in code point order; null comes last
        group, n = rows["_group"][0].as_py(), rows.num_rows
        ends = np.cumsum(split_quotas([*rows["_blocks"].to_pylist(), *rows["_singles"].to_pylist()], shards, [seed, group], share[group]), axis=0).T
        lists = pa.list_(pa.int64())
        return pa.table({"_rs": rows["_s"], "_block_ends": pa.array(ends[:n].tolist(), lists), "_row_ends": pa.array(ends[n:].tolist(), lists)})

    return grouped.groupBy("_group").applyInArrow(run, "_rs string, _block_ends array<bigint>, _row_ends array<bigint>")


def plan_mix(base: DataFrame, shards: int, seed: int, weights=WEIGHTS, most: int = MAX_COPIES) -> tuple[DataFrame, int]:
    """One row per (source, block), and the number of blocks of a source.

    ``base`` has (_source, _size, _hash). Columns: _ps, _pb (source and block), source_size, target, ``_shards``
    (the shard of each whole draw of the block), ``_low`` (for each shard the last hash of the rows that it draws
    singly, in order) and ``_more`` (array<struct<h,shard>>, further rows that are drawn singly).
    """
    aims = source_targets(base, weights, most)
    largest = aims.agg(F.max("_rows")).first()[0] or 0
    n_blocks = max(LEAST_BLOCKS, -(-largest // BLOCK_ROWS))
    base = base.withColumn("_block", block_of(F.col("_hash"), n_blocks))
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most).cast("long"), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    aims = stage_table(aims.withColumn("_full", passes).withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_full") * F.col("source_size"))), "mix-aims")

    blocks = base.groupBy("_source", "_block").agg(F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_rows_in"))
    order = W.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed), F.col("_block")), "_block")
    blocks = blocks.join(aims.drop("_rows"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    blocks = blocks.withColumn("_pos", F.row_number().over(order) - 1)
    blocks = blocks.withColumn("_before", F.sum("_words").over(order) - F.col("_words")).withColumn("_rows_before", F.sum("_rows_in").over(order) - F.col("_rows_in"))
    blocks = stage_table(blocks, "mix-blocks")

    # Around the place where the target cuts the blocks: whole blocks before it, then rows in order of their
    # hashes while they fit, then of the next FILL rows the largest that still fit.
    cut = blocks.where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") > F.col("_rest")))
    cut = cut.select(F.col("_source").alias("_cs"), F.col("_pos").alias("_cp"), F.col("_rows_before").alias("_cr"), F.col("_rows_in").alias("_cn"), (F.col("_rest") - F.col("_before")).alias("_room"))
    zone = blocks.join(cut, F.col("_source").eqNullSafe(F.col("_cs"))).where((F.col("_pos") >= F.col("_cp")) & (F.col("_rows_before") < F.col("_cr") + F.col("_cn") + FILL))
    zone = zone.select(F.col("_source").alias("_zs"), F.col("_block").alias("_zb"), F.col("_pos").alias("_zp"), "_room")
    inside = base.join(zone, F.col("_source").eqNullSafe(F.col("_zs")) & (F.col("_block") == F.col("_zb")))
    inside = inside.groupBy("_zs", "_zp", "_room", "_hash").agg(F.sum("_size").alias("_w"))
    line = W.partitionBy("_zs").orderBy("_zp", "_hash")
    inside = inside.withColumn("_sum", F.sum("_w").over(line.rowsBetween(W.unboundedPreceding, 0)))
    inside = inside.withColumn("_fits", F.col("_sum") <= F.col("_room")).withColumn("_n", F.sum(F.when(F.col("_fits"), 0).otherwise(1)).over(line))
    pool = F.collect_list(F.when(~F.col("_fits") & (F.col("_n") <= FILL) & (F.col("_w") <= F.col("_room")), F.struct((-F.col("_w")).alias("w"), F.col("_hash").alias("h"), F.col("_zp").alias("p"))))
    # Rows fit in order, so those that fit lie in the block that the target cuts; a block's rows are few.
    fitting = F.sort_array(F.collect_list(F.when(F.col("_fits"), F.col("_hash"))))
    ends = inside.groupBy("_zs", "_room").agg(F.coalesce(F.max(F.when(F.col("_fits"), F.col("_sum"))), F.lit(0)).alias("_got"), fitting.alias("_prefix"), F.sort_array(pool).alias("_pool"))
    nothing = F.struct((F.col("_room") - F.col("_got")).cast("double").alias("gap"), F.array().cast("array<struct<h:bigint,p:int>>").alias("out"))
    fill = F.aggregate(
        "_pool", nothing,
        lambda a, x: F.when(-x["w"] <= a["gap"], F.struct((a["gap"] + x["w"]).cast("double").alias("gap"), F.concat(a["out"], F.array(F.struct(x["h"].alias("h"), x["p"].cast("int").alias("p")))).alias("out"))).otherwise(a),
    )["out"]
    ends = stage_table(ends.select(F.col("_zs").alias("_es"), "_prefix", fill.alias("_fill")).join(cut.select("_cs", "_cp"), F.col("_es").eqNullSafe(F.col("_cs"))).drop("_cs"), "mix-cut")

    blocks = blocks.join(ends, F.col("_source").eqNullSafe(F.col("_es")), "left")
    whole = (F.col("_rest") > 0) & F.coalesce(F.col("_pos") < F.col("_cp"), F.col("_before") < F.col("_rest"))
    blocks = blocks.withColumn("_draws", F.col("_full") + whole.cast("int")).withColumn("_at_cut", F.coalesce(F.col("_pos") == F.col("_cp"), F.lit(False)))
    singles = F.max(F.when(F.col("_at_cut"), F.size("_prefix") + F.size("_fill")).otherwise(0))
    draws = blocks.groupBy(F.col("_source").alias("_s")).agg(F.sum("_draws").alias("_blocks"), singles.cast("long").alias("_singles"), F.count(F.lit(1)).alias("_present"))
    draws = stage_table(draws, "mix-draws")
    ranges = _shard_ends(draws.drop("_present"), shards, seed).join(draws.select(F.col("_s").alias("_ds"), "_present"), F.col("_rs").eqNullSafe(F.col("_ds")))
    blocks = blocks.join(ranges, F.col("_source").eqNullSafe(F.col("_rs")))
    owner = lambda ends, nth: F.size(F.filter(ends, lambda end: end <= nth)).cast("int")
    # Draws of a source are counted pass by pass; the last pass has the blocks before the cut only.
    shards_of = F.transform(F.sequence(F.lit(0), F.col("_draws") - 1), lambda e: owner("_block_ends", e * F.col("_present") + F.col("_pos")))
    none = F.array().cast("array<int>")
    low = F.transform("_row_ends", lambda end: F.get("_prefix", (F.least(end, F.size("_prefix").cast("long")) - 1).cast("int")))
    more = F.transform("_fill", lambda x, i: F.struct(x["h"].alias("h"), x["p"].alias("p"), owner("_row_ends", F.size("_prefix") + i).alias("shard")))
    mine = F.transform(F.filter(more, lambda x: x["p"] == F.col("_pos")), lambda x: F.struct(x["h"].alias("h"), x["shard"].alias("shard")))
    out = blocks.select(
        F.col("_source").alias("_ps"), F.col("_block").alias("_pb"), "source_size", "target", F.when(F.col("_draws") > 0, shards_of).otherwise(none).alias("_shards"),
        F.when(F.col("_at_cut") & (F.size("_prefix") > 0), low).alias("_low"), F.coalesce(mine, F.array().cast("array<struct<h:bigint,shard:int>>")).alias("_more"),
    )
    out = stage_table(out, "mix-plan")
    for done in (aims, blocks, ends, draws):
        drop_table(done)
    return out, n_blocks


def block_of(h: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(n_blocks)).cast("int")


def mix(docs: DataFrame, shards: int = 16, seed: int = 17, weights=WEIGHTS, most: int = MAX_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """One row per input row: id (or, with ``carry``, all columns in ``_row``), size (words), source_size,
    target (both of its source) and ``copies``: array<struct<pass int, shard int, place long>>, one for each draw
    that the row is in, empty if the mix leaves the row out. ``place`` orders a shard.

    Null texts have size 0; the null source comes last. Rows that agree in id, text and source share a hash
    and are taken together. The result depends on the rows and the seed only. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    source = F.col(f"`{source_col}`").cast("string")
    h = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), source)
    size = F.size(words_of(F.col(f"`{text_col}`"))).cast("long")
    base = stage_table(docs.select(F.col(f"`{id_col}`").alias("_id"), source.alias("_source"), size.alias("_size"), h.alias("_hash")), "mix-sizes")
    plan, n_blocks = plan_mix(base.select("_source", "_size", "_hash"), shards, seed, weights, most)
    rows = base
    if carry:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), source.alias("_source"), size.alias("_size"), h.alias("_hash"))
    rows = rows.withColumn("_block", block_of(F.col("_hash"), n_blocks))
    rows = rows.join(plan, F.col("_source").eqNullSafe(F.col("_ps")) & (F.col("_block") == F.col("_pb")))
    # The shards whose single rows all come before this one are passed; the next owns it, if any does.
    passed = F.size(F.filter("_low", lambda last: last.isNull() | (last < F.col("_hash"))))
    filled = F.get(F.transform(F.filter("_more", lambda x: x["h"] == F.col("_hash")), lambda x: x["shard"]), 0)
    single = F.when(F.col("_low").isNotNull() & (passed < shards), passed.cast("int")).otherwise(filled)
    drawn = F.when(single.isNull(), F.col("_shards")).otherwise(F.concat("_shards", F.array(single)))
    copies = F.transform(drawn, lambda s, e: F.struct(e.cast("int").alias("pass"), s.cast("int").alias("shard"), F.xxhash64(F.col("_hash"), e).alias("place")))
    out = rows.select("_row" if carry else F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"))
    if carry:
        drop_table(base)
        return out
    out = stage_table(out, "mixed")
    for done in (base, plan):
        drop_table(done)
    return out


def mixed_documents(docs: DataFrame, shards: int = 16, seed: int = 17, parts: int = 64, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row as often as it is taken, in the order of each shard.

    A shard is dealt out in ``parts`` pieces, so that it isn't one task; each piece is ordered locally. The
    number of tasks is the session's, since it follows the size of the data.
    """
    drawn = mix(docs, shards, seed, carry=True, **options).select("_row", F.explode("copies").alias("_c"))
    drawn = drawn.withColumn("_part", F.pmod(F.col("_c.place"), F.lit(parts)))
    placed = drawn.repartition(F.col("_c.shard"), F.col("_part")).sortWithinPartitions("_c.shard", "_part", "_c.place", "_c.pass")
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
