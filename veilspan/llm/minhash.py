"""Near-duplicate detection by min-max hashing.

Every permutation of a document's shingles gives two signature values, its minimum and its maximum, so half
the hash evaluations make a signature. Bands of those values find candidates; a link counts only after the
full shingle sets are compared. The steps:

1. Documents with equal shingle sets form a class; its smallest id stands for it.
2. Representatives that share a band are in one bucket. Each is compared with the smallest id it meets, then
   with the head of each bucket where it is still apart: links grow as stars, never as all pairs of a group.
3. Members of buckets that still hold several components are resolved exactly, by prefix filtering on their
   rarest shingles: it finds every pair over the threshold and few others.
4. Components of the links; every document gets the smallest id it can reach.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.llm.bpe import text_batches
from veilspan.llm.common import drop_table, stage_table, worker_state
from veilspan.llm.components import components

#: Chance that two documents just at the threshold share no band.
MISS = 1e-7
#: Pairs of one head that are compared in one piece.
HEAD_PAIRS = 200
#: Words whose hashes a worker remembers.
WORD_CACHE = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(percent: int, rows: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _finish(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class Shingler:
    """Distinct k-word shingles of texts as sorted 64-bit hashes; A-Z count as a-z, words are ``[^\\x20\\x09-\\x0D]+``."""

    def __init__(self, k: int):
        self.k, self._hash = k, _WordHashes()

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self._hash.__getitem__, words), np.uint64, n)
        if len(self._hash) > WORD_CACHE:
            self._hash.clear()
        width = min(n, self.k)
        out = np.full(n - width + 1, np.uint64(width))
        for i in range(width):
            out = (out ^ h[i : n - width + 1 + i]) * _MIX
            out ^= out >> np.uint64(31)
        return np.unique(_finish(out))


class Signer:
    """Band keys of shingle sets."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        n = -(-bands * rows // 2)
        self.a = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)

    def signature(self, sets: list[np.ndarray]) -> np.ndarray:
        """(documents, values): minimum and maximum under each permutation in turn. Sets must not be empty."""
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        starts = np.cumsum(sizes) - sizes
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        out = np.empty((2 * len(self.a), len(sets)), np.uint32)
        v = np.empty_like(x)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            np.multiply(x, a, out=v)
            np.add(v, b, out=v)
            np.minimum.reduceat(v, starts, out=out[2 * i])
            np.maximum.reduceat(v, starts, out=out[2 * i + 1])
        return out.T

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """(documents, bands) 64-bit keys; a key names its band."""
        sig = self.signature(sets)[:, : self.bands * self.rows].astype(np.uint64).reshape(len(sets), self.bands, self.rows)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) * _MIX, sig.shape[:2]).copy()
        for r in range(self.rows):
            key = (key ^ sig[:, :, r]) * _MIX
            key ^= key >> np.uint64(29)
        return _finish(key).view(np.int64)


def _signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(_id, _n, _set, _bands) of (_id, _text): set size, 128-bit key of the set, band keys (null if empty)."""
    import pyarrow as pa
    import xxhash

    def run(batches):
        shingle, signer = worker_state(Shingler, k), Signer(bands, rows)
        for batch in batches:
            for at, texts in text_batches(batch, 1):
                sets = [shingle(t) for t in texts]
                full = [s for s in sets if len(s)]
                found = iter(signer.keys(full)) if full else iter(())
                cols = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "_n", "_set", "_bands"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_id {kind}, _n bigint, _set binary, _bands array<bigint>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(_id, _shingles) of (_id, _text)."""
    import pyarrow as pa

    def run(batches):
        shingle = worker_state(Shingler, k)
        for batch in batches:
            for at, texts in text_batches(batch, 1):
                sets = [shingle(t).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sets, pa.list_(pa.int64()))], ["_id", "_shingles"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_id {kind}, _shingles array<bigint>")


def _close(a, b, percent: int):
    """The sizes allow the threshold."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose full sets meet the threshold. A ``u`` with very many partners is repeated, and
    they are dealt out among its repeats, so that the head of a large group isn't one task."""
    busy = pairs.groupBy(F.col("u").alias("_bu")).agg(F.ceil(F.count(F.lit(1)) / HEAD_PAIRS).cast("int").alias("_parts"))
    heads = sets.join(busy, F.col("_id") == F.col("_bu")).select(F.col("_id").alias("_a"), F.col("_shingles").alias("_sa"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_ha"))
    right = sets.select(F.col("_id").alias("_b"), F.col("_shingles").alias("_sb"))
    dealt = pairs.join(busy, F.col("u") == F.col("_bu")).select("u", "v", F.pmod(F.xxhash64("v"), F.col("_parts")).cast("int").alias("_part"))
    joined = dealt.join(right, F.col("v") == F.col("_b")).join(heads, (F.col("u") == F.col("_a")) & (F.col("_part") == F.col("_ha")))
    both = F.size(F.array_intersect("_sa", "_sb"))
    return joined.where(100 * both >= percent * (F.size("_sa") + F.size("_sb") - both)).select("u", "v").distinct()


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: components of the links between labels, carried back to the nodes."""
    if labels is None:
        return components(links)
    of = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    ends = links.join(of.withColumnsRenamed({"_n": "_nu", "_l": "_lu"}), F.col("u") == F.col("_nu"), "left")
    ends = ends.join(of.withColumnsRenamed({"_n": "_nv", "_l": "_lv"}), F.col("v") == F.col("_nv"), "left")
    lifted = ends.select(F.coalesce("_lu", "u").alias("u"), F.coalesce("_lv", "v").alias("v"))
    more = components(lifted).select(F.col("node").alias("_m"), F.col("label").alias("_k"))
    old = labels.join(more, F.col("label") == F.col("_m"), "left").select("node", F.coalesce("_k", "label").alias("label"))
    new = more.join(labels, F.col("_m") == F.col("node"), "left_anti").select(F.col("_m").alias("node"), F.col("_k").alias("label"))
    return stage_table(old.unionByName(new), "labels")


def _prefix_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) candidates among the nodes of ``open_`` (_id, _label): pairs of different labels that share one
    of their rarest shingles and can still reach the threshold from there on.

    Shingles are ranked by rarity. Two sets over the threshold must meet in the first n - ceil(n * t) + 1 of
    them; and when their first common shingle is the i-th of one and the j-th of the other, they share at
    most 1 + min(n - i, m - j), which must reach what sizes n and m need. Later common shingles only lower
    that bound, so testing it on every common one loses no pair.
    """
    mine = sets.join(open_, "_id").select("_id", "_label", F.size("_shingles").alias("_n"), F.explode("_shingles").alias("_x"))
    often = mine.groupBy("_x").agg(F.count(F.lit(1)).alias("_f"), (F.min("_label") != F.max("_label")).alias("_mixed"))
    ranked = mine.join(often, "_x").withColumn("_i", F.row_number().over(W.partitionBy("_id").orderBy("_f", "_x")))
    head = ranked.where((F.col("_i") <= F.col("_n") - F.ceil(F.col("_n") * percent / 100) + 1) & F.col("_mixed")).select("_x", "_id", "_label", "_n", "_i")
    other = head.select(F.col("_x").alias("_y"), F.col("_id").alias("_id2"), F.col("_label").alias("_label2"), F.col("_n").alias("_m"), F.col("_i").alias("_j"))
    reach = 1 + F.least(F.col("_n") - F.col("_i"), F.col("_m") - F.col("_j"))
    able = (100 + percent) * reach >= percent * (F.col("_n") + F.col("_m"))
    pairs = head.join(other, (F.col("_x") == F.col("_y")) & (F.col("_id") < F.col("_id2")) & (F.col("_label") != F.col("_label2")) & able)
    return pairs.select(F.col("_id").alias("u"), F.col("_id2").alias("v")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles (size of its set of distinct k-word shingles), component_id (the
    smallest id it reaches over links of similarity ``percent``/100 or more), kept (it is its own component).

    A text with fewer than k words is one shingle; without words (null, empty, blank) it has none and is
    linked with nothing. Rows that share an id are one document that is linked where any of its texts is.
    Rows without an id follow the rows with an id whose shingle set they share, and are never kept then;
    otherwise they keep a null component and are kept. An empty table gives no rows.
    """
    bands = bands_for(percent, rows)
    body = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    signed = stage_table(_signed(body, k, bands, rows), "signed")
    first = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_n", "_bands")))
    nodes = stage_table(signed.where(F.col("_n") > 0).groupBy("_set").agg(first.alias("_r")).select("_set", F.col("_r._id").alias("_rep"), F.col("_r._n").alias("_n"), F.col("_r._bands").alias("_bands")), "nodes")

    rows_ = nodes.where(F.col("_rep").isNotNull()).select("_rep", "_n", F.explode("_bands").alias("_key"))
    heads = rows_.groupBy("_key").agg(F.min("_rep").alias("_head"), F.max("_rep").alias("_last")).where(F.col("_head") != F.col("_last")).select(F.col("_key").alias("_hk"), "_head")
    members = stage_table(rows_.join(heads, F.col("_key") == F.col("_hk")).select("_key", "_rep", "_n", "_head"), "members")
    # An id with several texts ties their classes together.
    twice = signed.where((F.col("_n") > 0) & F.col("_id").isNotNull()).groupBy("_id").agg(F.min("_set").alias("_s1"), F.max("_set").alias("_s2")).where(F.col("_s1") != F.col("_s2")).select(F.col("_id").alias("_tid"))
    of_set = nodes.select(F.col("_set").alias("_s"), "_rep")
    tied = signed.join(twice, F.col("_id") == F.col("_tid"), "left_semi").join(of_set, F.col("_set") == F.col("_s")).select("_id", F.col("_rep").alias("v"))
    scratch: list[DataFrame] = []
    ties = stage_table(tied.join(tied.groupBy(F.col("_id").alias("_i2")).agg(F.min("v").alias("u")), F.col("_id") == F.col("_i2")).where(F.col("u") != F.col("v")).select("u", "v").distinct(), "ties")
    labels = None if ties.isEmpty() else _relabel(None, ties)
    if not members.isEmpty():
        wanted = members.select(F.col("_rep").alias("_w")).distinct()
        sets = stage_table(_sets(body.join(wanted, F.col("_id") == F.col("_w"), "left_semi"), k), "sets")

        lowest = members.where(F.col("_rep") != F.col("_head")).groupBy("_rep").agg(F.min("_head").alias("u"))
        links = stage_table(_links(lowest.select("u", F.col("_rep").alias("v")), sets, percent), "links")
        labels = _relabel(labels, links)
        scratch += [links, labels]

        size_of = members.select(F.col("_rep").alias("_sr"), F.col("_n").alias("_sn")).distinct()

        def labelled(table, node, name):
            of = labels.select(F.col("node").alias("_x"), F.col("label").alias("_y"))
            return table.join(of, F.col(node) == F.col("_x"), "left").withColumn(name, F.coalesce("_y", F.col(node))).drop("_x", "_y")

        apart = members.where(F.col("_rep") != F.col("_head")).select("_rep", "_n", "_head").distinct()
        apart = labelled(labelled(apart, "_rep", "_lr"), "_head", "_lh").where(F.col("_lr") != F.col("_lh"))
        apart = apart.join(lowest.select(F.col("u"), F.col("_rep").alias("_v")), (F.col("_rep") == F.col("_v")) & (F.col("_head") == F.col("u")), "left_anti")
        apart = apart.join(size_of, F.col("_head") == F.col("_sr")).where(_close(F.col("_n"), F.col("_sn"), percent))
        links = stage_table(_links(apart.select(F.col("_head").alias("u"), F.col("_rep").alias("v")), sets, percent), "links")
        if not links.isEmpty():
            labels = _relabel(labels, links)
        scratch += [links, labels]

        tagged = labelled(members.select("_key", "_rep", "_n"), "_rep", "_label")
        mixed = tagged.groupBy("_key").agg(F.min("_label").alias("_lo"), F.max("_label").alias("_hi")).where(F.col("_lo") != F.col("_hi")).select(F.col("_key").alias("_mk"))
        open_ = stage_table(tagged.join(mixed, F.col("_key") == F.col("_mk"), "left_semi").select(F.col("_rep").alias("_id"), "_label").distinct(), "open")
        links = stage_table(_links(_prefix_pairs(open_, sets, percent), sets, percent), "links")
        if not links.isEmpty():
            labels = _relabel(labels, links)
        scratch += [links, labels]
        # Labels are a written table of their own by now; what led to them can go.
        for done in (sets, open_, members):
            drop_table(done)

    worded = signed.where(F.col("_n") > 0).select("_id", "_n", "_set").join(of_set, F.col("_set") == F.col("_s")).select("_id", "_n", "_rep")
    if labels is not None:
        worded = worded.join(labels, F.col("_rep") == F.col("node"), "left").withColumn("_c", F.coalesce("label", "_rep"))
    else:
        worded = worded.withColumn("_c", F.col("_rep"))
    bare = signed.where(F.col("_n") == 0).select("_id", "_n", F.col("_id").alias("_c"))
    out = worded.select("_id", "_n", "_c").unionByName(bare)
    out = stage_table(out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_c").alias("component_id"), F.col("_id").eqNullSafe(F.col("_c")).alias("kept")), "classes")
    # The result is a small table of its own; what led to it can go.
    for done in [signed, nodes, ties, *scratch]:
        drop_table(done)
    return out


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component, one row per id (rows without an id all stay)."""
    found = near_duplicates(docs, k, percent, rows, id_col, text_col)
    keep = stage_table(found.where("kept").groupBy(F.col(id_col).alias("_kid")).agg(F.count(F.lit(1)).alias("_kn")), "kept")
    drop_table(found)
    # The columns travel packed, so none of them can clash with a name used here.
    whole = docs.select(F.col(f"`{id_col}`").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = whole.join(keep, F.col("_id").eqNullSafe(F.col("_kid")))
    single = joined.where((F.col("_kn") == 1) | F.col("_kid").isNull()).select("_row")
    as_text = [F.col("_row").getField(c).cast("string") for c in docs.columns]
    order = F.row_number().over(W.partitionBy("_kid").orderBy(F.xxhash64(F.col("_row").getField(text_col)), *as_text))
    several = joined.where((F.col("_kn") > 1) & F.col("_kid").isNotNull()).withColumn("_place", order).where("_place = 1").select("_row")
    return single.unionByName(several).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
