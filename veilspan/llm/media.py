"""Cropped and edited copies of images by local descriptors.

Corners are found on several scales and placed between pixels, their orientation is that of the patch's intensity
centroid, and the descriptor is a row of brightness comparisons at points turned by it, read from a smoothed
picture, so it survives cropping, turning, resizing, blur and changes of brightness. A descriptor is CHUNKS words
of CHUNK_BITS bits, and each word is the key of one Hamming table: descriptors that differ in fewer bits than
there are words always meet, and of those that differ in more a share does, which is enough since a copy has many
corners (recall by edit is in the README). A pair of images is linked when enough of its matches agree on one
similarity transform.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.llm.common import drop_table, stage_table
from veilspan.llm.components import components

#: Scales of the pyramid, and the strongest corners of an image that are kept on each in any case. Patches of
#: images that differ in size are alike when their scales are within a few percent, hence the small steps.
SCALES, CORNERS = (1.0, 1.1, 1.21, 1.33, 1.46, 1.61, 1.77, 1.95), (24, 12, 10, 8, 7, 6, 5, 4)
#: A corner with no stronger one this near (pixels of its scale, along both axes) is always kept. Which these are
#: does not depend on the rest of the image, so a crop keeps those of its part and they grow with the area.
NEAR = 3
#: A descriptor's words; each is a table's key. Words of unlike patches agree with a chance of about 2 ** -30, so
#: the pairs that meet for nothing stay fewer than the corners up to some ten million images; longer words lose
#: resized copies (README).
CHUNKS, CHUNK_BITS = 4, 56
WORDS = tuple(f"w{i}" for i in range(CHUNKS))
#: Bits, of CHUNKS * CHUNK_BITS, in which matching descriptors may differ.
MOST_DIFFER = 36
#: Entries of a key that are met in one piece; a key with more is dealt out.
HOT = 1000
#: Half the side of a patch. Small patches look alike in many images, and false matches grow with the square
#: of the images.
RADIUS = 13
#: Matches that have to agree, and the cells they are counted in: pixels, degrees and log2 scale.
AGREE, CELL, TURN, ZOOM = 4, 6.0, 15.0, 0.25
#: Pixels that are worked on at once.
PIXELS = 1 << 19

_rng = np.random.default_rng(20)
_PAIRS = np.clip(_rng.normal(0, RADIUS / 2.0, (CHUNKS * CHUNK_BITS, 4)), -RADIUS * 0.8, RADIUS * 0.8).astype(np.float32)
_DISC = np.array([(x, y) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])
_MARGIN = math.ceil(RADIUS * 0.8 * math.sqrt(2)) + 2
_HEAD = re.compile(rb"P5" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s")

Feature = tuple  # x, y, angle in degrees, scale, and the descriptor's words


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    """A binary PGM as a float array of 0 to 255, whatever its maximum; comments in the head are passed over.
    None for anything else."""
    head = _HEAD.match(data) if data else None
    if not head or any(len(x) > 9 for x in head.groups()):
        return None
    w, h, top = map(int, head.groups())
    kind = np.dtype(np.uint8 if top < 256 else ">u2")
    if not 0 < top < 65536 or w < 1 or h < 1 or len(data) < head.end() + w * h * kind.itemsize:
        return None
    return np.frombuffer(data, kind, w * h, head.end()).reshape(h, w).astype(np.float32) * np.float32(255 / top)


def encode_pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return b"P5 %d %d 255\n" % (w, h) + np.clip(np.rint(image), 0, 255).astype(np.uint8).tobytes()


def _blur(a: np.ndarray) -> np.ndarray:
    """A 3 x 3 mean over the last two axes, edges repeated."""
    for axis in (-1, -2):
        n = a.shape[axis]
        low = np.concatenate([a.take([0], axis), a.take(range(n - 1), axis)], axis) if n > 1 else a
        high = np.concatenate([a.take(range(1, n), axis), a.take([n - 1], axis)], axis) if n > 1 else a
        a = (low + a + high) * np.float32(1 / 3)
    return a


def _shrink(a: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear samples at multiples of ``scale``."""
    h, w = int((a.shape[-2] - 1) / scale) + 1, int((a.shape[-1] - 1) / scale) + 1
    y, x = np.arange(h) * scale, np.arange(w) * scale
    y0, x0 = np.minimum(y.astype(int), a.shape[-2] - 2), np.minimum(x.astype(int), a.shape[-1] - 2)
    fy, fx = (y - y0)[:, None].astype(np.float32), (x - x0)[None].astype(np.float32)
    rows = a[..., y0, :] * (1 - fy) + a[..., y0 + 1, :] * fy
    return rows[..., x0] * (1 - fx) + rows[..., x0 + 1] * fx


def _highest(a: np.ndarray, reach: int) -> np.ndarray:
    """The maximum within ``reach`` along both of the last two axes."""
    for axis in (-1, -2):
        n, out = a.shape[axis], a.copy()
        for d in range(1, min(reach, n - 1) + 1):
            near, far = [slice(None)] * a.ndim, [slice(None)] * a.ndim
            near[axis], far[axis] = slice(0, n - d), slice(d, n)
            np.maximum(out[tuple(near)], a[tuple(far)], out=out[tuple(near)])
            np.maximum(out[tuple(far)], a[tuple(near)], out=out[tuple(far)])
        a = out
    return a


def _vertex(low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where the parabola through three neighbours has its top, as an offset from the middle one."""
    bend = low - 2 * mid + high
    return np.clip(np.where(bend < 0, (low - high) / (2 * np.where(bend < 0, bend, -1)), 0), -0.5, 0.5)


def features_of(images: list[np.ndarray | None]) -> list[list[Feature]]:
    """The features of each image; too small images and None have none. Images of a size are worked on together."""
    out: list[list[Feature]] = [[] for _ in images]
    sizes: dict[tuple, list[int]] = {}
    for i, a in enumerate(images):
        if a is not None and min(a.shape) > 2 * _MARGIN + 2:
            sizes.setdefault(a.shape, []).append(i)
    for (h, w), where in sizes.items():
        step = max(1, PIXELS // (h * w))
        for at in range(0, len(where), step):
            part = where[at : at + step]
            stack = np.stack([images[i] for i in part])
            soft = _blur(stack)
            for scale, keep in zip(SCALES, CORNERS, strict=True):
                if min(h, w) / scale > 2 * _MARGIN + 2:
                    _corners(stack if scale == 1 else _shrink(soft, scale), scale, keep, part, out)
    return out


def _corners(a: np.ndarray, scale: float, keep: int, ids: list[int], out: list[list[Feature]]) -> None:
    """Append the features of one scale of a stack of images."""
    m = _MARGIN
    smooth = _blur(a)
    gy, gx = np.gradient(smooth, axis=(1, 2))
    xx, yy, xy = (_blur(_blur(p)) for p in (gx * gx, gy * gy, gx * gy))
    r = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
    core = r[:, m:-m, m:-m]
    n, y, x = np.nonzero((core >= _highest(r, 1)[:, m:-m, m:-m]) & (core > 1))
    alone = core[n, y, x] >= _highest(r, NEAR)[:, m:-m, m:-m][n, y, x]
    order = np.lexsort((x, y, -core[n, y, x], n))
    n, y, x, alone = n[order], y[order] + m, x[order] + m, alone[order]
    rank = np.arange(len(n)) - np.searchsorted(n, n)
    kept = (rank < keep) | alone
    n, y, x = n[kept], y[kept], x[kept]
    fy = y + _vertex(r[n, y - 1, x], r[n, y, x], r[n, y + 1, x])
    fx = x + _vertex(r[n, y, x - 1], r[n, y, x], r[n, y, x + 1])
    smooth = _blur(_blur(smooth))
    for at in range(0, len(n), 4096):
        _describe(smooth, n[at : at + 4096], fx[at : at + 4096], fy[at : at + 4096], scale, ids, out)


def _describe(smooth: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, scale: float, ids: list[int], out: list[list[Feature]]) -> None:
    flat, (_, h, w) = smooth.ravel(), smooth.shape
    x, y, base = x.astype(np.float32)[:, None], y.astype(np.float32)[:, None], (n * (h * w))[:, None]

    def at(px, py):
        """Bilinear samples at points of the corners' images."""
        px, py = np.clip(px, 0, w - 1.001), np.clip(py, 0, h - 1.001)
        x0, y0 = px.astype(np.int64), py.astype(np.int64)
        fx, fy = px - x0, py - y0
        i = base + y0 * w + x0
        top = flat[i] + (flat[i + 1] - flat[i]) * fx
        i += w
        return top + (flat[i] + (flat[i + 1] - flat[i]) * fx - top) * fy

    disc = flat[base + np.rint(y).astype(np.int64) * w + np.rint(x).astype(np.int64) + _DISC[:, 1] * w + _DISC[:, 0]]
    angle = np.arctan2(disc @ _DISC[:, 1].astype(np.float32), disc @ _DISC[:, 0].astype(np.float32))
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    point = lambda p, q: at(x + c * p - s * q, y + s * p + c * q)
    bits = point(_PAIRS[:, 0], _PAIRS[:, 1]) < point(_PAIRS[:, 2], _PAIRS[:, 3])
    words = bits.reshape(len(n), CHUNKS, CHUNK_BITS) @ (1 << np.arange(CHUNK_BITS, dtype=np.int64))
    for i, p, q, t, ws in zip(n.tolist(), (x[:, 0] * scale).tolist(), (y[:, 0] * scale).tolist(), np.degrees(angle).tolist(), words.tolist(), strict=True):
        out[ids[i]].append((p, q, t, scale, *ws))


_KIND = "struct<x:float,y:float,turn:float,zoom:float," + ",".join(f"{w}:bigint" for w in WORDS) + ">"


def describe(images: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """(_id, _pixels, _f): a hash of the image's bytes and its features; ``_f`` is array<struct>."""
    import pyarrow as pa
    import xxhash

    names = ("x", "y", "turn", "zoom", *WORDS)
    kind = pa.list_(pa.struct([(n, pa.int64() if n in WORDS else pa.float32()) for n in names]))

    def run(batches) -> Iterator:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                data = part.column(1).to_pylist()
                rows = [[dict(zip(names, f, strict=True)) for f in found] for found in features_of([decode_pgm(d) for d in data])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(d) if d else None for d in data], pa.binary()), pa.array(rows, kind)], ["_id", "_pixels", "_f"])

    rows = images.select(F.col(id_col).cast("long").alias("_id"), F.col(image_col).alias("_image"))
    return rows.mapInArrow(run, f"_id bigint, _pixels binary, _f array<{_KIND}>")


def _dealt(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """(u, uk, v, vk): entries of ``left`` (key, parts, v, vk) that meet those of ``right`` (key, parts, u, uk)
    under a key. The entries of a hot key are dealt into its parts on one side and repeated for each on the other."""
    left = left.select(F.col("key").alias("lkey"), F.pmod(F.xxhash64("v", "vk"), F.col("parts")).cast("int").alias("lpart"), "v", "vk", *[c for c in left.columns if c.startswith("_l")])
    right = right.select(F.col("key").alias("rkey"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("rpart"), "u", "uk", *[c for c in right.columns if c.startswith("_r")])
    return left.join(right, (F.col("lkey") == F.col("rkey")) & (F.col("lpart") == F.col("rpart")) & on).select("u", "uk", "v", "vk").distinct()


def _agreeing(met: DataFrame, shown: DataFrame) -> DataFrame:
    """(u, v) of the pairs that AGREE of their met features or more map onto each other by one transform."""
    for side in "uv":
        of = shown.toDF(*[f"{side}_{c}" for c in shown.columns])
        met = met.join(of, (F.col(side) == F.col(f"{side}__id")) & (F.col(f"{side}k") == F.col(f"{side}_k"))).drop(f"{side}__id", f"{side}_k")
    differ = sum((F.bit_count(F.col(f"u_{w}").bitwiseXOR(F.col(f"v_{w}"))) for w in WORDS), F.lit(0))
    met = met.where(differ <= MOST_DIFFER)
    ratio, turn = F.col("v_zoom") / F.col("u_zoom"), F.col("v_turn") - F.col("u_turn")
    c, s = F.cos(F.radians(turn)) * ratio, F.sin(F.radians(turn)) * ratio
    moved = met.select(
        "u", "v", "uk",
        F.round((F.col("v_x") - (c * F.col("u_x") - s * F.col("u_y"))) / CELL).cast("int").alias("dx"),
        F.round((F.col("v_y") - (s * F.col("u_x") + c * F.col("u_y"))) / CELL).cast("int").alias("dy"),
        (F.round(F.pmod(turn, F.lit(360.0)) / TURN).cast("int") % int(360 / TURN)).alias("dt"), F.round(F.log2(ratio) / ZOOM).cast("int").alias("dz"),
    )
    # A transform near the border of a cell also counts in the next one.
    cells = moved.select("u", "v", "uk", "dt", "dz", F.explode(F.array(*[F.struct((F.col("dx") + i).alias("cx"), (F.col("dy") + j).alias("cy")) for i in (0, 1) for j in (0, 1)])).alias("c"))
    votes = cells.groupBy("u", "v", "dt", "dz", "c").agg(F.count_distinct("uk").alias("n")).where(F.col("n") >= AGREE)
    return votes.select("u", "v").distinct()


def _able(rows: DataFrame) -> DataFrame:
    """The entries of images that have AGREE features or more among them."""
    able = rows.groupBy("_id").agg(F.count_distinct("k").alias("_n")).where(F.col("_n") >= AGREE).select(F.col("_id").alias("_able"))
    return rows.join(able, F.col("_id") == F.col("_able"), "left_semi")


def copy_links(features_: DataFrame, every: bool = False) -> DataFrame:
    """(u, v) with u < v: links enough to join all images that a chain of pairs with AGREE agreeing matches joins, or
    with ``every`` all such pairs.

    All pairs meet under their keys at once; an image with fewer than AGREE features under keys that it shares can't
    be the u of a pair, whose features are counted: a mark that very many otherwise different images share costs no
    pairs. For enough links, first every image is held against the smallest id under each of its keys, so a group of n
    copies gives about n links. Then, under keys whose images are still apart, the pairs that are apart meet;
    all keys that such a pair shares are among these, so no pair's votes are cut short.
    """
    one = features_.select("_id", F.posexplode("_f").alias("k", "f")).select("_id", "k", "f.*")
    rows = one.select("_id", "k", F.explode(F.array(*[F.xxhash64(F.lit(t), F.col(w)) for t, w in enumerate(WORDS)])).alias("key"))
    # One exchange for all: a window streams through a key's entries, however many.
    same = W.partitionBy("key")
    rows = rows.select("*", F.min("_id").over(same).alias("head"), F.max("_id").over(same).alias("_hi"), F.ceil(F.count(F.lit(1)).over(same) / HOT).cast("int").alias("parts"))
    rows = stage_table(rows.where("head < _hi").drop("_hi"), "entries")
    wanted = rows.select(F.col("_id").alias("_w"), F.col("k").alias("_wk")).distinct()
    shown = stage_table(one.join(wanted, (F.col("_id") == F.col("_w")) & (F.col("k") == F.col("_wk")), "left_semi"), "shown")
    heads = rows.where("_id = head").select("key", "parts", F.col("_id").alias("u"), F.col("k").alias("uk"))
    others = rows.where("_id > head").select("key", "parts", F.col("_id").alias("v"), F.col("k").alias("vk"))
    if every:
        left, right = rows.select("key", "parts", F.col("_id").alias("v"), F.col("k").alias("vk")), _able(rows).select("key", "parts", F.col("_id").alias("u"), F.col("k").alias("uk"))
        out = stage_table(_agreeing(_dealt(left, right, F.col("u") < F.col("v")), shown), "links")
        for done in (rows, shown):
            drop_table(done)
        return out
    links = stage_table(_agreeing(_dealt(others, heads, F.lit(True)), shown), "star")
    if links.isEmpty():
        open_ = rows.select("key", "parts", "_id", "k", F.col("_id").alias("label"))
    else:
        labels = components(links)
        of = labels.select(F.col("node").alias("_x"), F.col("label").alias("_y"))
        open_ = rows.select("key", "parts", "_id", "k").join(of, F.col("_id") == F.col("_x"), "left").select("key", "parts", "_id", "k", F.coalesce("_y", "_id").alias("label"))
    same = W.partitionBy("key")
    open_ = open_.select("*", F.min("label").over(same).alias("_a"), F.max("label").over(same).alias("_b")).where("_a < _b").drop("_a", "_b")
    open_ = stage_table(open_, "open")
    left = open_.select("key", "parts", F.col("_id").alias("v"), F.col("k").alias("vk"), F.col("label").alias("_lv"))
    right = _able(open_).select("key", "parts", F.col("_id").alias("u"), F.col("k").alias("uk"), F.col("label").alias("_ru"))
    more = _agreeing(_dealt(left, right, (F.col("u") < F.col("v")) & (F.col("_ru") != F.col("_lv"))), shown)
    out = stage_table(links.unionByName(more).distinct(), "links")
    for done in (rows, shown, links, open_):
        drop_table(done)
    return out


def image_copies(images: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """One row per input row: id, n_features, component_id (smallest id reached over copies), n_links.

    ``image`` is a binary PGM. Byte-equal images are one class, compared once; ``n_links`` counts all links of
    the row's class with other classes (see ``copy_links``). A null, empty, broken or too small image has no
    features and is linked only with byte-equal ones (null and empty: with nothing). Ids are integers; rows
    without an id stay apart. Repeated rows get the same result; other columns are not read; an empty table
    gives no rows.
    """
    found = stage_table(describe(images, id_col, image_col), "features")
    first = found.where(F.col("_pixels").isNotNull() & F.col("_id").isNotNull()).groupBy("_pixels").agg(F.min("_id").alias("_rep"))
    first = stage_table(first, "classes")
    shown = found.join(first.select(F.col("_rep"), F.col("_pixels").alias("_p")), (F.col("_id") == F.col("_rep")) & (F.col("_pixels") == F.col("_p"))).dropDuplicates(["_id", "_pixels"]).select("_id", "_f")
    links = copy_links(shown, every=True)
    ends = links.select(F.col("u").alias("_e")).union(links.select("v")).groupBy("_e").agg(F.count(F.lit(1)).alias("_n"))
    rows = found.select("_id", F.size("_f").cast("long").alias("n_features"), "_pixels").join(first.select(F.col("_pixels").alias("_p"), "_rep"), F.col("_id").isNotNull() & (F.col("_pixels") == F.col("_p")), "left")
    rows = rows.join(ends, F.col("_rep") == F.col("_e"), "left")
    if links.isEmpty():
        label = F.lit(None).cast("long")
    else:
        rows = rows.join(components(links), F.col("_rep") == F.col("node"), "left")
        label = F.col("label")
    out = rows.select(F.col("_id").alias(id_col), "n_features", F.coalesce(label, "_rep", "_id").alias("component_id"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"))
    out = stage_table(out, "copies")
    for done in (found, first, links):
        drop_table(done)
    return out


def _moved(a: np.ndarray, zoom: float, degrees: float) -> np.ndarray:
    """``a`` resized and turned about its centre, by bilinear samples."""
    h, w = (int(round(n * zoom)) for n in a.shape)
    y, x = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    c, s = math.cos(math.radians(degrees)) / zoom, math.sin(math.radians(degrees)) / zoom
    px = np.clip(c * x - s * y + (a.shape[1] - 1) / 2, 0, a.shape[1] - 1.001)
    py = np.clip(s * x + c * y + (a.shape[0] - 1) / 2, 0, a.shape[0] - 1.001)
    x0, y0 = px.astype(int), py.astype(int)
    fx, fy = px - x0, py - y0
    top = a[y0, x0] * (1 - fx) + a[y0, x0 + 1] * fx
    return ((a[y0 + 1, x0] * (1 - fx) + a[y0 + 1, x0 + 1] * fx) * fy + top * (1 - fy)).astype(np.float32)


#: What ``render`` does to a picture, by number.
EDITS = ("as drawn", "crop", "darker", "darker crop", "blur", "resize to 0.9", "turn by 5 degrees", "half crop", "16 grey levels")


def render(seed: bytes, edit: int = 0) -> np.ndarray:
    """A picture made from bytes by a fixed rule, and its edits (see EDITS)."""
    rng = np.random.default_rng(np.frombuffer(seed.ljust(8, b"\0")[: len(seed) // 8 * 8 or 8], np.uint64))
    a = _blur(np.kron(rng.integers(20, 236, (16, 16)), np.ones((5, 5), np.int64)).astype(np.float32))
    if edit in (1, 3):
        a = a[7:71, 9:77]
    if edit in (2, 3):
        a = a * np.float32(0.8)
    if edit == 4:
        a = _blur(a)
    if edit in (5, 6):
        a = _moved(a, 0.9 if edit == 5 else 1.0, 5 if edit == 6 else 0)
    if edit == 7:
        a = a[12:68, 12:68]
    return np.rint(a / 16) * 16 if edit == 8 else a


def pictures(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(image_id, image): a picture for each vector row. The tables hold no images, so every vector is drawn;
    each tenth row's picture is an edited copy of the picture of the row with the id before it."""
    import pyarrow as pa

    edited = F.pmod(F.col("_id"), F.lit(10)) == 9
    text = F.to_json(F.struct(F.col(vector_col).alias("v")))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.sha2(text, 256).alias("_v"))
    before = rows.select((F.col("_id") + 1).alias("_next"), F.col("_v").alias("_of")).where(F.pmod(F.col("_next"), F.lit(10)) == 9).dropDuplicates(["_next"])
    joined = rows.join(before, (F.col("_id") == F.col("_next")) & edited, "left")
    drawn = joined.select("_id", F.unhex(F.coalesce("_of", "_v")).alias("_seed"), F.when(F.col("_of").isNotNull(), 1 + F.pmod(F.floor(F.col("_id") / 10), F.lit(len(EDITS) - 1))).otherwise(0).cast("int").alias("_edit"))

    def run(batches) -> Iterator:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                made = [encode_pgm(render(s, e)) for s, e in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["image_id", "image"])

    # Drawing is the work here and its input is tiny, so the rows are dealt out by count.
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return drawn.repartition(parts).mapInArrow(run, "image_id bigint, image binary")
