"""Image copies on drawn pictures with known edits."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import types as T

from veilspan.llm import media

SCHEMA = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("image", T.BinaryType()), T.StructField("label", T.StringType())])


def picture(seed, edit=0):
    return media.render(bytes([seed]) * 16, edit)


def test_pgm_round_trip_and_broken_input():
    a = picture(1)
    assert np.array_equal(media.decode_pgm(media.encode_pgm(a)), np.rint(a))
    assert all(media.decode_pgm(x) is None for x in (None, b"", b"P5", b"P5 9 9 255\n", b"junk", b"P5 0 9 255\n", b"P5 1 1 0\n\0", b"P5 1 1 70000\n\0\0"))
    assert media.decode_pgm(b"P5 # by hand\n2 1\n# top\n100\n\x00\x64").tolist() == [[0, 255]]
    assert media.decode_pgm(b"P5 1 2 65535\n\x00\x00\xff\xff").tolist() == [[0], [255]]
    assert media.features_of([np.zeros((3, 3), np.float32), None, np.zeros((80, 80), np.float32), np.zeros((1, 900), np.float32)]) == [[]] * 4


def test_features_do_not_depend_on_the_batch(monkeypatch):
    images = [picture(s, e) for s in (1, 2) for e in range(len(media.EDITS))]
    together = media.features_of(images)
    monkeypatch.setattr(media, "PIXELS", 1)
    alone = [media.features_of([a])[0] for a in images]
    assert [[f[4:] for f in fs] for fs in together] == [[f[4:] for f in fs] for fs in alone] and all(len(fs) > 8 for fs in alone)


def test_copies_are_linked_and_others_left_alone(spark):
    rows = [(10 * s + e, media.encode_pgm(picture(s, e)), "x") for s in range(1, 13) for e in range(4)]
    rows += [(500, rows[0][1], "x"), (500, rows[0][1], "x"), (None, rows[0][1], "x"), (501, None, None), (502, None, None), (503, b"", "x"), (504, b"junk", "x"), (505, b"junk", "x"), (506, media.encode_pgm(np.rot90(picture(1))), "x")]
    out = media.image_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    got = {r.image_id: r.component_id for r in out}
    for s in range(1, 13):
        assert {got[10 * s + e] for e in range(4)} == {10 * s}
    assert got[500] == 10 and got[506] == 10 and got[None] is None
    assert (got[501], got[502], got[503], got[504], got[505]) == (501, 502, 503, 504, 504)
    links = {r.image_id: r.n_links for r in out}
    assert links[10] >= 3 and links[504] == 0 and links[500] == links[10]
    assert media.image_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pictures_follow_the_rows(spark):
    df = spark.createDataFrame([(i, [float(i), 0.5]) for i in (8, 9, 18, 19, 20)] + [(None, None)], "vec_id long, embedding array<float>")
    got = {r.image_id: r.component_id for r in media.image_copies(media.pictures(df)).collect()}
    assert got == {8: 8, 9: 8, 18: 18, 19: 18, 20: 20, None: None}


def test_three_bits_may_differ_wherever_they_lie(spark):
    """Each match of two images differs in the same three bits, over all ways to lay them on the words."""
    places = [n * media.CHUNK_BITS + k for n in range(media.CHUNKS) for k in (0, 10, media.CHUNK_BITS - 1)]
    r = np.random.default_rng(3)
    rows = []
    for n, flips in enumerate([(a, b, c) for i, a in enumerate(places) for j, b in enumerate(places[:i]) for c in places[:j]]):
        words = r.integers(0, 1 << media.CHUNK_BITS, (4, media.CHUNKS))
        for side in (0, 1):
            flip = np.zeros(media.CHUNKS, np.int64)
            for f in flips:
                flip[f // media.CHUNK_BITS] ^= side << f % media.CHUNK_BITS
            rows.append((2 * n + side, [(20.0 * k, 30.0 + k * k, 5.0, 1.0, *map(int, w ^ flip)) for k, w in enumerate(words)]))
    df = spark.createDataFrame(rows, f"_id long, _f array<{media._KIND}>")
    assert {(r.u, r.v) for r in media.copy_links(df).collect()} == {(i, i + 1) for i in range(0, len(rows), 2)}


def brute_links(images):
    """All pairs of images with AGREE matches on one transform, by plain loops."""
    out = set()
    for u, fu in images.items():
        for v, fv in images.items():
            if u >= v:
                continue
            votes = defaultdict(set)
            for k, f in enumerate(fu):
                for g in fv:
                    if not any(p == q for p, q in zip(f[4:], g[4:], strict=True)) or sum((p ^ q).bit_count() for p, q in zip(f[4:], g[4:], strict=True)) > media.MOST_DIFFER:
                        continue
                    ratio, turn = g[3] / f[3], g[2] - f[2]
                    c, s = math.cos(math.radians(turn)) * ratio, math.sin(math.radians(turn)) * ratio
                    dx, dy = (math.floor((g[0] - (c * f[0] - s * f[1])) / media.CELL + 0.5), math.floor((g[1] - (s * f[0] + c * f[1])) / media.CELL + 0.5))
                    dt, dz = math.floor(turn % 360 / media.TURN + 0.5) % 24, math.floor(math.log2(ratio) / media.ZOOM + 0.5)
                    for i in (0, 1):
                        for j in (0, 1):
                            votes[dx + i, dy + j, dt, dz].add(k)
            if any(len(x) >= media.AGREE for x in votes.values()):
                out.add((u, v))
    return out


def classes(ids, links):
    label = {i: i for i in ids}
    for _ in ids:
        for u, v in links:
            label[u] = label[v] = min(label[u], label[v])
    return label


def test_links_join_what_all_pairs_join(spark, monkeypatch):
    """Groups of copies, chains of parts, and marks of 3 or 4 corners that very many images share."""
    r = np.random.default_rng(8)
    draw = lambda n: [(float(x), float(y), float(t), 1.0, *map(int, w)) for x, y, t, w in zip(r.integers(10, 200, n), r.integers(10, 200, n), r.integers(0, 360, n), r.integers(0, 1 << media.CHUNK_BITS, (n, media.CHUNKS)), strict=True)]

    def seen(fs):
        return [(*f[:4], *(w ^ (1 << int(r.integers(media.CHUNK_BITS)) if r.random() < 0.4 else 0) for w in f[4:])) for f in fs]

    images, logo3, logo4, strip = {}, draw(3), draw(4), draw(40)
    for i in range(60):
        images[i] = draw(6) + seen(logo3)
    for i in range(60, 80):
        images[i] = draw(6) + logo4
    for i in range(80, 110):
        images[i] = seen(strip[i - 80 : i - 70]) + draw(2)
    for i in range(110, 130):
        images[i] = draw(5)
    images[130] = []
    monkeypatch.setattr(media, "HOT", 7)
    want = brute_links(images)
    df = spark.createDataFrame(list(images.items()), f"_id long, _f array<{media._KIND}>")
    got = {(x.u, x.v) for x in media.copy_links(df).collect()}
    assert got <= want and classes(images, got) == classes(images, want)
    assert len({classes(images, got)[i] for i in range(60)}) == 60 and {classes(images, got)[i] for i in range(60, 80)} == {60}
    assert len(got) < len(want)


def test_recall_by_edit(spark):
    """Each edit of 20 pictures, and some that the query does not draw: at least 0.9 are found, none wrongly."""
    def more(a):
        yield from (media._moved(a, z, 0) for z in (0.95, 0.85, 0.75))
        yield from (media._moved(a, 1, d) for d in (10, 20, 45))
        yield a + np.random.default_rng(1).normal(0, 5, a.shape)

    rows, kinds = [], 0
    for s in range(20):
        seed = bytes([s]) * 16
        drawn = [media.render(seed, e) for e in range(len(media.EDITS))] + list(more(media.render(seed)))
        kinds = len(drawn)
        # Every edit is paired with an original of its own, so that none is found by way of another.
        rows += [(2 * (s * kinds + k) + side, media.encode_pgm(a)) for k, edited in enumerate(drawn) if k for side, a in enumerate((np.rint(media._moved(drawn[0], 1, 0)) + k % 3, edited))]
    images = dict(zip([i for i, _ in rows], media.features_of([media.decode_pgm(b) for _, b in rows]), strict=True))
    found = Counter()
    for i in images:
        if i % 2 == 0:
            found[i // 2 % kinds] += bool(brute_links({0: images[i], 1: images[i + 1]}))
    assert min(found.values()) >= 18, found
    assert not brute_links({i: images[2 * (i * kinds + 1)] for i in range(20)})


def test_every_edit_is_found_through_the_query(spark, tmp_path):
    from veilspan.llm.queries import QUERIES

    rows = [(10 * i + k, [float(i), float(k)]) for i in range(3 * (len(media.EDITS) - 1)) for k in (8, 9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: (r.component_id, r.n_links) for r in QUERIES["op2_media_copies"](spark, str(tmp_path)).collect()}
    assert got == {v: (v // 10 * 10 + 8, 1) for v, _ in rows}


def test_resampled_copies_are_found(spark):
    """A shift by a quarter of a pixel changes every value; nearly all such copies are still found."""
    rows = []
    for s in range(1, 31):
        a = picture(s)
        rows += [(2 * s, media.encode_pgm(a), "x"), (2 * s + 1, media.encode_pgm(0.75 * a[:-1] + 0.25 * a[1:]), "x")]
    got = {r.image_id: r.component_id for r in media.image_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(c in (i, i // 2 * 2) for i, c in got.items())
    assert sum(got[i] == i - 1 for i in got if i % 2) >= 28


def test_a_small_crop_of_a_large_image_is_found(spark):
    rows = []
    for s in range(6):
        blocks = np.random.default_rng(s).integers(20, 236, (120, 120))
        large = media._blur(np.kron(blocks, np.ones((5, 5), np.int64)).astype(np.float32))
        for k, part in enumerate((large, large[303:383, 211:291], large[520:, 520:])):
            rows.append((10 * s + k, media.encode_pgm(part), "x"))
    out = {r.image_id: r for r in media.image_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r.component_id for i, r in out.items()} == {i: i // 10 * 10 for i in out}
    assert all(out[10 * s].n_features > 1000 for s in range(6))
