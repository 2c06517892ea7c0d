"""All links of image copies, held against plain loops over all pairs."""

import numpy as np

from tests.llm.test_media import SCHEMA, brute_links, classes, picture
from veilspan.llm import media


def drawn(r, n):
    return [(float(x), float(y), float(t), 1.0, *map(int, w)) for x, y, t, w in zip(r.integers(10, 200, n), r.integers(10, 200, n), r.integers(0, 360, n), r.integers(0, 1 << media.CHUNK_BITS, (n, media.CHUNKS)), strict=True)]


def test_no_link_is_left_out(spark, monkeypatch):
    """Groups whose images are all linked, chains, marks of 3 corners, and four corners that one corner answers."""
    r = np.random.default_rng(9)
    logo3, logo4, strip = drawn(r, 3), drawn(r, 4), drawn(r, 30)
    images = {i: drawn(r, 4) + logo3 for i in range(30)} | {i: drawn(r, 4) + logo4 for i in range(30, 50)}
    images |= {i: strip[i - 50 : i - 40] + drawn(r, 2) for i in range(50, 70)}
    one = drawn(r, 1)[0]
    images |= {80: [(one[0] + k / 8, *one[1:]) for k in range(media.AGREE)], 81: [one]}
    monkeypatch.setattr(media, "HOT", 7)
    want = brute_links(images)
    df = spark.createDataFrame(list(images.items()), f"_id long, _f array<{media._KIND}>")
    assert {(x.u, x.v) for x in media.copy_links(df, every=True).collect()} == want
    assert (80, 81) in want and sum(u >= 30 and v < 50 for u, v in want) == 190
    few = {(x.u, x.v) for x in media.copy_links(df).collect()}
    assert few <= want and classes(images, few) == classes(images, want)


def test_every_edited_copy_counts_its_links(spark):
    rows = [(10 * s + e, media.encode_pgm(picture(s, e)), "x") for s in (1, 2) for e in range(len(media.EDITS))]
    found = dict(zip([i for i, *_ in rows], media.features_of([media.decode_pgm(b) for _, b, _ in rows]), strict=True))
    want = {i: sum(i in pair for pair in brute_links(found)) for i in found}
    got = {x.image_id: x.n_links for x in media.image_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and min(got.values()) > 1
