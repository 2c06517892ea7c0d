"""Near duplicates against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import types as T

from veilspan.llm import minhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_n", T.StringType()), T.StructField("kept", T.StringType())])


def shingles(t, k):
    w = (t or "").encode().lower().split()
    m = min(k, len(w))
    return frozenset(tuple(w[i : i + m]) for i in range(len(w) - m + 1)) if w else frozenset()


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(40)]
    base = [r.choice(vocab) for _ in range(120)]
    rows = []
    for i in range(260):
        kind = i % 4
        if kind == 0:
            w = [r.choice(vocab) for _ in range(r.randrange(0, 60))]
        elif kind == 1:  # near copies of one text, at many distances
            w = list(base)
            for _ in range(r.randrange(0, 9)):
                w[r.randrange(len(w))] = r.choice(vocab)
        elif kind == 2:  # a shared passage that is most of the text
            w = passage + [r.choice(vocab) for _ in range(r.randrange(0, 12))]
        else:
            w = list(base[: r.randrange(1, 6)])
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else "\t ".join(w)))
    return rows + [(300, None), (301, ""), (302, " \n")]


@pytest.mark.parametrize(("k", "percent", "rows"), [(3, 85, 6), (5, 80, 5)])
def test_components_match_brute_force(spark, k, percent, rows):
    data = corpus(k)
    out = minhash.near_duplicates(spark.createDataFrame([(i, t, "x", "x") for i, t in data], SCHEMA), k, percent, rows).collect()
    want = brute(data, k, percent)
    assert {r.doc_id: r.component_id for r in out} == want
    texts = dict(data)
    assert all(r.n_shingles == len(shingles(texts[r.doc_id], k)) and r.kept == (r.doc_id == r.component_id) for r in out)


def test_repeated_rows_null_ids_and_empty_table(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, a), (5, b), (7, b), (None, a), (None, "only here no id"), (9, None), (9, None)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    out = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(df).collect())
    assert out == [(0, 0, True), (0, 5, False), (5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True), (9, 9, True)]
    left = minhash.one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 0, 5, 9]
    assert minhash.near_duplicates(df.where("false")).count() == 0 and minhash.one_of_each(df.where("false")).count() == 0


def test_one_of_each_keeps_all_columns(spark):
    rows = [(1, "a b c d e f g", 1, "p", None), (2, "a b c d e f g", 2, "q", 7), (3, "other words than these are in here", 3, "r", 9), (3, "a text of its own under the same id", 4, "s", 9), (None, None, 5, None, 1)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_rank", T.IntegerType()), T.StructField("_kid", T.StringType()), T.StructField("_kn", T.IntegerType())])
    df = spark.createDataFrame(rows, schema)
    out = minhash.one_of_each(df)
    assert out.columns == df.columns
    got = {tuple(r) for r in out.collect()}
    assert {rows[0], rows[4]} <= got <= set(rows) - {rows[1]} and len(got) == 3


def test_many_partners_of_one_head(spark, monkeypatch):
    """A star larger than one piece of comparisons."""
    monkeypatch.setattr(minhash, "HEAD_PAIRS", 3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(40)] + [(100 + i, " ".join([f"v{i}_{j}" for j in range(20)])) for i in range(5)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == brute(rows, 5, 80)


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    x = np.unique(r.integers(0, 2**64, 3000, dtype=np.uint64))
    sig = minhash.Signer(80, 6).signature([x[:2000], x[200:2200]])
    assert abs((sig[0] == sig[1]).mean() - 1800 / 2200) < 0.08
    assert minhash.bands_for(85, 6) >= 30
