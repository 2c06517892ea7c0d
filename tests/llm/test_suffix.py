"""Suffix arrays and repeat removal against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from veilspan.llm import suffixdedup
from veilspan.llm.suffixarray import permuted_lcp, suffix_array


def common(x, y):
    n = 0
    while n < len(x) and n < len(y) and x[n] == y[n]:
        n += 1
    return n


def test_suffix_array_and_lcp():
    r = random.Random(1)
    for k in range(1200):
        alphabet = r.choice([b"a", b"ab", b"abc", b"abcdefgh", bytes(range(256))])
        b = bytes(r.choice(alphabet) for _ in range(r.randrange(60))) * (3 if k % 5 == 0 else 1)
        text = np.frombuffer(b, np.uint8)
        sa = suffix_array(text)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i, b=b: b[i:])
        lcp = permuted_lcp(text, sa)
        assert all(lcp[sa[i]] == common(b[sa[i] :], b[sa[i - 1] :]) for i in range(1, len(b)))


def test_long_runs_stay_linear():
    for b in (b"a" * 60000, b"ab" * 30000, b" " * 30000 + b"x" + b" " * 30000):
        text = np.frombuffer(b, np.uint8)
        sa = suffix_array(text)
        at = np.linspace(1, len(b) - 1, 50).astype(int)
        assert all(b[sa[i - 1] :] < b[sa[i] :] for i in at) and np.bincount(sa, minlength=len(b)).max() == 1


def test_every_window_holds_an_anchor():
    r = np.random.default_rng(2)
    for alphabet in (1, 2, 30):
        texts = [bytes(r.integers(97, 97 + alphabet, r.integers(0, 300), dtype=np.uint8)) for _ in range(40)]
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        at, h = suffixdedup.find_anchors(np.frombuffer(b"".join(texts), np.uint8), starts, sizes)
        for t, s, n in zip(texts, starts, sizes, strict=True):
            mine = at[(at >= s) & (at + suffixdedup.GRAM <= s + n)] - s
            assert all(((mine >= w) & (mine + suffixdedup.GRAM <= w + 50)).any() for w in range(n - 49))
            alone, _ = suffixdedup.find_anchors(np.frombuffer(t, np.uint8), np.array([0]), np.array([n]))
            assert set(alone) <= set(mine)


def brute(rows):
    seen, out = {}, []
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    for i, t in order:
        key = 2**63 if i is None else i
        b = (t or "").encode()
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            seen[w] = min(seen.get(w, key), key)
    for i, t in order:
        key = 2**63 if i is None else i
        b = (t or "").encode()
        m = np.zeros(len(b) + 1, np.int64)
        for s in range(len(b) - 49):
            if seen[b[s : s + 50]] < key:
                m[s] += 1
                m[s + 50] -= 1
        gone = np.cumsum(m[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i if i is not None else -1, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    r = random.Random(9)
    line = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    passages = [line(r.randrange(45, 140)) for _ in range(12)]
    whole = line(700)
    rows = [(i, None if i % 61 == 0 else "".join(r.choice([r.choice(passages), line(r.randrange(80)), "=" * r.randrange(120)]) for _ in range(r.randrange(6)))) for i in range(260)]
    for i in range(260, 320):  # near copies of one text
        t = list(whole)
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = "Z"
        rows.append((i, "".join(t)))
    r.shuffle(rows)
    return rows + [(400, whole), (400, whole), (401, whole), (400, passages[0] + "x"), (None, whole + "y"), (None, whole + "y"), (500, "x" * 49), (501, "x" * 49)]


@pytest.mark.parametrize(("block", "fan", "hot", "chunk"), [(8 << 20, 512, 8, 4 << 20), (3000, 4, 1, 2000)])
def test_removal_matches_brute_force(spark, monkeypatch, block, fan, hot, chunk):
    for name, value in (("BLOCK", block), ("FAN", fan), ("HOT_BLOCKS", hot), ("BUCKET", 400 if hot == 1 else 2_000_000)):
        monkeypatch.setattr(suffixdedup, name, value)
    rows = corpus()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_g", T.StringType())])
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], schema)
    out = suffixdedup.remove_repeats(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute(rows)
    texts = {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in out) and len(texts)
    assert suffixdedup.remove_repeats(df.where("false")).count() == 0


def test_chunks_give_the_same_as_one_sort():
    r = random.Random(3)
    parts = [bytes(r.choice(b"abcd") for _ in range(90)) for _ in range(6)]
    texts = [b"".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(60)]
    ids, begins = np.arange(60) // 2, np.arange(60) * 7

    def covered(chunk):
        found, _ = suffixdedup.resolve(np.arange(60), ids, begins, texts, chunk)
        return {(i, p) for i, a, b in found.tolist() for p in range(a, b)}

    assert covered(1 << 20) == covered(500) == covered(1)


def test_only_recurring_windows_are_sorted(monkeypatch):
    r = random.Random(4)
    line = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n))
    phrase, passage = line(30), line(90)
    texts = [line(25) + phrase + line(25) for _ in range(200)] + [line(40) + passage, passage + line(40), phrase + b"Z" + passage[:49]]
    ids, begins = np.arange(203), np.zeros(203, np.int64)
    sizes = []
    monkeypatch.setattr(suffixdedup, "suffix_array", lambda flat: sizes.append(len(flat)) or suffix_array(flat))
    found, first = suffixdedup.resolve(ids, ids, begins, texts, survivors=True)
    assert found.tolist() == [[201, 0, 90]]
    assert (200, 0, 130) in first and (201, 41, 130) in first and (0, 0, 80) in first
    assert sum(sizes) < 400


def test_names_sort_by_doubled_prefixes():
    from veilspan.llm.suffixarray import _doubled

    r = random.Random(5)
    for k in range(300):
        names = [r.randrange(1, 1 + r.choice([1, 2, 50])) for _ in range(r.randrange(80))] * (3 if k % 4 == 0 else 1) + [0]
        assert _doubled(np.array(names, np.int32)).tolist() == sorted(range(len(names)), key=lambda i, names=names: names[i:])
