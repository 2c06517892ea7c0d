"""Chat formatting and source mixing."""

import hashlib
import json
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm import chat, mixing


def test_escape_is_reversible_and_leaves_no_control_string():
    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice([*chat.CONTROL, chat.ESCAPE, "<", "|", "n", "\n", "s>", "/", "a", chat.START, chat.END]) for _ in range(r.randrange(12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)
        turns = [(t, t), ("assistant", t), ("user", "")]
        text, loss = chat.render(turns)
        assert chat.parse(text) == turns
        assert "".join(chat.unescape(text[a:b]) for a, b in loss) == t * (2 if t == "assistant" else 1)


def test_layouts():
    cases = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 4}, [("user", "q"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "output": "o", "meta": {"a": [1]}}, [("user", "i"), ("assistant", "o")]),
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"question": "p", "answer": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"role": "human", "text": "t", "turn": 3}, [("human", "t")]),
    ]
    for record, turns in cases:
        assert chat.turns_of(record)[2] == turns
    assert chat.turns_of({"other": 1})[1] is None and chat.turns_of([1])[1] is None
    assert chat.fingerprint(chat.field_paths({"a": [{"b": 1}, {"c": None}]})) == chat.fingerprint({"a[].b", "a[].c"})


def test_chat_frames(spark):
    rows = [(1, 0, json.dumps({"role": "user", "text": None})), (1, 1, json.dumps({"role": "assistant", "text": "a\nb"})), (None, 0, json.dumps({"role": None, "text": "x"})), (2, 0, None), (3, 0, "not json"), (1, 1, json.dumps({"role": "assistant", "text": "a\nb"}))]
    df = spark.createDataFrame(rows, "id long, turn long, record string")
    turns = chat.to_turns(df, "id", "record", "turn")
    assert turns.count() == 6
    back = {r._id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert set(back) == {1, None}
    assert back[1].n_turns == 3 and back[1].loss_chars == 6
    assert back[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\na\nb\nassistant\na\nb\n").hexdigest()
    assert chat.format_chats(chat.to_turns(df.where("false"), "id", "record")).count() == 0


def expected_targets(sizes, weights, most=3):
    """Exact shares: sources in the order in which a rising level fills them up."""
    left, open_ = Fraction(sum(sizes)), Fraction(sum(weights))
    out, unit = [Fraction(0)] * len(sizes), None
    for i in sorted(range(len(sizes)), key=lambda i: Fraction(most * sizes[i], weights[i])):
        if unit is None and left * weights[i] <= most * sizes[i] * open_:
            unit = left / open_
        if unit is None:
            out[i] = Fraction(most * sizes[i])
            left, open_ = left - out[i], open_ - weights[i]
        else:
            out[i] = unit * weights[i]
    return [float(x) for x in out]


def targets(spark, sizes):
    rows = [(None if k == len(sizes) - 1 else f"s{k:06d}", n) for k, n in enumerate(sizes)]
    found = {r._s: r for r in mixing.source_targets(spark.createDataFrame(rows, "_source string, _size long")).collect()}
    assert all(found[s].source_size == n for s, n in rows)
    return [found[s].target for s, _ in rows]


@pytest.mark.parametrize("sizes", [[100, 10, 1000], [0, 0], [5], [1, 10**9, 1, 7, 0, 3, 10**6, 50], [10**k for k in range(9)]])
def test_targets(spark, sizes):
    want = expected_targets(sizes, [(1, 2, 3)[k % 3] for k in range(len(sizes))])
    assert targets(spark, sizes) == pytest.approx(want, rel=1e-12) and abs(sum(want) - sum(sizes)) < 1e-6 * sum(sizes) + 1e-9


def test_targets_of_very_many_sources(spark):
    r = random.Random(12)
    sizes = [int(r.paretovariate(0.7)) for _ in range(15_000)]
    assert targets(spark, sizes) == pytest.approx(expected_targets(sizes, [(1, 2, 3)[k % 3] for k in range(len(sizes))]), rel=1e-12)


def test_splits_are_hypergeometric():
    """The first half's share of three quotas over many seeds, against the exact distribution."""
    quotas, n = [3, 2, 4], 4000
    seen = Counter(tuple(mixing.split_quotas(quotas, 2, s)[0].tolist()) for s in range(n))
    ways = {(a, b, 4 - a - b): math.comb(3, a) * math.comb(2, b) * math.comb(4, 4 - a - b) for a in range(4) for b in range(3) if 0 <= 4 - a - b <= 4}
    total = sum(ways.values())
    assert set(seen) <= set(ways) and total == math.comb(9, 4)
    assert sum((seen[k] - n * w / total) ** 2 / (n * w / total) for k, w in ways.items()) < 35


def test_large_draws_stay_exact(monkeypatch):
    monkeypatch.setattr(mixing, "MOST_DRAWN", 50)
    q = [1000, 3, 0, 77, 12345]
    leaves = mixing.split_quotas(q, 7, 3)
    assert leaves.sum(0).tolist() == q and leaves.min() >= 0 and max(leaves.sum(1)) - min(leaves.sum(1)) <= 3
    assert mixing.split_quotas(q, 2, 3, [5000, 8425]).sum(1).tolist() == [5000, 8425]


def test_tree_keeps_quotas():
    q = [100, 0, 7, 1024]
    leaves = mixing.split_quotas(q, 13, 1)
    assert leaves.sum(0).tolist() == q and leaves.min() >= 0
    assert max(leaves.sum(1)) - min(leaves.sum(1)) <= 4
    assert (leaves == mixing.split_quotas(q, 13, 1)).all()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    rows = [(i, None if i % 97 == 0 else " ".join(["w"] * r.randrange(40)), None if i % 11 == 0 else ("hot" if i % 2 else f"s{i % 5}"), "x") for i in range(4000)]
    rows += [rows[5]] * 3 + [(None, "null id", "hot", "x")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("_block", T.StringType())])
    return spark.createDataFrame(rows, schema).cache()


def test_mix_meets_targets(spark, docs):
    out = mixing.mix(docs, shards=5).collect()
    assert len(out) == docs.count()
    source = {r.doc_id: r.source for r in docs.collect()}
    size, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in out:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.size * len(r.copies)
        goal[s] = r.target
        assert len(r.copies) <= 3 and all(0 <= c.shard < 5 for c in r.copies)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = expected_targets([size[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])
    for s, t in zip(order, want, strict=True):
        assert abs(goal[s] - t) < 1e-6 and t - 30 <= taken[s] <= t
    assert sorted((r.doc_id or -1, len(r.copies)) for r in mixing.mix(docs, shards=5).collect()) == sorted((r.doc_id or -1, len(r.copies)) for r in out)
    whole = mixing.mixed_documents(docs, shards=5)
    assert whole.columns == docs.columns and whole.count() == sum(len(r.copies) for r in out)


def test_rows_follow_the_tree(spark, docs):
    """Every copy is one draw of a shard: whole blocks pass by pass, then single rows of one block of the source."""
    shards = 5
    body = docs.select("doc_id", "text", "source", F.xxhash64(F.lit(17), "doc_id", "text", "source").alias("h"))
    blocks = {r.doc_id: (r.source, r.b, r.h) for r in body.select("*", mixing.block_of(F.col("h"), mixing.LEAST_BLOCKS).alias("b")).collect()}
    whole, rows_in, passes = defaultdict(set), defaultdict(set), {}
    drawn = defaultdict(lambda: defaultdict(set))
    for r in mixing.mix(docs, shards=shards).collect():
        source, block, h = blocks[r.doc_id]
        rows_in[source, block].add(h)
        passes[source] = min(passes.get(source, 9), len(r.copies))
        assert [c["pass"] for c in r.copies] == list(range(len(r.copies)))
        for c in r.copies:
            drawn[source, block, c["pass"]][c.shard].add(h)
    single = defaultdict(dict)
    for (source, block, e), by_shard in drawn.items():
        if set().union(*by_shard.values()) == rows_in[source, block] and len(by_shard) == 1:
            whole[source].add((e, block, next(iter(by_shard))))
        else:
            single[source].update({(block, h): s for s, hs in by_shard.items() for h in hs})
    quotas = Counter(s for draws in whole.values() for _, _, s in draws) + Counter(s for rows in single.values() for s in rows.values())
    assert max(quotas.values()) - min(quotas.get(s, 0) for s in range(shards)) <= 3
    for source, draws in whole.items():
        present = {b for s, b in rows_in if s == source}
        owners = [{b: s for e, b, s in draws if e == p} for p in range(passes[source])]
        assert all(set(o) == present for o in owners)
        # All passes go over the blocks in one order, so a block's shard never falls from one pass to the next.
        assert all(a[b] <= z[b] for a, z in zip(owners, owners[1:], strict=False) for b in a)
    for rows in single.values():
        assert sum(n > 1 for n in Counter(b for b, _ in rows).values()) <= 2
    assert {r.doc_id for r in mixing.mix(docs, shards=1).collect() if r.copies} == {r.doc_id for r in mixing.mix(docs, shards=shards).collect() if r.copies}
    assert {r.doc_id for r in mixing.mix(docs, seed=18).collect() if r.copies} != {r.doc_id for r in mixing.mix(docs).collect() if r.copies}


def test_mix_of_nothing(docs):
    assert mixing.mix(docs.where("false"), shards=2).count() == 0
