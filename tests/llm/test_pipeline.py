"""The pipeline's stages, each on its own input."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from tests.llm.test_chat_and_mixing import expected_targets
from tests.llm.test_minhash import brute
from tests.llm.test_native_ops import measured, words
from veilspan.llm.common import stage_table, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, SF), "test")
        out.append(docs)
    return out


def test_columns_and_decisions(steps):
    raw, quality, lines, near, mixed, tokens = steps
    for step in (quality, lines, near, mixed):
        assert step.columns == raw.columns
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in steps]
    assert set(ids[1]) < set(ids[0]) and sorted(ids[2]) == sorted(ids[1])
    assert set(ids[3]) < set(ids[2]) and len(set(ids[3])) == len(ids[3])
    assert set(ids[4]) <= set(ids[3]) and max(Counter(ids[4]).values()) <= 3
    assert sorted(ids[5]) == sorted(ids[4])


def test_no_near_duplicates_are_left(steps):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    kept = {r.doc_id: shingles(r.text) for r in steps[3].collect()}
    before = {r.doc_id: shingles(r.text) for r in steps[2].collect()}
    close = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    ids = sorted(kept)
    assert not any(close(kept[i], kept[j]) for n, i in enumerate(ids) for j in ids[n + 1 :])
    for i in set(before) - set(kept):
        assert any(close(before[i], s) for j, s in before.items() if j < i)


def test_tokens(steps):
    check_tokens(steps[4].collect(), steps[5].collect())


def check_tokens(rows, encoded):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter((r.doc_id, tuple(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded) == want


def passes(text):
    """The rules of the full policy in plain Python."""
    n, chars, symbols, dups, repeats = measured(text)
    t = text or ""
    lines = sum(bool(words(x)) for x in t.split("\n"))
    return not (
        n < 50 or 100 * repeats > 50 * n or 100 * symbols > 30 * n or 100 * t.count("!") > 50 * n or 100 * sum("A" <= c <= "Z" for c in t) > 50 * chars
        or (lines >= 4 and 100 * dups > 50 * lines) or 10 * chars < 15 * n or chars > 25 * n
    )


def without_boilerplate(rows):
    """(id, text) after the line stage."""
    sites, first = defaultdict(set), {}
    for r in rows:
        for x in filter(words, (r["text"] or "").split("\n")):
            x = x.strip(" \t\n\x0b\x0c\r")
            sites[x].add(r["source"])
            if r["doc_id"] is not None:
                first[x] = min(first.get(x, r["doc_id"]), r["doc_id"])
    out = []
    for r in rows:
        ls = [(x, x.strip(" \t\n\x0b\x0c\r")) for x in (r["text"] or "").split("\n")]
        left = [x for x, t in ls if not (t and len(sites[t]) >= 10 and first.get(t) != r["doc_id"])]
        out.append({**r, "text": "\n".join(left) if any(map(words, left)) and len(left) < len(ls) else r["text"]})
    return out


def test_all_stages_against_plain_python(spark, tmp_path):
    """Null, empty, repeated and long rows, rows without id or source, and columns named like the stages' own."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    nav = [" ".join(word() for _ in range(6)) for _ in range(4)]
    schema = T.StructType([T.StructField(n, k) for n, k in (
        ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("_rank", T.LongType()),
        ("_n_cut", T.StringType()), ("_id", T.StringType()), ("_size", T.StringType()), ("_row", T.IntegerType()), ("text_", T.StringType()),
    )])

    def row(i, text, source):
        return {"doc_id": i, "text": text, "lang": "en", "source": source, "n_chars": len(text or ""), "_rank": i, "_n_cut": "x", "_id": str(i), "_size": None, "_row": 1, "text_": "y"}

    rows = []
    for i in range(150):
        body = [" ".join(word() for _ in range(10)) for _ in range(r.randrange(3, 12))]
        rows.append(row(i, "\n".join([*r.sample(nav, 2), *body]), f"s{i % 13}" if i % 3 else "hot"))
    for i in range(150, 190):  # copies with a word or two changed
        ws = rows[i - 150]["text"].split(" ")
        ws[r.randrange(len(ws))] = word()
        rows.append(row(i, " ".join(ws), f"s{i % 13}"))
    rows += [row(200, None, "s1"), row(201, "", None), row(202, "short", "s2"), row(203, "A B " * 50, "s2"), row(204, " ".join(word() for _ in range(9000)), None), row(205, "# " * 90, "hot")]
    rows += [rows[4], rows[4], row(None, rows[9]["text"], "s5"), row(None, " ".join(word() for _ in range(70)), "s6")]
    docs = spark.createDataFrame([tuple(x.values()) for x in rows], schema)
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, ""), "test")
        steps.append(docs)
    as_rows = lambda df: Counter(tuple(x) for x in df.collect())
    packed = lambda xs: Counter(tuple(x.values()) for x in xs)
    assert all(s.columns == schema.names for s in steps[:4])

    good = [x for x in rows if passes(x["text"])]
    assert as_rows(steps[0]) == packed(good) and 150 < len(good) < len(rows)
    cut = [{**x, "n_chars": len(x["text"])} for x in without_boilerplate(good)]
    assert as_rows(steps[1]) == packed(cut) and cut != good
    component = brute([(x["doc_id"], x["text"]) for x in cut], 5, 80)
    with_id = {x["doc_id"]: x for x in cut if component.get(x["doc_id"]) == x["doc_id"] and x["doc_id"] is not None}
    alone = [x for x in cut if x["doc_id"] is None and x["text"] not in {y["text"] for y in cut if y["doc_id"] is not None}]
    assert as_rows(steps[2]) == packed([*with_id.values(), *alone]) and len(with_id) < 160
    kept = [*with_id.values(), *alone]
    size = defaultdict(int)
    for x in kept:
        size[x["source"]] += len(words(x["text"]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, expected_targets([size[s] for s in order], [(1, 2, 3)[k % 3] for k in range(len(order))]), strict=True))
    mixed = as_rows(steps[3])
    assert set(mixed) <= set(packed(kept)) and max(mixed.values()) <= 3
    for s in order:
        took = sum(n * len(words(x[1])) for x, n in mixed.items() if x[3] == s)
        assert goal[s] - max(len(words(x["text"])) for x in kept if x["source"] == s) <= took <= goal[s] + 1e-6
    check_tokens(steps[3].collect(), steps[4].collect())


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, SF), "test")
        assert docs.count() == 0
