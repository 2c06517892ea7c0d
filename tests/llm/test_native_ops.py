"""Line dedup, quality rules and sharding against plain Python."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm import linededup, quality, sharding

BLANK = " \t\n\x0b\x0c\r"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("_h", T.StringType()), T.StructField("n_words", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", None) for i, t, s in rows], DOCS)


def words(t):
    out, cur = [], ""
    for c in t or "":
        if c in BLANK:
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out + ([cur] if cur else [])


def measured(t):
    t = t or ""
    w = words(t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(win)
    rep = {k for i, x in enumerate(win) if c[x] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.strip(BLANK)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(rep)


def random_texts(n, seed=1):
    r = random.Random(seed)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", " x y", "é 𝒳 é 𝒳 é 𝒳", "x " * 3000, "#|<" * 5]
    for _ in range(n):
        out.append("".join(r.choice(["a", "b", "c d", " ", "\n", "\t", "\x0b", "#", "!", "É", "\r\n", "a b c "]) for _ in range(r.randrange(120))))
    return out


def test_quality_measurements(spark):
    texts = random_texts(200)
    rows = quality.ledger(frame(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(texts[r.doc_id]), texts[r.doc_id]
        assert bool(r.fail_bits & 3) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_quality_filter_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(60))
    docs = frame(spark, [(1, good, "a"), (1, good, "a"), (None, good, None), (2, "short", "b"), (3, None, "b"), (4, good.upper(), "c")])
    assert sorted((r.doc_id or 0) for r in quality.filter_documents(docs).collect()) == [0, 1, 1]
    assert quality.filter_documents(docs).columns == docs.columns
    book = quality.ledger(docs)
    rules = {r.rule: r for r in quality.ablations(book, "full-1").collect()}
    assert rules["too_few_words"].rejected == 2 and rules["upper_case"].rejected_alone == 1
    assert quality.ledger(docs.where("false")).count() == 0
    policies = {r.doc_id: r for r in quality.apply_policies(book).collect()}
    assert policies[4].kept_base_1 and not policies[4].kept_full_1


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_matches_the_algorithm(spark):
    r = random.Random(3)
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [r.randrange(-(2**63), 2**63) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 40, 1000):
        got = df.select("k", *[c.alias(f"c{i}") for i, c in enumerate(sharding.jump_shards(F.col("k"), n, n + 1))]).collect()
        assert all((x.c0, x.c1) == (jump(x.k, n), jump(x.k, n + 1)) for x in got)


def test_shard_rows(spark):
    rows = [(i % 700 if i % 50 else None, None if i % 9 == 0 else "té" * (i % 5), "s") for i in range(2000)]
    out = sharding.shard_rows(frame(spark, rows), 7, grow_to=8, slot_buckets=5).collect()
    assert len(out) == 2000
    slots = defaultdict(list)
    for x in out:
        assert x.shard == jump(x.doc_id or 0, 7) and x.grown_shard in (x.shard, 7)
        slots[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_rows(frame(spark, rows).where("false"), 7).count() == 0


def expected_lines(rows, min_sites, share):
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(BLANK):
                sites[x.strip(BLANK)].add(s)
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    out = []
    for i, t, s in rows:
        ls = (t or "").split("\n")
        boiler = [x for x in ls if x.strip(BLANK) in bad]
        cut = boiler and 100 * sum(len(x.strip(BLANK)) for x in boiler) <= share * sum(len(x.strip(BLANK)) for x in ls)
        out.append((i, "\n".join(x for x in ls if x.strip(BLANK) not in bad) if cut else t, len(boiler)))
    return Counter(out)


def test_line_dedup(spark):
    r = random.Random(5)
    rows = [(1, None, "a"), (2, "", "b"), (None, "boiler 1\nown line that is rather long indeed, yes", None), (4, "x\r\nx", "a")]
    for i in range(400):
        ls = [f"own text {r.random()} of this document" for _ in range(r.randrange(4))] + [f"  boiler {r.randrange(6)}" for _ in range(r.randrange(3))] + [""]
        r.shuffle(ls)
        rows.append((i % 390, "\n".join(ls), f"site{r.randrange(30) if i % 3 else 0}"))
    for sites in (3, 10, 24):
        out = linededup.dedup_lines(frame(spark, rows), min_sites=sites, lg_k=4 if sites == 24 else 10, keep_first=False).collect()
        assert Counter((x.doc_id, x.text, x._n_boiler) for x in out) == expected_lines(rows, sites, 50)
    assert linededup.dedup_lines(frame(spark, rows).where("false")).count() == 0


def test_line_dedup_names_and_rows_without_id(spark):
    """Columns named like the counts stay, and rows without an id are each cut on their own text."""
    rows = [(None if i % 2 else i, f"nav\nown {i % 7}", f"s{i}", "kept", 3) for i in range(40)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("_n_cut", T.StringType()), T.StructField("_id", T.IntegerType())])
    out = linededup.dedup_lines(spark.createDataFrame(rows, schema))
    assert out.columns == [*schema.names, "_n_lines", "_n_boiler", "_n_cut_2"]
    got = Counter((r.doc_id, r.text, r._n_cut, r._id) for r in out.collect())
    first = {f"own {k}": min((i for i in range(0, 40, 2) if i % 7 == k)) for k in range(7)}
    sites = Counter(f"own {i % 7}" for i in range(40))
    want = Counter()
    for i, t, *_ in rows:
        own = t.split("\n")[1]
        left = [x for x in ("nav", own) if (i == 0 if x == "nav" else sites[x] < 10 or first[own] == i)]
        want[i, "\n".join(left) or t, "kept", 3] += 1
    assert got == want


def test_pipeline_cuts_pages_of_mostly_boilerplate(spark):
    import corpus_pipeline

    nav = [f"navigation entry number {k}" for k in range(8)]
    passage = [f"line {k} of a passage that was copied" for k in range(6)]
    rows = [(i, "\n".join([*nav, f"own {i}"]), f"site{i}") for i in range(14)]
    rows += [(100 + i, "\n".join([*passage, f"copy {i}"]), f"site{i}") for i in range(12)]
    rows += [(200 + i, "\n".join(passage), f"site{i}") for i in range(3)] + [(300, None, "a"), (301, "", "a"), (None, "\n".join([nav[0], "no id"]), None)]
    r = random.Random(9)
    rows += [(1000 + i, "\n".join(r.sample(nav, r.randrange(9)) + [f"text {r.random()}"] * r.randrange(2)), f"site{r.randrange(30)}") for i in range(200)]
    docs = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in rows], "doc_id long, text string, source string, n_chars int")
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for x in filter(None, (t or "").split("\n")):
            sites[x].add(s)
            first[x] = min(first.get(x, 10**9), 10**9 if i is None else i)
    want = Counter()
    for i, t, _ in rows:
        left = [x for x in (t or "").split("\n") if len(sites[x]) < 10 or first[x] == i or not x]
        text = "\n".join(left) if any(left) else t
        want[(i, text, len(text or ""))] += 1
    got = Counter((x.doc_id, x.text, x.n_chars) for x in corpus_pipeline.line_dedup(spark, docs, "").collect())
    assert got == want and got[(0, "\n".join([*nav, "own 0"]), len("\n".join([*nav, "own 0"])))] == 1
    assert got[(5, "own 5", 5)] == 1 and got[(105, "copy 5", 6)] == 1 and got[(201, "\n".join(passage), len("\n".join(passage)))] == 1
