"""BPE encoding and token counts against the tokenizers library."""

import hashlib
import random
import struct
import unicodedata

import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from veilspan.llm import bpe, tokencount

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "É", "Σ", "'s", "'ll", "'S", "1", "23", "$", "<|endoftext|>", "<|startoftext|>", "<|", "İ", "ß", "\x1c", "\x85", "\xa0", "　", "日本", "😀", "é", "\r\n", "\x00", "ﬁ", "...", "x" * 20]


def texts(n, seed=2):
    r = random.Random(seed)
    out = ["", "a", " ", "  a", "a  ", "\n\n a", "a" * 5000, "ab" * 3000, " " * 4000, "".join(r.choice("abcdefgh") for _ in range(20000))]
    return out + ["".join(r.choice(PARTS) for _ in range(r.randrange(50))) for _ in range(n)]


def test_token_counts_match_the_library():
    lib, mine = Tokenizer.from_file(BYTE), tokencount.TokenCounter(BYTE)
    ts = texts(3000)
    for at in range(0, len(ts), 700):
        assert [len(e.ids) for e in lib.encode_batch(ts[at : at + 700], add_special_tokens=False)] == mine.count_batch(ts[at : at + 700])


def test_word_bpe_matches_the_library():
    lib, mine = Tokenizer.from_file(WORD), bpe.WordEncoder(WORD)
    ts = texts(3000, 3)
    for at in range(0, len(ts), 700):
        want = [e.ids for e in lib.encode_batch(ts[at : at + 700], add_special_tokens=False)]
        got = mine.encode_batch(ts[at : at + 700])
        assert [struct.pack(f"<{len(i)}I", *i) for i in want] == [g for g, _ in got]
        assert [lib.decode(i, skip_special_tokens=False).encode() for i in want] == [d for _, d in got]


def test_every_code_point():
    """Both encoders give the library's tokens around every code point that Python's Unicode tables know."""
    points = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) not in ("Cn", "Co", "Cs")]
    for path, mine, ids in ((WORD, bpe.WordEncoder(WORD).encode_batch, lambda g: len(g[0]) // 4), (BYTE, tokencount.TokenCounter(BYTE).count_batch, lambda g: g)):
        lib, differ = Tokenizer.from_file(path), []
        texts_ = ["".join(f"a{c} {c}B" for c in points[at : at + 16]) for at in range(0, len(points), 16)]
        for at in range(0, len(texts_), 5000):
            want = [len(e.ids) for e in lib.encode_batch(texts_[at : at + 5000], add_special_tokens=False)]
            got = [ids(g) for g in mine(texts_[at : at + 5000])]
            differ += [at + i for i, (w, g) in enumerate(zip(want, got, strict=True)) if w != g]
        assert not [texts_[i] for i in differ]


def test_the_bounded_cache_forgets_without_changing_results(monkeypatch):
    ts = texts(600, 4)
    whole = tokencount.TokenCounter(BYTE).count_batch(ts)
    small = tokencount.TokenCounter(BYTE)
    small._known, small._pre_known = bpe.TwoAges(20), bpe.TwoAges(20)
    assert [n for at in range(0, len(ts), 10) for n in small.count_batch(ts[at : at + 10])] == whole


def test_unsafe_merges_go_left_to_right_one_at_a_time():
    table = bpe.MergeTable(BYTE)
    fast = [m.tolist() for m in bpe.merge_words(table, [b"banana" * 40, b"aaaaaaaaaaa", b"x"])]
    table.everywhere[:] = False
    assert [m.tolist() for m in bpe.merge_words(table, [b"banana" * 40, b"aaaaaaaaaaa", b"x"])] == fast


def test_frames(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("_id", T.StringType())])
    rows = [(1, "Hello wörld"), (1, "Hello wörld"), (None, "x"), (2, None), (3, ""), (4, "long " * 50000)]
    df = spark.createDataFrame([(i, t, "z", "z") for i, t in rows], schema)
    got = {(r.doc_id, r.n_tokens): r for r in bpe.encode_documents(df, WORD).collect()}
    lib = Tokenizer.from_file(WORD)
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        r = got[i, len(ids)]
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    counts = tokencount.count_tokens(df, BYTE, 5).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.over_limit) for r in counts) == [(0, 1, False), (1, 12, False), (1, 12, False), (2, 0, False), (3, 0, False), (4, 250000, True)]
    assert bpe.encode_documents(df.where("false"), WORD).count() == 0 == tokencount.count_tokens(df.where("false"), BYTE, 5).count()
