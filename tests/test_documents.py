"""JSON leaves, gateway rules, refinement, windows, languages, streams and the query catalogue."""

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from veilspan.operators import detect as D
from veilspan.operators import gateway as G
from veilspan.operators import languages as L
from veilspan.operators import leaves as J
from veilspan.operators import refine as E
from veilspan.operators import windows as N
from veilspan.sources import requests as Q
from veilspan.sources import sse
from veilspan.streaming import restore as ST
from veilspan.streaming import stats

TREE = {"to": "a@x.io", "card": 4111111111111111, "qty": 2, "ok": True, "none": None, "list": ["x", {"y": "z"}, ""], "function": {"arguments": '{"name": "é", "n": 12345678901234567890}'}}


def test_leaves_and_rebuild(spark):
    found = [(J.path_text(p), k, t) for p, k, t in J.leaves(TREE)]
    assert found == [("to", "string", "a@x.io"), ("card", "number", "4111111111111111"), ("list[0]", "string", "x"), ("list[1].y", "string", "z"), ("function.arguments.$json.name", "string", "é"), ("function.arguments.$json.n", "number", "12345678901234567890")]
    assert J.replace_leaves(TREE, lambda _, t: t) == TREE
    df = spark.createDataFrame([(1, json.dumps(TREE)), (2, "not json"), (3, None), (4, '{"a": "b"}')], "id long, body string")
    rows = J.walk(df, ["id"], "body")
    assert rows.where("id = 1").count() == 6 and [r.text for r in rows.where("id = 2").collect()] == ["not json"]
    changed = rows.where("kind = 'string'").withColumn("new_text", F.concat(F.lit("<"), "text", F.lit(">")))
    out = {r.id: r.document for r in J.put_back(df, changed, ["id"], "body").collect()}
    new = json.loads(out[1])
    assert new["to"] == "<a@x.io>" and new["card"] == 4111111111111111 and json.loads(new["function"]["arguments"]) == {"name": "<é>", "n": 12345678901234567890}
    assert out[2] == "<not json>" and out[3] is None and json.loads(out[4]) == {"a": "<b>"}


def paths(body, protocol):
    return {(J.path_text(p), a) for p, a, _, _ in G.actions(body, protocol)}


def test_gateway_rules(spark):
    body = {
        "system": [{"type": "text", "text": "sys"}],
        "tools": [{"name": "t"}],
        "messages": [
            {"role": "user", "content": "plain"},
            {"role": "assistant", "content": [
                {"type": "thinking", "thinking": "no"}, {"type": "text", "text": "yes", "extra": "no"}, {"type": "tool_use", "input": {"q": "yes"}},
                {"type": "tool_result", "content": [{"type": "text", "text": "yes"}, {"type": "image", "source": {"data": "no"}}]},
                {"type": "document", "title": "yes", "source": {"type": "base64", "data": "no"}}, {"type": "document", "source": {"type": "text", "data": "yes"}},
                {"type": "search_result", "title": "yes", "source": "yes", "content": [{"type": "text", "text": "yes"}]}, {"type": "new_block", "stdout": "yes", "blob": "no", "output": ["yes"]},
            ]},
        ],
    }
    got = [(t, a) for _, a, _, t in G.actions(body, "messages")]
    assert got[0] == ("plain", "scrub") and got[-1][1] == "gate" and all(t == "yes" for t, _ in got[1:-2]) and len(got) == 13
    items = {
        "instructions": "gated", "prompt": {"variables": {"v": "yes"}},
        "input": [
            {"role": "user", "content": [{"type": "input_text", "text": "yes"}, {"type": "input_image", "text": "no"}]}, {"type": "reasoning", "content": "no"},
            {"type": "function_call", "arguments": '{"a": "yes"}'}, {"type": "function_call_output", "output": "yes"}, {"type": "shell_call", "action": {"command": ["yes"]}},
            {"type": "message", "content": "yes"},
        ],
    }
    got = [(t, a) for _, a, _, t in G.actions(items, "responses")]
    assert got[-1] == ("gated", "gate") and all(t == "yes" for t, _ in got[:-1]) and len(got) == 7
    assert ("input[2].arguments.$json.a", "scrub") in paths(items, "responses")
    df = spark.createDataFrame([(1, json.dumps(items), "responses"), (2, "broken", "messages"), (3, None, "messages")], "id long, body string, protocol string")
    assert G.gateway_leaves(df, "id", "body", "protocol").count() == 7


@pytest.mark.parametrize(
    ("text", "found", "kind", "want"),
    [
        ("HELPDESK_EMAIL=ada@mail.test", "HELPDESK_EMAIL=ada@mail.test", "EMAIL_ADDRESS", "ada@mail.test"),
        ("  email_address = bo@mail.test", "email_address = bo@mail.test", "EMAIL_ADDRESS", "bo@mail.test"),
        ("owner=bo@mail.test", "owner=bo@mail.test", "EMAIL_ADDRESS", "owner=bo@mail.test"),
        ("ask bo@mail.test;, please", "bo@mail.test;,", "EMAIL_ADDRESS", "bo@mail.test"),
        ("<path>/srv/ada/notes</path>", "<path>/srv/ada/notes</path>", "URL", "/srv/ada/notes"),
        ("amqp://svc:k3y@broker/vhost", ":k3y@broker", "SECRET", "k3y"),
        ("amqp://:k3y@broker", ":k3y", "SECRET", "k3y"),
        ("amqp://svc:a:b@c@broker", ":a:b@c@broker", "SECRET", "a:b@c"),
        ("db://u:k3y@h?pass=2", ":k3y@h?pass=2", "SECRET", "k3y@h?pass=2"),
        ("no uri: k3y@broker", ": k3y@broker", "SECRET", ": k3y@broker"),
        ('tel "+44 20 55"', '"+44 20 55"', "PHONE_NUMBER", "+44 20 55"),
        ("tel '+44 20 55' or", "+44 20 55", "PHONE_NUMBER", "+44 20 55"),
        ('tel \\"+44 20 55"', '"+44 20 55"', "PHONE_NUMBER", '"+44 20 55"'),
        ("<bo@mail.test> wrote", "<bo@mail.test>", "EMAIL_ADDRESS", "bo@mail.test"),
        ("7| - export BUILD_KEY = q9w8", "BUILD_KEY = q9w8", "SECRET", "q9w8"),
        ("BUILD_KEY==q9w8", "BUILD_KEY==q9w8", "SECRET", "BUILD_KEY==q9w8"),
        ("ZXCV0000QWERTY99X=on", "ZXCV0000QWERTY99X=on", "SECRET", "ZXCV0000QWERTY99X=on"),
        ("ADA_STONE=admin", "ADA_STONE=admin", "PERSON", "ADA_STONE=admin"),
    ],
)
def test_refinement(text, found, kind, want):
    a = text.index(found)
    start, end = E.fit(text, kind, a, a + len(found))
    assert text[start:end] == want


def test_model_spans_are_cut_at_assignments():
    text = "X_KEY=red\nY_KEY=tan\r\n"
    assert [text[a:b] for a, b in E.fit_model_span(text, "SECRET", 0, len(text))] == ["red", "tan"]
    assert E.fit_model_span(text, "SECRET", 1, 4) == [] and E.fit_model_span(text, "SECRET", 3, 3) == []


def test_refinement_of_one_long_line_is_bounded(spark):
    line = ",".join(f'{{"u":"https://a:b{i}@h/x"}}' for i in range(2000))
    at = [i for i in range(len(line)) if line.startswith(":b", i)]
    assert all(line[slice(*E.fit(line, "SECRET", i, i + 4))].startswith("b") for i in at)


def test_windows(spark):
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice("abc ") for _ in range(r.randrange(1, 200)))
        chunks = N.char_chunks(t, 40, 10)
        assert all(t[o : o + len(c)] == c and len(c) <= 40 for o, c in chunks)
        assert chunks[0][0] == 0 and chunks[-1][0] + len(chunks[-1][1]) == len(t) and all(b[0] <= a[0] + len(a[1]) for a, b in zip(chunks, chunks[1:], strict=False))
    df = spark.createDataFrame([(n,) for n in (0, 1, 1023, 1024, 1025, 5000)], "n int")
    for row in df.select("n", N.token_ranges(F.col("n")).alias("r"), N.covers(N.token_ranges(F.col("n")), F.col("n")).alias("ok")).collect():
        assert row.ok and (not row.r or row.r[-1].last == row.n)
        assert all(b.first == a.last - 128 for a, b in zip(row.r, row.r[1:], strict=False))


def test_stitch_and_decode(spark):
    n = 40
    labels = ["B-x", "I-x", "E-x", "O", "S-y"] * 8
    offsets = [(2 * i, 2 * i + 1) for i in range(n)]
    parts = [(labels[a:b], [0.5] * (b - a), offsets[a:b]) for a, b in ((0, 16), (12, 28), (24, 40))]
    assert N.stitch(parts, 4) == (labels, [0.5] * n, offsets) and N.stitch([], 4) == ([], [], [])
    text = "a " * n
    spans = N.decode_tags(labels, [0.5] * n, offsets, text)
    assert len(spans) == 16 and spans[0] == ("x", 0, 5, 0.5) and spans[1] == ("y", 8, 9, 0.5)
    assert N.decode_tags(["B-p"], [1.0], [(6, 8)], "/Users/marie x") == [("p", 7, 12, 1.0)]
    r = random.Random(2)
    rows, want = [], set()
    for d in range(60):
        ls = [r.choice(["O", "B-x", "I-x", "E-x", "S-x", "I-y", "E-y"]) for _ in range(20)]
        rows += [(d, i, s, 1.0, i * 2, i * 2 + 1) for i, s in enumerate(ls)]
        want |= {(d, k, a, b) for k, a, b, _ in N.decode_tags(ls, [1.0] * 20, [(i * 2, i * 2 + 1) for i in range(20)], "a" * 60)}
    got = N.tag_islands(spark.createDataFrame(rows, "d long, pos int, label string, score double, start int, end int"), ["d"]).collect()
    assert {(x.d, x.entity_type, x.start, x.end) for x in got} == want


LANGUAGE_CASES = [
    ("fr", "je m'appelle jean michel et toi", {("PERSON", "jean michel")}),
    ("fr", "Je m’appelle Jean  Dupont", {("PERSON", "Jean  Dupont")}),
    ("en", "I'm ready to go", set()),
    ("en", "I'm Marie Curie", {("PERSON", "Marie Curie")}),
    ("de", "Name: Anna Berg", {("PERSON", "Anna Berg")}),
    ("it", "via Roma 12", {("LOCATION", "Roma")}),
    ("en", "via Roma 12", set()),
    ("en", "11 April", set()),
    ("fr", "le 11 avril 2020.", {("DATE_TIME", "11 avril 2020"), ("DATE_TIME", "avril 2020"), ("DATE_TIME", "11 avril")}),
    ("fr", "3 maintenant", set()),
    ("en", "born 01/02/1990", {("DATE_TIME", "born 01/02/1990")}),
]


def test_languages(spark):
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t, _) in enumerate(LANGUAGE_CASES)], "doc_id long, lang string, text string")
    rows = D.span_rows(L.detect_by_language(df), ["doc_id"]).collect()
    for i, (_, text, want) in enumerate(LANGUAGE_CASES):
        mine = [r for r in rows if r.doc_id == i]
        assert {(r.entity_type, r.text) for r in mine} == want, text
        assert all(text[r.start : r.end] == r.text for r in mine)


def test_holdback_at_every_split():
    mapping = {"<PERSON_1>": 'Zo"é', "<PERSON_12>": "B", "Michel": "Jean"}
    whole = "Hi <PERSON_12>, <PERSON_1>! <PERS Michel Mich <PERSON_3>"
    want = 'Hi B, Zo"é! <PERS Jean Mich <PERSON_3>'
    for i in range(len(whole)):
        for j in range(i, len(whole), 5):
            h = ST.Holdback(mapping)
            assert h.feed(whole[:i]) + h.feed(whole[i:j]) + h.feed(whole[j:]) + h.flush() == want
    h = ST.Holdback(mapping, is_json=True)
    assert h.feed('{"a": "<PERSON_1>"}') == '{"a": "Zo\\"é"}'


def test_stream_and_stats(spark, tmp_path):
    rows = [("s", "text", 0, "Hi <PER", False, False, '{"<PERSON_1>": "Ann"}'), ("s", "text", 1, "SON_1>! <P", False, True, None), ("t", "text", 0, "x <", False, True, "{}")]
    schema = "stream_id string, channel string, seq long, fragment string, is_json boolean, flush boolean, mapping string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = ST.restore_stream(stream).writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("restored").orderBy("seq").collect():
        got[r.stream_id] = got.get(r.stream_id, "") + r.text
    assert got == {"s": "Hi Ann! <P", "t": "x <"}
    batch = {r.stream_id: r.text for r in ST.restore_batch(spark.createDataFrame(rows, schema)).collect()}
    assert batch == got
    seen = spark.createDataFrame([("u", "2024-01-01 00:00:00", "A"), ("u", "2024-01-01 00:30:00", "A"), ("u", "2024-01-01 05:00:00", "A")], "session string, ts string, entity_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in stats.session_counts(seen, "salt").collect()) == [1, 2]


def test_sources(spark):
    text = 'event: a\r\ndata: {"x": 1}\r\n\r\n: note\n\ndata: [DONE]\n\n'
    rows = sse.events(spark.createDataFrame([(1, text)], "id long, body string"), "body", "id").orderBy("seq").collect()
    assert [(r.event, r.data, r.is_json) for r in rows] == [("a", '{"x": 1}', True), ("", "", False), ("", "[DONE]", False)]
    body = json.dumps({"model": "m", "messages": [{"role": "user", "content": "hi"}]})
    df = spark.createDataFrame([("r", body, None)], "request string, body string, odd string")
    assert [(r.ordinal, r.content) for r in Q.message_rows(df, "request", "body").collect()] == [(0, "hi")]
    assert Q.within_limit(df, "body", 10).count() == 0 and Q.forwarded_fields(df, ["request"]).first().refused == "body"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
