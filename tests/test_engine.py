"""The whole call, requests as leaves, reply trees, stand-ins by policy, and streams that break off."""

import json

import pytest
from pyspark.sql import functions as F

from veilspan import engine
from veilspan.config import Config
from veilspan.operators import anonymize as A
from veilspan.operators import detect as D
from veilspan.operators import gateway as G
from veilspan.operators import policy as P
from veilspan.operators import restore as R
from veilspan.operators.secrets import SECRET_RULES
from veilspan.sources import requests as Q
from veilspan.streaming import restore as ST


def test_protect(spark):
    texts = [
        (1, 'api_key="q8w7e6r5t4"\nthen q8w7e6r5t4, not xq8w7e6r5t4', "x"), (2, "mail bo@mail.test; or bo@mail.test and <EMAIL_ADDRESS_1>", None), (3, "tel +1 (555) 123-4567", "x"),
        (4, None, "x"), (5, "", "x"), (6, "10.0.0.1 and 10.0.0.2 and 203.0.113.9", "x"), (6, "10.0.0.1 and 10.0.0.2 and 203.0.113.9", "x"), (7, "plain " * 20000, "x"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string, _spans string")
    p = engine.Protection(rules=(*D.COMMON, *SECRET_RULES), allow=(P.AllowRule(pattern=r"10\..*"),), blocked=("PHONE_NUMBER",))
    out = engine.protect(df.withColumnRenamed("_spans", "extra"), p)
    assert out.columns == ["doc_id", "text", "extra", "anonymized", "refused", "n_spans", "originals", "types", "fakes"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].anonymized == 'api_key="[SECRET]"\nthen [SECRET], not xq8w7e6r5t4' and rows[1].n_spans == 2 and rows[1].originals == []
    assert rows[2].anonymized == "mail <EMAIL_ADDRESS_2>; or <EMAIL_ADDRESS_2> and <EMAIL_ADDRESS_1>" and rows[2].originals == ["bo@mail.test"]
    assert rows[3].anonymized is None and rows[3].refused == ["PHONE_NUMBER"] and rows[3].originals == []
    assert rows[4].anonymized is None and rows[4].n_spans == 0 and rows[4].refused == [] and rows[5].anonymized == ""
    assert rows[6].anonymized == "10.0.0.1 and 10.0.0.2 and <IP_ADDRESS_1>" and rows[7].anonymized == texts[-1][1]
    assert out.count() == len(texts) and engine.leaks(out).count() == 0
    assert {(r.entity_type, r.n) for r in engine.count_types(out).collect()} == {("EMAIL_ADDRESS", 1), ("IP_ADDRESS", 2)}
    back = {r.doc_id: r.restored for r in engine.restore(out, "anonymized").collect()}
    assert back[2] == texts[1][1] and back[6] == texts[5][1]
    assert engine.protect(df.drop("_spans").where("false"), p).count() == 0


def test_protect_by_configuration(spark):
    config = Config(preset="light", languages=("en",), method="redact", overrides={"EMAIL_ADDRESS": {"method": "mask", "masking_char": "#"}}, custom={"TICKET": r"t-\d+"}, allow=({"value": "t-1"},))
    df = spark.createDataFrame([("my name is Ann Lee, T-77 by a@b.io", "en"), ("t-1 je m'appelle Ann", "en")], "text string, lang string")
    got = [r.anonymized for r in engine.protect(df, config, lang_col="lang").collect()]
    assert got == ["my name is [PERSON], [TICKET] by ######", "t-1 je m'appelle Ann"]
    with pytest.raises(ValueError, match="methods are"):
        Config(preset="light", method="shuffle").policy()


def test_in_row_and_table_forms_agree(spark):
    texts = spark.createDataFrame([(i, f"a{i % 3}@x.io b@x.io a{i % 3}@x.io 192.168.{i}.1 <IP_ADDRESS_1> 4111 1111 1111 1111" * (i % 4)) for i in range(40)], "doc_id long, text string")
    found = engine.find(texts, engine.Protection(rules=D.COMMON))
    rows = D.span_rows(found.withColumn("request", F.col("doc_id")), ["request", "doc_id"])
    table = {r.doc_id: r.anonymized for r in A.anonymize(texts.withColumn("request", F.col("doc_id")), rows, "request", "doc_id").collect()}
    assert {r.doc_id: r.anonymized for r in engine.protect(texts, engine.Protection(rules=D.COMMON)).collect()} == table


def test_stand_ins_by_policy(spark):
    rows = spark.createDataFrame([("r", 1, "bo@x.io", 0, "EMAIL_ADDRESS"), ("r", 2, "bo@x.io", 5, "EMAIL_ADDRESS"), ("r", 2, "al@x.io", 15, "EMAIL_ADDRESS"), ("r", 3, "Ann", 0, "PERSON")], "request string, n int, text string, start int, entity_type string")
    policy = A.Policy(overrides={"EMAIL_ADDRESS": A.Method("fake_replacement")})
    got = {r.original: r.fake for r in A.mapping_table(rows, "request", "n", policy).collect()}
    assert got["Ann"] == "<PERSON_1>" and len(set(got.values())) == 3 and all(got[v].endswith("@example.net") for v in ("bo@x.io", "al@x.io"))
    with pytest.raises(ValueError):
        A.anonymize_column(F.col("text"), F.col("s"), policy)
    assert {r.entity_type: r.n for r in A.type_counts(rows.unionByName(rows.selectExpr("request", "4 AS n", "text", "start", "'X' AS entity_type")), "request", "n").collect()} == {"EMAIL_ADDRESS": 2, "PERSON": 1}


CHAT = {
    "messages": [
        {"role": "system", "content": "sys"},
        {"role": "user", "content": ["a", {"type": "text", "text": "b"}, {"type": "image_url", "image_url": {"url": "no"}}], "refusal": "c", "audio": {"transcript": "d", "data": "no"}},
        {"role": "assistant", "content": None, "tool_calls": [{"id": "no", "function": {"name": "no", "arguments": '{"x": ["e", 1234567, true]}'}}], "function_call": {"name": "no", "arguments": "f"}},
    ],
    "prediction": {"content": "g"}, "web_search_options": {"user_location": {"city": "h"}}, "model": "no",
}


def test_request_leaves(spark):
    bodies = [("chat", CHAT), ("odd", {"messages": [{"role": "user", "content": {"weird": "w"}}]}), ("list", [1]), ("empty", {})]
    df = spark.createDataFrame([(n, json.dumps(b)) for n, b in bodies] + [("null", None), ("broken", "{")], "id string, body string")
    rows = Q.request_leaves(df, "id", "body", "chat").collect()
    assert [r.text for r in sorted((r for r in rows if r.id == "chat"), key=lambda r: r.ordinal)] == ["sys", "a", "b", "c", "d", "e", "1234567", "f", "g", "h"]
    assert [(r.path, r.text) for r in rows if r.id == "odd"] == [("messages[0].content.weird", "w")]
    assert {r.id: r.refused for r in rows if r.refused} == {"list": "body", "null": "body", "broken": "body"}
    strict = Q.request_leaves(df, "id", "body", "chat", passthrough_system=True, passthrough_tools=True, strict=True).collect()
    assert [r.text for r in strict if r.id == "chat"] == ["a", "b", "c", "d", "g", "h"] and [r.refused for r in strict if r.id == "odd"] == ["messages[0].content"]
    scopes = Q.request_leaves(spark.createDataFrame([("e", '{"input": ["x", "y"]}'), ("s", '{"input": "z"}')], "id string, body string"), "id", "body", "embeddings")
    assert {(r.id, r.scope, r.text) for r in scopes.collect()} == {("e", 0, "x"), ("e", 1, "y"), ("s", 0, "z")}
    changed = Q.request_leaves(df, "id", "body", "chat").where("text is not null").selectExpr("id", "ordinal", "concat('<', text, '>') AS new_text")
    back = {r.id: r.body for r in Q.put_leaves(df, changed, "id", "body", "chat").collect()}
    new = json.loads(back["chat"])
    assert new["messages"][1]["content"][:2] == ["<a>", {"type": "text", "text": "<b>"}] and new["model"] == "no" and back["null"] is None and back["empty"] == "{}"
    assert json.loads(new["messages"][2]["tool_calls"][0]["function"]["arguments"]) == {"x": ["<e>", "<1234567>", True]}


def test_gateway_items():
    body = {"input": [
        {"type": "shell_call_output", "output": [{"stdout": "yes", "stderr": "yes"}]}, {"type": "computer_call_output", "output": "no"},
        {"type": "additional_tools", "role": "developer", "content": "yes"}, {"type": "additional_tools", "role": "developer"},
        {"type": "function_call_output", "output": [{"type": "input_image", "image_url": "no"}, {"type": "note", "any": "yes"}]},
        {"type": "custom_tool_call", "input": "yes", "name": "no"}, {"type": "mcp_call", "arguments": '{"q": "yes"}', "output": "yes"},
        {"type": "code_interpreter_call", "code": "yes", "outputs": [{"type": "image", "url": "no"}]},
    ], "prompt": {"id": "no", "variables": {"v": "yes", "p": {"type": "input_file", "file_data": "no"}}}}
    got = [t for _, _, _, t in G.actions(body, "responses")]
    assert [t for t in got if t != "note"] == ["yes"] * 9


@pytest.mark.parametrize("pattern", [".*@.*", r"\S+ \S+", r"https://.*", r"[0-9.]+", r"[A-Z]{2}[0-9 ]+", r"\d{4}-\d\d-\d\d", ""])
def test_broad_allow_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        P.AllowRule(pattern=pattern)


def test_reply_trees():
    table = {"<PERSON_1>": 'Zo "é"', "<PERSON_12>": "B"}
    tree = {"type": "x", "a": ["<PERSON_12>", 3, {"type": "thinking", "t": "<PERSON_1>"}], "arguments": '{"n": "<PERSON_1>"}', "s": {"type": {"type": "string"}, "d": "<PERSON_1>"}}
    got = R.restore_tree(tree, table, G.THINKING)
    assert got["a"] == ["B", 3, {"type": "thinking", "t": "<PERSON_1>"}] and json.loads(got["arguments"]) == {"n": 'Zo "é"'} and got["s"]["d"] == 'Zo "é"'
    assert R.restore_tree({"arguments": "not json <PERSON_12>"}, table) == {"arguments": "not json B"}
    assert [R.is_placeholder(x) for x in ("<PERSON_1>", "<A_B_22>", "<a_1>", "<_1>", "<A1>", "PERSON_1", "<A_x>", "<>", "")] == [True, True, True, False, False, False, False, False, False]
    assert R.restore_fuzzy("Dear Michael Jonson, hi", {"Michael Johnson": "Ann Lee"}) == "Dear Ann Lee, hi"


def test_a_quiet_stream_is_drained(spark, tmp_path):
    import time

    schema = "stream_id string, channel string, seq long, fragment string, is_json boolean, flush boolean, mapping string"
    source = tmp_path / "in"
    spark.createDataFrame([("s", "text", 0, "Hi <PERSON_1", False, False, '{"<PERSON_1>": "Ann"}')], schema).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = ST.restore_stream(stream, idle_ms=1).writeStream.format("memory").queryName("drained").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("drained").count() < 2:
            time.sleep(1)
    finally:
        q.stop()
    assert [r.text for r in spark.table("drained").orderBy("seq").collect()] == ["Hi ", "<PERSON_1"]
