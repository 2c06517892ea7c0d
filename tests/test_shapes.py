"""Shape filters, stand-ins, event plans and configuration."""

import json

import pytest
from pyspark.sql import functions as F

from veilspan import config
from veilspan.operators import fakes, shapes
from veilspan.streaming import events


def test_names_and_dates(spark):
    names = {"Marie Dupont": True, "Ludwig van Beethoven": True, "Marie": False, "marie dupont": False, "A B C D E": False, "Foo = Bar": False, "Marie\nDupont": False, "Élodie Ça": True}
    got = spark.createDataFrame([(n,) for n in names], "t string").select("t", shapes.looks_like_name(F.col("t")).alias("ok")).collect()
    assert {r.t: r.ok for r in got} == names
    cases = {"October 9, 1954": ["October 9, 1954"], "connect(api_key": [], "f(2021, x) = 5": ["2021, x", "5"], "twenty (20) years": ["twenty (20) years"]}
    got = spark.createDataFrame([(n,) for n in cases], "t string").select("t", shapes.date_pieces(F.col("t"), F.lit(10)).alias("p")).collect()
    for r in got:
        assert [p.text for p in r.p] == cases[r.t]
        assert all(r.t[p.start - 10 : p.end - 10] == p.text for p in r.p)


def test_pieces_words_and_coverage():
    text = "one two\nthree four five six seven " * 9
    ranges = shapes.parse_pieces(text, 40)
    assert ranges[0][0] == 0 and ranges[-1][1] == len(text) and all(a[1] == b[0] and a[1] - a[0] <= 40 for a, b in zip(ranges, ranges[1:], strict=False))
    assert shapes.whole_words("Hello Marie-Claire", 7, 9) == (6, 11) and shapes.whole_words("SMTP_HOST", 6, 8) == (5, 9)
    assert shapes.whole_words("x" * 200, 100, 101) == (100, 101)
    assert shapes.with_marks("é!", 1) == 2 and shapes.harmless("́") and not shapes.harmless("a")
    shapes.check_coverage([(0, 2), (3, 5)], "ab cd ")
    for bad in ([(0, 2)], [(3, 5)], [(0, 9)]):
        with pytest.raises(RuntimeError):
            shapes.check_coverage(bad, "ab cd ")


def test_stand_ins(spark):
    assert fakes.stand_in("PERSON", " Ann ") == fakes.stand_in("PERSON", "ann") and fakes.stand_in("X", "a").startswith("[X_")
    table = fakes.assign([("PERSON", f"p{i}") for i in range(40)])
    assert len(set(table.values())) == 40
    with pytest.raises(fakes.StandInsExhausted, match="SECRET"):
        fakes.assign([("SECRET", "a"), ("SECRET", "b")])
    rows = spark.createDataFrame([("r", 0, "PERSON", "Ann", 0), ("r", 1, "PERSON", "Ann", 3), ("r", 0, "URL", "u", 9)], "request string, ordinal long, entity_type string, text string, start int")
    assert {r.original: r.fake for r in fakes.fake_table(rows, "request", "ordinal").collect()} == fakes.assign([("URL", "u"), ("PERSON", "Ann")])


def test_event_plans(spark):
    rows = [
        ("messages", {"type": "content_block_delta", "index": 2, "delta": {"type": "text_delta", "text": "a"}}),
        ("messages", {"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": "{"}}),
        ("messages", {"type": "content_block_delta", "delta": {"type": "thinking_delta", "thinking": "x"}}),
        ("messages", {"type": "content_block_stop", "index": 1}),
        ("messages", {"type": "message_stop"}),
        ("responses", {"type": "response.output_text.delta", "item_id": "i", "delta": "a"}),
        ("responses", {"type": "response.mcp_call_arguments.delta", "output_index": 3, "delta": "a"}),
        ("responses", {"type": "response.output_text.done", "item_id": "i", "text": "a"}),
        ("responses", {"type": "response.reasoning_text.delta", "delta": "a"}),
        ("responses", {"type": "response.completed"}),
    ]
    df = spark.createDataFrame([(i, p, json.dumps(d)) for i, (p, d) in enumerate(rows)], "i int, p string, data string")
    got = {r.i: r for r in events.plan(df, "data", "p").collect()}
    assert [got[i].action for i in range(10)] == ["delta", "delta", "verbatim", "restore", "restore", "delta", "delta", "restore", "verbatim", "restore"]
    assert [got[i].channel for i in (0, 1, 5, 6)] == ["text:2", "json:1", "response.output_text.delta:i", "response.mcp_call_arguments.delta:3"]
    assert [got[i].is_json for i in (0, 1, 5, 6)] == [False, True, False, True] and got[0].fragment == "a"
    assert got[3].flush == ["text:1", "json:1"] and got[7].flush == ["response.output_text.delta:i"] and got[4].flush_all and got[9].flush_all
    made = events.plan(df, "data", "p").where("channel is not null").select("i", events.flush_event(F.col("channel"), F.lit("rest")).alias("e")).collect()
    made = {r.i: json.loads(r.e) for r in made}
    assert made[0] == {"type": "content_block_delta", "index": 2, "delta": {"type": "text_delta", "text": "rest"}}
    assert made[6] == {"type": "response.mcp_call_arguments.delta", "delta": "rest", "output_index": 3}


def test_config():
    c = config.from_dict({"preset": "light", "custom": {"EMP": "emp-${N}"}, "overrides": {"CREDIT_CARD": {"method": "mask"}}, "block_types": ["US_SSN"], "allow": [{"value": "x", "entity_types": ["US_SSN"]}]}, {"N": "[0-9]+"})
    assert c.custom["EMP"] == "emp-[0-9]+" and c.warnings() and c.policy().overrides["CREDIT_CARD"].method == "mask"
    for bad in ({"unknown": 1}, {"preset": "best"}, {"languages": ["xx"]}, {"preset": "light", "strategy": "intersection"}, {"preset": "light", "block_types": ["NOPE"]}, {"allow": [{"pattern": ".*"}]}, {"on_error": "x"}):
        with pytest.raises(ValueError):
            config.from_dict(bad)
    with pytest.raises(ValueError, match="MISSING"):
        config.from_dict({"custom": {"a": "${MISSING}"}}, {})
