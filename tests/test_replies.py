"""Whole streamed replies of four protocols: fragments restored, framing kept, nothing held back for good."""

import json

from veilspan.sources import sse
from veilspan.streaming import replies as RP

MAPPING = json.dumps({"<PERSON_1>": 'Zoë "Z" O\'Neil', "<EMAIL_ADDRESS_1>": "zoe@mail.test"})


def _said(*data, name=None):
    return "".join((f"event: {name or d['type']}\n" if "type" in d else "") + "data: " + json.dumps(d) + "\n\n" for d in data)


def _chat(delta, finish=None, i=0, **more):
    return {"id": "c", "model": "m", "choices": [{"index": i, "delta": delta, "finish_reason": finish}], **more}


def _restored(spark, streams, protocol):
    texts = spark.createDataFrame([(k, t, protocol, MAPPING) for k, t in streams.items()], "stream_id string, body string, protocol string, mapping string")
    rows = RP.restore_replies(sse.blocks(texts, "body", ["stream_id", "protocol", "mapping"])).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.seq, r.part)):
        out.setdefault(r.stream_id, []).append(r.block)
    return out


def _data(blocks):
    return [json.loads(b.split("data: ", 1)[1]) for b in blocks if 'data: {"' in b]


def test_chat(spark):
    call = lambda text: {"tool_calls": [{"index": 2, "function": {"arguments": text}}]}
    plain = ": ping\n\n" + _said(_chat({"role": "assistant"}), _chat({"content": "Hi <PER"}), _chat({"content": "SON_"}), _chat({"content": "1>!"}), _chat({"content": "to <EM"}), _chat({}, "stop"), {"usage": {"n": 3}, "choices": []}) + "data: [DONE]\n\n"
    tools = _said(_chat(call('{"to": "<PERS')), _chat(call('ON_1>", "x": "<P')), _chat({"content": None}, "tool_calls"))
    broken = _said(_chat({"content": "a <PERSON_1"}), _chat({"reasoning": "b <PERS"}, i=1)) + "data: {not json\n\n"
    out = _restored(spark, {"plain": plain, "tools": tools, "broken": broken, "empty": ""}, "chat")
    assert out["plain"][0] == ": ping" and out["plain"][-1] == "data: [DONE]" and "empty" not in out
    said = [c["delta"].get("content") for d in _data(out["plain"]) for c in d["choices"]]
    # The fragment of nothing but held text gives no chunk; what the last one held joins the finishing chunk.
    assert said == [None, "Hi ", 'Zoë "Z" O\'Neil!', "to ", "<EM"] and _data(out["plain"])[-1] == {"usage": {"n": 3}, "choices": []}
    parts = [c["delta"]["tool_calls"][0]["function"]["arguments"] for d in _data(out["tools"]) for c in d["choices"] if "tool_calls" in c["delta"]]
    assert json.loads("".join(parts) + '"}') == {"to": 'Zoë "Z" O\'Neil', "x": "<P"} and _data(out["tools"])[-1]["choices"][0]["finish_reason"] == "tool_calls"
    ends = _data(out["broken"])[-2:]
    assert out["broken"][2] == "data: {not json" and [e["choices"][0]["delta"] for e in ends] == [{"content": "<PERSON_1"}, {"reasoning": "<PERS"}] and ends[1]["choices"][0]["index"] == 1


def test_completions(spark):
    chunk = lambda text, finish=None: {"model": "m", "choices": [{"index": 0, "text": text, "finish_reason": finish}]}
    out = _restored(spark, {"a": _said(chunk("by <EMAIL_ADD"), chunk("RESS_1>, <"), chunk(None, "stop")), "b": _said(chunk("x <PE"))}, "completions")
    assert [d["choices"][0]["text"] for d in _data(out["a"])] == ["by ", "zoe@mail.test, ", "<"]
    assert [d["choices"][0]["text"] for d in _data(out["b"])] == ["x ", "<PE"] and _data(out["b"])[1]["object"] == "text_completion"


def test_messages(spark):
    delta = lambda i, **d: {"type": "content_block_delta", "index": i, "delta": d}
    stream = _said(
        {"type": "message_start", "message": {"note": "<PERSON_1>"}}, delta(0, type="text_delta", text="Dear <PERSO"), delta(0, type="text_delta", text="N_1> <EM"), {"type": "content_block_stop", "index": 0},
        delta(1, type="input_json_delta", partial_json='{"to": "<PERSON'), delta(1, type="input_json_delta", partial_json='_1>"}'), delta(2, type="thinking_delta", thinking="<PERSON_1>"), {"type": "message_stop"},
    )
    out = _restored(spark, {"s": stream.replace("event: message_start\n", "event: message_start\nid: 7\n")}, "messages")["s"]
    data = _data(out)
    assert out[0].startswith("event: message_start\nid: 7\ndata: ") and data[0]["message"]["note"] == 'Zoë "Z" O\'Neil'
    assert "".join(d["delta"].get("text", "") for d in data if "delta" in d) == 'Dear Zoë "Z" O\'Neil <EM'
    assert [d["type"] for d in data[2:5]] == ["content_block_delta", "content_block_delta", "content_block_stop"] and out[3].startswith("event: content_block_delta\n")
    assert json.loads("".join(d["delta"].get("partial_json", "") for d in data if "delta" in d)) == {"to": 'Zoë "Z" O\'Neil'}
    assert data[-2]["delta"]["thinking"] == "<PERSON_1>" and data[-1] == {"type": "message_stop"}


def test_responses(spark):
    delta = lambda text, kind="output_text": {"type": f"response.{kind}.delta", "item_id": "i1", "delta": text}
    stream = _said(delta("I am <PER"), delta("SON_1>, <PE"), {"type": "response.output_text.done", "item_id": "i1", "text": "I am <PERSON_1>, <PE"}, delta("x<E", "refusal"), {"type": "response.completed", "response": {"output": ["<EMAIL_ADDRESS_1>"]}})
    data = _data(_restored(spark, {"s": stream}, "responses")["s"])
    assert [d.get("delta") for d in data] == ["I am ", 'Zoë "Z" O\'Neil, ', "<PE", None, "x", "<E", None]
    assert data[3]["text"] == 'I am Zoë "Z" O\'Neil, <PE' and data[-1]["response"]["output"] == ["zoe@mail.test"]


def test_stream_form(spark, tmp_path):
    lines = [b for b in _said(_chat({"content": "Hi <PER"}), _chat({"content": "SON_1> <PER"})).split("\n\n") if b]
    rows = spark.createDataFrame([("s", i, b, "chat", MAPPING) for i, b in enumerate(lines)], "stream_id string, seq long, block string, protocol string, mapping string")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = RP.restore_replies_stream(source, 500).writeStream.format("memory").queryName("replies").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        import time

        end = time.time() + 60
        while time.time() < end and spark.table("replies").count() < 3:
            time.sleep(0.5)
    finally:
        query.stop()
    got = [r.block for r in spark.table("replies").orderBy("seq", "part").collect()]
    assert [d["choices"][0]["delta"]["content"] for d in _data(got)] == ["Hi ", 'Zoë "Z" O\'Neil ', "<PER"]
