"""Token models, options inside string literals, failing detectors, and configuration files."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan import engine
from veilspan.config import Config, load
from veilspan.operators import detect as D
from veilspan.operators import model as M
from veilspan.operators import secrets as X

NAMES = ("O", "B-name", "I-name", "E-name", "S-name")
SEEN: list[int] = []


def _encode(text):
    if "!!" in text:
        raise RuntimeError(text)
    found = list(re.finditer(r"\S+", text))
    # Ids tell apart what the labels hang on: first capitals, last capitals, others.
    return [2 if m[0][0].isupper() else 1 for m in found], [m.span() for m in found]


def _infer(ids):
    SEEN.append(len(ids))
    logits = np.zeros((*ids.shape, len(NAMES)))
    logits[..., 0] = 1.0
    logits[ids == 2, 4] = 6.0
    return logits


MODEL = M.TokenModel(_encode, _infer, NAMES, {"name": "PERSON"}, window=8, overlap=2, frame=((101,), (102,)))


def _brute(text):
    return [{"entity_type": "PERSON", "text": m[0], "start": m.start(), "end": m.end()} for m in re.finditer(r"\S+", text) if m[0][0].isupper()]


def test_windows_of_a_model():
    for n in range(40):
        got = M.ranges(n, 8, 2)
        assert [i for i in range(n) if not any(a <= i < z for a, z in got)] == [] and all(z - a <= 8 for a, z in got)
        assert all(b[0] == a[0] + 6 for a, b in zip(got, got[1:], strict=False))
    text = " ".join(f"{'Ann' if i % 3 == 0 else 'word'}{i}" for i in range(100))
    got = M.text_spans(MODEL, text)
    assert [{k: s[k] for k in ("entity_type", "text", "start", "end")} for s in got] == _brute(text)
    assert got[0]["score"] == pytest.approx(np.exp(6) / (np.exp(6) + np.e + 3))
    SEEN.clear()
    M.text_spans(MODEL, "a " * 600)
    assert sum(SEEN) <= 2
    with pytest.raises(RuntimeError, match="every token"):
        M.text_spans(M.TokenModel(_encode, lambda ids: np.zeros((len(ids), 1, 2)), NAMES, {}), "a b")
    with pytest.raises(RuntimeError, match="leave text out"):
        M.text_spans(M.TokenModel(lambda t: ([1], [(0, 1)]), _infer, NAMES, {}), "a Bo")
    with pytest.raises(ValueError, match="overlap"):
        M.TokenModel(_encode, _infer, NAMES, {}, window=4, overlap=4)
    numbers, scores = M.best_labels(np.array([[1000.0, 0.0], [0.0, 0.0]]))
    assert numbers.tolist() == [0, 0] and scores.tolist() == [1.0, 0.5]


def test_pipeline_results():
    found = [{"entity_group": "PER", "score": 0.9, "start": 0, "end": 3}, {"label": "B-LOC", "score": 0.8, "start": 7, "end": 11}, {"entity": "MISC", "score": 1.0, "start": 0, "end": 1}, {"entity": "PER", "score": 0.1, "start": 0, "end": 3}, {"entity": "PER", "score": 0.9, "start": 3, "end": 99}]
    assert [(s["entity_type"], s["text"]) for s in M.pipeline_spans(found, "Ann in Oslo", {"PER": "PERSON", "LOC": "LOCATION"})] == [("PERSON", "Ann"), ("LOCATION", "Oslo")]


def test_protect_with_a_model_and_its_failures(spark):
    texts = [(1, "Ann wrote to bo@x.io"), (2, "!! Ann bo@x.io"), (3, None), (4, ""), (5, "!! +1 (555) 123-4567"), (6, "w " * 5000 + "Bo")]
    df = M.with_model(spark.createDataFrame(texts, "id int, text string"), MODEL)
    run = lambda on_error: {r.id: r for r in engine.protect(df, engine.Protection(blocked=("PHONE_NUMBER",), on_error=on_error), more=["model_spans"], failed="model_failed").collect()}
    closed, opened = run("block"), run("allow")
    assert closed[1].anonymized == opened[1].anonymized == "<PERSON_1> wrote to <EMAIL_ADDRESS_1>" and closed[6].anonymized == "w " * 5000 + "<PERSON_1>"
    assert closed[2].anonymized is None and closed[2].refused == [engine.FAILED] and closed[2].originals == []
    assert opened[2].anonymized == texts[1][1] and opened[2].refused == [] and opened[2].n_spans == 0
    assert closed[5].refused == opened[5].refused == ["PHONE_NUMBER"] and opened[5].anonymized is None
    assert closed[3].anonymized is None and closed[3].refused == [] and closed[4].anonymized == ""


def test_options_inside_literals(spark):
    inner = 'db --password="a \\"b\\" 1" --user x'
    once = "run(" + json.dumps(inner) + ")"
    twice = "x = " + json.dumps(json.dumps({"cmd": 'db --api-key "k 9" go'}))
    bare = 'exec("db --password=hunter42\\" ok")'
    texts = [(1, once), (2, twice), (3, bare), (4, "don't use \\ --password here"), (5, None), (6, 'sh "no backslash --password hunter42"'), (7, "--password tr0ub\\4dor")]
    p = engine.Protection(rules=X.SECRET_RULES, fit=False, propagate=False)
    got = {r.id: r.anonymized for r in engine.protect(spark.createDataFrame(texts, "id int, text string"), p).collect()}
    assert got[1] == 'run("db --password=\\"[SECRET]\\" --user x")'
    assert got[2] == twice.replace("k 9", "[SECRET]") and json.loads(json.loads(got[2][4:]))["cmd"] == 'db --api-key "[SECRET]" go'
    assert got[3] == 'exec("db --password=[SECRET]\\" ok")' and got[4] == texts[3][1] and got[5] is None
    assert got[6] == 'sh "no backslash --password [SECRET]"' and got[7] == "--password [SECRET]"
    decoded, at = X.decoded_literals('é "\\u0041\\n--x\\\\"')[0]
    assert decoded == "A\n--x\\" and at == [3, 9, 11, 12, 13, 14, 16]


def test_value_free_spans_and_primary_language(spark):
    df = D.detect(spark.createDataFrame([("bo@x.io and é al@x.io", "en"), ("nul@x.io", "fr"), ("", None)], "text string, lang string"))
    bare = df.select("text", "lang", "spans", D.without_values(F.col("spans")).alias("bare"))
    assert "text" not in bare.schema["bare"].dataType.elementType.names
    assert bare.where(D.with_values(F.col("bare"), F.col("text")) != F.col("spans")).count() == 0
    kept = df.select(F.size(D.keep_primary(F.col("spans"), F.col("lang"), "en", ["rules"])).alias("n")).collect()
    assert [r.n for r in kept] == [2, 0, 0]


def test_configuration_files(tmp_path):
    given = {"preset": "light", "languages": ["en"], "custom": {"TICKET": "t-${N}"}}
    (tmp_path / "c.json").write_text(json.dumps(given))
    config = load(str(tmp_path / "c.json"), {"N": "7"})
    assert config.custom == {"TICKET": "t-7"} and config.languages == ("en",)
    assert config.fingerprint() == load(str(tmp_path / "c.json"), {"N": "7"}).fingerprint() != load(str(tmp_path / "c.json"), {"N": "8"}).fingerprint()
    assert Config(preset="light").fingerprint() != Config(preset="light", disabled_rules=("email",)).fingerprint()
    (tmp_path / "bad.json").write_text('{"preset": "s3cret"')
    (tmp_path / "list.json").write_text('["s3cret"]')
    for name in ("bad.json", "list.json"):
        with pytest.raises(ValueError) as e:
            load(str(tmp_path / name))
        assert "s3cret" not in str(e.value) and e.value.__cause__ is None
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yml").write_text(yaml.safe_dump(given))
    assert load(str(tmp_path / "c.yml"), {"N": "7"}) == config
    (tmp_path / "bad.yml").write_text("preset: [s3cret")
    with pytest.raises(ValueError, match="line") as e:
        load(str(tmp_path / "bad.yml"))
    assert "s3cret" not in str(e.value)
