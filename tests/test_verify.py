"""The verification: values it has to find, and policies that it has to refuse."""

import json

from veilspan import engine, verify
from veilspan.operators import detect as D


def test_verdict(spark):
    rules = verify.engine.Protection.of(verify.Config(preset="light")).rules
    whole = engine.Protection(rules=rules, policy=verify.Policy())
    row = verify.verdict(verify.planted(spark), whole, "text", "value").first()
    assert row.ok and row.texts == len(verify.PLANTED) and row.spans >= row.texts and row.missed == row.leaks == row.unlike == 0
    less = engine.Protection(rules=D.COMMON, policy=verify.Policy())
    row = verify.verdict(verify.planted(spark), less, "text", "value").first()
    # The password before a host also reads as an address, the other three credentials as nothing.
    assert not row.ok and row.missed == 3
    # Redacted values can't come back.
    row = verify.verdict(verify.planted(spark), engine.Protection(rules=rules), "text", "value").first()
    assert not row.ok and row.unlike > 0 and row.missed == 0
    refused = engine.Protection(rules=rules, policy=verify.Policy(), blocked=("EMAIL_ADDRESS", "SECRET", "CREDIT_CARD", "IP_ADDRESS", "PHONE_NUMBER"))
    assert verify.verdict(verify.planted(spark), refused, "text", "value").first().ok
    assert verify.verdict(verify.planted(spark).where("false"), whole).first().asDict() == {"texts": 0, "spans": 0, "leaks": 0, "missed": 0, "unlike": 0, "ok": True}


def test_command(spark, tmp_path, capsys):
    texts = str(tmp_path / "t.parquet")
    spark.createDataFrame([("mail bo@x.io and <EMAIL_ADDRESS_1>", 1), (None, 2), ("", 3)], "body string, _0 int").write.parquet(texts)
    assert verify.main(["--texts", texts, "--column", "body"], spark) == 0
    told = capsys.readouterr().out.strip().splitlines()[-1]
    assert json.loads(told)["texts"] == {"texts": 3, "spans": 1, "leaks": 0, "missed": 0, "unlike": 0, "ok": True} and "bo@x.io" not in told
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"preset": "light", "disabled_rules": ["email"]}))
    assert verify.main(["--config", str(config)], spark) == 1


def test_what_stands_in_the_way(spark):
    from pyspark.sql import functions as F

    from veilspan.operators import policy as P
    from veilspan.operators.merge import merge_column

    host = D.Rule("host", "HOST", r"[a-z]+\.test", 0.9, "hosts")
    df = D.detect(spark.createDataFrame([(1, "a@mail.test and mail.test and b@other.test"), (2, "c@other.test"), (3, ""), (4, None)], "id int, text string"), (D.BY_NAME["email"], host))
    out = df.select("id", P.not_allowed(merge_column(F.col("spans"), F.col("text")), F.col("spans"), [P.AllowRule(value="mail.test", entity_types=("HOST",))]).alias("b"))
    assert {r.id: [s.text for s in r.b] for r in out.collect()} == {1: ["a@mail.test"], 2: [], 3: [], 4: []}
