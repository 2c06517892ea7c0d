"""Queries against their SQL on rows that the given tables don't hold."""

import random
import re
import time
from difflib import SequenceMatcher

import duckdb

from veilspan.operators import policy as P
from veilspan.operators import restore as R
from veilspan.plans.catalogue import ORACLE_SQL, QUERIES


def both(spark, folder, name, rows):
    """(rows of the query, rows of its SQL) over a table of documents."""
    path = str(folder / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(path)
    got = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_every_address_is_let_through_by_value(spark, tmp_path):
    ips = ("203.0.113.7", "203.0.113.70", "203.0.113.8", "203.9.9.9", "20.3.0.1", "0.0.0.0", "203.0.1.113", "255.255.255.255")
    rows = [(i, f"from {ip} on", "en", "s") for i, ip in enumerate(ips)] + [(50, f'token = "{"0a" * 20}" 1.2.3.4', "en", "s"), (51, None, "en", "s")]
    got, want = both(spark, tmp_path, "allow_list_secrets", rows)
    assert got == want and len(got) == len(ips) + 2


def test_windows_cut_no_address(spark, tmp_path):
    """Addresses at every place against the windows' borders, in texts of long words and without spaces."""
    mail = lambda i: f"jo.{i}.doe@mail{i}.example.com"
    texts = [("ab " * 500)[:k] + " " + mail(k) + " cd" * 900 for k in range(1250, 1500, 7)]
    texts += [",".join(mail(i) for i in range(300)), ("x" * 90 + " ") * 14 + "y" * 300 + "@" + "z" * 60 + ".com end " + "w" * 1400 + " " + mail(1) + " v" * 900]
    texts += ["q" * 4000 + " " + mail(2), "q" * 700 + ";" + mail(3) + ";" + "r" * 2000, " " * 3200 + mail(4), "", None]
    got, want = both(spark, tmp_path, "window_detect", [(i, t, "en", "s") for i, t in enumerate(texts)])
    assert got == want and len(got) > 330


def test_no_copy_of_a_found_value_is_left(spark, tmp_path):
    """Copies that the detectors read as part of something else: in a run of digits, in a word, more than once."""
    card, ip, mail = "4845168114407329", "25.178.32.13", "ann.lee@mail3.example.com"
    texts = [f"au {card} èai.\nDe 7536784127813050 {card} tre", f"{card} 1{card}{card}5 {card}", f"{ip} then 999.{ip} 1.1.1.{ip}.2", f"{mail} x{mail} {mail}é", f"<IP_ADDRESS_1> {ip} 256.{ip}", "none", "", None]
    got, want = both(spark, tmp_path, "protect_round_trip", [(i, t, "en", "s") for i, t in enumerate(texts)])
    assert got == want
    found = P.repeats_in_text("aba ab abab", [{"entity_type": "X", "text": "aba", "start": 0, "end": 3, "score": 0.5, "source": "rules"}, {"entity_type": "Y", "text": "ab", "start": 4, "end": 6, "score": 0.5, "source": "rules"}])
    assert [(s["text"], s["start"], s["entity_type"]) for s in found] == [("aba", 0, "X"), ("ab", 4, "Y"), ("aba", 7, "X")]


def plain_near_misses(text, table, threshold):
    """Every run of words against every fake."""
    cores = [(m.end() - len(m[0].lstrip(R._EDGES)), m.start() + len(m[0].rstrip(R._EDGES))) for m in re.finditer(r"\S+", text)]
    found = []
    for rank, fake in enumerate(sorted((f for f in table if f.strip()), key=len, reverse=True)):
        for (lo, _), (_, hi) in zip(cores, cores[len(fake.split()) - 1 :], strict=False):
            said = text[lo:hi]
            if lo < hi and said not in table and not R.is_placeholder(said) and said != table[fake]:
                if SequenceMatcher(None, " ".join(said.split()).lower(), fake.lower()).ratio() >= threshold:
                    found.append((rank, lo, hi, table[fake]))
    chosen = []
    for _, lo, hi, original in sorted(found):
        if all(hi <= a or z <= lo for a, z, _ in chosen):
            chosen.append((lo, hi, original))
    return sorted(chosen)


def test_near_misses_are_those_of_all_comparisons():
    r = random.Random(5)
    kinds = ("EMAIL_ADDRESS", "IP_ADDRESS", "PHONE_NUMBER")
    table = {f"<{k}_{i}>": f"v{i}.{k[0]}" for k in kinds for i in range(1, 13)} | {"Michel Deus": "Jean Eude", "Ann  Lee": "Bo", "İdil": "Zoë"}
    words = ["(EMAIL_ADDRESS_3)", "email_adress_4", "IP_ADDRES_11", "<IP_ADDRESS_99>", "Michel", "Deu,", "Ann", "Lee.", "v3.E", "phone_number_7>", "i̇dil", "plain", "le", "<PHONE_NUMBER_2", "..."]
    for _ in range(150):
        text = " ".join(r.choices(words, k=r.randint(0, 12)))
        for threshold in (0.6, 0.85, 0.9):
            assert R.near_misses(text, table, threshold) == plain_near_misses(text, table, threshold)


def test_ordinary_words_are_not_compared_with_every_fake():
    table = {f"<EMAIL_ADDRESS_{i}>": f"a{i}@b.test" for i in range(2000)}
    fakes = R.Fakes(table, 0.85)
    began = time.process_time()
    assert fakes.near_misses(" ".join(f"word{i % 50}oianeuxment oianeux" for i in range(20000))) == [] and len(fakes.known) == 50
    assert time.process_time() - began < 5
