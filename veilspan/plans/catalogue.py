"""Queries over the driver's tables and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan import engine
from veilspan.functions import spans as S
from veilspan.operators import anonymize as A
from veilspan.operators import detect as D
from veilspan.operators import gateway as G
from veilspan.operators import languages as L
from veilspan.operators import leaves as J
from veilspan.operators import merge as M
from veilspan.operators import model as MD
from veilspan.operators import policy as P
from veilspan.operators import restore as R
from veilspan.operators import refine as E
from veilspan.operators import secrets as X
from veilspan.operators import windows as N
from veilspan.plans import sql as Q
from veilspan.session import ship_package
from veilspan.sources import requests as RQ
from veilspan.sources import sse
from veilspan.streaming import events as EV
from veilspan.streaming import replies as RP
from veilspan.streaming import restore as ST

#: Session setting, see ``table``.
DEAL = "spark.veilspan.dealPartitions"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EMAIL, CARD, IP, PHONE = (D.BY_NAME[n] for n in ("email", "card", "ip", "phone"))
BASIC = (EMAIL, CARD, IP, PHONE, D.TOKEN_RULE)
# Detectors that overlap the basic ones, so that merging has something to decide.
HOST = D.Rule("host", "HOST", r"mail[0-9]+\.example\.com", 0.9, "hosts", needs="mail")
DIGITS = D.Rule("digits", "NUMBER", r"[0-9]{6,}", 0.4, "numbers")
ASSIGN = D.Rule("assign", "ASSIGNMENT", r'token = "[0-9a-f]*"?', 0.95, "assignments", needs="token")
WIDE = D.Rule("wide", "CONTACT", r"[a-z.]+@mail[0-9]+", 0.95, "contacts", needs="@mail")
OVERLAPPING = (*BASIC, HOST, DIGITS, ASSIGN, WIDE)


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's folder. A file of one row group is one task; a session that reads few small files
    can have their rows dealt out by setting DEAL to a number of partitions. Unset, tables are read as they lie."""
    ship_package(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = int(spark.conf.get(DEAL, "0"))
    return rows.repartition(parts) if parts else rows


def _shown(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select("doc_id", *extra, "entity_type", "text", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def _spans_of(spark, sf_dir, rules, *keys: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return D.span_rows(D.detect(docs.select("doc_id", *keys, "text"), rules), ["doc_id", *keys])


_SHOW = "doc_id, entity_type, text, a AS span_start, z AS span_end"


def _register_detectors() -> None:
    for name, rule in (("detect_email", EMAIL), ("detect_ip", IP), ("detect_phone", PHONE), ("detect_card_luhn", CARD), ("detect_custom_token", D.TOKEN_RULE)):
        query(name, f"SELECT {_SHOW} FROM ({Q.rule_sql(rule, 0)})")(lambda spark, sf, rule=rule: _shown(_spans_of(spark, sf, [rule])))


_register_detectors()


@query("detect_union_all", f"SELECT DISTINCT {_SHOW}, score FROM ({Q.spans_sql(BASIC)}) WHERE score >= 0.7")
def detect_union_all(spark, sf_dir):
    docs = D.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), BASIC)
    rows = D.span_rows(docs.withColumn("spans", D.above(F.col("spans"), 0.7)), ["doc_id"])
    return _shown(D.first_of_each(rows, ["doc_id"], "ord"), "score")


@query("dedupe_detect", f"SELECT {_SHOW} FROM ({Q.spans_sql(BASIC)})")
def dedupe_detect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return _shown(D.span_rows(D.detect_distinct(docs, BASIC, "doc_id", lang_col="lang"), ["doc_id"]))


_MERGED = "doc_id, entity_type, a AS span_start, z AS span_end, score, src AS detector"


def _merged_shown(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "entity_type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "score", F.col("source").alias("detector"))


@query("merge_union_default", f"SELECT {_MERGED} FROM ({Q.islands_sql(Q.spans_sql(OVERLAPPING))})")
def merge_union_default(spark, sf_dir):
    return _merged_shown(M.merge_rows(_spans_of(spark, sf_dir, OVERLAPPING), ["doc_id"]))


def _folded(spark, sf_dir, rules=OVERLAPPING, **options) -> DataFrame:
    docs = D.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), rules)
    return D.span_rows(D.with_merged(docs, M.merge_column(F.col("spans"), F.col("text"), **options)), ["doc_id"])


@query("merge_union_fold", f"SELECT {_MERGED}, substring(text, a + 1, z - a) AS text FROM ({Q.islands_sql(Q.spans_sql(OVERLAPPING))}) JOIN documents USING (doc_id)")
def merge_union_fold(spark, sf_dir):
    rows = _folded(spark, sf_dir)
    return rows.select("doc_id", "entity_type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "score", F.col("source").alias("detector"), "text")


@query("merge_longest_span", f"SELECT {_MERGED} FROM ({Q.fold_sql(Q.spans_sql(OVERLAPPING), 'f.z - f.a >= s.z - s.a')})")
def merge_longest_span(spark, sf_dir):
    return _merged_shown(_folded(spark, sf_dir, resolution="longest_span"))


# The source that this resolution prefers, with a score below those of the spans around it.
PREFERRED = D.Rule("host", "HOST", HOST.pattern, 0.3, "presidio", needs="mail")
_PREFERRED = (*BASIC, DIGITS, ASSIGN, PREFERRED, WIDE)
_PREFERS = "CASE WHEN (f.src = 'presidio') <> (s.src = 'presidio') THEN f.src = 'presidio' ELSE f.score >= s.score END"


@query("merge_presidio_priority", f"SELECT {_MERGED} FROM ({Q.fold_sql(Q.spans_sql(_PREFERRED), _PREFERS)})")
def merge_presidio_priority(spark, sf_dir):
    return _merged_shown(_folded(spark, sf_dir, _PREFERRED, resolution="presidio_priority"))


_PRIORITY = M.type_priorities(blocked=("CREDIT_CARD",), irreversible=("SECRET", "EMAIL_ADDRESS"))
_PRIORITY_SQL = "CASE entity_type WHEN 'CREDIT_CARD' THEN 2 WHEN 'SECRET' THEN 1 WHEN 'EMAIL_ADDRESS' THEN 1 ELSE 0 END"


@query("type_priorities", f"SELECT {_MERGED} FROM ({Q.islands_sql(Q.spans_sql(OVERLAPPING), priority=_PRIORITY_SQL)})")
def type_priorities(spark, sf_dir):
    return _merged_shown(M.merge_rows(_spans_of(spark, sf_dir, OVERLAPPING), ["doc_id"], _PRIORITY))


_CONFIRMED = f"""WITH s AS ({Q.spans_sql(OVERLAPPING)})
    SELECT * FROM s WHERE EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.src <> s.src AND o.a < s.z AND s.a < o.z)"""


@query("merge_intersection", f"SELECT {_MERGED} FROM ({Q.islands_sql(_CONFIRMED)})")
def merge_intersection(spark, sf_dir):
    return _merged_shown(_folded(spark, sf_dir, strategy="intersection"))


_ALLOW = (P.AllowRule(value="+1 (555) 123-4567"), P.AllowRule(pattern=r"[0-9]{1,2}\.[0-9]+\.[0-9]+\.[0-9]+", entity_types=("IP_ADDRESS",)), P.AllowRule(pattern=r"[a-m].*@mail[0-9]+\.example\.com"))


@query(
    "allow_list_verdict",
    f"""WITH s AS ({Q.spans_sql(OVERLAPPING)}), m AS ({Q.islands_sql("SELECT * FROM s")}),
    r AS (SELECT *, ((text = '+1 (555) 123-4567' AND entity_type <> 'SECRET') OR (entity_type = 'IP_ADDRESS' AND regexp_full_match(text, '[0-9]{{1,2}}\\.[0-9]+\\.[0-9]+\\.[0-9]+'))
                     OR (regexp_full_match(text, '[a-m].*@mail[0-9]+\\.example\\.com') AND entity_type <> 'SECRET')) AND length(text) <= 1024 AS ok FROM s)
    SELECT m.doc_id, m.entity_type, m.a AS span_start, m.z AS span_end, bool_and(ok) AS let_through
    FROM m JOIN r ON r.doc_id = m.doc_id AND r.a < m.z AND m.a < r.z GROUP BY ALL""",
)
def allow_list_verdict(spark, sf_dir):
    raw = _spans_of(spark, sf_dir, OVERLAPPING)
    merged = M.merge_rows(raw, ["doc_id"])
    out = P.allow_verdicts(merged, raw, ["doc_id"], _ALLOW)
    return out.select("doc_id", "entity_type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "let_through")


_BLOCKED = ("CREDIT_CARD", "SECRET")


@query(
    "block_gate",
    f"""WITH s AS (SELECT source, doc_id, entity_type FROM ({Q.spans_sql(BASIC)}) JOIN documents USING (doc_id) WHERE entity_type IN ('CREDIT_CARD', 'SECRET')),
    f AS (SELECT source, min(doc_id) AS doc_id FROM s GROUP BY source)
    SELECT source, array_to_string(list_sort(list_distinct(list(entity_type))), ',') AS blocked_types FROM s JOIN f USING (source, doc_id) GROUP BY source""",
)
def block_gate(spark, sf_dir):
    rows = _sourced(spark, sf_dir, BASIC)
    return P.block_gate(rows, "request", "doc_id", _BLOCKED).select(F.col("request").alias("source"), F.array_join("blocked_types", ",").alias("blocked_types"))


def _sourced(spark, sf_dir, rules) -> DataFrame:
    """Merged spans with the document's source as the request."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("request"), "text")
    docs = D.detect(docs, rules)
    return D.span_rows(D.with_merged(docs, M.merge_column(F.col("spans"), F.col("text"), priorities=_PRIORITY)), ["request", "doc_id"])


@query(
    "pass_gate",
    f"""SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM ({Q.spans_sql(BASIC)}) JOIN documents USING (doc_id) WHERE entity_type = 'SECRET')""",
)
def pass_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("request"))
    return P.pass_gate(docs, _sourced(spark, sf_dir, BASIC), "request", "doc_id", ("SECRET",)).select("doc_id")


# Anonymisation: the request is the source, texts in order of doc_id.
_M = f"""m AS (SELECT i.*, d.source, substring(d.text, a + 1, z - a) AS text FROM ({Q.islands_sql(Q.spans_sql(BASIC), priority=_PRIORITY_SQL)}) i JOIN documents d USING (doc_id))"""


def _numbered_sql(reversible: str) -> str:
    return f"""
    first_seen AS (SELECT source, text AS original, arg_min(entity_type, doc_id * 1000000 - a) AS entity_type, min(doc_id * 1000000 - a) AS place FROM m WHERE {reversible} GROUP BY source, text),
    map AS (SELECT source, original, entity_type, '<' || entity_type || '_' || row_number() OVER (PARTITION BY source, entity_type ORDER BY place) || '>' AS fake FROM first_seen)"""


def _anonymized_sql(fake: str, reversible: str = "true") -> str:
    swaps = f"SELECT m.doc_id, m.a, m.z, {fake} AS fake FROM m LEFT JOIN map ON map.source = m.source AND map.original = m.text"
    return f"""WITH {_M}, {_numbered_sql(reversible)}, swaps AS ({swaps}), r AS ({Q.rebuilt_sql("SELECT * FROM swaps")})
    SELECT doc_id, coalesce(r.out, d.text) AS anonymized, coalesce(n, 0) AS n_spans FROM documents d LEFT JOIN r USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM swaps GROUP BY doc_id) USING (doc_id)"""


_LOSSY = "CASE m.entity_type WHEN 'CREDIT_CARD' THEN repeat('*', length(m.text)) WHEN 'SECRET' THEN '[SECRET]' ELSE map.fake END"


def _anonymized(spark, sf_dir, policy: A.Policy) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("request"), "text")
    return A.anonymize(texts, _sourced(spark, sf_dir, BASIC), "request", "doc_id", policy).select("doc_id", "anonymized", "n_spans")


@query("anonymize_placeholder", _anonymized_sql("map.fake"))
def anonymize_placeholder(spark, sf_dir):
    return _anonymized(spark, sf_dir, A.Policy())


@query("anonymize_mask", _anonymized_sql("repeat('#', length(m.text))"))
def anonymize_mask(spark, sf_dir):
    types = {r.entity_type for r in BASIC}
    return _anonymized(spark, sf_dir, A.Policy(overrides={t: A.Method("mask", "#") for t in types}))


@query("anonymize_redact", _anonymized_sql("'[' || m.entity_type || ']'"))
def anonymize_redact(spark, sf_dir):
    return _anonymized(spark, sf_dir, A.Policy(A.Method("redact")))


@query("anonymize_policy", _anonymized_sql(_LOSSY, "entity_type NOT IN ('CREDIT_CARD', 'SECRET')"))
def anonymize_policy(spark, sf_dir):
    return _anonymized(spark, sf_dir, A.SHIPPED)


@query("mapping_table", f"WITH {_M}, {_numbered_sql('entity_type NOT IN (' + chr(39) + 'CREDIT_CARD' + chr(39) + ', ' + chr(39) + 'SECRET' + chr(39) + ')')} SELECT * FROM map")
def mapping_table(spark, sf_dir):
    return A.mapping_table(_sourced(spark, sf_dir, BASIC), "request", "doc_id").withColumnRenamed("request", "source")


_LITERALS = "'keep <PHONE_NUMBER_1> and <EMAIL_ADDRESS_2> <EMAIL_ADDRESS_3>'"


@query(
    "reserved_numbers",
    f"""WITH {_M}, {_numbered_sql("entity_type NOT IN ('CREDIT_CARD', 'SECRET')")},
    k AS (SELECT source, original, entity_type, row_number() OVER (PARTITION BY source, entity_type ORDER BY place) AS k FROM first_seen)
    SELECT source, original, '<' || entity_type || '_' || CASE entity_type WHEN 'PHONE_NUMBER' THEN k + 1 WHEN 'EMAIL_ADDRESS' THEN CASE WHEN k >= 2 THEN k + 2 ELSE k END ELSE k END || '>' AS fake FROM k""",
)
def reserved_numbers(spark, sf_dir):
    """Every source also holds a text with placeholder literals, which no issued placeholder may equal."""
    texts = table(spark, sf_dir, "documents").select(F.col("source").alias("request"), "text")
    literal = texts.select("request").distinct().withColumn("text", F.expr(_LITERALS))
    taken = A.reserved_numbers(texts.unionByName(literal), "request")
    rows = A.mapping_table(_sourced(spark, sf_dir, BASIC), "request", "doc_id", reserved=taken)
    return rows.select(F.col("request").alias("source"), "original", "fake")


@query("restore_exact", "SELECT doc_id, text AS restored FROM documents")
def restore_exact(spark, sf_dir):
    """The round trip: all types reversible, replaced and restored."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("request"), "text")
    rows = _sourced(spark, sf_dir, BASIC)
    out = A.anonymize(texts, rows, "request", "doc_id", A.Policy()).select("doc_id", "request", "anonymized")
    mapping = A.mapping_table(rows, "request", "doc_id", A.Policy(), A.reserved_numbers(texts, "request"))
    return R.restore(out, mapping, "request", "anonymized").select("doc_id", "restored")


@query("restore_fuzzy")
def restore_fuzzy(spark, sf_dir):
    """Placeholders retyped with a space are found again by similarity."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("request"), "text")
    rows = _sourced(spark, sf_dir, BASIC)
    out = A.anonymize(texts, rows, "request", "doc_id", A.Policy()).withColumn("anonymized", F.regexp_replace("anonymized", r"<(EMAIL_ADDRESS_[0-9]+)>", "($1)"))
    mapping = A.mapping_table(rows, "request", "doc_id", A.Policy())
    return R.restore_fuzzy_df(out, mapping, "request", "anonymized").select("doc_id", "restored")


@query("type_counts", f"WITH {_M}, o AS (SELECT source, text, arg_min(entity_type, doc_id * 1000000 - a) AS entity_type FROM m GROUP BY source, text) SELECT source, entity_type, count(*) AS n FROM o GROUP BY source, entity_type")
def type_counts(spark, sf_dir):
    return A.type_counts(_sourced(spark, sf_dir, BASIC), "request", "doc_id").withColumnRenamed("request", "source")


@query(
    "session_stats",
    """SELECT sha256('salt' || user_id) AS session, count(*) AS request_count, min(ts) AS first_seen, max(ts) AS last_seen, sum(n) AS pii_count
    FROM (SELECT user_id, ts, len(regexp_extract_all(props, '[0-9]{2,}')) AS n FROM events) GROUP BY user_id""",
)
def session_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", F.size(F.regexp_extract_all("props", F.lit("[0-9]{2,}"), F.lit(0))).cast("long").alias("n"))
    return events.groupBy(A.session_key(F.col("user_id"), "salt").alias("session")).agg(
        F.count(F.lit(1)).alias("request_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.sum("n").alias("pii_count")
    )


@query(
    "inspect_report",
    f"""WITH {_M}, {_numbered_sql("entity_type NOT IN ('CREDIT_CARD', 'SECRET')")}
    SELECT doc_id, lang AS language, m.entity_type, m.text, a AS span_start, z AS span_end, round(score, 3) AS score, src AS detector, {_LOSSY} AS replacement,
           m.source IN (SELECT source FROM m WHERE entity_type = 'SECRET') AS would_block
    FROM m LEFT JOIN map ON map.source = m.source AND map.original = m.text JOIN documents d USING (doc_id)""",
)
def inspect_report(spark, sf_dir):
    rows = _sourced(spark, sf_dir, BASIC)
    refused = P.block_gate(rows, "request", "doc_id", ("SECRET",)).select(F.col("request").alias("_q"), F.lit(True).alias("_b"))
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_d"), F.col("lang").alias("language"))
    out = A.replacements(rows, "request", "doc_id").join(refused, F.col("request") == F.col("_q"), "left").join(langs, F.col("doc_id") == F.col("_d"))
    return out.select(
        "doc_id", "language", "entity_type", "text", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.round("score", 3).alias("score"),
        F.col("source").alias("detector"), F.col("fake").alias("replacement"), F.coalesce("_b", F.lit(False)).alias("would_block"),
    )


@query(
    "leak_audit",
    f"""WITH {_M}, {_numbered_sql("true")}, swaps AS (SELECT m.doc_id, m.a, m.z, map.fake FROM m JOIN map ON map.source = m.source AND map.original = m.text), r AS ({Q.rebuilt_sql("SELECT * FROM swaps")}),
    o AS (SELECT doc_id, source, coalesce(r.out, d.text) AS body FROM documents d LEFT JOIN r USING (doc_id))
    SELECT map.source, original, count(*) FILTER (contains(body, original)) AS leaks FROM map JOIN o USING (source) GROUP BY map.source, original""",
)
def leak_audit(spark, sf_dir):
    """How many sent texts of its request still hold a detected value."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("request"), "text")
    rows = _sourced(spark, sf_dir, BASIC)
    sent = A.anonymize(texts, rows, "request", "doc_id", A.Policy()).select("request", "anonymized")
    values = A.mapping_table(rows, "request", "doc_id", A.Policy()).select(F.col("request").alias("_r"), "original")
    met = sent.join(values, F.col("request") == F.col("_r"))
    return met.groupBy(F.col("request").alias("source"), "original").agg(F.sum(F.contains("anonymized", F.col("original")).cast("long")).alias("leaks"))


def _planted(value) -> Column:
    """A made string in front of the document's own whole text."""
    return F.concat(value, F.lit("\n"), F.coalesce("text", F.lit("")))


_ENV = "'api_key=' || substr(md5(source), 1, 12) || 'x7'"
_BARE = "'then ' || substr(md5(source), 1, 12) || 'x7, or z' || substr(md5(source), 1, 12) || 'x7'"


@query(
    "known_value_propagation",
    f"""WITH k AS (SELECT source, min(doc_id) AS since FROM documents GROUP BY source),
    t AS (SELECT doc_id, source, CASE WHEN doc_id = since THEN {_ENV} ELSE {_BARE} END AS text, since FROM documents JOIN k USING (source))
    SELECT doc_id, source, substr(md5(source), 1, 12) || 'x7' AS text, CASE WHEN doc_id = since THEN 8 ELSE 5 END AS span_start,
           CASE WHEN doc_id = since THEN 22 ELSE 19 END AS span_end FROM t WHERE regexp_matches(substr(md5(source), 1, 12) || 'x7', '[0-9]')""",
)
def known_value_propagation(spark, sf_dir):
    """Each source's first text also assigns a credential; later texts repeat it bare, once alone and once inside a word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("request"), "text")
    first = docs.groupBy(F.col("request").alias("_r")).agg(F.min("doc_id").alias("_since"))
    value = F.concat(F.substring(F.md5(F.col("request").cast("binary")), 1, 12), F.lit("x7"))
    text = F.when(F.col("doc_id") == F.col("_since"), F.concat(F.lit("api_key="), value)).otherwise(F.concat(F.lit("then "), value, F.lit(", or z"), value))
    texts = docs.join(first, F.col("request") == F.col("_r")).select("doc_id", "request", _planted(text).alias("text"))
    rows = D.span_rows(D.detect(texts, X.SECRET_RULES), ["request", "doc_id"])
    known = P.known_values(rows, "request", "doc_id")
    out = P.copies_of_known(texts, known, "request", "doc_id")
    return out.select("doc_id", F.col("request").alias("source"), "text", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def _flagship(spark, sf_dir) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = D.detect(texts, BASIC)
    merged = F.when(F.size("spans") > 0, M.merge_column(F.col("spans"), F.col("text"), priorities=_PRIORITY)).otherwise(F.col("spans"))
    docs = S.computed_once(docs, merged, "spans")
    types = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda e: e["entity_type"]))), ",")
    return docs.select("doc_id", A.anonymize_column(F.col("text"), F.col("spans"), A.SHIPPED)["text"].alias("anonymized"), F.size("spans").cast("long").alias("n_spans"), types.alias("types"))


@query(
    "flagship",
    f"""WITH {_M.replace("d.source", "d.doc_id::VARCHAR AS source")}, {_numbered_sql("entity_type NOT IN ('CREDIT_CARD', 'SECRET')")},
    swaps AS (SELECT m.doc_id, m.a, m.z, m.entity_type, {_LOSSY} AS fake FROM m LEFT JOIN map ON map.source = m.source AND map.original = m.text), r AS ({Q.rebuilt_sql("SELECT doc_id, a, z, fake FROM swaps")})
    SELECT doc_id, coalesce(r.out, d.text) AS anonymized, coalesce(n, 0) AS n_spans, coalesce(types, '') AS types FROM documents d LEFT JOIN r USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(entity_type))), ',') AS types FROM swaps GROUP BY doc_id) USING (doc_id)""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detect, merge, apply the shipped policy, number and rebuild; each document is its own request."""
    return _flagship(spark, sf_dir)


@query("detect_by_language")
def detect_by_language(spark, sf_dir):
    """Names, places and dates cued by words of the document's language; each text also says them once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    said = F.expr(
        "CASE lang WHEN 'fr' THEN 'je m’appelle jean dupont et je vis Lyon le 3 mars 2021. ' WHEN 'de' THEN 'ich heiße Anna Berg und 12. März. ' "
        "WHEN 'es' THEN 'me llamo Luis Vega. ' ELSE 'my name is Ann Lee and I live Oxford. ' END"
    )
    rows = D.span_rows(L.detect_by_language(docs.withColumn("text", F.concat(said, "text"))), ["doc_id"])
    return _shown(rows, "score")


@query("page_secrets", f"SELECT page_id, entity_type, text, a AS span_start, z AS span_end FROM ({Q.spans_sql(BASIC, 'pages', 'page_id', 'html')})")
def page_secrets(spark, sf_dir):
    pages = D.detect(table(spark, sf_dir, "pages").select("page_id", "html"), BASIC, "html")
    return D.span_rows(pages, ["page_id"]).select("page_id", "entity_type", "text", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query("secret_rules", "SELECT doc_id, 'sk-' || md5(doc_id::VARCHAR) AS text, 14 AS span_start FROM documents UNION ALL SELECT doc_id, 'p' || doc_id || 'w9', 75 + length(doc_id::VARCHAR) FROM documents")
def secret_rules(spark, sf_dir):
    """Each document's own credentials and two written in front of it: an assignment and a URI password."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = F.concat(F.lit("sk-"), F.md5(F.col("doc_id").cast("string").cast("binary")))
    text = F.concat(F.lit('my api_key = "'), key, F.lit('" '), F.lit("postgres://user"), F.lit("x" * 8), F.col("doc_id").cast("string"), F.lit(":p"), F.col("doc_id").cast("string"), F.lit("w9@db.example.com/app"))
    rows = D.span_rows(D.detect(docs.withColumn("text", _planted(text)), X.SECRET_RULES), ["doc_id"])
    return rows.select("doc_id", "text", F.col("start").alias("span_start")).distinct()


@query("leaf_walk", "SELECT event_id, 'n' AS path, 'number' AS kind, props->>'k' AS text FROM events WHERE length(regexp_replace(props->>'k', '[^0-9]', '', 'g')) >= 7 UNION ALL SELECT event_id, 'tags[0]', 'string', event_type FROM events")
def leaf_walk(spark, sf_dir):
    """Leaves of nested JSON made from each event: a number is scanned from seven digits on."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    number = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"n": '), number, F.lit(', "ok": true, "none": null, "tags": ["'), F.col("event_type"), F.lit('"]}'))
    return J.walk(events.withColumn("body", body), ["event_id"], "body").select("event_id", "path", "kind", "text")


@query("tool_arguments", "SELECT conv_id, turn, 1 AS n_leaves, text AS leaf FROM conversations WHERE text <> ''")
def tool_arguments(spark, sf_dir):
    """Texts inside the JSON string of a tool call's arguments."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    inner = F.to_json(F.struct(F.col("text").alias("body"), F.lit(3).alias("count")))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("").alias("name"), inner.alias("arguments")).alias("function"))).alias("tool_calls")))
    out = J.walk(rows.withColumn("call", body), ["conv_id", "turn"], "call")
    return out.select("conv_id", "turn", F.lit(1).alias("n_leaves"), F.col("text").alias("leaf"))


@query("leaf_round_trip", "SELECT conv_id, turn, '<' || text || '>' AS text FROM conversations")
def leaf_round_trip(spark, sf_dir):
    """Leaves walked out, changed as rows, and put back into their documents."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    docs = rows.withColumn("body", F.to_json(F.struct(F.array(F.struct("text")).alias("a"))))
    found = J.walk(docs, ["conv_id", "turn"], "body").withColumn("new_text", F.concat(F.lit("<"), "text", F.lit(">")))
    out = J.put_back(docs, found, ["conv_id", "turn"], "body")
    return out.select("conv_id", "turn", F.get_json_object("document", "$.a[0].text").alias("text"))


_COUNT = "length(text) - length(replace(text, ' ', '')) + 1"


@query(
    "token_windows",
    f"""SELECT doc_id, i AS window_no, i * 896 AS first_token, least(i * 896 + 1024, c) AS last_token, true AS covered
    FROM (SELECT doc_id, c, unnest(range(0, 1 + greatest(ceil((c - 1024) / 896.0), 0)::INT)) AS i FROM (SELECT doc_id, {_COUNT} AS c FROM documents))""",
)
def token_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).alias("c"))
    ranges = N.token_ranges(F.col("c"))
    rows = docs.select("doc_id", N.covers(ranges, F.col("c")).alias("covered"), F.posexplode(ranges).alias("window_no", "_r"))
    return rows.select("doc_id", "window_no", F.col("_r.first").alias("first_token"), F.col("_r.last").alias("last_token"), "covered")


@query(
    "char_windows",
    """WITH RECURSIVE w AS (SELECT doc_id, text, length(text) AS c, 0 AS window_no, 0 AS o FROM documents WHERE text IS NOT NULL UNION ALL
    SELECT doc_id, text, c, window_no + 1, greatest(cut - 200, o + 1) FROM (SELECT *, CASE WHEN gap > 0 AND o + 1500 - gap > o THEN o + 1500 - gap ELSE o + 1500 END AS cut
        FROM (SELECT *, strpos(reverse(substring(text, o + 1301, 200)), ' ') AS gap FROM w) WHERE o + 1500 < c))
    SELECT doc_id, window_no, o AS "offset", substring(text, o + 1, CASE WHEN o + 1500 < c AND gap > 0 THEN 1500 - gap ELSE 1500 END) AS chunk
    FROM (SELECT *, strpos(reverse(substring(text, o + 1301, 200)), ' ') AS gap FROM w)""",
)
def char_windows(spark, sf_dir):
    return N.char_windows(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "window_no", "offset", "chunk")


@query(
    "tag_islands",
    """WITH t AS (SELECT doc_id, pos, length(w) / 10::DOUBLE AS score, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'B' WHEN length(w) > 8 THEN 'I' ELSE 'O' END AS tag
        FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents) WHERE w <> ''),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, CASE WHEN tag = 'I' AND coalesce(lag(tag) OVER (PARTITION BY doc_id ORDER BY pos), 'O') <> 'O' THEN 0 ELSE 1 END AS fresh FROM t))
    SELECT doc_id, 'cap' AS entity_type, min(pos)::INT AS span_start, (max(pos) + 1)::INT AS span_end, round(avg(score), 6) AS score FROM i WHERE tag <> 'O' GROUP BY doc_id, island""",
)
def tag_islands(spark, sf_dir):
    """Spans of BIO labels given by a rule to each word, decoded by gaps and islands."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w")).where("w <> ''")
    label = F.when(F.col("w").rlike("^[A-Z]"), "B-cap").when(F.length("w") > 8, "I-cap").otherwise("O")
    tokens = docs.select("doc_id", "pos", label.alias("label"), (F.length("w") / 10).alias("score"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    return N.tag_islands(tokens, ["doc_id"]).select("doc_id", "entity_type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.round("score", 6).alias("score"))


@query("window_detect", f"SELECT {_SHOW} FROM ({Q.rule_sql(EMAIL, 0)})")
def window_detect(spark, sf_dir):
    """A pluggable model (here a pattern) over overlapping windows, with doubles removed."""
    import re

    pattern = EMAIL.pattern

    def predict(chunks):
        return [[("mail", 0.9, m.start(), m.end()) for m in re.finditer(pattern, c)] for c in chunks]

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _shown(N.detect_windows(docs, ["doc_id"], predict, {"mail": "EMAIL_ADDRESS"}))


@query(
    "stream_restore",
    """SELECT conv_id::VARCHAR AS stream_id, string_agg('Hi Zoë ' || conv_id || ': ' || text || ' <PERSON_1>x', '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""".replace("<PERSON_1>x", "<PERSON_12>"),
)
def stream_restore(spark, sf_dir):
    """Replies cut into small fragments, across placeholders; unknown placeholders stay."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    said = F.concat(F.lit("Hi <PERSON_1>: "), "text", F.lit(" <PERSON_12>"))
    cut = rows.select("conv_id", "turn", F.posexplode(F.regexp_extract_all(said, F.lit("[\\s\\S]{1,7}"), F.lit(0))).alias("i", "fragment"))
    mapping = F.to_json(F.create_map(F.lit("<PERSON_1>"), F.concat(F.lit("Zoë "), F.col("conv_id").cast("string"))))
    fragments = cut.select(
        F.col("conv_id").cast("string").alias("stream_id"), F.lit("text").alias("channel"), (F.col("turn") * 1_000_000 + F.col("i")).alias("seq"), "fragment",
        F.lit(False).alias("is_json"), F.lit(False).alias("flush"), mapping.alias("mapping"),
    )
    return ST.restore_batch(fragments).select("stream_id", "text")


@query(
    "gateway_rules",
    """SELECT conv_id * 100 + turn AS request, 'messages[0].content[0].text' AS path, 'scrub' AS action, text FROM conversations WHERE text <> ''
    UNION ALL SELECT conv_id * 100 + turn, 'messages[0].content[2].input.q', 'scrub', role FROM conversations
    UNION ALL SELECT conv_id * 100 + turn, 'system', 'gate', 'be brief' FROM conversations""",
)
def gateway_rules(spark, sf_dir):
    """Leaves of a message body: text and tool input are scrubbed, thinking is relayed, the system text is gated."""
    rows = table(spark, sf_dir, "conversations")
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("thinking"), F.lit(None).cast("struct<q:string>").alias("input"))
    thinking = F.struct(F.lit("thinking").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("private").alias("thinking"), F.lit(None).cast("struct<q:string>").alias("input"))
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("thinking"), F.struct(F.col("role").alias("q")).alias("input"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.array(text, thinking, tool).alias("content"))).alias("messages"), F.lit("be brief").alias("system")))
    requests = rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("request"), body.alias("body"), F.lit("messages").alias("protocol"))
    return G.gateway_leaves(requests, "request", "body", "protocol").select("request", "path", "action", "text")


@query("refine_spans", "SELECT doc_id, 'a' || doc_id || '@example.com' AS text, 14 AS span_start, 14 + length('a' || doc_id || '@example.com') AS span_end FROM documents")
def refine_spans(spark, sf_dir):
    """A padded detection of an assigned, quoted address is fitted to the address, in front of the document and in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    value = F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit("@example.com"))
    docs = docs.withColumn("text", _planted(F.concat(F.lit('CONTACT_MAIL="'), value, F.lit('"\nnext'))))
    rule = D.Rule("padded", "EMAIL_ADDRESS", r'CONTACT_MAIL="[^"]*"', 0.9, "model")
    docs = D.detect(docs, [rule])
    rows = D.span_rows(docs.withColumn("spans", E.refine(F.col("text"), F.col("spans"))), ["doc_id"])
    return rows.select("doc_id", "text", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


_SHOWN_IP = r"[0-9]{1,2}\.[0-9]+\.[0-9]+\.[0-9]+"


@query(
    "protect_documents",
    f"""WITH s AS ({Q.spans_sql(BASIC)}), i AS ({Q.islands_sql("SELECT * FROM s", priority="CASE entity_type WHEN 'PHONE_NUMBER' THEN 2 WHEN 'CREDIT_CARD' THEN 1 WHEN 'SECRET' THEN 1 ELSE 0 END")}),
    v AS (SELECT i.doc_id, i.a, bool_and(s.entity_type = 'IP_ADDRESS' AND regexp_full_match(s.text, '{_SHOWN_IP}')) AS ok FROM i JOIN s ON s.doc_id = i.doc_id AND s.a < i.z AND i.a < s.z GROUP BY ALL),
    m AS (SELECT i.*, i.doc_id::VARCHAR AS source, substring(d.text, a + 1, z - a) AS text FROM i JOIN v USING (doc_id, a) JOIN documents d USING (doc_id) WHERE NOT ok),
    {_numbered_sql("entity_type NOT IN ('CREDIT_CARD', 'SECRET')").strip()},
    swaps AS (SELECT m.doc_id, m.a, m.z, m.entity_type, {_LOSSY} AS fake FROM m LEFT JOIN map ON map.source = m.source AND map.original = m.text), r AS ({Q.rebuilt_sql("SELECT doc_id, a, z, fake FROM swaps")}),
    n AS (SELECT doc_id, count(*) AS n, bool_or(entity_type = 'PHONE_NUMBER') AS bad FROM swaps GROUP BY doc_id)
    SELECT doc_id, CASE WHEN coalesce(bad, false) THEN NULL ELSE coalesce(r.out, d.text) END AS anonymized, CASE WHEN coalesce(bad, false) THEN 'PHONE_NUMBER' ELSE '' END AS refused, coalesce(n, 0) AS n_spans
    FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)""",
)
def protect_documents(spark, sf_dir):
    """The whole call: detect, fit, merge, let addresses of short numbers through, refuse texts with a phone number."""
    rule = P.AllowRule(pattern=_SHOWN_IP, entity_types=("IP_ADDRESS",))
    out = engine.protect(table(spark, sf_dir, "documents").select("doc_id", "text"), engine.Protection(rules=BASIC, allow=(rule,), blocked=("PHONE_NUMBER",)))
    return out.select("doc_id", "anonymized", F.array_join("refused", ",").alias("refused"), "n_spans")


@query("protect_round_trip", "SELECT doc_id, text AS restored, 0 AS n_leaks FROM documents")
def protect_round_trip(spark, sf_dir):
    """Protected, searched for leaks and put back, each document by its own values."""
    sent = engine.protect(table(spark, sf_dir, "documents").select("doc_id", "text"), engine.Protection(rules=BASIC, policy=A.Policy(), repeats=True))
    back = engine.restore(sent, "anonymized")
    leaking = F.size(F.filter("originals", lambda v: F.contains("anonymized", v)))
    return back.select("doc_id", "restored", leaking.alias("n_leaks"))


def _bodies(spark, sf_dir, body: str) -> DataFrame:
    """A request made from each turn by a JSON-building expression."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("request"), F.expr(body).alias("body"))


_PARTS = "array(named_struct('type', 'text', 'text', text, 'url', cast(null as string)), named_struct('type', 'image_url', 'text', cast(null as string), 'url', 'x'))"
_CALL = "array(named_struct('function', named_struct('name', 'f', 'arguments', to_json(named_struct('q', role, 'n', 12345678)))))"


@query(
    "chat_leaves",
    """WITH c AS (SELECT conv_id * 100 + turn AS request, text, role FROM conversations)
    SELECT request, 'messages[1].content[0].text' AS path, text FROM c WHERE text <> '' UNION ALL SELECT request, 'messages[1].reasoning', 'so ' || role FROM c
    UNION ALL SELECT request, 'messages[1].tool_calls[0].function.arguments.$json.q', role FROM c UNION ALL SELECT request, 'messages[1].tool_calls[0].function.arguments.$json.n', '12345678' FROM c
    UNION ALL SELECT request, 'prediction.content', 'then ' || role FROM c""",
)
def chat_leaves(spark, sf_dir):
    """System messages passed by; parts, reasoning, tool arguments and auxiliary fields in order."""
    body = f"to_json(named_struct('messages', array(named_struct('role', 'system', 'content', array(named_struct('type', 'text', 'text', 'rules', 'url', cast(null as string))), 'reasoning', cast(null as string), 'tool_calls', slice({_CALL}, 1, 0)), named_struct('role', 'user', 'content', {_PARTS}, 'reasoning', concat('so ', role), 'tool_calls', {_CALL})), 'prediction', named_struct('content', concat('then ', role))))"
    return RQ.request_leaves(_bodies(spark, sf_dir, body), "request", "body", "chat", passthrough_system=True).select("request", "path", "text")


@query(
    "completion_and_embedding_leaves",
    """WITH c AS (SELECT conv_id * 100 + turn AS request, text, role FROM conversations)
    SELECT request, 'completions' AS endpoint, 0 AS scope, 'prompt[0]' AS path, text FROM c WHERE text <> '' UNION ALL SELECT request, 'completions', 0, 'prompt[1]', role FROM c UNION ALL SELECT request, 'completions', 0, 'suffix', 'end' FROM c
    UNION ALL SELECT request, 'embeddings', 0, 'input[0]', text FROM c WHERE text <> '' UNION ALL SELECT request, 'embeddings', 1, 'input[1]', role FROM c""",
)
def completion_and_embedding_leaves(spark, sf_dir):
    """Prompts and suffix share a mapping; every embedding input has one of its own."""
    body = "to_json(named_struct('prompt', array(text, role), 'suffix', 'end', 'input', array(text, role)))"
    rows = _bodies(spark, sf_dir, body)
    parts = [RQ.request_leaves(rows, "request", "body", e).withColumn("endpoint", F.lit(e)) for e in ("completions", "embeddings")]
    return parts[0].unionByName(parts[1]).select("request", "endpoint", "scope", "path", "text")


@query("request_round_trip", """SELECT conv_id * 100 + turn AS request, '<' || text || '>' AS text, '<' || role || '>' AS argument FROM conversations WHERE text <> ''""")
def request_round_trip(spark, sf_dir):
    """Leaves changed as rows and put back, those inside a tool call's JSON too."""
    body = f"to_json(named_struct('messages', array(named_struct('role', 'user', 'content', text, 'tool_calls', {_CALL}))))"
    rows = _bodies(spark, sf_dir, body).where(F.get_json_object("body", "$.messages[0].content") != "")
    found = RQ.request_leaves(rows, "request", "body", "chat")
    out = RQ.put_leaves(rows, found.select("request", "ordinal", F.concat(F.lit("<"), "text", F.lit(">")).alias("new_text")), "request", "body", "chat")
    arguments = F.get_json_object("body", "$.messages[0].tool_calls[0].function.arguments")
    return out.select("request", F.get_json_object("body", "$.messages[0].content").alias("text"), F.get_json_object(arguments, "$.q").alias("argument"))


@query(
    "restore_reply_trees",
    """SELECT conv_id * 100 + turn AS request, 'Zoë "' || role || '": ' || text AS text, '<PERSON_1>' AS thinking, 'Zoë "' || role || '"' AS argument FROM conversations""",
)
def restore_reply_trees(spark, sf_dir):
    """Replies restored leaf by leaf: thinking blocks stay, quotes in an original don't break tool arguments."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("request"), "role", "text")
    reply = F.expr("to_json(named_struct('a', concat('<PERSON_1>: ', text), 'b', named_struct('type', 'thinking', 't', '<PERSON_1>'), 'c', named_struct('arguments', '{\"to\": \"<PERSON_1>\"}')))")
    mapping = rows.select("request", F.lit("<PERSON_1>").alias("fake"), F.concat(F.lit('Zoë "'), "role", F.lit('"')).alias("original"))
    out = R.restore_documents(rows.select("request", reply.alias("reply")), mapping, "request", "reply", G.THINKING)
    at = lambda p: F.get_json_object("restored", p)
    return out.select("request", at("$.a").alias("text"), at("$.b.t").alias("thinking"), F.get_json_object(at("$.c.arguments"), "$.to").alias("argument"))


@query(
    "gateway_items",
    """WITH c AS (SELECT conv_id * 100 + turn AS request, text, role FROM conversations)
    SELECT request, 'input[0].output.stdout' AS path, text FROM c WHERE text <> '' UNION ALL SELECT request, 'input[1].content', 'says ' || role FROM c UNION ALL SELECT request, 'input[2].output[1].note', role FROM c""",
)
def gateway_items(spark, sf_dir):
    """Every leaf of tool output is scanned, what a role says is whatever the item's type, binary parts and opaque items are not."""
    image = F.struct(F.lit("input_image").alias("type"), F.col("text").alias("note"))
    item = lambda kind, **fields: F.to_json(F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in fields.items()]))
    items = [
        item("shell_call_output", output=F.struct(F.col("text").alias("stdout"))), item("additional_tools", role=F.lit("developer"), content=F.concat(F.lit("says "), "role")),
        item("function_call_output", output=F.array(image, F.struct(F.lit("part").alias("type"), F.col("role").alias("note")))), item("reasoning", text=F.col("text")),
    ]
    # The kind of the second part is a word of seven letters or fewer, but a leaf like any other.
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("request"), F.concat(F.lit('{"input": ['), F.concat_ws(", ", *items), F.lit("]}")).alias("body"), F.lit("responses").alias("protocol"))
    return G.gateway_leaves(rows, "request", "body", "protocol").where("path not like '%.type'").select("request", "path", "text")


@query(
    "allow_list_secrets",
    f"""SELECT doc_id, entity_type, text, a AS span_start, entity_type <> 'SECRET' AS by_value, entity_type = 'SECRET' AS by_type FROM ({Q.spans_sql((D.TOKEN_RULE, IP))})""",
)
def allow_list_secrets(spark, sf_dir):
    """A rule without types never reaches a secret, one that names the type does, even where it is blocked."""
    rows = _spans_of(spark, sf_dir, (D.TOKEN_RULE, IP))
    # No pattern may match the sample address among P.CANARIES; that one is let through as a value.
    any_type = [P.AllowRule(pattern=r"[0-9a-f]{40}|(?!203\.0\.113\.7(?![0-9.]))[0-9.]+"), P.AllowRule(value="203.0.113.7")]
    named = [P.AllowRule(pattern="[0-9a-f]{40}", entity_types=("SECRET",))]
    verdict = lambda rules, *blocked: P.allowed(F.col("entity_type"), F.col("text"), rules, blocked)
    return rows.select("doc_id", "entity_type", "text", F.col("start").alias("span_start"), verdict(any_type).alias("by_value"), verdict(named, "SECRET").alias("by_type"))


def _chunk(delta: str, finish: str = "cast(null as string)") -> str:
    return f"""concat('data: ', to_json(named_struct('model', 'm', 'choices', array(named_struct('index', 0, 'delta', {delta}, 'finish_reason', {finish})))))"""


@query(
    "stream_replies",
    """SELECT (conv_id * 100 + turn)::VARCHAR AS stream_id, 'Hi Zoë "Z" ' || conv_id || ': ' || text || ' <PERS' AS content, 'Zoë "Z" ' || conv_id AS argument, true AS framed FROM conversations""",
)
def stream_replies(spark, sf_dir):
    """Chat replies as server-sent events, text and tool arguments cut across placeholders: restored, with the comment
    before and [DONE] after them, and the tail that never became a placeholder."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("stream_id"), "conv_id", "text")
    said = "concat('Hi <PERSON_1>: ', text, ' <PERS')"
    text = f"transform(regexp_extract_all({said}, '[\\\\s\\\\S]{{1,7}}', 0), x -> {_chunk("named_struct('content', x)")})"
    call = "named_struct('tool_calls', array(named_struct('index', 0, 'function', named_struct('arguments', x))))"
    argument = f"""transform(array('{{"to": "<PER', 'SON_', '1>"}}'), x -> {_chunk(call)})"""
    end = _chunk("named_struct('content', cast(null as string))", "'stop'")
    body = F.expr(f"concat(array_join(concat(array(': ping'), {text}, {argument}, array({end}, 'data: [DONE]')), '\\n\\n'), '\\n\\n')")
    mapping = F.to_json(F.create_map(F.lit("<PERSON_1>"), F.concat(F.lit('Zoë "Z" '), F.col("conv_id").cast("string"))))
    blocks = sse.blocks(rows.select("stream_id", F.lit("chat").alias("protocol"), mapping.alias("mapping"), body.alias("body")), "body", ["stream_id", "protocol", "mapping"])
    out = RP.restore_replies(blocks).withColumn("data", sse.data_of(F.col("block")))
    delta = lambda p: F.coalesce(F.get_json_object("data", f"$.choices[0].delta.{p}"), F.lit(""))
    put = lambda v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", v.alias("v")))), lambda x: x["v"]), "")
    whole = out.groupBy("stream_id").agg(
        put(delta("content")).alias("content"), put(delta("tool_calls[0].function.arguments")).alias("arguments"),
        F.min_by("block", F.struct("seq", "part")).alias("head"), F.max_by("block", F.struct("seq", "part")).alias("tail"),
    )
    framed = (F.col("head") == ": ping") & (F.col("tail") == "data: [DONE]")
    return whole.select("stream_id", "content", F.get_json_object("arguments", "$.to").alias("argument"), framed.alias("framed"))


WORD = D.Rule("word", "PERSON", r"[^\x20\x09-\x0D]+", 1.0, "model")


def _words(text):
    """Token ids (2: begins with a capital) and offsets of the words of a text."""
    import re

    found = list(re.finditer(WORD.pattern, text))
    return [2 if "A" <= m[0][0] <= "Z" else 1 for m in found], [m.span() for m in found]


def _capitals(ids):
    """Logits of two labels, sure of each."""
    import numpy as np

    return np.stack([np.where(ids == 2, -9.0, 9.0), np.where(ids == 2, 9.0, -9.0)], axis=-1)


@query("token_model", f"SELECT doc_id, text, a AS span_start FROM ({Q.rule_sql(WORD, 0)}) WHERE regexp_matches(text, '^[A-Z]')")
def token_model(spark, sf_dir):
    """A made model of one label over windows of 64 tokens that share 16, stitched and decoded."""
    model = MD.TokenModel(_words, _capitals, ("O", "S-name"), {"name": "PERSON"}, window=64, overlap=16)
    found = MD.with_model(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return D.span_rows(found.select("doc_id", "model_spans"), ["doc_id"], "model_spans").select("doc_id", "text", F.col("start").alias("span_start"))


@query(
    "literal_options",
    "SELECT doc_id, 'p\\\\\\\"' || doc_id || '\\\\\\\"w9' AS text, 21 AS span_start FROM documents",
)
def literal_options(spark, sf_dir):
    """A quoted option inside a string literal: the value with the characters it has in the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    value = F.concat(F.lit('p\\\\\\"'), F.col("doc_id").cast("string"), F.lit('\\\\\\"w9'))
    docs = docs.withColumn("text", _planted(F.concat(F.lit('run("db --password=\\"'), value, F.lit('\\" --user x")'))))
    found = X.with_literals(docs, "text", "literals").withColumn("spans", X.literal_spans(F.col("text"), F.col("literals")))
    return D.span_rows(found.select("doc_id", "spans"), ["doc_id"]).select("doc_id", "text", F.col("start").alias("span_start"))


@query(
    "error_policy",
    f"""WITH n AS (SELECT doc_id, count(*) AS n FROM ({Q.rule_sql(EMAIL, 0)}) GROUP BY doc_id)
    SELECT doc_id, on_error, CASE WHEN fell AND on_error = 'block' THEN '{engine.FAILED}' ELSE '' END AS refused, CASE WHEN fell AND on_error = 'allow' THEN 0 ELSE coalesce(n, 0) END AS n_spans, fell AND on_error = 'allow' AS raw
    FROM (SELECT doc_id, coalesce(lang = 'en', false) AS fell FROM documents) LEFT JOIN n USING (doc_id), (VALUES ('block'), ('allow')) v(on_error)""",
)
def error_policy(spark, sf_dir):
    """Texts that a further detector failed on (here: those of one language) are refused, or go out raw if that is the policy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("lang") == "en").alias("fell"))
    parts = []
    for on_error in ("block", "allow"):
        out = engine.protect(docs, engine.Protection(rules=(EMAIL,), on_error=on_error), failed="fell")
        raw = F.coalesce(F.col("fell") & F.col("anonymized").eqNullSafe(F.col("text")), F.lit(False))
        parts.append(out.select("doc_id", F.lit(on_error).alias("on_error"), F.array_join("refused", ",").alias("refused"), "n_spans", raw.alias("raw")))
    return parts[0].unionByName(parts[1])


@query(
    "batch_counts",
    f"""WITH i AS ({Q.islands_sql(Q.spans_sql(BASIC))}), m AS (SELECT i.doc_id, d.source, i.entity_type, a, substring(d.text, a + 1, z - a) AS v FROM i JOIN documents d USING (doc_id)),
    f AS (SELECT doc_id, source, v, arg_min(entity_type, a) AS entity_type FROM m GROUP BY doc_id, source, v)
    SELECT source, entity_type, count(*) AS n FROM f GROUP BY source, entity_type""",
)
def batch_counts(spark, sf_dir):
    """Counts of a batch whose items have a mapping each: an item's distinct values, summed over the batch."""
    sent = engine.protect(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), engine.Protection(rules=BASIC, policy=A.Policy()))
    return engine.count_types(sent, ["source"])


@query(
    "primary_language",
    f"""SELECT s.doc_id, s.entity_type, s.text, s.a AS span_start FROM ({Q.spans_sql((EMAIL, HOST))}) s JOIN documents d USING (doc_id) WHERE s.src <> 'hosts' OR d.lang = 'en'""",
)
def primary_language(spark, sf_dir):
    """A detector that reads one language's names counts in texts of that language only; patterns count in all."""
    docs = D.detect(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), (EMAIL, HOST))
    kept = docs.withColumn("spans", D.keep_primary(F.col("spans"), F.col("lang"), "en", ["hosts"]))
    return D.span_rows(kept, ["doc_id"]).select("doc_id", "entity_type", "text", F.col("start").alias("span_start"))


# Each line holds one credential between the marks, which are not part of the text; # stands for a document's digits.
_FAMILIES = """export PAYMENTS_TOKEN=⟦tok########abcdefgh⟧
12: + ENV MAIL_SECRET="⟦sec########ret qrstuv⟧"
DB_PASS=⟦pw########⟧
SMTP_PWD: ⟦pw2########⟧
client_secret = '⟦cs########⟧'
Authorization: Bearer ⟦########abc.def⟧
found ⟦sk-live########abcdefghijkl⟧
also ⟦AKIA########ABCDEFGH⟧
then ⟦eyJhbGci########.eyJzdWIi########.sig########⟧
run --db-password ⟦pw3########⟧
get --token="⟦tk ########⟧"
app --api-key '⟦ak ########⟧'
⟦-----BEGIN PRIVATE KEY-----
MII########
-----END PRIVATE KEY-----⟧
postgres://u:⟦pu########⟧@h/db
"""


def _families() -> tuple[str, list[tuple[str, int]]]:
    """The text of _FAMILIES without its marks, and (value, start) of what they hold."""
    text, values = "", []
    for i, part in enumerate(_FAMILIES.replace("⟧", "⟦").split("⟦")):
        if i % 2:
            values.append((part, len(text)))
        text += part
    return text, values


_FAMILY_TEXT, _FAMILY_VALUES = _families()


@query(
    "secret_families",
    "SELECT doc_id, replace(v, '########', lpad(doc_id::VARCHAR, 8, '0')) AS text, a AS span_start FROM documents, (VALUES " + ", ".join("('" + v.replace("'", "''") + f"', {a})" for v, a in _FAMILY_VALUES) + ") f(v, a)",
)
def secret_families(spark, sf_dir):
    """A credential of every family written in front of each document, and the document's own; each is found as it is, merged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    planted = F.replace(F.lit(_FAMILY_TEXT), F.lit("########"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    docs = D.detect(docs.withColumn("text", _planted(planted)), X.SECRET_RULES)
    found = D.with_merged(docs, M.merge_column(F.col("spans"), F.col("text")))
    return D.span_rows(found.select("doc_id", "spans"), ["doc_id"]).select("doc_id", "text", F.col("start").alias("span_start"))


@query(
    "event_plans",
    """WITH c AS (SELECT conv_id * 100 + turn AS request, text FROM conversations)
    SELECT request, 'messages' AS protocol, 'delta' AS action, 'text:0' AS channel, text AS fragment, '' AS flushed FROM c UNION ALL SELECT request, 'messages', 'delta', 'json:1', text, '' FROM c
    UNION ALL SELECT request, 'messages', 'verbatim', NULL, NULL, '' FROM c UNION ALL SELECT request, 'messages', 'restore', NULL, NULL, 'text:1,json:1' FROM c
    UNION ALL SELECT request, 'responses', 'delta', 'response.output_text.delta:i1', text, '' FROM c UNION ALL SELECT request, 'responses', 'restore', NULL, NULL, 'response.output_text.delta:i1' FROM c
    UNION ALL SELECT request, 'responses', 'verbatim', NULL, NULL, '' FROM c""",
)
def event_plans(spark, sf_dir):
    """What a restorer does with events of two protocols: text and arguments on channels of their own, thinking kept."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("request"), "text")
    block = lambda i, kind, name: F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(i).alias("index"), F.struct(F.lit(kind).alias("type"), F.col("text").alias(name)).alias("delta")))
    item = lambda kind, name: F.to_json(F.struct(F.lit(f"response.{kind}").alias("type"), F.lit("i1").alias("item_id"), F.col("text").alias(name)))
    events = F.array(
        *[F.struct(F.lit("messages").alias("protocol"), d.alias("data")) for d in (block(0, "text_delta", "text"), block(1, "input_json_delta", "partial_json"), block(2, "thinking_delta", "thinking"), F.lit('{"type": "content_block_stop", "index": 1}'))],
        *[F.struct(F.lit("responses").alias("protocol"), d.alias("data")) for d in (item("output_text.delta", "delta"), item("output_text.done", "text"), item("reasoning_text.delta", "delta"))],
    )
    plan = EV.plan(rows.select("request", F.inline(events)), "data", "protocol")
    return plan.select("request", "protocol", "action", "channel", "fragment", F.array_join("flush", ",").alias("flushed"))


_BLOCKERS = (EMAIL, HOST, WIDE, DIGITS)


@query(
    "allow_list_blockers",
    f"""WITH s AS ({Q.spans_sql(_BLOCKERS)}), i AS ({Q.islands_sql("SELECT * FROM s")}), held AS (SELECT DISTINCT i.* FROM i JOIN s ON s.doc_id = i.doc_id AND s.a < i.z AND i.a < s.z AND s.entity_type = 'HOST')
    SELECT DISTINCT s.doc_id, s.entity_type, s.text, s.a AS span_start, s.z AS span_end FROM s JOIN held h ON s.doc_id = h.doc_id AND s.a < h.z AND h.a < s.z WHERE s.entity_type <> 'HOST'""",
)
def allow_list_blockers(spark, sf_dir):
    """Why an allowed host is still replaced: the address and the contact that it was found in."""
    rule = P.AllowRule(pattern=HOST.pattern, entity_types=("HOST",))
    docs = D.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), _BLOCKERS, out="raw").where(F.size("raw") > 0)
    docs = S.computed_once(docs, M.merge_column(F.col("raw"), F.col("text")), "merged")
    found = docs.select("doc_id", P.not_allowed(F.col("merged"), F.col("raw"), [rule]).alias("spans"))
    return _shown(D.span_rows(found, ["doc_id"]))
