"""SQL texts of the same operators, in the dialect the results are held against."""

from __future__ import annotations

from veilspan.operators.detect import Rule

_LUHN = """(list_sum(list_transform(range(1, length(d) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN d[length(d) - i + 1]::INT
         ELSE 2 * d[length(d) - i + 1]::INT - CASE WHEN d[length(d) - i + 1]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"""


def rule_sql(rule: Rule, no: int, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Spans of one rule: key, rule_no, match_no, entity_type, text, a (start), z (end), score, src."""
    p = rule.whole.replace("'", "''")
    value = f"regexp_extract(m[i], '{p}', 2)" if rule.prefix or rule.suffix else "m[i]"
    lead = f"length(regexp_extract(m[i], '{p}', 1))" if rule.prefix or rule.suffix else "0"
    check = "true"
    if rule.name == "card":
        check = f"(SELECT {_LUHN} FROM (SELECT regexp_replace(v, '[^0-9]', '', 'g') AS d))"
    if rule.name == "ip":
        check = "list_bool_and(list_transform(string_split(v, '.'), lambda x: x::INT <= 255))"
    return f"""
    SELECT {key}, {no} AS rule_no, i AS match_no, '{rule.entity_type}' AS entity_type, v AS text, a, a + length(v) AS z,
           {rule.score}::DOUBLE AS score, '{rule.source}' AS src
    FROM (SELECT {key}, i, {value} AS v,
                 (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + {lead})::INT AS a
          FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i
                FROM (SELECT {key}, regexp_extract_all({text}, '{p}') AS m, string_split_regex({text}, '{p}') AS g FROM {table})))
    WHERE {check}"""


def spans_sql(rules, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return " UNION ALL ".join(rule_sql(r, i, table, key, text) for i, r in enumerate(rules))


def islands_sql(spans: str, key: str = "doc_id", priority: str = "0") -> str:
    """Merged spans (key, entity_type, a, z, score, src) of a span query under the default resolution."""
    return f"""
    SELECT {key}, arg_max(entity_type, r) AS entity_type, min(a) AS a, max(z) AS z, arg_max(score, r) AS score, arg_max(src, r) AS src
    FROM (SELECT *, sum(fresh) OVER w AS island, ({priority}) * 1000000000000 + score * 100000000 - n AS r
          FROM (SELECT *, CASE WHEN a >= coalesce(max(z) OVER (PARTITION BY {key} ORDER BY a, z DESC, rule_no, match_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh,
                       row_number() OVER (PARTITION BY {key} ORDER BY a, z DESC, rule_no, match_no) AS n
                FROM ({spans}))
          WINDOW w AS (PARTITION BY {key} ORDER BY a, z DESC, rule_no, match_no))
    GROUP BY {key}, island"""


def fold_sql(spans: str, keeps: str) -> str:
    """Merged spans as ``islands_sql`` gives them, folded one by one: ``keeps`` says when the span so far, f, keeps its
    label against the next one, s, of another type."""
    won = f"CASE WHEN f.entity_type = s.entity_type THEN f.score >= s.score ELSE {keeps} END"
    label = lambda c: f"CASE WHEN s.a < f.z AND ({won}) THEN f.{c} ELSE s.{c} END"
    return f"""
    WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, z DESC, rule_no, match_no) AS n FROM ({spans})),
    f AS (SELECT doc_id, n, 0 AS island, entity_type, a, z, score, src FROM s WHERE n = 1 UNION ALL
          SELECT s.doc_id, s.n, f.island + CASE WHEN s.a < f.z THEN 0 ELSE 1 END, {label("entity_type")}, CASE WHEN s.a < f.z THEN f.a ELSE s.a END, greatest(f.z, s.z), {label("score")}, {label("src")}
          FROM f JOIN s ON s.doc_id = f.doc_id AND s.n = f.n + 1)
    SELECT doc_id, arg_max(entity_type, n) AS entity_type, min(a) AS a, max(z) AS z, arg_max(score, n) AS score, arg_max(src, n) AS src FROM f GROUP BY doc_id, island"""


def rebuilt_sql(swaps: str) -> str:
    """(doc_id, out) from swaps (doc_id, a, z, fake) that do not overlap, for documents that have any."""
    return f"""
    SELECT doc_id, string_agg(substring(d.text, prev + 1, a - prev) || fake, '' ORDER BY a) || substring(any_value(d.text), max(z) + 1, length(any_value(d.text))) AS out
    FROM (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM ({swaps})) JOIN documents d USING (doc_id)
    GROUP BY doc_id"""
