"""DuckDB SQL for the correctness oracle.

The oracle recomputes each query independently in DuckDB from the same
parquet tables.  DuckDB's regex engine (RE2) has no look-around and an
ASCII-only ``\\b``, so the oracle rules are the fixed rule texts with three
changes: ``\\s`` is written out as Python's whitespace set, the SSN
look-aheads become a filter on the matched groups, and a match whose edge
touches a non-ASCII letter or digit is dropped (Python's ``\\b`` is
Unicode-aware).  Positions come from the gap trick: ``regexp_split_to_array``
gives the text between matches.
"""

from __future__ import annotations

from redactflow.operators.boost import ANCHOR_WORDS
from redactflow.operators.rules import (
    DEFAULT_RULES, NAME_BLOCKLIST, SERVICE_THRESHOLD, Rule, active_rules,
)

# Python's whitespace set for RE2 (RE2's \s is ASCII and lacks \v).
_PY_WS = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UWORD = r"[\p{L}\p{N}_]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def re2_regex(rule: Rule) -> str:
    p = rule.pattern
    if rule.entity_type == "SSN":
        p = p.replace("(?!000|666|9\\d{2})", "").replace("(?!00)", "").replace("(?!0{4})", "")
    out, in_class, i = [], False, 0
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            if p[i + 1] == "s":
                out.append(_PY_WS if in_class else "[" + _PY_WS + "]")
            else:
                out.append(p[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return ("(?i)" if rule.ignore_case else "") + "".join(out)


def _word(ch_sql: str) -> str:
    return f"regexp_matches({ch_sql}, {q('^' + _UWORD + '$')})"


def name_check_sql(col: str) -> str:
    blocked = ", ".join(q(w) for w in NAME_BLOCKLIST)
    toks = f"list_filter(string_split_regex({col}, {q('[' + _PY_WS + ']+')}), lambda t: length(t) > 0)"
    bad = (f"len(list_filter({toks}, lambda t: NOT (regexp_full_match(t, {q(chr(94) + '[A-Za-z][A-Za-z' + chr(39) + '-]*$')}) "
           f"AND NOT list_contains([{blocked}], lower(t))))) = 0")
    return f"(len({toks}) BETWEEN 2 AND 4 AND {bad})"


def rule_spans_sql(rule: Rule, win: str = "win") -> str:
    """SELECT of one rule's spans over a windows relation
    (doc_id, wid, ws, content) -> doc_id, wid, ws, s, e, text, entity_type,
    confidence, rank, source; s/e are window offsets."""
    p = q(re2_regex(rule))
    conf, rank, et, src = f"CAST({float(rule.confidence)!r} AS DOUBLE)", rule.rank, q(rule.entity_type), q(rule.source)
    if rule.anchored:
        g1 = f"regexp_extract(content, {p}, 1)"
        m0 = f"regexp_extract(content, {p}, 0)"
        inner = (f"SELECT doc_id, wid, ws, content, CAST(length({m0}) - length({g1}) AS BIGINT) AS s, "
                 f"CAST(length({m0}) AS BIGINT) AS e, {g1} AS text, 0::BIGINT AS ms0 FROM {win} "
                 f"WHERE length({g1}) > 0")
    else:
        grp = f", regexp_extract_all(content, {p}, 1) AS cs" if rule.group else ""
        lens = ("coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + "
                "coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)")
        text = "cs[i]" if rule.group else "ms[i]"
        s_expr = "(ms0 + length(ms[i]) - length(cs[i]))" if rule.group else "ms0"
        inner = (
            f"SELECT doc_id, wid, ws, content, CAST({s_expr} AS BIGINT) AS s, "
            f"CAST(ms0 + length(ms[i]) AS BIGINT) AS e, {text} AS text, ms0, ms[i] AS m FROM ("
            f"SELECT *, CAST({lens} AS BIGINT) AS ms0 FROM (SELECT doc_id, wid, ws, content, ms, gs{', cs' if rule.group else ''}, "
            f"unnest(range(1, len(ms) + 1)) AS i FROM ("
            f"SELECT doc_id, wid, ws, content, regexp_extract_all(content, {p}) AS ms, "
            f"regexp_split_to_array(content, {p}) AS gs{grp} FROM {win} "
            f"WHERE regexp_matches(content, {p}))))")
    conds = [
        # Python \b is Unicode-aware: a match edge next to a non-ASCII letter is no boundary.
        f"NOT (ms0 > 0 AND {_word('substring(content, ms0, 1)')} AND {_word('substring(content, ms0 + 1, 1)')})",
        f"NOT (e < length(content) AND {_word('substring(content, e, 1)')} AND {_word('substring(content, e + 1, 1)')})",
    ]
    if rule.entity_type == "SSN":
        conds.append("NOT (substring(m, 1, 3) IN ('000', '666') OR substring(m, 1, 1) = '9' "
                     "OR substring(m, 5, 2) = '00' OR substring(m, 8, 4) = '0000')")
    if rule.name_check:
        conds.append(name_check_sql("text"))
    return (f"SELECT doc_id, wid, ws, s, e, text, {et} AS entity_type, {conf} AS confidence, "
            f"CAST({rank} AS BIGINT) AS rank, {src} AS source FROM ({inner}) WHERE " + " AND ".join(conds))


def windows_sql(src: str, size: int = 500, overlap: int = 100) -> str:
    """``src`` yields (doc_id, text) -> (doc_id, text, wid, ws, we, content)."""
    step = size - overlap
    return (f"SELECT doc_id, text, CAST(ws // {step} AS BIGINT) AS wid, CAST(ws AS BIGINT) AS ws, "
            f"CAST(least(ws + {size}, length(text)) AS BIGINT) AS we, substring(text, ws + 1, {size}) AS content "
            f"FROM (SELECT doc_id, text, unnest(range(0, length(text), {step})) AS ws FROM ({src}))")


def boost_sql(conf: str, text: str, s: str, e: str) -> str:
    sl = f"lower(substring({text}, greatest({s} - 100, 0) + 1, {e} + 100 - greatest({s} - 100, 0)))"
    total = "CAST(0.0 AS DOUBLE)"
    for words in ANCHOR_WORDS.values():
        hit = " OR ".join(f"contains({sl}, {q(w)})" for w in words)
        total = f"({total} + CASE WHEN {hit} THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)"
    return f"least({conf} + {total}, CAST(1.0 AS DOUBLE))"


def pipeline_ctes(src: str, threshold: float = SERVICE_THRESHOLD, rules=DEFAULT_RULES,
                  size: int = 500, overlap: int = 100, boost: bool = True, external: str | None = None) -> str:
    """CTEs: win, raw (all rule spans, window offsets), wd (window dedup),
    dd (document dedup), ents (final: handles dropped, boosted, idx).
    ``external`` yields (doc_id, s, e, text, entity_type, score, rank) at document
    offsets; spans scoring at least the threshold join every window holding them."""
    use = active_rules(threshold, rules)
    parts = [f"({rule_spans_sql(r)})" for r in use]
    if external:
        parts.append(f"(SELECT w.doc_id, w.wid, w.ws, x.s - w.ws AS s, x.e - w.ws AS e, x.text, x.entity_type, "
                     f"CAST(x.score AS DOUBLE) AS confidence, CAST(x.rank AS BIGINT) AS rank, 'statistical' AS source "
                     f"FROM ({external}) x JOIN win w ON w.doc_id = x.doc_id AND x.s >= w.ws AND x.e <= w.we "
                     f"WHERE x.score >= {threshold!r})")
    raw = " UNION ALL ".join(parts)
    conf = boost_sql("d.confidence", "t.text", "d.s", "d.e") if boost else "d.confidence"
    return f"""win AS ({windows_sql(src, size, overlap)}),
raw AS ({raw}),
wd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, wid, s, e ORDER BY confidence DESC, rank) AS rn FROM raw) WHERE rn = 1),
dd AS (SELECT doc_id, s + ws AS s, e + ws AS e, entity_type, text, max(confidence) AS confidence, min(wid) AS wid, min(source) AS source
       FROM wd GROUP BY doc_id, s + ws, e + ws, entity_type, text),
kept AS (SELECT d.* FROM dd d WHERE NOT (d.entity_type = 'PROFILE_HANDLE' AND EXISTS (
          SELECT 1 FROM dd u WHERE u.doc_id = d.doc_id AND u.entity_type = 'URL' AND u.s <= d.s AND u.e >= d.e))),
ents AS (SELECT d.doc_id, d.s, d.e, d.entity_type, d.text, {conf} AS confidence, d.wid, d.source,
         row_number() OVER (PARTITION BY d.doc_id ORDER BY d.s, d.e, d.wid) - 1 AS idx
         FROM kept d JOIN ({src}) t ON t.doc_id = d.doc_id)"""


DOCS_SRC = "SELECT doc_id, text FROM documents"
PAGES_SRC = "SELECT page_id AS doc_id, url AS text FROM pages"
