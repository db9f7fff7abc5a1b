"""Registered queries (Spark) and their DuckDB oracle SQL.

Every query reads the given tables (or text Spark derives from them) whole.
Column names and types are aligned with the SQL: integers BIGINT,
confidences DOUBLE rounded to 4 places, no timestamps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow import oracle as O
from redactflow import tables as TB
from redactflow.functions.text import WINDOW_OVERLAP, WINDOW_SIZE, context_windows
from redactflow.operators import detect as D
from redactflow.operators import redact as R
from redactflow.operators.rules import RULES_BY_NAME, Rule
from redactflow.plans.scrub import ScrubConfig, detect, entity_rows, scrub

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r4(c: Column) -> Column:
    return F.round(c, 4)


# ---- shared building blocks ----------------------------------------------------

def window_rows(docs: DataFrame, size: int = WINDOW_SIZE, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """One row per window: doc_id, window_id, ws (start), we (end), content."""
    w = explode_structs(docs.select("doc_id", context_windows(F.col("text"), size, overlap).alias("w")),
                        "w", ["doc_id"])
    return w.select("doc_id", F.col("x.window_id").alias("window_id"), F.col("x.start_char").alias("ws"),
                    F.col("x.end_char").alias("we"), F.col("x.content").alias("content"))


def explode_structs(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """Explode an array of structs without an inferred ``size > 0`` filter
    (which Catalyst would push below exchanges and so evaluate twice)."""
    return (df.select(*keep, F.posexplode_outer(col).alias("pos", "x"))
            .where(F.col("pos").isNotNull()))


def spans_by_window(docs: DataFrame, rules, dedup: bool) -> DataFrame:
    w = window_rows(docs)
    ents = D.union_detectors(F.col("content"), rules, F.col("window_id"))
    if dedup:
        ents = D.dedup_window_spans(ents)
    return explode_structs(w.select("doc_id", "window_id", "ws", ents.alias("ents")), "ents",
                           ["doc_id", "window_id", "ws"])


def _doc_entity_cols(extra: list[Column] | None = None) -> list[Column]:
    return [F.col("doc_id"), F.col("idx"), F.col("start_char"), F.col("end_char"), F.col("entity_type"),
            F.col("text"), r4(F.col("confidence")).alias("confidence")] + (extra or [])


ENT_SQL_COLS = ("doc_id, idx, s AS start_char, e AS end_char, entity_type, text, "
                "round(confidence, 4) AS confidence")


def _with(src: str, body: str, *extra_ctes: str, **kw) -> str:
    """Pipeline CTEs for ``src``, then ``extra_ctes``, then ``body``."""
    ctes = ",\n".join([O.pipeline_ctes(src, **kw), *extra_ctes])
    return f"WITH {ctes}\n{body}"


# ---- 2.3 single rules ----------------------------------------------------------

_RULE_SOURCES = {
    "detect_email": ("docs", O.DOCS_SRC), "detect_phone": ("docs", O.DOCS_SRC),
    "detect_aadhaar": ("forms", TB.FORMS_SQL), "detect_ssn": ("forms", TB.FORMS_SQL),
    "detect_credit_card": ("docs", O.DOCS_SRC), "detect_ip": ("docs", O.DOCS_SRC),
    "detect_url": ("pages", O.PAGES_SRC), "detect_registration_number": ("forms", TB.FORMS_SQL),
    "detect_registration_context": ("forms", TB.FORMS_SQL), "detect_person_context": ("forms", TB.FORMS_SQL),
    "detect_profile_handle": ("forms", TB.FORMS_SQL), "detect_leading_name": ("docs", O.DOCS_SRC),
}
_SPARK_SOURCES = {
    "docs": TB.documents, "forms": TB.customer_forms, "pages": TB.pages_urls,
}


def _rule_query(rule: Rule, src_key: str) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spans_by_window(_SPARK_SOURCES[src_key](spark, sf_dir), (rule,), dedup=False)
        return rows.select(
            "doc_id", F.col("window_id").cast("long").alias("window_id"),
            (F.col("x.s") + F.col("ws")).cast("long").alias("start_char"),
            (F.col("x.e") + F.col("ws")).cast("long").alias("end_char"),
            F.col("x.text").alias("text"), F.col("x.entity_type").alias("entity_type"))
    return run


def _rule_sql(rule: Rule, src: str) -> str:
    return (f"WITH win AS ({O.windows_sql(src)}) SELECT doc_id, wid AS window_id, s + ws AS start_char, "
            f"e + ws AS end_char, text, entity_type FROM ({O.rule_spans_sql(rule)})")


for _name, (_key, _src) in _RULE_SOURCES.items():
    register(_name, _rule_sql(RULES_BY_NAME[_name], _src))(_rule_query(RULES_BY_NAME[_name], _key))


# ---- 2.2 text preparation ------------------------------------------------------

@register("normalize_text", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[" + O._PY_WS
          + "]+', ' ', 'g'), '[\\x00-\\x08\\x0e-\\x1b]', '', 'g')) AS normalized, "
          "CAST(length(trim(regexp_replace(regexp_replace(text, '[" + O._PY_WS
          + "]+', ' ', 'g'), '[\\x00-\\x08\\x0e-\\x1b]', '', 'g'))) AS BIGINT) AS n_chars FROM documents")
def q_normalize_text(spark, sf_dir):
    from redactflow.functions.text import normalize_text
    n = normalize_text(F.col("text"))
    return TB.documents(spark, sf_dir).select("doc_id", n.alias("normalized"),
                                              F.length(n).cast("long").alias("n_chars"))


@register("context_windows", f"SELECT doc_id, wid AS window_id, ws AS start_char, we AS end_char, "
          f"CAST(length(content) AS BIGINT) AS length, content FROM ({O.windows_sql(O.DOCS_SRC)})")
def q_context_windows(spark, sf_dir):
    w = window_rows(TB.documents(spark, sf_dir))
    return w.select("doc_id", F.col("window_id").cast("long").alias("window_id"),
                    F.col("ws").cast("long").alias("start_char"), F.col("we").cast("long").alias("end_char"),
                    F.length("content").cast("long").alias("length"), "content")


# ---- 2.3 / 2.4 pipeline stages -------------------------------------------------

@register("union_detectors", _with(O.DOCS_SRC, "SELECT doc_id, wid AS window_id, s AS start_char, e AS end_char, "
                                   "entity_type, text, rank, confidence FROM raw"))
def q_union_detectors(spark, sf_dir):
    rows = spans_by_window(TB.documents(spark, sf_dir), ScrubConfig().plan_rules(), dedup=False)
    return rows.select("doc_id", F.col("window_id").cast("long").alias("window_id"),
                       F.col("x.s").cast("long").alias("start_char"), F.col("x.e").cast("long").alias("end_char"),
                       F.col("x.entity_type").alias("entity_type"), F.col("x.text").alias("text"),
                       F.col("x.rank").cast("long").alias("rank"), r4(F.col("x.confidence")).alias("confidence"))


@register("dedup_window_spans", _with(O.DOCS_SRC, "SELECT doc_id, wid AS window_id, s AS start_char, e AS end_char, "
                                      "entity_type, text, rank, confidence FROM wd"))
def q_dedup_window_spans(spark, sf_dir):
    rows = spans_by_window(TB.documents(spark, sf_dir), ScrubConfig().plan_rules(), dedup=True)
    return rows.select("doc_id", F.col("window_id").cast("long").alias("window_id"),
                       F.col("x.s").cast("long").alias("start_char"), F.col("x.e").cast("long").alias("end_char"),
                       F.col("x.entity_type").alias("entity_type"), F.col("x.text").alias("text"),
                       F.col("x.rank").cast("long").alias("rank"), r4(F.col("x.confidence")).alias("confidence"))


@register("rebase_offsets", _with(O.DOCS_SRC, "SELECT doc_id, wid AS window_id, s + ws AS start_char, "
                                  "e + ws AS end_char, entity_type, text FROM wd"))
def q_rebase_offsets(spark, sf_dir):
    rows = spans_by_window(TB.documents(spark, sf_dir), ScrubConfig().plan_rules(), dedup=True)
    return rows.select("doc_id", F.col("window_id").cast("long").alias("window_id"),
                       (F.col("x.s") + F.col("ws")).cast("long").alias("start_char"),
                       (F.col("x.e") + F.col("ws")).cast("long").alias("end_char"),
                       F.col("x.entity_type").alias("entity_type"), F.col("x.text").alias("text"))


def _doc_entities(docs: DataFrame, cfg: ScrubConfig = ScrubConfig()) -> DataFrame:
    return entity_rows(detect(docs, cfg=cfg))


@register("dedup_document_spans", _with(O.DOCS_SRC, "SELECT doc_id, s AS start_char, e AS end_char, entity_type, "
                                        "text, round(confidence, 4) AS confidence, wid AS first_window FROM dd"))
def q_dedup_document_spans(spark, sf_dir):
    docs = TB.documents(spark, sf_dir)
    ents = D.dedup_document_spans(D.detect_windows(F.col("text"), ScrubConfig().plan_rules()))
    rows = explode_structs(docs.select("doc_id", ents.alias("ents")), "ents", ["doc_id"])
    return rows.select("doc_id", F.col("x.s").cast("long").alias("start_char"),
                       F.col("x.e").cast("long").alias("end_char"), F.col("x.entity_type").alias("entity_type"),
                       F.col("x.text").alias("text"), r4(F.col("x.confidence")).alias("confidence"),
                       F.col("x.window_id").cast("long").alias("first_window"))


@register("drop_handles_in_urls", _with(TB.FORMS_SQL, f"SELECT {ENT_SQL_COLS} FROM ents", boost=False))
def q_drop_handles_in_urls(spark, sf_dir):
    return _doc_entities(TB.customer_forms(spark, sf_dir), ScrubConfig(boost=False)).select(*_doc_entity_cols())


@register("context_boost", _with(O.DOCS_SRC, f"SELECT {ENT_SQL_COLS} FROM ents"))
def q_context_boost(spark, sf_dir):
    return _doc_entities(TB.documents(spark, sf_dir)).select(*_doc_entity_cols())


@register("order_entities", _with(O.DOCS_SRC, "SELECT doc_id, idx, s AS start_char, e AS end_char FROM ents"))
def q_order_entities(spark, sf_dir):
    return _doc_entities(TB.documents(spark, sf_dir)).select("doc_id", "idx", "start_char", "end_char")


@register("scrub_forms", _with(TB.FORMS_SQL, f"SELECT {ENT_SQL_COLS} FROM ents"))
def q_scrub_forms(spark, sf_dir):
    return _doc_entities(TB.customer_forms(spark, sf_dir)).select(*_doc_entity_cols())


@register("scrub_pages", _with(O.PAGES_SRC, f"SELECT {ENT_SQL_COLS} FROM ents"))
def q_scrub_pages(spark, sf_dir):
    return _doc_entities(TB.pages_urls(spark, sf_dir)).select(*_doc_entity_cols())


# ---- 2.6 / 2.7 redaction ---------------------------------------------------------

def _mask_sql(mode: str, t: str = "text", ty: str = "entity_type") -> str:
    if mode == "placeholder":
        return f"('<' || {ty} || '>')"
    if mode == "partial":
        return (f"(CASE WHEN length({t}) <= 4 THEN repeat('X', CAST(length({t}) AS BIGINT)) "
                f"ELSE substring({t}, 1, 2) || repeat('X', CAST(length({t}) - 2 AS BIGINT)) END)")
    return f"(CASE WHEN length({t}) = 0 THEN '████' ELSE repeat('█', CAST(length({t}) AS BIGINT)) END)"


_RED_SEQ = "row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, e, wid) - 1"


def _scrubbed(spark, sf_dir, mode="full", src=TB.documents, **kw) -> DataFrame:
    return scrub(src(spark, sf_dir), cfg=ScrubConfig(mode=mode, **kw))


def _replacement_rows(mode: str) -> QueryFn:
    def run(spark, sf_dir):
        rows = entity_rows(_scrubbed(spark, sf_dir, mode))
        return rows.select("doc_id", "idx", "entity_type", "text", "replacement")
    return run


for _mode, _name in (("full", "mask_full"), ("placeholder", "mask_placeholder"), ("partial", "mask_partial")):
    register(_name, _with(O.DOCS_SRC, f"SELECT doc_id, idx, entity_type, text, {_mask_sql(_mode)} AS replacement "
                                      f"FROM ents"))(_replacement_rows(_mode))


@register("mask_dispatch", _with(O.DOCS_SRC, " UNION ALL ".join(
    f"SELECT doc_id, idx, '{m}' AS mode, {_mask_sql(m if m != 'hash' else 'full')} AS replacement FROM ents"
    for m in ("full", "placeholder", "partial", "hash"))))
def q_mask_dispatch(spark, sf_dir):
    from redactflow.functions.masks import replacement
    rows = _doc_entities(TB.documents(spark, sf_dir))
    modes = ("full", "placeholder", "partial", "hash")
    per_mode = F.array(*[F.struct(F.lit(m).alias("mode"),
                                  replacement(m, F.col("text"), F.col("entity_type")).alias("replacement"))
                         for m in modes])
    return rows.select("doc_id", "idx", F.inline(per_mode))


def _splice_sql(src: str, red_cte: str) -> str:
    """Fold of a ``red(doc_id, l)`` list (redaction order) over each text of ``src``."""
    return _with(src, f"""SELECT d.doc_id, CASE WHEN r.l IS NULL THEN d.text ELSE list_reduce(r.l, lambda acc, x:
       substring(acc, 1, x.s) || x.r || substring(acc, x.e + 1), d.text) END AS redacted_text
FROM ({src}) d LEFT JOIN red r ON r.doc_id = d.doc_id""", *red_cte)


def _redacted_sql(src: str, mode: str) -> str:
    return _splice_sql(src, [f"red AS (SELECT doc_id, list(struct_pack(s := s, e := e, r := {_mask_sql(mode)}) "
                             f"ORDER BY s DESC, e, wid) AS l FROM ents GROUP BY doc_id)"])


def _redacted_query(mode: str, src=TB.documents) -> QueryFn:
    def run(spark, sf_dir):
        return _scrubbed(spark, sf_dir, mode, src, ).select("doc_id", "redacted_text")
    return run


register("redact_documents", _redacted_sql(O.DOCS_SRC, "full"))(_redacted_query("full"))
register("redact_documents_placeholder", _redacted_sql(O.DOCS_SRC, "placeholder"))(_redacted_query("placeholder"))
register("redact_documents_partial", _redacted_sql(O.DOCS_SRC, "partial"))(_redacted_query("partial"))
register("redact_forms_placeholder", _redacted_sql(TB.FORMS_SQL, "placeholder"))(
    _redacted_query("placeholder", TB.customer_forms))


@register("redaction_order", _with(O.DOCS_SRC, f"SELECT doc_id, {_RED_SEQ} AS seq, s AS start_char, e AS end_char FROM ents"))
def q_redaction_order(spark, sf_dir):
    docs = detect(TB.documents(spark, sf_dir))
    rows = explode_structs(docs.select("doc_id", R.redaction_order(F.col("entities")).alias("r")), "r", ["doc_id"])
    return rows.select("doc_id", F.col("pos").cast("long").alias("seq"), F.col("x.s").cast("long").alias("start_char"),
                       F.col("x.e").cast("long").alias("end_char"))


@register("redaction_metadata", _with(
    O.DOCS_SRC, f"SELECT doc_id, {_RED_SEQ} AS seq, text AS original_text, entity_type, {_mask_sql('placeholder')} "
                f"AS replacement, s AS position_start, e AS position_end, round(confidence, 4) AS confidence FROM ents"))
def q_redaction_metadata(spark, sf_dir):
    out = _scrubbed(spark, sf_dir, "placeholder")
    rows = explode_structs(out.select("doc_id", "redaction_metadata"), "redaction_metadata", ["doc_id"])
    return rows.select("doc_id", F.col("pos").cast("long").alias("seq"), F.col("x.original_text").alias("original_text"),
                       F.col("x.entity_type").alias("entity_type"), F.col("x.replacement").alias("replacement"),
                       F.col("x.position.start").cast("long").alias("position_start"),
                       F.col("x.position.end").cast("long").alias("position_end"),
                       r4(F.col("x.confidence")).alias("confidence"))


_PSEUDO_SQL = """
SELECT doc_id, text, entity_type, 'USER_' || upper(substring(entity_type, 1, 3)) || '_' ||
       CAST(row_number() OVER (PARTITION BY doc_id, upper(substring(entity_type, 1, 3)) ORDER BY first_seq) AS VARCHAR) AS pseudonym
FROM (SELECT doc_id, text, entity_type, min(seq) AS first_seq
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, e, wid) AS seq FROM ents)
      GROUP BY doc_id, text, entity_type)"""


@register("pseudonymize_document", _with(TB.FORMS_SQL, _PSEUDO_SQL))
def q_pseudonymize_document(spark, sf_dir):
    docs = detect(TB.customer_forms(spark, sf_dir))
    rows = explode_structs(docs.select("doc_id", R.pseudonym_entries(F.col("entities")).alias("p")), "p", ["doc_id"])
    return rows.select("doc_id", F.col("x.k.text").alias("text"), F.col("x.k.entity_type").alias("entity_type"),
                       F.col("x.n").alias("pseudonym"))


@register("redact_documents_pseudonym", _splice_sql(TB.FORMS_SQL, [f"ps AS ({_PSEUDO_SQL})", """red AS (
  SELECT e.doc_id, list(struct_pack(s := e.s, e := e.e, r := p.pseudonym) ORDER BY e.s DESC, e.e, e.wid) AS l
  FROM ents e JOIN ps p ON p.doc_id = e.doc_id AND p.text = e.text AND p.entity_type = e.entity_type
  GROUP BY e.doc_id)"""]))
def q_redact_documents_pseudonym(spark, sf_dir):
    return _scrubbed(spark, sf_dir, "pseudonym", TB.customer_forms, pseudonymize=True).select("doc_id", "redacted_text")


@register("redact_terms", _with(O.DOCS_SRC, """SELECT d.doc_id, CASE WHEN t.l IS NULL THEN d.text
       ELSE list_reduce(t.l, lambda acc, x: replace(acc, x.t, x.r), d.text) END AS redacted_text
FROM documents d LEFT JOIN terms t ON t.doc_id = d.doc_id""", f"""terms AS (
  SELECT doc_id, list(struct_pack(t := text, r := {_mask_sql('full', 'text')}) ORDER BY length(text) DESC, text) AS l
  FROM (SELECT DISTINCT doc_id, text FROM ents WHERE length(text) > 0) GROUP BY doc_id)"""))
def q_redact_terms(spark, sf_dir, src=TB.documents):
    from redactflow.operators.terms import redact_terms_pass
    out = _scrubbed(spark, sf_dir, "full", src)
    terms = R.term_replacements(F.col("redaction_metadata"), "full")
    return redact_terms_pass(out, "text", terms, "replaced").select("doc_id", F.col("replaced").alias("redacted_text"))


@register("redact_terms_placeholder", REGISTRY["redact_terms"][1].replace(
    _mask_sql("full", "text") + ") ORDER BY", _mask_sql("placeholder", "text") + ") ORDER BY").replace(
    "FROM (SELECT DISTINCT doc_id, text FROM ents", "FROM (SELECT doc_id, text, arg_max(entity_type, seq) AS entity_type FROM "
    "(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, e, wid) AS seq FROM ents)").replace(
    "WHERE length(text) > 0) GROUP BY doc_id)", "WHERE length(text) > 0 GROUP BY doc_id, text) GROUP BY doc_id)"))
def q_redact_terms_placeholder(spark, sf_dir, src=TB.documents):
    from redactflow.operators.terms import redact_terms_pass
    out = _scrubbed(spark, sf_dir, "placeholder", src)
    terms = R.term_replacements(F.col("redaction_metadata"), "placeholder")
    return redact_terms_pass(out, "text", terms, "replaced").select("doc_id", F.col("replaced").alias("redacted_text"))


@register("distinct_terms", _with(O.DOCS_SRC, """SELECT doc_id, text AS term,
  row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, text) - 1 AS rank
FROM (SELECT DISTINCT doc_id, text FROM ents WHERE length(text) > 0)"""))
def q_distinct_terms(spark, sf_dir, src=TB.documents):
    out = _scrubbed(spark, sf_dir, "full", src)
    terms = R.term_replacements(F.col("redaction_metadata"), "full")
    rows = explode_structs(out.select("doc_id", terms.alias("t")), "t", ["doc_id"])
    return rows.select("doc_id", F.col("x.term").alias("term"), F.col("pos").cast("long").alias("rank"))


_ISLANDS_SQL = """isl AS (
  SELECT doc_id, s, e, entity_type, idx,
         sum(CASE WHEN pe IS NULL OR s >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS island
  FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
        FROM ents)),
islands AS (SELECT doc_id, island, min(s) AS s, max(e) AS e, arg_min(entity_type, idx) AS entity_type,
            count(*) AS n FROM isl GROUP BY doc_id, island)"""


@register("merge_overlaps", _with(O.DOCS_SRC, "SELECT doc_id, s AS start_char, e AS end_char, n AS n_spans, "
                                              "entity_type FROM islands", _ISLANDS_SQL))
def q_merge_overlaps(spark, sf_dir, src=TB.documents):
    docs = detect(src(spark, sf_dir))
    rows = explode_structs(docs.select("doc_id", R.merge_overlaps(R.document_order(F.col("entities"))).alias("m")),
                           "m", ["doc_id"])
    return rows.select("doc_id", F.col("x.s").cast("long").alias("start_char"), F.col("x.e").cast("long").alias("end_char"),
                       F.col("x.n").cast("long").alias("n_spans"), F.col("x.entity_type").alias("entity_type"))


@register("redact_documents_merged", _splice_sql(O.DOCS_SRC, [_ISLANDS_SQL, """red AS (
  SELECT doc_id, list(struct_pack(s := s, e := e, r := '<' || entity_type || '>') ORDER BY s DESC) AS l
  FROM islands GROUP BY doc_id)"""]))
def q_redact_documents_merged(spark, sf_dir, src=TB.documents):
    docs = detect(src(spark, sf_dir))
    return docs.select("doc_id", R.redact_merged(F.col("text"), F.col("entities"), "placeholder").alias("redacted_text"))


_GREEDY_SQL = """g AS (SELECT doc_id, list_reduce(list(struct_pack(s := s, e := e, k := []::BIGINT[]) ORDER BY idx),
     lambda acc, x: CASE WHEN x.s < coalesce(acc.k[-1], 0) THEN acc
                         ELSE struct_pack(s := acc.s, e := acc.e, k := list_concat(acc.k, [x.s, x.e])) END,
     struct_pack(s := 0, e := 0, k := []::BIGINT[])).k AS k FROM ents GROUP BY doc_id)"""


@register("greedy_nonoverlap", _with(O.DOCS_SRC, """SELECT doc_id, CAST(i AS BIGINT) AS pos, k[2 * i + 1] AS start_char,
       k[2 * i + 2] AS end_char FROM (SELECT doc_id, k, unnest(range(0, len(k) // 2)) AS i FROM g)""", _GREEDY_SQL))
def q_greedy_nonoverlap(spark, sf_dir, src=TB.documents):
    docs = detect(src(spark, sf_dir))
    rows = explode_structs(docs.select("doc_id", R.greedy_nonoverlap(R.document_order(F.col("entities"))).alias("g")),
                           "g", ["doc_id"])
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("x.s").cast("long").alias("start_char"),
                       F.col("x.e").cast("long").alias("end_char"))


def _esc_sql(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#x27;')")


@register("annotate_spans", _with(O.DOCS_SRC, f"""SELECT d.doc_id, CASE WHEN g.k IS NULL THEN {_esc_sql('d.text')} ELSE
  list_reduce(list_transform(range(0, len(g.k) // 2), lambda i: struct_pack(s := g.k[2 * i + 1], e := g.k[2 * i + 2],
    t := '')), lambda acc, x: struct_pack(s := x.e, e := 0, t := acc.t || {_esc_sql('substring(d.text, acc.s + 1, x.s - acc.s)')}
    || '<mark title="' || ty.m[x.s] || '">' || {_esc_sql('substring(d.text, x.s + 1, x.e - x.s)')} || '<sup>' || ty.m[x.s]
    || '</sup></mark>'), struct_pack(s := 0, e := 0, t := '')).t || {_esc_sql('substring(d.text, g.k[-1] + 1)')} END AS html
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN ty ON ty.doc_id = d.doc_id""", _GREEDY_SQL,
    "ty AS (SELECT doc_id, map(list(s ORDER BY idx), list(entity_type ORDER BY idx)) AS m FROM "
    "(SELECT * FROM ents QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY idx) = 1) GROUP BY doc_id)"))
def q_annotate_spans(spark, sf_dir, src=TB.documents):
    docs = detect(src(spark, sf_dir))
    return docs.select("doc_id", R.annotate_spans(F.col("text"), F.col("entities")).alias("html"))


# ---- 2.3 predicates and scalars --------------------------------------------------

@register("threshold_filter", _with(TB.FORMS_SQL, f"SELECT {ENT_SQL_COLS} FROM ents", threshold=0.985))
def q_threshold_filter(spark, sf_dir):
    return _doc_entities(TB.customer_forms(spark, sf_dir), ScrubConfig(threshold=0.985)).select(*_doc_entity_cols())


_CANDIDATES = r"(?U)[A-Z][a-z]+(?:[\s\x1c-\x1f]+[A-Z][a-z]+){1,3}"


@register("looks_like_name", "SELECT doc_id, CAST(i - 1 AS BIGINT) AS idx, cands[i] AS candidate, " + O.name_check_sql("cands[i]") + " AS is_name FROM ("
          "SELECT *, unnest(range(1, len(cands) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, "
          + O.q("[A-Z][a-z]+(?:[" + O._PY_WS + "]+[A-Z][a-z]+){1,3}") + ") AS cands FROM documents))")
def q_looks_like_name(spark, sf_dir):
    """Every run of two to four capitalised words of every text."""
    docs = TB.documents(spark, sf_dir).select("doc_id", F.regexp_extract_all("text", F.lit(_CANDIDATES), F.lit(0)).alias("cands"))
    rows = explode_structs(docs, "cands", ["doc_id"])
    return rows.select("doc_id", F.col("pos").cast("long").alias("idx"), F.col("x").alias("candidate"), D.looks_like_name(F.col("x")).alias("is_name"))


@register("length_confidence", _with(O.DOCS_SRC, "SELECT doc_id, idx, text, CASE WHEN length(text) > 3 "
                                                  "THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS score FROM ents"))
def q_length_confidence(spark, sf_dir):
    from redactflow.operators.detect import length_confidence
    rows = _doc_entities(TB.documents(spark, sf_dir))
    return rows.select("doc_id", "idx", "text", length_confidence(F.col("text")).alias("score"))


@register("context_slice", _with(O.DOCS_SRC, """SELECT e.doc_id, e.idx, lower(substring(d.text, greatest(e.s - 100, 0) + 1,
  e.e + 100 - greatest(e.s - 100, 0))) AS slice FROM ents e JOIN documents d ON d.doc_id = e.doc_id"""))
def q_context_slice(spark, sf_dir):
    from redactflow.functions.arrays import let
    from redactflow.functions.text import context_slice_of, cut_text
    docs = detect(TB.documents(spark, sf_dir))
    # the text is cut once per document; no entity row carries it
    slices = let(cut_text(F.col("text")), lambda pieces: F.transform("entities", lambda x: context_slice_of(pieces, x["s"], x["e"])))
    rows = explode_structs(docs.select("doc_id", slices.alias("slices")), "slices", ["doc_id"])
    return rows.select("doc_id", F.col("pos").cast("long").alias("idx"), F.col("x").alias("slice"))


def _minimal_sql() -> str:
    from redactflow.operators.rules import MINIMAL_RULES
    raw = " UNION ALL ".join(f"({O.rule_spans_sql(r)})" for r in MINIMAL_RULES)
    return (f"WITH win AS ({O.windows_sql(O.DOCS_SRC)}) SELECT doc_id, wid AS window_id, s + ws AS start_char, "
            f"e + ws AS end_char, entity_type, text, round(confidence, 4) AS confidence FROM ({raw})")


@register("detect_minimal_profile", _minimal_sql())
def q_detect_minimal_profile(spark, sf_dir):
    from redactflow.operators.rules import MINIMAL_RULES
    rows = spans_by_window(TB.documents(spark, sf_dir), MINIMAL_RULES, dedup=False)
    return rows.select("doc_id", F.col("window_id").cast("long").alias("window_id"),
                       (F.col("x.s") + F.col("ws")).cast("long").alias("start_char"),
                       (F.col("x.e") + F.col("ws")).cast("long").alias("end_char"),
                       F.col("x.entity_type").alias("entity_type"), F.col("x.text").alias("text"),
                       r4(F.col("x.confidence")).alias("confidence"))


_LUHN_SQL = ("(regexp_full_match(t, '[0-9]+') AND list_sum(list_transform(range(0, length(t)), lambda i: "
             "CASE WHEN i % 2 = 1 THEN CAST(substring(reverse(t), i + 1, 1) AS INTEGER) * 2 - "
             "CASE WHEN CAST(substring(reverse(t), i + 1, 1) AS INTEGER) * 2 > 9 THEN 9 ELSE 0 END "
             "ELSE CAST(substring(reverse(t), i + 1, 1) AS INTEGER) END)) % 10 = 0)")


@register("card_luhn_flag", _with(TB.FORMS_SQL, "SELECT doc_id, idx, text, "
                                  + _LUHN_SQL.replace("t,", "text,").replace("(t)", "(text)")
                                  + " AS luhn_ok FROM ents WHERE entity_type = 'CREDIT_CARD'"))
def q_card_luhn_flag(spark, sf_dir):
    rows = _doc_entities(TB.customer_forms(spark, sf_dir)).where(F.col("entity_type") == "CREDIT_CARD")
    return rows.select("doc_id", "idx", "text", F.expr("luhn_check(text)").alias("luhn_ok"))


# ---- 2.4 overlaps, 2.7 corpus pseudonyms ------------------------------------------

# spans meet in the position bucket where their overlap starts, as a span lies in each bucket that it touches
@register("overlap_pairs", _with(O.DOCS_SRC, """SELECT a.doc_id, a.idx AS a_idx, b.idx AS b_idx FROM placed a JOIN placed b
  ON a.doc_id = b.doc_id AND a.bucket = b.bucket AND a.bucket = greatest(a.s, b.s) // 256
WHERE a.idx < b.idx AND b.s < a.e AND a.s < b.e""",
                                  "spans AS MATERIALIZED (SELECT doc_id, idx, s, e FROM ents)",
                                  "placed AS MATERIALIZED (SELECT *, unnest(range(s // 256, greatest(e - 1, s) // 256 + 1)) AS bucket FROM spans)"))
def q_overlap_pairs(spark, sf_dir, src=TB.documents):
    from redactflow.operators.report import overlap_pairs
    return overlap_pairs(_doc_entities(src(spark, sf_dir)))


_CORPUS_NAMES_SQL = """SELECT text, entity_type, 'USER_' || upper(substring(entity_type, 1, 3))
  || '_' || CAST(row_number() OVER (PARTITION BY upper(substring(entity_type, 1, 3)) ORDER BY fd, fs, text, entity_type)
  AS VARCHAR) AS pseudonym
FROM (SELECT text, entity_type, arg_min(doc_id, struct_pack(d := doc_id, q := seq)) AS fd,
             arg_min(seq, struct_pack(d := doc_id, q := seq)) AS fs FROM
      (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, e, wid) - 1 AS seq FROM ents)
      GROUP BY text, entity_type)"""


@register("pseudonymize_corpus", _with(TB.FORMS_SQL, _CORPUS_NAMES_SQL))
def q_pseudonymize_corpus(spark, sf_dir):
    from redactflow.operators.report import pseudonymize_corpus
    return pseudonymize_corpus(_in_redaction_order(TB.customer_forms(spark, sf_dir)))


def _in_redaction_order(docs: DataFrame) -> DataFrame:
    """doc_id, seq (place in redaction order), text, entity_type of every entity."""
    rows = explode_structs(detect(docs).select("doc_id", R.redaction_order(F.col("entities")).alias("r")), "r", ["doc_id"])
    return rows.select("doc_id", F.col("pos").cast("long").alias("seq"), F.col("x.text").alias("text"),
                       F.col("x.entity_type").alias("entity_type"))


_KEYS_SQL = """SELECT text, entity_type, upper(substring(entity_type, 1, 3)) AS p, min(struct_pack(d := doc_id, q := seq)) AS f FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, e, wid) - 1 AS seq FROM ents) GROUP BY text, entity_type"""


@register("pseudonymize_corpus_two_runs", f"""WITH k1 AS ({_with(TB.FORMS_SQL, _KEYS_SQL)}),
k2 AS ({_with(TB.LONG_FORMS_SQL, _KEYS_SQL)}),
r1 AS (SELECT text, entity_type, p, row_number() OVER (PARTITION BY p ORDER BY f, text, entity_type) AS n, 1 AS version FROM k1),
r2 AS (SELECT text, entity_type, p, row_number() OVER (PARTITION BY p ORDER BY f, text, entity_type)
         + coalesce((SELECT max(n) FROM r1 WHERE r1.p = k2.p), 0) AS n, 2 AS version
       FROM k2 WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.text = k2.text AND r1.entity_type = k2.entity_type))
SELECT text, entity_type, 'USER_' || p || '_' || CAST(n AS VARCHAR) AS pseudonym, CAST(version AS BIGINT) AS version
FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2)""")
def q_pseudonymize_corpus_two_runs(spark, sf_dir):
    """A dictionary of the forms, then a second run over the long forms that keeps its names and adds the new ones."""
    import uuid

    from redactflow.operators.report import store_pseudonyms
    from redactflow.session import shared_dir
    path = shared_dir(spark, f"pseudonyms-{uuid.uuid4().hex}")
    store_pseudonyms(_in_redaction_order(TB.customer_forms(spark, sf_dir)), path, 1)
    names = store_pseudonyms(_in_redaction_order(TB.long_forms(spark, sf_dir)), path, 2)
    return names.select("text", "entity_type", "pseudonym", F.col("version").cast("long").alias("version"))


# ---- 2.5 aggregations --------------------------------------------------------------

@register("entity_distribution", _with(O.DOCS_SRC, "SELECT doc_id, entity_type, count(*) AS n FROM ents "
                                                    "GROUP BY doc_id, entity_type"))
def q_entity_distribution(spark, sf_dir):
    from redactflow.operators.report import entity_distribution_rows
    return entity_distribution_rows(detect(TB.documents(spark, sf_dir)))


@register("entity_distribution_corpus", _with(O.DOCS_SRC, """SELECT d.lang, d.source AS doc_source, e.entity_type, count(*) AS n
FROM ents e JOIN documents d ON d.doc_id = e.doc_id GROUP BY ROLLUP (d.lang, d.source, e.entity_type)"""))
def q_entity_distribution_corpus(spark, sf_dir):
    from redactflow.operators.report import entity_distribution_corpus
    docs = TB.documents(spark, sf_dir, extra=("lang", "source")).withColumnRenamed("source", "doc_source")
    rows = entity_rows(detect(docs), extra=("lang", "doc_source"))
    return entity_distribution_corpus(rows, ("lang", "doc_source"))


@register("document_summary", _with(O.DOCS_SRC, """SELECT d.doc_id, coalesce(c.k, 0) AS entities_found,
  coalesce(c.k, 0) AS redactions_applied, coalesce(c.by_type, '') AS by_type
FROM documents d LEFT JOIN (SELECT doc_id, sum(n) AS k, string_agg(entity_type || ':' || n, ',' ORDER BY entity_type) AS by_type
  FROM (SELECT doc_id, entity_type, count(*) AS n FROM ents GROUP BY doc_id, entity_type) GROUP BY doc_id) c
ON c.doc_id = d.doc_id"""))
def q_document_summary(spark, sf_dir):
    from redactflow.operators.report import by_type_text
    out = _scrubbed(spark, sf_dir, "full")
    return out.select("doc_id", F.size("entities").cast("long").alias("entities_found"),
                      F.size("redaction_metadata").cast("long").alias("redactions_applied"),
                      by_type_text(F.col("entities")).alias("by_type"))


@register("run_metrics", _with(O.DOCS_SRC, """SELECT (SELECT count(*) FROM documents) AS documents,
  (SELECT count(*) FROM ents) AS entities, (SELECT count(*) FROM ents) AS redactions,
  (SELECT count(DISTINCT entity_type) FROM ents) AS distinct_types,
  (SELECT sum(length(text)) FROM documents) AS characters_processed"""))
def q_run_metrics(spark, sf_dir):
    from redactflow.operators.report import run_metrics
    return run_metrics(_scrubbed(spark, sf_dir, "full"))


@register("redaction_stats", _with(O.DOCS_SRC, "SELECT count(*) AS total_redacted, count(*) AS audit_entries, "
                                                "CAST(0 AS BIGINT) AS pseudonym_mappings FROM ents"))
def q_redaction_stats(spark, sf_dir):
    from redactflow.operators.report import redaction_stats_rows
    return redaction_stats_rows(detect(TB.documents(spark, sf_dir)))


@register("audit_log", _with(O.DOCS_SRC, f"""SELECT doc_id, {_RED_SEQ} AS seq, entity_type, round(confidence, 4) AS confidence,
  'placeholder' AS replacement_mode, 'file' AS context_key, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS context_value
FROM ents"""))
def q_audit_log(spark, sf_dir):
    from redactflow.operators.report import FILE_CONTEXT_KEY, audit_log
    out = _scrubbed(spark, sf_dir, "placeholder")
    rows = explode_structs(out.select("doc_id", "redaction_metadata"), "redaction_metadata", ["doc_id"])
    ents = rows.select("doc_id", F.col("pos").cast("long").alias("seq"), F.col("x.entity_type").alias("entity_type"),
                       F.col("x.confidence").alias("confidence"))
    ctx = F.create_map(F.lit(FILE_CONTEXT_KEY), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    log = audit_log(ents, "placeholder", ctx)
    return log.select("doc_id", "seq", "entity_type", r4(F.col("confidence")).alias("confidence"), "replacement_mode",
                      F.map_keys("context")[0].alias("context_key"), F.map_values("context")[0].alias("context_value"))


# ---- 2.8 feedback and knowledge -----------------------------------------------------

@register("feedback_append", f"SELECT * FROM ({TB.EVENTS_FEEDBACK_SQL})")
def q_feedback_append(spark, sf_dir):
    return TB.events_feedback(spark, sf_dir)


@register("feedback_stats", f"""SELECT feedback_type, count(*) AS n, sum(count(*)) OVER () AS total_feedback
FROM ({TB.EVENTS_FEEDBACK_SQL}) GROUP BY feedback_type""")
def q_feedback_stats(spark, sf_dir):
    from redactflow.operators.report import feedback_stats
    return feedback_stats(TB.events_feedback(spark, sf_dir))


@register("feedback_stats_zero_filled", f"""SELECT count(*) AS total_feedback,
  count(*) FILTER (WHERE feedback_type = 'missed') AS missed,
  count(*) FILTER (WHERE feedback_type = 'over_scrubbed') AS over_scrubbed,
  count(*) FILTER (WHERE feedback_type = 'correct') AS correct FROM ({TB.EVENTS_FEEDBACK_SQL})""")
def q_feedback_stats_zero_filled(spark, sf_dir):
    from redactflow.operators.report import feedback_stats_zero_filled
    return feedback_stats_zero_filled(TB.events_feedback(spark, sf_dir))


@register("feedback_by_domain", f"SELECT domain, feedback_type, count(*) AS n FROM ({TB.EVENTS_FEEDBACK_SQL}) "
                                "GROUP BY domain, feedback_type")
def q_feedback_by_domain(spark, sf_dir):
    from redactflow.operators.report import feedback_by_domain
    return feedback_by_domain(TB.events_feedback(spark, sf_dir))


@register("feedback_flag_entities", _with(TB.FORMS_SQL, f"""SELECT entity_type, correct, over_scrubbed, missed,
  round(correct / nullif(correct + over_scrubbed, 0), 4) AS precision FROM (
  SELECT f.entity_type, count(*) FILTER (WHERE feedback_type = 'correct') AS correct,
         count(*) FILTER (WHERE feedback_type = 'over_scrubbed') AS over_scrubbed,
         count(*) FILTER (WHERE feedback_type = 'missed') AS missed
  FROM ({TB.EVENTS_FEEDBACK_SQL}) f WHERE EXISTS (SELECT 1 FROM ents e WHERE e.text = f.entity AND e.entity_type = f.entity_type)
  GROUP BY f.entity_type)"""))
def q_feedback_flag_entities(spark, sf_dir):
    from redactflow.operators.report import feedback_flag_entities
    return feedback_flag_entities(TB.events_feedback(spark, sf_dir), _doc_entities(TB.customer_forms(spark, sf_dir)))


_KB_SQL = """kb AS (SELECT text AS entity_text, arg_min(entity_type, struct_pack(nc := -c, t := entity_type)) AS entity_type,
  sum(c) AS frequency FROM (SELECT text, entity_type, count(*) AS c FROM ents GROUP BY text, entity_type) GROUP BY text)"""


@register("knowledge_build", _with(TB.FORMS_SQL, "SELECT entity_text, entity_type, CAST(frequency AS BIGINT) AS frequency "
                                                 "FROM kb", _KB_SQL))
def q_knowledge_build(spark, sf_dir):
    from redactflow.operators.report import knowledge_build
    return knowledge_build(_doc_entities(TB.customer_forms(spark, sf_dir)))


_BOTH_SQL = f"SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM ({TB.LONG_FORMS_SQL})"


@register("knowledge_upsert", _with(_BOTH_SQL, "SELECT entity_text, entity_type, CAST(frequency AS BIGINT) AS frequency FROM kb", _KB_SQL))
def q_knowledge_upsert(spark, sf_dir):
    """A stored state of the documents' entities, and the long forms' merged in: the table of both."""
    import uuid

    from redactflow.operators.report import knowledge_view, store_knowledge
    from redactflow.session import shared_dir
    path = shared_dir(spark, f"knowledge-{uuid.uuid4().hex}")
    store_knowledge(_doc_entities(TB.documents(spark, sf_dir)), path, 1)
    return knowledge_view(store_knowledge(_doc_entities(TB.long_forms(spark, sf_dir)), path, 2))


@register("knowledge_lookup", _with(TB.FORMS_SQL, f"""SELECT f.entity, f.feedback_type, k.entity_type AS kb_type,
  CAST(k.frequency AS BIGINT) AS kb_frequency FROM ({TB.EVENTS_FEEDBACK_SQL}) f LEFT JOIN kb k ON k.entity_text = f.entity""",
                                    _KB_SQL))
def q_knowledge_lookup(spark, sf_dir):
    from redactflow.operators.report import knowledge_build, knowledge_lookup
    kb = knowledge_build(_doc_entities(TB.customer_forms(spark, sf_dir)))
    fb = TB.events_feedback(spark, sf_dir).select(F.col("entity").alias("text"), "feedback_type")
    out = knowledge_lookup(fb, kb)
    return out.select(F.col("text").alias("entity"), "feedback_type", "kb_type", "kb_frequency")


# ---- 2.3 external spans and domain patterns -------------------------------------

_EXTERNAL_SQL = """SELECT l.doc_id, 0 AS s, length(regexp_extract(d.text, '^[^ \\t\\n]+', 0)) AS e,
  regexp_extract(d.text, '^[^ \\t\\n]+', 0) AS text, 'MODEL_FLAG' AS entity_type,
  CASE WHEN l.toxic = 1 THEN 0.99 ELSE 0.90 END AS score, 12 AS rank
FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE length(regexp_extract(d.text, '^[^ \\t\\n]+', 0)) > 0"""


def model_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for a model's output, derived from ``labels``: the first token
    of each labelled document, flagged 0.99 when toxic and 0.90 otherwise
    (below the service threshold, so dropped as the reference drops them)."""
    lab = TB.load(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = TB.load(spark, sf_dir, "documents").select("doc_id", "text")
    tok = F.regexp_extract(F.col("text"), r"^[^ \t\n]+", 0)
    return (lab.join(docs, "doc_id").where(F.length(tok) > 0)
            .select("doc_id", F.lit(0).alias("s"), F.length(tok).alias("e"), tok.alias("text"),
                    F.lit("MODEL_FLAG").alias("entity_type"),
                    F.when(F.col("toxic") == 1, F.lit(0.99)).otherwise(F.lit(0.90)).alias("score")))


@register("union_external_spans", _with(O.DOCS_SRC, f"SELECT {ENT_SQL_COLS} FROM ents", external=_EXTERNAL_SQL))
def q_union_external_spans(spark, sf_dir):
    from redactflow.plans.scrub import union_external_spans
    docs = union_external_spans(TB.documents(spark, sf_dir), model_spans(spark, sf_dir))
    return entity_rows(detect(docs, external_col="external")).select(*_doc_entity_cols())


# Our own example domain-pattern table (id, domain, name, regex, boost).
# "secret_token" appears twice: the later row (higher id) wins the lookup.
DOMAIN_PATTERNS = (
    (1, "general", "secret_token", "[0-9a-f]{40}", 0.05),
    (2, "general", "secret_token", 'token = "[0-9a-f]{40}"', 0.10),
    (3, "general", "visa_like", "^4[0-9]{15}$", 0.01),
    (4, "finance", "iban", "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", 0.10),
    (5, "medical", "mrn", "MRN[- ]?[0-9]{6,10}", 0.10),
    (6, "general", "own_mail", "@example", 0.30),
    (7, "general", "own_mail", "example[.]com$", 0.02),
)
_PATTERNS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {O.q(d)}, {O.q(n)}, {O.q(r)}, CAST({b!r} AS DOUBLE))" for i, d, n, r, b in DOMAIN_PATTERNS
) + ") AS t(id, domain, pattern_name, pattern_regex, confidence_boost)"
_LOOKUP_SQL = (f"SELECT domain, pattern_name, arg_max(pattern_regex, id) AS pattern_regex, "
               f"arg_max(confidence_boost, id) AS confidence_boost FROM ({_PATTERNS_SQL}) GROUP BY domain, pattern_name")


def domain_patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DOMAIN_PATTERNS), "id long, domain string, pattern_name string, "
                                                        "pattern_regex string, confidence_boost double")


@register("detect_domain_patterns", f"""SELECT doc_id, pattern_name, CAST(ms0 AS BIGINT) AS start_char,
  CAST(ms0 + length(ms[i]) AS BIGINT) AS end_char, ms[i] AS text FROM (
  SELECT *, CAST(coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)
          + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS ms0 FROM (
    SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT d.doc_id, p.pattern_name, regexp_extract_all(d.text, p.pattern_regex) AS ms,
             regexp_split_to_array(d.text, p.pattern_regex) AS gs
      FROM documents d JOIN ({_LOOKUP_SQL}) p ON p.domain = 'general')))""")
def q_detect_domain_patterns(spark, sf_dir):
    from redactflow.operators.boost import detect_domain_patterns
    return detect_domain_patterns(TB.documents(spark, sf_dir), domain_patterns(spark), "general")


def customer_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern for every customer, of four kinds: a padded number, a link in any case, a word
    repeated, and one without a literal that a match could not do without (``CUSTOMER_PATTERNS_SQL``)."""
    k = F.col("c_custkey")
    kind = (F.when(k % 200 == 7, F.concat(F.lit("(?:[#]"), k.cast("string"), F.lit("|\\|"), k.cast("string"), F.lit("\\|)")))
            .when(k % 3 == 0, F.concat(F.lit("RX-0*"), TB._pad(k, 6), F.lit("\\.")))
            .when(k % 3 == 1, F.concat(F.lit("(?i)GITHUB\\.COM/customer-"), TB._pad(k, 9), F.lit("(?: and)?")))
            .otherwise(F.concat(F.lit("Card (?:4[0-9]{3}|5) ?[0-9]*"), TB._pad(k, 5), F.lit("[.]"))))
    return TB.load(spark, sf_dir, "customer").select(
        k.alias("id"), F.lit("general").alias("domain"), F.concat(F.lit("customer_"), k.cast("string")).alias("pattern_name"),
        kind.alias("pattern_regex"), F.lit(0.1).alias("confidence_boost"))


CUSTOMER_PATTERNS_SQL = f"""SELECT CASE WHEN c_custkey % 200 = 7 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 0 THEN {TB._pad_sql('c_custkey', 6)}
       WHEN c_custkey % 3 = 1 THEN {TB._pad_sql('c_custkey', 9)} ELSE {TB._pad_sql('c_custkey', 5)} END AS needed,
  'customer_' || CAST(c_custkey AS VARCHAR) AS pattern_name,
  CASE WHEN c_custkey % 200 = 7 THEN '(?:[#]' || CAST(c_custkey AS VARCHAR) || '|\\|' || CAST(c_custkey AS VARCHAR) || '\\|)'
       WHEN c_custkey % 3 = 0 THEN 'RX-0*' || {TB._pad_sql('c_custkey', 6)} || '\\.'
       WHEN c_custkey % 3 = 1 THEN '(?i)GITHUB\\.COM/customer-' || {TB._pad_sql('c_custkey', 9)} || '(?: and)?'
       ELSE 'Card (?:4[0-9]{{3}}|5) ?[0-9]*' || {TB._pad_sql('c_custkey', 5)} || '[.]' END AS pattern_regex FROM customer"""


# a match holds a digit run that ends in the customer's padded number: the SQL searches only texts that do
@register("detect_domain_patterns_indexed", f"""WITH d AS MATERIALIZED ({TB.FORMS_SQL}), p AS MATERIALIZED ({CUSTOMER_PATTERNS_SQL}),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS run FROM d),
ends AS (SELECT DISTINCT doc_id, n FROM (SELECT doc_id, unnest([run, right(run, 5), right(run, 6), right(run, 9)]) AS n FROM runs)),
pairs AS MATERIALIZED (SELECT d.doc_id, d.text, p.pattern_name, p.pattern_regex FROM p JOIN ends ON ends.n = p.needed JOIN d ON d.doc_id = ends.doc_id)
SELECT doc_id, pattern_name, CAST(ms0 AS BIGINT) AS start_char,
  CAST(ms0 + length(ms[i]) AS BIGINT) AS end_char, ms[i] AS text FROM (
  SELECT *, CAST(coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)
          + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS ms0 FROM (
    SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, pattern_name, regexp_extract_all(text, pattern_regex) AS ms, regexp_split_to_array(text, pattern_regex) AS gs FROM pairs)))""")
def q_detect_domain_patterns_indexed(spark, sf_dir):
    """As many patterns as customers, over all forms, through the literal index."""
    from redactflow.operators.boost import detect_domain_patterns
    return detect_domain_patterns(TB.customer_forms(spark, sf_dir), customer_patterns(spark, sf_dir), "general", max_patterns=20)


@register("apply_domain_boost", _with(TB.FORMS_SQL, f"""SELECT e.doc_id, e.idx, e.entity_type, e.text,
  round(least(e.confidence + coalesce((SELECT sum(p.confidence_boost) FROM ({_LOOKUP_SQL}) p
    WHERE p.domain = 'general' AND regexp_matches(e.text, p.pattern_regex)), 0.0), 1.0), 4) AS confidence
FROM ents e"""))
def q_apply_domain_boost(spark, sf_dir):
    from redactflow.operators.boost import apply_domain_boost
    ents = _doc_entities(TB.customer_forms(spark, sf_dir)).withColumn("domain", F.lit("general"))
    out = apply_domain_boost(ents, domain_patterns(spark))
    return out.select("doc_id", "idx", "entity_type", "text", r4(F.col("confidence")).alias("confidence"))


# ---- 2.1 sources and sinks (table forms) -------------------------------------------

@register("src_file_manifest", """SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS file_name,
  CAST(strlen(text) AS BIGINT) AS file_size_bytes, '.txt' AS file_format, sha256(text) AS file_hash FROM documents""")
def q_src_file_manifest(spark, sf_dir):
    """Documents as files named doc_<id>.txt: size in UTF-8 bytes and SHA-256
    of the bytes (``sources.files.file_manifest`` does the same for real files)."""
    docs = TB.documents(spark, sf_dir)
    return docs.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
                       F.octet_length("text").cast("long").alias("file_size_bytes"), F.lit(".txt").alias("file_format"),
                       F.sha2(F.col("text"), 256).alias("file_hash"))


_VALIDATE_LIMIT_KB = 16


@register("src_validate_files", f"""SELECT doc_id, is_valid, message FROM (
  SELECT doc_id, CASE WHEN strlen(text) > {_VALIDATE_LIMIT_KB} * 1024 THEN 'File exceeds max size of {_VALIDATE_LIMIT_KB}KB'
    WHEN substring(text, 1, 4) = 'PK' || chr(3) || chr(4) THEN 'Potential ZIP bomb detected'
    ELSE 'File validation passed' END AS message,
    (CASE WHEN strlen(text) > {_VALIDATE_LIMIT_KB} * 1024 THEN false WHEN substring(text, 1, 4) = 'PK' || chr(3) || chr(4)
     THEN false ELSE true END) AS is_valid FROM documents)""")
def q_src_validate_files(spark, sf_dir):
    """Documents as .txt files checked with a 16 KB size limit and the ZIP
    signature test (``sources.files.validate_files`` for real files)."""
    from redactflow.sources.files import MSG_PASSED, MSG_ZIP_BOMB, ZIP_SIGNATURE_HEX
    docs = TB.documents(spark, sf_dir)
    too_big = F.octet_length("text") > _VALIDATE_LIMIT_KB * 1024
    is_zip = F.upper(F.hex(F.substring(F.encode(F.col("text"), "UTF-8"), 1, 4))) == ZIP_SIGNATURE_HEX
    msg = (F.when(too_big, F.lit(f"File exceeds max size of {_VALIDATE_LIMIT_KB}KB"))
           .when(is_zip, F.lit(MSG_ZIP_BOMB)).otherwise(F.lit(MSG_PASSED)))
    return docs.select("doc_id", (msg == MSG_PASSED).alias("is_valid"), msg.alias("message"))


_TABLE_COLS_SRC = ("SELECT 'customer|' || CAST(c_custkey AS VARCHAR) || '|c_name' AS doc_id, c_name AS text FROM customer "
                   "UNION ALL SELECT 'customer|' || CAST(c_custkey AS VARCHAR) || '|c_mktsegment', c_mktsegment FROM customer "
                   "UNION ALL SELECT 'supplier|' || CAST(s_suppkey AS VARCHAR) || '|s_name', s_name FROM supplier")


@register("src_table_columns", _with(_TABLE_COLS_SRC, """SELECT split_part(doc_id, '|', 1) AS "table",
  CAST(split_part(doc_id, '|', 2) AS BIGINT) AS row_key, split_part(doc_id, '|', 3) AS "column",
  s AS start_char, e AS end_char, entity_type, text FROM ents"""))
def q_src_table_columns(spark, sf_dir):
    parts = [TB.table_text_columns(TB.load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"),
                                   "c_custkey", "customer"),
             TB.table_text_columns(TB.load(spark, sf_dir, "supplier").select("s_suppkey", "s_name"),
                                   "s_suppkey", "supplier")]
    cells = parts[0].unionByName(parts[1])
    rows = entity_rows(detect(cells), id_cols=("table", "row_key", "column"))
    return rows.select("table", "row_key", "column", "start_char", "end_char", "entity_type", "text")


@register("sink_metadata_csv", _with(O.DOCS_SRC, f"""SELECT doc_id, {_RED_SEQ} AS seq, entity_type,
  {_mask_sql('partial')} AS replacement, s AS position_start, e AS position_end, round(confidence, 4) AS confidence FROM ents"""))
def q_sink_metadata_csv(spark, sf_dir):
    """The rows ``write_metadata_csv`` writes (original text left out)."""
    from redactflow.sources.sinks import metadata_csv_rows
    rows = metadata_csv_rows(_scrubbed(spark, sf_dir, "partial"))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), "entity_type", "replacement",
                       F.col("position_start").cast("long").alias("position_start"),
                       F.col("position_end").cast("long").alias("position_end"), r4(F.col("confidence")).alias("confidence"))


@register("sink_output_names", """SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || '_redacted.txt' AS redacted,
  'doc_' || CAST(doc_id AS VARCHAR) || '_metadata.json' AS metadata, 'doc_' || CAST(doc_id AS VARCHAR) || '_audit.json' AS audit
FROM documents""")
def q_sink_output_names(spark, sf_dir):
    from redactflow.sources.sinks import file_stem, output_names
    docs = TB.documents(spark, sf_dir)
    names = output_names(file_stem(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))))
    return docs.select("doc_id", names["redacted"].alias("redacted"), names["metadata"].alias("metadata"),
                       names["audit"].alias("audit"))


# ---- 2.10 streaming ------------------------------------------------------------------

def _stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = TB.load(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parq*")


def _unique(name: str) -> str:
    import uuid
    return f"{name}_{uuid.uuid4().hex[:8]}"


@register("stream_scrub", f"""SELECT doc_id, redacted_text FROM ({_redacted_sql(O.DOCS_SRC, 'full')})""")
def q_stream_scrub(spark, sf_dir):
    from redactflow.streaming.stream import run_to_parquet, stream_scrub
    path = _fresh_dir(spark, "stream_scrub")
    run_to_parquet(stream_scrub(_stream_of(spark, sf_dir, "documents").select("doc_id", "text")), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select("doc_id", "redacted_text")


@register("stream_pseudonyms", _splice_sql(TB.FORMS_SQL, [f"ps AS ({_CORPUS_NAMES_SQL})", """red AS (
  SELECT e.doc_id, list(struct_pack(s := e.s, e := e.e, r := p.pseudonym) ORDER BY e.s DESC, e.e, e.wid) AS l
  FROM ents e JOIN ps p ON p.text = e.text AND p.entity_type = e.entity_type GROUP BY e.doc_id)"""]))
def q_stream_pseudonyms(spark, sf_dir):
    """Customer forms as a stream, redacted with names that hold over the whole stream."""
    from redactflow.streaming.stream import run_pseudonyms
    path = _fresh_dir(spark, "stream_pseudonyms")
    forms = TB.customer_forms(spark, sf_dir)
    forms.write.parquet(f"{path}/in")
    docs, _ = run_pseudonyms(spark.readStream.schema(forms.schema).parquet(f"{path}/in"), path, f"{path}/checkpoint")
    return docs.select("doc_id", "redacted_text")


_EVENT_TEXT_SQL = f"SELECT event_id AS doc_id, 'user ' || {TB._pad_sql('user_id', 8)} || ' ' || event_type AS text FROM events"


@register("stream_entity_counts", _with(_EVENT_TEXT_SQL, """SELECT strftime(time_bucket(INTERVAL 1 HOUR, v.ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  e.entity_type, count(*) AS n FROM ents e JOIN events v ON v.event_id = e.doc_id GROUP BY 1, 2"""))
def q_stream_entity_counts(spark, sf_dir):
    from redactflow.streaming.stream import run_updates, stream_entity_counts
    ev = _stream_of(spark, sf_dir, "events")
    text = F.concat(F.lit("user "), TB._pad(F.col("user_id"), 8), F.lit(" "), F.col("event_type"))
    path = _fresh_dir(spark, "stream_entity_counts")
    return run_updates(stream_entity_counts(ev, "ts", text), ["w", "entity_type"], f"{path}/out", f"{path}/checkpoint").select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                                    "entity_type", F.col("n").cast("long").alias("n"))


@register("stream_feedback_stats", f"SELECT feedback_type, count(*) AS n FROM ({TB.EVENTS_FEEDBACK_SQL}) GROUP BY feedback_type")
def q_stream_feedback_stats(spark, sf_dir):
    from redactflow.streaming.stream import run_updates, stream_feedback_stats
    ev = _stream_of(spark, sf_dir, "events")
    c = TB._feedback_cols(F.col("user_id"), F.col("event_type"))
    fb = ev.select(c["feedback_type"].alias("feedback_type"))
    path = _fresh_dir(spark, "stream_feedback_stats")
    return run_updates(stream_feedback_stats(fb), ["feedback_type"], f"{path}/out", f"{path}/checkpoint").select("feedback_type", F.col("n").cast("long").alias("n"))


# ---- the exploded plan shape (same entity table, one shuffle of span rows) ---------

@register("entity_table_exploded", _with(O.DOCS_SRC, f"SELECT {ENT_SQL_COLS}, wid AS window_id FROM ents"))
def q_entity_table_exploded(spark, sf_dir):
    from redactflow.plans.exploded import entity_table_exploded
    return entity_table_exploded(TB.documents(spark, sf_dir)).select(
        *_doc_entity_cols([F.col("window_id")]))


# ---- sinks and the text source as round trips through the shared folder ------------

def _fresh_dir(spark: SparkSession, name: str) -> str:
    from redactflow.session import shared_dir
    return shared_dir(spark, _unique(name))


@register("sink_redacted_text", _redacted_sql(O.DOCS_SRC, "full"))
def q_sink_redacted_text(spark, sf_dir):
    """Redacted documents written by ``write_outputs(..., "txt")`` and read back."""
    from redactflow.sources.sinks import write_outputs
    path = _fresh_dir(spark, "sink_redacted_text")
    write_outputs(_scrubbed(spark, sf_dir, "full"), path, "txt")
    return spark.read.parquet(path).select("doc_id", "redacted_text")


@register("sink_metadata_json", _with(O.DOCS_SRC, """SELECT d.doc_id, coalesce(c.n, 0) AS n_redactions,
  coalesce(c.types, '') AS types FROM documents d LEFT JOIN (
    SELECT doc_id, count(*) AS n, string_agg(entity_type, ',' ORDER BY s DESC, e, wid) AS types FROM ents GROUP BY doc_id) c
  ON c.doc_id = d.doc_id"""))
def q_sink_metadata_json(spark, sf_dir):
    """``write_metadata_json`` output read back: redactions per document and
    their types in redaction order (original text left out by default)."""
    from redactflow.sources.sinks import write_outputs
    path = _fresh_dir(spark, "sink_metadata_json")
    write_outputs(_scrubbed(spark, sf_dir, "placeholder"), path, "json")
    schema = ("doc_id long, redacted_text string, export_timestamp string, pseudonym_map map<string,string>, "
              "redaction_metadata array<struct<entity_type:string, replacement:string, "
              "position:struct<start:int,end:int>, confidence:double>>")
    back = spark.read.schema(schema).json(path)
    types = F.transform("redaction_metadata", lambda m: m["entity_type"])
    return back.select("doc_id", F.coalesce(F.size(types), F.lit(0)).cast("long").alias("n_redactions"),
                       F.coalesce(F.array_join(types, ","), F.lit("")).alias("types"))


@register("sink_audit_report", _with(O.DOCS_SRC, """SELECT d.doc_id, coalesce(c.n, 0) AS total_redacted,
  coalesce(c.n, 0) AS audit_entries, CAST(0 AS BIGINT) AS pseudonym_mappings, 'gdpr,hipaa,ccpa,dpdp' AS certifications
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ents GROUP BY doc_id) c ON c.doc_id = d.doc_id"""))
def q_sink_audit_report(spark, sf_dir):
    """``write_audit_report`` output read back: the stats of each report."""
    from redactflow.sources.sinks import write_audit_report
    path = _fresh_dir(spark, "sink_audit_report")
    write_audit_report(_scrubbed(spark, sf_dir, "full"), path, "full")
    schema = ("doc_id long, report_timestamp string, redaction_stats struct<total_redacted:long, audit_entries:long, "
              "pseudonym_mappings:long, generation_time:string>, compliance_certifications array<string>")
    back = spark.read.schema(schema).json(path)
    return back.select("doc_id", F.col("redaction_stats.total_redacted").alias("total_redacted"),
                       F.col("redaction_stats.audit_entries").alias("audit_entries"),
                       F.col("redaction_stats.pseudonym_mappings").alias("pseudonym_mappings"),
                       F.array_join("compliance_certifications", ",").alias("certifications"))


#: Files that a task writes: making a file costs far more than its bytes.
_FILES_PER_TASK = 250


@register("src_text", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[" + O._PY_WS
          + "]+', ' ', 'g'), '[\\x00-\\x08\\x0e-\\x1b]', '', 'g')) AS text FROM documents")
def q_src_text(spark, sf_dir):
    """Documents written as one text file each (folder per doc_id), then read
    back as files: invalid bytes dropped, text normalized."""
    from redactflow.sources.files import read_text_files, write_text_files
    path = _fresh_dir(spark, "src_text")
    # each file ends with a newline, which the normalization trims
    write_text_files(TB.documents(spark, sf_dir), path, "doc_id", _FILES_PER_TASK)
    files = read_text_files(spark, path)
    return files.select(F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("long").alias("doc_id"), "text")


@register("src_csv", """SELECT trim(regexp_replace(CAST(c_custkey AS VARCHAR) || ' ' || c_name || ' ' ||
  CAST(c_nationkey AS VARCHAR) || ' ' || c_mktsegment, '[""" + O._PY_WS + """]+', ' ', 'g')) AS text FROM customer""")
def q_src_csv(spark, sf_dir):
    """``customer`` written as CSV with a header and read back: one document per row."""
    from redactflow.sources.files import read_csv_files
    path = _fresh_dir(spark, "src_csv")
    (TB.load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
     .write.option("header", True).csv(path))
    return read_csv_files(spark, path).select("text")


@register("src_csv_split", """SELECT CAST(doc_id AS VARCHAR) || ' ' || text || ' ' || lang AS text FROM documents""")
def q_src_csv_split(spark, sf_dir):
    """``documents`` written as CSV with a header, texts quoted and over many lines, and read back in splits."""
    from redactflow.sources.csv_split import read_csv_split
    path = _fresh_dir(spark, "src_csv_split")
    (TB.load(spark, sf_dir, "documents").select("doc_id", "text", "lang").write.option("header", True).option("quoteAll", True)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_csv_split(spark, path, normalize=False).select("text")


@register("src_json", """SELECT CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey,
  'c_mktsegment': c_mktsegment}) AS VARCHAR) AS text FROM customer""")
def q_src_json(spark, sf_dir):
    """``customer`` written as JSON files, each one array of at most 100
    records, and read back: one document per record, keys in the file's order."""
    from redactflow.sources.files import read_json_files
    path = _fresh_dir(spark, "src_json")
    cust = TB.load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    arrays = (cust.groupBy(F.floor(F.col("c_custkey") / 100).alias("bucket"))
              .agg(F.to_json(F.collect_list(F.struct(*cust.columns))).alias("value")))
    arrays.repartition("bucket").write.partitionBy("bucket").text(path)
    return read_json_files(spark, path, pattern="*.txt").select("text")


@register("merge_overlaps_rows", REGISTRY["merge_overlaps"][1])
def q_merge_overlaps_rows(spark, sf_dir, src=TB.documents):
    """``merge_overlaps`` computed from the entity table (segmented prefix scans)."""
    from redactflow.operators.report import merge_overlaps_table
    rows = merge_overlaps_table(_doc_entities(src(spark, sf_dir)))
    return rows.select("doc_id", "start_char", "end_char", "n_spans", "entity_type")


# ---- dense and long texts, whole tables of other texts ------------------------------

def _on(name: str, src, src_sql: str) -> None:
    """The overlap query ``name`` over another text table."""
    sql = REGISTRY[name][1].replace(O.DOCS_SRC, src_sql).replace("FROM documents d LEFT JOIN", f"FROM ({src_sql}) d LEFT JOIN")
    fn = globals()[f"q_{name}"]
    register(f"{name}_long_forms", sql)(lambda spark, sf_dir: fn(spark, sf_dir, src))


for _name in ("overlap_pairs", "merge_overlaps", "merge_overlaps_rows", "redact_documents_merged", "greedy_nonoverlap", "annotate_spans",
              "redact_terms", "redact_terms_placeholder", "distinct_terms"):
    _on(_name, TB.long_forms, TB.LONG_FORMS_SQL)
for _mode in ("full", "placeholder", "partial"):
    register(f"redact_long_forms_{_mode}", _redacted_sql(TB.LONG_FORMS_SQL, _mode))(_redacted_query(_mode, TB.long_forms))
register("redact_conversations", _redacted_sql(TB.CONVERSATIONS_SQL, "placeholder"))(_redacted_query("placeholder", TB.conversations))
register("redact_pages_html", _redacted_sql(TB.PAGES_HTML_SQL, "full"))(_redacted_query("full", TB.pages_html))


_TWO_DETECTORS_SQL = f"""SELECT doc_id, s, s + 9 AS e, substring(text, s + 1, 9) AS text,
  CASE WHEN s % 2 = 0 THEN 'MODEL_FLAG' ELSE 'SPACY_PERSON' END AS entity_type,
  CASE WHEN (s // 37) % 5 = 0 THEN 0.90 ELSE 0.97 END AS score, CASE WHEN s % 2 = 0 THEN 12 ELSE 13 END AS rank
FROM (SELECT doc_id, text, unnest(range(doc_id % 37, length(text) - 9, 37)) AS s FROM ({TB.LONG_FORMS_SQL}))"""


@register("union_external_spans_two_detectors", _with(TB.LONG_FORMS_SQL, f"SELECT {ENT_SQL_COLS} FROM ents", external=_TWO_DETECTORS_SQL))
def q_union_external_spans_two_detectors(spark, sf_dir):
    """Spans of two detectors (ranks 12 and 13) at many offsets, over window edges too, some below the threshold."""
    from redactflow.plans.scrub import union_external_spans
    docs = TB.long_forms(spark, sf_dir)
    starts = F.sequence((F.col("doc_id") % 37).cast("int"), F.length("text") - 10, F.lit(37))
    at = docs.select("doc_id", "text", F.explode(starts).alias("s"))
    even = F.col("s") % 2 == 0
    spans = at.select("doc_id", "s", (F.col("s") + 9).alias("e"), F.substring("text", F.col("s") + 1, F.lit(9)).alias("text"),
                      F.when(even, "MODEL_FLAG").otherwise("SPACY_PERSON").alias("entity_type"),
                      F.when(F.floor(F.col("s") / 37) % 5 == 0, 0.90).otherwise(0.97).alias("score"), F.when(even, 12).otherwise(13).alias("rank"))
    return entity_rows(detect(union_external_spans(docs, spans), external_col="external")).select(*_doc_entity_cols())


_CORPUS_NAMES_SQL = """names AS (SELECT text, entity_type, 'USER_' || upper(substring(entity_type, 1, 3))
  || '_' || CAST(row_number() OVER (PARTITION BY upper(substring(entity_type, 1, 3)) ORDER BY fd, fs, text, entity_type) AS VARCHAR) AS pseudonym
  FROM (SELECT text, entity_type, arg_min(doc_id, struct_pack(d := doc_id, q := seq)) AS fd, arg_min(seq, struct_pack(d := doc_id, q := seq)) AS fs
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, e, wid) - 1 AS seq FROM ents) GROUP BY text, entity_type))"""


@register("redact_documents_corpus_pseudonym", _splice_sql(TB.FORMS_SQL, [_CORPUS_NAMES_SQL, """red AS (
  SELECT doc_id, list(struct_pack(s := s, e := e, r := pseudonym) ORDER BY s DESC, e, wid) AS l
  FROM ents JOIN names USING (text, entity_type) GROUP BY doc_id)"""]))
def q_redact_documents_corpus_pseudonym(spark, sf_dir):
    """Forms redacted with one dictionary for the whole corpus: one person, one name in every text."""
    from redactflow.operators.report import with_corpus_pseudonyms
    out = with_corpus_pseudonyms(detect(TB.customer_forms(spark, sf_dir)))
    return out.select("doc_id", R.redact_text(F.col("text"), F.col("entities")).alias("redacted_text"))


# ---- operators on files and tables that were really written ------------------------

#: Customers per file of the round trips: files grow in number, not in size.
_PER_FILE = 1000
_LINES_SQL = f"""SELECT part, CASE WHEN part % 3 = 2 THEN 'PK' || chr(3) || chr(4) ELSE '' END || body || chr(10) AS body FROM (
  SELECT c_custkey // {_PER_FILE} AS part,
    string_agg(c_custkey || ',' || c_name || ',"' || c_mktsegment || chr(10) || c_nationkey || '"', chr(10) ORDER BY c_custkey) AS body
  FROM customer GROUP BY 1)"""


def _customer_files(spark: SparkSession, sf_dir: str, root: str, ext: str) -> str:
    """``customer`` as one CSV-like file per thousand keys (folder ``part=n``); every third file begins like a ZIP."""
    c = TB.load(spark, sf_dir, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.concat(F.lit('"'), "c_mktsegment", F.lit("\n"), F.col("c_nationkey").cast("string"), F.lit('"')))
    parts = (c.groupBy(F.floor(F.col("c_custkey") / _PER_FILE).alias("part")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("rows")))
    head = F.when(F.col("part") % 3 == 2, F.lit("PK\x03\x04")).otherwise(F.lit(""))
    body = F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    path = f"{root}/{ext}"
    parts.select("part", body.alias("value")).repartition("part").write.partitionBy("part").text(path)
    return path




def _part() -> Column:
    return F.regexp_extract(F.col("path"), r"part=(\d+)", 1).cast("long").alias("part")


@register("src_files_written", f"""SELECT part, CAST(strlen(body) AS BIGINT) AS file_size_bytes, '.txt' AS file_format, sha256(body) AS file_hash,
  part % 3 <> 2 AS is_valid, CASE WHEN part % 3 = 2 THEN 'Potential ZIP bomb detected' ELSE 'File validation passed' END AS message FROM ({_LINES_SQL})""")
def q_src_files_written(spark, sf_dir):
    """``file_manifest`` and ``validate_files`` over written files."""
    from redactflow.sources.files import file_manifest, validate_files
    path = _customer_files(spark, sf_dir, _fresh_dir(spark, "src_files_written"), "txt")
    verdicts = validate_files(spark, path).select("path", "is_valid", "message")
    return (file_manifest(spark, path).join(verdicts, "path")
            .select(_part(), "file_size_bytes", "file_format", "file_hash", "is_valid", "message"))


@register("src_format_filter", f"""SELECT part, CASE WHEN part % 3 = 2 THEN 'Potential ZIP bomb detected'
  ELSE 'No decoder for format: .txt' END AS message FROM ({_LINES_SQL})""")
def q_src_format_filter(spark, sf_dir):
    """Files of an accepted format without a decoder are quarantined with the reason, as rejected ones are."""
    from redactflow.sources.files import documents_and_quarantine, ingest_files
    path = _customer_files(spark, sf_dir, _fresh_dir(spark, "src_format_filter"), "txt")
    docs, bad = documents_and_quarantine(ingest_files(spark, path, formats=(".csv", ".json")))
    return bad.select(_part(), "message").unionByName(docs.select(_part(), F.lit("decoded").alias("message")))


@register("process_files", f"""SELECT part, CASE WHEN part % 3 = 2 THEN 'rejected' ELSE 'completed' END AS status,
  CAST(strlen(body) AS BIGINT) AS file_size, sha256(body) AS file_hash, CAST(CASE WHEN part % 3 = 2 THEN 0 ELSE 1 END AS BIGINT) AS documents,
  CAST(CASE WHEN part % 3 = 2 THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS entities_found,
  CAST(CASE WHEN part % 3 = 2 THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS redactions_applied,
  CAST(CASE WHEN part % 3 = 2 THEN 0 ELSE 3 END AS BIGINT) AS n_outputs
FROM ({_LINES_SQL}) f LEFT JOIN (""" + _with(
    f"SELECT part AS doc_id, trim(regexp_replace(regexp_replace(body, '[{O._PY_WS}]+', ' ', 'g'), '[\\x00-\\x08\\x0e-\\x1b]', '', 'g')) AS text FROM ({_LINES_SQL})",
    "SELECT doc_id, count(*) AS n FROM ents GROUP BY doc_id") + ") e ON e.doc_id = f.part")
def q_process_files(spark, sf_dir):
    """The file service from loading to its summary."""
    from redactflow.plans.files import process_files
    root = _fresh_dir(spark, "process_files")
    out = process_files(spark, _customer_files(spark, sf_dir, root, "txt"), f"{root}/out")
    return out.withColumnRenamed("file", "path").select(
        _part(), "status", "file_size", "file_hash", "documents", "entities_found", "redactions_applied", F.size("output_files").cast("long").alias("n_outputs"))


@register("sink_dispatch", _with(TB.FORMS_SQL, """SELECT doc_id, count(*) AS txt_rows, sum(n) AS json_rows, sum(n) AS csv_rows FROM
  (SELECT t.doc_id, coalesce(c.n, 0) AS n FROM (""" + TB.FORMS_SQL + """) t LEFT JOIN (SELECT doc_id, count(*) AS n FROM ents GROUP BY doc_id) c
   ON c.doc_id = t.doc_id) GROUP BY doc_id"""))
def q_sink_dispatch(spark, sf_dir):
    """``write_outputs`` in its three formats, read back: texts, metadata entries and CSV rows per document."""
    from redactflow.sources.sinks import write_outputs
    root = _fresh_dir(spark, "sink_dispatch")
    done = scrub(TB.customer_forms(spark, sf_dir), cfg=ScrubConfig(mode="placeholder"))
    done.write.parquet(f"{root}/scrubbed")
    done = spark.read.parquet(f"{root}/scrubbed")
    for fmt in ("txt", "json", "csv"):
        write_outputs(done, f"{root}/{fmt}", fmt)
    txt = spark.read.parquet(f"{root}/txt").groupBy("doc_id").agg(F.count("*").alias("txt_rows"))
    entries = spark.read.schema("doc_id long, redaction_metadata array<struct<entity_type:string>>").json(f"{root}/json")
    entries = entries.select("doc_id", F.coalesce(F.size("redaction_metadata"), F.lit(0)).cast("long").alias("json_rows"))
    rows = spark.read.option("header", True).csv(f"{root}/csv").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("csv_rows"))
    return txt.join(entries, "doc_id").join(rows, "doc_id", "left").select("doc_id", "txt_rows", "json_rows", F.coalesce("csv_rows", F.lit(0)).alias("csv_rows"))


@register("feedback_store", f"""SELECT feedback_type, domain, user_id, 2 * count(*) AS n FROM ({TB.EVENTS_FEEDBACK_SQL}) GROUP BY ALL""")
def q_feedback_store(spark, sf_dir):
    """Feedback appended to its table in two batches and read back."""
    from redactflow.operators.report import feedback_append
    path = _fresh_dir(spark, "feedback_store")
    records = TB.events_feedback(spark, sf_dir)
    feedback_append(records, path)
    feedback_append(records, path)
    return spark.read.parquet(path).groupBy("feedback_type", "domain", "user_id").agg(F.count("*").alias("n"))


@register("run_report_pseudonym", _with(TB.FORMS_SQL, """SELECT count(*) AS total_redacted, count(*) AS audit_entries,
  count(DISTINCT (doc_id, text, entity_type)) AS pseudonym_mappings, 'gdpr,hipaa,ccpa,dpdp' AS certifications FROM ents"""))
def q_run_report_pseudonym(spark, sf_dir):
    """One report for a run in pseudonym mode, with its real number of mappings."""
    from redactflow.sources.sinks import run_report
    stats, _ = run_report(_scrubbed(spark, sf_dir, "pseudonym", TB.customer_forms, pseudonymize=True), "pseudonym")
    return stats.select("total_redacted", "audit_entries", "pseudonym_mappings", F.array_join("compliance_certifications", ",").alias("certifications"))


@register("run_report_audit_log", _with(TB.FORMS_SQL, f"""SELECT doc_id, {_RED_SEQ} AS seq, entity_type, round(confidence, 4) AS confidence,
  'partial' AS replacement_mode FROM ents"""))
def q_run_report_audit_log(spark, sf_dir):
    from redactflow.sources.sinks import run_report
    _, log = run_report(_scrubbed(spark, sf_dir, "partial", TB.customer_forms), "partial")
    return log.select("doc_id", F.col("seq").cast("long").alias("seq"), "entity_type", r4(F.col("confidence")).alias("confidence"), "replacement_mode")
