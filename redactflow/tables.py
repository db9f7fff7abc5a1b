"""Loading the input tables and deriving the text tables queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.plans.joins import spread, spread_rows

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, *extra), spread over the cores when it arrives in few splits."""
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text", *extra), "doc_id")


def pages_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text"))


def _cap(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, (1 << 31) - 1)))


def _pad(c: Column, n: int) -> Column:
    """Zeros in front up to ``n`` places; a longer number keeps all its digits."""
    digits = c.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), n - F.length(digits))), digits)


def customer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One form-like text per customer, built from its keys, holding a name at
    the start, labelled name, registration number, SSN-shaped, Aadhaar-shaped,
    phone, card, IP-shaped, e-mail and profile links (see ``FORMS_SQL``)."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    c = spread_rows(c, "c_custkey")  # keys are dealt, not the texts made of them
    ck, nk, seg = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    handle = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-")))
    text = F.concat(
        _cap(seg), F.lit(" Holder wrote: Name: "), _cap(seg), F.lit(" Holder. Reg No: RX-"), _pad(ck, 8),
        F.lit(". SSN "), _pad((ck * 7) % 1000, 3), F.lit("-"), _pad(ck % 100, 2), F.lit("-"),
        _pad((ck * 13) % 10000, 4),
        F.lit(". Aadhaar "), _pad((ck * 37) % 10000, 4), F.lit(" "), _pad((ck * 41) % 10000, 4), F.lit(" "),
        _pad((ck * 43) % 10000, 4),
        F.lit(". Call +1 ("), _pad(nk + 200, 3), F.lit(") 555-"), _pad(ck % 10000, 4),
        F.lit(". Card 4"), _pad(ck, 15),
        F.lit(". IP "), nk.cast("string"), F.lit("."), (ck % 256).cast("string"), F.lit("."),
        ((ck * 7) % 256).cast("string"), F.lit("."), ((ck * 11) % 300).cast("string"),
        F.lit(". Mail "), F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"),
        F.lit(". Profile https://github.com/"), handle, F.lit(" and linkedin.com/in/"), handle,
        F.lit(" or twitter.com/"), handle, F.lit("'s page."),
    )
    return c.select(ck.alias("doc_id"), text.alias("text"))


def _cap_sql(c: str) -> str:
    return f"(upper(substring({c}, 1, 1)) || lower(substring({c}, 2)))"


def _pad_sql(c: str, n: int) -> str:
    return f"(repeat('0', greatest(0, {n} - length(CAST({c} AS VARCHAR)))) || CAST({c} AS VARCHAR))"


_H = "lower(replace(c_name, '#', '-'))"
FORMS_SQL = (
    "SELECT c_custkey AS doc_id, " + " || ".join([
        _cap_sql("c_mktsegment"), "' Holder wrote: Name: '", _cap_sql("c_mktsegment"), "' Holder. Reg No: RX-'",
        _pad_sql("c_custkey", 8), "'. SSN '", _pad_sql("(c_custkey * 7) % 1000", 3), "'-'",
        _pad_sql("c_custkey % 100", 2), "'-'", _pad_sql("(c_custkey * 13) % 10000", 4),
        "'. Aadhaar '", _pad_sql("(c_custkey * 37) % 10000", 4), "' '", _pad_sql("(c_custkey * 41) % 10000", 4),
        "' '", _pad_sql("(c_custkey * 43) % 10000", 4),
        "'. Call +1 ('", _pad_sql("c_nationkey + 200", 3), "') 555-'", _pad_sql("c_custkey % 10000", 4),
        "'. Card 4'", _pad_sql("c_custkey", 15),
        "'. IP '", "CAST(c_nationkey AS VARCHAR)", "'.'", "CAST(c_custkey % 256 AS VARCHAR)", "'.'",
        "CAST((c_custkey * 7) % 256 AS VARCHAR)", "'.'", "CAST((c_custkey * 11) % 300 AS VARCHAR)",
        "'. Mail '", "lower(replace(c_name, '#', '.'))", "'@example.com'",
        "'. Profile https://github.com/'", _H, "' and linkedin.com/in/'", _H, "' or twitter.com/'", _H,
        "'''s page.'",
    ]) + " AS text FROM customer"
)


def long_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer form three times over with uneven filling (so spans lie at
    many offsets and over window edges), e-mails and handles inside links
    (overlapping spans), and accented letters next to digits (``LONG_FORMS_SQL``)."""
    k = F.col("doc_id")
    link = lambda d: F.concat(F.lit(" see https://h.example.org/"), F.lit("u"), (k + d).cast("string"), F.lit("@mail.org "))
    fill = lambda n: F.repeat(F.lit("zz "), (k % n).cast("int"))
    text = F.concat(F.col("text"), link(1), fill(41), F.col("text"), F.lit(" é555-123-4567 and 555-123-4567é, "), link(2), link(3), fill(67),
                    F.col("text"), link(4), F.lit(" https://twitter.com/ann"), k.cast("string"), F.lit("/status@x.org"))
    return customer_forms(spark, sf_dir).select("doc_id", text.alias("text"))


def _link_sql(d: int) -> str:
    return f"' see https://h.example.org/' || 'u' || CAST(doc_id + {d} AS VARCHAR) || '@mail.org '"


LONG_FORMS_SQL = (
    f"SELECT doc_id, text || {_link_sql(1)} || repeat('zz ', CAST(doc_id % 41 AS INT)) || text || ' é555-123-4567 and 555-123-4567é, ' || "
    f"{_link_sql(2)} || {_link_sql(3)} || repeat('zz ', CAST(doc_id % 67 AS INT)) || text || {_link_sql(4)} || ' https://twitter.com/ann' || "
    f"CAST(doc_id AS VARCHAR) || '/status@x.org' AS text FROM ({FORMS_SQL})"
)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a document."""
    c = load(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), "text")


CONVERSATIONS_SQL = "SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS doc_id, text FROM conversations"


def pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's whole html as a document."""
    return spread(load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), "doc_id")


PAGES_HTML_SQL = "SELECT page_id AS doc_id, html AS text FROM pages"


def _feedback_cols(user: Column, etype: Column) -> dict[str, Column]:
    kind = (F.when(etype == "click", "missed").when(etype == "error", "over_scrubbed")
            .when(etype.isin("purchase", "view"), "correct").otherwise("other"))
    domain = (F.when(user % 5 == 0, F.lit(None).cast("string")).when(user % 4 == 0, "medical")
              .when(user % 4 == 1, "legal").when(user % 4 == 2, "finance").otherwise("general"))
    return dict(text=F.concat(F.lit("user "), _pad(user, 8), F.lit(" "), etype), entity=_pad(user, 8),
                entity_type=F.lit("REGISTRATION_NUMBER"), feedback_type=kind, domain=domain,
                user_id=F.when(etype == "signup", F.lit(None).cast("string")).otherwise(user.cast("string")))


def events_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback records derived from ``events``: the user's padded id is the
    entity, the event kind maps to a feedback kind (click: missed, error:
    over_scrubbed, purchase/view: correct, else other); some rows leave
    domain or user empty so the defaults apply (``EVENTS_FEEDBACK_SQL``)."""
    from redactflow.operators.report import feedback_records

    ev = load(spark, sf_dir, "events")
    c = _feedback_cols(F.col("user_id"), F.col("event_type"))
    return feedback_records(ev, c["text"], c["entity"], c["entity_type"], c["feedback_type"], c["domain"],
                            c["user_id"], timestamp=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


EVENTS_FEEDBACK_SQL = f"""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
  'user ' || {_pad_sql('user_id', 8)} || ' ' || event_type AS text,
  {_pad_sql('user_id', 8)} AS entity, 'REGISTRATION_NUMBER' AS entity_type,
  CASE WHEN event_type = 'click' THEN 'missed' WHEN event_type = 'error' THEN 'over_scrubbed'
       WHEN event_type IN ('purchase', 'view') THEN 'correct' ELSE 'other' END AS feedback_type,
  coalesce(CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 'medical' WHEN user_id % 4 = 1 THEN 'legal'
                WHEN user_id % 4 = 2 THEN 'finance' ELSE 'general' END, 'general') AS domain,
  coalesce(CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(user_id AS VARCHAR) END, 'system') AS user_id
FROM events"""


def table_text_columns(df: DataFrame, key: str, table: str) -> DataFrame:
    """Every string column of a table as (table, row_key, column, text) rows."""
    cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name != key]
    stacked = df.select(F.col(key).cast("long").alias("row_key"),
                        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text"))
                                           for c in cols])))
    return stacked.select(F.lit(table).alias("table"), "row_key", "column", "text")
