"""Golden rows from FIXTURES.md (expected values read from the behaviour being matched)."""

from pyspark.sql import functions as F

from redactflow.functions.masks import mask_full, mask_partial
from redactflow.functions.text import context_windows, normalize_text
from redactflow.plans.scrub import ScrubConfig, detect, scrub

SAMPLE = ("To the front desk: Mira Vale moved house. Letters reach mira.vale@post.example, calls reach +1-555-204-7731 "
          "until noon. The form lists SSN 321-54-9876 and a refund to 4012888888881881. "
          "Later, once the papers were sorted and put away for the summer, someone from the next town wrote "
          "that all of it came from host 10.20.30.40 late on Monday.")


def ents_of(spark, docs, text, **cfg):
    row = detect(docs(text), cfg=ScrubConfig(**cfg)).select("entities").first()
    return [(x.entity_type, x.s, x.e, x.text, round(x.confidence, 4)) for x in row.entities]


def test_f1_sample(spark, docs):
    assert ents_of(spark, docs, SAMPLE) == [
        ("EMAIL", 56, 78, "mira.vale@post.example", 1.0),
        ("PHONE", 93, 107, "1-555-204-7731", 1.0),
        ("SSN", 139, 150, "321-54-9876", 1.0),
        ("CREDIT_CARD", 167, 183, "4012888888881881", 1.0),
        ("IP_ADDRESS", 312, 323, "10.20.30.40", 0.98),
    ]


def test_f1_modes(spark, docs):
    d = docs(SAMPLE)
    ph = scrub(d, cfg=ScrubConfig(mode="placeholder")).first()
    assert "calls reach +<PHONE> until noon." in ph.redacted_text
    assert [m.entity_type for m in ph.redaction_metadata] == ["IP_ADDRESS", "CREDIT_CARD", "SSN", "PHONE", "EMAIL"]
    part = scrub(d, cfg=ScrubConfig(mode="partial")).first()
    assert sorted(m.replacement for m in part.redaction_metadata) == sorted(
        ["mi" + "X" * 20, "1-" + "X" * 12, "32" + "X" * 9, "40" + "X" * 14, "10" + "X" * 9])
    full = scrub(d, cfg=ScrubConfig(mode="full")).first()
    assert len(full.redacted_text) == len(SAMPLE)
    assert full.redacted_text.count("█") == 22 + 14 + 11 + 16 + 11


def test_f2_windows(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 400, 401, 450, 500, 900)], "n int")
    out = rows.select("n", context_windows(F.repeat(F.lit("a"), F.col("n"))).alias("w")).collect()
    got = {r.n: [(w.start_char, w.end_char) for w in r.w] for r in out}
    assert got == {0: [], 1: [(0, 1)], 400: [(0, 400)], 401: [(0, 401), (400, 401)],
                   450: [(0, 450), (400, 450)], 500: [(0, 500), (400, 500)],
                   900: [(0, 500), (400, 900), (800, 900)]}


def test_f3_normalize(spark):
    df = spark.createDataFrame([(" a \x00 b\x1cc\xa0d\x0be ",), ("\t\n\r\n",)], "t string")
    assert [r[0] for r in df.select(normalize_text(F.col("t"))).collect()] == ["a  b c d e", ""]


F4 = [
    ("5551234567", [("PHONE", 0, 10)]),
    ("123456789012", [("AADHAAR", 0, 12)]),
    ("12345678", [("REGISTRATION_NUMBER", 0, 8)]),
    ("4111 1111 1111 1111", [("AADHAAR", 0, 14)]),
    ("378282246310005", [("CREDIT_CARD", 0, 15)]),
    ("000-12-3456", []),
    ("192.168.1.300", []),
    ("Name: Jane Doe", [("PERSON_NAME", 6, 14)]),
    ("name - jane doe smith", [("PERSON_NAME", 7, 21)]),
    ("Patient: Health Cloud", []),
    ("reg no: AB-12345", [("REGISTRATION_NUMBER", 8, 16)]),
    ("regulation text", [("REGISTRATION_NUMBER", 3, 10)]),
    ("region", []),
    ("John Smith went", [("PERSON_NAME", 0, 10)]),
    ("Computer Science Dept", []),
    ("see https://github.com/alice-dev now", [("URL", 4, 32)]),
]


def test_f4_rules_and_ties(spark, docs):
    d = docs(*[t for t, _ in F4])
    out = {r.doc_id: [(x.entity_type, x.s, x.e) for x in r.entities]
           for r in detect(d, cfg=ScrubConfig(boost=False)).collect()}
    for i, (_, want) in enumerate(F4):
        assert out[i] == want, F4[i][0]


def test_f4_confidences(spark, docs):
    assert ents_of(spark, docs, "Name: Jane Doe", boost=False)[0][4] == 0.99
    assert ents_of(spark, docs, "John Smith went", boost=False)[0][4] == 0.9


def test_f4_threshold(spark, docs):
    got = ents_of(spark, docs, "John Smith a@b.com 12345678 reg no: AB-12345", threshold=0.985, boost=False)
    assert {g[0] for g in got} == {"PERSON_NAME", "REGISTRATION_NUMBER"}
    assert all(g[4] in (0.99, 0.9) for g in got)


F5 = ("a " * 242) + "john@example.com.org" + " tail tail tail"


def test_f5_window_artefact_and_splice(spark, docs):
    got = ents_of(spark, docs, F5, boost=False)
    assert [(g[1], g[2], g[3]) for g in got] == [(484, 500, "john@example.com"), (484, 504, "john@example.com.org")]
    row = scrub(docs(F5), cfg=ScrubConfig(mode="placeholder")).first()
    assert row.redacted_text.endswith("a a <EMAIL>l tail")
    from redactflow.operators import redact as R
    merged = detect(docs(F5)).select(R.redact_merged(F.col("text"), F.col("entities"), "placeholder")).first()[0]
    assert merged.endswith("a a <EMAIL> tail tail tail")


def test_f5_document_mode(spark, docs):
    got = ents_of(spark, docs, F5, boost=False, window_size=1 << 20, overlap=0)
    assert [(g[1], g[2]) for g in got] == [(484, 504)]


def test_f6_masks(spark):
    df = spark.createDataFrame([("",), ("abcd",), ("abcde",)], "t string")
    out = df.select(mask_full(F.col("t")), mask_partial(F.col("t"))).collect()
    assert [tuple(r) for r in out] == [("████", ""), ("████", "XXXX"), ("█████", "abXXX")]


def test_f6_dispatch_unknown_mode(spark, docs):
    d = docs("mail a@b.co now")
    assert scrub(d, cfg=ScrubConfig(mode="other")).first().redacted_text == "mail ██████ now"
    assert scrub(d, cfg=ScrubConfig(mode="other", pseudonymize=True)).first().redacted_text == "mail USER_EMA_1 now"


def test_f7_pseudonyms(spark):
    from redactflow.operators.redact import with_replacements
    rows = [(0, 6, "a@x.io", "EMAIL"), (10, 17, "Ann Lee", "PERSON_NAME"), (20, 27, "Bob Ray", "SPACY_PERSON"),
            (30, 36, "Cy Fox", "PERSON"), (40, 46, "a@x.io", "EMAIL")]
    arr = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(t).alias("text"),
                             F.lit(ty).alias("entity_type"), F.lit(0).alias("window_id")) for s, e, t, ty in rows])
    got = spark.range(1).select(with_replacements(arr, "pseudonym", True).alias("x")).first().x
    assert {(x.text, x.entity_type): x.replacement for x in got} == {
        ("a@x.io", "EMAIL"): "USER_EMA_1", ("Cy Fox", "PERSON"): "USER_PER_1",
        ("Bob Ray", "SPACY_PERSON"): "USER_SPA_1", ("Ann Lee", "PERSON_NAME"): "USER_PER_2"}


def test_f8_boost(spark):
    from redactflow.operators.boost import boosted_confidence
    pad = "x" * 120
    cases = [(pad + "NUM" + pad, 0.90, 0.90), ("income wage NUM" + pad, 0.90, 0.95),
             ("income hospital NUM", 0.90, 1.0), ("David NUM", 0.98, 1.0),
             ("ssn" + "y" * 98 + "NUM", 0.98, 0.98)]
    df = spark.createDataFrame([(t, c) for t, c, _ in cases], "t string, c double")
    s = F.instr("t", "NUM") - 1
    out = [round(r[0], 4) for r in df.select(boosted_confidence(F.col("c"), F.col("t"), s, s + 3)).collect()]
    assert out == [c for _, _, c in cases]
