"""Pattern index, one-pass terms, versioned tables, prefix scans, linear array passes, plan size."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from redactflow.functions.spans import MARKS, find_spans, free_mark
from redactflow.operators import detect as D
from redactflow.operators import redact as R
from redactflow.operators import report as P
from redactflow.operators.boost import detect_domain_patterns
from redactflow.operators.patterns import required_runs
from redactflow.operators.rules import DEFAULT_RULES
from redactflow.operators.terms import replace_terms, settled_once
from redactflow.plans.scrub import ScrubConfig, detect
from redactflow.plans.versions import read_versions


# ---- pattern index ----------------------------------------------------------------

@pytest.mark.parametrize(("pattern", "runs"), [
    ("abc", ["abc"]), ("ab", []), ("abc|abd", []), ("(abc|x)defg", ["defg"]), ("abc+def", ["abc", "def"]), ("abcd?ef", ["abc"]),
    ("abc{0,2}def", ["def"]), ("abc{2}def", ["abc", "def"]), (r"a\.b\-c", ["a.b-c"]), (r"\bRX-\d+end\b", ["end", "rx-"]),
    ("(?i)GitHub[.]com", ["github.com"]), ("(?iu)task list", [" l"][:0]), ("(?=abc)xyz", ["xyz"]), ("(?<!abc)xyz(?:hello)", ["hello", "xyz"]),
    (r"\Qabc\E", []), ("[abc]def[x-z]ghi", ["def", "ghi"]), ("(?P<n>name)(?:left){0,1}", ["name"]), ("cafés here", ["caf", "s here"]),
    ("(?x) a b c d", []), ("ab(", []), (r"(\w+) \1 tail", [" tail"][0:0] or ["tail"[:0] or " tail"])])
def test_required_runs(pattern, runs):
    assert required_runs(pattern) == sorted(runs)


def test_runs_are_in_every_match():
    r = random.Random(4)
    parts = ["ab", "cde", "c", r"\.", "[xy]", "[z]", "(?:ab|cd)", "(efg)", "(?:hij)?", "k+", "l*", "m{2}", "n{0,1}", ".", r"\d", "(?i:q)", "^", "(?!zz)", "(?=a)"]
    checked = 0
    for _ in range(4000):
        pattern = r.choice(["", "(?i)"]) + "".join(r.choice(parts) for _ in range(r.randint(1, 6)))
        text = "".join(r.choice(["ab", "cde", "efg", "hij", "AB", "k", "mm", "x", "z", "1", ".", "c", "q"]) for _ in range(20))
        for m in re.finditer(pattern, text):
            checked += 1
            assert all(run in m.group().lower() for run in required_runs(pattern)), (pattern, m.group())
    assert checked > 500


def test_index_gives_the_spans_of_the_literal_form(spark, docs):
    r = random.Random(1)
    words = ["alpha", "beta", "Gamma", "delta", "EPSILON", "zeta9", "x.y-z", "#77"]
    table = docs(*[" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(40)], None, "", "é" + MARKS[0] + "alpha 7", "a퟿b alpha 😀beta")
    regexes = [rf"{a}\s+{b}" for a in ("alpha", "beta", "Gamma") for b in ("delta", "zeta\\d", "x[.]y")]
    regexes += ["(?i)GAMMA|nothing", "(?i)epsilon", r"#\d+", "a", r"\d", "(alpha|beta) delta", "never there", "zeta9?"]
    patterns = spark.createDataFrame([(i, "general", f"p{i}", x, 0.1) for i, x in enumerate(regexes)] + [(99, "other", "p0", "alpha", 0.1), (98, "general", "p3", "delta", 0.1)],
                                     "id long, domain string, pattern_name string, pattern_regex string, confidence_boost double")
    want = sorted(map(tuple, detect_domain_patterns(table, patterns, "general").collect()))
    assert len(want) > 500
    for limits in ({"max_patterns": 0}, {"max_patterns": 3, "max_bytes": 300}):
        assert sorted(map(tuple, detect_domain_patterns(table, patterns, "general", **limits).collect())) == want
    assert detect_domain_patterns(table, patterns, "nobody", max_patterns=0).collect() == []


def test_many_patterns_join_no_constant(spark, docs):
    n = 3000
    patterns = spark.range(n).select(F.col("id"), F.lit("general").alias("domain"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("pattern_name"),
                                     F.format_string("key-%05d!", F.col("id")).alias("pattern_regex"), F.lit(0.1).alias("confidence_boost"))
    out = detect_domain_patterns(docs(*[f"some key-{i:05d}! and key-{i + 1:05d}" for i in range(0, n, 100)]), patterns, "general")
    assert out.count() == n // 100
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_alternatives_are_listed_under_a_piece_of_each(spark, docs):
    from redactflow.operators.patterns import literal_index, required_clauses

    assert required_clauses("(?:[#]1207|\\|1207\\|)") == [["#1207", "|1207|"]] and required_clauses("abc|d") == []
    regexes = [f"(?:[#]{k}|\\|{k}\\|)" for k in range(100, 400)] + [f"RX-0*{k:06d}\\." for k in range(400)] + ["ab|cde"]
    patterns = spark.createDataFrame([(i, "general", f"p{i}", x, 0.1) for i, x in enumerate(regexes)], "id long, domain string, pattern_name string, pattern_regex string, confidence_boost double")
    index = literal_index(patterns.select("pattern_name", "pattern_regex"))
    assert [r.pattern_regex for r in index.where("pieces is null").collect()] == ["ab|cde"]
    # no piece of a number's pattern is shared by tens of others
    listed = index.where("pattern_regex like 'RX%'").selectExpr("explode(pieces) as piece").groupBy("piece").count()
    assert listed.agg({"count": "max"}).first()[0] <= 2
    table = docs(*[f"see #{k} and |{k}| or RX-{k:08d}. " for k in range(90, 410, 7)], None)
    want = sorted(map(tuple, detect_domain_patterns(table, patterns, "general", max_patterns=1000).collect()))
    assert len(want) > 100
    for size in (0, 4 << 20):
        assert sorted(map(tuple, detect_domain_patterns(table, patterns, "general", max_bytes=size).collect())) == want


# ---- terms --------------------------------------------------------------------------

def test_terms_equal_replacing_one_by_one():
    r = random.Random(2)
    passes = 0
    for _ in range(3000):
        letters = r.choice(["ab", "abc", "abcdef [", "abX*"])
        terms = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 12))}, key=lambda t: (-len(t), t))
        masks = [r.choice(["*" * len(t), "[X]", "", "[ab]", t[0] + "*" + t[-1]]) if r.random() < 0.3 else r.choice(["*" * len(t), "<M>"]) for t in terms]
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        want = text
        for t, m in zip(terms, masks):
            want = want.replace(t, m)
        assert replace_terms(text, terms, masks) == want
        passes += len(terms) >= 4 and settled_once(terms, masks)
    assert passes > 300


def test_term_pass_is_linear():
    names = [f"person number {i} of all" for i in range(20_000)]
    text = " met ".join(names)
    t0 = time.time()
    out = replace_terms(text, sorted(names, key=lambda t: (-len(t), t)), ["#" * len(t) for t in sorted(names, key=lambda t: (-len(t), t))])
    assert time.time() - t0 < 5 and set(out) == set("# met")


def test_term_pass_in_a_table(spark):
    rows = [(1, "Ann Lee met Ann and Bob.", [("Ann Lee", "X"), ("Ann", "Y")]), (2, None, [("a", "b")]), (3, "kept", None), (4, "kept", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, terms array<struct<term: string, repl: string>>")
    from redactflow.operators.terms import redact_terms_pass
    got = {x.doc_id: x.out for x in redact_terms_pass(df, "text", F.col("terms"), "out").collect()}
    assert got == {1: "X met Y and Bob.", 2: None, 3: "kept", 4: "kept"}


# ---- versions ----------------------------------------------------------------------

def entity_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, seq long, text string, entity_type string")


def test_names_never_change(spark, tmp_path):
    path = str(tmp_path / "names")
    first = entity_rows(spark, [(2, 0, "Bea", "PERSON_NAME"), (1, 0, "Ann", "PERSON"), (1, 1, "a@b.c", "EMAIL"), (3, 0, "Ann", "PERSON")])
    second = entity_rows(spark, [(0, 0, "Zed", "PERSON"), (0, 1, "Ann", "PERSON"), (0, 2, "Ann", "EMAIL"), (5, 0, "Yan", "PERSON_NAME"), (6, 0, "+1", "PHONE")])
    names = lambda df: {(x.text, x.entity_type): x.pseudonym for x in df.collect()}
    one = names(P.store_pseudonyms(first, path, 1, ranges=3))
    assert one == {("Ann", "PERSON"): "USER_PER_1", ("Bea", "PERSON_NAME"): "USER_PER_2", ("a@b.c", "EMAIL"): "USER_EMA_1"}
    two = names(P.store_pseudonyms(second, path, 2, ranges=3))
    assert two == one | {("Zed", "PERSON"): "USER_PER_3", ("Ann", "EMAIL"): "USER_EMA_2", ("Yan", "PERSON_NAME"): "USER_PER_4", ("+1", "PHONE"): "USER_PHO_1"}
    assert names(P.store_pseudonyms(second, path, 2, ranges=3)) == two  # a repeated run
    assert names(P.store_pseudonyms(first.union(second), path, 3)) == two  # nothing new
    assert read_versions(spark, path, P.PSEUDONYM_SCHEMA).count() == len(two)


def test_knowledge_states_merge(spark, tmp_path):
    r = random.Random(3)
    rows = [(0, 0, r.choice("abc"), r.choice(["EMAIL", "PERSON", "PHONE"])) for _ in range(60)] + [(0, 0, "x", "PERSON")] * 3 + [(0, 0, "x", "EMAIL")] * 2
    more = [(0, 0, "x", "EMAIL")] * 4 + [(0, 0, "d", "PERSON")]
    path = str(tmp_path / "knowledge")
    table = lambda df: sorted(map(tuple, df.collect()))
    whole = table(P.knowledge_build(entity_rows(spark, rows + more)))
    P.store_knowledge(entity_rows(spark, rows), path, 1)
    for _ in range(2):  # the second time as if the first run had been cut short
        assert table(P.knowledge_view(P.store_knowledge(entity_rows(spark, more), path, 2))) == whole
    assert ("x", "EMAIL", 9) in whole
    state = P.knowledge_upsert(P.knowledge_state(entity_rows(spark, more)), entity_rows(spark, rows))
    assert table(P.knowledge_view(state)) == whole


# ---- prefix scans -------------------------------------------------------------------

def test_islands_of_one_huge_document(spark):
    r = random.Random(7)
    rows, at = [], 0
    for i in range(4000):
        at += r.choice([0, 1, 2, 30])
        rows.append((1 if i < 3500 else i % 5 + 2, i, at, at + r.choice([1, 3, 25]), r.choice("AB")))
    rows.append((9, 0, 0, 100_000, "L"))
    rows += [(9, i, 10 * i, 10 * i + 3, "S") for i in range(1, 300)]
    ents = spark.createDataFrame(rows, "doc_id long, idx long, start_char long, end_char long, entity_type string")
    want = []
    for d in sorted({x[0] for x in rows}):
        reach = None
        for _, _, s, e, t in sorted(x for x in rows if x[0] == d):
            if reach is None or s >= reach:
                want.append([d, s, e, 1, t])
                reach = e
            else:
                reach = max(reach, e)
                want[-1][2:4] = [reach, want[-1][3] + 1]
    got = P.merge_overlaps_table(ents, ranges=16)
    assert sorted(tuple(x[c] for c in ("doc_id", "start_char", "end_char", "n_spans", "entity_type")) for x in got.collect()) == sorted(map(tuple, want))


# ---- row forms ----------------------------------------------------------------------

SPAN = "array<struct<s:int,e:int,text:string,entity_type:string,confidence:double,source:string,rank:int,window_id:int>>"


def spans_df(spark, lists):
    return spark.createDataFrame([(i, [(*x, 0.9, "rule-based", 1, 0) for x in xs]) for i, xs in enumerate(lists)], f"doc_id long, entities {SPAN}")


def test_folds_match_plain_loops(spark):
    r = random.Random(5)
    lists = [sorted((s := r.randint(0, 300), s + r.randint(1, 30), r.choice("abcd"), r.choice(["URL", "PROFILE_HANDLE", "EMAIL"])) for _ in range(n)) for n in (0, 1, 2, 70, 129, 400)]
    df = spans_df(spark, lists)
    out = df.select("doc_id", R.greedy_nonoverlap(F.col("entities")).alias("g"), D.drop_handles_in_urls(F.col("entities")).alias("h"),
                    R.merge_overlaps(F.col("entities")).alias("m"), R.pseudonym_entries(F.col("entities")).alias("p"),
                    R.with_replacements(F.col("entities"), "pseudonym", True).alias("w")).orderBy("doc_id").collect()
    for xs, row in zip(lists, out):
        greedy, end, islands = [], 0, []
        for x in xs:
            if x[0] >= end:
                greedy.append(x)
                end = x[1]
            if islands and x[0] < islands[-1][1]:
                islands[-1] = (islands[-1][0], max(islands[-1][1], x[1]), islands[-1][2] + 1, islands[-1][3])
            else:
                islands.append((x[0], x[1], 1, x[3]))
        handles = [x for x in xs if not (x[3] == "PROFILE_HANDLE" and any(u[3] == "URL" and u[0] <= x[0] and u[1] >= x[1] for u in xs))]
        cut = lambda v: [tuple(y)[:4] for y in v]
        assert (cut(row.g), cut(row.h), [tuple(y) for y in row.m]) == (greedy, handles, islands)
        names, counts = {}, {}
        for x in sorted(xs, key=lambda x: (-x[0], x[1])):
            if x[2:4] not in names:
                prefix = "USER_" + x[3][:3].upper()
                counts[prefix] = counts.get(prefix, 0) + 1
                names[x[2:4]] = f"{prefix}_{counts[prefix]}"
        assert [((y.k.text, y.k.entity_type), y.n) for y in row.p] == list(names.items())
        assert [y.replacement for y in row.w] == [names[x[2:4]] for x in xs]


def test_many_entities_stay_near_linear(spark):
    def seconds(n):
        xs = [(3 * i, 3 * i + 2, f"t{i}", ("URL", "EMAIL", "PERSON", "PROFILE_HANDLE")[i % 4]) for i in range(n)]
        df = spans_df(spark, [xs]).select(R.with_replacements(F.col("entities"), "pseudonym", True).alias("w"), R.greedy_nonoverlap(F.col("entities")).alias("g"),
                                          D.drop_handles_in_urls(F.col("entities")).alias("h"), R.merge_overlaps(F.col("entities")).alias("m"))
        df.write.format("noop").mode("overwrite").save()
        t0 = time.time()
        df.write.format("noop").mode("overwrite").save()
        return time.time() - t0

    assert seconds(16_000) < 8 * max(seconds(4_000), 0.5)


def test_spans_of_models_by_window(spark):
    r = random.Random(6)
    text = "".join(r.choice("abc def") for _ in range(2300))
    xs = sorted((s := r.randint(0, 2290), min(2300, s + r.choice([1, 5, 60, 450, 900])), "m", "MODEL") for _ in range(400))
    xs += [(0, 500, "m", "MODEL"), (400, 900, "m", "MODEL"), (2000, 2300, "m", "MODEL"), (2299, 2300, "m", "MODEL")]
    df = spans_df(spark, [xs, []]).withColumnRenamed("entities", "external").withColumn("text", F.when(F.col("doc_id") == 0, text))
    got = df.select(D.detect_windows(F.col("text"), [], external=F.col("external"), dedup=False).alias("x")).collect()[0].x
    want = [(s, e, w) for w, at in enumerate(range(0, 2300, 400)) for s, e, *_ in xs if s >= at and e <= min(at + 500, 2300)]
    assert [(y.s, y.e, y.window_id) for y in got] == sorted(want, key=lambda y: y[2]) and len(want) > 200


def test_texts_that_hold_the_marks(spark, docs):
    text = "".join(MARKS) + " mail a@b.org " + "".join(chr(0xE000 + i) for i in range(300)) + " c@d.org"
    df = docs(text, "plain e@f.org", None, MARKS[0] + " g@h.org")
    mails = F.transform(F.filter(F.col("entities"), lambda x: x["entity_type"] == "EMAIL"), lambda x: x["text"])
    assert [x.m for x in detect(df).select(mails.alias("m")).collect()] == [["a@b.org", "c@d.org"], ["e@f.org"], [], ["g@h.org"]]
    free = df.select("text", free_mark(F.substring("text", 1, 500), 500).alias("f")).where("text is not null").collect()
    assert all(x.f and x.f not in x.text[:500] for x in free)
    assert df.select(find_spans(F.col("text"), "[a-z]@").alias("x")).first().x[1].text == "c@"


def test_detection_is_planned_once(spark, docs):
    from redactflow.plans.scrub import scrub
    plan = scrub(docs("x"), cfg=ScrubConfig())._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 65_000
    rare = next(r for r in DEFAULT_RULES if r.entity_type == "EMAIL").java
    assert plan.count(rare) <= 1
