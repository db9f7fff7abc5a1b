"""Language identification by interpolated Kneser-Ney character models.

Every language has a model of character 4-grams over lower-cased letters, any
run of other characters being one blank.  Counts come from all training rows:
each task counts its own n-grams, and the sums are taken per language and n-gram.
Lower orders use continuation counts (in how many contexts an n-gram stands), as
Kneser and Ney have it, with one absolute discount per order.

The models lie in sorted arrays of n-gram hashes, one row of log-probabilities
(a column per language) for each; a table over the leading bits of the hash
says where to look.  A text's language is the one of least cross-entropy per
character.  ``accepted`` is calibrated: the entropy must not exceed what the
language's own training texts (all of them) reach, but for a small share; a language
whose texts are all taken for another has no limit.

The arrays hold at most ``most`` numbers (n-grams times languages).  If there are more, the same model is
computed by aggregations over all of them and written as tables; the arrays then
hold the most frequent 4-grams, and a text's other n-grams are looked up in the
tables by joins, so no count is left out.  Null texts, and texts without a
letter, are ``und`` with score 0; rows without lang teach nothing.  Languages
never gather in a task: a language of a third of all rows is counted where its rows lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.llm.common import STEP_BYTES, held_out, mix, stage, table

ORDER = 4
BLANK = 0x20
_symbols: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """Code point -> 16-bit symbol: a letter's own code (beyond the first plane, a hash into the private range), else a blank."""
    if not _symbols:
        code = np.arange(0x110000)
        own = np.where(code < 0x10000, code, 0xE000 + code % 0x1800)
        letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
        _symbols.append(np.where(letter, own, BLANK).astype(np.uint16))
    return _symbols[0]


def gram_parts(text: str | None, limit: int = STEP_BYTES) -> Iterator[np.ndarray]:
    """The packed 4-grams of a text (16 bits a symbol), one per symbol and one for its end, in
    parts of ``limit`` characters, so memory follows the part.  Each part begins with the last
    three symbols of the one before: the n-grams are the same however the text is cut."""
    low = (text or "").lower()  # as a whole, since the lower case of a letter may depend on its neighbours
    tail = np.full(ORDER - 1, BLANK, np.uint64)
    for at in range(0, len(low) + 1, limit):
        codes = symbols()[np.frombuffer(low[at:at + limit].encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.uint64)
        letter = codes != BLANK
        keep = letter | np.append(tail[-1] != BLANK, letter[:-1])[:len(codes)]  # the first blank after a letter stays
        c = np.concatenate([tail, codes[keep]])
        if at + limit > len(low) and c[-1] != BLANK:
            c = np.append(c, np.uint64(BLANK))
        if len(c) > len(tail):
            yield c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]
        tail = c[-len(tail):]


def ngrams(text: str | None, limit: int = STEP_BYTES) -> np.ndarray:
    """All n-grams of a text; none without a letter."""
    parts = list(gram_parts(text, limit))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of ``docs`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # of this task: lang -> keys, counts and how many

        def out(lang: str) -> pa.RecordBatch:
            key, n = _summed(*held.pop(lang)[:2])
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for b in batches:
            texts: dict[str, list[np.ndarray]] = {}
            sizes: dict[str, int] = {}

            def count(lang: str) -> None:
                key, n = np.unique(np.concatenate(texts.pop(lang)), return_counts=True)
                sizes.pop(lang)
                h = held.setdefault(lang, [[], [], 0])
                h[0].append(key)
                h[1].append(n)
                h[2] += len(key)
                if h[2] > 4_000_000:
                    key, n = _summed(h[0], h[1])
                    held[lang] = [[key], [n], len(key)]

            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for g in gram_parts(text.as_py()):
                    texts.setdefault(lang, []).append(g)
                    sizes[lang] = sizes.get(lang, 0) + len(g)
                    if sizes[lang] > STEP_BYTES:
                        count(lang)
            for lang in list(texts):
                count(lang)
            for lang in [x for x, h in held.items() if h[2] > 2_000_000]:
                yield out(lang)
        for lang in list(held):
            yield out(lang)

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class HashRows:
    """Rows of numbers under sorted 64-bit hashes; ``find`` gives row numbers, -1 for unknown keys."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        hashes = mix(keys)
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order].astype(np.float32)
        self.shift = np.uint64(64 - max(4, min(22, int(len(keys)).bit_length() + 1)))
        top = (self.hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        self.deep = int(np.diff(self.first).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys)
        at = self.first[(h >> self.shift).astype(np.int64)]
        out = np.full(len(h), -1, np.int64)
        if not len(self.hashes):
            return out
        left = np.arange(len(h))
        for k in range(self.deep):
            place = np.minimum(at[left] + k, len(self.hashes) - 1)
            hit = self.hashes[place] == h[left]
            out[left[hit]] = place[hit]
            left = left[~hit & (self.hashes[place] < h[left])]
            if not len(left):
                break
        return out


@dataclass
class ModelTables:
    """The written model: a map lang -> value for each n-gram that the language has."""

    probabilities: list[DataFrame]  # by order, from 1: gram, values (probability of the last symbol)
    weights: list[DataFrame]  # by order, from 2: gram (a context), values (weight of the lower order)
    floor: dict[str, float]  # probability of a symbol that the language doesn't have

    def looked_up(self, grams: DataFrame, langs: list[str]) -> DataFrame:
        """gram, logs (log-probability in each of ``langs``) of distinct 4-grams ``grams``."""
        out = grams
        for order in range(1, ORDER + 1):
            known = self.probabilities[order - 1].select(F.col("gram").alias("_key"), F.col("values").alias(f"_p{order}"))
            out = out.join(known, F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1 if order < ORDER else -1)) == F.col("_key"), "left").drop("_key")
            if order > 1:
                known = self.weights[order - 2].select(F.col("gram").alias("_key"), F.col("values").alias(f"_w{order}"))
                context = F.shiftrightunsigned(F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1 if order < ORDER else -1)), 16)
                out = out.join(known, context == F.col("_key"), "left").drop("_key")

        def log(lang: str) -> Column:
            p = F.coalesce(F.col("_p1")[lang], F.lit(self.floor[lang]))
            for order in range(2, ORDER + 1):
                p = F.coalesce(F.col(f"_p{order}")[lang], F.coalesce(F.col(f"_w{order}")[lang], F.lit(1.0)) * p)
            return F.log(F.greatest(p, F.lit(1e-30)))

        return out.select("gram", F.array(*map(log, langs)).alias("logs"))


@dataclass
class Models:
    langs: list[str]
    grams: list[HashRows]  # by order, from 1: log-probability of the last symbol
    weights: list[HashRows]  # by order, from 2: log-weight of the lower order after a context
    floor: np.ndarray  # log-probability of a symbol no language knows
    limit: np.ndarray | None = None  # entropy up to which a text is accepted
    tables: ModelTables | None = None  # the whole model, if ``grams`` holds only its most frequent 4-grams

    def entropies(self, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Cross-entropy per symbol of each text (rows) in each language (columns); ``starts`` of texts in ``grams``."""
        place = self.grams[-1].find(grams)
        total = np.empty((len(starts), len(self.langs)))
        missing = np.flatnonzero(place < 0)
        lower = self.log_probability(grams[missing], ORDER) if len(missing) else None
        for k in range(len(self.langs)):
            column = self.grams[-1].rows[place, k] if len(self.grams[-1].rows) else np.zeros(len(grams), np.float32)
            if lower is not None:
                column[missing] = lower[:, k]
            total[:, k] = np.add.reduceat(column, starts, dtype=np.float64)
        return -total / np.diff(np.append(starts, len(grams)))[:, None]

    def verdict(self, h: np.ndarray, n: int) -> tuple[str, float, float, bool]:
        """(language, score, entropy, accepted) of a text of ``n`` n-grams from its entropy in each language."""
        best = int(h.argmin())
        # the posterior of the languages, were the text's characters worth a tenth of theirs (they aren't independent)
        evidence = np.exp(-(h - h[best]) * max(1.0, n / 10))
        return self.langs[best], float(1 / evidence.sum()), float(h[best]), bool(self.limit is None or h[best] <= self.limit[best])

    def log_probability(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Of the last symbol after the ``order`` - 1 symbols before it."""
        keys = grams & np.uint64((1 << 16 * order) - 1)
        place = self.grams[order - 1].find(keys)
        known = place >= 0
        out = np.empty((len(keys), len(self.langs)), np.float32)
        out[known] = self.grams[order - 1].rows[place[known]]
        if not known.all():
            if order == 1:
                out[~known] = self.floor
            else:
                after = self.weights[order - 2].find(keys[~known] >> np.uint64(16))
                weight = np.where((after >= 0)[:, None], self.weights[order - 2].rows[after] if len(self.weights[order - 2].rows) else 0, 0)
                out[~known] = weight + self.log_probability(keys[~known], order - 1)
        return out


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from lang -> (sorted packed 4-grams, counts)."""
    langs = sorted(counts)
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[counts[x] for x in langs]]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: contexts that a shorter n-gram follows
        by_order.insert(0, [np.unique(keys & np.uint64((1 << 16 * order) - 1), return_counts=True) for keys, _ in by_order[0]])
    size = max(2, len(np.unique(np.concatenate([k for k, _ in by_order[0]]))) + 1)
    grams, weights = [], []
    below_keys, below = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
    for order in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([k for k, _ in by_order[order - 1]]))
        contexts = np.unique(keys >> np.uint64(16)) if order > 1 else np.zeros(1, np.uint64)
        p, w = np.empty((len(keys), len(langs))), np.ones((len(contexts), len(langs)))
        for k, (own, n) in enumerate(by_order[order - 1]):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = discount_of(ones, twos)
            context = own >> np.uint64(16) if order > 1 else np.zeros(len(own), np.uint64)
            at = np.searchsorted(contexts, context)
            sums, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
            seen = sums > 0
            w[seen, k] = discount * kinds[seen] / sums[seen]
            c = np.zeros(len(keys))
            c[np.searchsorted(keys, own)] = n
            here = np.searchsorted(contexts, keys >> np.uint64(16)) if order > 1 else np.zeros(len(keys), np.int64)
            lower = below[np.searchsorted(below_keys, keys & np.uint64((1 << 16 * (order - 1)) - 1)), k] if order > 1 else 1 / size
            p[:, k] = np.maximum(c - discount, 0) / np.maximum(sums[here], 1) + w[here, k] * lower
        grams.append(HashRows(keys, np.log(np.maximum(p, 1e-30))))
        if order > 1:
            weights.append(HashRows(contexts, np.log(w)))
        else:
            floor = np.log(w[0] / size)
        below_keys, below = keys, p
    return Models(langs, grams, weights, floor)


def discount_of(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))


def kneser_ney_tables(counts: DataFrame, most: int) -> Models:
    """The models of ``kneser_ney`` from all rows of ``counts`` (lang, gram, n), as
    tables; the arrays take the most frequent 4-grams, ``most`` numbers at most."""
    by_order = [counts]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1)).alias("gram")
        by_order.insert(0, stage(by_order[0].select("lang", shorter).groupBy("lang", "gram").agg(F.count("*").alias("n")), f"grams{order}"))
    size = max(2, by_order[0].select("gram").distinct().count() + 1)
    probabilities, weights, floor = [], [], {}
    below = None
    for order, own in enumerate(by_order, 1):
        found = own.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")).alias("ones"), F.sum((F.col("n") == 2).cast("long")).alias("twos"), F.sum("n").alias("sums"), F.count("*").alias("kinds")).collect()
        discounts = {r["lang"]: discount_of(r["ones"], r["twos"]) for r in found}
        less = F.create_map(*(F.lit(x) for pair in discounts.items() for x in pair))[F.col("lang")]
        if order == 1:
            langs = sorted(discounts)
            floor = {r["lang"]: discounts[r["lang"]] * r["kinds"] / r["sums"] / size for r in found}
            by_lang = lambda of: F.create_map(*(F.lit(x) for pair in of.items() for x in pair))[F.col("lang")]
            p = F.greatest(F.col("n") - less, F.lit(0.0)) / by_lang({r["lang"]: r["sums"] for r in found}) + by_lang(floor)
            rows = own.select("lang", "gram", p.alias("p"))
        else:
            context = F.shiftrightunsigned("gram", 16).alias("context")
            contexts = own.select("lang", context, "n").groupBy("lang", "context").agg(F.sum("n").alias("sums"), F.count("*").alias("kinds"))
            contexts = stage(contexts.select("lang", "context", "sums", (less * F.col("kinds") / F.col("sums")).alias("w")), f"contexts{order}")
            weights.append(_by_gram(contexts.select("lang", F.col("context").alias("gram"), F.col("w").alias("p")), f"weights{order}"))
            lower = below.select("lang", F.col("gram").alias("lower"), F.col("p").alias("lower_p"))
            # a language that has an n-gram has its context and its shorter n-gram as well
            rows = own.select("lang", "gram", "n", context, F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)).alias("lower"))
            rows = rows.join(contexts, ["lang", "context"]).join(lower, ["lang", "lower"])
            rows = rows.select("lang", "gram", (F.greatest(F.col("n") - less, F.lit(0.0)) / F.col("sums") + F.col("w") * F.col("lower_p")).alias("p"))
        below = stage(rows, f"probabilities{order}")
        probabilities.append(_by_gram(below, f"by_gram{order}"))
    tables = ModelTables(probabilities, weights, floor)
    sums = stage(counts.groupBy("gram").agg(F.sum("n").alias("n")), "sums")
    least = 1
    while sums.where(F.col("n") >= least).count() > most // len(langs):
        least *= 2
    head = tables.looked_up(sums.where(F.col("n") >= least).select("gram"), langs).toPandas()
    logs = np.array(head["logs"].tolist(), np.float64).reshape(-1, len(langs))
    return Models(langs, [HashRows(head["gram"].to_numpy(np.int64).view(np.uint64), logs)], [], np.log([floor[x] for x in langs]), tables=tables)


def _by_gram(rows: DataFrame, name: str) -> DataFrame:
    return stage(rows.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "p"))).alias("values")), name)


def fit(docs: DataFrame, most: int = 16_000_000, calibration_rows: int | None = None, reject_share: float = 0.001) -> Models | None:
    """Models from all rows of ``docs`` (doc_id, lang, text) with a lang; None if there are none.

    ``most`` bounds the numbers in the arrays, n-grams times languages: 64 MB of them are broadcast
    and two to three times as much is held by the driver while it computes them.
    All these rows set the entropy limit of their language as well; only with ``calibration_rows``
    is it set by about so many rows of each language, chosen by the hash of their id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = stage(ngram_counts(known), "grams")
    shape = counts.agg(F.countDistinct("gram").alias("grams"), F.countDistinct("lang").alias("langs")).first()
    if not shape["grams"]:
        return None
    if shape["grams"] * shape["langs"] > most:
        models = kneser_ney_tables(counts, most)
    else:
        rows = counts.toPandas()
        own = {lang: x.sort_values("gram") for lang, x in rows.assign(gram=rows["gram"].to_numpy().view(np.uint64)).groupby("lang")}
        models = kneser_ney({lang: (x["gram"].to_numpy(), x["n"].to_numpy()) for lang, x in own.items()})
    judged = known if calibration_rows is None else stage(language_sample(known, calibration_rows), "calibration")
    scored = identify(judged.select(F.col("lang").alias("doc_id"), "text"), models)  # a row's language goes along in place of its id
    right = stage(scored.where(F.col("doc_id") == F.col("lang_pred")).select(F.col("lang_pred").alias("lang"), "entropy"), "entropies")
    limits = entropy_limits(right, 1 - reject_share)
    models.limit = np.array([limits.get(lang, np.inf) for lang in models.langs])
    return models


#: Leading bits after the point by which entropies are told apart, step by step.
CELL_BITS = (10, 20, 30, 40)


def entropy_limits(rows: DataFrame, share: float) -> dict[str, float]:
    """lang -> the quantile ``share`` (interpolated) of ``entropy`` over all its ``rows``.

    The two values next to it are found by counting rows in cells of an entropy's leading bits, each step within the
    cells that the step before left, so no task and not the driver holds a language's rows.  At the
    end a cell is 1e-12 wide."""
    places = {}  # (lang, which neighbour) -> rows before it in its cell
    inside: dict[tuple[str, int], int] = {}  # its cell
    value: dict[tuple[str, int], float] = {}
    weight = {}
    for step, bits in enumerate(CELL_BITS):
        cell = F.floor(F.col("entropy") * (1 << bits))
        left = rows
        if step:
            ids = sorted({(lang, c) for (lang, _), c in inside.items()})
            wanted = rows.sparkSession.createDataFrame(ids, "lang string, wide long")
            left = rows.withColumn("wide", F.floor(F.col("entropy") * (1 << CELL_BITS[step - 1]))).join(F.broadcast(wanted), ["lang", "wide"], "left_semi")
        cells: dict[str, list[tuple[int, int, float]]] = {}
        for r in left.groupBy("lang", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.max("entropy").alias("top")).collect():
            cells.setdefault(r["lang"], []).append((r["cell"], r["n"], r["top"]))
        if not step:
            for lang, own in cells.items():
                at = share * (sum(n for _, n, _ in own) - 1)
                weight[lang] = at - int(at)
                places |= {(lang, 0): int(at), (lang, 1): int(np.ceil(at))}
        for key, before in places.items():
            for c, n, top in sorted(cells[key[0]]):
                if step and c >> (bits - CELL_BITS[step - 1]) != inside[key]:
                    continue
                if before < n:
                    places[key], value[key] = before, top
                    break
                before -= n
            inside[key] = c
    return {lang: value[lang, 0] + w * (value[lang, 1] - value[lang, 0]) for lang, w in weight.items()}


def language_sample(known: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows of each language (all of a rarer one), by the hash of doc_id, wherever they lie."""
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return known.select("doc_id", "lang", "text")
    shares = [F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, rows / n) * (1 << 32)))]
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 32))
    return known.select("doc_id", "lang", "text").where(place < F.create_map(*shares)[F.col("lang")])


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """doc_id, lang_pred, score, entropy (null without a letter), accepted of every row of ``docs`` (doc_id, text)."""
    if models is not None and models.tables is not None:
        return _identify_by_tables(docs, models)
    kind = dict(docs.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def score(texts: list[np.ndarray]) -> list[tuple]:
        m = sent.value
        have = [g for g in texts if len(g)]
        starts = np.cumsum([0] + [len(g) for g in have])[:-1]
        h = m.entropies(np.concatenate(have), starts) if have else np.zeros((0, len(m.langs)))
        out, at = [], 0
        for g in texts:
            if not len(g):
                out.append(("und", 0.0, None, False))
                continue
            out.append(m.verdict(h[at], len(g)))
            at += 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            i, rows, held, size = 0, [], [], 0
            for i, text in enumerate(texts):
                if sent.value is None:
                    rows.append(("und", 0.0, None, False))
                    continue
                g = ngrams(text)
                held.append(g)
                size += len(g)
                if size > STEP_BYTES:
                    rows += score(held)
                    held, size = [], 0
            if held:
                rows += score(held)
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "lang_pred", "score", "entropy", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, entropy double, accepted boolean")


def _identify_by_tables(docs: DataFrame, models: Models) -> DataFrame:
    """``identify`` with arrays that hold a part of the model: each task sums what the
    arrays know, and the other n-grams of a text are joined with the tables."""
    kind, langs = dict(docs.dtypes)["doc_id"], models.langs
    sent = docs.sparkSession.sparkContext.broadcast(replace(models, tables=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value

        def out(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n", "logs", "rest", "times"])

        for b in batches:
            rows, first, size = [], 0, 0
            for k, text in enumerate(b.column(1)):
                n, logs, rest, counts = 0, np.zeros(len(m.langs)), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for g in gram_parts(text.as_py()):
                    n += len(g)
                    place = m.grams[-1].find(g)
                    logs += m.grams[-1].rows[place[place >= 0]].sum(0, dtype=np.float64)
                    key, times = np.unique(g[place < 0], return_counts=True)
                    rest.append(key)
                    counts.append(times)
                key, times = _summed(rest, counts)
                rows.append((n, logs, key.view(np.int64), times))
                size += len(key)
                if size > STEP_BYTES:
                    yield out(b.column(0).slice(first, len(rows)), rows)
                    rows, first, size = [], k + 1, 0
            yield out(b.column(0).slice(first, len(rows)), rows)

    read = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, logs array<double>, rest array<long>, times array<long>")
    read = stage(read.withColumn("row", F.monotonically_increasing_id()), "texts")
    pairs = read.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("gram"), F.col("x.times").alias("times"))
    known = models.tables.looked_up(pairs.select("gram").distinct(), langs)
    more = pairs.join(known, "gram").groupBy("row").agg(F.array(*(F.sum(F.col("times") * F.col("logs")[k]) for k in range(len(langs)))).alias("more"))

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            rows = []
            for n, logs, more in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                rows.append(m.verdict(-(np.array(logs) + (0.0 if more is None else np.array(more))) / n, n) if n else ("und", 0.0, None, False))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "lang_pred", "score", "entropy", "accepted"])

    out = read.select("row", "doc_id", "n", "logs").join(more, "row", "left").select("doc_id", "n", "logs", "more")
    return out.mapInArrow(verdicts, f"doc_id {kind}, lang_pred string, score double, entropy double, accepted boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    models = fit(docs.where(~held_out("doc_id")))
    return identify(docs, models).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "entropy", "accepted")
