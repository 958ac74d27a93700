"""Toxicity by weak supervision.

1. Lexicon: words and word beginnings of labelled training documents are counted by documents with and without the label,
   and by how many different words go before them in toxic ones (a small bitmap that combines before
   the shuffle): evidence shrinks by how often it only repeats, so that a word of one much-copied document counts little.
   Entries that tell toxic documents apart beyond chance make the lexicon, LEXICON_SIZE at most, the strongest first.
2. Voters: SEEDS and PATTERNS know no labels; the lexicon is dealt by its rates to TIERS voters (8 entries, 8, 16, 32, ...),
   and one more fires if a text holds an entry twice. The labels are one more voter, which abstains
   from all rows without a label.
3. Label model: the votes of every training document are counted by pattern of votes (2 ** 16 at most, by label) and a
   generative model with a latent label is fitted by EM: firing rates of each voter by label, the error rates of the
   labels, and a tree of the strongest correlations given the latent label, so that voters that repeat each other don't count
   twice.
4. Classifier: a logistic regression on lexicon entries, seeds and patterns in a text, fitted on the posterior labels of
   all training documents (combined by equal features first). It scores every document.

Labels are learnt only from rows that `held_out` excludes; labels, lang, source and doc_id are never inputs of a score.
At most about LABEL_ROWS labelled rows (a documented bound, drawn by hash) are learnt from; all else covers all rows.

Defined results: null and empty texts have no features and get the score of the intercept; labels of null count as
none; with few labels, or none, the seeds and patterns decide alone; without rows to learn from every score is 0; rows
that repeat get equal scores; further columns survive in `without_toxic` and are ignored elsewhere.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import documents, in_bitmap, key_bitmap, landed, shielded, text_batches, text_of, tidied

LABEL_ROWS = 200_000
LEXICON_SIZE = 256
STEMS = (4, 5)
SUMS = 50_000
LEAST_GAIN, LEAST_RATIO = 10.0, 4.0  # twice the log-likelihood ratio (chance gives 10 to one word in 600), and of rates
TIERS = 6
#: Rates at which a label is 1 by what a document is, (0, 1): estimated between these, as labels err less than voters do.
LABEL_BOUNDS = np.array([[0.0005, 0.95], [0.002, 0.999]])
THRESHOLD = 0.7
# Common insults of four languages, by what they say of someone.
SEEDS = [
    "idiot idiots idiotic moron morons stupid dumb fool imbecile dumm trottel blödmann idiota estúpido tonto imbécil stupide crétin imbécile",
    "worthless loser losers pathetic useless wertlos versager erbärmlich inútil perdedor patético minable nul",
    "disgusting scum trash garbage filth vermin abschaum dreck ekelhaft asqueroso basura escoria ordure dégoûtant",
    "clown clowns freak liar coward jerk lügner feigling payaso cobarde mentiroso menteur lâche bouffon",
]
PATTERNS = [
    r"[!?]{3,}",  # shouting marks
    r"\b[A-Z]{4,}\b.*\b[A-Z]{4,}\b",  # shouting words
    r"\w[*@#$%]{2,}\w?",  # masked words
    r"(?i)\b(?:you are|you're|du bist|tu es|eres)\b",  # said to someone
]
TWICE = TIERS
FIRST_SEED = TIERS + 1
FIRST_PATTERN = FIRST_SEED + len(SEEDS)
VOTERS = FIRST_PATTERN + len(PATTERNS)


def held_out(id_col: str | Column) -> Column:
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """All of it is of bounded size: lexicon entries, rates of VOTERS voters and of the labels, weights."""

    lexicon: list[str] = field(default_factory=list)  # an entry that ends with * is a beginning of words
    weights: list[float] = field(default_factory=list)
    intercept: float = -math.inf
    prior: float = 0.0
    rates: list[list[float]] = field(default_factory=list)  # of each voter to fire, by label 0 and 1
    label_rates: list[float] = field(default_factory=list)  # of a given label to be 1, by label 0 and 1
    correlations: list[list[float]] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)

    @property
    def n_features(self) -> int:
        return 2 * len(self.lexicon) + len(SEEDS) + len(PATTERNS)


def counted_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to counts by entry: documents with it by label, those that hold it twice, and a bitmap of words before it.

    Sums of a task are given out whenever they hold many entries."""
    split = re.compile(r"[^\W_]+")
    sums: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        columns = [pa.array(list(sums), pa.string()), *[pa.array([v[k] for v in sums.values()], pa.int64()) for k in range(5)]]
        return pa.RecordBatch.from_arrays(columns, names=["entry", "pos", "neg", "pos2", "neg2", "slots"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            own: dict[str, int] = {}  # the slot of the word before its first place; below 0 if there are more places
            before = ""
            for found in split.finditer(text.as_py().lower()):
                word = found.group()
                slot = zlib.crc32(before.encode()) & 63
                for entry in (word, *[f"{word[:n]}*" for n in STEMS if len(word) >= n]):
                    own[entry] = slot if entry not in own else -1 - (own[entry] if own[entry] >= 0 else -1 - own[entry])
                before = word
            for entry, slot in own.items():
                held = sums.setdefault(entry, [0, 0, 0, 0, 0])
                held[0 if toxic else 1] += 1
                held[2 if toxic else 3] += slot < 0
                if toxic:
                    bit = 1 << (slot if slot >= 0 else -1 - slot)
                    held[4] |= bit - (1 << 64) if bit >> 63 else bit
            if len(sums) > SUMS:
                yield out()
                sums.clear()
    if sums:
        yield out()


def mined_lexicon(labelled: DataFrame) -> list[str]:
    """labelled(text, toxic) to the strongest words and word beginnings."""
    totals = labelled.agg(F.count_if("toxic").alias("pos"), F.count_if(~F.col("toxic")).alias("neg")).first()
    if not totals["pos"]:
        return []
    parts = labelled.select("text", "toxic").mapInArrow(tidied(counted_entries), "entry string, pos long, neg long, pos2 long, neg2 long, slots long")
    sums = [F.sum(c).alias(c) for c in ("pos", "neg", "pos2", "neg2")]
    counted = parts.groupBy("entry").agg(*sums, F.bit_count(F.bit_or("slots")).alias("slots"))
    share = totals["pos"] / (totals["pos"] + totals["neg"])
    # different words before it, by the places of the bitmap that are still free
    apart = -64 * F.log(1 - F.least(F.col("slots"), F.lit(63)) / 64)

    def gain(p: str, n: str) -> Column:
        pos, neg = F.col(p).cast("double"), F.col(n).cast("double")
        own = F.when(pos > 0, pos * F.log(pos / ((pos + neg) * share))).otherwise(0.0)
        return 2 * (own + F.when(neg > 0, neg * F.log(neg / ((pos + neg) * (1 - share) + 1e-9))).otherwise(0.0))

    def ratio(p: str, n: str) -> Column:
        return (F.col(p) / totals["pos"]) / ((F.col(n) + 0.5) / max(1, totals["neg"]))

    # an entry tells by being there, or by being there twice, whichever tells more
    levels = [F.when(ratio(p, n) >= LEAST_RATIO, gain(p, n)).otherwise(0.0) for p, n in (("pos", "neg"), ("pos2", "neg2"))]
    fresh = F.least(F.lit(1.0), apart / F.col("pos"))
    strong = counted.filter("pos > 0").select("entry", "pos", "neg", (F.greatest(*levels) * fresh).alias("gain"), ratio("pos", "neg").alias("ratio"))
    strong = strong.filter(F.col("gain") >= LEAST_GAIN)
    best = strong.orderBy(F.col("gain").desc(), "entry").limit(4 * LEXICON_SIZE).collect()
    kept = told_apart([(r["entry"], r["pos"], r["neg"]) for r in best])[:LEXICON_SIZE]
    ratios = {r["entry"]: r["ratio"] for r in best}
    return sorted(kept, key=lambda x: (-ratios[x], x))


def told_apart(entries: list[tuple[str, int, int]]) -> list[str]:
    """entries (with their documents), strongest first, without beginnings and words that a stronger one of the same word tells as well."""
    kept: dict[str, list[tuple[int, int]]] = {}
    out = []
    for entry, pos, neg in entries:
        family = kept.setdefault(entry[: STEMS[0]], [])
        if all(abs(pos - p) > 0.1 * p or abs(neg - n) > 0.1 * n + 1 for p, n in family):
            family.append((pos, neg))
            out.append(entry)
    return out


def features_udf(lexicon: list[str]):
    """The sorted numbers of the lexicon entries that a text holds, of those it holds twice or more, of seeds and patterns."""
    size = len(lexicon)

    @F.pandas_udf("array<int>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        known = [(entry, i) for i, entry in enumerate(lexicon)]
        known += [(word, 2 * size + k) for k, words in enumerate(SEEDS) for word in words.split()]
        for entry, i in known:
            core = entry.rstrip("*")
            finder.add_word(core, (*finder.get(core, ()), (len(core), entry[-1] == "*", i)))
        finder.make_automaton()
        patterns = [re.compile(p) for p in PATTERNS]

        def of(text: str) -> list[int]:
            found = {2 * size + len(SEEDS) + k for k, p in enumerate(patterns) if p.search(text)}
            low = text.lower()
            for end, which in finder.iter(low):
                for length, open_, i in which:
                    start = end - length  # of the character before
                    if start >= 0 and low[start].isalnum():
                        continue
                    if not open_ and end + 1 < len(low) and low[end + 1].isalnum():
                        continue
                    found.add(i + size if i < size and i in found else i)
            return sorted(found)

        yield from tidied(lambda own: (texts.fillna("").map(of) for texts in own))(batches)

    return features


def tier_of(i: Column) -> Column:
    """The tier of the lexicon's i-th entry: 0 for the first 8, 1 for the next 8, then 16, 32, ..."""
    return F.least(F.greatest(F.floor(F.log2(i + 1e-9)) - 2, F.lit(0)), F.lit(TIERS - 1)).cast("int")


def votes(features: Column, size: int) -> Column:
    """A bit for each voter that fires."""
    own = F.filter(features, lambda i: i < size)
    again = F.filter(features, lambda i: (i >= size) & (i < 2 * size))
    fired = F.concat(
        F.transform(own, tier_of),
        F.when(F.size(again) >= 1, F.array(F.lit(TWICE))).otherwise(F.array().cast("array<int>")),
        F.transform(F.filter(features, lambda i: i >= 2 * size), lambda i: i - 2 * size + FIRST_SEED),
    )
    return F.aggregate(F.array_distinct(fired), F.lit(0).cast("long"), lambda so_far, b: so_far + F.pow(F.lit(2.0), b).cast("long"))


def strongest_tree(joint: np.ndarray, of_label: np.ndarray) -> tuple[list[int], np.ndarray]:
    """A tree of the voters that depend most on each other given the label (its parents), and their correlations."""
    n = joint.shape[1]
    gain, correlations = np.zeros((n, n)), np.zeros((n, n))
    for y in (0, 1):
        mass = of_label[y] + 4
        share = of_label[y] / of_label.sum()
        both, one = (joint[y] + 1) / mass, (np.diag(joint[y]) + 2) / mass
        cells = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): 1 - one[:, None] - one[None, :] + both}
        for (a, b), cell in cells.items():
            expected = (one if a else 1 - one)[:, None] * (one if b else 1 - one)[None, :]
            cell = np.maximum(cell, 1e-12)
            gain += share * cell * np.log(cell / expected)
        spread = np.sqrt(one * (1 - one))
        correlations += share * (both - one[:, None] * one[None, :]) / (spread[:, None] * spread[None, :])
    parents, inside = [-1] * n, [0]
    while len(inside) < n:
        i, j = max(((i, j) for i in inside for j in range(n) if j not in inside), key=lambda p: gain[p])
        parents[j] = i
        inside.append(j)
    return parents, correlations


def fitted_label_model(masks: np.ndarray, counts: np.ndarray, voters: int = VOTERS, rounds: int = 25, tree: bool = True, bounds: np.ndarray = LABEL_BOUNDS) -> tuple[np.ndarray, Model]:
    """EM over patterns of votes. counts: rows of each pattern without a label, with label 0, with label 1.

    Returns the posterior of label 1 of each pattern by what its label says (none, 0, 1), and the model."""
    fires = (masks[:, None] >> np.arange(voters) & 1).astype(float)
    strong = fires[:, : min(voters, FIRST_PATTERN)].sum(1) >= 2
    posterior = np.stack([np.where(strong, 0.5, 0.01), np.where(strong, 0.2, 0.01), np.full(len(masks), 0.9)], 1)
    parents, correlations = [-1] * voters, np.zeros((voters, voters))
    for step in range(2 * rounds if tree else rounds):
        mass = np.stack([counts * (1 - posterior), counts * posterior])  # by label, pattern, what is known
        of_label = mass.sum((1, 2))
        prior = (of_label[1] + 0.5) / (of_label.sum() + 1)
        joint = np.stack([(fires * mass[y].sum(1)[:, None]).T @ fires for y in (0, 1)])
        rates = np.stack([(np.diag(joint[y]) + 0.5 * prior) / (of_label[y] + 1) for y in (0, 1)], 1)
        labels = np.array([(mass[y, :, 2].sum() + w) / (mass[y, :, 1:].sum() + 2) for y, w in ((0, 0.1), (1, 1.9))])
        labels = np.clip(labels, *bounds)
        if tree and step == rounds:
            parents, correlations = strongest_tree(joint, of_label)
        log_odds = np.full(len(masks), math.log(prior / (1 - prior)))
        for j in range(voters):
            for y, sign in ((0, -1), (1, 1)):
                p = np.full(len(masks), rates[j, y])
                if parents[j] >= 0:
                    up, on = parents[j], joint[y][parents[j], parents[j]]
                    p1 = (joint[y][j, up] + rates[j, y]) / (on + 1)
                    p0 = (joint[y][j, j] - joint[y][j, up] + rates[j, y]) / (of_label[y] - on + 1)
                    p = np.where(fires[:, up] > 0, p1, p0)
                p = np.clip(p, 1e-6, 1 - 1e-6)
                log_odds += sign * np.where(fires[:, j] > 0, np.log(p), np.log(1 - p))
        said = np.array([0.0, math.log((1 - labels[1]) / (1 - labels[0])), math.log(labels[1] / labels[0])])
        posterior = 1 / (1 + np.exp(-np.clip(log_odds[:, None] + said, -30, 30)))
    return posterior, Model(prior=float(prior), rates=rates.tolist(), label_rates=labels.tolist(), correlations=correlations.tolist(), parents=parents)


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and a row for every row: __id, __mark (a hash of the text), __held, __features. Texts go to Python once."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    text_batches(docs.sparkSession)
    key, text = F.col(id_col).cast("long"), text_of(text_col)
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__label")).filter(
        F.col("__label").isNotNull() & F.col("__id").isNotNull() & ~held_out("__id")
    )
    n = known.count()
    if n > LABEL_ROWS:
        known = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int((1 << 30) * LABEL_ROWS / n))
    known = F.broadcast(known.groupBy("__id").agg(F.max("__label").alias("__label")))  # LABEL_ROWS at most
    own = docs.select(key.alias("__id"), text.alias("text"))
    lexicon = mined_lexicon(own.join(known, "__id").select("text", (F.col("__label") == 1).alias("toxic")))
    size = len(lexicon)
    mark = F.xxhash64(text, F.length(text)).alias("__mark")
    found = docs.select(key.alias("__id"), mark, held_out(key).alias("__held"), features_udf(lexicon)(text).alias("__features"))
    found = landed(found, "toxicity-features")

    learnt = found.filter("not __held").select("__id", "__features", votes(F.col("__features"), size).alias("mask"))
    learnt = learnt.join(known, "__id", "left").select("__features", "mask", F.coalesce(F.col("__label").cast("int") + 1, F.lit(0)).alias("known"))
    same = learnt.groupBy("__features", "mask", "known").agg(F.count(F.lit(1)).alias("n"))
    counted = learnt.groupBy("mask", "known").count().collect()  # 3 * 2 ** VOTERS rows at most
    if not counted:
        return Model(lexicon, weights=[0.0] * (2 * size + len(SEEDS) + len(PATTERNS))), found
    masks = np.array(sorted({r["mask"] for r in counted}), np.int64)
    row = {int(m): i for i, m in enumerate(masks)}
    counts = np.zeros((len(masks), 3))
    for r in counted:
        counts[row[r["mask"]], min(r["known"], 2)] += r["count"]
    posterior, model = fitted_label_model(masks, counts)
    model.lexicon = lexicon

    spark = docs.sparkSession
    soft = [(int(m), k, float(posterior[i, k])) for i, m in enumerate(masks) for k in range(3) if counts[i, k]]
    same = same.join(F.broadcast(spark.createDataFrame(soft, "mask long, known int, posterior double")), ["mask", "known"])
    dense = F.transform(F.sequence(F.lit(0), F.lit(model.n_features - 1)), lambda i: F.array_contains("__features", i).cast("double"))
    sides = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("posterior")).alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("posterior"))).alias("weight")),
        )
    )
    rows = same.select(array_to_vector(dense).alias("x"), sides.alias("side")).select("x", "side.*").filter("weight > 1e-9")
    rows = landed(rows, "toxicity-fit")
    fit = LogisticRegression(featuresCol="x", weightCol="weight", regParam=1e-5, maxIter=60, standardization=False).fit(rows)
    model.weights = [float(w) for w in fit.coefficients.toArray()]
    model.intercept = float(fit.intercept)
    return model, found


def score(features: Column, model: Model) -> Column:
    weights = F.array(*[F.lit(w) for w in model.weights])
    line = F.aggregate(features, F.lit(model.intercept), lambda so_far, i: so_far + F.element_at(weights, i + 1))
    return 1 / (1 + F.exp(-line))


@shielded
def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose score is below THRESHOLD.

    A bitmap of the toxic rows is asked while docs are read again; only rows that it holds are shuffled."""
    model, found = trained(docs, labels, id_col, text_col)
    toxic = found.filter(score(F.col("__features"), model) >= THRESHOLD).select(F.struct("__id", "__mark").alias("__toxic")).distinct()
    toxic = landed(toxic, "toxicity-rows")
    text = text_of(text_col)
    own = docs.withColumn("__mark", F.xxhash64(text, F.length(text)))
    maybe = in_bitmap(key_bitmap(toxic, F.col("__toxic.__mark"), "toxicity-bitmap"), F.col("__mark"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__toxic.__id")) & (F.col("__mark") == F.col("__toxic.__mark"))
    rest = own.filter(maybe).join(toxic.hint("merge"), same, "left_anti")
    return own.filter(~maybe).select(*docs.columns).unionAll(rest.select(*docs.columns))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted."""
    model, found = trained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = found.select(F.col("__id").alias("doc_id"), F.col("__held").alias("held_out"), score(F.col("__features"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
