"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Documents are counted into cells of source, language and topic (tokens, combined before the shuffle). Each category of a
dimension has a goal: its target share of the KEEP of all tokens, at most what it holds; what a category lacks is spread
over the others of its dimension by their targets. The cells' token weights are then raked to the goals of sources, of
languages and of topics in turn, under the bound that no document is taken more than once (p <= 1): a cell that is full
stays full, and the rest of its category is scaled to what is left of the goal. Sums by category combine before they
move, so no task holds all cells of a language. Each document is taken if a hash of its id falls below the probability
of its cell. Topics are forms that a rule on the text tells (`topic_of`); tokens are words.

`margins` gives the goal and the expected tokens of every category, and tells which targets the tables can't meet.

Defined results: null texts are empty and have no tokens; null source or language is the category ''; categories without
a target share REST, by their tokens; rows that repeat an id are drawn alike; cells without tokens are taken whole (they
cost nothing); an empty table gives an empty table; further columns survive in `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import documents, landed, shielded, text_of

DIMS = ["source", "lang", "topic"]
#: A share of tokens for each category, or the power to which observed shares are tempered.
TARGETS: dict[str, dict[str, float] | float] = {
    "source": 0.5,
    "lang": {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14},
    "topic": {"long-form": 0.45, "article": 0.38, "note": 0.12, "numbers": 0.03, "shouting": 0.02},
}
REST = 0.02
KEEP = 0.7  # of all tokens
ROUNDS = 6  # the margins then miss their goals by less than 1e-4 of the kept tokens on the given tables
SEED = "mix-1"
BROADCAST_CELLS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """The form of a text: many digits, many marks, or by its number of lines."""
    n = F.length(text)
    lines = n - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        F.when(F.regexp_count(text, F.lit("[0-9]")) * 100 >= n, "numbers")
        .when(F.regexp_count(text, F.lit("[!?]")) * 50 >= n, "shouting")
        .when(lines >= 12, "long-form")
        .when(lines >= 3, "article")
        .otherwise("note")
    )


def counted(docs: DataFrame, text_col: str = "text") -> list[Column]:
    """The columns of a document's cell and its tokens, under names that don't clash."""
    text = text_of(text_col)
    return [
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("__lang"),
        topic_of(text).alias("__topic"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("__tokens"),
    ]


def share_of(dim: str, target: dict[str, float] | float, unlisted: float) -> Column:
    """The target share of a category that holds `held` tokens, before those of its dimension are brought to a sum of 1."""
    if not isinstance(target, dict):
        return F.pow("held", F.lit(float(target)))
    listed = F.lit(None).cast("double")
    for name, share in target.items():
        listed = F.when(F.col(dim) == name, F.lit(float(share))).otherwise(listed)
    return F.coalesce(listed, F.lit(REST) * F.col("held") / F.lit(unlisted or 1.0))


def goals(cells: DataFrame, dim: str, target: dict[str, float] | float, budget: float) -> DataFrame:
    """The categories of a dimension: held (tokens), share (of the targets), goal (tokens to take), whole (all of it is to be taken)."""
    held = cells.groupBy(dim).agg(F.sum("n").cast("double").alias("held"))
    listed = list(target) if isinstance(target, dict) else []
    unlisted = held.filter(~F.col(dim).isin(listed)).agg(F.sum("held")).first()[0] or 0.0
    held = landed(held.withColumn("share", share_of(dim, target, unlisted)), "mix-categories")
    factor = budget / (held.agg(F.sum("share")).first()[0] or 1.0)
    while True:  # it only rises, and at each turn but the last a further category is full
        full = F.col("share") * F.lit(factor) > F.col("held")
        got = held.agg(F.sum(F.when(full, F.col("held"))).alias("n"), F.sum(F.when(~full, F.col("share"))).alias("t")).first()
        risen = (budget - (got["n"] or 0.0)) / got["t"] if got["t"] else factor
        if risen <= factor * (1 + 1e-12):
            break
        factor = risen
    most = F.col("share") * F.lit(factor)
    return held.select("*", F.least(most, F.col("held")).alias("goal"), (most >= F.col("held")).alias("whole"))


def fitted(cells: DataFrame, targets: dict = TARGETS, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """cells(source, lang, topic, n) with p: the expected tokens of each category meet its goal, and no p exceeds 1.

    p is least(1, u), u a product of factors of categories; in turn each category gets the factor that brings its expected
    tokens to its goal (a Newton step over the cells below 1)."""
    budget = keep * float(cells.agg(F.sum("n")).first()[0] or 0)
    out, whole = cells, F.lit(False)
    for d in DIMS:
        own = goals(cells, d, targets[d], budget).select(d, F.col("goal").alias(f"g_{d}"), F.col("whole").alias(f"w_{d}"))
        out, whole = out.join(own, d), whole | F.col(f"w_{d}")
    n, u = F.col("n").cast("double"), F.col("u")
    out = landed(out.select(*DIMS, "n", *[f"g_{d}" for d in DIMS], F.when(whole, 1e9).otherwise(float(keep)).alias("u")), "mix-start")
    for _ in range(rounds):
        for d in DIMS:
            sums = out.groupBy(d).agg(
                F.sum(F.when(u >= 1, n).otherwise(0.0)).alias("full"), F.sum(F.when(u < 1, n * u).otherwise(0.0)).alias("below")
            )
            goal = F.col(f"g_{d}")
            step = F.when((goal > F.col("full")) & (F.col("below") > 0), (goal - F.col("full")) / F.col("below"))
            step = step.otherwise(F.coalesce(F.try_divide(goal, F.col("full") + F.col("below")), F.lit(0.0)))
            out = landed(out.join(sums, d).withColumn("u", u * step).drop("full", "below"), "mix-step")
    return out.select(*DIMS, "n", F.when(F.col("n") == 0, 1.0).otherwise(F.least(F.lit(1.0), u)).alias("p"))


def margins(cells: DataFrame, targets: dict = TARGETS, keep: float = KEEP) -> DataFrame:
    """For cells with p: dim, category, held, target, goal and expected tokens; short tells that the target can't be met."""
    budget = keep * float(cells.agg(F.sum("n")).first()[0] or 0)
    found = None
    for d in DIMS:
        own = goals(cells, d, targets[d], budget)
        shares = F.lit(budget / (own.agg(F.sum("share")).first()[0] or 1.0)) * F.col("share")
        taken = cells.groupBy(d).agg(F.sum(F.col("n") * F.col("p")).alias("expected"))
        own = own.join(taken, d).select(
            F.lit(d).alias("dim"), F.col(d).alias("category"), "held", shares.alias("target"), "goal", "expected", (shares > F.col("held")).alias("short")
        )
        found = own if found is None else found.unionAll(own)
    return found


def drawn(id_col: Column, seed: str = SEED) -> Column:
    """A number of [0, 1) that only the id and the seed decide."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_probability(docs: DataFrame, targets: dict = TARGETS, keep: float = KEEP, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with __source, __lang, __topic, __tokens, __p and __taken."""
    return with_probability_of_cell(docs.select("*", *counted(docs, text_col)), targets, keep, id_col)


def with_probability_of_cell(own: DataFrame, targets: dict = TARGETS, keep: float = KEEP, id_col: str = "doc_id") -> DataFrame:
    """The same for rows that have been counted already."""
    cells = own.groupBy(*[F.col(f"__{d}").alias(d) for d in DIMS]).agg(F.sum("__tokens").alias("n"))
    cells = landed(fitted(landed(cells, "mix-cells"), targets, keep), "mix-probabilities")
    right = cells.select(*[F.col(d).alias(f"__{d}") for d in DIMS], F.col("p").alias("__p"))
    if cells.count() <= BROADCAST_CELLS:
        right = F.broadcast(right)
    return own.join(right, [f"__{d}" for d in DIMS]).withColumn("__taken", drawn(F.col(id_col)) < F.col("__p"))


@shielded
def mixed(docs: DataFrame, targets: dict = TARGETS, keep: float = KEEP) -> DataFrame:
    """The rows of docs, with their columns, that the sample takes."""
    return with_probability(docs, targets, keep).filter("__taken").select(*docs.columns)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its cell, tokens, probability and whether it is taken."""
    docs = documents(spark, sf_dir)
    found = with_probability_of_cell(landed(docs.select("doc_id", *counted(docs)), "mix-counted"))  # texts are read once
    return found.select(
        F.col("doc_id"),
        *[F.col(f"__{d}").alias(d) for d in DIMS],
        F.col("__tokens").alias("n_tokens"),
        F.round("__p", 6).alias("probability"),
        F.col("__taken").alias("taken"),
    )


def mixing_sql(docs: str = "documents") -> str:
    """The same in DuckDB, rounds written out. Goals are found without a loop: categories in the order in which they fill."""

    def share(d: str) -> str:
        target = TARGETS[d]
        if not isinstance(target, dict):
            return f"pow(held, {float(target)})"
        cases = " ".join(f"WHEN {d} = '{k}' THEN {v}::DOUBLE" for k, v in target.items())
        names = ", ".join(f"'{k}'" for k in target)
        return f"CASE {cases} ELSE {REST}::DOUBLE * held / sum(held) FILTER ({d} NOT IN ({names})) OVER () END"

    lines = "length(t) - length(replace(t, chr(10), ''))"
    budget = f"({KEEP}::DOUBLE * (SELECT sum(n) FROM c)::DOUBLE)"
    ctes = [
        f"""b AS (SELECT *, coalesce(text, '') AS t FROM {docs})""",
        f"""d AS (SELECT * EXCLUDE (source, lang), coalesce(source, '') AS source, coalesce(lang, '') AS lang,
        CASE WHEN (length(t) - length(translate(t, '0123456789', ''))) * 100 >= length(t) THEN 'numbers'
             WHEN (length(t) - length(translate(t, '!?', ''))) * 50 >= length(t) THEN 'shouting'
             WHEN {lines} >= 12 THEN 'long-form' WHEN {lines} >= 3 THEN 'article' ELSE 'note' END AS topic,
        len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM b)""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS n FROM d GROUP BY ALL)",
    ]
    for d in DIMS:
        ctes += [
            f"h_{d} AS (SELECT {d}, sum(n)::DOUBLE AS held FROM c GROUP BY {d})",
            f"s_{d} AS (SELECT *, {share(d)} AS share FROM h_{d})",
            # the factor that holds if exactly the categories before this one are full
            f"o_{d} AS (SELECT *, held / share AS fills, ({budget} - (sum(held) OVER o - held)) / (sum(share) OVER () - (sum(share) OVER o - share)) AS factor"
            f" FROM s_{d} WINDOW o AS (ORDER BY held / share, {d} ROWS UNBOUNDED PRECEDING))",
            f"f_{d} AS (SELECT max(factor) FILTER (factor <= fills) AS f FROM o_{d})",
            f"g_{d} AS (SELECT {d}, least(share * f, held) AS g_{d}, share * f >= held AS w_{d} FROM s_{d}, f_{d})",
        ]
    ctes.append(
        f"u0 AS (SELECT c.*, g_source, g_lang, g_topic, CASE WHEN w_source OR w_lang OR w_topic THEN 1e9::DOUBLE ELSE {KEEP}::DOUBLE END AS u"
        " FROM c JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic))"
    )
    k = 0
    for _ in range(ROUNDS):
        for d in DIMS:
            ctes += [
                f"m{k} AS (SELECT *, sum(CASE WHEN u >= 1 THEN n ELSE 0 END::DOUBLE) OVER (PARTITION BY {d}) AS full_,"
                f" sum(CASE WHEN u < 1 THEN n * u ELSE 0 END) OVER (PARTITION BY {d}) AS below FROM u{k})",
                f"u{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (u, full_, below), u * CASE WHEN g_{d} > full_ AND below > 0 THEN (g_{d} - full_) / below"
                f" ELSE coalesce(g_{d} / nullif(full_ + below, 0), 0) END AS u FROM m{k})",
            ]
            k += 1
    ctes.append(f"p AS (SELECT source, lang, topic, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, u) END AS p FROM u{k})")
    ctes.append(
        "mixed AS (SELECT d.*, p.p, ('0x' || substr(md5('" + SEED + ":' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE"
        " / 4503599627370496.0 < p.p AS taken FROM d JOIN p USING (source, lang, topic))"
    )
    return "WITH " + ",\n".join(ctes)


OP10_SQL = mixing_sql() + "\nSELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability, taken FROM mixed"
