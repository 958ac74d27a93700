"""Expectation and value models: features, logistic regression and boosted trees, splits, scores, surfaces.

Logistic regression and first-order trees are pyspark.ml's. Trees by second-order gains over histograms, with an L2 penalty
on leaves, missing values of their own and early stopping, are in newton_trees; they take the settings of the models they
stand for, not their exact trees."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchframe.functions.coerce import ratio
from pitchframe.functions.pitch import GOAL_X, WIDTH
from pitchframe.functions.shared import landed
from pitchframe.functions.stats import agreement, binary_scores, calibration, quantile_bin, quantile_edges
from pitchframe.operators.newton_trees import NewtonTrees, TreesConfig
from pitchframe.operators.newton_trees import fitted as newton_fitted
from pitchframe.operators.shots_passes import SHOT_FLAGS, SHOT_LABELS, SHOT_NUMBERS, with_shot_features

RARE = "infrequent"


@dataclass(frozen=True)
class ModelConfig:
    """kind: logistic, trees (first-order) or newton; inverse_penalty is that of a penalty on the summed loss.

    newton has the settings of that kind; valid_share of its training rows, drawn by a hash, tell when to stop."""

    kind: str = "logistic"
    inverse_penalty: float = 0.5
    min_frequency: int = 20
    rounds: int = 100
    depth: int = 3
    rate: float = 0.05
    subsample: float = 0.85
    centre: bool = True
    seed: int = 7
    newton: TreesConfig = field(default_factory=TreesConfig)
    valid_share: float = 0.0


# Settings of the models.
SHOT_MODELS = {"logistic": ModelConfig(), "trees": ModelConfig("trees", rounds=60)}
PASS_MODELS = {"logistic": ModelConfig(inverse_penalty=0.7, min_frequency=30), "trees": ModelConfig("trees", min_frequency=30, rounds=60, depth=4)}
ACTION_MODEL = ModelConfig(inverse_penalty=1.0, centre=False)
SHOT_TREES = {
    "depthwise": TreesConfig(rounds=450, depth=3, rate=0.035, l2=2.0, least_weight=8, row_share=0.85, column_share=0.85),
    "leafwise": TreesConfig(rounds=500, depth=5, rate=0.03, l2=2.0, least_weight=1e-3, least_rows=40, column_share=0.85, leaves=24),
}
PASS_TREES = {
    "depthwise": TreesConfig(rounds=500, depth=4, rate=0.035, l2=2.0, least_weight=10, row_share=0.85, column_share=0.85),
    "leafwise": TreesConfig(rounds=550, depth=6, rate=0.03, l2=2.0, least_weight=1e-3, least_rows=80, column_share=0.85, leaves=31),
}
#: Action models by the number of training rows: below SMALL and from it on.
SMALL = 50_000
ACTION_TREES = {
    "small": TreesConfig(rounds=200, depth=3, rate=0.05, l2=5.0, least_weight=10, row_share=0.8, column_share=0.8),
    "large": TreesConfig(rounds=400, depth=5, rate=0.05, l2=2.0, least_weight=10, row_share=0.85, column_share=0.85),
}


def action_model(kind: str, n_train: int) -> ModelConfig:
    """The estimator of action values by name and by the number of training rows: trees relax where there are few."""
    name = kind.strip().lower()
    if name in ("logistic", "logistic_regression"):
        return ACTION_MODEL
    if name in ("newton", "xgboost", "xgb"):
        return ModelConfig("newton", newton=ACTION_TREES["small" if n_train < SMALL else "large"])
    raise ValueError(f"no model is named {kind!r}")


def shot_model(kind: str, min_frequency: int = 20) -> ModelConfig:
    return _table_model(kind, SHOT_TREES, SHOT_MODELS["logistic"], min_frequency)


def pass_model(kind: str, min_frequency: int = 30) -> ModelConfig:
    return _table_model(kind, PASS_TREES, PASS_MODELS["logistic"], min_frequency)


def _table_model(kind: str, trees: dict[str, TreesConfig], logistic: ModelConfig, min_frequency: int) -> ModelConfig:
    name = {"xgboost": "depthwise", "xgb": "depthwise", "lightgbm": "leafwise", "lgbm": "leafwise"}.get(kind.strip().lower(), kind)
    if name == "logistic":
        return replace(logistic, min_frequency=min_frequency)
    if name not in trees:
        raise ValueError(f"no model is named {kind!r}")
    return ModelConfig("newton", min_frequency=min_frequency, newton=trees[name])


@dataclass
class Trained:
    """A fitted pipeline with the levels that it knows."""

    pipeline: PipelineModel
    numbers: list[str]
    flags: list[str]
    levels: dict[str, list[str]]
    target: str

    def scored(self, df: DataFrame, out: str) -> DataFrame:
        made = self.pipeline.transform(ready(df, self.numbers, self.flags, self.levels))
        return made.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


@dataclass
class TrainedTrees:
    """Newton-boosted trees with the levels that they know. Missing numbers stay missing; a level is a column of 0 and 1."""

    trees: NewtonTrees
    numbers: list[str]
    flags: list[str]
    levels: dict[str, list[str]]
    target: str

    def scored(self, df: DataFrame, out: str) -> DataFrame:
        made = tree_inputs(df, self.numbers, self.flags, self.levels)
        return made.withColumn(out, self.trees.probability()).select(*df.columns, out)


def tree_columns(numbers: list[str], flags: list[str], levels: dict[str, list[str]]) -> list[str]:
    """Names of the inputs of trees."""
    return [f"number_{c}" for c in numbers] + [f"flag_{c}" for c in flags] + [f"label_{c}={v}" for c, own in levels.items() for v in own]


def tree_inputs(df: DataFrame, numbers: list[str], flags: list[str], levels: dict[str, list[str]]) -> DataFrame:
    """df with the feature matrix of trees as columns."""
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("missing"))
    values = [F.col(c).cast("double") for c in [*numbers, *flags]] + [(label(c) == v).cast("double") for c, own in levels.items() for v in own]
    return df.withColumns(dict(zip(tree_columns(numbers, flags, levels), values)))


def trained_trees(df: DataFrame, numbers: list[str], flags: list[str], labels: list[str], target: str, config: ModelConfig) -> TrainedTrees:
    levels = common_levels(df, labels, config.min_frequency)
    data = tree_inputs(df, numbers, flags, levels)
    valid = None
    if config.valid_share:
        drawn = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in df.columns if c != target], F.lit(config.seed)), F.lit(1 << 20)) / float(1 << 20)
        valid = drawn < config.valid_share
    return TrainedTrees(newton_fitted(data, tree_columns(numbers, flags, levels), target, config.newton, valid), numbers, flags, levels, target)


def common_levels(df: DataFrame, labels: list[str], least: int) -> dict[str, list[str]]:
    """The levels of each label with enough rows, all labels in one aggregation; names of levels reach the driver."""
    if not labels:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("v")) for c in labels])).alias("x"))
    found = long.groupBy("x.c", "x.v").count().filter(F.col("count") >= least).collect()
    out: dict[str, list[str]] = {c: [] for c in labels}
    for r in sorted(found, key=lambda r: (r["c"], r["v"])):
        out[r["c"]].append(r["v"])
    return out


def ready(df: DataFrame, numbers: list[str], flags: list[str], levels: dict[str, list[str]]) -> DataFrame:
    """Inputs of the pipeline under names of their own: numbers, flags as 0 and 1, rare and unknown levels as one."""
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("missing"))
    return df.withColumns(
        {f"__n_{c}": F.col(c).cast("double") for c in numbers}
        | {f"__f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in flags}
        | {f"__l_{c}": F.when(label(c).isin(own), label(c)).otherwise(RARE) if own else F.lit(RARE) for c, own in levels.items()}
    )


def trained(df: DataFrame, numbers: list[str], flags: list[str], labels: list[str], target: str, config: ModelConfig, complete: list[str] = []) -> Trained | TrainedTrees:
    """Medians for missing numbers, one column a level, scaling and the estimator, fitted on df; trees of kind newton on the plain values.

    complete: numbers that no row lacks, neither here nor where it is scored (one that does is refused). They get no median:
    sketches of a column from all tasks meet in one."""
    if config.kind == "newton":
        return trained_trees(df, numbers, flags, labels, target, config)
    known = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(c).cast("double")).alias(c) for c in numbers]).first()
    numbers = [c for c in numbers if known[c]]  # a column without any value says nothing
    levels = common_levels(df, labels, config.min_frequency)
    many = [c for c, own in levels.items() if len(own) > 1]
    data = ready(df, numbers, flags, levels).withColumn("__y", F.col(target).cast("double"))
    steps = []
    gaps = [c for c in numbers if c not in complete]
    if gaps:
        steps.append(Imputer(strategy="median", inputCols=[f"__n_{c}" for c in gaps], outputCols=[f"__i_{c}" for c in gaps]))
    if many:
        steps.append(StringIndexer(inputCols=[f"__l_{c}" for c in many], outputCols=[f"__x_{c}" for c in many], handleInvalid="keep", stringOrderType="alphabetAsc"))
        steps.append(OneHotEncoder(inputCols=[f"__x_{c}" for c in many], outputCols=[f"__o_{c}" for c in many], dropLast=False, handleInvalid="keep"))
    if numbers:
        steps.append(VectorAssembler(inputCols=[f"__i_{c}" if c in gaps else f"__n_{c}" for c in numbers], outputCol="__numbers"))
        steps.append(StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=config.centre, withStd=True))
    parts = ["__scaled"] * bool(numbers) + [f"__f_{c}" for c in flags] + [f"__o_{c}" for c in many]
    steps.append(VectorAssembler(inputCols=parts, outputCol="features"))
    if config.kind == "logistic":
        penalty = 1.0 / (config.inverse_penalty * max(1, known["n"]))
        steps.append(LogisticRegression(labelCol="__y", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=200))
    else:
        steps.append(GBTClassifier(labelCol="__y", maxIter=config.rounds, maxDepth=config.depth, stepSize=config.rate, subsamplingRate=config.subsample, seed=config.seed))
    return Trained(Pipeline(stages=steps).fit(data), numbers, flags, levels, target)


def season_split(df: DataFrame, train: list[str], test: list[str], column: str = "season_name") -> DataFrame:
    """split: train, test or unused; an error if one side is empty."""
    season = F.col(column).cast("string")
    out = df.withColumn("split", F.when(season.isin(train), "train").when(season.isin(test), "test").otherwise("unused"))
    found = {r[0] for r in out.select("split").distinct().collect()}
    if not {"train", "test"} <= found:
        raise ValueError("a side of the split is empty")
    return out


def last_matches_split(df: DataFrame, n: int, column: str = "match_id") -> DataFrame:
    """The last n matches by id, one at least, are the test side. The ids that are last are ranked, not all rows."""
    ids = df.select(column).distinct()
    last = ids.orderBy(F.desc(column)).limit(max(1, n)).withColumn("split", F.lit("test"))  # n may grow with the matches: no hint
    return df.join(last, column, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def last_third_split(df: DataFrame, column: str = "match_id") -> DataFrame:
    n = df.select(column).distinct().count()
    return last_matches_split(df, n // 3, column)


def train_and_score(split: DataFrame, numbers: list[str], flags: list[str], labels: list[str], target: str, config: ModelConfig, out: str, only_used: bool = False) -> tuple[Trained, DataFrame]:
    """Fitted on train rows; scores of all rows, or of train and test rows only."""
    model = trained(split.filter("split = 'train'"), numbers, flags, labels, target, config)
    return model, model.scored(split.filter("split <> 'unused'") if only_used else split, out)


def evaluated(scored: DataFrame, target: str, score: str, clip: float | None = None) -> DataFrame:
    """Scores of train and test rows apart."""
    return binary_scores(scored.filter("split <> 'unused'"), target, score, ["split"], clip)


def compared(split: DataFrame, numbers: list[str], flags: list[str], labels: list[str], target: str, configs: dict[str, ModelConfig], out: str, clip: float | None = None) -> tuple[str, dict[str, Trained], DataFrame]:
    """All models with their scores on the test side; the best by log-loss, then Brier score."""
    models, rows = {}, None
    for name, config in configs.items():
        models[name], scored = train_and_score(split, numbers, flags, labels, target, config, out)
        own = evaluated(scored, target, out, clip).withColumn("model", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    best = rows.filter("split = 'test'").orderBy(F.asc_nulls_last("log_loss"), "brier", "model").first()["model"]
    return best, models, rows


def coefficients(model: Trained | TrainedTrees) -> DataFrame:
    """feature, weight of a linear model or importance of a tree model, the largest first."""
    if isinstance(model, TrainedTrees):
        df = SparkSession.active().createDataFrame(list(model.trees.importance().items()), "feature string, weight double")
        return df.orderBy(F.desc("weight"), "feature")
    last = model.pipeline.stages[-1]
    names = [f"number_{c}" for c in model.numbers] + [f"flag_{c}" for c in model.flags]
    weights = (last.coefficients if hasattr(last, "coefficients") else last.featureImportances).toArray()
    many = [c for c, own in model.levels.items() if len(own) > 1]
    if many:
        indexer = next(s for s in model.pipeline.stages if type(s).__name__ == "StringIndexerModel")
        for c, known in zip(many, indexer.labelsArray):
            names += [f"label_{c}={v}" for v in [*known, "unseen"]]
    names += [f"other_{k}" for k in range(len(weights) - len(names))]
    df = SparkSession.active().createDataFrame([(n, float(w)) for n, w in zip(names, weights)], "feature string, weight double")
    return df.orderBy(F.desc(F.abs("weight")), "feature")


def provider_deciles(scored: DataFrame, ours: str, theirs: str, target: str, bins: int = 10) -> DataFrame:
    """Rows, outcome and both estimates in quantile bins of the provider's estimate."""
    both = scored.filter(F.col(ours).isNotNull() & F.col(theirs).isNotNull())
    edges = quantile_edges(both, theirs, bins)
    binned = both.withColumn("bin", quantile_bin(F.col(theirs), edges)).filter("bin is not null")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(target).cast("double")).alias("observed"), F.avg(theirs).alias("provider"), F.avg(ours).alias("model"))


def compared_with_provider(scored: DataFrame, ours: str, theirs: str, by: list[str] = []) -> DataFrame:
    return agreement(scored, ours, theirs, by)


def two_heads(features: DataFrame, labels: DataFrame, keys: list[str], config: ModelConfig = ACTION_MODEL) -> tuple[dict[str, Trained], DataFrame]:
    """Models of scores and concedes on the same features; labels(keys, scores, concedes, split). Returns p_scores, p_concedes."""
    return two_heads_of(features.join(labels.select(*keys, "scores", "concedes", "split"), keys), keys, config)


def two_heads_of(labelled: DataFrame, keys: list[str], config: ModelConfig = ACTION_MODEL) -> tuple[dict[str, Trained], DataFrame]:
    """two_heads where one table has keys, features and labels: nothing wide has to be shuffled for a join. Rows without a key are left out."""
    columns = [c for c in labelled.columns if c not in [*keys, "scores", "concedes", "split"]]
    both = landed(labelled.dropna(subset=keys), "value-features")  # read by every round of both models
    gaps = both.agg(*[F.bool_or(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns]).first()
    complete = [c for c in columns if gaps[c] is False]
    models = {t: trained(both.filter("split = 'train'"), columns, [], [], t, config, complete) for t in ("scores", "concedes")}
    out = both
    for t, model in models.items():
        out = model.scored(out, f"p_{t}")
    return models, out.select(*keys, "split", "scores", "concedes", "p_scores", "p_concedes")


def template_shot(shots: DataFrame) -> DataFrame:
    """One typical shot of open play: medians of numbers, the commonest of flags and labels; fixed where it must be."""
    own = with_shot_features(shots)
    for rule in (~F.col("is_header"), ~F.col("is_set_piece_start"), F.col("start_type") == "pass_reception"):
        some = own.filter(rule)
        own = own if some.isEmpty() else some
    fixed = {c: F.lit(False) for c in ("is_header", "is_set_piece_start", "is_corner_start", "is_free_kick_start", "is_throw_in_start", "is_goal_kick_start", "carry", "one_touch", "quick_pass")}
    fixed |= {"start_type": F.lit("pass_reception"), "team_in_possession_phase_type": F.lit("finish")}
    row = own.agg(*[F.percentile(c, 0.5).alias(c) for c in SHOT_NUMBERS], *[F.mode(c, True).alias(c) for c in [*SHOT_FLAGS, *SHOT_LABELS]])
    return row.withColumns(fixed)


def location_surface(model: Trained, shots: DataFrame, nx: int = 90, ny: int = 70, out: str = "xg") -> DataFrame:
    """The model on a grid of places, all else typical: shot_x, shot_y, and the estimate."""
    at = lambda k, n, a, b: F.lit(float(a)) + F.col(k) * ((b - a) / (n - 1))
    cells = shots.sparkSession.range(nx * ny).select((F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    template = template_shot(shots).drop("shot_x", "shot_y", "distance_covered", "duration")
    grid = cells.join(F.broadcast(template)).withColumns({"shot_x": at("i", nx, 0.0, GOAL_X), "shot_y": at("j", ny, -WIDTH / 2, WIDTH / 2)})  # one row on the right
    grid = grid.withColumns({"possession_start_x": F.col("shot_x"), "possession_start_y": F.col("shot_y"), "distance_covered": F.lit(0.0), "duration": F.lit(0.0)})
    return model.scored(with_shot_features(grid), out).select("shot_x", "shot_y", out)


def spread(scored: DataFrame, score: str) -> DataFrame:
    return scored.agg(*[f(score).alias(n) for n, f in (("least", F.min), ("mean", F.avg), ("deviation", F.stddev_samp), ("most", F.max))], F.count(score).alias("n"))

