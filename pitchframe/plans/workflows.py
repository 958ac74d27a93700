"""Whole runs: from action, shot, pass or tracking tables to fitted models, scored tables, summaries and written artefacts."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.functions.shared import landed
from pitchframe.functions.stats import agreement
from pitchframe.operators import models as M
from pitchframe.operators import physical as Y
from pitchframe.operators import shots_passes as P
from pitchframe.operators import threat as T
from pitchframe.operators import tracking as K
from pitchframe.operators import value_chain as V
from pitchframe.sources import sinks


#: Completion estimates are held this far from 0 and 1 where they are scored.
CLIP = 1e-6


@dataclass
class Run:
    """Fitted objects and result tables by name, figures of tables for the manifest, and what it tells about the run."""

    models: dict[str, object]
    tables: dict[str, DataFrame]
    figures: dict[str, dict[str, Column]] = field(default_factory=dict)
    about: dict = field(default_factory=dict)

    def write(self, path: str, kind: str = "parquet") -> dict[str, int]:
        """All tables below path with a manifest of what they hold; pipelines and surfaces beside them."""
        for name, model in self.models.items():
            if isinstance(model, M.TrainedTrees):
                model.trees.table(next(iter(self.tables.values())).sparkSession).write.mode("overwrite").parquet(f"{path}/models/{name}")
            elif isinstance(model, M.Trained):
                model.pipeline.write().overwrite().save(f"{path}/models/{name}")
            elif isinstance(model, T.Surface):
                sinks.save_surface(next(iter(self.tables.values())).sparkSession, model, f"{path}/models/{name}")
        return sinks.tables(self.tables, path, kind, self.figures, self.about)


def share(known: Column) -> Column:
    """The share of rows for which it is true."""
    return F.avg(F.coalesce(known, F.lit(False)).cast("double"))


def threat_run(actions: DataFrame, columns: int = T.COLUMNS, rows: int = T.ROWS, unsuccessful: str = "nan", least_actions: int = 0, provider: str | None = None) -> Run:
    """Surface, rated actions, metrics, summaries by team and player, and agreement with a provider's value."""
    surface = T.fitted(actions, columns, rows)
    rated = T.rated(actions, surface, unsuccessful)
    kinds = ["pass", "carry", "shot"]
    tables = {
        "rated": rated, "metrics": T.metrics(rated), "teams": T.summary(rated, ["team_shortname"], kinds=kinds),
        "players": T.summary(rated, ["player_id"], least_actions=least_actions, kinds=kinds), "probabilities": T.cell_probabilities(actions, columns, rows),
    }
    if provider:
        tables["agreement"] = agreement(rated, "xT_added", provider, [])
    figures = {f"n_{k}": F.count_if(F.col("action_type") == k) for k in kinds} | {"matches": F.approx_count_distinct("match_id"), "rated_share": share(F.col("xT_added").isNotNull())}
    about = {"grid": [columns, rows], "rounds": surface.rounds, "unsuccessful": unsuccessful, "least_actions": least_actions}
    return Run({"surface": surface}, tables, {"rated": figures}, about)


def shot_run(shots: DataFrame, train: list[str], test: list[str], configs: dict[str, M.ModelConfig] = M.SHOT_MODELS, columns: tuple[list[str], list[str], list[str]] = (P.SHOT_NUMBERS, P.SHOT_FLAGS, P.SHOT_LABELS)) -> Run:
    """Goal expectation: all models compared, the best one's scores, calibration and weights."""
    split = M.season_split(P.with_shot_features(shots), train, test)
    best, models, metrics = M.compared(split, *columns, "goal", configs, "xg")
    scored = models[best].scored(split, "xg")
    return Run({**models, "best": models[best]}, {"scored": scored, "metrics": metrics, "calibration": M.calibration(scored.filter("split = 'test'"), "goal", "xg", 10), "weights": M.coefficients(models[best])})


def pass_run(passes: DataFrame, train: list[str], test: list[str], configs: dict[str, M.ModelConfig] = M.PASS_MODELS, columns: tuple[list[str], list[str], list[str]] = (P.PASS_NUMBERS, P.PASS_FLAGS, P.PASS_LABELS)) -> Run:
    """Completion expectation: compared models, passes above expectation by team and player, types of passes."""
    split = M.season_split(P.with_pass_features(P.modelled_passes(passes)), train, test)
    best, models, metrics = M.compared(split, *columns, "pass_completed", configs, "model_xpass", CLIP)
    scored = P.with_pass_type(P.above_expectation(models[best].scored(split.filter("split <> 'unused'"), "model_xpass")))
    return Run(
        {**models, "best": models[best]},
        {
            "scored": scored, "metrics": metrics, "teams": P.pax_summary(scored, ["team_shortname"]), "players": P.pax_summary(scored, ["player_name"]),
            "types": P.cluster_summary(scored), "weights": M.coefficients(models[best]),
        },
        {"scored": {"model_share": share(F.col("model_xpass").isNotNull()), "completed": F.count_if(F.col("pass_completed")), **provider_coverage(passes)}},
        {"train": train, "test": test, "best": best, "clip": CLIP},
    )


def provider_coverage(passes: DataFrame, column: str = "xpass_completion") -> dict[str, Column]:
    """The share of passes with the provider's own estimate, if its column is there."""
    return {"provider_share": share(F.col(column).isNotNull())} if column in passes.columns else {}


def value_run(actions: DataFrame, tie: list[str], test_matches: int = 8, directory: DataFrame | None = None, config: M.ModelConfig | str = M.ACTION_MODEL, states: int = V.STATES) -> Run:
    """Action values: score and labels, two heads fitted on all but the last matches, values and ratings of players.

    config: a model, or the name of one that is then chosen by the number of training rows."""
    ordered = landed(V.with_labels(V.with_score(actions, tie)), "value-actions")
    split = M.last_matches_split(ordered, test_matches)
    keys = ["match_id", "action_id"]
    if isinstance(config, str):
        config = M.action_model(config, split.filter("split = 'train'").count())
    labelled = M.last_matches_split(V.with_state_features(ordered, states, ["scores", "concedes"]), test_matches)
    models, scored = M.two_heads_of(labelled, keys, config)
    valued = V.with_values(ordered.drop("split", "scores", "concedes", "p_scores", "p_concedes").join(scored, keys))
    metrics = M.evaluated(scored, "scores", "p_scores").withColumn("head", F.lit("scores")).unionByName(M.evaluated(scored, "concedes", "p_concedes").withColumn("head", F.lit("concedes")))
    return Run(dict(models), {"valued": valued, "ratings": V.player_ratings(valued, directory), "metrics": metrics})


def physical_run(frame: DataFrame, lineup: DataFrame | None = None, config: K.TrackingConfig = K.TrackingConfig(), least_minutes: float = 60.0, least_matches: int = 2) -> Run:
    """Player-match rows, qualified rows, profiles with percentiles, and the report of limits."""
    kinematics = K.prepared(frame, config, lineup)
    rows = Y.player_matches(kinematics, config)
    if lineup is not None:
        rows = enriched(rows, lineup)
    qualified = Y.qualified_outfield(rows, least_minutes, least_matches)
    figures = {
        "player_matches": {"players": F.approx_count_distinct("player_id"), "matches": F.approx_count_distinct("match_id"), "bip_minutes": F.sum("bip_minutes")},
        "qualified": {"players": F.approx_count_distinct("player_id")},
    }
    about = {
        "definition": "efforts and distances in live play; p60 rates by minutes in which the ball is in play", "config": asdict(config),
        "speed_thresholds_kmh": {"running": config.running_kmh, "hsr": config.hsr_kmh, "sprint": config.sprint_kmh},
        "eligibility": {"least_minutes": least_minutes, "least_matches": least_matches, "population": "outfield", "coverage_is_a_filter": False},
    }
    tables = {"player_matches": rows, "qualified": qualified, "profiles": Y.group_percentiles(Y.profiles(qualified), Y.PEAKS), "caps": K.cap_report(kinematics)}
    return Run({}, tables, figures, about)


def enriched(rows: DataFrame, lineup: DataFrame) -> DataFrame:
    """Left join of the line-up; columns that both have keep the rows' values, the line-up's get `_lineup`."""
    keys = ["match_id", "player_id"]
    right = lineup.select(*keys, *[F.col(c).alias(f"{c}_lineup" if c in rows.columns else c) for c in lineup.columns if c not in keys])
    return rows.join(right, keys, "left")


def rate_sensitivity(frame: DataFrame, config: K.TrackingConfig = K.TrackingConfig(), native_hz: float = 10.0) -> DataFrame:
    """The same rows at the common rate and at the feed's own."""
    runs = {"common": config, "native": replace(config, target_hz=None, sample_hz=native_hz)}
    parts = [Y.player_matches(K.prepared(frame, c), c).withColumn("rate", F.lit(name)) for name, c in runs.items()]
    return parts[0].unionByName(parts[1])
