"""Boosted trees by second-order gains over histograms, for binary outcomes.

Each number is cut into at most BINS - 1 quantile bins once; bin 0 holds missing values. A round grows one tree level by
level. For a level each task adds up gradients and hessians by (node, feature, bin) over its rows with whole arrays, so
that at most nodes * features * BINS sums leave a task; Spark adds those of all tasks, and only the sums reach the driver,
which picks the splits. A split's gain is G_l^2/(H_l + l2) + G_r^2/(H_r + l2) - G^2/(H + l2); missing values go to the side
that gains more; a leaf is worth -G/(H + l2) times the rate.

Margins are carried on every REFRESH rounds into a table below the shared folder, so that neither plans nor the work of a
round grow with the number of trees. Log-loss on validation rows is added up in the pass that opens the next round; no
better one for `patience` rounds ends the fit, and the trees behind the best round go.

Defined results: null and NaN are missing; an outcome of one class gives its base rate everywhere; without validation
rows all rounds are run; rows sampled for a tree are drawn by a hash of their number and the round."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.functions.shared import landed

BINS = 256
REFRESH = 16
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class TreesConfig:
    """Settings of a boosted model; leaves limits those of a tree, its best splits come first on each level."""

    rounds: int = 100
    depth: int = 3
    rate: float = 0.05
    l2: float = 1.0
    least_weight: float = 1.0  # hessian on each side of a split
    least_rows: int = 1
    row_share: float = 1.0
    column_share: float = 1.0
    leaves: int | None = None
    patience: int | None = None
    seed: int = 42


@dataclass
class Tree:
    """Nodes as columns; a node without a feature (-1) is a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, missing_left: bool, gain: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.missing_left[node], self.gain[node] = feature, at, missing_left, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for column, empty in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
                column.append(empty)
        return self.left[node], self.right[node]

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row of bins."""
        feature, at, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        missing_left = np.array(self.missing_left)
        node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            own = bins[row, feature[node]]
            to_left = np.where(own == 0, missing_left[node], own <= at[node])
            node = np.where(feature[node] < 0, node, np.where(to_left, left[node], right[node]))
        return node


def draws(rows: np.ndarray, round_no: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row number, another one each round (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (round_no + 1) + seed) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def values(features: list[str]) -> Column:
    """All features of a row as doubles, NaN for missing."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last: quantiles, in one aggregation; at most bins - 2 numbers a feature."""
    shares = F.array(*[F.lit(i / (bins - 1)) for i in range(1, bins - 1)])
    known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features]
    row = df.agg(*[F.percentile_approx(c, shares, 20 * bins).alias(f"f{i}") for i, c in enumerate(known)]).first()
    return [np.unique(np.array(own if own else [], float)) for own in row]


def binned(rows: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of rows of values: 0 for missing, else 1 + how many edges lie below the value."""
    out = np.empty(rows.shape, np.uint8)
    for f, own in enumerate(edges):
        out[:, f] = np.where(np.isnan(rows[:, f]), 0, 1 + np.searchsorted(own, rows[:, f]))
    return out


STATE = "bins binary, y double, valid boolean, row long, margin double"
SUMS = "cell long, g double, h double, n long"


def bins_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def margins(batch: pa.RecordBatch, bins: np.ndarray, trees: list[Tree], depth: int) -> np.ndarray:
    out = batch.column("margin").to_numpy().copy()
    for tree in trees:
        out += np.array(tree.value)[tree.nodes(bins, depth)]
    return out


def level_sums(state: DataFrame, trees: list[Tree], tree: Tree, open_nodes: list[int], chosen: list[int], width: int, round_no: int, config: TreesConfig) -> dict[int, tuple[float, float, int]]:
    """cell -> (gradients, hessians, rows) of a level: cell = (place in open_nodes * width + feature) * BINS + bin.

    Cell -1 has the log-loss and number of validation rows, when the level is a tree's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(open_nodes) * width * BINS))
        loss = np.zeros(2)
        place = np.full(len(tree.feature), -1)
        place[open_nodes] = np.arange(len(open_nodes))
        for batch in batches:
            if not len(batch):
                continue
            bins = bins_of(batch.column("bins"), width)
            p = 1 / (1 + np.exp(-margins(batch, bins, trees, config.depth)))
            y = batch.column("y").to_numpy()
            valid = batch.column("valid").to_numpy(zero_copy_only=False)
            own = np.where(y > 0.5, p, 1 - p)[valid]
            loss += -np.log(np.clip(own, 1e-15, None)).sum(), valid.sum()
            at = place[tree.nodes(bins, config.depth)]
            use = ~valid & (at >= 0)
            if config.row_share < 1:
                use &= draws(batch.column("row").to_numpy(), round_no, config.seed) < config.row_share
            at, bins, g, h = at[use], bins[use], (p - y)[use], (p * (1 - p))[use]
            for f in chosen:
                cell = (at * width + f) * BINS + bins[:, f]
                for k, weights in enumerate((g, h, None)):
                    sums[k] += np.bincount(cell, weights, minlength=sums.shape[1])
        cells = np.flatnonzero(sums[2])
        columns = [np.append(cells, -1), np.append(sums[0][cells], loss[0]), np.append(sums[1][cells], 0.0), np.append(sums[2][cells].astype(np.int64), int(loss[1]))]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["cell", "g", "h", "n"])

    found = state.mapInArrow(run, SUMS).groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    return {c: (g, h, n) for c, g, h, n in zip(*(found[c].to_pylist() for c in ("cell", "g", "h", "n")))}


@dataclass
class Split:
    gain: float = LEAST_GAIN
    feature: int = -1
    at: int = 0
    missing_left: bool = False
    #: (gradients, hessians) left and right
    sides: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))


def best_split(sums: np.ndarray, chosen: list[int], config: TreesConfig) -> Split:
    """sums: (3, features, BINS) of one node."""
    best = Split()
    for f in chosen:
        missing, known = sums[:, f, 0], sums[:, f, 1:]
        total = missing + known.sum(axis=1)
        below = np.cumsum(known, axis=1)
        for missing_left in (False, True):
            left = below + (missing[:, None] if missing_left else 0)
            right = total[:, None] - left
            score = left[0] ** 2 / (left[1] + config.l2) + right[0] ** 2 / (right[1] + config.l2) - total[0] ** 2 / (total[1] + config.l2)
            enough = (np.minimum(left[1], right[1]) >= config.least_weight) & (np.minimum(left[2], right[2]) >= max(1, config.least_rows))
            score = np.where(enough, score, -np.inf)
            at = int(np.argmax(score))
            if score[at] > best.gain * (1 + 1e-12):
                best = Split(float(score[at]), f, at + 1, missing_left, ((left[0][at], left[1][at]), (right[0][at], right[1][at])))
    return best


@dataclass
class NewtonTrees:
    """A fitted model: its base margin, trees and the edges of its bins."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    config: TreesConfig
    losses: list[float]  # on validation rows, before each round

    def probability(self) -> Column:
        """The probability of the outcome, from the columns named as the features."""
        edges, trees, base, depth, width = self.edges, self.trees, self.base, self.config.depth, len(self.features)

        @F.arrow_udf("double")
        def scored(rows: pa.Array) -> pa.Array:
            bins = binned(matrix(rows, width), edges)
            out = np.full(len(bins), base)
            for tree in trees:
                out += np.array(tree.value)[tree.nodes(bins, depth)]
            return pa.array(1 / (1 + np.exp(-out)))

        return scored(values(self.features))

    def importance(self) -> dict[str, float]:
        """The share of all gains that each feature's splits have."""
        gains = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    gains[self.features[f]] += gain
        whole = sum(gains.values()) or 1.0
        return {f: g / whole for f, g in gains.items()}

    def table(self, spark) -> DataFrame:
        """A row for each node: tree, node, feature, threshold (values at or below it go left), sides, value, gain."""
        rows = [
            (t, i, self.features[f] if f >= 0 else None, float(self.edges[f][b - 1]) if f >= 0 and b <= len(self.edges[f]) else None, m if f >= 0 else None,
             le if f >= 0 else None, r if f >= 0 else None, float(v), float(g))
            for t, tree in enumerate(self.trees)
            for i, (f, b, m, le, r, v, g) in enumerate(zip(tree.feature, tree.bin, tree.missing_left, tree.left, tree.right, tree.value, tree.gain))
        ]
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, missing_left boolean, left int, right int, value double, gain double")


def grow(state: DataFrame, trees: list[Tree], width: int, round_no: int, config: TreesConfig) -> tuple[Tree, tuple[float, int]]:
    """One more tree, and the log-loss and number of validation rows before it."""
    tree, open_nodes, leaves, loss = Tree(), [0], 1, (0.0, 0)
    chosen = sorted(random.Random(f"{config.seed}-{round_no}").sample(range(width), max(1, round(config.column_share * width))))
    for level in range(config.depth):
        cells = level_sums(state, trees, tree, open_nodes, chosen, width, round_no, config)
        if not level:
            loss = cells.get(-1, (0.0, 0.0, 0))[::2]
        cells.pop(-1, None)
        sums = np.zeros((3, len(open_nodes) * width * BINS))
        if cells:
            sums[:, list(cells)] = np.array(list(cells.values()), float).T
        sums = sums.reshape(3, len(open_nodes), width, BINS)
        if not level:
            g, h = sums[0, 0, chosen[0]].sum(), sums[1, 0, chosen[0]].sum()
            tree.value[0] = -config.rate * g / (h + config.l2)
        found = [(best_split(sums[:, i], chosen, config), node) for i, node in enumerate(open_nodes)]
        found = sorted((x for x in found if x[0].feature >= 0), key=lambda x: (-x[0].gain, x[1]))
        if config.leaves:
            found = found[: max(0, config.leaves - leaves)]
        open_nodes = []
        for split, node in found:
            sides = tree.split(node, split.feature, split.at, split.missing_left, split.gain)
            for child, (g, h) in zip(sides, split.sides):
                tree.value[child] = -config.rate * g / (h + config.l2)
            open_nodes += sides
        leaves += len(found)
        if not open_nodes:
            break
    return tree, loss


def with_margins(state: DataFrame, trees: list[Tree], width: int, depth: int) -> DataFrame:
    """The state with the trees' values added to its margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = margins(batch, bins_of(batch.column("bins"), width), trees, depth) if len(batch) else batch.column("margin").to_numpy()
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(out))

    return landed(state.mapInArrow(run, STATE), "margins")


def fitted(
    df: DataFrame, features: list[str], target: str, config: TreesConfig = TreesConfig(), valid: Column | None = None,
    bins: int = BINS, edges: list[list[float]] | None = None,
) -> NewtonTrees:
    """Trees for P(target) from df's features. Rows where valid is true only tell when to stop.

    edges: upper edges of each feature's bins but the last, in place of quantiles."""
    if not features or not 3 <= bins <= BINS:
        raise ValueError("a model needs features, and 3 to 256 bins")
    held = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(False)
    y = F.col(target).cast("double")
    rows = df.filter(y.isNotNull()).select(values(features).alias("x"), y.alias("y"), held.alias("valid"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    if edges is None:
        edges = bin_edges(rows.filter("not valid"), [f"f{i}" for i in range(len(features))], bins)
    elif len(edges) != len(features) or max(map(len, edges)) > BINS - 2:
        raise ValueError("each feature needs its edges, 254 at most")
    edges = [np.unique(np.array(own, float)) for own in edges]
    mean = rows.filter("not valid").agg(F.avg("y")).first()[0] or 0.0
    base = math.log(max(mean, 1e-9) / max(1 - mean, 1e-9))
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = binned(matrix(batch.column(0), width), edges).tobytes()
            own = pa.array([own[i : i + width] for i in range(0, len(own), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([own, *batch.columns[1:], pa.array(np.full(len(batch), base))], names=["bins", "y", "valid", "row", "margin"])

    numbered = rows.select("x", "y", "valid", F.monotonically_increasing_id().alias("row"))
    state = landed(numbered.mapInArrow(run, STATE), "binned")
    trees, losses, since = [], [], 0
    if 0 < mean < 1:
        for round_no in range(config.rounds):
            tree, (loss, n) = grow(state, trees[since:], width, round_no, config)
            losses.append(loss / n if n else math.nan)
            best = int(np.nanargmin(losses)) if n else round_no
            if config.patience and round_no - best >= config.patience:
                del trees[best:]
                break
            trees.append(tree)
            if len(trees) - since == REFRESH and round_no + 1 < config.rounds:
                state, since = with_margins(state, trees[since:], width, config.depth), len(trees)
    return NewtonTrees(features, edges, base, trees, config, losses)
