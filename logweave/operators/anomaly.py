"""Isolation forest (Liu, Ting, Zhou 2008) and anomaly records.

Fitting samples by hash, so the forest depends on the rows and the seed but not on how the rows
are partitioned. A tree sees at most 256 rows, hence the whole forest has at most 511 nodes per
tree; that bound is what allows it to travel with the scoring function.
"""

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.model import FEATURES
from logweave.operators.cooldown import COOLDOWN_SECONDS, cooldown
from logweave.session import materialize

# Model settings and score rules.
TREES = 100
SAMPLE_ROWS = 256
CONTAMINATION = 0.05
SEED = 42
MIN_ROWS = 10
VERSION = "1.0"
FOREST_LIMIT = -0.1
BASELINE = (5.0, 8.0, 3.0, 6.0, 4.0)
SPIKE_SCORE, NO_SPIKE_SCORE = 0.8, 0.1

_NODES = "tree int, node int, feature int, threshold double, left int, right int, path double"


def average_path(n):
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    h = np.log(np.where(big, n - 1, 1)) + np.euler_gamma
    return np.where(big, 2 * h - 2 * (n - 1) / np.where(big, n, 1), out)


@dataclass
class Forest:
    """A fitted forest. ``nodes`` is a pandas table of at most ``trees * (2 * sample - 1)`` rows."""

    nodes: pd.DataFrame
    features: list
    sample_rows: int
    rows: int
    contamination: float = CONTAMINATION
    offset: float = -0.5
    version: str = VERSION
    trained_at: str = None
    arrays: list = field(default=None, repr=False)

    def __post_init__(self):
        by_tree = self.nodes.sort_values(["tree", "node"]).groupby("tree")
        self.arrays = [tuple(g[c].to_numpy() for c in ["feature", "threshold", "left", "right", "path"]) for _, g in by_tree]


def score_rows(trees, sample_rows, x):
    """Minus the anomaly score of each row of a matrix, given the node arrays of every tree."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, threshold, left, right, path in trees:
        at = np.zeros(len(x), dtype=int)
        while (feature[at] >= 0).any():
            f = feature[at]
            low = x[rows, np.maximum(f, 0)] <= threshold[at]
            at = np.where(f >= 0, np.where(low, left[at], right[at]), at)
        total += path[at]
    depth = total / max(len(trees), 1)
    return -np.power(2.0, -depth / max(float(average_path(sample_rows)), 1e-12))


def _grow(x, rng, limit):
    """Nodes of one tree over a small matrix, as rows of ``_NODES`` without the tree number."""
    nodes, todo = [], [(np.arange(len(x)), 0, None)]
    while todo:
        idx, depth, parent = todo.pop()
        number = len(nodes)
        if parent is not None:
            nodes[parent[0]][parent[1]] = number
        part = x[idx]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(idx) <= 1 or not len(usable):
            nodes.append([number, -1, 0.0, -1, -1, depth + float(average_path(len(idx)))])
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        if not cut < high[f]:
            cut = float(low[f])
        nodes.append([number, f, cut, -1, -1, 0.0])
        goes_left = part[:, f] <= cut
        todo.append((idx[~goes_left], depth + 1, (number, 4)))
        todo.append((idx[goes_left], depth + 1, (number, 3)))
    return nodes


def iforest_fit(df, cols=FEATURES, key=("window", "service_name"), trees=TREES, contamination=CONTAMINATION,
                seed=SEED, sample_rows=SAMPLE_ROWS):
    """Fit a forest on the feature rows; ``None`` when there are fewer than ten.

    Each row draws one hash per tree, and a tree takes the rows with its smallest hashes. Only
    hashes that can be among those are kept: four times as many as needed are expected to pass.
    """
    # read three times below: size, sample, quantile
    df = materialize(df.select(*key, *cols), "features")
    rows = df.count()
    if rows < MIN_ROWS:
        return None
    take = min(sample_rows, rows)
    share = min(1.0, 4.0 * take / rows)
    bound = min(-2**63 + int(share * 2**64), 2**63 - 1)
    ident = [F.col(c) for c in key]
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)),
                        lambda t: F.struct(t.alias("tree"), F.xxhash64(*ident, F.lit(seed), t).alias("draw")))
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    drawn = df.select(*key, values.alias("x"), F.inline(F.filter(draws, lambda d: d["draw"] <= bound)))
    smallest = W.partitionBy("tree").orderBy("draw", *key)
    sample = drawn.withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= take)
    limit = math.ceil(math.log2(max(take, 2)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        tree = int(pdf["tree"].iloc[0])
        grown = _grow(np.array(pdf["x"].tolist()), np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([[tree, *n] for n in grown],
                            columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

    # at most trees * (2 * take - 1) rows
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread_out = sample.select("tree", "x", "_n").repartition(width, "tree")
    nodes = spread_out.groupBy("tree").applyInPandas(build, _NODES).toPandas()
    forest = Forest(nodes, list(cols), take, rows, contamination,
                    trained_at=pd.Timestamp.now("UTC").isoformat())
    # rounding bounds the distinct values the exact quantile has to hold
    scored = df.select(F.round(_score_column(forest), 6).alias("s"))
    forest.offset = float(scored.agg(F.percentile("s", F.lit(contamination))).first()[0])
    return forest


def _score_column(forest):
    """Score column; the node arrays travel with the function (see the bound at the top)."""
    trees, sample_rows = forest.arrays, forest.sample_rows
    if sum(len(t[0]) for t in trees) > len(trees) * 2 * max(sample_rows, 1):
        raise ValueError("forest is larger than its settings allow")

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        return pd.Series(score_rows(trees, sample_rows, np.stack(x.to_numpy())))

    return score(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in forest.features]))


def iforest_score(df, forest):
    """Add ``if_score`` (negative is anomalous) and ``if_label`` (-1 or 1); without a forest 0 and 1."""
    if forest is None:
        return df.withColumns({"if_score": F.lit(0.0), "if_label": F.lit(1)})
    scored = df.withColumn("if_score", _score_column(forest) - F.lit(forest.offset))
    return scored.withColumn("if_label", F.when(F.col("if_score") < 0, -1).otherwise(1))


def score_services(features, forest=None, baseline=BASELINE, weights=None, multiplier=3.0):
    """Forest and error-rate scores of each feature row, and their mean.

    ``weights=(forest, spike)`` gives a weighted mean. Without a forest only the spike counts.
    """
    rows = iforest_score(features, forest)
    mean, std = float(np.mean(baseline)), float(np.std(baseline))
    limit = mean + multiplier * std if std > 0 else mean * multiplier
    spike = F.when(F.col("log_count") > 0, F.when(F.col("error_rate") > limit, SPIKE_SCORE).otherwise(NO_SPIKE_SCORE))
    rows = rows.withColumn("statistical_spike", spike)
    known = F.lit(None).cast("double")
    if forest is not None:
        known = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - F.col("if_score")))
    rows = rows.withColumn("isolation_forest", known)
    wf, ws = weights or (1.0, 1.0)
    parts = [(F.col("isolation_forest"), wf), (F.col("statistical_spike"), ws)]
    total, weight = F.lit(0.0), F.lit(0.0)
    for score, w in parts:
        total = total + F.coalesce(score * w, F.lit(0.0))
        weight = weight + F.when(score.isNotNull(), F.lit(w)).otherwise(0.0)
    anomalous = F.coalesce(F.col("error_rate") > limit, F.lit(False)) & (F.col("log_count") > 0)
    if forest is not None:
        anomalous = anomalous | (F.col("if_score") < FOREST_LIMIT)
    return rows.withColumns({
        "combined_score": F.round(F.when(weight > 0, total / weight).otherwise(0.0), 3),
        "is_anomaly": anomalous,
    })


def record_anomalies(scores, time="window", cooldown_s=COOLDOWN_SECONDS, model="ensemble"):
    """Anomaly rows in the stored form, one per service and cooldown."""
    return anomaly_records(cooldown(scores.where("is_anomaly"), "service_name", time, cooldown_s, time), time, model)


def anomaly_records(fired, time="window", model="ensemble"):
    """The stored form of score rows that are recorded; works on streams too."""
    kind = F.when(F.col("statistical_spike") > 0.5, "error_spike").otherwise("volume_anomaly")
    return fired.select(
        F.md5(F.concat_ws("|", F.lit(model), "service_name", F.col(time).cast("string"))).alias("id"),
        F.col(time).alias("detected_at"),
        F.coalesce(kind, F.lit("volume_anomaly")).alias("anomaly_type"),
        "service_name",
        F.col("combined_score").alias("severity_score"),
        F.format_string("Anomaly detected on %s: combined score %.3f", "service_name", "combined_score").alias("description"),
        F.to_json(F.struct("isolation_forest", "statistical_spike")).alias("features"),
        F.lit(model).alias("model_name"), F.lit(VERSION).alias("model_version"), F.lit(False).alias("is_acknowledged"),
    )


def forest_info(spark, forest):
    """One row about the model, for status reports."""
    row = (("isolation_forest", False, None, VERSION, CONTAMINATION, [], TREES) if forest is None else
           ("isolation_forest", True, forest.trained_at, forest.version, forest.contamination, forest.features,
            len(forest.arrays)))
    return spark.createDataFrame([row], "model_name string, is_trained boolean, trained_at string, version string, "
                                        "contamination double, feature_names array<string>, n_estimators int")


def train_summary(features, messages, clusters=None, cluster_key="cluster_id"):
    """One row per model: trained or skipped, on how much, and why not."""
    def summary(df, model, unit):
        n = df.agg(F.count("*").alias("samples"))
        enough = F.col("samples") >= MIN_ROWS
        reason = F.concat(F.lit("Not enough "), F.lit(unit), F.lit(" ("), F.col("samples").cast("string"),
                          F.lit(f", need {MIN_ROWS}+)"))
        return n.select(F.lit(model).alias("model"), F.when(enough, "trained").otherwise("skipped").alias("status"),
                        "samples", F.when(~enough, reason).alias("reason"))
    forest_row = summary(features, "isolation_forest", "data").withColumn("clusters", F.lit(None).cast("bigint"))
    found = F.lit(None).cast("bigint")
    if clusters is not None:
        found = clusters.where(F.col(cluster_key) != -1).agg(F.count_distinct(cluster_key)).scalar()
    return forest_row.unionByName(summary(messages, "pattern_detector", "messages").withColumn("clusters", found))
