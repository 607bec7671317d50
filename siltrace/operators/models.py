"""Models on feature rows with Spark ML."""

from __future__ import annotations

import json
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltrace.operators.metrics import balanced_weights, log_loss, recall_at_fpr, roc_points
from siltrace.operators.together import run_together
from siltrace.session import stored

#: Published search ranges (fixed values), as far as Spark has them. Spark's trees stop at depth 30
#: where 40 is published; it has no least size of a node that is split (10 to 50), so half of it is
#: asked of each side; and 200 to 500 leaves become a depth of 8 or 9.
RANGES = {
    "glm": {"regularisation": ["l1", "l2"], "c": [0.01, 0.09], "standardise": [True, False]},
    "forest": {"trees": [100, 200], "depth": [10, 30], "leaf": [5, 25]},
    "boosted": {"depth": [8, 9], "rate": [0.01, 0.09], "leaf": [100, 200]},
}
#: Boosting rounds, where none are given (the published trainer's default).
ROUNDS = 100
#: Days of the published window sweep.
WINDOWS = [1, 7, 14, 30, 60, 90]


def _prepared(rows: DataFrame, features: list[str]) -> DataFrame:
    """Label as a number, balanced weights, and doubles for the assembler."""
    weights = F.broadcast(balanced_weights(rows).withColumnRenamed("weight", "_weight"))
    return rows.select("*", F.col("label").cast("double").alias("_y")).withColumns({c: F.col(c).cast("double") for c in features}).join(weights, "label")


def _stages(kind: str, features: list[str], params: dict, n: int) -> list:
    """Trees see nulls as a sentinel; the linear model as the column's median."""
    put = {"featuresCol": "_x", "labelCol": "_y", "weightCol": "_weight"}
    if kind == "glm":
        model = LogisticRegression(**put, elasticNetParam=1.0 if params.get("regularisation") == "l1" else 0.0, regParam=1.0 / (params.get("c", 1.0) * max(n, 1)), standardization=params.get("standardise", True), maxIter=100)
        filled = [f"_f_{c}" for c in features]
        return [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_x"), model]
    if kind == "forest":
        model = RandomForestClassifier(**put, numTrees=params.get("trees", 100), maxDepth=min(30, params.get("depth", 10)), minInstancesPerNode=params.get("leaf", 1), seed=42)
    else:
        model = GBTClassifier(**put, maxDepth=params.get("depth", 5), stepSize=params.get("rate", 0.1), minInstancesPerNode=params.get("leaf", 20), maxIter=params.get("rounds", ROUNDS), seed=42)
    return [VectorAssembler(inputCols=features, outputCol="_x"), model]


def _without_nulls(rows: DataFrame, kind: str, features: list[str]) -> DataFrame:
    return rows if kind == "glm" else rows.fillna(-1e9, subset=features)


def train(rows: DataFrame, features: list[str], kind: str = "boosted", params: dict | None = None) -> PipelineModel:
    """A fitted pipeline of one of the three families, classes balanced by weight."""
    ready = _without_nulls(_prepared(rows, features), kind, features)
    return Pipeline(stages=_stages(kind, features, params or {}, ready.count())).fit(ready)


def stage1_scorer(rows: DataFrame, features: list[str], rounds: int = 150) -> PipelineModel:
    """Boosted trees of depth 5 on profile and degree columns; walk columns are refused."""
    if any(c.startswith(("gw_", "gwd_")) for c in features):
        raise ValueError("the first stage must not see walk features")
    return train(rows, features, "boosted", {"depth": 5, "rounds": rounds})


def scored(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with ``score``, the probability of the positive class."""
    kind = "glm" if len(model.stages) == 3 else "trees"
    ready = _without_nulls(rows.withColumns({c: F.col(c).cast("double") for c in features}), kind, features)
    out = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return out.drop(*[c for c in out.columns if c not in {*rows.columns, "score"}])


def drawn(kind: str, n: int, seed: int = 42) -> list[dict]:
    """Seeded draws from the ranges; rates and penalties on a log scale."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        one = {}
        for name, r in RANGES[kind].items():
            if len(r) == 2 and isinstance(r[0], bool | str):
                one[name] = rng.choice(r)
            elif isinstance(r[0], float):
                one[name] = r[0] * (r[1] / r[0]) ** rng.random()
            else:
                one[name] = rng.randint(*r)
        out.append(one)
    return out


def _recall(model, rows: DataFrame, target_fpr: float) -> float | None:
    """Recall of a fitted last stage on rows with a vector ``_x``; null without both labels."""
    found = model.transform(rows).select("label", vector_to_array("probability")[1].alias("score"))
    got = recall_at_fpr(roc_points(found), target_fpr).first()
    return got[0] if got else None


def _best(spark, fits: list, draws: list[dict], parallel: int, timeout: float | None):
    """(result, parameters, recall) of the best draw that ended in time; ``fits`` give (result, recall).

    The first of several equal ones counts. If none ends in time, the first draw is fitted without limit.
    """
    ended = [(o.value, p) for o, p in zip(run_together(spark, fits, parallel, timeout, "tuning"), draws) if not o.late]
    if not ended:
        ended = [(fits[0](), draws[0])]
    (result, recall), params = max(ended, key=lambda x: x[0][1] or 0.0)
    return result, params, recall or 0.0


def tune(train_rows: DataFrame, validation: DataFrame, features: list[str], kind: str = "boosted", trials: int = 50, target_fpr: float = 0.2, seed: int = 42, timeout: float | None = None, parallel: int = 4) -> tuple[PipelineModel, dict, float]:
    """The model, parameters and validation recall of the best of ``trials`` draws.

    ``parallel`` fits run at a time; those that run when ``timeout`` seconds are over are cancelled.
    """
    train_rows, validation = train_rows.persist(), validation.persist()

    def fit(params):
        model = train(train_rows, features, kind, params)
        return model, recall_at_fpr(roc_points(scored(model, validation, features)), target_fpr).first()[0]

    draws = drawn(kind, trials, seed)
    try:
        return _best(train_rows.sparkSession, [lambda p=p: fit(p) for p in draws], draws, parallel, timeout)
    finally:
        train_rows.unpersist()
        validation.unpersist()


def importances(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """``feature, importance`` of a tree model, one row for each feature."""
    return spark.createDataFrame([(f, float(x)) for f, x in zip(features, model.stages[-1].featureImportances.toArray())], "feature string, importance double")


def top_importances(table: DataFrame, n: int = 25) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(n)


def permutation_importance(model: PipelineModel, rows: DataFrame, features: list[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """``feature, importance``: the mean rise of log loss when a column is shuffled.

    A column is shuffled by joining each row's place to the value at the same place in another,
    hash-made order. Places are made of hash buckets, so no task ranks all rows.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_id", F.xxhash64("account_id", "date")).persist()
    base = log_loss(scored(model, keyed, features)).first()[0]
    buckets = max(8, keyed.count() // 20_000)  # of about as many rows, whatever the table's size

    def placed(salt) -> DataFrame:
        mixed = keyed.withColumn("_m", F.xxhash64("_id", F.lit(salt))).withColumn("_b", F.pmod("_m", F.lit(buckets)))
        n = mixed.groupBy("_b").count().select("_b", (F.sum("count").over(W.orderBy("_b")) - F.col("count")).alias("_o"))
        return mixed.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_m", "_id"))).join(F.broadcast(n), "_b").withColumn("_p", F.col("_o") + F.col("_r"))

    out = []
    home = placed("home").drop("_m", "_b", "_o", "_r").persist()
    for f in features:
        rises = []
        for k in range(repeats):
            other = placed(f"{f}|{k}|{seed}").select("_p", F.col(f).alias("_v"))
            shuffled = home.join(other, "_p").withColumn(f, F.col("_v")).drop("_v", "_p")
            rises.append(log_loss(scored(model, shuffled, features)).first()[0] - base)
        out.append((f, float(sum(rises) / len(rises))))
    home.unpersist()
    keyed.unpersist()
    return spark.createDataFrame(out, "feature string, importance double")


def ablation(splits: dict[str, DataFrame], sets: dict[str, list[str]], kind: str = "boosted", trials: int = 5, target_fpr: float = 0.2, timeout: float | None = None, parallel: int = 4) -> DataFrame:
    """``name, recall`` on the test split for each named list of columns, each tuned by ``trials`` draws.

    Fits of all sets share the ``parallel`` threads and the time limit. Nulls are filled and rows weighted once for all
    fits (medians are those of the training split), and a split is kept in tasks of ``ROWS_A_TASK`` rows, since each
    step of a fit runs them all again.
    """
    spark, draws = splits["train"].sparkSession, drawn(kind, trials)
    names = list(dict.fromkeys(c for features in sets.values() for c in features))
    ready = {k: _without_nulls(v.where("label is not null").select("label", *[F.col(c).cast("double").alias(c) for c in names]), kind, names) for k, v in splits.items()}
    if kind == "glm":
        medians = Imputer(inputCols=names, outputCols=[f"_f_{c}" for c in names], strategy="median").fit(ready["train"])
        ready = {k: medians.transform(v).select("label", *[F.col(f"_f_{c}").alias(c) for c in names]) for k, v in ready.items()}
    n = {r["label"]: r["count"] for r in splits["train"].where("label is not null").groupBy("label").count().collect()}
    total = sum(n.values())
    weight = F.when(F.col("label"), total / (2 * n.get(True, 1))).otherwise(total / (2 * n.get(False, 1)))
    held = {k: stored(v.withColumns({"_y": F.col("label").cast("double"), "_weight": weight}), f"ablation-{k}").coalesce(max(1, -(-total // ROWS_A_TASK))).persist() for k, v in ready.items()}

    def cell(features, split):
        return VectorAssembler(inputCols=features, outputCol="_x").transform(held[split]).select("label", "_y", "_weight", "_x")

    def fit(features, params):
        model = _stages(kind, [], params, total)[-1].fit(cell(features, "train"))
        return model, _recall(model, cell(features, "validation"), target_fpr)

    try:
        fits = [(name, lambda f=f, p=p: fit(f, p)) for name, f in sets.items() for p in draws]
        ended = run_together(spark, [f for _, f in fits], parallel, timeout, "ablation")
        best = {}
        for name in sets:
            tried = [o.value for (n, _), o in zip(fits, ended) if n == name and not o.late] or [fit(sets[name], draws[0])]
            best[name] = max(tried, key=lambda x: x[1] or 0.0)[0]
        out = run_together(spark, [lambda n=n: _recall(best[n], cell(sets[n], "test"), target_fpr) for n in sets], parallel, name="ablation")
    finally:
        for df in held.values():
            df.unpersist()
    return spark.createDataFrame([(n, o.value) for n, o in zip(sets, out)], "name string, recall double")


def sweep_table(rows: DataFrame, degrees: DataFrame, profiles: list[str]) -> DataFrame:
    """``label, split, w, _x``: every row's vector once for each window, in a folder for each window and label.

    ``degrees`` are the degree features of every account and day of ``rows`` once for each window ``w``. A pair of
    windows is read from two of the folders, so no feature is computed or joined twice.
    """
    names = profiles + [c for c in degrees.columns if c not in ("account_id", "day", "w")]
    joined = rows.join(degrees, ["account_id", "day"]).withColumns({c: F.col(c).cast("double") for c in names})
    x = VectorAssembler(inputCols=names, outputCol="_x").transform(_without_nulls(joined, "boosted", names))
    return stored(x.select("label", "split", "w", "_x"), "sweep", ["w", "label"])


ROWS_A_TASK = 50_000  # of a training set; fewer tasks than that leaves only pay for being started


def window_sweep(rows: DataFrame, degrees: DataFrame, profiles: list[str], grid: list[int] = WINDOWS, kind: str = "boosted", params: dict | None = None, target_fpr: float = 0.2, reference: int = 60, trials: int = 30, timeout: float | None = 180, parallel: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """``tws, twl, recall`` on the test split of a tree model refit for each pair of windows.

    Suspicious ``rows`` (with ``label`` and ``split``) take their degree features at ``tws``, the others at
    ``twl``. Parameters are tuned once, at the window ``reference`` for both (``trials`` draws, scored on the
    validation split, those unfinished after ``timeout`` seconds cancelled), unless ``params`` gives
    them. Then ``parallel`` pairs are fitted at a time.
    """
    spark, table = rows.sparkSession, sweep_table(rows, degrees, profiles)
    some = table.where((F.col("w") == grid[0]) & (F.col("split") == "train")).groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in some}
    weight = F.when(F.col("label"), sum(n.values()) / (2 * n.get(True, 1))).otherwise(sum(n.values()) / (2 * n.get(False, 1)))
    parts = max(1, -(-sum(n.values()) // ROWS_A_TASK))

    def cell(tws: int, twl: int, split: str) -> DataFrame:
        mine = table.where((F.col("label") & (F.col("w") == tws)) | (~F.col("label") & (F.col("w") == twl))).where(F.col("split") == split)
        return mine.select("label", F.col("label").cast("double").alias("_y"), weight.alias("_weight"), "_x").coalesce(parts)

    def fit(tws: int, twl: int, given: dict, split: str) -> float | None:
        model = _stages(kind, [], {"rounds": rounds, **given}, 0)[-1].fit(cell(tws, twl, "train"))
        return _recall(model, cell(tws, twl, split), target_fpr)

    if params is None:
        draws = drawn(kind, trials)
        tuned = [lambda p=p: (None, fit(reference, reference, p, "validation")) for p in draws]
        _, params, _ = _best(spark, tuned, draws, parallel, timeout)
    pairs = [(tws, twl) for tws in grid for twl in grid]
    recalls = run_together(spark, [lambda p=p: fit(*p, params, "test") for p in pairs], parallel, name="sweep")
    return spark.createDataFrame([(*p, o.value) for p, o in zip(pairs, recalls)], "tws int, twl int, recall double")


def save(model: PipelineModel, path: str, name: str, features: list[str]) -> None:
    """The model, and its name and columns as a one-row JSON table beside it."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(name, json.dumps(features))], "name string, features string").coalesce(1).write.mode("overwrite").json(f"{path}/columns")


def load(path: str) -> tuple[PipelineModel, str, list[str]]:
    """What ``save`` wrote: the model, its name and its columns in order."""
    row = SparkSession.active().read.schema("name string, features string").json(f"{path}/columns").first()
    return PipelineModel.load(f"{path}/model"), row["name"], json.loads(row["features"])
