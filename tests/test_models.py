"""Models, tuning and sweeps by their results on small tables."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from siltrace.operators import metrics, models
from siltrace.operators.together import run_together

FEATURES = ["told", "noise", "holes"]


@pytest.fixture(scope="module")
def rows(spark):
    """The label is in ``told``; ``noise`` says nothing and ``holes`` is mostly null."""
    made = [(f"A{k}", f"2024-01-{1 + k % 28:02}", k % 4 == 0, ("train", "validation", "test")[k % 3], float(k % 4 == 0) + k % 7 / 10, float(k * 37 % 11), None if k % 5 else 1.0) for k in range(360)]
    return spark.createDataFrame(made, "account_id string, date string, label boolean, split string, told double, noise double, holes double").cache()


def _recall(rows, model, features=FEATURES):
    return metrics.recall_at_fpr(metrics.roc_points(models.scored(model, rows, features))).first()[0]


@pytest.mark.parametrize("kind,params", [("glm", {"c": 0.09}), ("forest", {"trees": 5, "depth": 4}), ("boosted", {"depth": 3, "rounds": 5})])
def test_each_family_learns_separable_rows(rows, kind, params):
    model = models.train(rows.where("split = 'train'"), FEATURES, kind, params)
    got = models.scored(model, rows.where("split = 'test'"), FEATURES)
    assert got.columns == [*rows.columns, "score"] and _recall(rows.where("split = 'test'"), model) == 1.0
    low, high = (got.where(F.col("label") == y).agg(f("score")).first()[0] for y, f in ((False, F.max), (True, F.min)))
    assert low < high


def test_first_stage_refuses_walks_and_names_the_column_that_counts(spark, rows):
    with pytest.raises(ValueError):
        models.stage1_scorer(rows, ["told", "gw_mean"])
    model = models.stage1_scorer(rows.where("split = 'train'"), FEATURES, rounds=3)
    top = models.top_importances(models.importances(model, FEATURES, spark), 2).collect()
    assert top[0].feature == "told" and top[0].importance > 0.9 and len(top) == 2


def test_permutation_names_the_column_that_counts(rows):
    model = models.train(rows.where("split = 'train'"), FEATURES, "glm", {"c": 0.09})
    got = {r.feature: r.importance for r in models.permutation_importance(model, rows.where("split = 'test'"), FEATURES, repeats=2).collect()}
    assert got["told"] > 0.01 and got["told"] > 5 * abs(got["noise"]) and abs(got["holes"]) < 1e-3


def test_saved_model_comes_back_with_its_columns(rows, tmp_path):
    model = models.train(rows, FEATURES, "glm")
    models.save(model, str(tmp_path / "m"), "best", FEATURES)
    again, name, features = models.load(str(tmp_path / "m"))
    assert name == "best" and features == FEATURES
    plain = lambda m, f: sorted((r.account_id, r.score) for r in models.scored(m, rows, f).collect())
    assert plain(again, features) == plain(model, FEATURES)


def test_tuning_takes_the_first_best_draw(rows):
    train, validation = rows.where("split = 'train'"), rows.where("split = 'validation'")
    model, params, recall = models.tune(train, validation, FEATURES, "glm", trials=3)
    tried = [_recall(validation, models.train(train, FEATURES, "glm", p)) for p in models.drawn("glm", 3)]
    assert recall == max(tried) and params == models.drawn("glm", 3)[tried.index(max(tried))] and _recall(validation, model) == recall


def test_ablation_and_its_table(spark, rows, monkeypatch):
    monkeypatch.setattr(models, "drawn", lambda kind, n: [{"regularisation": "l2", "c": 0.09}, {"regularisation": "l1", "c": 0.01}][:n])
    splits = {s: rows.where(F.col("split") == s) for s in ("train", "validation", "test")}
    got = {r.name: r.recall for r in models.ablation(splits, {"a": ["noise"], "b": ["told"]}, "glm", trials=2).collect()}
    assert got["b"] == 1.0 > got["a"]
    recalls = spark.createDataFrame([("profiles+degrees+GWd", 0.7), ("profiles", 0.5), ("profiles+GWd", 0.9), ("profiles+GW", 0.7), ("other", None)], "name string, recall double")
    table = {r.name: (r.delta and round(r.delta, 9), r.best) for r in metrics.ablation_table(recalls).collect()}
    assert table == {"profiles": (0.0, False), "profiles+GW": (0.2, True), "profiles+degrees+GWd": (0.2, False), "profiles+GWd": (0.4, False), "other": (None, False)}


def test_roc_does_not_depend_on_ranges(spark):
    scored = spark.createDataFrame([(float(k * 7 % 31), k % 3 == 0) for k in range(60)] + [(None, True), (1.0, None)], "score double, label boolean")
    one = {tuple(r) for r in metrics.roc_points(scored).collect()}
    assert one == {tuple(r) for r in metrics.roc_points(scored, 5).collect()} and (None, 0.0, 0.0) in one


def test_jobs_overlap_and_inherit(spark):
    sc = spark.sparkContext
    sc.setLocalProperty("siltrace.asked", "yes")
    seen, both = [], threading.Barrier(2, timeout=30)

    def work(k):
        def slow(batches):
            for b in batches:
                time.sleep(1.5)
                yield b

        both.wait()
        began = time.monotonic()
        n = spark.range(k).coalesce(1).mapInArrow(slow, "id long").count()
        seen.append((began, time.monotonic(), sc.getLocalProperty("siltrace.asked"), sc.getLocalProperty("spark.scheduler.pool")))
        return n

    got = run_together(spark, [lambda: work(3), lambda: work(5)], 2, name="overlap")
    sc.setLocalProperty("siltrace.asked", None)
    assert [o.value for o in got] == [3, 5] and not any(o.late for o in got)
    (a, b, *_), (c, d, *_) = seen
    assert max(a, c) < min(b, d) and {x[2:] for x in seen} == {("yes", "overlap")}


def test_late_work_is_cancelled_and_errors_are_raised(spark):
    def stuck():
        def sleep(batches):
            time.sleep(120)
            yield from batches

        return spark.range(4).coalesce(1).mapInArrow(sleep, "id long").count()

    began = time.monotonic()
    got = run_together(spark, [lambda: spark.range(7).count(), stuck, stuck, stuck], 2, timeout=8)
    assert time.monotonic() - began < 60
    assert got[0].value == 7 and [o.late for o in got] == [False, True, True, True]
    assert spark.sparkContext.statusTracker().getActiveJobsIds() == []
    with pytest.raises(ZeroDivisionError):
        run_together(spark, [lambda: 1 / 0, stuck], 2)


def test_a_late_draw_is_left_out(spark, rows, monkeypatch):
    draws = models.drawn("glm", 2)
    ready = models.train(rows.where("split = 'train'"), ["told"], "glm", draws[1])

    def slow(*a):
        if a[3] == draws[0]:
            spark.range(1).coalesce(1).mapInArrow(lambda b: time.sleep(120), "id long").count()
        return ready

    monkeypatch.setattr(models, "train", slow)
    _, params, _ = models.tune(rows.where("split = 'train'"), rows.where("split = 'validation'"), ["told"], "glm", trials=2, timeout=20)
    assert params == draws[1]


def test_sweep_tunes_once_and_refits_each_pair(spark):
    made = [(f"A{k}", k, k % 3 == 0, ("train", "test", "validation")[k // 3 % 3], float(k % 5)) for k in range(180)]
    frame = spark.createDataFrame(made, "account_id string, day int, label boolean, split string, p double")
    # the label is in the degree at window 7 of suspicious rows only
    known = [(a, d, w, float(w == 7 and y) + d % 4 / 100) for a, d, y, _, _ in made for w in (1, 7)]
    degrees = spark.createDataFrame(known, "account_id string, day int, w int, in_degree double")
    given = {"depth": 3, "leaf": 2, "rounds": 4}
    got = {(r.tws, r.twl): r.recall for r in models.window_sweep(frame, degrees, ["p"], [1, 7], params=given).collect()}
    assert set(got) == {(1, 1), (1, 7), (7, 1), (7, 7)} and got[7, 1] == got[7, 7] == 1.0 > got[1, 1]
    for (tws, twl), recall in got.items():
        cell = frame.withColumn("w", F.when(F.col("label"), tws).otherwise(twl)).join(degrees, ["account_id", "day", "w"])
        model = models.train(cell.where("split = 'train'"), ["p", "in_degree"], "boosted", given)
        assert recall == _recall(cell.where("split = 'test'"), model, ["p", "in_degree"])
    tuned = models.window_sweep(frame, degrees, ["p"], [1, 7], "forest", reference=7, trials=2, parallel=2).collect()
    assert len(tuned) == 4 and {r.recall for r in tuned if r.tws == 7} == {1.0}
