"""Every query with an SQL twin against DuckDB on the small tables."""

import collections
import os

import pandas as pd
import pytest

from frameledger import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def bag(frame):
    columns = sorted(frame.columns)
    return columns, collections.Counter(tuple(None if pd.isna(v) else round(float(v), 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    assert bag(catalog.QUERIES[name](spark, DATA).toPandas()) == bag(duck.execute(catalog.SQL[name]).fetchdf())


def test_forest_learns(spark):
    """Forests can't be put as SQL: held-in accuracy over the share of the largest class, every image once."""
    got = catalog.rf_predict(spark, DATA).toPandas()
    assert got["image_id"].is_unique and len(got) == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert (got["cls"] == got["predicted"]).mean() > got["cls"].value_counts(normalize=True).max()
    assert sorted(set(catalog.QUERIES) - set(catalog.SQL)) == ["forest_tuning", "rf_predict", "tile_features"]


def test_forest_in_parts_is_a_forest(spark, monkeypatch):
    """Few nodes may lie on the driver: the trees come in several fits, every row once, repeated rows too, and probabilities predict as well as those of one fit."""
    import random

    from frameledger.operators import models

    rng = random.Random(4)
    data = [(i // 2, (c := rng.choice([0, 1, 2])), [c + rng.gauss(0, 0.6), rng.random()]) for i in range(400)]
    rows, fits = spark.createDataFrame(data, "id long, cls int, x array<double>"), []

    class Counted(models.RandomForestClassifier):
        def fit(self, dataset):
            fits.append((self.getNumTrees(), self.getSeed(), self.getFeatureSubsetStrategy()))
            return super().fit(dataset)

    monkeypatch.setattr(models, "RandomForestClassifier", Counted)

    def found(**limit):
        got = models.forest_probabilities(rows, rows, "x", "cls", trees=10, depth=8, **limit).collect()
        assert sorted((r.id, r.cls, r.x) for r in got) == sorted(data) and all(abs(sum(r.proba) - 1) < 1e-9 for r in got)
        return sum(max(range(3), key=lambda k: r.proba[k]) == r.cls for r in got) / len(got)

    whole, parts = found(), found(nodes=500)
    assert fits[0] == (10, 7, "sqrt") and [n for n, _, _ in fits[1:]] == [3, 3, 3, 1] and len({seed for _, seed, _ in fits[1:]}) == 4
    assert {s for _, _, s in fits} == {"sqrt"} and abs(whole - parts) < 0.06 and parts > 0.7


def test_forest_tuning_selects_the_first_best(spark):
    got = catalog.forest_tuning(spark, DATA).toPandas().sort_values(["forest", "power_no"], ignore_index=True)
    assert list(zip(got["forest"], got["power_no"], got["power"])) == [(f, n, p) for f in (0, 1) for n, p in enumerate((0.0, 0.5, 1.0))]
    assert got["fg_macro_iou"].between(0, 1).all()
    assert got[got["best"]].index.tolist() == [got["fg_macro_iou"].idxmax()]


def test_forest_scores_equal_those_of_its_probabilities(spark):
    """The score of a candidate from the forest's probabilities, in plain Python."""
    import random

    from pyspark.sql import functions as F

    from frameledger.operators import models

    rng = random.Random(3)
    data = [(i, (c := rng.choice([0, 0, 0, 1, 2])), [c + rng.gauss(0, 0.9), rng.random()]) for i in range(300)]
    rows = spark.createDataFrame(data, "id long, cls int, x array<double>")
    train, held, ratio = rows.where("id < 200"), rows.where("id >= 200"), [2.0, 0.5, 0.5]
    scores = {(r.forest, r.power_no): r.fg_macro_iou for r in models.tune_forest(train, held, "x", "cls", ratio, [{"trees": 5, "depth": 3}], [0.0, 1.0]).collect()}
    proba = models.forest_probabilities(train, held, "x", "cls", trees=5, depth=3).select("cls", "proba").collect()
    for n, power in enumerate((0.0, 1.0)):
        picks = [(int(r.cls), max(range(len(r.proba)), key=lambda k: (r.proba[k] * ratio[k] ** power, -k))) for r in proba]
        ious = [sum(t == p == c for t, p in picks) / u for c in (1, 2) if (u := sum(c in pair for pair in picks))]
        assert scores[0, n] == pytest.approx(sum(ious) / len(ious))
    tied = spark.createDataFrame([(1, 0, 0.0, 0.5), (0, 1, 1.0, 0.5), (0, 0, 0.0, None)], "forest int, power_no int, power double, fg_macro_iou double")
    assert models.best_candidate(tied).select("forest", "power_no").collect() == [(0, 1)]
    assert models.best_candidate(tied.where(F.lit(False))).count() == 0
