"""The forest grown from histograms against the library's own."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel, RandomForestRegressor

from forecourt.operators import forest


@pytest.fixture(scope="module")
def rows(spark):
    random = np.random.default_rng(1)
    x = random.normal(size=(4000, 4))
    x[:, 1], x[:, 2], x[:, 3] = random.integers(0, 9, 4000), random.integers(0, 3, 4000), 1
    y = 3 * x[:, 0] + x[:, 1] ** 2 + 5 * x[:, 2] + random.normal(size=4000)
    given = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, d double, price double")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(given.repartition(4)).persist()


def _predicted(model, rows):
    return np.array([r[0] for r in model.transform(rows).orderBy("a", "b").select("prediction").collect()])


@pytest.mark.parametrize("group_bytes", [1, 1 << 20])
def test_a_tree_of_all_rows_is_the_librarys(rows, monkeypatch, group_bytes):
    monkeypatch.setattr(forest, "GROUP_BYTES", group_bytes)
    settings = {"labelCol": "price", "maxDepth": 5, "maxBins": 32, "seed": 3}
    one = forest.grow(rows, RandomForestRegressor(numTrees=1, featureSubsetStrategy="all", **settings), bootstrap=False)
    library = DecisionTreeRegressor(**settings).fit(rows)
    assert one.trees[0].numNodes == library.numNodes
    assert np.allclose(_predicted(one, rows), _predicted(library, rows))
    assert np.allclose(one.featureImportances.toArray(), library.featureImportances.toArray())


def test_a_forest_is_as_good_as_the_librarys_and_is_saved(rows, tmp_path):
    asked = RandomForestRegressor(labelCol="price", numTrees=20, maxDepth=6, maxBins=32, seed=3, featureSubsetStrategy="all")
    grown, library = forest.grow(rows, asked), asked.fit(rows)
    price = np.array([r[0] for r in rows.orderBy("a", "b").select("price").collect()])
    errors = [np.abs(_predicted(m, rows) - price).mean() for m in (grown, library)]
    assert grown.getNumTrees == 20 and errors[0] == pytest.approx(errors[1], rel=0.05)
    assert len({t.featureImportances.toArray().tobytes() for t in grown.trees}) == 20
    assert np.allclose(grown.featureImportances.toArray(), library.featureImportances.toArray(), atol=0.02)
    grown.write().save(f"{tmp_path}/forest")
    assert np.array_equal(_predicted(RandomForestRegressionModel.load(f"{tmp_path}/forest"), rows), _predicted(grown, rows))


def test_features_of_few_bins_share_a_block():
    blocks = forest.blocks_of([7, 50, 128, 3, 1, 2])
    assert sorted(f for b in blocks for f in b) == [0, 1, 2, 3, 5]
    assert all(np.prod([[7, 50, 128, 3, 1, 2][f] for f in b]) <= forest.BLOCK_BINS for b in blocks) and len(blocks) < 5


def test_borders_are_middles_or_quantiles():
    assert forest.borders_of(np.array([3.0, 1.0, 1.0, 2.0]), 4).tolist() == [1.5, 2.5]
    assert len(forest.borders_of(np.arange(1000.0), 16)) == 15
