"""Price model: feature preparation, training, prediction, evaluation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from forecourt.functions import fixed
from forecourt.operators.forest import GrownForestRegressor
from forecourt.operators.listings import feature_columns, priced
from forecourt.operators.once import once
from forecourt.operators.ranks import MAX_SORTED, exact_medians
from forecourt.operators.split import train_val_split
from forecourt.session import ship_package
from forecourt.sources.tables import path_exists

MIN_TRAINING_ADS = 10
ROWS_PER_TASK = 100_000  # each task of the fit sends figures of all open nodes, so more of them than cores would only send more
FEATURES = fixed.NUMERIC_FEATURES + fixed.CATEGORY_FEATURES


def feature_medians(ads: DataFrame, max_sorted: int = MAX_SORTED) -> dict[str, float]:
    """Median of each numeric feature over the given ads, the constant default where all are null."""
    # Kept for the passes: four numbers a row, instead of what made the ads again and again.
    numbers = ads.select(*fixed.NUMERIC_FEATURES).persist()
    found = exact_medians(numbers, list(fixed.NUMERIC_FEATURES), max_sorted)
    numbers.unpersist()
    return {c: fixed.NUMERIC_DEFAULTS[c] if m is None else m for c, m in found.items()}


def fill_features(ads: DataFrame, numeric: dict[str, float]) -> DataFrame:
    """Features without gaps, as double and string columns with the prefix ``f_``."""
    filled = {f"f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in numeric.items()}
    filled |= {
        f"f_{c}": F.coalesce(F.col(c).cast("string"), F.lit(fixed.MISSING_CATEGORY)) for c in fixed.CATEGORY_FEATURES
    }
    return ads.withColumns(filled)


def prepare_training_data(ads: DataFrame, max_sorted: int = MAX_SORTED) -> DataFrame:
    rows = priced(ads)
    return fill_features(rows, feature_medians(rows, max_sorted))


def encoding_stages() -> list:
    """Alphabetic label codes (unknown words take the number after the last), and standard scaling."""
    indexed = [f"i_{c}" for c in fixed.CATEGORY_FEATURES]
    return [
        StringIndexer(
            inputCols=[f"f_{c}" for c in fixed.CATEGORY_FEATURES], outputCols=indexed,
            stringOrderType="alphabetAsc", handleInvalid="keep",
        ),
        VectorAssembler(inputCols=[f"f_{c}" for c in fixed.NUMERIC_FEATURES] + indexed, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]


def price_pipeline(trees: int = 100, depth: int = 10, seed: int = 42, grown: bool = False) -> Pipeline:
    """Codes, scaling and a random forest, fitted by the library or ``grown`` from histograms (``forest``).

    Codes are plain numbers to the forest, as scaled features carry no category information. Every split
    looks at all features.
    """
    regressor = GrownForestRegressor if grown else RandomForestRegressor
    return Pipeline(stages=[
        *encoding_stages(),
        regressor(
            featuresCol="features", labelCol="price", predictionCol="predicted_price",
            numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all", maxBins=128,
        ),
    ])


@dataclass
class TrainedPriceModel:
    model: PipelineModel
    training_samples: int
    test_samples: int
    mae: float
    r2_score: float

    @property
    def feature_importance(self) -> dict[str, float]:
        return dict(zip(FEATURES, self.model.stages[-1].featureImportances.toArray().tolist()))

    def report(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [("trained", self.training_samples, self.test_samples, self.mae, self.r2_score, self.feature_importance)],
            "status string, training_samples bigint, test_samples bigint, mae double, r2_score double, "
            "feature_importance map<string,double>",
        )


def enough_ads(ads: DataFrame, required: int = MIN_TRAINING_ADS) -> int | None:
    """Number of usable ads when there are too few of them, else None; reads no more than needed."""
    available = ads.limit(required).count()
    return available if available < required else None


def train_price_model(
    ads: DataFrame, key: str = "id", trees: int = 100, depth: int = 10, seed: int = 42,
    test_ratio: float = 0.2, max_sorted: int = MAX_SORTED, rows_per_task: int = ROWS_PER_TASK,
) -> TrainedPriceModel:
    """Fit on 80 % of the priced ads and evaluate on the rest; raises ValueError below 10 ads.

    Every level of every tree passes over the training rows, so they are dealt to all cores, however few files they come from.
    Rows of one task are fitted by the library, more of them by ``forest``.
    """
    rows = priced(ads).persist()
    available = enough_ads(rows)
    if available is not None:
        raise ValueError(f"insufficient data for training: {available} of {MIN_TRAINING_ADS} ads")
    tasks = min(ads.sparkSession.sparkContext.defaultParallelism, ceil(rows.count() / rows_per_task))
    prepared = train_val_split(prepare_training_data(rows, max_sorted), key, 1 - test_ratio, seed, max_sorted)
    prepared = (prepared.repartition(tasks, key) if tasks > 1 else prepared).persist()
    train, test = prepared.filter("split = 'train'"), prepared.filter("split = 'val'")
    model = price_pipeline(trees, depth, seed, tasks > 1).fit(train)
    scored = model.transform(test).select("price", "predicted_price").persist()
    evaluate = lambda name: RegressionEvaluator(labelCol="price", predictionCol="predicted_price", metricName=name).evaluate(scored)
    sizes = {r["split"]: r["count"] for r in prepared.groupBy("split").count().collect()}
    trained = TrainedPriceModel(model, sizes.get("train", 0), sizes.get("val", 0), evaluate("mae"), evaluate("r2"))
    scored.unpersist()
    prepared.unpersist()
    rows.unpersist()
    return trained


def completeness(columns: list[str] = FEATURES) -> Column:
    """Prediction confidence from the share of given features."""
    given = F.lit(0)
    for name in columns:
        given = given + F.col(name).isNotNull().cast("int")
    return F.least(F.lit(0.9), given * F.lit(0.8) / F.lit(float(len(columns))))


def with_deal(scored: DataFrame) -> DataFrame:
    """Difference to the predicted price, and whether the ad is a good deal; null without price or prediction."""
    given = F.coalesce(F.col("price"), F.lit(0.0)) != 0
    return scored.withColumns({
        "price_difference": F.when(given, F.col("price") - F.col("predicted_price")),
        "is_good_deal": F.when(given, F.col("price") < F.col("predicted_price") * 0.9),
    })


def predict_prices(model: PipelineModel, ads: DataFrame, keep: tuple[str, ...] = ("id", "source_id", "price")) -> DataFrame:
    """Predicted price, confidence and deal flag of every ad; gaps take the constant defaults."""
    filled = fill_features(ads, fixed.NUMERIC_DEFAULTS).withColumn("confidence", completeness())
    # A forest's walk is not repeated for the columns and filters that read the price.
    scored = once(model.transform(filled), "__price", F.col("predicted_price")).drop("predicted_price").withColumnRenamed("__price", "predicted_price")
    return with_deal(scored).select(
        *keep, "predicted_price", "confidence", "price_difference", "is_good_deal"
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_info(spark: SparkSession, trained: TrainedPriceModel | PipelineModel | None, path: str = "") -> DataFrame:
    """One row: whether there is a model, its features, kind, and where it is kept."""
    return spark.createDataFrame(
        [(trained is not None, "ready" if trained is not None else "needs_training", FEATURES, "RandomForestRegressor", path)],
        "is_trained boolean, status string, feature_columns array<string>, model_type string, model_path string",
    )


# --- The forest as a table, and what it says of rows whose features are columns. ---
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double"


def forest_nodes(spark: SparkSession, path: str) -> DataFrame:
    """A saved model's forest, a row a node: feature and threshold of a branch (at most: left, else right), value of a leaf.

    Node 0 is a tree's root. A forest has at most trees * 2^(depth + 1) rows.
    """
    saved = spark.read.parquet(f"{path}/stages/*_RandomForestRegressor_*/data").select("treeID", "nodeData.*")
    branch = F.col("leftChild") >= 0
    return saved.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.when(branch, F.col("split.featureIndex")).alias("feature"),
        F.when(branch, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"), F.when(branch, F.col("leftChild")).alias("left"),
        F.when(branch, F.col("rightChild")).alias("right"), F.when(~branch, F.col("prediction")).alias("value"),
    )


def _scores(forest: dict[str, np.ndarray], features: str, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(features)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            # Every row stands at a node of every tree; all take a step down at once until all are at leaves.
            at = np.broadcast_to(forest["roots"], (batch.num_rows, len(forest["roots"])))
            while (branch := forest["left"][at] >= 0).any():
                value = np.take_along_axis(x, np.maximum(forest["feature"][at], 0), axis=1)
                down = np.where(value <= forest["threshold"][at], forest["left"][at], forest["right"][at])
                at = np.where(branch, down, at)
            kept = [batch.column(c) for c in batch.schema.names if c != features]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(forest["value"][at].mean(axis=1))], names=out)

    return run


def score_forest(rows: DataFrame, nodes: DataFrame, features: str = "features", name: str = "predicted_price") -> DataFrame:
    """Rows with the mean of all trees' leaf values; ``features`` is an array of numbers without gaps and leaves.

    ``nodes`` are those of ``forest_nodes``; a forest fits every task, being bounded by its trees and their depth.
    """
    ship_package(rows.sparkSession)
    found = nodes.orderBy("tree", "node").toArrow()
    columns = {c: found.column(c).to_numpy() for c in found.column_names}
    key = columns["tree"].astype(np.int64) << 32 | columns["node"]
    whole = lambda c: np.nan_to_num(columns[c].astype(float), nan=-1).astype(np.int64)

    def place(child: np.ndarray) -> np.ndarray:
        return np.where(child < 0, -1, np.searchsorted(key, (columns["tree"].astype(np.int64) << 32) | np.maximum(child, 0)))

    forest = {
        "roots": np.flatnonzero(columns["node"] == 0), "feature": whole("feature"), "left": place(whole("left")), "right": place(whole("right")),
        "threshold": columns["threshold"].astype(float), "value": columns["value"].astype(float),
    }
    schema = StructType([*[f for f in rows.schema.fields if f.name != features], StructField(name, DoubleType())])
    return rows.mapInArrow(_scores(forest, features, schema.names), schema)


def encoded(model: PipelineModel, prepared: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Codes of the words and scaled features, as the forest sees them."""
    rows = prepared
    for stage in model.stages[: len(encoding_stages())]:
        rows = stage.transform(rows)
    return rows.select(*keep, *[f"i_{c}" for c in fixed.CATEGORY_FEATURES], vector_to_array("features").alias("features"))


def quality(scored: DataFrame, label: str = "price", predicted: str = "predicted_price") -> DataFrame:
    """One row: number of rows, mean absolute error, and the share of the variance that is explained."""
    error = F.col(label) - F.col(predicted)
    out = scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sum(error * error).alias("left"), F.var_pop(label).alias("spread")
    )
    return out.select("n", "mae", (1 - F.col("left") / (F.col("spread") * F.col("n"))).alias("r2_score"))


def fingerprint(ads: DataFrame, *settings: object) -> str:
    """A name for a training set and its settings: equal rows in any order give the same one."""
    row = ads.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*ads.columns).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), *ads.columns))).first()
    digest = "-".join(str(v) for v in (*row, *settings))
    return hashlib.md5(digest.encode()).hexdigest()[:16]


def trained_model(ads: DataFrame, root: str, key: str = "id", trees: int = 100, depth: int = 10, seed: int = 42) -> str:
    """Path of the saved model of these ads, fitted where there is none yet. The training rows are read each time: a model
    is found by what they are, so it never outlives them. Its report is written last and marks it as complete."""
    spark = ads.sparkSession
    rows = feature_columns(priced(ads), (key,))
    path = f"{root}/price-model-{fingerprint(rows, trees, depth, seed)}"
    if not path_exists(spark, f"{path}/report/_SUCCESS"):
        model = train_price_model(rows, key, trees, depth, seed)
        save_model(model.model, f"{path}/model")
        model.report(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/report")
    return path


def saved_info(spark: SparkSession, path: str) -> DataFrame:
    """``model_info`` of what is saved at a path."""
    there = path_exists(spark, f"{path}/model/metadata")
    return model_info(spark, load_model(f"{path}/model") if there else None, path)
