"""Feature transforms, splits and classifiers on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.core import ensure_checkpoint_dir
from whyframe.operators.frames import hash_split, stratified_folds
from whyframe.operators.scoring import cv_summary, model_report


@dataclass(frozen=True)
class LogisticScore:
    """Closed-form probability of class 1; usable as a Column, in numpy and in SQL."""

    weights: dict[str, float]
    bias: float

    @property
    def features(self) -> list[str]:
        return list(self.weights)

    def column(self, values: dict[str, Column] | None = None) -> Column:
        z = F.lit(float(self.bias))
        for name, w in self.weights.items():
            v = values[name] if values is not None else F.col(name)
            z = z + v.cast("double") * F.lit(float(w))
        return 1.0 / (1.0 + F.exp(-z))

    def numpy(self, x):
        import numpy as np

        z = np.full(x.shape[:-1], self.bias)
        for i, w in enumerate(self.weights.values()):  # same order of sums as the Column and SQL forms
            z = z + x[..., i] * w
        return 1.0 / (1.0 + np.exp(-z))

    def sql(self, values: dict[str, str] | None = None) -> str:
        terms = " + ".join(f"({(values or {}).get(n, n)})::DOUBLE * ({w!r})" for n, w in self.weights.items())
        return f"(1.0 / (1.0 + exp(-({self.bias!r}::DOUBLE + {terms}))))"


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(x - mean) / population std`` (std 0 counts as 1); statistics are one aggregate row."""
    stats = df.agg(F.struct(*[a for c in cols for a in (
        F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).alias("s")).scalar()
    with_stats = df.withColumn("_s", stats)
    return with_stats.withColumns({
        c: (F.col(c) - F.col(f"_s.m_{c}")) / F.when(F.col(f"_s.s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s.s_{c}"))
        for c in cols
    }).drop("_s")


def one_hot(df: DataFrame, col: str, categories: list[str]) -> DataFrame:
    """0/1 column per known category; an unknown value gives all zeros."""
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("long"), F.lit(0)) for v in categories})


def feature_columns(df: DataFrame, y: str, ignore: list[str] | None = None) -> tuple[list[str], list[str]]:
    """The numeric and the categorical columns that models learn from."""
    from whyframe.core import categorical_columns, numeric_columns

    skip = set(ignore or []) | {y, "fold", "part"}
    return [c for c in numeric_columns(df) if c not in skip], [c for c in categorical_columns(df) if c not in skip]


def feature_stages(df: DataFrame, y: str, ignore: list[str] | None = None):
    """Pipeline stages: impute and scale numerics (by the population deviation of the ``df`` rows), one-hot categoricals, assemble."""
    from pyspark.ml.feature import ElementwiseProduct, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.linalg import Vectors

    nums, cats = feature_columns(df, y, ignore)
    n = df.count()  # the scaler divides by the sample deviation
    stages = [
        Imputer(inputCols=nums, outputCols=[f"{c}_f" for c in nums]),
        VectorAssembler(inputCols=[f"{c}_f" for c in nums], outputCol="_num"),
        StandardScaler(inputCol="_num", outputCol="_sample", withMean=True),
        ElementwiseProduct(scalingVec=Vectors.dense([(n / (n - 1)) ** 0.5 if n > 1 else 1.0] * len(nums)), inputCol="_sample", outputCol="_scaled"),
    ]
    parts = ["_scaled"]
    if cats:
        stages += [
            StringIndexer(inputCols=cats, outputCols=[f"{c}_i" for c in cats], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_i" for c in cats], outputCols=[f"{c}_o" for c in cats]),
        ]
        parts += [f"{c}_o" for c in cats]
    return stages + [VectorAssembler(inputCols=parts, outputCol="features")]


def candidates(y: str, trees: int = 100, seed: int = 30) -> dict[int, tuple[str, object]]:
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier

    return {
        1: ("logistic regression", LogisticRegression(labelCol=y, maxIter=50)),
        2: ("decision tree", DecisionTreeClassifier(labelCol=y, seed=seed)),
        3: ("random forest", RandomForestClassifier(labelCol=y, numTrees=trees, seed=seed)),
    }


def fit_models(df: DataFrame, y: str, id_col: str, which: list[int] | None = None, trees: int = 100,
               test_fraction: float = 0.3, seed: int = 7):
    """Fit the chosen models on the train part; returns their fitted pipelines and a report frame."""
    from functools import reduce

    from pyspark.ml import Pipeline

    split = hash_split(df, id_col, test_fraction, seed).persist()
    train, test = split.filter("part = 'train'"), split.filter("part = 'test'")
    prep = Pipeline(stages=feature_stages(train, y, [id_col])).fit(train)
    train_x = prep.transform(train).select("features", y).persist()
    test_x = prep.transform(test).select("features", y)
    fitted, scored = {}, []
    for no, (name, est) in candidates(y, trees).items():
        if which and no not in which:
            continue
        model = est.fit(train_x)
        fitted[no] = (name, prep, model)
        scored.append(model.transform(test_x).select(
            F.lit(no).cast("long").alias("model_no"), F.col(y).cast("int").alias("truth"), F.col("prediction").cast("int").alias("pred")))
    n_train = train_x.count()
    ensure_checkpoint_dir(df.sparkSession)
    report = model_report(reduce(DataFrame.unionByName, scored), "truth", "pred", "model_no", F.lit(n_train).cast("long")).checkpoint()
    train_x.unpersist()
    split.unpersist()
    return fitted, report


# Rows of one task of a fit; small tables are fitted in few tasks, as a fit is hundreds of short jobs.
FIT_ROWS = 50_000


def cv_accuracy(df: DataFrame, y: str, id_col: str, k: int = 10, which: list[int] | None = None, trees: int = 100,
                seed: int = 7, parallelism: int = 4) -> DataFrame:
    """Stratified k-fold accuracy: ``(model_no, mean_score, std_score)``.

    Features are prepared once per fold on its training part; all folds of a
    model are scored as one union, so accuracy is a single aggregate. The tasks
    of a fit follow the number of rows, not the width of shuffles.
    """
    from functools import reduce
    from multiprocessing.pool import ThreadPool

    from pyspark.ml import Pipeline

    dealt = stratified_folds(df, id_col, y, k, seed).persist()
    folds = dealt.coalesce(max(1, -(-dealt.count() // FIT_ROWS)))

    def run(f: int) -> list[DataFrame]:
        train = folds.filter(F.col("fold") != f)
        prep = Pipeline(stages=feature_stages(train, y, [id_col])).fit(train)
        train_x = prep.transform(train).select("features", y).persist()
        test_x = prep.transform(folds.filter(F.col("fold") == f)).select("features", y)
        out = [
            est.fit(train_x).transform(test_x).select(
                F.lit(no).cast("long").alias("model_no"), F.lit(f).alias("fold"), (F.col("prediction") == F.col(y)).cast("double").alias("hit"))
            for no, (_, est) in candidates(y, trees).items() if not which or no in which
        ]
        train_x.unpersist()
        return out

    with ThreadPool(parallelism) as pool:  # folds are independent Spark jobs
        scored = [s for part in pool.map(run, range(k)) for s in part]
    per_fold = reduce(DataFrame.unionByName, scored).groupBy("model_no", "fold").agg(F.avg("hit").alias("accuracy"))
    ensure_checkpoint_dir(df.sparkSession)
    summary = cv_summary(per_fold, "model_no", "accuracy").checkpoint()
    dealt.unpersist()
    return summary


def _exists(spark, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(f"{path}/metadata")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def best_model_flow(df: DataFrame, y: str, id_col: str, which: list[int] | None = None, path: str | None = None):
    """Fit, report, pick the best by F1 and refit it on all rows; reuse a model saved at ``path``."""
    from pyspark.ml import Pipeline, PipelineModel

    from whyframe.operators.scoring import best_model

    if path is not None and _exists(df.sparkSession, path):
        return PipelineModel.load(path), None
    _, report = fit_models(df, y, id_col, which)
    no = int(best_model(report.withColumn("all", F.lit(1)), ["all"]).first()["best_model"])
    final = Pipeline(stages=feature_stages(df, y, [id_col]) + [candidates(y)[no][1]]).fit(df)
    if path is not None:
        final.write().overwrite().save(path)
    return final, report
