"""Route records to explainers and metrics, and assemble prompt records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_results(results: DataFrame, refs: DataFrame, question: str = "question") -> tuple[DataFrame, DataFrame]:
    """Join generated records with references on the question (backslashes ignored): matched, unmatched."""
    r = results.withColumn("_q", F.translate(question, "\\", "")).drop(question)
    matched = refs.join(r, refs[question] == r["_q"], "inner").drop("_q")
    unmatched = results.withColumn("_q", F.translate(question, "\\", "")).join(
        refs.select(F.col(question).alias("_rq")), F.col("_q") == F.col("_rq"), "left_anti").drop("_q")
    return matched, unmatched


def route_explainer(records: DataFrame, methods: DataFrame, implemented: list[str]) -> DataFrame:
    """Record type -> method instances -> implemented explainers whose name contains the instance name.

    The registry of implemented explainers is code, so it joins as constants.
    """
    names = F.array(*[F.lit(n) for n in implemented])
    hits = F.filter(names, lambda n: F.contains(n, F.lower(F.col("instance"))))
    return records.join(methods, "explanation_type").select(*records.columns, "instance", F.explode(hits).alias("explainer"))


def explainer_metrics(methods: DataFrame, modality_metrics: DataFrame) -> DataFrame:
    """Explainer -> modality -> metrics (names compared without case and outer blanks)."""
    m = methods.withColumn("_m", F.lower(F.trim("modality")))
    q = modality_metrics.select(F.lower(F.trim("modality")).alias("_m"), "metric")
    return m.join(q, "_m").drop("_m")


# Evaluators and the metrics each one scores together.
EVALUATORS = {
    "average_rule_length_and_fidelity": ["average rule length", "fidelity"],
    "non_representativeness": ["non representativeness"],
    "diversity": ["diversity"],
    "monotonicity_and_faithfulness": ["monotonicity", "faithfulness"],
}


def route_evaluator(df: DataFrame, key: str, metric: str = "metric", registry: dict[str, list[str]] | None = None) -> DataFrame:
    """Evaluators all of whose metrics are asked for, per key."""
    registry = registry or EVALUATORS
    asked = df.groupBy(key).agg(*[
        F.max(F.when(F.lower(F.trim(metric)) == m, F.lit(True)).otherwise(F.lit(False))).alias(f"has {m}")
        for m in sorted({m for ms in registry.values() for m in ms})
    ])
    rows = F.array_compact(F.array(*[
        F.when(F.forall(F.array(*[F.col(f"has {m}") for m in ms]), lambda h: h), F.lit(name)) for name, ms in registry.items()
    ]))
    return asked.select(key, F.explode(rows).alias("evaluator"))


# Fixed value: the only type whose original cases are shown beside the results.
WITH_ORIGINALS = "Counterfactual Explanation"


def assemble_prompts(records: DataFrame, definitions: DataFrame, modality: DataFrame, results: DataFrame,
                     evaluations: DataFrame, subsets: DataFrame, originals: DataFrame) -> DataFrame:
    """One row per (run, subset) with everything a prompt needs.

    The inputs keyed by (run_id, subset_idx) share that partitioning, so they
    shuffle once each; dimension tables are left to the optimizer's size check.
    """
    key = ["run_id", "subset_idx"]
    body = (
        results.join(subsets, key, "left").join(evaluations, key, "left").join(originals, key, "left")
    )
    return (
        records.join(definitions, "explanation_type", "left").join(modality, "explainer", "left")
        .join(body, "run_id", "inner")
        .withColumn("original", F.when(F.col("explanation_type") == WITH_ORIGINALS, F.col("original")))
    )


def needs_question(modality: str = "modality", kind: str = "explanation_type"):
    """Representative samples of a data explanation are phrased with the question."""
    return F.coalesce((F.col(modality) == "Representative Samples") & (F.col(kind) == "Data Explanation"), F.lit(False))
