"""Every sink written to the shared folder and read back: the rows must be those of the source."""

from pyspark.sql import functions as F

from whyframe.core import shared_path
from whyframe.operators import models as ml
from whyframe.plans.catalog.models import customer_cases
from whyframe.plans.catalog.shared import KIND
from whyframe.plans.registry import query
from whyframe.sources import readers, writers


@query("lines_back", "SELECT trim(p_name) AS line, count(*) AS n FROM part GROUP BY 1")
def lines_back(t):
    path = shared_path(t.spark, "lines")
    writers.write_lines(t.part, "p_name", path)
    return readers.read_lines(t.spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("types_back", "SELECT DISTINCT trim(c_mktsegment) AS line FROM customer")
def types_back(t):
    """A whitelist written with outer blanks and read as stripped lines."""
    path = shared_path(t.spark, "types")
    writers.write_lines(t.customer.select(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")).alias("kind")).distinct(), "kind", path)
    return readers.read_lines(t.spark, path)


CORPUS = ["o_orderkey AS record_id", """concat('why "', o_orderstatus, '", ', o_orderpriority, '?') AS text""", "round(o_totalprice, 2) AS price"]


@query("corpus_back", f"SELECT {', '.join(CORPUS)} FROM orders WHERE o_orderkey % 4 <> 0")
def corpus_back(t):
    """A JSONL corpus of which a part replaces an older one and another is appended."""
    path = shared_path(t.spark, "corpus")
    parts = [t.orders.filter(f"o_orderkey % 4 = {i}").selectExpr(*CORPUS) for i in range(4)]
    writers.write_corpus(parts[0], path)
    writers.write_corpus(parts[1], path)
    for p in parts[2:]:
        writers.write_corpus(p, path, mode="append")
    return t.spark.read.schema(parts[0].schema).json(path)


@query("csv_back", f"SELECT {', '.join(CORPUS)} FROM orders")
def csv_back(t):
    path = shared_path(t.spark, "csv")
    rows = t.orders.selectExpr(*CORPUS)
    writers.write_corpus(rows, path, fmt="csv")
    return t.spark.read.option("header", True).schema(rows.schema).csv(path)


@query("runs_back", f"""
    SELECT {KIND} AS explanation_type, CASE o_orderkey % 2 WHEN 0 THEN 'run_a' ELSE 'run_b' END AS method, count(*) AS n, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS runs,
      CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey < 200 GROUP BY ALL""")
def runs_back(t):
    """Results of many runs in folders by type, method and run; an empty table leaves none."""
    root = shared_path(t.spark, "runs")
    rows = t.orders.filter("o_orderkey < 200").select(F.expr(KIND).alias("explanation_type"), F.expr("CASE o_orderkey % 2 WHEN 0 THEN 'run_a' ELSE 'run_b' END").alias("method"),
                                                      F.concat(F.lit("r"), F.col("o_orderkey")).alias("run_id"), "o_orderkey")
    written = writers.write_run({"results": rows, "evaluations": rows.limit(0)}, root)
    back = t.spark.read.parquet(f"{root}/{written[0]}")
    return back.groupBy("explanation_type", "method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs"), F.sum("o_orderkey").alias("keys"))


@query("parses_back", "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'unusable' ELSE 'usable' END AS kind, s_name AS line FROM supplier")
def parses_back(t):
    root = shared_path(t.spark, "parses")
    blocks = t.supplier.select("s_suppkey", F.col("s_name").alias("block"))
    writers.write_parses(blocks.filter("s_suppkey % 3 <> 0"), blocks.filter("s_suppkey % 3 = 0"), root)
    one, two = (readers.read_lines(t.spark, f"{root}/{k}").select(F.lit(k).alias("kind"), "line") for k in ("usable", "unusable"))
    return one.unionByName(two)


@query("batches_back", "SELECT CAST(c_custkey // 70 AS BIGINT) AS slice, c_custkey FROM customer")
def batches_back(t):
    """Batches of seven customers, ten to a slice, written twice as by a repeated run."""
    path = shared_path(t.spark, "batches")
    rows = t.customer.select(F.floor(F.col("c_custkey") / 7).alias("batch"), "c_custkey")
    writers.append_batches(rows, "batch", path)
    writers.append_batches(rows, "batch", path)
    return t.spark.read.json(path).select(F.col("slice").cast("long").alias("slice"), "c_custkey")


@query("model_back", "SELECT c_custkey, true AS same FROM customer")
def model_back(t):
    """The best model kept at a path: the second run finds it there and predicts the same."""
    path, data = shared_path(t.spark, "model"), customer_cases(t)
    made, report = ml.best_model_flow(data, "outcome", "c_custkey", which=[1, 2], path=path)
    kept, nothing = ml.best_model_flow(data, "outcome", "c_custkey", path=path)
    one, two = (m.transform(data).select("c_custkey", F.col("prediction").alias(n)) for m, n in ((made, "was"), (kept, "now")))
    return one.join(two, "c_custkey").select("c_custkey", ((F.col("was") == F.col("now")) & F.lit(report is not None and nothing is None)).alias("same"))
