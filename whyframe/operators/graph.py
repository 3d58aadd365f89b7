"""Class hierarchies held as triples ``(s, p, o)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.core import ensure_checkpoint_dir
from whyframe.functions.text import quoted, spread, uri_label

# Public vocabulary terms.
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
DEFINITION = "http://www.w3.org/2004/02/skos/core#definition"
EXAMPLE = "http://www.w3.org/2004/02/skos/core#example"


def to_triples(df: DataFrame, subject: Column, properties: dict[str, Column]) -> DataFrame:
    """One triple per non-null property of each row."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), c.cast("string").alias("o")) for p, c in properties.items()])
    return df.select(subject.alias("s"), F.inline(pairs)).filter(F.col("o").isNotNull())


def objects(triples: DataFrame, prop: str, name: str = "o") -> DataFrame:
    return triples.filter(F.col("p") == prop).select("s", F.col("o").alias(name))


def classes_by_label(triples: DataFrame, label: str) -> DataFrame:
    """The class carrying the label (ignoring case); the first one when several do."""
    return objects(triples, LABEL, "label").filter(F.lower(F.trim("label")) == label.lower()).agg(F.min("s").alias("s"))


def descendants(edges: DataFrame, root: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, depth)`` reachable from the root rows through ``edges(child, parent)``, at their least depth.

    By doubling: the pairs that are exactly one step apart give those two steps apart, these those four apart, and so on (in a tree no
    more pairs than nodes each time). Any depth is a sum of such steps, so the root then takes the longest ones first. The number of
    rounds grows with the logarithm of the depth; each is written to the shared folder. Cycles end as no least depth reaches the
    number of nodes.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    hops = [edges.select(F.col("parent").alias("top"), F.col("child").alias("node")).filter("top is not null and node is not null").distinct().checkpoint()]
    most = hops[0].select("node").distinct().count() if max_depth is None else max_depth
    while 2 << (len(hops) - 1) <= most:
        near = hops[-1].withColumnRenamed("node", "middle")
        further = near.join(hops[-1].withColumnRenamed("top", "middle"), "middle").select("top", "node").distinct().checkpoint()
        if further.isEmpty():
            break
        hops.append(further)
    reached = root.select(F.col(root.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0).cast("long")).checkpoint()
    for k in reversed(range(len(hops))):
        steps = reached.withColumnRenamed("node", "top").join(hops[k], "top").select("node", (F.col("depth") + (1 << k)).alias("depth"))
        reached = reached.unionByName(steps).groupBy("node").agg(F.min("depth").alias("depth")).checkpoint()
    return reached.filter("depth > 0") if max_depth is None else reached.filter((F.col("depth") > 0) & (F.col("depth") <= max_depth))


def children_of_named(edges: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """Nodes one of whose parents has a name containing the text."""
    hit = names.filter(F.contains("name", F.lit(text))).select(F.col("node").alias("parent"))
    return edges.join(hit, "parent", "left_semi").select("child").distinct()


def property_value(nodes: DataFrame, triples: DataFrame, prop: str) -> DataFrame:
    """First value of the property per node, empty text without one."""
    first = objects(triples, prop).groupBy("s").agg(F.min("o").alias("o"))
    return nodes.join(first, "s", "left").select("s", F.coalesce("o", F.lit("")).alias("value"))


def definitions(types: DataFrame, triples: DataFrame) -> DataFrame:
    """``(label, definition)`` for each distinct explanation type label."""
    label = objects(triples, LABEL, "label")
    text = objects(triples, DEFINITION, "definition").groupBy("s").agg(F.min("definition").alias("definition"))
    known = label.join(text, "s", "left").groupBy("label").agg(F.min("definition").alias("definition"))
    return types.select("label").distinct().join(known, "label", "left").select(
        "label", F.coalesce("definition", F.lit("")).alias("definition"))


def mine_questions(nodes: DataFrame, triples: DataFrame, first_only: bool = False) -> DataFrame:
    """``(explanation, question)``: quoted sentences in the examples of the given classes."""
    label = objects(triples, LABEL, "explanation").groupBy("s").agg(F.min("explanation").alias("explanation"))
    examples = objects(triples, EXAMPLE, "example")
    if first_only:
        examples = examples.groupBy("s").agg(F.min("example").alias("example"))
    found = nodes.select("s").join(examples, "s").join(label, "s", "left")
    return spread(found, [F.coalesce("explanation", F.lit("")).alias("explanation")], quoted(F.col("example")), "question")


def mine_questions_below(triples: DataFrame, root_label: str, first_only: bool = False) -> DataFrame:
    """The questions of all classes below the class with the label, at any depth."""
    edges = objects(triples, SUBCLASS, "parent").withColumnRenamed("s", "child")
    below = descendants(edges, classes_by_label(triples, root_label).filter("s is not null"))
    return mine_questions(below.select(F.col("node").alias("s")), triples, first_only)


def instances_of(triples: DataFrame, label: str) -> DataFrame:
    """Instances of the classes with a given label, with their display label."""
    classes = objects(triples, LABEL, "label").filter(F.col("label") == label).select(F.col("s").alias("cls"))
    inst = objects(triples, TYPE, "cls").join(classes, "cls", "left_semi").select("s")
    return inst.distinct().select(F.col("s").alias("instance"), uri_label(F.col("s"), split=False).alias("name"))


def method_modality_metric(triples: DataFrame, uses: str, measured: str) -> DataFrame:
    """``(method, modality, metric)`` through method -uses-> modality -measured-> metric."""
    m = objects(triples, uses, "modality").withColumnRenamed("s", "method")
    q = objects(triples, measured, "metric").withColumnRenamed("s", "modality")
    return m.join(q, "modality").select("method", "modality", "metric").distinct()
