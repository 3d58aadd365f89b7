"""Readers for cases, records, text blocks, run folders and corpora.

Readers that touch files are thin; the parsing they need works on a text
column, so the same code serves files, tables and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whyframe.functions.text import drop_unnamed, strip_bytes_repr
from whyframe.operators.frames import union_sheets

# Layout of instruction blocks and run folders.
BLOCK_END = "---------"
SINGLE_KEYS = ["Question", "Machine interpretation", "Explanation type"]
RUN_PATH = r"([^/_]+)_run_([^/_]+)_([0-9]+)/(?:([0-9]+)/)?([^/]+)$"
RATING_FILE = r"evaluation_set_[0-9]+\.[a-z]+$"


def read_cases(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header; index columns of earlier exports are dropped. Give a schema to avoid the inference pass."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return drop_unnamed(reader.csv(path))


def dataset_file(domain: str) -> str:
    """File name of a domain's dataset."""
    return "_".join(domain.lower().split(" ")) + ".csv"


def cases_from_text(df: DataFrame, line: str, schema: str) -> DataFrame:
    """Typed rows from CSV lines held in a column."""
    return df.select(F.from_csv(F.col(line), schema).alias("_r")).select("_r.*")


def block_fields(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, field, pos, value)`` of the ``field : value`` lines of each block."""
    lines = blocks.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).filter(F.contains(F.col("line"), F.lit(" : ")))
    parts = F.split(F.col("line"), " : ")
    return lines.select(key, F.trim(parts[0]).alias("field"), F.col("pos").cast("long").alias("pos"), F.trim(parts[1]).alias("value"))


def blocks_to_records(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """One row per block: single fields as text, repeated ones (Action, Feature groups) as arrays in order.

    A block is one row of bounded text, so this is a projection without shuffle.
    """
    lines = F.filter(F.split(F.col(text), "\n"), lambda ln: F.contains(ln, F.lit(" : ")))

    def values(name: str) -> Column:
        mine = F.filter(F.col("_l"), lambda ln: F.trim(F.split(ln, " : ")[0]) == name)
        return F.transform(mine, lambda ln: F.trim(F.split(ln, " : ")[1]))

    return blocks.withColumn("_l", lines).select(
        key,
        *[F.try_element_at(values(n), F.lit(-1)).alias(n.lower().replace(" ", "_")) for n in SINGLE_KEYS],
        values("Action").alias("actions"), values("Feature groups").alias("feature_groups"),
    )


def read_instruction_blocks(spark: SparkSession, path: str, compat: bool = True) -> DataFrame:
    """Records of an instruction file. ``compat`` drops a last block that is not closed by a dashed line."""
    raw = spark.read.option("lineSep", BLOCK_END + "\n").text(path).withColumn("block_id", F.monotonically_increasing_id())
    raw = raw.filter(F.trim("value") != "")
    if compat:
        # a closed block ends with the newline before its separator and holds its type line
        raw = raw.filter(F.endswith(F.col("value"), F.lit("\n")) & F.contains(F.col("value"), F.lit("Explanation type :")))
    return blocks_to_records(raw, "block_id", "value")


def pivot_records(df: DataFrame, run: str, key: str, value: str, keys: list[str]) -> DataFrame:
    """Key/value rows to one row per run; the keys are given, so no pass is spent finding them."""
    return df.groupBy(run).pivot(key, keys).agg(F.first(value))


# Keys of a stored record.
RECORD_KEYS = ["Question", "Machine interpretation", "Action", "Feature groups", "Explanation type"]


def read_records(spark: SparkSession, glob: str) -> DataFrame:
    """Transposed key/value record files, one row per run folder."""
    kv = spark.read.schema("key string, value string").option("multiLine", True).csv(glob)
    kv = kv.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run_id"), "key", "value")
    return pivot_records(kv.filter(F.col("key").isin(RECORD_KEYS)), "run_id", "key", "value", RECORD_KEYS)


def run_parts(path: Column) -> dict[str, Column]:
    """Explanation type, method, time stamp, subset and file of a path inside a run folder."""
    names = ["explanation_type", "method", "run_ts", "subset_idx", "file"]
    out = {n: F.regexp_extract(path, RUN_PATH, i + 1) for i, n in enumerate(names)}
    out["run_ts"] = out["run_ts"].try_cast("long")
    out["subset_idx"] = out["subset_idx"].try_cast("long")
    return out


def scan_runs(spark: SparkSession, root: str, file: str, schema: str) -> DataFrame:
    """All files of one name under a tree of run folders, as one table keyed by run and subset."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", file).csv(root)
    path = F.col("_metadata.file_path")
    return df.select(*[c.alias(n) for n, c in run_parts(path).items()], *df.columns)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines; lines written as encoded text are unwrapped."""
    return spark.read.text(path).select(strip_bytes_repr(F.trim("value")).alias("line"))


def utterance_parts(text: Column) -> tuple[Column, Column]:
    """Question and operations line of one record."""
    lines = F.split(text, "\n")
    return lines[0], F.try_element_at(lines, F.lit(2))


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n\n").text(path)
    q, ops = utterance_parts(F.col("value"))
    return raw.filter(F.trim("value") != "").select(q.alias("question"), ops.alias("operations"))


def question_fields(df: DataFrame, key: str, text: str, compat: bool = True) -> DataFrame:
    """``(key, pos, field, value)`` of one generated-question block.

    Leading numbers and dashes are removed; a line without ``:`` is the
    question. ``compat`` keeps only what stands between the first two colons.
    """
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    line = F.regexp_replace(F.regexp_replace(F.trim("line"), r"^([0-9]+.\s)", ""), r"^(-\s)", "")
    lines = lines.select(key, F.col("pos").cast("long").alias("pos"), line.alias("line")).filter("line <> ''")
    has = F.contains(F.col("line"), F.lit(":"))
    parts = F.split(F.col("line"), ":", -1 if compat else 2)
    return lines.select(
        key, "pos", F.when(has, F.trim(parts[0])).otherwise(F.lit("Question")).alias("field"),
        F.when(has, F.trim(F.try_element_at(parts, F.lit(2)))).otherwise(F.col("line")).alias("value"))


def read_generated_questions(spark: SparkSession, root: str, compat: bool = True) -> DataFrame:
    """Blank-line separated question blocks of all text files under a folder, with source type and sheet."""
    raw = spark.read.option("lineSep", "\n\n").option("recursiveFileLookup", True).text(root)
    path = F.col("_metadata.file_path")
    raw = raw.select(
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("source_type"),
        F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1).alias("sheet"), "value",
    ).filter(F.trim("value") != "").withColumn("block_id", F.monotonically_increasing_id())
    fields = question_fields(raw, "block_id", "value", compat)
    wide = fields.groupBy("block_id").pivot("field", ["Question", "Machine interpretation", "Action", "Explanation type", "Target variable", "Likelihood"]).agg(F.first("value"))
    return raw.select("block_id", "source_type", "sheet").join(wide, "block_id").drop("block_id")


def read_sheets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sheets exported as CSV, columns cleaned and stacked."""
    from whyframe.functions.text import rename_columns

    return union_sheets([
        rename_columns(drop_unnamed(spark.read.option("header", True).csv(p), anywhere=True)).withColumn("source_file", F.lit(p)) for p in paths])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string, instruction string, input string, output string, label string").json(path)


def first_rating_file(paths: DataFrame, folder: str, file: str) -> DataFrame:
    """The first rating file (by name) of each folder."""
    return paths.filter(F.col(file).rlike("^" + RATING_FILE)).groupBy(folder).agg(F.min(file).alias(file))


def scan_feedback(spark: SparkSession, root: str) -> DataFrame:
    """Ratings of a user study exported as CSV: one rating file per participant folder."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "evaluation_set_*").csv(root)
    path = F.col("_metadata.file_path")
    df = df.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("participant"), F.regexp_extract(path, r"([^/]+)$", 1).alias("file"), *df.columns)
    keep = first_rating_file(df.select("participant", "file").distinct(), "participant", "file")
    return drop_unnamed(df.join(keep, ["participant", "file"], "left_semi"))


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """Triples of an RDF/XML file: labels, definitions, examples, direct parents and instance types."""
    from whyframe.operators.graph import DEFINITION, EXAMPLE, LABEL, SUBCLASS, TYPE

    ref = "struct<`_rdf:resource`:string,_VALUE:string>"
    schema = ("`_rdf:about` string, `rdfs:label` array<struct<_VALUE:string>>, `skos:definition` array<struct<_VALUE:string>>, "
              f"`skos:example` array<struct<_VALUE:string>>, `rdfs:subClassOf` array<{ref}>, `rdf:type` array<{ref}>")

    def rows(tag: str) -> DataFrame:
        df = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).filter(F.col("`_rdf:about`").isNotNull())

        def texts(c: str, p: str) -> Column:
            return F.transform(F.coalesce(F.col(f"`{c}`"), F.array()), lambda v: F.struct(F.lit(p).alias("p"), v["_VALUE"].alias("o")))

        def refs(c: str, p: str) -> Column:
            return F.transform(F.coalesce(F.col(f"`{c}`"), F.array()), lambda v: F.struct(F.lit(p).alias("p"), v["_rdf:resource"].alias("o")))

        return df.select(F.col("`_rdf:about`").alias("s"), F.inline(F.concat(
            texts("rdfs:label", LABEL), texts("skos:definition", DEFINITION), texts("skos:example", EXAMPLE),
            refs("rdfs:subClassOf", SUBCLASS), refs("rdf:type", TYPE),
        ))).filter(F.col("o").isNotNull())

    return rows("owl:Class").unionByName(rows("owl:NamedIndividual"))
