"""Prompt rendering, training corpora and evaluation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.functions.text import add_empty, chunk, render
from whyframe.operators.frames import seeded_sample
from whyframe.operators.scoring import numbered_concat, run_metrics

# Layout of training records and wording of the prompts.
TASK = "Question: {question}\n"
ANSWER = "Machine interpretation: {parse}\nAction: {action}\nExplanation type: {explanation type}\nTarget variable: {target variable}\n"
RECORD = "### System:\n{instruction}\n\n### User:\n{user}\n\n### Response:\n{response}\n\n"
SUBSET_PROMPT = ("Find a match in the data based on feature group: {feature_group}. \nContext: The outcome variable is {outcome_variable}.\n"
                 "If there are no full matches, summarize the dataset.")
EXPLANATION_PROMPT = ("Summarize the data in English. Structure your response based on the expected format for: "
                      "{Explanation_Type} being that {Definition}.")
QUESTION_NOTE = "If features from question which are: {columns} in dataframe, tailor your answers to them."
RESULT_NOTES = {
    "Counterfactual Explanation": "The dataframe contains changes and not actual values.",
    "Rationale Explanation": "The dataframe contains rules derived for classification. Summarize them.",
}
USER_STUDY_COLUMNS = ["The explanation is sufficiently complete.", "The explanation is clear.", "Comments"]

GENERATION_PROMPT = """Write 20 new questions that call for a {explanation}. Known ones of this kind:
{questions}
A question may use these features:
{features}
It asks about {prediction}. Values lie in these ranges: {feature_ranges}
Add to each question its predicates, the action it asks for, its kind ({explanation}), the outcome meant and whether that outcome is likely."""
PAGE = 1000  # positions a page of a report holds


def build_corpus(df: DataFrame, instruction: str) -> DataFrame:
    """``text, instruction, input, output, label`` records from question rows; a missing action is empty."""
    answer = render(ANSWER, **{"parse": F.col("interpretation"), "action": F.col("action"), "explanation type": F.col("explanation_type"),
                               "target variable": F.col("target")})
    out = df.withColumns({"_user": render(TASK, question=F.col("question")), "_answer": answer})
    text = render(RECORD, instruction=F.lit(instruction), user=F.col("_user"), response=F.col("_answer"))
    return out.select(
        *[c for c in df.columns if c.endswith("_id")], text.alias("text"), F.lit(instruction).alias("instruction"),
        F.col("question").alias("input"), F.col("_answer").alias("output"), F.col("explanation_type").alias("label"))


def inference_prompt(instruction: Column, question: Column, output: Column | None = None) -> Column:
    """Prompt of one stored record; its answer is included only for training."""
    return render(RECORD, instruction=instruction, user=F.trim(question), response=F.lit("") if output is None else output)


def explanation_prompt(kind: Column, definition: Column, columns: Column | None = None) -> Column:
    """Prompt for the result of an explainer, with the columns its question names and a note on the kind of result."""
    parts = [render(EXPLANATION_PROMPT, Explanation_Type=kind, Definition=definition)]
    if columns is not None:
        parts.append(F.when(F.size(columns) > 0, render(QUESTION_NOTE, columns=F.array_join(columns, ", "))).otherwise(F.lit("")))
    note = F.lit("")
    for name, text in RESULT_NOTES.items():
        note = F.when(kind == name, F.lit(text)).otherwise(note)
    return F.concat(*parts, note)


def subset_prompt(group: Column, question: Column, outcome: str) -> Column:
    """Ask for the rows of a feature group; an empty group falls back on the question."""
    asked = F.when(F.coalesce(group, F.lit("")) == "", question).otherwise(group)
    return render(SUBSET_PROMPT, feature_group=asked, outcome_variable=F.lit(outcome))


def generation_prompt(kind: Column, questions: Column, features: list[str], prediction: str, ranges: Column) -> Column:
    return render(GENERATION_PROMPT, explanation=kind, questions=F.array_join(questions, "\n"), features=F.lit("\n".join(features)),
                  prediction=F.lit(prediction), feature_ranges=F.array_join(ranges, "\n"))


def f1_line(field: Column, f1: Column, precision: Column, recall: Column) -> Column:
    """One printed score line."""
    pct = [F.round(c * 100, 2).cast("string") for c in (f1, precision, recall)]
    return render("{field}, F1: {f}%, Precision: {p}% and Recall: {r}%", field=field, f=pct[0], p=pct[1], r=pct[2])


def group_report(df: DataFrame, run: str, group: str, subset: str, explanation: str, page: int = PAGE) -> DataFrame:
    """Text report of a run: one block per group, in group order, in pages of ``page`` groups."""
    block = render("Group {g}\nMatched subset {s}\nExplainer explanation {e}\n---------\n", g=F.col(group), s=F.col(subset), e=F.col(explanation))
    rows = df.select(F.col(run), F.floor(F.col(group) / page).cast("long").alias("page"), F.struct(F.col(group).alias("g"), block.alias("b")).alias("r"))
    return rows.groupBy(run, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["b"]), "").alias("report"))


def eval_records(df: DataFrame, size: int = 200, context_size: int | None = None) -> DataFrame:
    """Two rows per subset (subset text, result text) with their contexts cut into chunks.

    Contexts are whole by default; ``context_size`` limits them to a model's window.
    """
    def cut(c: Column) -> Column:
        return chunk(c if context_size is None else F.substr(c, F.lit(1), F.lit(context_size)), size)

    rows = F.array(
        F.struct(F.lit("subset").alias("part"), F.col("subset_answer").alias("answer"), F.col("subset_text").alias("context")),
        F.struct(F.lit("result").alias("part"), F.col("result_answer").alias("answer"), F.col("result_text").alias("context")),
    )
    return df.select("run_id", "subset_idx", "explanation_type", "question", F.inline(rows)).select(
        "run_id", "subset_idx", "part", "explanation_type", "answer", "question", cut(F.col("context")).alias("contexts"))


def human_eval_set(records: DataFrame, explanations: DataFrame, evaluations: DataFrame, n: int = 15, seed: int = 11) -> DataFrame:
    """Sampled runs with question, groups, numbered explanations, mean metrics and empty rating columns."""
    runs = seeded_sample(records, "run_id", n, seed)
    mine = explanations.join(runs.select("run_id"), "run_id", "left_semi")
    subset = numbered_concat(mine, "run_id", "subset_idx", "subset_text").withColumnRenamed("report", "matched_subset")
    result = numbered_concat(mine, "run_id", "subset_idx", "result_text").withColumnRenamed("report", "explainer_output")
    scores = run_metrics(evaluations.join(runs.select("run_id"), "run_id", "left_semi")).groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "metric", F.format_string("%.2f", "value")))), ";").alias("metrics"))
    out = runs.join(subset, "run_id", "left").join(result, ["run_id", "page"], "left").join(scores, "run_id", "left")
    return add_empty(out, USER_STUDY_COLUMNS)
