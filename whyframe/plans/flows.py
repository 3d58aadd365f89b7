"""The three stages end to end, each one a batch over all records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.core import ensure_checkpoint_dir
from whyframe.functions import text as tx
from whyframe.operators import frames as fr
from whyframe.operators import interpretations as ip
from whyframe.operators import routing
from whyframe.operators.attributions import shapley
from whyframe.operators.counterfactuals import counterfactuals
from whyframe.operators.frames import seeded_sample
from whyframe.operators.groups import CELLS, dealt_groups, map_groups, stacked
from whyframe.operators.metrics import diversity, faithfulness, fitted_non_representativeness, monotonicity
from whyframe.operators.models import LogisticScore, standard_scale
from whyframe.operators.nearest import nearest_cases, whole_table_groups
from whyframe.operators.prompts import explanation_prompt, subset_prompt
from whyframe.operators.prototypes import clean, group_prototypes, prototypes
from whyframe.operators.rules import best_cut, cut_scores, rule_length, rule_text
from whyframe.operators.schema_match import AliasTable
from whyframe.operators.scoring import scorecard
from whyframe.operators.trees import TreeScore, tree_attributions

Score = LogisticScore | TreeScore

# Fields of a generated answer.
ANSWER_FIELDS = {"explanation_type": "Explanation type", "interpretation": "Machine interpretation", "action": "Action", "target": "Target variable"}


def read_answers(raw: DataFrame, line: str, text: str, types: list[str]) -> DataFrame:
    """Generated answers to records, one per question (the last answer wins)."""
    sides = raw.select(F.col(line).alias("line"), F.split(text, "### Response:").alias("s"))
    response = F.coalesce(F.try_element_at("s", F.lit(2)), F.lit(""))
    fields = {n: tx.response_field(response, k) for n, k in ANSWER_FIELDS.items()}
    fields["explanation_type"] = tx.snap_to_list(fields["explanation_type"], types)
    out = sides.select("line", tx.response_field(F.col("s")[0], "User").alias("question"), *[c.alias(n) for n, c in fields.items()])
    return fr.dedup_questions(out, "question", "line").drop("line")


def decompose(raw: DataFrame, line: str, text: str, refs: DataFrame, types: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers scored against references: matched records, unmatched ones, scorecard."""
    found = read_answers(raw, line, text, types)
    named = found.withColumnsRenamed({f: f"{f}_found" for f in found.columns if f != "question"})
    matched, unmatched = routing.match_results(named, refs)
    return matched, unmatched, scorecard(matched, {f: (f, f"{f}_found") for f in fields})


def _long(df: DataFrame, keys: list[str], explainer: str, metrics: dict[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()])
    return df.select(*keys, F.lit(explainer).alias("explainer"), F.inline(rows)).filter("value is not null")


def wide_attributions(phis: DataFrame, id_col: str, feats: list[str]) -> DataFrame:
    """``(id_col, phi_<feature>)`` from rows per feature."""
    return phis.groupBy(id_col).agg(*[F.max(F.when(F.col("feature") == f, F.col("phi"))).alias(f"phi_{f}") for f in feats])


def case_attributions(picks: DataFrame, keys: list[str], id_col: str, score: Score) -> DataFrame:
    """``(keys, id, features, phi_<feature>)``: exact attributions of each case, along the trees of a tree model, within its subset (at most ``k`` cases) otherwise."""
    feats = score.features
    if isinstance(score, TreeScore):
        found = wide_attributions(tree_attributions(picks.select(id_col, *feats).distinct(), id_col, score), id_col, feats)
        return picks.select(*keys, id_col, *[F.col(f).cast("double").alias(f) for f in feats]).join(found, id_col)
    d = len(feats)

    def run(flat, places):
        import numpy as np
        import pyarrow as pa

        from whyframe.operators.attributions import coalition_weight

        x = stacked(flat[1:], places)
        groups, n, _ = x.shape
        v = []
        for s in range(1 << d):
            on = np.array([bool(s >> i & 1) for i in range(d)])
            own = np.empty((groups, n))
            step = max(1, CELLS // (groups * n))
            for lo in range(0, n, step):
                own[:, lo:lo + step] = score.numpy(np.where(on, x[:, lo:lo + step, None, :], x[:, None, :, :])).mean(axis=2)
            v.append(own)
        out = [flat[0].take(pa.array(places.ravel()))]
        for i in range(d):
            phi = sum(coalition_weight(s.bit_count(), d) * (v[s | 1 << i] - v[s]) for s in range(1 << d) if not s >> i & 1)
            out += [pa.array(x[:, :, i].ravel(), from_pandas=True), pa.array(phi.ravel(), from_pandas=True)]
        return np.repeat(np.arange(groups), n), out

    kinds = {id_col: picks.schema[id_col].dataType.simpleString()} | {name: "double" for f in feats for name in (f, f"phi_{f}")}
    return map_groups(picks, keys, {id_col: F.col(id_col)} | {f"x{i}": F.col(f).cast("double") for i, f in enumerate(feats)}, run, kinds)


def attribution_report(explained: DataFrame, keys: list[str], score: Score) -> tuple[DataFrame, DataFrame]:
    """Mean absolute attribution ``(keys, feature, importance)`` and ``(keys, faithfulness, monotonicity)`` of explained cases.

    The metrics take each case's attributions for its predicted class; cases without a faithfulness don't count in its mean.
    """
    feats = score.features
    means = explained.groupBy(*keys).agg(*[F.avg(F.abs(f"phi_{f}")).alias(f) for f in feats])
    importance = means.select(*keys, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in feats])))
    own = {f: F.when(score.column() >= 0.5, F.col(f"phi_{f}")).otherwise(-F.col(f"phi_{f}")) for f in feats}
    scored = monotonicity(faithfulness(explained, score, own), score, own)
    return importance, scored.groupBy(*keys).agg(F.avg("faithfulness").alias("faithfulness"), F.avg(F.col("monotone").cast("double")).alias("monotonicity"))


def group_rules(picks: DataFrame, keys: list[str], score: Score) -> DataFrame:
    """Best single cut explaining the model's predictions within each selected subset (at most ``k`` cases).

    By precision, then coverage, then the earlier feature, the smaller edge, ``below`` and label 0.
    """
    feats = score.features

    def run(flat, places):
        import numpy as np
        import pyarrow as pa

        x = stacked(flat, places)
        groups, n, d = x.shape
        said = score.numpy(x.reshape(-1, d)).reshape(groups, n) >= 0.5
        edges, hits, agreeing = np.empty((groups, d, n)), np.empty((groups, d, n, 2, 1), int), np.empty((groups, d, n, 2, 2), int)
        for i in range(d):
            order = np.argsort(x[:, :, i], axis=1, kind="stable")
            edge = edges[:, i] = np.take_along_axis(x[:, :, i], order, 1)
            # rows below an edge are those before the first of its value
            new = np.concatenate([np.ones((groups, 1), bool), edge[:, 1:] != edge[:, :-1]], axis=1)
            below = np.maximum.accumulate(np.where(new, np.arange(n), 0), axis=1)
            running = np.concatenate([np.zeros((groups, 1), int), np.cumsum(np.take_along_axis(said, order, 1), axis=1)], axis=1)
            positive = np.take_along_axis(running, below, 1)
            for side, (covered, pos) in enumerate(((below, positive), (n - below, running[:, -1:] - positive))):
                hits[:, i, :, side, 0], agreeing[:, i, :, side, 0], agreeing[:, i, :, side, 1] = covered, covered - pos, pos
        precision = np.where(hits > 0, agreeing / np.maximum(hits, 1), -1.0)
        best = precision == precision.max(axis=(1, 2, 3, 4), keepdims=True)
        covered = np.where(best, hits, -1)
        best &= covered == covered.max(axis=(1, 2, 3, 4), keepdims=True)
        every = np.arange(groups)
        feature = best.any(axis=(2, 3, 4)).argmax(axis=1)
        best, edge = best[every, feature], edges[every, feature]
        low = np.where(best.any(axis=(2, 3)), edge, np.inf).min(axis=1)
        best &= (edge == low[:, None])[:, :, None, None]
        pick = best.reshape(groups, -1).argmax(axis=1)
        side, label = np.unravel_index(best.any(axis=1).reshape(groups, -1).argmax(axis=1), (2, 2))
        fidelity = agreeing[every, feature].reshape(groups, -1)[every, pick] / n
        lines = [rule_text([(feats[f], float("-inf"), c) if s == 0 else (feats[f], c, float("inf"))], str(a))
                 for f, c, s, a in zip(feature.tolist(), low.tolist(), side.tolist(), label.tolist(), strict=True)]
        return every, [pa.array(lines, pa.string()), pa.array(fidelity)]

    return map_groups(picks, keys, {f"x{i}": F.col(f).cast("double") for i, f in enumerate(feats)}, run, {"rule": "string", "fidelity": "double"})


def chosen_evaluators(methods: DataFrame, implemented: list[str], modality_metrics: DataFrame) -> set[tuple[str, str]]:
    """``(explainer, evaluator)``: an explainer's modality names its metrics, and an evaluator is used when all its metrics are named."""
    names = F.array(*[F.lit(n) for n in implemented])
    found = methods.select("modality", F.explode(F.filter(names, lambda n: F.contains(n, F.lower(F.col("instance"))))).alias("explainer")).distinct()
    metrics = routing.explainer_metrics(found, modality_metrics)
    return {(r[0], r[1]) for r in routing.route_evaluator(metrics, "explainer").collect()}  # at most explainers x evaluators


def _report(keys: list[str], id_col: str, cases: DataFrame, score: Score, label: str, most: int,
            protos: DataFrame, flips: DataFrame, explained: DataFrame, rules: DataFrame, chosen: set[tuple[str, str]] | None = None,
            sizes: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Results and evaluations in long form from each explainer's output by ``keys``, at most ``most`` cases each; ``chosen`` evaluators only.

    ``sizes`` says about how many rows an explainer's cases are; those of an explainer that isn't in it are few.
    """
    feats, sizes = score.features, sizes or {}
    proto_rows = dealt_groups(protos.join(cases, id_col), keys, sizes.get("run_protodash", 0))
    vec = F.array(*[F.col(f).cast("double") for f in [*feats, "weight"]])
    proto_div = diversity(proto_rows, keys, id_col, vec, max_group=most)
    proto_rep = fitted_non_representativeness(proto_rows, keys, id_col, feats, label)

    moved = {f: F.col(f"cf_{f}") for f in feats}
    dealt_flips = dealt_groups(flips, keys, sizes.get("run_dice", 0))
    dice_div = diversity(dealt_flips, keys, id_col, F.array(*moved.values()), max_group=most)
    flipped = dealt_flips.withColumn("flipped", (score.column(moved) >= 0.5).cast("int"))
    dice_rep = fitted_non_representativeness(flipped, keys, id_col, [f"cf_{f}" for f in feats], "flipped")
    importance, attributed = attribution_report(explained, keys, score)

    def item(df: DataFrame, explainer: str, name: Column, content: Column) -> DataFrame:
        return df.select(*keys, F.lit(explainer).alias("explainer"), name.cast("string").alias("item"), content.alias("content"))

    results = (
        item(protos, "run_protodash", F.col(id_col), F.format_string("weight %.2f", "weight"))
        .unionByName(item(flips, "run_dice", F.col(id_col), F.concat_ws(", ", *[F.format_string(f"{f}=%.2f", f"cf_{f}") for f in feats])))
        .unionByName(item(importance, "run_shap", F.col("feature"), F.format_string("%.6f", "importance")))
        .unionByName(item(rules, "run_rulexai", F.lit("rule"), F.col("rule")))
    )
    scored = {
        ("run_protodash", "diversity"): lambda: _long(proto_div, keys, "run_protodash", {"Diversity": F.col("diversity")}),
        ("run_protodash", "non_representativeness"): lambda: _long(proto_rep, keys, "run_protodash", {"Non representativeness": F.col("non_representativeness")}),
        ("run_dice", "diversity"): lambda: _long(dice_div, keys, "run_dice", {"Diversity": F.col("diversity")}),
        ("run_dice", "non_representativeness"): lambda: _long(dice_rep, keys, "run_dice", {"Non representativeness": F.col("non_representativeness")}),
        ("run_shap", "monotonicity_and_faithfulness"): lambda: _long(attributed, keys, "run_shap", {"Faithfulness": F.col("faithfulness"), "Monotonicity": F.col("monotonicity")}),
        ("run_rulexai", "average_rule_length_and_fidelity"): lambda: _long(
            rules, keys, "run_rulexai", {"Average rule length": rule_length(F.col("rule")), "Fidelity": F.col("fidelity")}),
    }
    made = [build() for pair, build in scored.items() if chosen is None or pair in chosen]
    evaluations = reduce(DataFrame.unionByName, made) if made else _long(rules, keys, "run_rulexai", {"Fidelity": F.col("fidelity")}).limit(0)
    return results, evaluations


def whole_table_report(cases: DataFrame, id_col: str, score: Score, label: str, m: int = 5, n_explained: int = 10,
                       chosen: set[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """``_report`` of every explainer run once on the whole table, keyed by ``scope``.

    ``m`` prototypes of all cases, the best single cut of all predictions, and attributions and counterfactuals of a seeded sample of
    ``n_explained`` cases, attributed against all cases.
    """
    feats, keys = score.features, ["scope"]
    scope = F.lit("table").alias("scope")
    spark = cases.sparkSession
    table = cases.select(id_col, *[c.alias(f) for f, c in zip(feats, clean(cases, feats), strict=True)])
    protos = prototypes(standard_scale(table, feats), id_col, feats, m).select(scope, id_col, "weight")
    sample = seeded_sample(table, id_col, n_explained, 9).checkpoint()
    flips = counterfactuals(sample, cases, id_col, score).withColumn("scope", scope)
    found = tree_attributions(sample, id_col, score) if isinstance(score, TreeScore) else shapley(table, sample, id_col, score)
    phis = wide_attributions(found, id_col, feats)
    cuts = best_cut(cut_scores(table.withColumn("y", (score.column() >= 0.5).cast("int")), feats, "y"))
    top = cuts.orderBy(F.desc(F.round("precision", 9)), F.desc("covered"), "feature", "side", "edge").first()
    found = []
    if top:
        span = (float("-inf"), top["edge"]) if top["side"] == "below" else (top["edge"], float("inf"))
        found = [("table", rule_text([(top["feature"], *span)], str(top["label"])), top["precision"] * top["coverage"])]
    rules = spark.createDataFrame(found, "scope string, rule string, fidelity double")
    return _report(keys, id_col, cases, score, label, max(m, n_explained), protos, flips, sample.join(phis, id_col).withColumn("scope", scope), rules, chosen)


def delegate(records: DataFrame, cases: DataFrame, id_col: str, columns: list[str], methods: DataFrame, implemented: list[str],
             score: Score, label: str, types: list[str], k: int = 10, m: int = 5, n_explained: int = 10,
             modality_metrics: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse, route and explain all records at once.

    Returns results ``(record_id, group_idx, explainer, item, content)`` and
    evaluations ``(record_id, group_idx, explainer, metric, value)``. Groups that
    pick the same cases share a signature: each explainer is one plan over the
    distinct signatures routed to it, and a table of signatures links the
    records to their results. A group that no feature narrows gets the results
    of the whole table, which are computed once for all such groups. With
    ``modality_metrics(modality, metric)`` an explainer is scored by the
    evaluators whose metrics its modality names, otherwise by all of its own.
    """
    keys = ["record_id", "group_idx"]
    ensure_checkpoint_dir(cases.sparkSession)
    chosen = chosen_evaluators(methods, implemented, modality_metrics) if modality_metrics is not None else None
    parsed, _ = ip.usable(ip.parse_interpretations(records, columns), types)
    # the parse is the dearest pass over the records and is read four times
    parsed = parsed.checkpoint()
    routes = routing.route_explainer(parsed.select("record_id", "explanation_type"), methods, implemented).select("record_id", "explainer")
    groups = ip.long_groups(parsed, ["record_id"])
    picks = nearest_cases(cases, groups, k, id_col)
    # at most k ids a group
    picked = picks.groupBy(*keys).agg(F.sort_array(F.collect_list(id_col)).alias("ids")).withColumn("signature", F.md5(F.concat_ws(",", F.col("ids").cast("array<string>"))))
    links = picked.join(routes, "record_id").select(*keys, "explainer", "signature", "ids").checkpoint()
    own = ["signature"]
    wanted = links.groupBy("signature", "explainer").agg(F.first("ids").alias("ids")).select("signature", "explainer", F.explode("ids").alias(id_col))
    # every explainer reads the routed cases, so they are written once
    rows = wanted.join(cases, id_col).checkpoint()
    sizes = {r[0]: r[1] for r in rows.groupBy("explainer").count().collect()}  # one row an explainer

    def wanted_rows(name: str) -> DataFrame:
        return rows.filter(F.col("explainer") == name)

    feats = score.features

    scaled = standard_scale(cases.select(id_col, *[F.col(f).cast("double").alias(f) for f in feats]), feats)
    near = wanted_rows("run_protodash").select(*own, id_col).join(scaled, id_col)
    protos = group_prototypes(dealt_groups(near, own, sizes.get("run_protodash", 0)), own, id_col, feats, m).checkpoint()
    asked = wanted_rows("run_dice")
    flips = counterfactuals(dealt_groups(asked.select(id_col, *feats), [id_col], sizes.get("run_dice", 0)).distinct(), cases, id_col, score)
    # both evaluators read them
    dice = asked.select(*own, id_col).join(flips, id_col).checkpoint()
    explained = case_attributions(dealt_groups(wanted_rows("run_shap"), own, sizes.get("run_shap", 0)), own, id_col, score)
    rules = group_rules(dealt_groups(wanted_rows("run_rulexai"), own, sizes.get("run_rulexai", 0)), own, score)
    parts = _report(own, id_col, cases, score, label, k, protos, dice, explained, rules, chosen, sizes)
    named = links.drop("ids")
    parts = tuple(named.join(p, ["signature", "explainer"]).select(*keys, *[c for c in p.columns if c != "signature"]) for p in parts)

    whole = whole_table_groups(cases, groups, id_col).join(routes, "record_id").checkpoint()
    if whole.isEmpty():
        return parts
    # at most m + n_explained + one row per feature and metric stand for the table, whatever its size
    tables = whole_table_report(cases, id_col, score, label, m, n_explained, chosen)
    return tuple(p.unionByName(whole.join(F.broadcast(t.drop("scope")), "explainer")) for p, t in zip(parts, tables, strict=True))


def synthesize(assembled: DataFrame, result_cols: list[str], columns: list[str], outcome: str = "Outcome") -> DataFrame:
    """Prompts per kept (run, subset): subsets cut to the groups, equal results dropped, patient-only groups left out.

    Adds ``group_text``, ``subset_prompt`` and ``prompt``.
    """
    kept = fr.truncate_to_groups(assembled, "subset_idx", "group_maps")
    kept = fr.dedup_frames(kept, "run_id", "subset_idx", result_cols)
    kept = fr.drop_patient_only(kept.withColumn("group_map", F.get("group_maps", F.col("subset_idx"))))
    group = F.array_join(F.transform(F.map_entries("group_map"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    kept = kept.withColumn("group_text", F.when(routing.needs_question(), F.col("question")).otherwise(group))
    return kept.withColumns({
        "subset_prompt": subset_prompt(F.col("group_text"), F.col("question"), outcome),
        "prompt": explanation_prompt(F.col("explanation_type"), F.col("definition"), AliasTable(columns).in_text(F.col("question"))),
    })
