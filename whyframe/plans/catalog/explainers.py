"""Prototypes, attributions, counterfactuals, rules and the batched run of all of them."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from whyframe.operators import attributions as at
from whyframe.operators import counterfactuals as cf
from whyframe.operators import prototypes as pt
from whyframe.operators import rules as rl
from whyframe.operators import models as ml
from whyframe.operators.frames import seeded_sample
from whyframe.operators.models import LogisticScore
from whyframe.operators.trees import TreeScore, plain_tree, tree_attributions
from whyframe.operators.trees import tree_score as fitted_score
from whyframe.plans import flows
from whyframe.plans.catalog.models import LINE_SCORE, customer_cases
from whyframe.plans.catalog.selection import mix_sql
from whyframe.plans.catalog.shared import CASE_COLUMNS, IMPLEMENTED, KIND, METHODS, MODALITY_METRICS, TYPES, cases, interpretations, values
from whyframe.plans.registry import query

FEATS = LINE_SCORE.features
PART_SCORE = LogisticScore({"p_size": 0.06, "p_retailprice": 0.002, "name_len": -0.15}, -2.6)


def part_means(t):
    """Mean line item of every part: one keyed case per part."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("case_id")).agg(*[F.avg(f).alias(f) for f in FEATS])


PART_MEANS = "(SELECT l_partkey AS case_id, " + ", ".join(f"avg({f}) AS {f}" for f in FEATS) + " FROM lineitem GROUP BY l_partkey)"


def shapley_sql(n: int, seed: int) -> str:
    d = len(FEATS)
    mixed = {f: f"CASE WHEN (m & {1 << i}) > 0 THEN i.{f} ELSE b.{f} END" for i, f in enumerate(FEATS)}
    phi = " UNION ALL ".join(
        f"SELECT a.case_id, '{f}' AS feature, sum((b.v - a.v) * w.w) AS phi FROM v a JOIN v b ON a.case_id = b.case_id AND b.m = a.m + {1 << i} "
        f"JOIN w ON w.m = a.m WHERE (a.m & {1 << i}) = 0 GROUP BY a.case_id" for i, f in enumerate(FEATS))
    weights = ", ".join(f"({s}, {at.coalition_weight(s.bit_count(), d) if s != (1 << d) - 1 else 0.0!r}::DOUBLE)" for s in range(1 << d))
    return f"""
    WITH i AS (SELECT * FROM {PART_MEANS} ORDER BY {mix_sql('case_id', seed)}, case_id LIMIT {n}),
    v AS (SELECT i.case_id, m, avg({LINE_SCORE.sql(mixed)}) AS v FROM i, lineitem b, range({1 << d}) r(m) GROUP BY i.case_id, m),
    w AS (SELECT * FROM (VALUES {weights}) t(m, w)), phi AS ({phi})"""


@query("shapley_exact", shapley_sql(10, 4) + " SELECT feature, round(avg(abs(phi)), 6) AS importance FROM phi GROUP BY feature")
def shapley_exact(t):
    """Mean absolute attribution over ten sampled cases against all line items."""
    phis = at.shapley(t.lineitem, seeded_sample(part_means(t), "case_id", 10, 4), "case_id", LINE_SCORE)
    return at.rank_importance(phis).select("feature", F.round(F.col("importance")[1], 6).alias("importance"))


@query("shapley_single", shapley_sql(1, 8) + " SELECT case_id, feature, round(phi, 6) AS phi FROM phi")
def shapley_single(t):
    phis = at.shapley(t.lineitem, seeded_sample(part_means(t), "case_id", 1, 8), "case_id", LINE_SCORE)
    return phis.withColumn("phi", F.round("phi", 6))


@query("rank_importance", """
    SELECT l_returnflag AS feature, round(avg(abs(l_discount - l_tax)), 6) AS class_0, round(avg(abs(l_discount - l_tax)), 6) AS class_1 FROM lineitem GROUP BY 1""")
def rank_importance(t):
    out = at.rank_importance(t.lineitem.select(F.col("l_returnflag").alias("feature"), (F.col("l_discount") - F.col("l_tax")).alias("phi")))
    return out.select("feature", F.round(F.col("importance")[0], 6).alias("class_0"), F.round(F.col("importance")[1], 6).alias("class_1"))


# A declared tree model: (feature, cut, left, right), left where the value is at most the cut; numbers are probabilities of class 1.
LINE_FOREST = TreeScore(tuple(FEATS), tuple(plain_tree(FEATS, spec) for spec in (
    ("l_quantity", 25.0, ("l_discount", 0.05, 0.35, 0.1), ("l_tax", 0.04, 0.55, ("l_quantity", 40.0, 0.7, 0.95))),
    ("l_extendedprice", 30000.0, ("l_tax", 0.02, 0.2, 0.4), ("l_discount", 0.07, ("l_extendedprice", 60000.0, 0.6, 0.9), 0.3)),
    ("l_tax", 0.05, ("l_quantity", 10.0, 0.15, ("l_discount", 0.02, 0.65, 0.45)), 0.8))), (0.0,) * len(FEATS))


@query("tree_score", f"""
    SELECT l_linenumber, count(*) AS n, round(avg(p), 6) AS mean_score, count(*) FILTER (p >= 0.5) AS n_positive FROM (SELECT l_linenumber, {LINE_FOREST.sql()} AS p FROM lineitem) GROUP BY 1""")
def tree_score(t):
    """Scores of a declared tree ensemble over all line items."""
    p = t.lineitem.select("l_linenumber", LINE_FOREST.column().alias("p"))
    return p.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_score"), F.count_if(F.col("p") >= 0.5).alias("n_positive"))


def tree_shap_sql() -> str:
    """Attributions along the trees by listing all coalitions: an unknown feature's steps weigh as the rows that went each way."""
    d = len(FEATS)
    covers, values = [], []
    for t, tree in enumerate(LINE_FOREST.trees):
        reached: dict[int, list[str]] = {0: []}
        for node in range(len(tree.feature)):  # preorder: a node comes before its children
            covers.append(f"count(*) FILTER ({' AND '.join(reached[node]) or 'true'})::DOUBLE AS c{t}_{node}")
            if tree.feature[node] >= 0:
                test = LINE_FOREST.test_sql(tree, node)
                reached |= {tree.left[node]: [*reached[node], test], tree.right[node]: [*reached[node], f"NOT ({test})"]}
    for mask in range(1 << d):
        terms = []
        for t, tree in enumerate(LINE_FOREST.trees):
            for leaf, steps in tree.paths():
                parts = [f"{tree.value[leaf]!r}::DOUBLE"]
                for node, left in steps:
                    test, child = LINE_FOREST.test_sql(tree, node), tree.left[node] if left else tree.right[node]
                    parts.append(f"CASE WHEN {'' if left else 'NOT '}({test}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" if mask >> tree.feature[node] & 1
                                 else f"CASE WHEN c{t}_{node} > 0 THEN c{t}_{child} / c{t}_{node} ELSE 0.5::DOUBLE END")
                terms.append(" * ".join(f"({p})" for p in parts))
        values.append(f"({' + '.join(terms)}) / {len(LINE_FOREST.trees)} AS v{mask}")
    phis = " UNION ALL ".join(
        f"SELECT case_id, '{f}' AS feature, " + " + ".join(f"(v{s | 1 << i} - v{s}) * {at.coalition_weight(s.bit_count(), d)!r}::DOUBLE" for s in range(1 << d) if not s >> i & 1)
        + " AS phi FROM v" for i, f in enumerate(FEATS))
    return f"WITH c AS (SELECT {', '.join(covers)} FROM lineitem), v AS (SELECT case_id, {', '.join(values)} FROM {PART_MEANS}, c), phi AS ({phis})"


@query("tree_shap", tree_shap_sql() + " SELECT case_id, feature, round(phi, 6) AS phi FROM phi")
def tree_shap(t):
    """Attributions of every part's mean line item along the trees, whose covers all line items give."""
    phis = tree_attributions(part_means(t), "case_id", LINE_FOREST.with_covers(t.lineitem))
    return phis.withColumn("phi", F.round("phi", 6))


@query("fitted_forest_shap", "SELECT c_custkey, true AS same_score, true AS adds_up FROM customer")
def fitted_forest_shap(t):
    """The best fitted tree model explained: per customer whether the flat trees score as the model does and the attributions add up."""
    data = customer_cases(t)
    model, _ = ml.best_model_flow(data, "outcome", "c_custkey", which=[2, 3])
    score = fitted_score(model, *ml.feature_columns(data, "outcome", ["c_custkey"]))
    told = score.encoded(model.transform(data)).withColumns({"own": score.column(), "told": vector_to_array("probability")[1]})
    sums = tree_attributions(told, "c_custkey", score).groupBy("c_custkey").agg(F.sum("phi").alias("phi"))
    return told.join(sums, "c_custkey").select("c_custkey", (F.abs(F.col("own") - F.col("told")) < 1e-9).alias("same_score"),
                                               (F.abs(F.col("phi") + score.base() - F.col("own")) < 1e-9).alias("adds_up"))


@query("kernel_shap")
def kernel_shap(t):
    """Sampled-coalition attributions of a 64-wide vector model for ten cases against all vectors."""
    weights = [((7 * i) % 11 - 5) / 2.0 for i in range(64)]
    return at.kernel_shap(t.embeddings, "embedding", seeded_sample(t.embeddings, "vec_id", 10, 2), "vec_id", weights, 0.1)


def parts(t):
    return t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", F.length("p_name").cast("double").alias("name_len"))


def grid_sql() -> str:
    feats = PART_SCORE.features
    cands = ", ".join(str(c) for c in cf.grid_candidates(3, 9))
    new = {f: f"CASE WHEN i = {k} THEN lo_{f} + a * (hi_{f} - lo_{f}) / 8 WHEN j = {k} THEN lo_{f} + b * (hi_{f} - lo_{f}) / 8 ELSE {f} END" for k, f in enumerate(feats)}
    dist = " + ".join(f"abs(cf_{f} - {f}) / (hi_{f} - lo_{f})" for f in feats)
    spans = ", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in feats)
    return f"""
    WITH p AS (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice, length(p_name)::DOUBLE AS name_len FROM part),
    r AS (SELECT {spans} FROM p), c AS (SELECT * FROM (VALUES {cands}) t(id, i, a, j, b)),
    x AS (SELECT *, {', '.join(f'{e} AS cf_{f}' for f, e in new.items())} FROM p, r, c),
    y AS (SELECT *, {dist} AS dist FROM x WHERE ({PART_SCORE.sql()} >= 0.5) <> ({PART_SCORE.sql({f: f'cf_{f}' for f in feats})} >= 0.5)),
    best AS (SELECT *, CASE WHEN j >= 0 THEN 2 ELSE 1 END AS n_changed FROM y
      QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN j >= 0 THEN 2 ELSE 1 END, round(dist, 9), id) = 1)"""


@query("counterfactual_grid", grid_sql() + """
    SELECT p_partkey, CAST(n_changed AS BIGINT) AS n_changed, round(dist, 6) AS distance, CAST(id AS BIGINT) AS candidate,
      round(cf_p_size, 4) AS cf_p_size, round(cf_p_retailprice, 4) AS cf_p_retailprice, round(cf_name_len, 4) AS cf_name_len FROM best""")
def counterfactual_grid(t):
    """Smallest change of one or two features that flips the score, for every part."""
    out = cf.counterfactuals(parts(t), parts(t), "p_partkey", PART_SCORE)
    return out.withColumns({"distance": F.round("distance", 6), **{f"cf_{f}": F.round(f"cf_{f}", 4) for f in PART_SCORE.features}})


@query("counterfactual_changes", grid_sql() + """
    SELECT p_partkey, p_brand, round(cf_p_size - p.p_size, 2) AS p_size, round(cf_name_len - length(p_name), 2) AS name_len, CAST(p.p_size % 2 AS INTEGER) AS outcome
    FROM best b JOIN part p USING (p_partkey)""")
def counterfactual_changes(t):
    """Numeric differences; categoricals and the outcome show the new value."""
    q = t.part.select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("p_size"), F.length("p_name").cast("double").alias("name_len"), F.lit(0).alias("outcome"))
    c = cf.counterfactuals(parts(t), parts(t), "p_partkey", PART_SCORE)
    c = c.join(t.part.select("p_partkey", "p_brand", (F.col("p_size") % 2).cast("int").alias("outcome")), "p_partkey").select(
        "p_partkey", "p_brand", F.col("cf_p_size").alias("p_size"), F.col("cf_name_len").alias("name_len"), "outcome")
    return cf.changes(q, c, "p_partkey", outcome="outcome")


MIXED_SCORE = LogisticScore({"p_size": 0.06, "p_retailprice": 0.002, "name_len": -0.15, "brand": 0.35}, -3.4)
BRAND = "CAST(CAST(substr(p_brand, 7) AS INT) % 5 AS DOUBLE)"


def mixed_sql() -> str:
    """Every change of up to three features to a quantile or a category, listed."""
    feats = MIXED_SCORE.features
    numbers = feats[:3]
    tried = ", ".join(f"v_{f} AS (SELECT DISTINCT unnest([{', '.join(f'quantile_cont({f}, {i / 4})' for i in range(5))}]) AS c_{f} FROM p UNION ALL SELECT NULL)" for f in numbers)
    new = {f: f"coalesce(c_{f}, {f})" for f in feats}
    changed = " + ".join(f"CASE WHEN c_{f} IS NULL THEN 0 ELSE 1 END" for f in feats)
    same = " AND ".join(f"(c_{f} IS NULL OR c_{f} <> {f})" for f in feats)
    dist = " + ".join([f"abs({new[f]} - {f}) / (hi_{f} - lo_{f})" for f in numbers] + ["CASE WHEN c_brand IS NULL THEN 0.0 ELSE 1.0 END"])
    spans = ", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in numbers)
    cf = ", ".join(f"{e} AS cf_{f}" for f, e in new.items())
    return f"""
    WITH p AS (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice, length(p_name)::DOUBLE AS name_len, {BRAND} AS brand FROM part),
    r AS (SELECT {spans} FROM p), {tried}, v_brand AS (SELECT DISTINCT brand AS c_brand FROM p UNION ALL SELECT NULL),
    x AS (SELECT p.*, {cf}, {changed} AS n_changed, {dist} AS dist FROM p, r, {', '.join(f'v_{f}' for f in feats)} WHERE {same} AND {changed} BETWEEN 1 AND 3),
    best AS (SELECT * FROM x WHERE ({MIXED_SCORE.sql()} >= 0.5) <> ({MIXED_SCORE.sql({f: f'cf_{f}' for f in feats})} >= 0.5)
      QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n_changed, round(dist, 9), {', '.join(f'cf_{f}' for f in feats)}) = 1)
    SELECT p.p_partkey, CAST(coalesce(n_changed, 0) AS BIGINT) AS n_changed, round(dist, 6) AS distance, {', '.join(f'round(cf_{f}, 3) AS cf_{f}' for f in feats)}
    FROM p LEFT JOIN best USING (p_partkey)"""


@query("counterfactual_mixed", mixed_sql())
def counterfactual_mixed(t):
    """Every part's smallest flip over numbers and a category, or none."""
    p = parts(t).join(t.part.select("p_partkey", F.expr(BRAND).alias("brand")), "p_partkey")
    out = cf.mixed_counterfactuals(p, p, "p_partkey", MIXED_SCORE, ["brand"], beam=256)
    return out.withColumns({"distance": F.round("distance", 6), **{f"cf_{f}": F.round(f"cf_{f}", 3) for f in MIXED_SCORE.features}})


def rule_rows(t):
    return t.lineitem.select("l_quantity", "l_extendedprice", "l_tax", F.when(LINE_SCORE.column() >= 0.5, 1).otherwise(0).alias("y"))


RULE_FEATS = ["l_quantity", "l_extendedprice", "l_tax"]
RULE_ROWS = f"SELECT l_quantity, l_extendedprice, l_tax, CASE WHEN {LINE_SCORE.sql()} >= 0.5 THEN 1 ELSE 0 END AS y FROM lineitem"


def cuts_sql(rows: str) -> str:
    """Every one-sided cut at a distinct value, with its counts by running sums: ``(feature, edge, nn, side, label, covered, agreeing)``."""
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, y FROM {rows}" for f in RULE_FEATS)
    return f"""SELECT feature, edge, nn, side, label, CASE side WHEN 'below' THEN nl ELSE nn - nl END AS covered,
        CASE WHEN label = 1 THEN CASE side WHEN 'below' THEN pl ELSE pp - pl END ELSE CASE side WHEN 'below' THEN nl - pl ELSE nn - nl - pp + pl END END AS agreeing
      FROM (SELECT feature, x AS edge, CAST(sum(n) OVER w - n AS BIGINT) AS nl, CAST(sum(p) OVER w - p AS BIGINT) AS pl,
              CAST(sum(n) OVER (PARTITION BY feature) AS BIGINT) AS nn, CAST(sum(p) OVER (PARTITION BY feature) AS BIGINT) AS pp
            FROM (SELECT feature, x, count(*) AS n, sum(y) AS p FROM ({long}) GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature ORDER BY x)),
        (VALUES ('below'), ('above')) sd(side), (VALUES (0), (1)) lb(label) WHERE nl > 0"""


@query("rule_mine_single", f"""
    WITH d AS ({RULE_ROWS}), c AS ({cuts_sql('d')})
    SELECT CAST(label AS BIGINT) AS label, feature, side, edge, covered, agreeing, round(agreeing / covered, 6) AS precision FROM c WHERE covered > 0 AND covered / nn >= 0.05
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(agreeing / covered, 9) DESC, covered DESC, feature DESC, side DESC, edge) = 1""")
def rule_mine_single(t):
    """Best one-sided cut per label over the distinct values of all features."""
    best = rl.best_cut(rl.cut_scores(rule_rows(t), RULE_FEATS, "y"))
    return best.select("label", "feature", "side", "edge", "covered", "agreeing", F.round("precision", 6).alias("precision"))


def covering_sql(share: float) -> str:
    """Sequential covering step by step: each rule covers ``share`` of the table, so the steps are counted beforehand."""
    def within(cut: str) -> str:
        value = " ".join(f"WHEN '{f}' THEN d.{f}" for f in RULE_FEATS)
        return f"((CASE {cut}.feature {value} END < {cut}.edge) = ({cut}.side = 'below'))"

    order = "ORDER BY round(agreeing / covered, 9) DESC, covered DESC, label, feature DESC, side DESC, edge LIMIT 1"
    steps = [f"o0 AS MATERIALIZED ({RULE_ROWS})", f"t AS MATERIALIZED (SELECT {share} * count(*) AS least FROM o0)"]
    out = []
    for k in range(int(1 / share)):
        first, second = f"a{k}", f"b{k}"
        steps += [
            f"{first} AS MATERIALIZED (SELECT * FROM ({cuts_sql(f'o{k}')}) WHERE covered >= greatest((SELECT least FROM t), 1) {order})",
            f"i{k} AS MATERIALIZED (SELECT d.* FROM o{k} d, {first} WHERE agreeing < covered AND {within(first)})",
            f"{second} AS MATERIALIZED (SELECT c.* FROM ({cuts_sql(f'i{k}')}) c JOIN {first} a ON a.label = c.label "
            f"WHERE c.covered >= greatest((SELECT least FROM t), 1) AND c.agreeing / c.covered > a.agreeing / a.covered {order.replace('agreeing', 'c.agreeing').replace('covered', 'c.covered').replace('label', 'c.label').replace('feature', 'c.feature').replace('side', 'c.side').replace(', edge', ', c.edge')})",
            f"o{k + 1} AS MATERIALIZED (SELECT d.* FROM o{k} d LEFT JOIN {first} ON true LEFT JOIN {second} ON true "
            f"WHERE NOT coalesce({within(first)} AND coalesce({within(second)}, true), false))"]
        conds = " UNION ALL ".join(
            f"SELECT {k} AS rule_id, {i} AS cond_idx, c.feature, CASE c.side WHEN 'above' THEN c.edge END AS lo, CASE c.side WHEN 'below' THEN c.edge END AS hi, "
            f"c.label, coalesce(b.covered, a.covered) AS covered, coalesce(b.agreeing / b.covered, a.agreeing / a.covered) AS precision FROM {cut} c, {first} a LEFT JOIN {second} b ON true"
            for i, cut in enumerate((first, second)))
        out.append(conds)
    return ("WITH " + ", ".join(steps) + " SELECT CAST(rule_id AS BIGINT) AS rule_id, CAST(cond_idx AS BIGINT) AS cond_idx, feature, lo, hi, CAST(label AS VARCHAR) AS label, covered, "
            "round(precision, 6) AS precision FROM (" + " UNION ALL ".join(out) + ")")


@query("rules_covering", covering_sql(0.05))
def rules_covering(t):
    """Sequential covering of the model's predictions, each rule's text taken apart into its conditions."""
    found = rl.rule_conditions(rl.mine_rules(rule_rows(t), RULE_FEATS, "y", min_coverage=0.05))

    def finite(c):
        return F.when(F.abs(c) != float("inf"), F.col(c)).alias(c)

    return found.select("rule_id", F.col("cond_idx").cast("long").alias("cond_idx"), "feature", finite("lo"), finite("hi"), "label", "covered", F.round("precision", 6).alias("precision"))


@query("rules_surrogate_tree")
def rules_surrogate_tree(t):
    return rl.surrogate_rules(rule_rows(t), RULE_FEATS, "y")


def vectors(t):
    return t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


@query("prototype_first", """
    WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(v) AS m FROM x GROUP BY i)
    SELECT vec_id, round(sum(v * m), 6) AS gain FROM x JOIN m USING (i) GROUP BY vec_id""")
def prototype_first(t):
    """First greedy step: gain of every vector."""
    return pt.prototype_gain(vectors(t), "vec_id", [f"e{i}" for i in range(64)]).withColumn("gain", F.round("gain", 6))


@query("prototypes")
def prototypes(t):
    return pt.prototypes(vectors(t), "vec_id", [f"e{i}" for i in range(64)])


@query("prototype_gaussian", """
    WITH x AS (SELECT a.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: power(z[1]::DOUBLE - z[2]::DOUBLE, 2))) AS d FROM embeddings a, embeddings b),
    m AS (SELECT vec_id, avg(exp(-d / 8)) AS mu FROM x GROUP BY vec_id) SELECT vec_id, CAST(0 AS BIGINT) AS pick, 1.0::DOUBLE AS weight FROM m ORDER BY round(mu, 12) DESC, vec_id LIMIT 1""")
def prototype_gaussian(t):
    """The vector nearest to all others by the Gaussian kernel."""
    return pt.gaussian_prototypes(vectors(t), "vec_id", [f"e{i}" for i in range(64)], m=1)


ORDER_SCORE = LogisticScore({"TotalPrice": 0.00001, "CustKey": -0.0005}, -2.0)


def _delegate(t):
    kinds = t.customer.select(F.col("c_custkey").alias("record_id"), F.expr(
        "CASE c_custkey % 5 WHEN 0 THEN 'Case Based Explanation' WHEN 1 THEN 'Contrastive Explanation' WHEN 2 THEN 'Rationale Explanation' "
        "WHEN 3 THEN 'Counterfactual Explanation' ELSE 'Data Explanation' END").alias("explanation_type"))
    table = cases(t).withColumn("label", F.when(F.col("OrderStatus") == "F", 1).otherwise(0))
    return flows.delegate(interpretations(t).join(kinds, "record_id"), table, "case_id", CASE_COLUMNS,
                          values(t, METHODS, "explanation_type string, instance string, modality string"), IMPLEMENTED, ORDER_SCORE, "label", TYPES,
                          modality_metrics=values(t, MODALITY_METRICS, "modality string, metric string"))


@query("delegate_batch")
def delegate_batch(t):
    """Parse, route and explain one question per customer; all results in long form."""
    return _delegate(t)[0]


@query("delegate_evaluations")
def delegate_evaluations(t):
    return _delegate(t)[1]
