from pyspark.sql import functions as F

from whyframe.operators import graph
from whyframe.sources import readers, writers

OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#"
 xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:skos="http://www.w3.org/2004/02/skos/core#">
 <owl:Class rdf:about="http://x#Answer"><rdfs:label>answer</rdfs:label></owl:Class>
 <owl:Class rdf:about="http://x#CaseAnswer"><rdfs:subClassOf rdf:resource="http://x#Answer"/>
  <rdfs:subClassOf><owl:Restriction/></rdfs:subClassOf>
  <rdfs:label>case answer</rdfs:label><skos:definition>by cases</skos:definition>
  <skos:example>"Which case is like it?" and "Why this one?"</skos:example><skos:example>"What else?"</skos:example></owl:Class>
 <owl:Class rdf:about="http://x#NearCase"><rdfs:subClassOf rdf:resource="http://x#CaseAnswer"/><rdfs:label>near case</rdfs:label></owl:Class>
 <owl:NamedIndividual rdf:about="http://x#Proto"><rdf:type rdf:resource="http://x#NearCase"/></owl:NamedIndividual>
</rdf:RDF>"""


def test_ontology(spark, tmp_path):
    f = tmp_path / "o.owl"
    f.write_text(OWL)
    tr = readers.read_ontology(spark, str(f)).cache()
    edges = graph.objects(tr, graph.SUBCLASS, "parent").withColumnRenamed("s", "child")
    assert edges.count() == 2
    root = graph.classes_by_label(tr, "Answer")
    below = {r.node: r.depth for r in graph.descendants(edges, root).collect()}
    assert below == {"http://x#CaseAnswer": 1, "http://x#NearCase": 2}
    nodes = spark.createDataFrame([(n,) for n in below], "s string")
    mined = sorted((r.explanation, r.question) for r in graph.mine_questions(nodes, tr).collect())
    assert mined == [("case answer", "What else?"), ("case answer", "Which case is like it?"), ("case answer", "Why this one?")]
    assert sorted((r.explanation, r.question) for r in graph.mine_questions_below(tr, "answer").collect()) == mined
    assert graph.mine_questions_below(tr, "no such class").count() == 0
    assert [r.name for r in graph.instances_of(tr, "near case").collect()] == ["Proto"]
    assert {r.s: r.value for r in graph.property_value(nodes, tr, graph.DEFINITION).collect()}["http://x#NearCase"] == ""


def test_descendants_with_cycle(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (4, 1), (4, 2)], "child long, parent long")
    root = spark.createDataFrame([(1,)], "id long")
    assert {r.node: r.depth for r in graph.descendants(edges, root).collect()} == {2: 1, 4: 1, 3: 2}
    deep = spark.range(1, 31).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    assert graph.descendants(deep, spark.createDataFrame([(0,)], "id long")).count() == 30


def test_descendants_of_deep_and_mixed_graphs(spark):
    import random

    rnd = random.Random(3)
    chain = [(i + 1, i) for i in range(700)]
    some = [(rnd.randrange(1000, 1060), rnd.randrange(1000, 1060)) for _ in range(90)]  # cycles, several parents, loops
    edges = spark.createDataFrame([*chain, *some, (None, 1), (5, None)], "child long, parent long")

    def plain(roots, most=10 ** 6):
        depth, level, n = dict.fromkeys(roots, 0), list(roots), 0
        while level and n < most:
            n += 1
            level = list({c for c, p in chain + some if p in set(level)} - depth.keys())
            depth |= dict.fromkeys(level, n)
        return {k: d for k, d in depth.items() if d}

    for roots, most in (([0], None), ([3, 1005], None), ([1001], 3), ([0], 5), ([9999], None)):
        root = spark.createDataFrame([(r,) for r in roots], "id long")
        assert {r.node: r.depth for r in graph.descendants(edges, root, most).collect()} == plain(roots, most or 10 ** 6)


def test_instruction_blocks_roundtrip(spark, tmp_path):
    from whyframe.functions.text import render_block

    df = spark.createDataFrame([("q1", "Predict(x)", ["Predict", "Show"], ["{'Age': '3'}"], "Data Explanation"), ("q2", "m", [], [], "Other")],
                               "q string, m string, a array<string>, g array<string>, k string")
    text = "".join(r[0] for r in df.select(render_block(F.col("q"), F.col("m"), F.col("a"), F.col("g"), F.col("k"))).collect())
    f = tmp_path / "b.txt"
    f.write_text(text + "Question : open block\n")
    rows = {r.question: r for r in readers.read_instruction_blocks(spark, str(f)).collect()}
    assert set(rows) == {"q1", "q2"}
    assert rows["q1"].actions == ["Predict", "Show"] and rows["q1"].feature_groups == ["{'Age': '3'}"]
    assert rows["q2"].explanation_type == "Other" and rows["q2"].actions == []


def test_run_tree(spark, tmp_path):
    for run, sub, v in (("CaseBased_run_proto_170", 0, 1.5), ("CaseBased_run_proto_170", 1, 2.5), ("Rule_run_tree_171", 0, 3.0)):
        d = tmp_path / "results" / run / str(sub)
        d.mkdir(parents=True)
        (d / "Evaluations.csv").write_text(f"Metric,Value\nDiversity,{v}\n")
        (tmp_path / "results" / run / "record.csv").write_text(f",0\nQuestion,why {run}\nAction,\"['a']\"\nExplanation type,T\n")
    df = readers.scan_runs(spark, str(tmp_path / "results"), "Evaluations.csv", "metric string, value double")
    got = sorted((r.explanation_type, r.method, r.run_ts, r.subset_idx, r.value) for r in df.collect())
    assert got == [("CaseBased", "proto", 170, 0, 1.5), ("CaseBased", "proto", 170, 1, 2.5), ("Rule", "tree", 171, 0, 3.0)]
    rec = {r.run_id: r for r in readers.read_records(spark, str(tmp_path / "results" / "*" / "record.csv")).collect()}
    assert rec["Rule_run_tree_171"].Question == "why Rule_run_tree_171" and rec["Rule_run_tree_171"].Action == "['a']"


def test_text_sources(spark, tmp_path):
    (tmp_path / "u.txt").write_text("why a\nop one\n\nwhy b\nop two\n")
    assert sorted(tuple(r) for r in readers.read_utterances(spark, str(tmp_path / "u.txt")).collect()) == [("why a", "op one"), ("why b", "op two")]
    d = tmp_path / "gen" / "typeA"
    d.mkdir(parents=True)
    (d / "sheet1.txt").write_text("1. Why x?\n- Action: go: now\n- Explanation type: T\n\n2. Why y?\n- Action: stay\n")
    rows = {r.Question: r for r in readers.read_generated_questions(spark, str(tmp_path / "gen")).collect()}
    assert rows["Why x?"].Action == "go" and rows["Why x?"].source_type == "typeA" and rows["Why y?"].sheet == "sheet1"
    full = {r.Question: r for r in readers.read_generated_questions(spark, str(tmp_path / "gen"), compat=False).collect()}
    assert full["Why x?"].Action == "go: now"
    (tmp_path / "c.csv").write_text(",Age,Sex\n0,3,F\n1,4,M\n")
    assert readers.read_cases(spark, str(tmp_path / "c.csv")).columns == ["Age", "Sex"]
    assert readers.dataset_file("Some Domain") == "some_domain.csv"
    (tmp_path / "l.txt").write_text("b'one'\nplain \n")
    assert [r.line for r in readers.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["one", "plain"]


def test_sheets_and_feedback(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Unnamed: 0,Question,predicate logic\n0,q1,p1\n")
    (tmp_path / "b.csv").write_text("Question,Likelihood\nq2,high\n")
    df = readers.read_sheets(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert {c for c in df.columns} == {"Question", "Machine interpretation", "Likelihood", "source_file"} and df.count() == 2
    for who, files in (("p1", ["evaluation_set_2.csv", "evaluation_set_1.csv"]), ("p2", ["evaluation_set_x.csv", "evaluation_set_9.csv"])):
        (tmp_path / "fb" / who).mkdir(parents=True)
        for name in files:
            (tmp_path / "fb" / who / name).write_text(f"kind,score\n{name},1\n")
    got = sorted((r.participant, r.kind) for r in readers.scan_feedback(spark, str(tmp_path / "fb")).collect())
    assert got == [("p1", "evaluation_set_1.csv"), ("p2", "evaluation_set_9.csv")]


def test_writers(spark, tmp_path):
    root = str(tmp_path / "out")
    a, b = writers.new_run_id(), writers.new_run_id()
    for run in (a, b):
        df = spark.createDataFrame([("T", "m", run, 0, 1.0)], "explanation_type string, method string, run_id string, subset_idx int, value double")
        assert writers.write_run({"results": df, "evaluations": df.limit(0)}, root) == ["results"]
    back = spark.read.parquet(root + "/results")
    assert {r.run_id for r in back.collect()} == {a, b}
    corpus = spark.createDataFrame([("t", "i", "in", "out", "l")], "text string, instruction string, input string, output string, label string")
    writers.write_corpus(corpus, str(tmp_path / "c"))
    writers.write_corpus(corpus, str(tmp_path / "c"), mode="append")
    assert readers.read_corpus(spark, str(tmp_path / "c")).count() == 2
    writers.write_lines(corpus, "text", str(tmp_path / "t"))
    assert [r.line for r in readers.read_lines(spark, str(tmp_path / "t")).collect()] == ["t"]
    blocks = spark.createDataFrame([("x",)], "block string")
    writers.write_parses(blocks, blocks.limit(0), str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p" / "usable")).count() == 1
    batches = spark.range(50).withColumn("batch", F.floor(F.col("id") / 2).cast("int"))
    assert writers.append_batches(batches, "batch", str(tmp_path / "b"), every=10) == 3
    assert spark.read.json(str(tmp_path / "b")).count() == 50
