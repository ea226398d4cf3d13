"""Readers, writers, streaming, API and command line on small files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lemniscate.functions import dot, html, latex
from lemniscate.functions import text as tx
from lemniscate.operators import evaluate, formulas, fusion, maintain, search
from lemniscate.plans import api
from lemniscate.sources import readers, writers
from lemniscate.streaming import ingest

MATH = '<math xmlns="http://www.w3.org/1998/Math/MathML"><mrow><mi>x</mi><mo>+</mo><mn>%d</mn></mrow></math>'


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_posts_xml(spark, tmp_path):
    rows = [(1, 1, "A &amp; B", '&lt;p&gt;Let &lt;span class=&quot;math-container&quot; id=&quot;7&quot;&gt;x^2&lt;/span&gt; be&lt;/p&gt;'), (2, 2, "", "x"), (3, 1, "", "&lt;b&gt;y&lt;/b&gt;")]
    path = put(f"{tmp_path}/p.xml", "<posts>\n" + "".join(f'<row Id="{i}" PostTypeId="{t}" Title="{h}" Body="{b}" />\n' for i, t, h, b in rows) + "</posts>")
    posts = readers.posts_xml(spark, path)
    assert posts.count() == 3
    docs = {r["post_id"]: r for r in readers.post_documents(readers.new_questions(posts)).collect()}
    assert set(docs) == {"1", "3"} and docs["1"]["formulas_count"] == 1
    assert docs["1"]["text_latex_search"] == "A & B Let $x^2$ be" and docs["1"]["text_without_formula"] == "A & B Let be" and docs["3"]["text"] == "<b>y</b>"
    assert [r["post_id"] for r in readers.new_questions(posts, 1, 1).collect()] == [3]


def test_formula_tables_and_cli(spark, tmp_path):
    from lemniscate.__main__ import main

    put(f"{tmp_path}/f/1.tsv", "id\tpost_id\ttype\tformula\n" + f"a\t1\tquestion\t{MATH % 1}\n" + f"b\t9\tquestion\t{MATH % 2}\n" + "c\t1\tquestion\t\n" + f"d\t1\tanswer\t{MATH % 3}\n".replace('"', '"'))
    spark.createDataFrame([(1,)], "post_id long").write.parquet(f"{tmp_path}/posts")
    found = readers.usable_formulas(readers.formula_tsv(spark, readers.formula_files(f"{tmp_path}/f")), spark.read.parquet(f"{tmp_path}/posts"))
    assert [r["id"] for r in found.collect()] == ["a"]
    main(["index", "--formulas", f"{tmp_path}/f", "--posts", f"{tmp_path}/posts", "--dims", "8", "--out", f"{tmp_path}/index"])
    index = spark.read.parquet(f"{tmp_path}/index")
    assert index.count() == 1
    index.select(F.lit("q").alias("query_id"), "slt_vector").write.parquet(f"{tmp_path}/q")
    main(["retrieve", "--index", f"{tmp_path}/index", "--queries", f"{tmp_path}/q", "--field", "slt_vector", "--run-id", "slt", "--out", f"{tmp_path}/run"])
    (line,) = [r[0] for r in spark.read.text(f"{tmp_path}/run").collect()]
    assert line.startswith("q xxx a 1 ") and line.endswith(" Run_slt")


def test_file_collections(spark, tmp_path):
    put(f"{tmp_path}/w/d1/Articles/Café.html", f"<p>{MATH % 1}</p><m:math xmlns:m='x'><m:mi>y</m:mi></m:math>")
    rows = {r["formula_id"]: r["formula"] for r in readers.wiki_collection(spark, f"{tmp_path}/w").collect()}
    assert set(rows) == {"Cafe:0", "Cafe:1"} and rows["Cafe:1"].startswith("<math") and "<mi>y</mi>" in rows["Cafe:1"]
    put(f"{tmp_path}/q/3.html", MATH % 1 + MATH % 2)
    put(f"{tmp_path}/q/33.html", MATH % 1)
    ((q, f),) = [tuple(r) for r in readers.wiki_queries(spark, f"{tmp_path}/q").collect()]
    assert q == 3 and "<mn>2</mn>" in f
    path = put(f"{tmp_path}/m.txt", "x+1$$a\ny\n+2$$b\nUSD 3$$c\n<p z$$d\n\nlost$$e\n")
    got = [(r["formula_id"], r["formula"]) for r in readers.latex_collection(spark, path).orderBy("ord").collect()]
    assert got == [("a", "x+1"), ("b", "y +2")]
    triples = spark.createDataFrame([("h$$f1$$i1$$h$$f2$$i2$$",)], "c string").select(readers.latex_triples(F.col("c"))).first()[0]
    assert [tuple(t) for t in triples] == [("f1", "i1"), ("f2", "i2")]


def test_tokenised_files_and_probes(spark, tmp_path):
    put(f"{tmp_path}/t/f1.txt", "V!x\t+\tn\t-\n\n+\tN!2\tn\tn\n")
    ((name, tuples),) = [tuple(r) for r in readers.tokenised_collection(spark, f"{tmp_path}/t").collect()]
    assert name == "f1" and tuples == ["V!x\t+\tn\t-", "+\tN!2\tn\tn"]
    docs = spark.createDataFrame([("a qvar b",), ("plain",)], "content string")
    assert readers.holding(docs, "qvar", "zzz").count() == 1
    places = spark.createDataFrame([("q", 1, "d", [3, 5], ["sum"])], "query_id string, place int, doc_id string, positions array<int>, keywords array<string>")
    assert writers.composite_lines(places).first()[0] == "q\t1\td\t*M*3,5*M*\t*W*sum*W*"


def test_config_control_results(spark, tmp_path):
    assert readers.config(spark, put(f"{tmp_path}/c", "vector_size,300\nname,slt\n")) == {"vector_size": 300, "name": "slt"}
    assert readers.control(spark, put(f"{tmp_path}/d", "window\t2\n")) == {"window": 2}
    assert len(readers.config_grid(a=[1, 2], b=["x", "y"])) == 4
    values = ["Q\tq1", "E\te1", "R\td1\t[0]\tx\t0.5", "E\te2", "R\td2\t[1]\ty\t0.25", "Q\tq2", "R\td3\t[0]\tz\t1"]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "file string, line int, value string")
    got = [(r["query"], r["query_expression"], r["doc_id"], r["score"]) for r in readers.engine_results(lines).collect()]
    assert sorted(got)[:2] == [("q1", "e1", "d1", 0.5), ("q1", "e2", "d2", 0.25)]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(["Q\tq1", "P\tword", "M\td1\t2.5"])], "file string, line int, value string")
    assert [tuple(r) for r in readers.keyword_results(lines).collect()] == [("q1", "d1", 2.5)]
    docs = spark.createDataFrame([("b.tex",), ("a.html",), ("c.pdf",)], "path string")
    numbered = [tuple(r) for r in readers.document_list(docs, 2).orderBy("doc_id").collect()]
    assert numbered == [("a.html", 0, 0, 0), ("b.tex", 1, 0, 1), ("c.pdf", 2, 1, 0)]
    routes = [r[0] for r in docs.orderBy("path").select(readers.route(readers.document(F.col("path")))).collect()]
    assert routes == ["xml", "tex", None]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("N", "V!", 60000), ("E", "n", 500)], "kind string, symbol string, id int")
    writers.write_map(df, f"{tmp_path}/map")
    assert sorted(map(tuple, readers.encoder_map(spark, f"{tmp_path}/map").collect())) == sorted(map(tuple, df.collect()))
    writers.write_csv(df, f"{tmp_path}/csv")
    writers.write_json(df, f"{tmp_path}/json")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == spark.read.json(f"{tmp_path}/json").count() == 2
    pairs = spark.createDataFrame([("d", "f", "V!x", "+", "n", "-")], "dir string, formula_id string, s1 string, s2 string, rel_path string, loc string")
    writers.write_tuples(pairs, f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t/dir=d").first()[0] == "V!x\t+\tn\t-"


def test_streaming(spark, tmp_path):
    schema = "post_id long, text string"
    run = lambda: ingest.ingest(ingest.stream_of(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    run()
    spark.createDataFrame([(2, "new"), (3, "c")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    posts = ingest.collection(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, posts.collect())) == [(1, "a"), (2, "new"), (3, "c")]
    have = spark.createDataFrame([(1, [0.0])], "post_id long, vector array<double>")
    assert sorted(r["post_id"] for r in ingest.fill_missing(posts, have, lambda d: d).collect()) == [2, 3]
    assert ingest.max_id(posts) == 3


def test_html(spark):
    page = '<p>A <b>b</b><!-- c --><script>x</script></p><span class="math-container" id="5">y<i>z</i></span>&amp; end'
    row = spark.createDataFrame([(page,), (None,)], "h string")
    got = row.select(html.html_text("h"), html.html_text_with_latex("h"), html.html_text_without_formulas("h")).collect()
    assert tuple(got[0]) == ("A b y z & end", "A b $yz$ & end", "A b & end") and tuple(got[1]) == (None, None, None)
    x = spark.createDataFrame([("<p>Let <math><mi>x</mi></math> be<math/> ok</p>",)], "h string").select(html.separated("h").alias("s")).first()[0]
    assert x["text"] == "Let be ok" and x["formulas"][0] == "<math><mi>x</mi></math>" and x["positions"][0] == 4


def test_latex_and_text(spark):
    one = lambda c, s: spark.createDataFrame([(s,)], "s string").select(c(F.col("s"))).first()[0]
    assert one(latex.cleaned, r"The area $A = \pi r^{2}$ and $\vec{v}\cdot\mathbf{u}$.") == r"The area A=\pir^2 and vu ."
    assert one(latex.formulas, r"$a$ $x^2 + y$ \[ \sin(x) \] \begin{eq} abcdefg \end{eq}") == ["$x^2 + y$", r"$\sin(x)$", "$abcdefg$"]
    assert one(tx.analysed, "The running foxes, à la carte!") == ["run", "fox", "la", "cart"]
    assert one(tx.int_list, "[1, 2]") == [1, 2] and one(tx.int_list, "3") == [3] and one(tx.int_list, "junk") == []
    size = spark.createDataFrame([("M!()2x3",), ("M!V-2",)], "t string").select(*tx.matrix_size(F.col("t"))).collect()
    assert [tuple(r) for r in size] == [(2, 3), (-1, -1)]
    assert one(tx.cut_after_first_formula, "a b c d $x$ e") == "b c d $x$" and one(tx.cut_after_first_formula, "z" * 60) == "z" * 50


def test_graph(spark):
    parsed = formulas.parsed(spark.createDataFrame([(1, MATH % 2)], "k int, formula string"))
    text = parsed.select(dot.dot_graph(F.col("nodes"), F.array(F.lit("n")))).first()[0]
    assert text.startswith("digraph {") and 'n0 -> n1 [label="n"];' in text and text.count("filled") == 1
    assert parsed.select(dot.at_path(F.col("nodes"), F.lit("nn")), dot.leaves(F.col("nodes"))).first() == ("N!2", ["N!2"])


def test_api(spark):
    posts = spark.createDataFrame(
        [("1", "the quick fox", "quick $x^2+y^2$ fox", [1.0, 0.0]), ("2", "a slow dog", "slow dog", [0.0, 1.0]), ("3", "nothing", "nothing", [0.6, 0.8])],
        "post_id string, text string, text_latex_search string, text_without_html_vector array<double>",
    )
    queries = spark.createDataFrame([("q", f"<p>quick fox {MATH % 2}</p>")], "query_id string, query string")
    plain = api.search_pure_text(posts, queries.withColumn("query", F.lit("fox")))
    assert [r["doc_id"] for r in plain.collect()] == ["1"]
    treated = api.search_treated_formulas(posts, queries.withColumn("query", F.lit('quick <span class="math-container" id="1">x^2+y^2</span>')))
    assert treated.orderBy("rank").first()["doc_id"] == "1"
    embed = lambda d: d.select("doc_id", F.array(F.lit(1.0), F.lit(0.1)).alias("vector"))
    near = api.search_text_vector(posts, queries, embed, 2)
    assert [r["doc_id"] for r in near.orderBy("rank").collect()] == ["1", "3"]
    asked = api.query_formulas(queries, dims=8)
    index = asked.select(F.lit("f1").alias("formula_id"), F.lit("2").alias("post_id"), F.col("vector").alias("slt_vector"))
    out = api.search_hybrid(near.select("query_id", "doc_id", "score"), plain.select("query_id", "doc_id", "score"), index, asked)
    assert set(out) == {"max", "mean", "max_weighted", "mean_weighted"}
    assert {r["doc_id"] for r in out["max"].collect()} == {"1", "2", "3"}
    assert api.with_attributes(out["max"], posts, "text").filter("doc_id = '2'").first()["text"] == "a slow dog"
    with pytest.raises(ValueError):
        api.search_formula_vector(index, asked, "text_vector")


def test_maintenance(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, x string, y int")
    assert sorted(map(tuple, maintain.updated(old, new, "k").collect())) == [(1, "a", 1), (2, "b", 9)]
    assert sorted(map(tuple, maintain.updated(old, new, "k", insert=True).collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]
    v = spark.createDataFrame([([1.0], [2.0]), ([], [1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(maintain.complete("a", "b")).collect()] == [True, False, False]


def test_fusion_properties(spark):
    text = spark.createDataFrame([("q", 1, 0.4), ("q", 2, 0.8)], "query_id string, doc_id int, score double")
    hits = spark.createDataFrame([("q", 2, 0.2, 0.5), ("q", 2, 0.6, 0.5), ("q", 3, -0.5, 1.0)], "query_id string, doc_id int, score double, weight double")
    score = lambda how, w: {r["doc_id"]: round(r["score"], 6) for r in fusion.fused(text, fusion.by_document(hits, how, w)).collect()}
    assert score("max", False) == {1: 0.2, 2: 0.7, 3: 0.0} and score("mean", False)[2] == 0.6 and score("max", True)[2] == 0.55
    shuffled = {r["doc_id"]: round(r["score"], 6) for r in fusion.fused(text.repartition(7), fusion.by_document(hits.repartition(5))).collect()}
    assert shuffled == score("max", False)
    k = search.knn(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id int, vector array<double>"), spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vector array<double>"), 5)
    assert [(r["id"], r["score"]) for r in k.collect()] == [(1, 1.0)]
    found = evaluate.found_at(spark.createDataFrame([("c", "q", 2), ("d", "q", 9)], "case_id string, query_id string, doc_id int"), text.withColumn("rank", F.col("doc_id")))
    assert {r["case_id"]: r["position"] for r in found.collect()} == {"c": 2, "d": None}


def test_a_dictionary_is_written_by_many_tasks(spark, tmp_path):
    pairs = spark.range(100).repartition(4).selectExpr("'N' AS kind", "concat('s', id) AS symbol", "int(id) AS id")
    writers.write_map(pairs, f"{tmp_path}/map")
    assert len(list(tmp_path.glob("map/*.csv"))) == 4
    assert sorted(map(tuple, readers.encoder_map(spark, f"{tmp_path}/map").collect())) == sorted(map(tuple, pairs.collect()))


def test_folders_of_tuples_do_not_grow_with_the_rows(spark, monkeypatch):
    """A folder holds many formulas, each line with its formula's id."""
    from lemniscate.plans import source_queries

    written = []
    plain = writers.write_tuples
    monkeypatch.setattr(writers, "write_tuples", lambda df, path, **how: (plain(df, path, **how), written.append(path)))
    made = spark.range(500).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name")
    monkeypatch.setattr(source_queries, "table", lambda *_: made)
    got = sorted(map(tuple, source_queries.sinks(spark, "").collect()))
    assert got == sorted((i, f"S{i}", "V!x\t+\tn\t-") for i in range(500))
    assert spark.read.text(written).select("dir").distinct().count() == 20
