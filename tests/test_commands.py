"""The command line end to end on a few formulas."""

from __future__ import annotations

from pyspark.ml.feature import Word2VecModel
from pyspark.sql import functions as F

from lemniscate.__main__ import main
from lemniscate.operators import formulas

M = '<math xmlns="http://www.w3.org/1998/Math/MathML">%s</math>'


def test_train_combine_retrieve(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lemniscate.__main__.session", lambda *_, **__: spark)
    forms = [M % f"<mrow><mi>x</mi><mo>+</mo><mn>{i % 4}</mn></mrow>" for i in range(12)] + [M % "<zz/>"]
    rows = spark.createDataFrame([(f"f{i}", f, "1", "question") for i, f in enumerate(forms)], "id string, formula string, post_id string, type string")
    rows.coalesce(1).write.option("sep", "\t").option("header", True).csv(f"{tmp_path}/raw")
    (part,) = (tmp_path / "raw").glob("part-*.csv")
    (tmp_path / "tsv").mkdir()
    part.rename(tmp_path / "tsv" / "a.tsv")
    spark.createDataFrame([(1,)], "post_id long").write.parquet(f"{tmp_path}/posts")
    (tmp_path / "config").write_text("vector_size,8\nwindow,3\n")
    common = ["--formulas", f"{tmp_path}/tsv", "--posts", f"{tmp_path}/posts"]
    main(["train", *common, "--config", f"{tmp_path}/config", "--kind", "slt", "--model", f"{tmp_path}/model", "--out", f"{tmp_path}/a"])
    vectors = spark.read.parquet(f"{tmp_path}/a")
    assert vectors.count() == 12 and vectors.filter(F.size("vector") != 8).count() == 0
    main(["combine", "--indexes", f"{tmp_path}/a,{tmp_path}/a", "--out", f"{tmp_path}/both"])
    both = {r["formula_id"]: r["vector"] for r in spark.read.parquet(f"{tmp_path}/both").collect()}
    assert all(abs(x - 2 * y) < 1e-12 for r in vectors.collect() for x, y in zip(both[r["formula_id"]], r["vector"]))
    spark.read.parquet(f"{tmp_path}/both").filter("formula_id = 'f1'").select(F.lit("q").alias("query_id"), "vector").write.parquet(f"{tmp_path}/asked")
    main(["retrieve", "--index", f"{tmp_path}/both", "--queries", f"{tmp_path}/asked", "--field", "vector", "-k", "3", "--out", f"{tmp_path}/run"])
    lines = sorted((r["value"] for r in spark.read.text(f"{tmp_path}/run").collect()), key=lambda x: int(x.split()[3]))
    assert [x.split()[2] for x in lines] == ["f1", "f5", "f9"] and all(x.split()[0] == "q" for x in lines)
    # A word that training never saw is known by its n-grams.
    words = spark.createDataFrame([(1, 0, [60000, 60001, 60002, 60003, 99])], "k int, pos int, word array<int>")
    model = Word2VecModel.load(f"{tmp_path}/model")
    assert formulas.with_model(model, words, "k").count() <= 1


def test_subword_train_and_vectors_of_new_formulas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lemniscate.__main__.session", lambda *_, **__: spark)

    def folder(name, forms):
        rows = spark.createDataFrame([(f"{name}{i}", f, "1", "question") for i, f in enumerate(forms)], "id string, formula string, post_id string, type string")
        rows.coalesce(1).write.option("sep", "\t").option("header", True).csv(f"{tmp_path}/raw-{name}")
        (part,) = (tmp_path / f"raw-{name}").glob("part-*.csv")
        (tmp_path / name).mkdir()
        part.rename(tmp_path / name / "a.tsv")
        return ["--formulas", f"{tmp_path}/{name}", "--posts", f"{tmp_path}/posts"]

    spark.createDataFrame([(1,)], "post_id long").write.parquet(f"{tmp_path}/posts")
    (tmp_path / "config").write_text("vector_size,8\nwindow,3\nepoch,2\n")
    known = folder("known", [M % f"<mrow><mi>x</mi><mo>+</mo><mn>{i % 4}</mn></mrow>" for i in range(12)])
    new = folder("new", [M % "<mrow><mi>x</mi><mo>+</mo><mn>2</mn></mrow>", M % "<mrow><mi>q</mi><mo>-</mo><mi>z</mi></mrow>"])
    model = ["--model", f"{tmp_path}/model"]
    main(["train", "--subword", *known, *model, "--config", f"{tmp_path}/config", "--out", f"{tmp_path}/a"])
    main(["vectors", *new, *model, "--out", f"{tmp_path}/b"])
    seen = {r["formula_id"]: r["vector"] for r in spark.read.parquet(f"{tmp_path}/a").collect()}
    got = {r["formula_id"]: r["vector"] for r in spark.read.parquet(f"{tmp_path}/b").collect()}
    # A formula that training met has the vector it had there; one of unknown symbols has one too.
    assert set(got) == {"new0", "new1"} and len(got["new1"]) == 8 and any(got["new1"])
    assert all(abs(x - y) < 1e-12 for x, y in zip(got["new0"], seen["known2"]))
