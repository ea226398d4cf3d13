"""Collections of many files as data sources: against the plain readers, filters, repeated and awkward files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lemniscate.sources import datasource, readers
from lemniscate.sources.datasource import CollectionReader, FormulaPages, FormulaTuples, Part


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    datasource.register(spark)
    path = tmp_path_factory.mktemp("collection")
    pages = [("a", f"Page{n}.html", "<p>é</p>" + f"<m:math><m:mi>x{n}</m:mi><mws:qvar name='q'/></m:math>\n" * (n % 4), None) for n in range(40)]
    pages += [("b", "Müller.html", "<math>\n<mi>y</mi></math><math/>", 1), ("b", "Empty.html", None, 2), ("b", "Notes.txt", "<math></math>", 3), (None, "x.html", "", 4), ("c", None, "", 5)]
    rows = spark.createDataFrame(pages, "folder string, file string, content string, formula_id int")
    rows.repartition(3).write.format("formula_pages").mode("append").save(str(path))
    return str(path)


def sorted_rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_pages_equal_the_plain_reader(spark, root):
    mine = spark.read.format("formula_pages").load(root)
    want = sorted_rows(readers.wiki_collection(spark, root))
    # The plain reader takes math elements with an end tag, as this one does.
    assert sorted_rows(mine) == want and len(want) == 61
    assert sorted_rows(spark.read.format("formula_pages").option("parts", 1).load(f"file://{root}")) == want
    assert ("<math>\n<mi>y</mi></math>", "Muller:0", 0) in want


def opened(root, *filters):
    reader = CollectionReader(FormulaPages, root, 3)
    assert list(reader.pushFilters(list(filters))) == list(filters)
    return sorted(p.rpartition("/")[2] for part in reader.partitions() for p in reader.names(part))


def test_filters_leave_files_unopened(spark, root):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    assert len(opened(root)) == 42
    assert len(opened(root, GreaterThan(("formula_id",), "x"), EqualTo(("formula",), "x"))) == 42
    assert opened(root, EqualTo(("formula_id",), "Page1:0")) == ["Page1.html"]
    assert opened(root, In(("formula_id",), ("Page1:0", "Muller:1", "none", None))) == ["Müller.html", "Page1.html"]
    assert opened(root, StringStartsWith(("formula_id",), "Page3")) == ["Page3.html"] + [f"Page{n}.html" for n in range(30, 40)]
    assert opened(root, StringStartsWith(("formula_id",), "Page3:")) == ["Page3.html"]
    assert opened(root, EqualTo(("formula_id",), "Page1:0"), EqualTo(("formula_id",), "Page2:0")) == []
    mine = spark.read.format("formula_pages").load(root)
    asked = [F.col("formula_id") == "Page3:1", F.col("formula_id").isin("Page3:0", "Page2:7"), F.col("formula_id").startswith("Page1"), (F.col("ord") > 0) & (F.col("formula_id") != "Muller:1")]
    for f in asked:
        assert sorted_rows(mine.filter(f)) == sorted_rows(readers.wiki_collection(spark, root).filter(f))


def test_parts_share_the_files_of_a_folder(root):
    reader = CollectionReader(FormulaPages, root, 5)
    parts = reader.partitions()
    assert len(parts) == 10 and all(isinstance(p, Part) for p in parts)
    each = [list(reader.names(p)) for p in parts if p.folder.endswith("/a")]
    assert sum(map(len, each)) == len({x for e in each for x in e}) == 40 and sum(map(bool, each)) > 2


def test_tuples_equal_the_plain_reader(spark, tmp_path):
    datasource.register(spark)
    rows = [("f", "one.tsv", "a\tb\r\n\n c\n"), ("f", "two", "x"), ("f", "t.h.ree", "y\n"), ("f", ".hidden", "z"), ("g", "empty.tsv", "")]
    spark.createDataFrame(rows, "folder string, file string, content string").write.format("formula_tuples").mode("append").save(str(tmp_path))
    mine = spark.read.format("formula_tuples").load(str(tmp_path))
    want = [("one", ["a\tb", " c"]), ("t.h", ["y"]), ("two", ["x"])]
    assert sorted_rows(mine) == want
    assert sorted_rows(readers.tokenised_collection(spark, f"{tmp_path}/f").filter("formula_id <> ''")) == want
    assert mine.filter("formula_id = 't.h'").count() == 1
    assert FormulaTuples.formula("two") == "two"


def test_files_written_again_and_errors(spark, root, tmp_path):
    datasource.register(spark)
    write = lambda rows, mode="append": spark.createDataFrame(rows, "folder string, file string, content string").write.format("formula_pages").mode(mode).save(str(tmp_path))
    write([("a", "p.html", "<math>1</math>")])
    write([("a", "p.html", "<math>2</math>"), ("b", "q.html", "<math>3</math>")])
    assert sorted_rows(spark.read.format("formula_pages").load(str(tmp_path))) == [("<math>2</math>", "p:0", 0), ("<math>3</math>", "q:0", 0)]
    write([])
    with pytest.raises(Exception, match="mode append"):
        write([("a", "p.html", "")], "overwrite")
    with pytest.raises(Exception, match="not the name"):
        write([("..", "p.html", "")])
    with pytest.raises(Exception, match="there is no content"):
        spark.createDataFrame([("a", "b")], "folder string, file string").write.format("formula_pages").mode("append").save(str(tmp_path))
    with pytest.raises(Exception):  # noqa: B017  (a root that is missing)
        spark.read.format("formula_pages").load(f"{tmp_path}/none").count()
