"""Skip-gram training against plain loops; determinism, loss, unknown words, saved versions."""

from __future__ import annotations

import json
import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemniscate.operators import formulas, subword
from lemniscate.operators.subword import SubwordRules

RULES = SubwordRules(dims=6, buckets=64, contexts=32, window=2, negatives=3, rounds=3, rate=0.2, part=7, batch=3)


@pytest.fixture(scope="module")
def words(spark):
    # Two themes: words of one theme stand side by side.
    rows = [(f"s{k}", i, [60000 + (k % 2) * 10 + (k + i) % 4, 501, 60000 + (k % 2) * 10 + i % 3]) for k in range(30) for i in range(1 + k % 6)]
    return spark.createDataFrame([*rows, ("none", 0, None), ("empty", 0, [])], "k string, pos int, word array<int>")


def plain(given, rules):
    """The training by loops over pairs and components."""
    w, c = (x.tolist() for x in subword.start(rules))
    counts = [0] * rules.contexts
    for _, _, _, ctx in given:
        for x in ctx:
            counts[x] += 1
    share = np.cumsum(np.array(counts, float) ** 0.75) / max((np.array(counts, float) ** 0.75).sum(), 1e-300)
    for number in range(rules.rounds):
        moved = [{}, {}]
        for part in sorted({x[0] for x in given}):
            pw, pc = [list(x) for x in w], [list(x) for x in c]
            mine = sorted((x for x in given if x[0] == part), key=lambda x: x[1])
            rng = np.random.default_rng([rules.seed, number, part])
            for k in range(0, len(mine), rules.batch):
                pairs = []
                for _, _, b, ctx in mine[k : k + rules.batch]:
                    reach = rng.integers(1, rules.window + 1, len(b))
                    for i in range(len(b)):
                        pairs += [(b[i], ctx[j]) for j in range(len(b)) if j != i and abs(j - i) <= reach[i]]
                if not pairs:
                    continue
                draws = rng.random((len(pairs), rules.negatives))
                change = [{}, {}]
                for (b, x), draw in zip(pairs, draws):
                    h = [sum(pw[g][d] for g in b) / len(b) for d in range(rules.dims)]
                    targets = [x] + [min(int(np.searchsorted(share, r, side="right")), rules.contexts - 1) for r in draw]
                    to_h = [0.0] * rules.dims
                    for t, y in enumerate(targets):
                        g = (t == 0) - 1 / (1 + math.exp(-sum(p * q for p, q in zip(h, pc[y]))))
                        to_h = [a + g * q for a, q in zip(to_h, pc[y])]
                        change[1].setdefault(y, []).append([g * p for p in h])
                    for g in b:
                        change[0].setdefault(g, []).append(to_h)
                for table, rows in zip((pw, pc), change):
                    for k2, vs in rows.items():
                        table[k2] = [x + rules.rate * sum(v[d] for v in vs) / len(vs) for d, x in enumerate(table[k2])]
            for side, (old, new) in enumerate(((w, pw), (c, pc))):
                for k, (x, y) in enumerate(zip(old, new)):
                    if x != y:
                        moved[side].setdefault(k, []).append([q - p for p, q in zip(x, y)])
        for side, table in enumerate((w, c)):
            for k, vs in moved[side].items():
                table[k] = [x + sum(v[d] for v in vs) / len(vs) for d, x in enumerate(table[k])]
    return np.array(w)


def table_of(model):
    return np.array([r["vector"] for r in model.table.orderBy("bucket").collect()])


def test_equals_plain_loops_and_repeats_itself(spark, words):
    model = subword.train(words, "k", RULES)
    parts = words.select("k").distinct().count() // RULES.part + 1
    given = [tuple(r) for r in subword.sentences(words, "k", RULES, parts).collect()]
    assert len({x[0] for x in given}) > 2
    got = table_of(model)
    assert np.abs(got - plain(given, RULES)).max() < 1e-9
    assert np.abs(got - subword.start(RULES)[0]).max() > 1e-3
    again = subword.train(words.repartition(7), "k", RULES)
    assert (table_of(again) == got).all() and again.losses == model.losses
    other = subword.train(words, "k", SubwordRules(**{**RULES.__dict__, "seed": 2}))
    assert (table_of(other) != got).any()


def test_loss_falls_and_themes_part(spark, words):
    model = subword.train(words, "k", SubwordRules(dims=16, buckets=4096, contexts=512, window=3, rounds=25, rate=0.5, part=100, batch=4))
    assert model.losses[-1] < 0.8 * model.losses[0]
    asked = spark.createDataFrame([(i, 0, [60000 + 10 * t + x, 501, 60000 + 10 * t + x]) for i, (t, x) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)])], "k int, pos int, word array<int>")
    v = {r["k"]: np.array(r["vector"]) for r in model.vectors(asked, "k").collect()}
    cos = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
    assert cos(0, 1) > cos(0, 2) and cos(2, 3) > cos(1, 3)


def test_unknown_words_and_empty_tables(spark, words):
    model = subword.train(words, "k", RULES)
    new = spark.createDataFrame([(1, 0, [9, 8, 7, 6, 5]), (2, 0, [9]), (3, 0, None), (4, 0, [])], "k int, pos int, word array<int>")
    got = {r["k"]: r["vector"] for r in model.vectors(new, "k").collect()}
    assert set(got) == {1, 2} and all(len(v) == 6 for v in got.values())
    table = table_of(model)
    b = [r["b"] for r in new.filter("k = 1").select(subword.buckets(F.col("word"), RULES).alias("b")).collect()][0]
    assert np.allclose(got[1], table[b].mean(axis=0))
    none = subword.train(words.filter("false"), "k", RULES)
    assert (table_of(none) == subword.start(RULES)[0]).all() and none.losses == [0.0] * 3


def test_saved_model_answers_in_a_new_session(spark, words, tmp_path):
    model = subword.train(words, "k", RULES)
    model.save(f"{tmp_path}/model")
    subword.train(words, "k", SubwordRules(**{**RULES.__dict__, "seed": 5})).save(f"{tmp_path}/model")
    assert subword.versions(spark, f"{tmp_path}/model") == [1, 2]
    first = subword.load(spark, f"{tmp_path}/model", 1)
    assert (table_of(first) == table_of(model)).all() and first.rules == RULES and first.losses == model.losses
    assert (table_of(subword.load(spark, f"{tmp_path}/model")) != table_of(model)).any()
    with pytest.raises(ValueError):
        subword.load(spark, f"{tmp_path}/nothing")
    code = f"""
import json
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from lemniscate.operators import formulas, subword
new = spark.createDataFrame([(1, 0, [9, 8, 7, 6, 5])], "k int, pos int, word array<int>")
print("got", json.dumps(subword.load(spark, {str(tmp_path / "model")!r}, 1).vectors(new, "k").first()["vector"]))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=subword.__file__.split("/lemniscate/")[0], timeout=300)
    (line,) = [x for x in said.stdout.splitlines() if x.startswith("got ")]
    new = spark.createDataFrame([(1, 0, [9, 8, 7, 6, 5])], "k int, pos int, word array<int>")
    assert np.allclose(json.loads(line[4:]), model.vectors(new, "k").first()["vector"], atol=1e-12)


def test_registered_query_by_plain_loops(spark, monkeypatch):
    """The registered query's vectors are those of the loops over the same words."""
    from lemniscate.plans import formula_queries

    rules = SubwordRules(dims=4, buckets=128, contexts=64, window=2, negatives=2, rounds=1, part=60, batch=8)
    monkeypatch.setattr(formula_queries, "SUBWORD", rules)
    sf = "/root/testdata/sf0.001"
    got = {r["p_partkey"]: r["vector"] for r in formula_queries.subword_vectors(spark, sf).collect()}
    words, _ = formulas.words_of(formula_queries.part_formulas(spark, sf), "slt", "p_partkey")
    parts = words.select("p_partkey").distinct().count() // rules.part + 1
    given = [tuple(r) for r in subword.sentences(words, "p_partkey", rules, parts).collect()]
    w = plain(given, rules)
    assert len(got) == len(given) == 200 and parts == 4
    for _, at, b, _ in given:
        want = np.mean([w[x].mean(axis=0) for x in b], axis=0)
        assert np.allclose([float(x) for x in got[json.loads(at)["p_partkey"]].split(",")], want, atol=1.1e-6)


def test_vectors_give_no_row_for_each_bucket(spark):
    """Means of means over many batches of keys, in one grouping by key."""
    w = subword.start(RULES)[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "bucket int, vector array<double>")
    model = subword.SubwordModel(RULES, table, [])
    words = spark.range(2500).selectExpr("id AS k", "explode(sequence(0, int(id % 3))) AS pos").selectExpr("k", "pos", "array(int(k), pos, 7) AS word")
    found = model.vectors(words, "k")
    assert found._jdf.queryExecution().executedPlan().toString().count("Generate") == 1  # that of the words above
    b = {}
    for r in words.select("k", subword.buckets(F.col("word"), RULES).alias("b")).collect():
        b.setdefault(r["k"], []).append(w[r["b"]].mean(axis=0))
    got = {r["k"]: r["vector"] for r in found.collect()}
    assert got.keys() == b.keys() and all(np.allclose(got[k], np.mean(x, axis=0)) for k, x in b.items())
