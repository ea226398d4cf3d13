"""Trees, tuples, tokens and ids on hand-derived examples."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lemniscate.functions import mathml
from lemniscate.functions.text import cut_text, from_run_lengths, run_lengths, short_path, stem
from lemniscate.operators import formulas

M = '<math xmlns="http://www.w3.org/1998/Math/MathML">%s</math>'
SLT = {
    "<mrow><mi>x</mi><mo>+</mo><mn>2</mn></mrow>": "[V!x[+[N!2]]]",
    "<msup><mi>x</mi><mn>2</mn></msup>": "[V!x,a[N!2]]",
    "<mfrac><mn>1</mn><mi>y</mi></mfrac>": "[O!divide,o[N!1],u[V!y]]",
    "<msub><mo>∑</mo><mi>i</mi></msub>": "[∑,u[V!i]]",
    "<mrow><mo>(</mo><mi>a</mi><mo>,</mo><mi>b</mi><mo>)</mo></mrow>": "[M!()1x2,w[V!a[&comma;],e[V!b]]]",
    "<msup><mrow><mi>x</mi><mi>y</mi></mrow><mn>2</mn></msup>": "[M!1x1,a[N!2],w[V!x[V!y]]]",
    "<mroot><mi>x</mi><mn>3</mn></mroot>": "[O!root,c[N!3],w[V!x]]",
    "<msqrt><mi>x</mi></msqrt>": "[O!root,w[V!x]]",
    "<mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd><mtd/></mtr></mtable>": "[M!2x2,w[N!1,e[N!2,e[N!3,e[W!]]]]]",
    "<mrow><mi>f</mi><mo>⁡</mo><mtext>a?</mtext></mrow>": "[V!f[T!a&quest;]]",
    "<mmultiscripts><mi>F</mi><mi>a</mi><mi>b</mi><mprescripts/><mi>c</mi><none/></mmultiscripts>": "[V!F,a[V!b],b[V!a],d[V!c]]",
    "<mfenced open='['><mi>a</mi><mi>b</mi></mfenced>": "[M!&lsqb;)1x2,w[V!a[,],e[V!b]]]",
}
OPT = {
    "<apply><plus/><ci>x</ci><cn>2</cn></apply>": "[U!plus,0[V!x],1[N!2]]",
    "<apply><ci>f</ci><ci>x</ci></apply>": "[F!f,0[V!x]]",
    "<apply><root/><ci>x</ci></apply>": "[O!root,0[V!x],1[N!2]]",
    "<apply><int/><ci>x</ci></apply>": "[O!int,0[V!x],1[W!],2[W!]]",
    "<apply><apply><csymbol cd='ambiguous'>subscript</csymbol><ci>f</ci><cn>1</cn></apply><ci>x</ci></apply>": "[+!V!f,0[O!SUB,0[V!f],1[N!1]],1[V!x]]",
    "<interval closure='open'><cn>0</cn><cn>1</cn></interval>": "[O!interval(O-O),0[N!0],1[N!1]]",
    "<matrix><matrixrow><cn>1</cn><cn>2</cn></matrixrow><matrixrow><cn>3</cn></matrixrow></matrix>": "[M!M-2x2,0[M!R!,0[N!1],1[N!2]],1[M!R!,0[N!3],1[E!]]]",
}


@pytest.mark.parametrize("markup,tree", SLT.items())
def test_layout(markup, tree):
    assert mathml.written(mathml.tree("slt", M % markup), "slt") == tree


@pytest.mark.parametrize("markup,tree", OPT.items())
def test_operators(markup, tree):
    assert mathml.written(mathml.tree("opt", M % markup), "opt") == tree


def test_many_children_split():
    node = mathml.tree("opt", M % ("<apply><plus/>" + "<ci>x</ci>" * 100 + "</apply>"))
    assert len(node[1]) == 2 and all(len(c[1]) == 50 for _, c in node[1])


def trees(edges):
    tag = st.text("abV!x+12", min_size=1, max_size=4)
    return st.recursive(
        tag.map(lambda t: (t, [])),
        lambda kids: st.tuples(tag, st.dictionaries(st.sampled_from(edges), kids, max_size=3).map(lambda d: sorted(d.items(), key=lambda x: edges.index(x[0])))),
        max_leaves=12,
    )


@settings(max_examples=60, deadline=None)
@given(trees(mathml.EDGE_ORDER))
def test_layout_round_trip(node):
    assert mathml.read(mathml.written(node, "slt")) == node


@settings(max_examples=60, deadline=None)
@given(st.text("nabou", max_size=40))
def test_run_lengths(path):
    assert from_run_lengths(run_lengths(path)) == path
    assert len(short_path(path)) <= max(5, 2 * len(path))


def sequential(node, kind, window):
    """Pairs by a plain recursive walk."""
    label = lambda t, e: "0" if kind == "opt" and t[0].startswith("U") else e

    def below(n, path):
        out, stack = [], [(n, path)]
        while stack:
            x, p = stack.pop()
            out.append((x[0], p))
            if len(p) < window:
                kids = sorted(x[1], key=lambda k: "nabouc dwe".index(k[0])) if kind == "slt" else x[1]
                stack += [(c, p + label(x, e)) for e, c in kids]
        return out

    def pairs(n, loc):
        out = []
        for e, c in n[1]:
            out += [(n[0], t, p, loc or "-") for t, p in below(c, label(n, e))]
            out += pairs(c, loc + label(n, e))
        if not (any(e == "n" for e, _ in n[1]) if kind == "slt" else n[1]):
            out.append((n[0], "0!", "n" if kind == "slt" else "0", loc or "-"))
        return out

    return [(a, b, short_path(p), l if l == "-" else short_path(l)) for a, b, p, l in pairs(node, "")]


def test_tuples_match_a_plain_walk(spark):
    rnd = random.Random(3)

    def grow(depth, edges):
        kids = sorted(rnd.sample(edges, rnd.randrange(0, 4)), key=edges.index) if depth else []
        return (rnd.choice(["V!x", "U!plus", "N!2", "+", "O!"]), [(e, grow(depth - 1, edges)) for e in kids])

    for kind, edges in (("slt", list(mathml.EDGE_ORDER)), ("opt", None)):
        made = [grow(4, edges or list("012")) for _ in range(12)]
        if kind == "opt":
            fix = lambda n: (n[0], [(str(i), fix(c)) for i, (_, c) in enumerate(n[1])])
            made = [fix(n) for n in made]
        rows = [(i, [dict(zip(("path", "tag", "above", "last", "walk"), x)) for x in mathml.flat(n, kind)]) for i, n in enumerate(made)]
        df = spark.createDataFrame(rows, "k int, nodes array<struct<path:string,tag:string,above:array<int>,last:int,walk:int>>")
        for window in (1, 2, 4):
            got = {}
            for r in formulas.tuples(df, "k", kind, window).orderBy("k", "pos").collect():
                got.setdefault(r["k"], []).append((r["s1"], r["s2"], r["rel_path"], r["loc"]))
            assert got == {i: sequential(n, kind, window) for i, n in enumerate(made)}


def test_worked_example(spark):
    df = spark.createDataFrame([(1, M % "<mrow><mi>x</mi><mo>+</mo><mn>2</mn></mrow>"), (2, "<bad"), (3, None), (4, M % "<mfoo/>")], "formula_id int, formula string")
    parsed = formulas.parsed(df)
    errors = {r["formula_id"]: r["error"] for r in parsed.collect()}
    assert errors[1] is None and errors[2] and errors[3] is None and errors[4]
    pairs = formulas.tuples(parsed, "formula_id")
    assert [tuple(r)[2:] for r in pairs.orderBy("pos").collect()] == [
        ("V!x", "+", "n", "-"), ("V!x", "N!2", "nn", "-"), ("+", "N!2", "n", "n"), ("N!2", "0!", "n", "nn"),
    ]
    tokens = formulas.tokenised(pairs, "both_separated", True)
    ids = {(r["kind"], r["symbol"]): r["id"] for r in formulas.dictionary(tokens, "formula_id").collect()}
    assert ids == {("N", "V!"): 60000, ("N", "x"): 60001, ("N", "+"): 60002, ("N", "N!"): 60003, ("N", "2"): 60004, ("N", "0!"): 60005, ("N", ""): 60006, ("E", "n"): 500}
    known = spark.createDataFrame([("N", "V!", 70000), ("E", "n", 500)], "kind string, symbol string, id int")
    grown = {(r["kind"], r["symbol"]): r["id"] for r in formulas.dictionary(tokens, "formula_id", known).collect()}
    assert grown["N", "V!"] == 70000 and grown["N", "x"] == 70001 and len(grown) == len(ids)


def test_vectors(spark):
    both = "<semantics><annotation-xml encoding='MathML-Presentation'>%s</annotation-xml><annotation-xml encoding='MathML-Content'>%s</annotation-xml></semantics>"
    rows = [(i, M % (both % (a, b))) for i, (a, b) in enumerate(zip(SLT, OPT))] + [(99, M % "<mi>x</mi>")]
    out = {r["formula_id"]: r for r in formulas.representations(spark.createDataFrame(rows, "formula_id int, formula string"), dims=8).collect()}
    assert len(out[0]["formula_vector"]) == 8 and out[0]["formula_vector"] == pytest.approx([a + b + c for a, b, c in zip(out[0]["slt_vector"], out[0]["opt_vector"], out[0]["slt_type_vector"])])
    assert out[99]["slt_vector"] is not None and out[99]["formula_vector"] is None
    texts = formulas.text_vectors(spark.createDataFrame([(1, "a b"), (2, None), (3, "a c")], "doc_id int, text string"), 16).collect()
    assert all(len(r["vector"]) == 16 for r in texts)


def test_latex():
    tree = lambda s: mathml.written(mathml.tree("slt", mathml.latex_markup(s)), "slt")
    assert tree("x+2") == "[V!x[+[N!2]]]"
    assert tree(r"\frac{1}{y}") == "[O!divide,o[N!1],u[V!y]]"
    assert tree(r"\sum_{i}^n x_i^2") == "[∑[V!x,a[N!2],b[V!i]],o[V!n],u[V!i]]"
    assert tree(r"\sqrt[3]{\alpha}") == "[O!root,c[N!3],w[V!α]]"
    assert tree(r"\hat{x}\not\in\mathbb{R}^{+}") == "[V!x[∉[V!R,a[+]]],o[^]]"
    assert tree(r"(a)^2") == "[M!()1x1,a[N!2],w[V!a]]" and tree("f'") == "[V!f,a[′]]"
    assert tree(r"\begin{pmatrix}a&b\\[2pt]c&d\end{pmatrix}") == "[M!()2x2,w[V!a,e[V!b,e[V!c,e[V!d]]]]]"
    assert tree(r"\underset{x}{\max}\,\Gamma") == "[V!max[V!Γ],u[V!x]]"
    for broken in (r"\unknown{x}", "{x", r"\frac1", "a_", r"\begin{matrix}a", r"\\ x", "}", r"\text{x", "{" * 5000):
        assert mathml.latex_markup(broken) is None, broken


@pytest.mark.parametrize(
    ("latex", "expected"),
    [
        ("a+b+c", "[U!plus,0[V!a],1[V!b],2[V!c]]"),
        ("-a", "[O!minus,0[V!a]]"),
        ("a=b=c", "[U!and,0[U!eq,0[V!a],1[V!b]],1[U!eq,0[V!b],1[V!c]]]"),
        ("&=c", None),
        ("=c", "[U!eq,0[W!],1[V!c]]"),
        (r"2\sin x<1", "[O!lt,0[U!times,0[N!2],1[F!sin,0[V!x]]],1[N!1]]"),
        (r"\int e^x", "[O!int,0[O!SUP,0[V!e],1[V!x]],1[W!],2[W!]]"),
        (r"(a-b)^2", "[O!SUP,0[O!minus,0[V!a],1[V!b]],1[N!2]]"),
        (r"\{1,2\}", "[M!S-1,0[M!L-2,0[N!1],1[N!2]]]"),
        (r"n!", "[O!factorial,0[V!n]]"),
        (r"\left|\begin{matrix}1&2\end{matrix}\right|", "[F!det,0[M!M-1x2,0[M!R!,0[N!1],1[N!2]]]]"),
        (r"\sqrt[3]{x}", "[O!root,0[V!x],1[N!3]]"),
        (r"a\pm b", "[O!plus-or-minus,0[V!a],1[V!b]]"),
        ("(x", None),
        ("", None),
    ],
)
def test_content_of_latex(latex, expected):
    markup = mathml.latex_content(latex)
    assert (markup and mathml.written(mathml.tree("opt", markup), "opt")) == expected


def test_latex_columns(spark):
    df = spark.createDataFrame([(1, "x+1"), (2, None), (3, r"\nosuch"), (4, "x+1")], "id long, latex string")
    got = {r["id"]: (r["m"], r["c"]) for r in df.select("id", formulas.latex_markup("latex").alias("m"), formulas.latex_content("latex").alias("c")).collect()}
    assert got[2] == got[3] == (None, None) and got[1] == got[4] and None not in got[1]
    read = {r["id"]: (r["tree"], r["error"]) for r in formulas.parsed_latex(df, "opt").collect()}
    assert read[1] == ("[U!plus,0[V!x],1[N!1]]", None) and read[2] == (None, None)
    assert read[3] == (None, "LaTeX that isn't understood")


def test_tokens(spark):
    df = spark.createDataFrame([("N!123",), ("+",), ("O!",), ("V!x",), ("M!R!",)], "tag string")
    got = lambda mode, numbers=False: {r[0]: r[1] for r in df.select("tag", formulas.node_tokens(F.col("tag"), mode, numbers)).collect()}
    assert got("both_separated", True) == {"N!123": ["N!", "1", "2", "3"], "+": ["+"], "O!": ["O!"], "V!x": ["V!", "x"], "M!R!": ["M!", "R"]}
    assert got("type")["N!123"] == ["N!"] and got("value")["V!x"] == ["x"] and got("both")["M!R!"] == ["M!R!"]


def test_small_text_functions():
    assert cut_text("a" * 60) == "a" * 50
    assert cut_text("words before " + "$" + "x" * 45 + "$ after") == "words before $" + "x" * 45 + "$"
    assert cut_text("words here before " + "$" + "x" * 100 + "$") == "words here before"
    assert [stem(w) for w in ("running", "ponies", "relational", "hopping", "agreed", "sky", "happy", "adjustable")] == ["run", "poni", "relat", "hop", "agre", "sky", "happi", "adjust"]


def test_numbers_share_a_shape(spark):
    given = [
        "<math><mrow><msub><mi>x</mi><mn>1</mn></msub><mo>+</mo><mn>23</mn></mrow></math>",
        "<math><mrow><msub><mi>x</mi><mn>7</mn></msub><mo>+</mo><mn>8</mn></mrow></math>",
        '<math><mrow><mn id="a">4</mn><mo>+</mo><mn>5.5</mn></mrow></math>',
        "<math><!-- <mn>9</mn> --><mi><![CDATA[<mn>3</mn>]]></mi></math>",
        "<math><mrow><mi>0</mi><mn>2</mn></mrow></math>",
        "<math><mrow><mi>a</mi><mn></mn><mn>6</mn></mrow></math>",
        "<math><zz/><mn>1</mn></math>", "<math><mn>1</mn>", "", None,
    ]
    rows = spark.createDataFrame(list(enumerate(given)), "k int, formula string")
    assert formulas.shapes(formulas._kept(rows.filter("k < 2"), "formula", ["k"]), "_f").count() == 1
    one = {r["k"]: r for r in formulas.parsed(rows).collect()}
    for k, markup in enumerate(given):
        tree = None
        if markup:
            try:
                tree = mathml.tree("slt", markup)
            except (mathml.UnknownTag, mathml.ET.ParseError) as e:
                assert one[k]["error"] == f"{type(e).__name__}: {e}"
        assert one[k]["tree"] == (tree and mathml.written(tree, "slt"))
        assert (one[k]["nodes"] and [tuple(n) for n in one[k]["nodes"]]) == (tree and list(mathml.flat(tree, "slt")))
    parsed = formulas.parsed(rows).filter("nodes IS NOT NULL")
    assert sorted(map(tuple, formulas.shaped_tuples(rows, "k").collect())) == sorted(map(tuple, formulas.tuples(parsed, "k").collect()))
    assert sorted(map(tuple, formulas.shaped_stats(rows, "k").collect())) == sorted(map(tuple, formulas.tree_stats(parsed, "k").collect()))
    assert sorted(formulas.shaped_nodes(rows, "k").collect()) == sorted(parsed.select("k", "nodes").collect())
    assert {r["k"]: r["formula"] for r in formulas.trees(rows, {"formula": "slt"}, ["k"]).collect()} == {k: r["tree"] for k, r in one.items()}


def test_words_by_shape(spark, monkeypatch):
    """Dictionary and words by way of shapes are those of the tokens of all pairs, over-long pairs left out."""
    row = lambda *x: M % f"<mrow>{''.join(x)}</mrow>"
    given = [
        row("<msub><mi>x</mi><mn>1</mn></msub>", "<mo>+</mo>", "<mn>23</mn>"), row("<msub><mi>x</mi><mn>701</mn></msub>", "<mo>+</mo>", "<mn>1</mn>"),
        row("<mn>5</mn>", "<mo>+</mo>", f"<mn>{'9876' * 49}</mn>"), row("<mn>5</mn>", "<mo>+</mo>", "<mn>6</mn>"), row(f"<mn>{'12' * 60}</mn>", "<mo>+</mo>", f"<mn>{'3' * 100}</mn>"),
        M % "<!-- <mn>9</mn> --><mi>y</mi>", M % "<mn>4.5</mn>", row("<mi>\ue000</mi>", "<mn>77</mn>"), M % "<mi>z</mi>", "<bad", None,
        M % "<apply><plus/><ci>x</ci><cn>2</cn></apply>", M % "<apply><plus/><ci>x</ci><cn>2</cn><cn>40</cn></apply>",
    ]
    rows = spark.createDataFrame([(f"k{90 - i}", x) for i, x in enumerate(given)], "formula_id string, formula string")
    start = spark.createDataFrame([("N", "V!", 70000), ("N", "7", 70001), ("N", "2", 70002)], "kind string, symbol string, id int")
    both = {"slt": rows, "slt_type": rows, "opt": rows}
    want = {}
    for kind, df in both.items():
        for known in (None, start):
            tokens = formulas.tokenised(formulas.short_enough(formulas.shaped_tuples(df, "formula_id", kind[:3])), *formulas.MODES[kind])
            ids = formulas.dictionary(tokens, "formula_id", known)
            want[kind, known is None] = sorted(map(tuple, ids.collect())), sorted(map(tuple, formulas.encoded(tokens, "formula_id", ids).collect()))
    assert all(len(w) > 4 for _, w in want.values())
    # Nothing goes through the tokens of all pairs.
    for name in ("tokenised", "encoded", "shaped_tuples"):
        monkeypatch.setattr(formulas, name, None)
    for kind, df in both.items():
        for known in (None, start):
            words, ids = formulas.words_of(df, kind, known=known)
            assert (sorted(map(tuple, ids.collect())), sorted(map(tuple, words.collect()))) == want[kind, known is None], kind
            assert sorted(map(tuple, formulas.dictionary_of(df, kind, known=known).collect())) == want[kind, known is None][0]
