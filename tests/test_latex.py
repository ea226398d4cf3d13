"""Formula cleaning against values written out by hand, and against the patterns read as Python reads them."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lemniscate.functions import latex

# step, formula, what becomes of it
GOLDEN = [
    ("basic", r"\left( x + 1 \right) \quad \leqslant \textrm{} |y| \\ z", r"(x+1)\leq\midy\midz"),
    ("underset", r"\underset{x\to0}{lim}f+\underset{i=1}{n}", r"\lim_{x\to0}f+\underset{i=1}n"),
    ("operatorname", r"\operatorname{sen}(x)", "sen(x)"),
    ("bold", r"\mathbf{v}+\mathbb{R}+\boldsymbol{a}+\mathit{x}", "v+R+a+x"),
    ("vectors", r"\vec{AB}+\vec{u}", "AB+u"),
    ("superscripts", r"x^{2+n}+y^{2}", "x^2+n+y^2"),
    ("parentheses", "((x+1))+f(x)+g(2)", "(x+1)+fx+g2"),
    ("parentheses", "função(é)+((ação))", "funçãoé+(ação)"),
    ("dots", r"a.b1.5+2.\cdot1.2.3", "ab1.5+21.2.3"),
    ("angles", r"sin(x)+\cos(y)+\tan(z)+\sec\csc\cot", "sen(x)+cos(y)+tg(z)+seccsccot"),
    ("special", "x​1 y﻿", "x1y"),
    ("brackets", "〈a,b〉", r"\langlea,b\rangle"),
    ("primes", r"f^{\prime}(x)", "f^{'}(x)"),
    ("mathrm", r"\mathrm{kg}+\mathrm{~m}", "kg+m"),
    ("mathrm", r"\mathrm{área}+\mathrm{~ção}", "área+ção"),
    ("text", r"x+\text{valor é}+\text{}", "x+valor é+"),
    ("overs", r"\overline{AB}+\overset{*}{x}+\overrightarrow{P}+\hat{v}", "AB+x+P+v"),
    ("integrals", r"\int_a^b+(\int)g+\int\int h+\int\int\int", r"\inta^b+\intg+\iint h+\iiint"),
]


def test_golden(spark):
    rows = spark.createDataFrame([(i, f) for i, (_, f, _) in enumerate(GOLDEN)], "i int, f string")
    made = rows.select("i", *[latex.applied(F.col("f"), steps).alias(name) for name, steps in latex.STEPS.items()])
    got = {r["i"]: r.asDict() for r in made.collect()}
    assert [got[i][name] for i, (name, _, _) in enumerate(GOLDEN)] == [want for _, _, want in GOLDEN]


@pytest.mark.parametrize("text", ["Seja $\\mathrm{área}+f(é)$ dada", "a  b c", "$$x^{2}$$ e $y$", "", "só texto"])
def test_as_python_reads_the_patterns(text, spark):
    def step(x, steps):
        for kind, what, by in steps:
            x = x.replace(what, by) if kind == "plain" else re.sub(what, re.sub(r"\$(\d)", r"\\\1", by), x)
        return x

    def formula(m):
        x = m[0]
        for name, steps in latex.STEPS.items():
            x = step(x.strip() if name == "underset" else x, steps)
        return x

    want = step(re.sub(latex.SPAN, formula, text), latex.OUTSIDE).strip()
    assert spark.createDataFrame([(text,)], "t string").select(latex.cleaned(F.col("t"))).first()[0] == want
