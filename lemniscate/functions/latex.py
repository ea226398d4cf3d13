"""Normalisation of LaTeX inside texts, as chains of replacements on columns.

A step is either ("plain", what, by) or ("regex", pattern, by), with groups
written $1.  The same steps serve as Column expressions here and as SQL for
comparison.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lemniscate.functions.text import stripped

Step = tuple[str, str, str]

# What each named step replaces, in the order of application.
STEPS: dict[str, list[Step]] = {
    "basic": [
        ("plain", " ", ""),
        ("plain", "\\textrm{}", ""),
        ("plain", "\\left", ""),
        ("plain", "\\right", ""),
        ("plain", "\\quad", ""),
        ("plain", "\\leqslant", "\\leq"),
        ("plain", "|", "\\mid"),
        ("plain", "\\\\", ""),
        ("plain", "\n", ""),
    ],
    "underset": [
        ("regex", r"\\underset\{([^}]+)\}\{lim\}", r"\\lim_{$1}"),
        ("regex", r"\\underset\{([^}]+)\}\{([^}]+)\}", r"\\underset{$1}$2"),
    ],
    "operatorname": [("regex", r"\\operatorname\{([^}]+)\}", "$1")],
    "bold": [("regex", r"\\(?:mathbf|boldsymbol|bm|mathbb|mathsf|mathit)\{([^}]+)\}", "$1")],
    "vectors": [("regex", r"\\vec\{([^}]+)\}", "$1")],
    "superscripts": [("regex", r"\^\{([^}]+)\}", "^$1")],
    "parentheses": [("regex", r"\(\(([^()]+)\)\)", "($1)"), ("regex", r"\b(\w+)\((\w+)\)", "$1$2")],
    "dots": [("regex", r"(?<!\d)\.|\.(?!\d)", ""), ("plain", "\\cdot", "")],
    "angles": [
        ("plain", "sin", "sen"),
        ("plain", "\\sen", "sen"),
        ("plain", "\\cos", "cos"),
        ("plain", "\\tan", "tg"),
        ("plain", "\\sec", "sec"),
        ("plain", "\\csc", "csc"),
        ("plain", "\\cot", "cot"),
    ],
    "special": [("regex", "[\u2000-\u206f\ufeff]", "")],
    "brackets": [("plain", "\u3008", "\\langle"), ("plain", "\u3009", "\\rangle")],
    "primes": [("plain", "\\prime", "'")],
    "mathrm": [("regex", r"\\mathrm\{~?(\w+)\}", "$1")],
    "text": [("regex", r"\\text\{([^}]*)\}", "$1")],
    "overs": [
        ("regex", r"\\overline\{([^}]*)\}", "$1"),
        ("regex", r"\\overset\{[^}]*\}\{([^}]*)\}", "$1"),
        ("regex", r"\\overrightarrow\{([^}]*)\}", "$1"),
        ("regex", r"\\hat\{([^}]*)\}", "$1"),
    ],
    "integrals": [
        ("plain", "(\\int)", "\\int"),
        ("plain", "(\\iint)", "\\iint"),
        ("plain", "(\\iiint)", "\\iiint"),
        ("plain", "int_", "int"),
        ("plain", "\\int\\int\\int", "\\iiint"),
        ("plain", "\\int\\int", "\\iint"),
    ],
}
# What is replaced in the whole text after its formulas are done.
OUTSIDE: list[Step] = [
    ("plain", "$$", " "),
    ("plain", "$", " "),
    ("plain", "\\textrm{ }", ""),
    ("plain", "\\left", ""),
    ("plain", "\\right", ""),
    ("plain", "\\leqslant", "\\leq"),
    ("regex", r"\s+", " "),
]
# Fixed value: a formula span in a text.
SPAN = r"\$\$[\s\S]*?\$\$|\$[^\n]*?\$|\\\[.*?\\\]|\\begin\{.*?\}[\s\S]*?\\end\{.*?\}"
#: Shorter formulas are not extracted.
MIN_FORMULA = 6


def applied(x: Column, steps: list[Step]) -> Column:
    for kind, what, by in steps:
        # Letters, digits and spaces of any script count as such.
        x = F.replace(x, F.lit(what), F.lit(by)) if kind == "plain" else F.regexp_replace(x, f"(?U){what}", by)
    return x


def cleaned_formula(x: Column) -> Column:
    """A formula span through all steps."""
    for name, steps in STEPS.items():
        x = applied(stripped(x) if name == "underset" else x, steps)
    return x


def cleaned(text: Column) -> Column:
    """A text with its formula spans normalised, delimiters dropped and white space collapsed."""
    between = F.split(text, SPAN, -1)
    inside = F.transform(F.regexp_extract_all(text, F.lit(SPAN), F.lit(0)), cleaned_formula)
    woven = F.zip_with(between, inside, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.trim(applied(F.array_join(woven, ""), OUTSIDE))


# Fixed value: a span's inside, by kind of delimiter.
INSIDE = r"(?s)^(?:\$\$(.*)\$\$|\$(.*)\$|\\\[(.*)\\\]|\\begin\{.*?\}(.*)\\end\{.*?\})$"


def formulas(text: Column) -> Column:
    """Insides of the formula spans that have more than five characters, each as ``$…$``."""
    spans = F.regexp_extract_all(text, F.lit(SPAN), F.lit(0))
    bare = F.transform(spans, lambda x: stripped(F.regexp_replace(x, INSIDE, "$1$2$3$4")))
    return F.transform(F.filter(bare, lambda x: F.length(x) >= MIN_FORMULA), lambda x: F.concat(F.lit("$"), x, F.lit("$")))
