"""Formulas to symbol trees: presentation markup, content markup and simple LaTeX.

A tree leaves Python as a flat list of nodes (path, tag, ancestors, order
numbers); everything after that is done on columns.  A layout tree is held as
rows: a row is a list of symbols side by side, and each symbol has further rows
by the edge that leads to them (a above, b below, o over, u under, c and d
before above and below, w within); cells of a matrix follow each other by e.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

# Edge order of pair extraction and of the walk below a symbol.
EDGE_ORDER = "aocnbudew"
WALK_ORDER = "ewdcuoban"
# How a symbol's text is escaped, and signs that stand for nothing.
ESCAPES = {"\t": "\\t", "\n": "\\n", "\r": "\\r", "?": "&quest;", ",": "&comma;", "[": "&lsqb;", "]": "&rsqb;"}
INVISIBLE = "⁡⁢⁣⁤"
MAX_CHILDREN = 62
CHILD_LABELS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


class UnknownTag(ValueError):
    """A tag or symbol that the trees don't know."""


@dataclass
class Sym:
    tag: str
    sub: dict[str, list[Sym]] = field(default_factory=dict)
    cells: list[list[Sym]] = field(default_factory=list)


Row = list[Sym]


def clean(text: str | None) -> str:
    out = "".join(ESCAPES.get(c, c) for c in (text or "").strip())
    return "" if out in INVISIBLE else out


def _typed(kind: str, text: str | None) -> Row:
    content = clean(text)
    return [Sym(kind + content if content else "W!")]


def _blank(row: Row) -> bool:
    return not row or (len(row) == 1 and row[0].tag in ("W!", "") and not row[0].sub and not row[0].cells)


def _joined(rows: list[Row]) -> Row:
    return [s for r in rows for s in r]


def _matrix(rows: list[list[Row]]) -> Sym:
    cells = [c or [Sym("W!")] for r in rows for c in r]
    return Sym(f"M!{len(rows)}x{len(rows[0]) if rows else 0}", cells=cells)


def _plain_size(s: Sym) -> tuple[int, int] | None:
    m = re.fullmatch(r"M!(\d+)x(\d+)", s.tag)
    return (int(m[1]), int(m[2])) if m else None


def _side_by_side(rows: list[Row]) -> Row:
    """Rows one after the other; plain matrices of as many rows become one."""
    out: Row = []
    last: Sym | None = None
    for r in rows:
        a, b = (_plain_size(last) if last else None), _plain_size(r[0])
        if a and b and a[0] == b[0]:
            left, right = last.cells, r[0].cells
            last.cells = [c for k in range(a[0]) for c in left[k * a[1] : (k + 1) * a[1]] + right[k * b[1] : (k + 1) * b[1]]]
            last.tag = f"M!{a[0]}x{a[1] + b[1]}"
            out += r[1:]
        else:
            out += r
            last = r[0]
    return out


def _fenced(rows: list[Row], separators: list[str]) -> Row:
    """Rows between two fences as a 1 x n matrix whose cells end with their separators."""
    fences = rows[0][0].tag + (rows[-1][0].tag if len(rows) > 1 else "")
    inner = rows[1:-1]
    only = inner[0] if len(inner) == 1 else None
    if only and len(only) == 1 and only[0].tag.startswith("M!") and only[0].tag[2:3] not in tuple("({|&∥") and not only[0].sub:
        only[0].tag = "M!" + fences + only[0].tag[2:]
        return only
    if not inner:
        return [Sym("M!" + fences)]
    parts = [[s] for s in only] if only else inner
    separates = lambda r: len(r) >= 1 and (r[0].tag in separators or (r[0].tag == "&comma;" and "," in separators))
    cells, n, fresh = [[]], 1, False
    for k, part in enumerate(parts):
        if separates(part):
            n += 1
            cells[-1] += part if cells[-1] else [Sym("W!"), *part]
            fresh = True
        else:
            if fresh:
                cells.append([])
            cells[-1] += part
            fresh = False
    return [Sym(f"M!{fences}1x{n}", cells=cells)]


def _scripted(rows: list[Row], *labels: str, plain: bool = False) -> Row:
    """A base and its scripts; on operators sub and sup become under and over unless ``plain``."""
    if len(rows) != len(labels) + 1:
        return _joined([r for r in rows if not _blank(r)])
    base = [Sym("W!")] if _blank(rows[0]) else rows[0]
    head = base[0].tag
    if not plain and not (head.startswith("?") or head[1:2] == "!"):
        labels = tuple({"b": "u", "a": "o"}[x] for x in labels)
    if len(base) > 1 or any(x in base[0].sub for x in labels):
        base = [_matrix([[base]])]
    base[0].sub |= {x: r for x, r in zip(labels, rows[1:]) if r}
    return base


def _multiscripts(elem: ET.Element) -> Row:
    rows: list[Row | None] = [None if _name(c) == "mprescripts" else layout(c) for c in elem]
    if not rows:
        return []
    at = rows.index(None) if None in rows else len(rows)
    base = [Sym("W!")] if _blank(rows[0] or []) else rows[0]
    for scripts, low, high in ((rows[1:at], "b", "a"), (rows[at + 1 :], "d", "c")):
        for k, label in ((0, low), (1, high)):
            side = [r or [] for r in scripts[k::2]]
            if side and _blank(side[-1]):
                side.pop()
            if row := _joined(side):
                base[0].sub[label] = row
    return base


def _name(elem: ET.Element) -> str:
    return elem.tag.rpartition("}")[2]


def layout(elem: ET.Element) -> Row:
    """Presentation markup as a row."""
    name = _name(elem)
    if name == "math":
        if len(elem) > 1:
            raise UnknownTag("math with several children")
        return layout(elem[0]) if len(elem) else []
    if name in ("semantics", "mstyle"):
        return layout(elem[0]) if len(elem) else []
    if name in ("mn", "mi", "mtext"):
        return _typed({"mn": "N!", "mi": "V!", "mtext": "T!"}[name], elem.text)
    if name == "mo":
        return [Sym(clean(elem.text))]
    if name in ("mspace", "none", "mphantom"):
        return [Sym("W!")]
    if name == "qvar":
        return [Sym("?" + elem.get("name", clean(elem.text)))]
    if name == "merror":
        return [Sym("E!" + clean(elem.text))]
    if name == "mmultiscripts":
        return _multiscripts(elem)
    if name == "mtable":
        return [_matrix([[layout(c) for c in r] or [[]] if _name(r) == "mtr" else [layout(r)] for r in elem])]
    rows = [layout(c) for c in elem]
    if name in ("mrow", "mpadded"):
        rows = [r for r in rows if not _blank(r)]
        if len(rows) > 2:
            first, last = rows[0][0].tag, rows[-1][0].tag
            if (first in "({|∥" or first == "&lsqb;") and (last in ")}|∥" or last == "&rsqb;"):
                return _fenced(rows, [","])
        return _side_by_side(rows) if rows else []
    if name == "mfenced":
        rows = [r for r in rows if not _blank(r)]
        separators = elem.get("separators", ",").split() or [""]
        given = rows[:1]
        for k, r in enumerate(rows[1:]):
            given += [[Sym(separators[min(k, len(separators) - 1)])], r]
        left, right = elem.get("open", "(").replace("[", "&lsqb;"), elem.get("close", ")").replace("]", "&rsqb;")
        return _fenced([[Sym(left)], *given, [Sym(right)]], separators)
    if name == "menclose":
        return [Sym(elem.get("notation", "longdiv"), {"w": _joined(rows)} if _joined(rows) else {})]
    if name in ("msub", "munder"):
        return _scripted(rows, "b") if name == "msub" else _scripted(rows, "u", plain=True)
    if name in ("msup", "mover"):
        return _scripted(rows, "a") if name == "msup" else _scripted(rows, "o", plain=True)
    if name in ("msubsup", "munderover"):
        return _scripted(rows, "b", "a") if name == "msubsup" else _scripted(rows, "u", "o", plain=True)
    if name == "msqrt":
        return [Sym("O!root", {"w": _joined(rows) or [Sym("W!")]})] if rows else [Sym("W!")]
    if name in ("mroot", "mfrac"):
        if len(rows) != 2:
            return _joined([r for r in rows if not _blank(r)])
        edges = ("w", "c") if name == "mroot" else ("o", "u")
        return [Sym("O!root" if name == "mroot" else "O!divide", {e: r for e, r in zip(edges, rows) if r})]
    if name in ("mtd", "mtr"):
        return _joined(rows) or [Sym("W!")]
    raise UnknownTag(name)


@dataclass
class Op:
    tag: str
    children: list[Op] = field(default_factory=list)


# Content elements by what they become.
FUNCTIONS = [
    "sin", "cos", "tan", "cot", "sec", "csc", "sinh", "cosh", "tanh", "coth", "sech", "csch", "arccos", "arccot", "arccsc", "arcsec", "arcsin", "arctan",
    "arccosh", "arccoth", "arccsch", "arcsech", "arcsinh", "arctanh", "abs", "exp", "log", "ln", "min", "max", "ceiling", "floor", "arg", "gcd", "real",
    "imaginary",
]
UNORDERED = ["approx", "eq", "neq", "equivalent", "union", "intersect", "plus", "times", "and", "or"]
ORDERED = [
    "lt", "gt", "leq", "geq", "minus", "divide", "subset", "prsubset", "notsubset", "notprsubset", "in", "notin", "forall", "exists", "setdiff", "not",
    "implies", "int", "sum", "partialdiff", "limit", "factorial", "compose", "root",
]
CONSTANTS = ["infinity", "emptyset", "imaginaryi"]
MODIFIERS = ["degree", "bvar", "lowlimit", "uplimit"]
GROUPS = {"vector": "V-", "list": "L-", "set": "S-"}
CLOSURES = {"open": "O-O", "closed": "C-C", "open-closed": "O-C", "closed-open": "C-O"}
# Named symbols that are ordered operators.
NAMED_OPERATORS = frozenset(
    (
    "annotated", "approaches-limit", "approximately-equals-or-equals", "approximately-equals-or-image-of", "assign", "asymptotically-equals", "because",
    "between", "binomial", "bottom", "bra", "cases", "complement", "conditional-set", "contains", "continued-fraction", "contour-integral", "coproduct",
    "currency-dollar", "degree", "difference-between", "dimension", "direct-product", "direct-sum", "divides", "does-not-prove", "double-integral",
    "double-intersection", "double-subset-of", "double-superset-of", "double-union", "equals-or-preceeds", "equals-or-succeeds", "evaluated-at",
    "exclusive-or", "expectation", "forces", "geometrically-equals", "greater-than-and-not-approximately-equals", "greater-than-and-not-equals",
    "greater-than-and-not-equivalent-to", "greater-than-or-approximately-equals", "greater-than-or-equals-or-less-than", "greater-than-or-equivalent-to",
    "greater-than-or-less-than", "iff", "image-of-or-approximately-equals", "infimum", "infinity", "injective-limit", "inner-product", "kernel", "ket",
    "left-normal-factor-semidirect-product", "left-semidirect-product", "less-than-or-approximately-equals", "less-than-or-similar-to", "limit-from",
    "limit-infimum", "limit-supremum", "maps-to", "minus-or-plus", "models", "much-greater-than", "much-less-than", "norm", "not-and",
    "not-approximately-equals", "not-contains", "not-contains-nor-equals", "not-divides", "not-equivalent-to", "not-exists", "not-forces",
    "not-greater-than", "not-greater-than-nor-equals", "not-greater-than-or-equals", "not-less-than", "less-than-and-not-approximately-equals",
    "less-than-and-not-equals", "less-than-and-not-equivalent-to", "not-less-than-nor-greater-than", "not-less-than-nor-equals", "not-less-than-or-equals",
    "less-than-or-equals-or-greater-than", "less-than-or-greater-than", "not-models", "not-much-greater-than", "not-much-less-than",
    "not-similar-to-or-equals", "not-parallel-to", "not-partial-differential", "not-perpendicular-to", "not-precedes", "not-precedes-nor-equals",
    "not-proves", "not-proportional-to", "not-similar-to", "not-square-image-of-or-equals", "not-subgroup-of", "not-subgroup-of-nor-equals", "not-subset-of",
    "not-subset-of-or-equals", "not-subset-of-nor-equals", "not-succeeds", "not-succeeds-nor-equals", "not-superset-of", "not-superset-of-nor-equals",
    "not-superset-of-or-equals", "not-very-much-less-than", "not-very-much-greater-than", "parallel-to", "percent", "perpendicular-to", "plus-or-minus",
    "precedes", "precedes-and-not-approximately-equals", "precedes-and-not-equals", "precedes-and-not-equivalent-to", "precedes-or-approximately-equals",
    "precedes-or-equals", "precedes-or-equivalent-to", "product", "projective-limit", "proper-intersection", "proportional-to", "proves",
    "quadruple-integral", "quantum-operator-product", "right-normal-factor-semidirect-product", "right-semidirect-product", "similar-to",
    "similar-to-or-equals", "square-image-of", "square-image-of-or-equals", "square-intersection", "square-original-of", "square-original-of-or-equals",
    "square-union", "succeeds", "succeeds-and-not-approximately-equals", "succeeds-and-not-equals", "succeeds-and-not-equivalent-to",
    "succeeds-or-approximately-equals", "succeeds-or-equals", "succeeds-or-equivalent-to", "superset-of", "superset-of-or-equals",
    "superset-of-and-not-equals", "supremum", "symmetric-difference", "tensor-product", "therefore", "top", "triple-integral", "very-much-greater-than",
    "very-much-less-than", "weierstrass-p", "subgroup-of-or-equals", "implied-by", "double-factorial", "multiple-integral",
)
)
# Named symbols that become something else.
NAMED_OTHERS = {
    "absent": "W!",
    "for-all": "O!forall",
    "hyperbolic-cotangent": "F!coth",
    "modulo": "O!rem",
    "planck-constant-over-2-pi": "C!hbar",
    "square-root": "O!root",
    "differential-d": "O!d",
    "conditional": "O!if",
    "matrix": "O!matrix",
}
AMBIGUOUS = {
    "formulae-sequence": "O!form-seq",
    "fragments": "O!fragments",
    "missing-subexpression": "W!",
    "subscript": "O!SUB",
    "superscript": "O!SUP",
}
# The wildcards that are known by spelling, with what follows the question mark.
WILDCARDS = {"qvar_": "", "qvar_$": "", "qvar_&quest": "", "qvar_&quest;": "", "qvar_i": "", "qvar_missing": "", "qvar_.": ""}


def _named(elem: ET.Element) -> Op:
    content, cd = clean(elem.text).lower(), elem.get("cd", "")
    if cd == "latexml":
        if content in NAMED_OPERATORS:
            return Op("O!" + content)
        if content in NAMED_OTHERS:
            return Op(NAMED_OTHERS[content])
        if content.startswith("delimited-"):
            return Op("M!D-" + content[11:].replace("[", "&lsqb;").replace("]", "&rsqb;"))
        try:
            return Op(f"N!{float(content)}")
        except ValueError:
            pass
    elif cd == "mws" and content in WILDCARDS:
        return Op("?" + WILDCARDS[content])
    elif cd == "ambiguous" and content in AMBIGUOUS:
        return Op(AMBIGUOUS[content])
    elif cd == "unknown":
        return Op("-!" + content)
    raise UnknownTag(f"csymbol {content} {cd}")


def _split(node: Op) -> None:
    """Halves with the same tag while a node has too many children."""
    if len(node.children) > MAX_CHILDREN:
        half = (len(node.children) + 1) // 2
        node.children = [Op(node.tag, node.children[:half]), Op(node.tag, node.children[half:])]
        for c in node.children:
            _split(c)


def _applied(elem: ET.Element, above: list[Op]) -> Op:
    if not len(elem):
        raise UnknownTag("empty apply")
    op = operators(elem[0], above)
    if op.tag.startswith("V!"):
        op.tag = "F!" + op.tag[2:]
    if op.children:
        name = op.children[0].tag if op.tag in ("O!SUB", "O!SUP") else ""
        op = Op("+!" + name, [op])
    for c in elem[1:]:
        op.children.append(operators(c, [*above, op]))
    if op.tag == "O!int":
        if len(op.children) != 1:
            raise UnknownTag("integral with other than one operand")
        op.children += [Op("W!"), Op("W!")]
    if op.tag == "O!root":
        degrees = [c for c in op.children if c.tag == "$!degree"]
        operands = [c for c in op.children if c.tag != "$!degree"]
        if len(operands) != 1 or any(len(d.children) != 1 for d in degrees):
            raise UnknownTag("root with other than one operand")
        op.children = [operands[0], degrees[-1].children[0] if degrees else Op("N!2")]
    if op.tag.startswith("U!"):
        _split(op)
    return op


def operators(elem: ET.Element, above: list[Op] | None = None) -> Op:
    """Content markup as an operator tree; ``above``: the nodes over the element."""
    above = above or []
    name = _name(elem)
    parts = lambda node: [operators(c, [*above, node]) for c in elem]
    if name == "math":
        if len(elem) != 1:
            raise UnknownTag("math with other than one child")
        return operators(elem[0], above)
    if name in ("ci", "cn", "mtext"):
        return Op(_typed({"ci": "V!", "cn": "N!", "mtext": "T!"}[name], elem.text)[0].tag)
    if name == "qvar":
        return Op("?" + elem.get("name", clean(elem.text)))
    if name == "apply":
        node = _applied(elem, above)
    elif name == "cerror":
        node = Op("E!")
        for c in parts(node):
            if node.children and node.children[-1].tag[:2] in ("-!", "T!") and c.tag[:2] == "-!":
                node.children[-1].tag = "T!" + node.children[-1].tag[2:] + c.tag[2:]
            else:
                node.children.append(c)
        _split(node)
    elif name == "share":
        # A repeated operand: the last operand of the relation before this one.
        if elem.get("href") != "#.cmml" or len(above) < 2 or above[-2].tag != "U!and":
            raise UnknownTag("share")
        return above[-2].children[-1].children[-1]
    elif name in GROUPS:
        node = Op(f"M!{GROUPS[name]}{len(elem)}")
        node.children = parts(node)
    elif name == "matrix":
        node = Op("M!")
        rows = parts(node)
        width = max((len(r.children) for r in rows), default=0)
        for r in rows:
            r.children += [Op("E!") for _ in range(width - len(r.children))]
        node = Op(f"M!M-{len(rows)}x{width}", rows)
    elif name == "matrixrow":
        node = Op("M!R!")
        node.children = parts(node)
    elif name == "interval":
        closure = elem.get("closure", "closed").strip().lower()
        if closure not in CLOSURES:
            raise UnknownTag(closure)
        node = Op(f"O!interval({CLOSURES[closure]})")
        node.children = parts(node)
    elif name in MODIFIERS:
        node = Op("$!" + name)
        node.children = parts(node)
    elif name == "csymbol":
        return _named(elem)
    else:
        kinds = {"F!": FUNCTIONS, "U!": UNORDERED, "O!": ORDERED, "C!": CONSTANTS}
        kind = next((k for k, names in kinds.items() if name in names), None)
        if name == "determinant":
            return Op("F!det")
        if kind is None:
            raise UnknownTag(name)
        return Op(kind + name)
    if len(node.children) > MAX_CHILDREN:
        raise UnknownTag("too many children")
    return node


# A common form of both trees: a tag and its children by edge.
Node = tuple[str, list[tuple[str, "Node"]]]


def _row_node(row: Row, k: int = 0, after: list[tuple[str, Node]] | None = None) -> Node:
    s = row[k]
    kids = [(e, _row_node(r)) for e, r in s.sub.items()]
    if s.cells:
        chained: Node | None = None
        for cell in reversed(s.cells):
            chained = _row_node(cell, 0, [("e", chained)] if chained else None)
        kids.append(("w", chained))
    if k + 1 < len(row):
        kids.append(("n", _row_node(row, k + 1)))
    return s.tag, sorted(kids + (after or []), key=lambda x: EDGE_ORDER.index(x[0]))


def _op_node(op: Op) -> Node:
    return op.tag, [(CHILD_LABELS[i], _op_node(c)) for i, c in enumerate(op.children)]


def tree(kind: str, markup: str) -> Node | None:
    """Layout (``slt``) or operator (``opt``) tree of a formula's part of that kind; None for an empty one."""
    root = _part(ET.fromstring(markup), kind)
    if kind == "opt":
        return _op_node(operators(root)) if len(root) or _name(root) != "math" else None
    row = layout(root)
    return _row_node(row) if row else None


def written(node: Node, kind: str) -> str:
    """``[tag,edge[…]]``; the next symbol of a layout tree follows without an edge."""
    tag, kids = node
    order = "nabouc" + "dwe"
    kids = sorted(kids, key=lambda x: order.index(x[0])) if kind == "slt" else kids
    return "[" + tag + "".join(written(c, kind) if kind == "slt" and e == "n" else f",{e}{written(c, kind)}" for e, c in kids) + "]"


def read(text: str) -> Node:
    """The tree of what :func:`written` writes."""
    at = 0

    def node() -> Node:
        nonlocal at
        at += 1
        end = min(x for x in (text.find(c, at) for c in "[],") if x >= 0)
        tag, kids = text[at:end], []
        at = end
        while text[at] != "]":
            edge = "n"
            if text[at] == ",":
                edge, at = text[at + 1], at + 2
            kids.append((edge, node()))
        at += 1
        return tag, sorted(kids, key=lambda x: EDGE_ORDER.index(x[0])) if all(e in EDGE_ORDER for e, _ in kids) else kids

    return node()


def flat(root: Node, kind: str) -> Iterator[tuple]:
    """Nodes in order: (path, tag, indexes of the ancestors from the root, last index below, walk number).

    ``path`` has the edges from the root; children of unordered operators share
    edge 0.  The walk number orders what lies below a symbol as pairs list it.
    """
    out: list[list] = []

    def visit(node: Node, path: str, above: list[int]) -> None:
        me = len(out)
        out.append([path, node[0], above, 0, 0])
        for e, c in node[1]:
            visit(c, path + ("0" if kind == "opt" and node[0].startswith("U") else e), [*above, me])
        out[me][3] = len(out) - 1

    visit(root, "", [])
    children: dict[int, list[int]] = {}
    for i, n in enumerate(out):
        if n[2]:
            children.setdefault(n[2][-1], []).append(i)
    stack, number = [0], 0
    while stack:
        i = stack.pop()
        out[i][4] = number
        number += 1
        kids = children.get(i, [])
        edge = lambda k: out[k][0][-1]
        stack += sorted(kids, key=lambda k: WALK_ORDER[::-1].index(edge(k))) if kind == "slt" else kids
    return (tuple(n) for n in out)


# LaTeX commands and what they stand for.  Symbols that are named like the characters of HTML come from those names.
SIGNS = {
    "le": "≤", "ge": "≥", "ne": "≠", "neq": "≠", "to": "→", "gets": "←", "implies": "⟹", "impliedby": "⟸", "infty": "∞", "neg": "¬",
    "land": "∧", "lor": "∨", "exists": "∃", "nexists": "∄", "partial": "∂", "circ": "∘", "star": "⋆", "ast": "∗", "iint": "∬", "iiint": "∭",
    "ldots": "…", "dots": "…", "dotsc": "…", "cdots": "⋯", "dotsb": "⋯", "vdots": "⋮", "ddots": "⋱", "lvert": "|", "rvert": "|", "vert": "|",
    "lVert": "∥", "rVert": "∥", "Vert": "∥", "|": "∥", "lbrace": "{", "rbrace": "}", "lbrack": "[", "rbrack": "]", "colon": ":",
    "subsetneq": "⊊", "supsetneq": "⊋", "ngeq": "≱", "nleq": "≰", "bigotimes": "⨂", "bigoplus": "⨁", "bigwedge": "⋀", "bigvee": "⋁",
}
NAMES = [
    "sin", "cos", "tan", "cot", "sec", "csc", "sinh", "cosh", "tanh", "coth", "arcsin", "arccos", "arctan", "log", "ln", "lg", "exp", "lim", "limsup",
    "liminf", "max", "min", "sup", "inf", "arg", "det", "dim", "deg", "gcd", "hom", "ker", "mod", "bmod", "Pr",
]
ACCENTS = {
    "hat": "^", "widehat": "^", "bar": "¯", "overline": "¯", "vec": "→", "overrightarrow": "→", "overleftarrow": "←", "tilde": "~",
    "widetilde": "~", "dot": "˙", "ddot": "¨", "check": "ˇ", "breve": "˘", "acute": "´", "grave": "`", "overbrace": "⏞",
}
UNDER = {"underline": "_", "underbrace": "⏟"}
STYLES = [
    "mathbf", "mathbb", "mathcal", "mathfrak", "mathscr", "mathsf", "mathit", "mathtt", "boldsymbol", "bm", "pmb", "ensuremath", "mathop", "mathrel",
    "mathbin", "mathord",
]
WORDS = {"text": "mtext", "textrm": "mtext", "textbf": "mtext", "textit": "mtext", "mbox": "mtext", "hbox": "mtext", "mathrm": "mi", "operatorname": "mi"}
SILENT = [
    ",", ";", ":", "!", ">", "quad", "qquad", "displaystyle", "textstyle", "scriptstyle", "limits", "nolimits", "rm", "bf", "it", "left", "right", "middle",
    "big", "Big", "bigg", "Bigg", "bigl", "bigr", "Bigl", "Bigr", "biggl", "biggr", "Biggl", "Biggr", "nonumber", "notag", "hline",
]
FENCES = {"pmatrix": "()", "bmatrix": "[]", "Bmatrix": "{}", "vmatrix": "||", "Vmatrix": "∥∥", "cases": "{"}


def _symbol(name: str) -> str | None:
    """The character of a LaTeX command."""
    from html.entities import html5

    found = SIGNS.get(name) or html5.get(name + ";")
    return found if found and len(found) == 1 else None


def latex_markup(latex: str) -> str | None:
    """Presentation markup of a formula; None where a command isn't known or a group doesn't close.

    Identifiers, numbers, operators, scripts and primes, fractions, binomials,
    roots, symbols by name, sums, integrals, limits, text, accents, stacked
    signs, negations, brackets, matrices, cases and aligned lines; styles and
    spaces say nothing; unescaped percent signs go.
    """
    from unicodedata import category, normalize
    from xml.sax.saxutils import escape

    marks = re.findall(r"\\[A-Za-z]+|\\.|\d+(?:\.\d+)?|\S", re.sub(r"(?<!\\)%", "", latex.strip().strip("$")))
    at = 0

    def taken(mark: str) -> bool:
        nonlocal at
        found = at < len(marks) and marks[at] == mark
        at += found
        return found

    def plain(close: str) -> str:
        """The marks up to ``close`` as they stand."""
        nonlocal at
        end = marks.index(close, at)
        words, at = "".join(marks[at:end]), end + 1
        return words

    def group() -> str:
        while at < len(marks) and marks[at][1:] in SILENT and marks[at][0] == "\\":
            atom()
        return row("}") if taken("{") else atom()

    def sign(char: str) -> str:
        kind = "mi" if category(char)[0] == "L" else "mo"
        return f"<{kind}>{escape(char)}</{kind}>"

    def table(name: str) -> str:
        nonlocal at
        taken("*")
        if name in ("array", "alignat") and taken("{"):
            plain("}")
        taken("*") and taken("}")
        rows: list[list[str]] = [[]]
        while True:
            rows[-1].append(row("&", "\\\\", "\\end"))
            ended = marks[at - 1]
            if ended == "\\\\":
                taken("[") and plain("]")
                rows.append([])
            elif ended == "\\end":
                break
        taken("{")
        if plain("}").rstrip("*") != name:
            raise UnknownTag("environments cross")
        if rows[-1] == ["<mrow></mrow>"]:
            rows.pop()
        body = "".join(f"<mtr>{''.join(f'<mtd>{c}</mtd>' for c in r)}</mtr>" for r in rows)
        fence = [f"<mo>{x}</mo>" for x in FENCES.get(name, "")] + ["", ""]
        return f"<mrow>{fence[0]}<mtable>{body}</mtable>{fence[1]}</mrow>" if name in FENCES else f"<mtable>{body}</mtable>"

    def atom() -> str:
        nonlocal at
        if at >= len(marks) or marks[at] in ("}", "&", "\\\\", "\\end"):
            raise UnknownTag("end")
        m = marks[at]
        at += 1
        name = m[1:] if m.startswith("\\") else ""
        if m == "{":
            return row("}")
        if m in ("~", "\\ ") or name in SILENT:
            if name in ("left", "right", "middle"):
                taken(".")
            return ""
        if name in STYLES:
            return group()
        if name in ("frac", "dfrac", "tfrac", "cfrac"):
            return f"<mfrac>{group()}{group()}</mfrac>"
        if name in ("binom", "dbinom", "tbinom"):
            return f"<mrow><mo>(</mo><mfrac>{group()}{group()}</mfrac><mo>)</mo></mrow>"
        if name == "sqrt":
            if taken("["):
                degree = row("]")
                return f"<mroot>{group()}{degree}</mroot>"
            return f"<msqrt>{group()}</msqrt>"
        if name in WORDS:
            taken("*")
            words = plain("}") if taken("{") else marks[at]
            return f"<{WORDS[name]}>{escape(words)}</{WORDS[name]}>"
        if name in ACCENTS:
            return f"<mover>{group()}<mo>{ACCENTS[name]}</mo></mover>"
        if name in UNDER:
            return f"<munder>{group()}<mo>{UNDER[name]}</mo></munder>"
        if name in ("overset", "stackrel", "underset"):
            mark, base = group(), group()
            return f"<munder>{base}{mark}</munder>" if name == "underset" else f"<mover>{base}{mark}</mover>"
        if name == "not":
            char = re.sub("<[^>]*>", "", atom()).replace("&lt;", "<").replace("&gt;", ">")
            return sign(made) if len(made := normalize("NFC", char + "̸")) == 1 else f"<mo>{escape(char)}̸</mo>"
        if name == "pmod":
            return f"<mrow><mo>(</mo><mi>mod</mi>{group()}<mo>)</mo></mrow>"
        if name == "begin" and taken("{"):
            return table(plain("}").rstrip("*"))
        if name.startswith("qvar") or m == "?":
            return '<mws:qvar xmlns:mws="http://search.mathweb.org/ns" name="x"/>'
        if name in NAMES:
            return f"<mi>{name}</mi>"
        if name and name not in "{}%#$&_":
            if (char := _symbol(name)) is None:
                raise UnknownTag(m)
            return sign(char)
        if m[0].isdigit():
            return f"<mn>{m}</mn>"
        return sign(name or m)

    def row(*until: str) -> str:
        """What stands before the first of ``until``, which is taken."""
        nonlocal at
        parts, opened = [], []
        while at < len(marks) and marks[at] not in until:
            base, scripts = ("" if marks[at] in ("^", "_", "'") else atom()), {"_": "", "^": ""}
            while at < len(marks) and marks[at] in ("^", "_", "'", "\\limits", "\\nolimits"):
                which = marks[at]
                at += 1
                if which == "'":
                    scripts["^"] += "<mo>′</mo>"
                elif which[0] != "\\":
                    scripts[which] += group()
            kind = {(True, False): "msub", (False, True): "msup", (True, True): "msubsup"}.get((scripts["_"] != "", scripts["^"] != ""))
            below, above = (f"<mrow>{scripts[k]}</mrow>" if scripts[k] else "" for k in "_^")
            if base in ("<mo>(</mo>", "<mo>[</mo>", "<mo>{</mo>"):
                opened.append(len(parts))
            elif base in ("<mo>)</mo>", "<mo>]</mo>", "<mo>}</mo>") and opened:
                first = opened.pop()
                base = f"<mrow>{''.join(parts[first:])}{base}</mrow>"
                del parts[first:]
            parts.append(f"<{kind}>{base or '<mrow></mrow>'}{below}{above}</{kind}>" if kind else base)
        if until and at >= len(marks):
            raise UnknownTag("unclosed group")
        at += bool(until)
        return f"<mrow>{''.join(parts)}</mrow>"

    try:
        return f'<math xmlns="http://www.w3.org/1998/Math/MathML">{row()}</math>'
    except (UnknownTag, ValueError, IndexError, RecursionError):
        return None


# Signs by the content element that they become.
RELATIONS = {
    "=": "eq", "<": "lt", ">": "gt", "≤": "leq", "≥": "geq", "≠": "neq", "≈": "approx", "≡": "equivalent", "∈": "in", "∉": "notin",
    "⊂": "prsubset", "⊆": "subset", "⊃": "superset-of", "⊇": "superset-of-or-equals", "⇒": "implies", "⟹": "implies", "⇔": "iff",
    "∼": "similar-to", "≪": "much-less-than", "≫": "much-greater-than", "∝": "proportional-to", "⊥": "perpendicular-to", "↦": "maps-to",
    "→": "→",
}
SUMS = {"+": "plus", "-": "minus", "−": "minus", "±": "plus-or-minus", "∓": "minus-or-plus", "∪": "union", "∨": "or", "⊕": "direct-sum"}
PRODUCTS = {
    "×": "times", "⋅": "times", "·": "times", "∗": "times", "*": "times", "/": "divide", "÷": "divide", "∩": "intersect", "∧": "and",
    "∘": "compose", "⊗": "tensor-product",
}
BIG = {"∑": "sum", "∏": "product", "∫": "int", "lim": "limit"}
ALONE = {"∞": "infinity", "∅": "emptyset", "∀": "forall", "∃": "exists"}
CLOSED_BY = {"(": ")", "[": "]", "{": "}", "|": "|", "∥": "∥", "⌊": "⌋", "⌈": "⌉"}


def _made(tag: str, *children: ET.Element, text: str | None = None, **attributes: str) -> ET.Element:
    out = ET.Element(tag, attributes)
    out.text = text
    out.extend(children)
    return out


def _sign(name: str) -> ET.Element:
    """An operator by its content element's name, or by its name among the named symbols."""
    if name in ORDERED or name in UNORDERED or name in FUNCTIONS or name == "determinant":
        return _made(name)
    return _made("csymbol", text=name, cd="latexml") if name in NAMED_OPERATORS else _made("ci", text=name)


def _apply(op: str | ET.Element, *operands: ET.Element) -> ET.Element:
    return _made("apply", _sign(op) if isinstance(op, str) else op, *operands)


def _script(which: str, base: ET.Element, script: ET.Element) -> ET.Element:
    return _apply(_made("csymbol", text=which, cd="ambiguous"), base, script)


def _split_at(items: list[ET.Element], signs: object) -> tuple[list[list[ET.Element]], list[str]]:
    """``items`` cut at the signs that stand outside brackets, and those signs."""
    runs, found, closing = [[]], [], []
    for x in items:
        text = (x.text or "") if _name(x) == "mo" else ""
        if closing and text == closing[-1]:
            closing.pop()
        elif text in CLOSED_BY:
            closing.append(CLOSED_BY[text])
        elif text and text in signs and not closing:
            runs.append([])
            found.append(text)
            continue
        runs[-1].append(x)
    return runs, found


def _expression(items: list[ET.Element]) -> ET.Element:
    """A row of presentation elements as one content element: lists, relations, sums, products, factors."""
    runs, _ = _split_at(items, ",;")
    if len(runs) > 1:
        listed = [_expression(r) for r in runs if r]
        return listed[0] if len(listed) == 1 else _made("list", *listed)
    runs, signs = _split_at(items, RELATIONS)
    if signs:
        sides = [_expression(r) for r in runs]
        each = [_apply(RELATIONS[s], a, b) for s, a, b in zip(signs, sides, sides[1:])]
        return each[0] if len(each) == 1 else _apply("and", *each)
    runs, signs = _split_at(items, SUMS)
    if signs:
        out = _product(runs[0]) if runs[0] else None
        for s, r in zip(signs, runs[1:]):
            x = _product(r)
            if out is None:
                out = _apply(SUMS[s], x)
            elif SUMS[s] != "minus" and _name(out) == "apply" and _name(out[0]) == SUMS[s] and len(out) > 2:
                out.append(x)
            else:
                out = _apply(SUMS[s], out, x)
        return out
    return _product(items)


def _product(items: list[ET.Element]) -> ET.Element:
    runs, signs = _split_at(items, PRODUCTS)
    out = _factors(runs[0])
    for s, r in zip(signs, runs[1:]):
        out = _apply(PRODUCTS[s], out, _factors(r))
    return out


def _head(x: ET.Element) -> str:
    """The text of a symbol or of the symbol that carries its scripts."""
    return _head(x[0]) if _name(x) in ("msub", "msup", "msubsup", "munder", "mover", "munderover") and len(x) else (x.text or "").strip()


def _factors(items: list[ET.Element]) -> ET.Element:
    """What stands side by side is multiplied; functions take the next factor, sums and integrals all that follow."""
    factors: list[ET.Element] = []
    waiting: list[ET.Element] = []
    k = 0
    while k < len(items):
        x, head = items[k], _head(items[k])
        k += 1
        if head in BIG and k < len(items):
            factors.append(_apply(_content(x), _factors(items[k:])))
            break
        if head in FUNCTIONS and k < len(items):
            waiting.append(_content(x))
            continue
        if _name(x) == "mo" and head in CLOSED_BY:
            if head == "{" and len(items) == k + 1 and _name(items[k]) == "mtable":
                factors.append(_apply("cases", *[_content(cell) for line in items[k] for cell in line]))
                break
            depth, end = [CLOSED_BY[head]], k
            while end < len(items) and depth:
                text = (items[end].text or "") if _name(items[end]) == "mo" else ""
                if text == depth[-1]:
                    depth.pop()
                elif text in CLOSED_BY:
                    depth.append(CLOSED_BY[text])
                end += 1
            if depth:
                raise UnknownTag("unclosed bracket")
            inner = items[k : end - 1]
            value = _expression(inner) if inner else _made("list")
            wrap = {"|": "abs", "⌊": "floor", "⌈": "ceiling", "∥": "norm"}.get(head)
            wrap = "determinant" if head == "|" and [_name(i) for i in inner] == ["mtable"] else wrap
            value = _made("set", value) if head == "{" else _apply(wrap, value) if wrap else value
            k = end
        elif _name(x) == "mo" and head == "!" and factors:
            factors[-1] = _apply("factorial", factors[-1])
            continue
        else:
            value = _content(x)
        while waiting:
            value = _apply(waiting.pop(), value)
        factors.append(value)
    if not factors:
        return _made("csymbol", text="absent", cd="latexml")
    return factors[0] if len(factors) == 1 else _apply("times", *factors)


def _content(x: ET.Element) -> ET.Element:
    name, text = _name(x), (x.text or "").strip()
    if name in ("math", "mrow", "mtd"):
        return _expression(list(x))
    if name == "mn":
        return _made("cn", text=text)
    if name == "mtext":
        return _made("mtext", text=text)
    if name == "qvar":
        return x
    if name in ("mi", "mo"):
        if text in ALONE:
            return _made(ALONE[text])
        if known := BIG.get(text) or RELATIONS.get(text) or (text if text in FUNCTIONS else None):
            return _sign(known)
        return _made("ci", text=text) if name == "mi" else _made("csymbol", text=text, cd="unknown")
    if name == "mtable":
        return _made("matrix", *[_made("matrixrow", *[_content(c) if len(c) and len(c[0]) else _made("cerror") for c in r]) for r in x])
    parts = [_content(c) for c in x]
    if name == "msub":
        return _script("subscript", *parts)
    if name == "msup":
        return _script("superscript", *parts)
    if name == "msubsup":
        return _script("superscript", _script("subscript", *parts[:2]), parts[2])
    if name == "mfrac":
        return _apply("divide", *parts)
    if name == "msqrt":
        return _apply("root", parts[0])
    if name == "mroot":
        return _apply("root", _made("degree", parts[1]), parts[0])
    if _name(x[1]) != "mo":
        return _script("subscript" if name == "munder" else "superscript", *parts)
    return _apply(parts[1], parts[0])


def latex_content(latex: str) -> str | None:
    """Content markup of a formula, by the usual precedence of its signs; None where its layout or an operand isn't clear.

    Letters side by side are factors, so ``f(x)`` is a product; a function's
    name takes the next factor, a sum, product, integral or limit what follows it.
    """
    markup = latex_markup(latex)
    try:
        root = None if markup is None else ET.fromstring(markup)
        if root is None or not len(root[0]):
            return None
        return ET.tostring(_made("math", _content(root)), encoding="unicode")
    except (UnknownTag, TypeError, IndexError, RecursionError):
        return None


def _part(root: ET.Element, kind: str) -> ET.Element:
    """The presentation (``slt``) or content (``opt``) part of a parsed formula, without its TeX annotation."""
    wanted, other = ("MathML-Presentation", "MathML-Content") if kind == "slt" else ("MathML-Content", "MathML-Presentation")
    found = None
    for parent in root.iter():
        for child in list(parent):
            name = _name(child)
            if name == "annotation" and child.get("encoding") == "application/x-tex":
                parent.remove(child)
            elif name == "annotation-xml" and child.get("encoding") == wanted and found is None:
                found = child
            elif name == "annotation-xml" and child.get("encoding") == other:
                parent.remove(child)
    if found is None:
        return root
    found.tag, found.tail = "math", None
    return found


def isolated(markup: str, kind: str) -> str:
    """The part that :func:`tree` reads, as markup."""
    return ET.tostring(_part(ET.fromstring(markup), kind), encoding="unicode")
