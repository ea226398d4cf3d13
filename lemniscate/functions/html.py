"""Markup to text, with and without formulas, by the standard library's parser in Arrow batches."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SILENT = {"script", "style", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Nodes(HTMLParser):
    """Text nodes in order; ``math-container`` elements dropped or wrapped in ``$``; math elements apart."""

    def __init__(self, containers: str = "keep", maths: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.containers, self.maths = containers, maths
        self.nodes: list[str] = []
        self.formulas: list[str] = []
        self.offsets: list[int] = []
        self.stack: list[str] = []
        self.held: list[str] | None = None
        self.held_at = self.math_at = 0
        self.raw: list[str] | None = None
        self.length = 0

    def _text(self, s: str) -> None:
        self.nodes.append(s)
        self.length += len(s)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.raw is not None:
            self.raw.append(self.get_starttag_text() or "")
        elif self.maths and tag == "math":
            self.raw, self.math_at = [self.get_starttag_text() or ""], len(self.stack)
        elif self.held is None and self.containers != "keep" and "math-container" in (dict(attrs).get("class") or "").split():
            self.held, self.held_at = [], len(self.stack)
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.raw is not None:
            self.raw.append(self.get_starttag_text() or "")

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack.pop() != tag:
            pass
        if self.raw is not None:
            self.raw.append(f"</{tag}>")
            if len(self.stack) <= self.math_at:
                self.formulas.append("".join(self.raw))
                self.offsets.append(self.length)
                self.raw = None
                self._text(" ")
        elif self.held is not None and len(self.stack) <= self.held_at:
            if self.containers == "dollar":
                self._text(f"${''.join(self.held)}$")
            self.held = None

    def handle_data(self, data: str) -> None:
        if self.raw is not None:
            self.raw.append(data)
        elif self.stack and self.stack[-1] in _SILENT and not self.maths:
            return
        elif self.held is not None:
            self.held.append(data)
        else:
            self._text(data)


def _read(html: str, **how: object) -> _Nodes:
    p = _Nodes(**how)  # type: ignore[arg-type]
    p.feed(html)
    p.close()
    return p


def _joined(nodes: list[str]) -> str:
    return " ".join(x for x in (n.strip() for n in nodes) if x)


def _series(html: pd.Series, containers: str) -> pd.Series:
    return html.map(lambda s: None if s is None else _joined(_read(s, containers=containers).nodes))


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Text nodes, stripped and joined by one space."""
    return _series(html, "keep")


@F.pandas_udf(T.StringType())
def html_text_with_latex(html: pd.Series) -> pd.Series:
    """As :func:`html_text`, with formula containers as ``$…$``."""
    return _series(html, "dollar")


@F.pandas_udf(T.StringType())
def html_text_without_formulas(html: pd.Series) -> pd.Series:
    """As :func:`html_text`, without formula containers."""
    return _series(html, "drop")


@F.pandas_udf(
    T.StructType()
    .add("text", T.StringType())
    .add("formulas", T.ArrayType(T.StringType()))
    .add("positions", T.ArrayType(T.IntegerType()))
)
def separated(html: pd.Series) -> pd.DataFrame:
    """Text with one space for every ``math`` element, the elements, and their offsets before white space is collapsed."""
    out = []
    for s in html:
        p = _read(s or "", maths=True)
        out.append((" ".join("".join(p.nodes).split()), p.formulas, p.offsets))
    return pd.DataFrame(out, columns=["text", "formulas", "positions"])


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unescape(s))


def title_and_body(title: Column, body: Column) -> Column:
    """Title, space, body; the body alone without a title."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat_ws(" ", title, body)).otherwise(body)


# Fixed value: the span that holds a formula and its id.
CONTAINER = r'<span class="math-container" id="(\d+)">.*?</span>'


def formula_ids(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(CONTAINER), F.lit(1))


def formulas_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit('class="math-container"'))


def substituted(html: Column, texts: Column, kind: str = "SLT") -> Column:
    """Formula spans replaced by their text in the map ``texts``, or by a note that it is missing."""
    between = F.split(html, CONTAINER, -1)
    missing = lambda i: F.concat(F.lit("[FORMULA_ID_"), i, F.lit(f"_{kind}_NOT_FOUND]"))
    inside = F.transform(formula_ids(html), lambda i: F.coalesce(F.try_element_at(texts, i), missing(i)))
    return F.array_join(F.zip_with(between, inside, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
