"""A symbol tree as a graph description, by column functions over its node list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot_graph(nodes: Column, matched: Column | None = None) -> Column:
    """DOT text: one node per symbol, one labelled edge per child; paths in ``matched`` are filled."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))
    name = lambda i: F.concat(F.lit("n"), i.cast("string"))

    def node(x: Column, i: Column) -> Column:
        style = F.lit("") if matched is None else F.when(F.array_contains(matched, x["path"]), ' style=filled fillcolor="lightgreen"').otherwise("")
        return F.concat(F.lit("  "), name(i), F.lit(" [label="), quoted(x["tag"]), style, F.lit("];"))

    def edge(x: Column, i: Column) -> Column:
        return F.when(
            F.size(x["above"]) > 0,
            F.concat(F.lit("  "), name(F.element_at(x["above"], -1)), F.lit(" -> "), name(i), F.lit(' [label="'), F.substring(x["path"], -1, 1), F.lit('"];')),
        )

    lines = F.concat(F.transform(nodes, node), F.filter(F.transform(nodes, edge), lambda e: e.isNotNull()))
    return F.concat(F.lit("digraph {\n"), F.array_join(lines, "\n"), F.lit("\n}"))


def at_path(nodes: Column, path: Column) -> Column:
    """Tag of the node at a path, null if there is none."""
    return F.get(F.filter(nodes, lambda x: x["path"] == path), F.lit(0))["tag"]


def leaves(nodes: Column) -> Column:
    """Tags of nodes without children."""
    marked = F.transform(nodes, lambda x, i: F.struct((x["last"] == i).alias("leaf"), x["tag"].alias("tag")))
    return F.transform(F.filter(marked, lambda x: x["leaf"]), lambda x: x["tag"])


def has_type(tag: Column) -> Column:
    return F.substring(tag, 2, 1) == "!"


def is_variable(tag: Column) -> Column:
    return tag.startswith("V!")


def is_number(tag: Column) -> Column:
    return tag.startswith("N!")


def is_matrix(tag: Column) -> Column:
    return tag.startswith("M!")


def is_wildcard(tag: Column) -> Column:
    return tag.startswith("?")
