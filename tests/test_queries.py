"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest

from lemniscate.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, con):
    if name in registry.ORACLE_SQL:
        compare(spark, name, registry.QUERIES[name], registry.ORACLE_SQL[name], SF, con)
    else:
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_queries_without_sql_by_plain_python(spark):
    """One row per given row, and the values that a few lines of Python give."""
    import re
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in registry.QUERIES["html_to_text"](spark, SF).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        bare = re.sub(r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>|<!doctype[^>]*>", "<>", page)
        pieces = [unescape(x).strip() for x in re.split(r"<[^<>]*>", bare)]
        assert got[i].split() == " ".join(x for x in pieces if x).split(), i
    parts = {r["page_id"]: r["n_formulas"] for r in registry.QUERIES["html_separate"](spark, SF).collect()}
    assert parts == {i: len(re.findall(r"<math\b", page)) for i, page in pages.items()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    cut = {r["doc_id"]: r["text"] for r in registry.QUERIES["truncate_keep_formulas"](spark, SF).collect()}
    assert set(cut) == set(docs)
    for i, text in docs.items():
        assert text.strip().startswith(cut[i].strip()) and len(cut[i]) <= 100
        if "$" not in text and "<" not in text:
            assert cut[i] == text[:50]
