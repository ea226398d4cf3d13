"""Operators that must stay on DataFrame functions have no Python in their plans."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest

from lemniscate.llm import line_dedup, pii, quality, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [quality.quality_rules, quality.keep_good, pii.find_pii, pii.masked, sharding.shard, line_dedup.dedup_lines])
def test_no_python(make, spark):
    out = io.StringIO()
    with redirect_stdout(out):
        make(spark.read.parquet(f"{SF}/documents.parquet")).explain("formatted")
    text = out.getvalue()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("make", [quality.quality_rules, quality.keep_good, pii.find_pii, pii.masked, sharding.shard])
def test_no_python_in_stored_steps(make, spark, monkeypatch):
    """The plans of the tables that are written on the way, which the result's own plan no longer shows."""
    from pyspark.sql import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def seen(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().toString())
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    make(spark.read.parquet(f"{SF}/documents.parquet"))
    assert plans
    for text in plans:
        assert not any(x in text for x in ("Python", "Pandas", "InArrow", "MapPartitions", "ExternalRDD"))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
