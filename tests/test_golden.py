"""Queries over inline rows give the rows that their SQL lists, and the public interface is there."""

from __future__ import annotations

import duckdb
import pytest

import opalgrid
from opalgrid.functions.registry import register_functions
from opalgrid.functions.scalars import request_date
from opalgrid.plans import golden
from opalgrid.sources import registry


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(golden.QUERIES))
def test_golden(spark, name):
    df = golden.QUERIES[name](spark, "")
    found = duckdb.sql(golden.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    want = [tuple(plain(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_public_interface(spark):
    for name in opalgrid.__all__:
        assert getattr(opalgrid, name) is not None
    with pytest.raises(AttributeError):
        opalgrid.nothing
    assert "opal_title_ratio" in register_functions(spark)
    assert spark.sql("SELECT opal_title_ratio('data engineer', 'data engineer') AS r").first().r == 1.0
    with pytest.raises(ValueError):
        registry.register_source("file", lambda spark: None)
    with pytest.raises(ValueError):
        registry.read_source(spark, "nowhere")


def test_request_date():
    assert request_date(" 31.01.2026 ") == "2026-01-31" and request_date("") == "" and request_date("2026-01-31") == "2026-01-31"
    with pytest.raises(ValueError):
        request_date("1.1.2026")
