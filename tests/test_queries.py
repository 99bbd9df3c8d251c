"""Every query of the catalog against its SQL in DuckDB, on the smallest driver tables."""

import math
import os
import re

import pytest

from catalogkit import plans

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((str(tuple(plain(r[c]) for c in names)) for r in df.collect()))
    if name in plans.ORACLES:
        r = duck.execute(plans.ORACLES[name])
        columns = [d[0] for d in r.description]
        assert sorted(columns) == names
        at = [columns.index(c) for c in names]
        assert got == sorted(str(tuple(plain(row[i]) for i in at)) for row in r.fetchall())


@pytest.mark.parametrize("name", ["q_error_report", "q_item_bank", "q_item_denorm", "q_item_risk", "q_mixed_pick", "q_sample_items", "q_valid_items", "q_balanced_pick", "q_type_label"])
def test_item_queries_send_picks_and_totals_only(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    sent = {re.search(r"TakeOrderedAndProject|HashAggregate\(keys=\[\]|Join|Scan", p)[0] for p in plan.split("BroadcastExchange")[1:]}
    assert not sent & {"Join", "Scan"}  # nothing that grows with the parts
