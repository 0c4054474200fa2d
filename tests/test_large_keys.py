"""Queries against their SQL on tables whose keys are larger than those of the given ones."""

import duckdb

from lightfold.plans import catalog


def test_vote_toggle_with_equal_ids(spark, tmp_path):
    c = duckdb.connect()
    # stars 1 and 2 share evidence_id 200000, one with and one without a vote; a kind is null
    c.sql(f"""copy (select * from (values (1, 25000, 'A', 0.00), (2, 0, 'A', 0.08), (3, 5, 'R', 0.08), (3, 5, NULL, 0.01)) v(l_orderkey, l_suppkey, l_returnflag, l_tax),
        (select 0.05::DOUBLE as l_discount, 7::BIGINT as l_partkey, 10.0::DOUBLE as l_extendedprice)) to '{tmp_path}/lineitem.parquet'""")
    c.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = c.sql(catalog.ORACLES["vote_toggle"]).fetchall()
    got = catalog.QUERIES["vote_toggle"](spark, f"file://{tmp_path}").select("tic", "kind", "source", "affects_state").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(got) == 4
