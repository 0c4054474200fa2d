"""Queries do the whole job: no sample, no lost rows, on any form of their input."""

import os
import shutil

import numpy as np
import pandas as pd
import pytest

from lightfold.operators import ranking
from lightfold.plans import catalog
from lightfold.streaming import streams

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_farthest_points_of_all_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    x[7, 2] = np.nan
    x[640] = x[12]
    order = rng.permutation(900)
    pd.DataFrame({"vec_id": order, "embedding": list(x[order])}).to_parquet(tmp_path / "embeddings.parquet")
    got = catalog.QUERIES["farthest_points"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 51))
    assert [r["vec_id"] for r in got] == ranking.farthest_points(x.astype(float), 50)


def test_farthest_points_of_equal_rows(spark, tmp_path):
    pd.DataFrame({"vec_id": [4, 2, 9, 3], "embedding": [[1.0, 2.0]] * 3 + [[5.0, 2.0]]}).to_parquet(tmp_path / "embeddings.parquet")
    got = catalog.QUERIES["farthest_points"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, 2, 4, 9]


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_rolling_rate", "stream_sessions", "stream_distinct", "stream_leases"])
def test_streams_read_a_file_or_a_folder(spark, tmp_path, name):
    (tmp_path / "one").mkdir()
    shutil.copy(f"{DATA}/events.parquet", tmp_path / "one" / "events.parquet")
    spark.read.parquet(f"{DATA}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/many/events.parquet")
    one, many = (sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path / x)).collect()), key=repr) for x in ("one", "many"))
    assert one and one == many


def test_stream_output_stays_off_the_driver(spark, monkeypatch, tmp_path):
    made, run = [], streams.run_once
    monkeypatch.setattr(streams, "run_once", lambda *a: made.append(run(*a)) or made[-1])
    for name in ("stream_distinct", "stream_leases", "stream_sessions"):
        assert catalog.QUERIES[name](spark, DATA).count()
    assert all(m.inputFiles() for m in made) and len(made) == 3
