"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from fareflow.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)

    def plain(x):
        if x is None or isinstance(x, (bool, str)):
            return x
        return float(x) if isinstance(x, (int, float)) else str(x)[:26].replace(" 00:00:00", "")

    return sorted(repr([plain(x) for x in r]) for r in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, oracle, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), oracle.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["gbt_stress", "elastic_net_tips", "kmeans_profiles"])
def test_models_give_rows(spark, name):
    found = {r["model"]: r["mae"] for r in catalogue.QUERIES[name](spark, SF).collect()} if name != "kmeans_profiles" else None
    if name == "elastic_net_tips":
        assert found["pred_model"] < found["pred_median"]
    elif found is not None:
        assert set(found) == {"pred_model", "pred_persistence"}
    else:
        assert catalogue.QUERIES[name](spark, SF).count() == 8


@pytest.mark.parametrize("name", ["gbt_stress", "rf_stress"])
def test_stress_models_have_their_whole_size(spark, name, monkeypatch):
    from fareflow.plans import learning_queries

    monkeypatch.setattr(learning_queries, "_report", lambda spark, sf, make, **options: make("y", **options))
    model = catalogue.QUERIES[name](spark, None)
    assert (model.getMaxIter(), model.getMaxDepth()) == (50, 4) if name == "gbt_stress" else (model.getNumTrees(), model.getMaxDepth()) == (100, 8)


def test_entry_is_importable_without_session():
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=here, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
