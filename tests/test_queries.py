"""Every query with SQL gives the rows of that SQL; the others run and give rows."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, canonical
from veilframe.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert canonical(ours, columns) == canonical(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert rows and all(r["error"] is None for r in rows if "error" in r.asDict())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sizes_of_all_units(spark, tmp_path):
    ids = [0, 1023, 1024, 1280, 1048575, 1048576, 1310720, 3 << 29, 1 << 30, 5 << 38, 1 << 40, 7 << 41, 1 << 52]
    events = spark.read.parquet(f"{SF}/events.parquet").limit(1)
    ids_ = F.array(*map(F.lit, ids)).cast("array<long>")
    events.withColumn("event_id", F.explode(ids_)).write.parquet(str(tmp_path / "events.parquet"))

    def shown(value):
        for unit in ("B", "KB", "MB", "GB", "TB"):
            if value < 1024 or unit == "TB":
                return f"{value:.1f} {unit}" if unit != "B" else f"{value} B"
            value /= 1024

    assert {r["event_id"]: r["size"] for r in catalog.QUERIES["display_values"](spark, str(tmp_path)).collect()} == {i: shown(i) for i in ids}
