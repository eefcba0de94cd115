"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from veldspar.plans import queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 6) if not isinstance(value, (str, bool, bytes)) else value


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    found = db.sql(queries.ORACLE_SQL[name])
    frame = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(frame.columns) == sorted(found.columns)
    columns = sorted(frame.columns)
    want = Counter(tuple(_plain(row[found.columns.index(c)]) for c in columns) for row in found.fetchall())
    assert Counter(tuple(_plain(row[c]) for c in columns) for row in frame.collect()) == want


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")
def test_register_map_of_many_parts(spark, tmp_path):
    """Keys above 65535, as part has them from sf 0.33 on, still make legal addresses, and the SQL holds."""
    from pyspark.sql import functions as F

    for t in TABLES:
        if t != "part":
            os.symlink(f"{SF_DIR}/{t}.parquet", tmp_path / f"{t}.parquet")
    part = spark.read.parquet(f"{SF_DIR}/part.parquet")
    spark.range(1, 70001).select(*(F.col("id").cast(f.dataType).alias("p_partkey") if f.name == "p_partkey" else F.lit("Brand#1" if f.name == "p_brand" else None).cast(f.dataType).alias(f.name) for f in part.schema)).coalesce(1).write.parquet(str(tmp_path / "parts"))
    os.symlink(next((tmp_path / "parts").glob("*.parquet")), tmp_path / "part.parquet")
    defined = queries._definitions(spark, str(tmp_path)).select("ord", "address").collect()
    assert len(defined) == 70000 and {r.address for r in defined} == set(range(65536))
    assert {r.address for r in defined if r.ord in (1, 65537)} == {1}
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = queries.QUERIES["register_match_diagnostics"](spark, str(tmp_path)).first()
    assert tuple(got) == db.sql(queries.ORACLE_SQL["register_match_diagnostics"]).fetchall()[0]
    assert queries.QUERIES["register_explained"](spark, str(tmp_path)).where("parameter_name is not null").limit(1).count() == 1
    assert queries.QUERIES["register_values"](spark, str(tmp_path)).where("converted_value is not null").limit(1).count() == 1


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")
def test_lines_are_dealt_before_they_are_grouped(spark, monkeypatch):
    """Groups are of one line nearly all, so held before the shuffle they only spill; and parts grow in number with the lines."""
    from veldspar.plans import derive

    monkeypatch.setattr(derive, "DEALT_LINES", 500)
    for rows in (derive.hex_bodies(spark, SF_DIR), derive.segments(spark, SF_DIR)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.index("partial_min") < plan.index("Exchange hashpartitioning")
        assert rows.rdd.getNumPartitions() >= 12


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")
def test_many_definitions_are_not_broadcast(spark, monkeypatch):
    """A file of definitions is small beside what they take in memory, so their number decides; the plan holds neither frames nor texts of the map."""
    plan = lambda: queries.QUERIES["register_explained"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    few = plan()
    monkeypatch.setattr(queries, "BROADCAST_DEFINITIONS", 10)
    many = plan()
    assert "Broadcast" in few and "Broadcast" not in many and "SortMergeJoin" in many
    assert "lineitem" not in many and "p_brand" not in many and len(many) < 100_000
