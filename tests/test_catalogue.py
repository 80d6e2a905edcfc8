"""Every catalogue query against its SQL in DuckDB, on the smallest data."""

import math
import os

import duckdb
import pytest

from verdigris.plans import catalogue, media, parts, shards, streams

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables are not here")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'; SET memory_limit = '4GB'")
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(f"{value:.6g}") if isinstance(value, float) else str(value) if not isinstance(value, (int, bool)) else value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.ORACLES:
        assert got
        return
    relation = oracle.sql(catalogue.ORACLES[name])
    assert sorted(relation.columns) == sorted(df.columns)
    want = table(relation.columns, relation.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    assert catalogue.QUERIES["dump_edges"] is parts.dump_edges
    assert catalogue.QUERIES["frame_stream"] is streams.frame_stream
    assert catalogue.QUERIES["picture_stats"] is media.picture_stats
    assert catalogue.QUERIES["shard_questions"] is shards.shard_questions
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.queries()["shortlist"] is catalogue.shortlist
