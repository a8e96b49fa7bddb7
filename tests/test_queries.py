"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from strandlake.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    done = duck.execute(registry.SQL[name])
    names = [c[0] for c in done.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, done.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_stream_equals_batch(spark):
    from strandlake.plans import bindings, jobs
    from strandlake.streaming import reads as stream

    batch = stream.preprocess(bindings.signals(spark, DATA), 7, 6)
    streamed = jobs.r1(spark, DATA)
    assert {r.read_id: round(r.first, 9) for r in streamed.collect()} == {r.read_id: round(r.signal[0], 9) for r in batch.collect()}


def test_stream_decodes_as_batch(spark, tmp_path):
    from strandlake.functions import arrays
    from strandlake.plans import bindings, jobs
    from strandlake.streaming import reads as stream

    scores = bindings.scores(spark, DATA)
    scores.repartition(3).write.parquet(f"{tmp_path}/scores")
    arriving = stream.arriving(spark, f"{tmp_path}/scores", scores.schema, 1)
    streamed = jobs._finish(stream.decode(arriving))
    key = lambda r: (r.read_id, tuple(r.top3), tuple(r.region), r.fragmented)
    assert sorted(map(key, streamed.collect())) == sorted(map(key, arrays.compress(scores).collect()))
