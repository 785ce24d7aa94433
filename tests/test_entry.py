"""Driver contract: entry() runs, every query of the reference's operators has an oracle and runs at the smallest scale.

The training-data queries have tests of their own.
"""
import __spark_entry__ as E


def own(names):
    return {n for n in names if n.startswith("q_")}


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and df.columns == ["digest_key", "md"]
    assert all(r.md.startswith("# Research Digest") for r in rows)


def test_every_query_has_an_oracle():
    assert own(E.queries()) == own(E.oracle_sql()) and set(E.oracle_sql()) <= set(E.queries())


def test_queries_run(spark, sf_small):
    for name, fn in E.queries().items():
        if name not in own([name]) or name.startswith("q_stream"):
            continue
        df = fn(spark, sf_small)
        assert df.columns, name
        df.limit(1).collect()
