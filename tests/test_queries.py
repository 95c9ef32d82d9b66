import pytest
from conftest import same

import __spark_entry__
from strandline.plans.grammar import Grammar
from strandline.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, duck, name):
    same(QUERIES[name](spark, small), duck.execute(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, small, name):
    assert QUERIES[name](spark, small).collect() is not None


def test_entry(spark, small):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["t", "stock", "value"] and out.filter("value is not null").count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_audit_verdicts(spark, small):
    got = {r["hash"]: (r["verdict"], r["formula"]) for r in QUERIES["compatibility_audit"](spark, small).collect()}
    assert got["0" * 64] == ("review", "open") and got["5" * 64][0] == "reject"
    assert all(got[str(k) * 64] == ("reject", None) for k in (1, 2, 3, 4))
    assert all(got[n.hash()] == ("accept", n.formula()) for k in (1, 2) for n in Grammar().enumerate(k))


def test_audit_of_all_small_expressions(spark, small):
    got = QUERIES["compatibility_audit"](spark, small).groupBy("verdict").count().collect()
    want = [n.hash() for k in (1, 2) for n in Grammar().enumerate(k)]
    assert len(set(want)) == len(want) and dict(tuple(r) for r in got)["accept"] == len(want) > 600
