from math import comb

import pytest

from quillspark.operators import agreement


def pairs(spark, n10, n01):
    case = spark.range(n10 + n01 + 5).selectExpr(f"CASE WHEN id < {n10} THEN 1 WHEN id < {n10 + n01} THEN 2 ELSE 3 END AS c")
    return case.selectExpr("'a' AS gold", "CASE WHEN c = 2 THEN 'b' ELSE 'a' END AS pred_a", "CASE WHEN c = 1 THEN 'b' ELSE 'a' END AS pred_b")


@pytest.mark.parametrize("n10,n01", [(0, 0), (3, 0), (7, 12), (400, 460), (5100, 4900), (9000, 1000)])
def test_mcnemar_is_exact(spark, monkeypatch, n10, n01):
    monkeypatch.setattr(agreement, "TERMS", 100, raising=False)
    m = n10 + n01
    want = min(1.0, 2 * sum(comb(m, i) for i in range(min(n10, n01) + 1)) / 2**m)
    r = agreement.mcnemar(pairs(spark, n10, n01)).first()
    assert (r["n10"], r["n01"]) == (n10, n01) and r["p_value"] == pytest.approx(want, rel=1e-8, abs=1e-300)


def test_tail_is_dealt_out(spark):
    plan = agreement.mcnemar(pairs(spark, 10, 10))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in plan and "aggregate(" not in plan
