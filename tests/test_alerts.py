"""CAP alerts: work is dealt to all tasks and each text is read few times."""

from slopeline.plans import assets


def test_alerts_are_dealt_and_read_twice(spark):
    plan = assets.cap_alerts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("/text()") == 2
