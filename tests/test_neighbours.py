from cloudloom.plans import registry


def test_match_broadcasts_no_points(spark):
    """Spark sizes the points below its limit for broadcasts by their packed file, whatever their number."""
    plan = registry.queries()["match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("SortMergeJoin") >= 2  # the neighbour search itself may broadcast pairs of leaves, which it counts
