"""The candidates for the number of clusters."""

import __spark_entry__

SF_DIR = "/root/testdata/sf0.001"


def test_candidates_go_from_three_to_ten(spark):
    found = __spark_entry__.queries()["kmeans_candidates"](spark, SF_DIR).collect()
    assert sorted(r.candidate for r in found) == list(range(3, 11))
