"""Pages below restricted ones, deeper than any fixed number of rounds."""

from corvane.sources import files


def test_restricted_pages_of_any_depth(spark):
    chain = [(i, i - 1 if i else None, i == 0) for i in range(26)]
    rows = [*chain, (100, None, False), (101, 100, False), (102, 100, None), (200, 201, True), (201, 200, False)]
    got = files.restricted_pages(spark.createDataFrame(rows, "id long, parent long, restricted boolean")).collect()
    assert sorted(r.id for r in got) == [*range(26), 102, 200, 201]
