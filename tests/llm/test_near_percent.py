import pytest

from trustweave.llm import near_duplicates


@pytest.mark.parametrize("percent", [0, 50, 79.9, 101])
def test_percents_that_the_bounds_are_not_made_for_are_refused(spark, percent):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError, match="percent"):
        near_duplicates.near_duplicates(docs, percent=percent)


def test_higher_percents_run(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e g")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs, 2, 95).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
