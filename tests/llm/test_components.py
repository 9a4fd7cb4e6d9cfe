import pytest

from millrace.llm.components import components


def test_rounds_that_run_out_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long").repartition(7)
    with pytest.raises(RuntimeError, match="1 rounds"):
        components(links, rounds=1)
    assert {r["component"] for r in components(links).collect()} == {0}
