import pytest

#: Nulls, blanks, repeats, clashing extra columns.
ODD = [(1, None, "x"), (2, "", "y"), (3, " \n\t ", "z"), (None, "one two three four five six", "q"), (4, "Same text here, five words", "a"), (4, "Same text here, five words", "a"), (5, "Same text here, five words", None), (6, "w " * 30000, "b"), (7, "é😀 ñandú ÉTÉ", "c")]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A stored table of awkward texts with extra columns whose names an operator might use itself."""
    path = f"file://{tmp_path_factory.mktemp('odd')}/t"
    spark.createDataFrame([(i, t, s, 0, 0, "k", 1.0) for i, t, s in ODD], "doc_id long, text string, source string, uid int, n int, key string, score double").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(odd, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('empty')}/t"
    odd.where("false").write.parquet(path)
    return odd.sparkSession.read.parquet(path)
