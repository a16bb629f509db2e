import pytest

from quarry.operators.index import SearchIndex
from quarry.storage import TASK_BYTES, broadcast_if_small, is_small, placed, stored_bytes


def test_size_in_bytes_not_rows(spark):
    """Few rows with long arrays are as large as many short ones."""
    few = spark.range(10).selectExpr("id", "array_repeat(struct(id as a, 'word' as b), 5000) as spans", "map('k', array(1, 2)) as m", "cast(null as array<string>) as n")
    many = spark.range(100_000)
    for df, size in ((few, 10 * 5000 * 30), (many, 100_000 * 8)):
        assert is_small(df, 4 * size) and not is_small(df, size // 2)


@pytest.mark.parametrize("limit,hinted", [(1 << 20, True), (100, False)])
def test_hint_only_if_small(spark, limit, hinted):
    plan = broadcast_if_small(spark.range(1000), limit)._jdf.queryExecution().logical().toString()
    assert ("broadcast" in plan.lower()) == hinted


def test_empty_and_null(spark):
    assert is_small(spark.range(0), 0) and is_small(spark.createDataFrame([(None, None)], "a string, b array<array<string>>"), 1000)


def test_tasks_by_the_size_of_the_stored_table(spark, tmp_path):
    """However much Spark would put into a task by its settings."""
    spark.range(300_000).selectExpr("id as doc_id", "md5(cast(id as string)) as text").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    size = stored_bytes(df)
    assert size == stored_bytes(df.where("doc_id > 5").select("text")) > TASK_BYTES
    postings = SearchIndex.build(df, ["text"]).postings
    assert postings.rdd.getNumPartitions() == max(4, -(-size // TASK_BYTES))
    assert placed(df, "doc_id", each=size // 10).rdd.getNumPartitions() in (10, 11)
    assert postings.count() == 300_000 and stored_bytes(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a long")) is None
