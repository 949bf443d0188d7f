"""Row numbers stay with their rows."""

from cipherlode.llm.text import with_uid


def test_numbers_outlive_other_splits(spark, tmp_path):
    spark.range(4000).selectExpr("id AS doc_id", "repeat(sha2(string(id), 256), 20) AS text").repartition(6).write.parquet(f"file://{tmp_path}/t")
    rows = with_uid(spark.read.parquet(f"file://{tmp_path}/t"), "doc_id", "text")
    number = lambda: {r.key: r.uid for r in rows.select("uid", "key").collect()}
    before = number()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        after = number()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(set(before.values())) == 4000 and before == after
