"""Parts of the test tables as tables of their own."""

SF = "/root/testdata/sf0.001"


def copy_tables(spark, folder, name, condition):
    spark.read.parquet(f"{SF}/{name}.parquet").filter(condition).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
