"""Streaming sums against the same sums of the whole table."""

from sparkmat import streaming as T
from sparkmat.operators import matrix as M


def test_batches_add_up(spark, tmp_path):
    rows = [(i % 7, i % 5, float(i)) for i in range(100)]
    x = spark.createDataFrame(rows, "cell long, gene long, value double")
    for i in range(3):
        x.where(f"cell % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    T.keep_sums(stream, f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    got = {tuple(r) for r in T.read_sums(spark, f"{tmp_path}/out").select("cell", "total", "nnz").collect()}
    assert got == {tuple(r) for r in M.matrix_sums(x, "cell").collect()}
    T.running_sums(stream, "gene").writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("sums").collect()} == {tuple(r) for r in M.matrix_sums(x, "gene").collect()}


def test_windows(spark, tmp_path):
    x = spark.createDataFrame([(0, 0, 1.0, "2024-01-01 00:00:10"), (0, 0, 2.0, "2024-01-01 00:00:50"), (0, 1, 4.0, "2024-01-01 00:01:10"), (0, 1, 8.0, "2024-01-01 02:00:00")], "cell long, gene long, value double, t string").selectExpr("cell", "gene", "value", "CAST(t AS timestamp) AS t")
    x.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(x.schema).parquet(f"{tmp_path}/in")
    T.windowed_sums(stream, "t", "1 minute", "10 minutes").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(str(r.start)[11:16], r.gene, r.total, r.nnz) for r in spark.table("windows").collect()}
    assert got == {("00:00", 0, 3.0, 2), ("00:01", 1, 4.0, 1)}
