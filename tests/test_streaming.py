from corpusloom.streaming import refresh


def test_watch_appends_finished_windows(spark, tmp_path):
    rows = [("r", "a.py", "1", "2024-01-01 00:05:00"), ("r", "a.py", "2", "2024-01-01 00:50:00"), ("r", "b.py", "3", "2024-01-01 05:00:00")]
    source = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, "repo_id string, path string, content string, seen string").selectExpr("repo_id", "path", "content", "CAST(seen AS timestamp) AS seen").write.parquet(source)
    refresh.watch(spark, source, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(120)
    refresh.watch(spark, source, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert [(r["path"], r["versions"]) for r in got] == [("a.py", 2)]
