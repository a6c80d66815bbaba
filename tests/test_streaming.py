from datetime import datetime, timedelta

from millrace.streaming import accounting


def stream(spark, tmp_path, n):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=20 * i), i % 2, 0, i % 30) for i in range(n)]
    schema = "ts timestamp, rank int, epoch int, sample_index long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def run(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_windows_of_reads(spark, tmp_path):
    found = run(spark, accounting.windowed_reads(stream(spark, tmp_path, 60)), "windows", "complete")
    assert sum(r.observed for r in found) == 60 and len({r.start for r in found}) == 4


def test_first_reads(spark, tmp_path):
    found = run(spark, accounting.first_reads(stream(spark, tmp_path, 60)), "firsts", "append")
    assert sorted(r.sample_index for r in found) == list(range(30))
