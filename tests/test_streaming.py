from pyspark.sql import functions as F

from tidemark.streaming.rates import tumbling_rates


def test_rates_of_a_stream(spark, tmp_path):
    rows = [("a", 0, 0.0), ("a", 60, 30.0), ("a", 120, 90.0), ("a", 400, 10.0), ("b", 10, 5.0), ("a", 2000, 1.0)]
    df = spark.createDataFrame(rows, "lkey string, s long, value double").select("lkey", F.timestamp_seconds("s").alias("at"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = tumbling_rates(stream).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = {tuple(r) for r in spark.table("rates").collect()}
    assert ("a", 300_000, 0.75) in got and len(got) == 1
