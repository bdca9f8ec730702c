import random

from pyspark.sql import functions as F

from siltwork.streaming.timeline import ROCKS_DB, error_sessions, errors_per_bucket, silences


def source(spark, tmp_path):
    rows = [("a", "2024-01-01 10:00:00", True), ("a", "2024-01-01 10:00:30", True), ("b", "2024-01-01 10:01:00", False), ("a", "2024-01-01 10:20:00", True), ("a", "2024-01-01 12:00:00", False)]
    df = spark.createDataFrame(rows, "source string, t string, bad boolean").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return df.sparkSession.table(name).collect()


def test_buckets_and_sessions(spark, tmp_path):
    s = source(spark, tmp_path)
    assert {(str(r.start), r.errors) for r in run(errors_per_bucket(s, "ts", F.col("bad")), "buckets", "complete")} == {("2024-01-01 10:00:00", 2), ("2024-01-01 10:20:00", 1)}
    assert [(str(r.start), r.errors) for r in run(error_sessions(s, "ts", F.col("bad"), "source", least=2), "sessions", "complete")] == [("2024-01-01 10:00:00", 2)]


def silent(spark, folder, parts, **more):
    """The silences of a stream that gets one file after the other, a batch each."""
    folder.mkdir()
    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "source string, t string").select("source", F.to_timestamp("t").alias("ts"))
        df.toPandas().to_parquet(folder / f"{k:03d}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    s = spark.readStream.schema("source string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(folder))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    try:
        return sorted((r.source, str(r.start), r.seconds) for r in run(silences(s, "ts", "source", **more), f"silent_{folder.name}"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


END = [("end", "2024-01-03 00:00:00")]  # lets the watermark pass all others


def test_silences_out_of_order_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(4)
    times, at = [], 0
    for _ in range(60):
        at += rng.choice([20, 60, 290, 301, 900])
        times.append(at)
    events = [(s, f"2024-01-01 {t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d}") for t in times for s in ("a", "b")[: rng.choice([1, 2])]]
    want = []
    for s in ("a", "b"):
        own = sorted({t for x, t in events if x == s})
        micros = [(spark.sql(f"SELECT unix_seconds(timestamp'{t}')").first()[0], t) for t in own]
        want += [(s, a[1], float(b[0] - a[0])) for a, b in zip(micros, micros[1:]) if b[0] - a[0] >= 300]
    shuffled = sorted(events, key=lambda e: e[1])
    for k in range(0, len(shuffled) - 5, 5):  # out of order within and across batches
        part = shuffled[k : k + 6]
        rng.shuffle(part)
        shuffled[k : k + 6] = part
    parts = [shuffled[k : k + 7] for k in range(0, len(shuffled), 7)]
    assert silent(spark, tmp_path / "mixed", [*parts, END], late="3 hours") == sorted(want)


def test_sources_are_forgotten(spark, tmp_path):
    first, later = ("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 12:00:00")
    middle = [("b", f"2024-01-01 {h:02d}:00:00") for h in (4, 8)]
    parts = [[first], middle[:1], middle[1:], [later], END]
    assert [x for x in silent(spark, tmp_path / "kept", parts, late="1 minute") if x[0] == "a"] == [("a", "2024-01-01 00:00:00", 43200.0)]
    assert [x for x in silent(spark, tmp_path / "gone", parts, late="1 minute", forget=3600) if x[0] == "a"] == []
