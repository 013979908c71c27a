"""What must not grow with the number of sources, days or ranges."""

from pyspark.sql import functions as F

from flowsentry.operators import detect
from flowsentry.sources import capture, tables
from flowsentry.streaming import live, state

SECOND = 1_000_000
DAY = 86_400 * SECOND


def stored(spark, packets, path, files=1):
    tables.to_table(packets, "packets").drop("dt").coalesce(files).write.mode("append").parquet(path)
    return path


def test_flood_states_are_shared_by_sources(spark, packets_of, tmp_path):
    """Five hundred sources in a minute, one of them a flood over two micro-batches, write a few entries of state."""
    start = 1_000_000 * SECOND
    batches = []
    for part in range(2):
        quiet = [{"pid": 10_000 * part + n, "src_ip": f"10.0.{n // 250}.{n % 250}"} for n in range(500)]
        flood = [{"pid": 10_000 * part + 5000 + n, "src_ip": "10.9.9.9", "protocol": "ICMP"} for n in range(80)]
        rows = [{**row, "ts_us": start + part * SECOND + n} for n, row in enumerate([*quiet, *flood])]
        batches.append(packets_of(rows))
    path = str(tmp_path / "in")
    for batch in batches:
        stored(spark, batch, path)
    stream = state.stream_rates(tables.packet_stream(spark, path, max_files=1))
    writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    updated = [step["stateOperators"][0]["numRowsUpdated"] for step in query.recentProgress if step["numInputRows"]]
    assert len(updated) == 2 and max(updated) <= 2 * state.RATE_BUCKETS
    found = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    expected = detect.rate_findings(batches[0].unionByName(batches[1]), detect.RATE_RULES)
    assert expected.count() == 60
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_many_short_ranges_share_tasks():
    """Their number follows the bytes, not the ranges; all ranges are read, in their order, and few ones are a task each."""
    few, many = ([("a", size), ("b", 0), ("c", size + 7)] for size in (900_000, 90_000_000))
    parts = capture.ranges("root", few, 30_000)
    assert [len(task.parts) for task in capture.packed(parts)] == [1] * len(parts)
    parts = capture.ranges("root", many, 30_000)
    tasks = capture.packed(parts)
    assert len(parts) > 6000 and len(tasks) <= 2 * capture.TASKS
    assert [part for task in tasks for part in task.parts] == parts
    assert max(sum(part.end - part.start for part in task.parts) for task in tasks) <= capture.TASK_BYTES


def test_a_short_range_reads_little(tmp_path):
    """What is read of a file follows the range, not the buffer."""
    record = b"\x01\x00\x00\x00" + bytes(4) + (60).to_bytes(4, "little") * 2 + bytes(60)
    head = b"\xd4\xc3\xb2\xa1\x02\x00\x04\x00" + bytes(8) + (capture.SNAPLEN).to_bytes(4, "little") + b"\x01\x00\x00\x00"
    (tmp_path / "a.pcap").write_bytes(head + record * 100_000)
    parts = capture.ranges(str(tmp_path), capture.files_of(str(tmp_path)), 30_000)
    found = [[len(data), [base + at for at, *_ in rows]] for part in parts for data, rows, _, base, _ in capture.records(part)]
    assert sorted(at for _, rows in found for at in rows) == [24 + 76 * n for n in range(100_000)]
    assert max(size for size, _ in found) < 500_000


def test_the_live_job_writes_a_day_from_one_task_or_a_few(spark, packets_of, tmp_path):
    """Rows of forty days from eight tasks are about forty files, not one per day and task."""
    rows = packets_of([{"ts_us": (n % 40) * DAY + n * SECOND} for n in range(800)]).repartition(8)
    days = rows.select("pid", "ts_us", F.to_date(F.timestamp_micros("ts_us")).alias("dt"))
    path = str(tmp_path / "out")
    live._write(days, path)
    written = spark.read.parquet(path)
    assert len(written.inputFiles()) <= 40 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, written.select(*days.columns).collect())) == sorted(map(tuple, days.collect()))


def test_the_live_job_writes_sparse_days_from_many_tasks(spark, tmp_path):
    """A hundred and twenty short days are few bytes, but not one task's work."""
    rows = spark.range(120 * 48).select("id", (F.col("id") * (DAY // 48)).alias("ts_us"), F.rand(7).alias("value"))
    days = rows.withColumn("dt", F.to_date(F.timestamp_micros("ts_us")))
    live._write(days, str(tmp_path / "out"))
    files = spark.read.parquet(str(tmp_path / "out")).inputFiles()
    tasks = {file.rsplit("/", 1)[1].split("-")[1] for file in files}
    assert len(tasks) >= 3 and 120 <= len(files) < 120 + len(tasks)
