"""Logs and sensor memory as data sources."""

import os
import struct
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from wayfold.plans import live
from wayfold.sources import connectors, logs, records
from wayfold.streaming import stateful

ROWS = [(k, f"/t{i % 2}", i * 10, i, bytes([i % 250]) * 20) for k in (1, 2) for i in range(400)]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    connectors.register(spark)
    folder = f"file://{tmp_path_factory.mktemp('logs')}/a"
    connectors.save_logs(spark.createDataFrame(ROWS, connectors.WRITTEN), folder, 1024, 2000)
    return folder


def test_logs_are_written_and_read_by_name(spark, written):
    got = spark.read.format("chunked_log").load(written)
    assert sorted((r["topic"], r["log_time_ns"], r["publish_time_ns"], bytes(r["data"])) for r in got.collect()) == sorted((t, at, p, d) for _, t, at, p, d in ROWS)
    assert got.where("not chunk_crc_ok").count() == 0
    some = got.where("log_time_ns >= 1000 and log_time_ns < 1300 and topic = '/t1'")
    assert some.count() == 30 and sorted({r["log_time_ns"] for r in some.collect()}) == list(range(1010, 1300, 20))


def test_filters_choose_the_chunks_that_are_read(spark, written):
    whole, part = connectors.LogReader(written), connectors.LogReader(written)
    asked = [GreaterThanOrEqual(("log_time_ns",), 1000), LessThan(("log_time_ns",), 1100), EqualTo(("topic",), "/t0"), EqualTo(("data",), b"")]
    assert list(part.pushFilters(asked)) == asked[3:]  # the others hold of all that is read
    times = {r: [t for log in r.partitions() for b in r.read(log) for t in b.column("log_time_ns").to_pylist()] for r in (whole, part)}
    assert len(times[whole]) == len(ROWS) and sorted(times[part]) == sorted(2 * list(range(1000, 1100, 20)))
    assert whole.read_chunks > 30 and 2 <= part.read_chunks <= 6
    none = connectors.LogReader(written)
    list(none.pushFilters([EqualTo(("topic",), "/other")]))
    assert [b for log in none.partitions() for b in none.read(log)] == [] and none.read_chunks == 0


def test_filters_of_a_query_reach_the_source(spark):
    plan = live.log_source(spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    (pushed,) = (x for x in plan.splitlines() if x.startswith("PushedFilters"))
    assert all(x in pushed for x in ("log_time_ns", *map(str, live._SPAN)))


def test_sources_are_found_from_a_thread_of_ones_own(spark, written):
    def count():
        connectors.register(spark)
        return spark.read.format("chunked_log").load(written).count()

    with ThreadPoolExecutor(1) as pool:
        assert pool.submit(count).result() == len(ROWS)


def test_a_log_without_a_footer_is_read_by_its_heads(spark, written, tmp_path):
    name = connectors.LogReader(written).partitions()[0].path.removeprefix("file://")
    raw = open(name, "rb").read()
    with open(f"{tmp_path}/cut.mcap", "wb") as out:
        out.write(raw[: len(raw) // 2])
    got = spark.read.format("chunked_log").load(f"file://{tmp_path}")
    assert 20 < got.count() < 400 and got.where("log_time_ns < 100").count() == spark.read.format("chunked_log").load(written).where(F.col("path").endswith(os.path.basename(name)) & (F.col("log_time_ns") < 100)).count()


def test_a_failing_task_leaves_nothing_listed(spark, written, tmp_path):
    folder = f"file://{tmp_path}/b"
    df = spark.createDataFrame(ROWS, connectors.WRITTEN)
    bad = df.withColumn("topic", F.when((F.col("trip_id") == 2) & (F.col("log_time_ns") == 3990), F.lit(None)).otherwise(F.col("topic")))
    with pytest.raises(Exception, match="topic"):
        connectors.save_logs(bad, folder, 1024, 2000)
    assert [x for x in os.listdir(f"{tmp_path}/b") if not x.endswith(".crc")] == []
    connectors.save_logs(df.where("trip_id = 1"), folder)
    connectors.save_logs(df.where("trip_id = 2"), folder)
    assert spark.read.format("chunked_log").load(folder).count() == 800
    (tmp_path / "b" / "left.mcap").write_bytes(b"what an attempt left")  # listed nowhere
    assert spark.read.format("chunked_log").load(folder).count() == 800
    connectors.save_logs(df.where("trip_id = 2"), folder, mode="overwrite")
    assert spark.read.format("chunked_log").load(folder).count() == 400 and len(os.listdir(f"{tmp_path}/b")) < 6


def memory(path, slots, last):
    out = np.zeros(slots, records.REPORT)
    for c in range(max(1, last - slots + 1), last + 1):
        out[(c - 1) % slots] = (104, 1, 2, c, c * 5, c / 2, 0.0, 0.0)
    with open(path, "wb") as f:
        f.write(out.tobytes() + struct.pack("<I", 7))


def test_a_restart_reads_each_record_once(spark, tmp_path):
    connectors.register(spark)
    path, out, state = f"{tmp_path}/ring", f"{tmp_path}/out", f"file://{tmp_path}/state"
    seen = lambda: sorted(r["counter"] for r in spark.read.schema(connectors.REPORTS).parquet(out).collect())

    def run():
        live = spark.readStream.format("sensor_records").option("path", f"file://{path}").option("records", 7).load()
        stateful.run_all(spark, live.writeStream.format("parquet").option("path", out).option("checkpointLocation", state))

    memory(path, 64, 20)
    run()
    assert seen() == list(range(1, 21))
    run()
    memory(path, 64, 50)
    run()
    assert seen() == list(range(1, 51))
    memory(path, 64, 200)  # 51 to 136 were overwritten before anyone read them
    run()
    assert seen() == [*range(1, 51), *range(137, 201)]


def test_footer_and_heads_say_the_same(tmp_path):
    with open(f"{tmp_path}/x.mcap", "wb") as out:
        w = logs.LogWriter(out, 300)
        for i in range(100):
            w.message(f"/{i % 3}", i, i, b"abc" * 5)
        w.finish()
    import pyarrow as pa

    with pa.OSFile(f"{tmp_path}/x.mcap") as source:
        a, b = connectors.footer_chunks(source), connectors.scanned_chunks(source)
    assert a[0] == b[0] and [x[:4] for x in a[1]] == [x[:4] for x in b[1]] and len(a[1]) > 5
