import datetime
import time

from pyspark.sql import functions as F

from wavelake.plans.capture import controlled, tuned
from wavelake.streaming.analysis import rocksdb
from wavelake.streaming.controls import settled

START = datetime.datetime(2024, 1, 1)
BLOCKS = "session string, event_time timestamp, block_index long, channel int, frequency_hz double, gain_db int, epoch int"
COMMANDS = "session string, event_time timestamp, kind string, channel int, frequency_hz double, gain_db int"


def at(s):
    return START + datetime.timedelta(seconds=s)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.02)


def run(spark, base):
    b, c = (spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{base}/{n}") for n, s in (("blocks", BLOCKS), ("commands", COMMANDS)))
    stream = settled(b, c, "5 seconds")
    with rocksdb(spark):
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def block(s, k):
    return (s, at(k), k, 9, 1.0, 45, 0)


def rows_of(found):
    return {(r.session, r.block_index): (r.channel, r.frequency_hz, r.gain_db, r.epoch, r.counter, r.stopped) for r in found.collect()}


def test_stream_equals_batch(spark, tmp_path):
    """Commands come in other files than blocks, some of them later than blocks they hold for; over a restart."""
    blocks = [block(s, k) for s in "xy" for k in range(40)]
    commands = [("x", at(3), "retune", 37, 2402e6, None), ("x", at(10), "gain", None, None, 20), ("x", at(17.5), "retune", 38, 2426e6, None), ("x", at(17.5), "clear", None, None, None), ("y", at(21), "gain", None, None, 30), ("y", at(22), "clear", None, None, None), ("x", at(30), "clear", None, None, None)]
    early, later = [r for r in blocks if r[2] < 20], [r for r in blocks if r[2] >= 20]
    put(spark, f"{tmp_path}/blocks", early[::2] + [], BLOCKS)
    put(spark, f"{tmp_path}/commands", commands[2:4] + commands[:1], COMMANDS)
    put(spark, f"{tmp_path}/blocks", early[1::2], BLOCKS)
    put(spark, f"{tmp_path}/commands", commands[1:2], COMMANDS)
    run(spark, tmp_path)
    put(spark, f"{tmp_path}/commands", commands[4:], COMMANDS)
    put(spark, f"{tmp_path}/blocks", later + [block(s, 60) for s in "xy"], BLOCKS)
    put(spark, f"{tmp_path}/blocks", [block("z", 70)], BLOCKS)  # another session's time moves on for all
    got = {k: v for k, v in rows_of(run(spark, tmp_path)).items() if k[1] < 40}
    b = spark.createDataFrame(blocks, BLOCKS).withColumn("wall_time", F.unix_micros("event_time") / 1e6)
    c = spark.createDataFrame(commands, COMMANDS).withColumn("effective_from", F.unix_micros("event_time") / 1e6)
    want = tuned(controlled(b, c.select("session", "effective_from", "kind", "gain_db")), c.where("kind = 'retune'").select("session", "effective_from", "channel", "frequency_hz"))
    assert got == {(r.session, r.block_index): (r.channel, r.frequency_hz, r.gain_db, r.epoch, r.counter, False) for r in want.collect()}


def test_late_command_and_stop(spark, tmp_path):
    put(spark, f"{tmp_path}/blocks", [block("x", k) for k in range(30)], BLOCKS)
    put(spark, f"{tmp_path}/commands", [("x", at(5), "stop", None, None, None), ("x", at(8), "start", None, None, None)], COMMANDS)
    put(spark, f"{tmp_path}/blocks", [block("x", 31)], BLOCKS)
    first = rows_of(run(spark, tmp_path))
    assert {k for (_, k), v in first.items() if v[-1]} == {5, 6, 7} and ("x", 31) not in first
    put(spark, f"{tmp_path}/commands", [("x", at(9), "retune", 37, 2402e6, None)], COMMANDS)  # its blocks are out
    put(spark, f"{tmp_path}/blocks", [block("x", k) for k in (32, 50, 60)], BLOCKS)
    found = rows_of(run(spark, tmp_path))
    assert found.items() >= first.items() and found["x", 32] == (9, 1.0, 45, 0, 0, False)
