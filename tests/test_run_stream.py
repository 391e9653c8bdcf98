"""Runs that end by their condition or by silence, across restarts."""

import datetime as dt

from tidemark.streaming import runs

T0 = dt.datetime(2026, 3, 4, tzinfo=dt.timezone.utc)
SCHEMA = "stream_id long, at timestamp, on boolean"


def test_runs_end_by_condition_or_by_silence(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def add(name, rows):
        df = spark.createDataFrame([(s, T0 + dt.timedelta(seconds=t), on) for s, t, on in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def step():
        q = runs.run_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "on", 3.0, 10.0)
        q = q.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        found = spark.read.schema(runs.OUTPUT).parquet(f"{tmp_path}/out").collect()
        return sorted((r.stream_id, (r.start - t0).total_seconds(), (r.end - t0).total_seconds(), r.ended_by) for r in found)

    t0 = spark.createDataFrame([(T0,)], "t timestamp").first().t
    try:
        add("a", [(1, t, 2 <= t <= 6) for t in range(9)] + [(2, t, t >= 4) for t in range(9)] + [(3, t, t in (2, 3)) for t in range(5)])
        assert step() == [(1, 2, 6, "condition")]
        # A new query goes on from the state: stream 2 goes on with its run, stream 3 had none long enough.
        add("b", [(2, t, True) for t in range(9, 13)] + [(1, t, None) for t in range(9, 13)])
        assert step() == [(1, 2, 6, "condition")]
        # Stream 1 alone goes on: time passes, and the run of stream 2 ends by a timer, with its last sample.
        add("c", [(1, t, t > 40) for t in range(13, 50)])
        assert step() == [(1, 2, 6, "condition"), (2, 4, 12, "silence")]
        # A gap inside one batch, before any timer.
        add("d", [(1, t, True) for t in (50, 51, 80, 81, 90)])
        assert step() == [(1, 2, 6, "condition"), (1, 41, 51, "silence"), (2, 4, 12, "silence")]
    finally:
        spark.conf.unset(provider)
