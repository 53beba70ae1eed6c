from chronofold.model import events
from chronofold.sources import log
from chronofold.streaming import runs

SCHEMA = "sequence long, run_id string, ts long, new_state string"


def test_run_states_across_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), []
    path = ["Scheduled", "Ready", "Leased", "Running", "Completed"]
    first = spark.createDataFrame([(i + 1, "A", i, s) for i, s in enumerate(path[:3])] + [(10, "B", 1, "Scheduled"), (11, "B", 2, "Running")], SCHEMA)
    second = spark.createDataFrame([(20, "A", 9, "Running"), (21, "A", 9, "Completed"), (22, "A", 9, "Ready"), (5, "B", 9, "Ready")], SCHEMA)
    for part in (first, second):
        part.write.mode("append").parquet(source)
        query = runs.run_states(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).foreachBatch(lambda b, _: out.append({r.run_id: (r.state, r.sequence, r.rejected) for r in b.collect()})).start().awaitTermination()
    assert out[0] == {"A": ("Leased", 3, 0), "B": ("Scheduled", 10, 1)}
    assert out[-1] == {"A": ("Completed", 21, 1), "B": ("Scheduled", 10, 2)}


def test_guarded_append(spark, tmp_path):
    path, refused = str(tmp_path / "log"), []
    write = runs.guarded_append(path, lambda batch, i, why: refused.append(i))
    batch = lambda *s: events(spark, [{"sequence": x, "event_type": "EnginePaused", "ts": x} for x in s])
    write(batch(1, 2), 0)
    write(batch(1, 2), 0)  # after a restart
    write(batch(5, 7), 1)
    write(batch(6, 8), 2)
    assert refused == [2]
    assert [r.sequence for r in log.read_log(spark, path).orderBy("sequence").collect()] == [1, 2, 5, 7]


def test_order_within_a_batch_of_many_chunks(spark, tmp_path):
    source, out = str(tmp_path / "in"), []
    path = ["Scheduled", "Ready", "Leased", "Running", "Completed"]
    spark.createDataFrame([(i + 1, "A", i, s) for i, s in reversed(list(enumerate(path)))], SCHEMA).coalesce(1).write.parquet(source)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        query = runs.run_states(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).foreachBatch(lambda b, _: out.extend((r.state, r.sequence, r.rejected) for r in b.collect())).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert out == [("Completed", 5, 0)]
