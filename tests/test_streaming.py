from __future__ import annotations

from spindle.streaming.harvest import first_seen, harvest, records, windowed_counts


def test_harvest_goes_on_after_a_restart(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    (source / "1.jsonl").write_text('{"_id": "a", "date": "2024-01-01T00:00:00"}\nnot json\n\n{"_id": "b", "identifier": "", "date": "2024-01-01T01:00:00"}\n{"_id": "a", "date": "2024-01-01T00:30:00"}\n')
    run = lambda: harvest(first_seen(records(spark, source.as_uri())), target, checkpoint).awaitTermination(120)
    assert run()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == ["a", "b"]
    (source / "2.jsonl").write_text('{"_id": "b", "date": "2024-01-01T02:00:00"}\n{"identifier": "c", "_id": "x", "date": "2024-01-01T03:00:00"}\n{"date": "2024-01-01T03:00:00"}\n')
    assert run()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_windows(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text('{"_id": "a", "date": "2024-01-01T00:10:00"}\n{"_id": "b", "date": "2024-01-01T00:50:00"}\n{"_id": "c", "date": "2024-01-01T01:10:00"}\n')
    query = windowed_counts(records(spark, tmp_path.as_uri())).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 2]
