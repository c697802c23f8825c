"""Paged segments, resumable upserts and isolated batches, with restarts in the middle."""

from __future__ import annotations

import datetime
import json
import random

import pandas as pd
import pytest

from spindle.operators.batches import isolated, manifest, outputs, run_batch
from spindle.operators.segments import segmented
from spindle.sources.paged import deduplicated, harvest_report, read_pages, write_pages
from spindle.streaming import upserts
from spindle.streaming.harvest import records


def by_hand(rows, most, longest=24):
    """Each record's segment from its definition."""
    if len(rows) <= most:
        return {i: ("wildcard", "*") for i, *_ in rows}
    out = {}
    names = [n for _, day, n in rows if day is None and n]
    shared = 0
    while names and all(len(n) > shared and n[: shared + 1] == names[0][: shared + 1] for n in names):
        shared += 1
    for i, day, name in rows:
        if day is not None:
            texts = [f"{day:%Y}", f"{day:%Y-%m}", f"{day:%Y-%m-%d}"]
            n = [sum(d is not None and f"{d:%Y-%m-%d}".startswith(t) for _, d, _ in rows) for t in texts]
            out[i] = ("date", next((t for t, c in zip(texts, n) if c <= most), texts[2]))
        elif name:
            cuts = [name[:k] for k in range(min(shared + 1, longest), min(len(name), longest) + 1)]
            out[i] = ("name", next((c for c in cuts if sum(n.startswith(c) for n in names) <= most), name[:longest]))
        else:
            out[i] = ("wildcard", "*")
    return out


@pytest.mark.parametrize("most", [3, 10, 1000])
def test_segments_by_date_then_name_then_rest(spark, most):
    rng = random.Random(8)
    days = [None, *(datetime.date(2020, rng.randint(1, 12), rng.randint(1, 5)) for _ in range(20)), datetime.date(2021, 1, 1)]
    rows = [(i, rng.choice(days) if i % 2 else None, rng.choice([None, "", "ab", "abc", "abd", "a/b #1*", "z"] + [f"ab{k}" for k in range(9)])) for i in range(120)]
    frame = spark.createDataFrame(rows, "id int, day date, name string")
    got = {r.id: (r.kind, r.segment) for r in segmented(frame, most).collect()}
    assert got == by_hand(rows, most)
    assert segmented(frame.limit(0), most).count() == 0


def test_pages_are_read_until_one_is_empty(spark, tmp_path):
    path = tmp_path.as_uri() + "/pages"
    rows = [("a/b #1*", i, json.dumps({"_id": f"r{i}"})) for i in range(7)] + [("2020-01", i, json.dumps({"_id": f"r{i}", "identifier": "x" if i == 1 else ""})) for i in range(3)]
    frame = spark.createDataFrame(rows, "segment string, id int, value string")
    write_pages(frame, path, 3)
    fetched = read_pages(spark, path)
    got = {(r.segment, r.page): r.n for r in fetched.groupBy("segment", "page").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert got == {("a/b #1*", 1): 3, ("a/b #1*", 2): 3, ("a/b #1*", 3): 1, ("2020-01", 1): 3}
    assert fetched.rdd.getNumPartitions() == 2
    once = {r.id: r.segments for r in deduplicated(fetched).collect()}
    assert once == {"r0": 2, "r1": 1, "x": 1, "r2": 2, "r3": 1, "r4": 1, "r5": 1, "r6": 1}
    expected = frame.groupBy("segment").agg({"*": "count"}).withColumnRenamed("count(1)", "n")
    assert all(r.complete for r in harvest_report(expected, fetched).collect())
    # an empty page ends its segment, what lies behind it is not fetched
    (folder,) = (p for p in (tmp_path / "pages").iterdir() if p.name.startswith("segment=a"))
    for f in (folder / "page=2").iterdir():
        if f.suffix == ".txt":
            f.write_text("\n")
    report = {r.segment: (r.expected, r.fetched, r.pages, r.complete) for r in harvest_report(expected, read_pages(spark, path)).collect()}
    assert report == {"a/b #1*": (7, 3, 1, False), "2020-01": (3, 3, 1, True)}
    assert read_pages(spark, tmp_path.as_uri() + "/nothing").collect() == []


def test_pages_are_written_by_the_tasks_that_have_them(spark, tmp_path):
    rows = [(f"s{i % 5}", i, None if i == 3 else f"é{i}") for i in range(60)]
    write_pages(spark.createDataFrame(rows, "segment string, id int, value string"), tmp_path.as_uri() + "/pages", 5)
    found = {str(f.relative_to(tmp_path / "pages")): f.read_text().split("\n") for f in (tmp_path / "pages").rglob("*") if f.is_file()}
    # nothing but a file for each page: no checksums, markers or temporary folders
    assert len(found) == 15 and found["segment=s3/page=1/part.txt"] == ["", "é8", "é13", "é18", "é23", ""]
    assert read_pages(spark, tmp_path.as_uri() + "/pages").count() == 59


def lines(*rows):
    return "".join(json.dumps({"_id": i, "date": f"2024-01-{day:02d}T00:00:00", "v": v}) + "\n" for i, day, v in rows)


def state(spark, table):
    return {r.id: json.loads(r.body)["v"] for r in upserts.current(spark, table).collect()}


def test_a_batch_broken_off_before_its_commit_changes_nothing(spark, tmp_path):
    source, table, checkpoint = tmp_path / "in", f"{tmp_path}/table", f"{tmp_path}/checkpoint"
    source.mkdir()
    (source / "1.jsonl").write_text(lines(("a", 1, "old"), ("b", 2, "b1"), ("a", 3, "new"), ("a", 2, "middle")))
    stream = lambda: records(spark, source.as_uri())
    run = lambda **more: upserts.harvest_upserts(stream(), table, checkpoint, **more)
    assert run().awaitTermination(120)
    assert state(spark, table) == {"a": "new", "b": "b1"}
    (source / "2.jsonl").write_text(lines(("b", 5, "b2"), ("c", 1, "c1"), ("a", 1, "late and old")))

    def killed():
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(between=killed).awaitTermination(120)
    # the data is there, but no reader takes it
    assert (tmp_path / "table" / "batch-1").exists()
    assert state(spark, table) == {"a": "new", "b": "b1"}
    assert run().awaitTermination(120)
    want = {"a": "new", "b": "b2", "c": "c1"}
    assert state(spark, table) == want
    entries = sorted((r.batch, r.n_rows) for r in upserts.manifest(spark, table).collect())
    assert entries == [(0, 2), (1, 3)]
    # the same batch once more, as after a crash between the manifest and the checkpoint
    again = spark.read.text(f"{source}/2.jsonl")
    assert again.count() == 3
    rows = [("b", "2024-01-05", "b2"), ("c", "2024-01-01", "c1"), ("a", "2024-01-01", "late and old")]
    frame = spark.createDataFrame([(i, datetime.datetime.fromisoformat(d), json.dumps({"v": v})) for i, d, v in rows], "id string, at timestamp, body string")
    upserts.upsert_batch(table)(frame, 1)
    assert state(spark, table) == want and sorted((r.batch, r.n_rows) for r in upserts.manifest(spark, table).collect()) == entries
    # compaction keeps the state, and later batches go on top of it
    upserts.compact(spark, table)
    assert state(spark, table) == want
    (source / "3.jsonl").write_text(lines(("c", 9, "c2"), ("b", 4, "older")))
    assert run().awaitTermination(120)
    assert state(spark, table) == want | {"c": "c2"}


def test_one_key_that_fails_leaves_the_others(spark, tmp_path):
    rows = [(k, v) for k in "abcd" for v in range(3)] + [(None, 1)]
    frame = spark.createDataFrame(rows, "k string, v int")

    def function(group: pd.DataFrame) -> pd.DataFrame:
        if group["k"].iloc[0] == "b":
            raise KeyError("broken")
        if group["k"].iloc[0] == "c":
            return pd.DataFrame({"other": [1]})
        return pd.DataFrame({"total": [int(group["v"].sum())]}) if group["k"].iloc[0] == "a" else pd.DataFrame({"total": []})

    got = {r.k: (r.total, r.error) for r in isolated(frame, "k", function, "total long").collect()}
    assert got == {"a": (3, None), "b": (None, "KeyError: 'broken'"), "c": (None, "ValueError: no column total"), "d": (None, None)}

    folder = f"{tmp_path}/batches"
    assert manifest(spark, folder).collect() == []
    first = {r.key: (r.n_rows, r.error is None) for r in run_batch(frame.where("k <> 'd'"), "k", function, "total long", folder, 1).collect()}
    assert first == {"a": (1, True), "b": (0, False), "c": (0, False)}
    mended = lambda g: pd.DataFrame({"total": [int(g["v"].sum()) + 10]})
    assert {r.key for r in run_batch(frame, "k", mended, "total long", folder, 2).collect()} == {"b", "c", "d"}
    want = {("a", 1, 3), ("b", 2, 13), ("c", 2, 13), ("d", 2, 13)}
    assert {(r.k, r.batch, r.total) for r in outputs(spark, folder).collect()} == want
    # a batch that is run again overwrites itself; with nothing left there is nothing to do
    run_batch(frame, "k", mended, "total long", folder, 2)
    assert {(r.k, r.batch, r.total) for r in outputs(spark, folder).collect()} == want
    assert run_batch(frame, "k", mended, "total long", folder, 3).collect() == []
    assert {(r.k, r.batch, r.total) for r in outputs(spark, folder).collect()} == want


def test_many_segments_share_partitions(spark, tmp_path, monkeypatch):
    from spindle.sources import paged

    rows = [(f"s{k}", i, f"{k}-{i}") for k in range(11) for i in range(k + 1)]
    write_pages(spark.createDataFrame(rows, "segment string, id int, value string"), path := tmp_path.as_uri() + "/pages", 2)
    monkeypatch.setattr(paged, "PARTS", 4)
    monkeypatch.setattr(paged, "LINES", 3)
    reader = paged.PagedReader(path)
    parts = reader.partitions()
    assert len(parts) == 4
    got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(got) == sorted((s, i // 2 + 1, v) for s, i, v in rows)
