"""The sample index against scans, its pruning, and when it is stale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spindle.operators.cohort import phrase_match
from spindle.sources import sample_index as index

ROWS = [
    ("s1", "GSE1,GSE2", "Lung cancer of the left lung", "cell line A"), ("s2", "GSE2", "of the", None), ("s3", "GSE10", "the of the lung", "of THE-lung!"), ("s4", "X1", "", "lung of"),
    ("s5", None, None, "Of\tthe   heart"), (None, "GSE1", "of the", "x"), ("s6", "GSE3, GSE1", "of of the the", "é of the"), ("s7", "GSE3", "oft he", "thelung"),
]


@pytest.fixture
def built(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, "sample string, series_id string, title string, source_name string")
    frame.write.parquet(source := f"{tmp_path}/source")
    rows = spark.read.parquet(source)
    assert index.ensure(rows, folder := f"{tmp_path}/index", source, buckets=5)
    return rows, folder, source


@pytest.mark.parametrize("phrases", [["of the"], ["lung"], ["the lung", "heart"], ["of of the the"], ["nothing"], ["", "--"], ["the of the"]])
def test_phrases_are_those_of_a_scan(spark, built, phrases):
    rows, folder, _ = built
    got = sorted(r.sample for r in index.phrase_samples(spark, folder, phrases).collect())
    scan = rows.where("sample is not null").where(phrase_match(index.FIELDS, phrases))
    assert got == sorted(r.sample for r in scan.collect())
    titles = sorted(r.sample for r in index.phrase_samples(spark, folder, phrases, ["title"]).collect())
    assert titles == sorted(r.sample for r in rows.where("sample is not null").where(phrase_match(["title"], phrases)).collect())


def test_studies_of_the_index(spark, built):
    _, folder, _ = built
    got = {(r.series, r.sample) for r in index.series_samples(spark, folder, ["GSE1", "GSE10", "GSE99"]).collect()}
    assert got == {("GSE1", "s1"), ("GSE1", "s6"), ("GSE10", "s3")}
    assert index.series_samples(spark, folder, []).collect() == [] and index.series_samples(spark, folder, ["ZZZ"]).collect() == []


def test_only_the_buckets_of_a_word_are_read(spark, built):
    _, folder, _ = built
    rows = index.lookup(spark, folder, "words", ["lung"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters" in plan and "word" in plan.split("PushedFilters")[1][:80]
    files = rows.select(F.input_file_name().alias("f")).distinct().count()
    assert files == 1 and len(rows.inputFiles()) > 1


def test_staleness(spark, built):
    rows, folder, source = built
    assert not index.is_stale(spark, folder, source) and not index.ensure(rows, folder, source)
    assert index.is_stale(spark, folder, source, version="3") and index.is_stale(spark, folder + "-none", source)
    rows.limit(2).write.mode("append").parquet(source)
    again = spark.read.parquet(source)
    assert index.ensure(again, folder, source) and not index.is_stale(spark, folder, source)
    assert index.newest(spark, folder).built == 2
    with pytest.raises(ValueError):
        index.lookup(spark, folder + "-none", "words", ["x"])


def test_an_empty_table_has_an_empty_index(spark, tmp_path):
    frame = spark.createDataFrame([], "sample string, series_id string, title string, source_name string")
    frame.write.parquet(source := f"{tmp_path}/source")
    index.build(frame, folder := f"{tmp_path}/index", source, buckets=3)
    assert index.phrase_samples(spark, folder, ["of the"]).collect() == [] and index.newest(spark, folder).n_samples == 0


def test_buckets_grow_with_the_text_and_nothing_is_sent_before_the_sort(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKET", 500)
    rows = [(f"s{i:03}", "GSE1", " ".join(["the", f"w{i}", "lung", "of"] * 3), None if i % 2 else "of the") for i in range(200)]
    frame = spark.createDataFrame(rows, "sample string, series_id string, title string, source_name string")
    frame.write.parquet(source := f"{tmp_path}/source")
    index.build(spark.read.parquet(source), folder := f"{tmp_path}/index", source, buckets=2)
    assert len(list((tmp_path / "index" / index.newest(spark, folder).folder / "words" / "rows").glob("bucket=*"))) > 10
    assert "Exchange" not in index.postings(frame)._jdf.queryExecution().executedPlan().toString()
    # more samples than a list holds
    got = {(r.sample, r.field): r.positions for r in index.lookup(spark, folder, "words", ["of"]).collect()}
    assert got == {(r[0], f): p for r in rows for f, p in (("title", [3, 7, 11]), ("source_name", [0])) if f == "title" or r[3]}
    assert index.phrase_samples(spark, folder, ["the w7 lung"]).collect() == [("s007",)]


def test_lists_are_sent_packed_and_come_back_whole(spark):
    import pyarrow as pa

    rng = __import__("random").Random(5)
    words = [" ".join(rng.choice(["the", "of", "lung", f"w{rng.randint(0, 300)}"]) for _ in range(rng.choice([0, 1, 5, 900]))) for _ in range(150)]
    lists = index._lists(pa.array([f"sé{i * 7}" for i in range(150)]), pa.array(words), "title")
    sent = index._packed(lists)
    (back,) = index._unpacked([sent])
    assert back.to_pylist() == lists.to_pylist() and sent.nbytes * 2 < lists.nbytes
    # parts of a batch too
    (some,) = index._unpacked([sent.slice(3, 40)])
    assert some.to_pylist() == lists.to_pylist()[3:43]
    x = index.np.array([0, 1, 127, 128, 16383, 16384, (1 << 31) - 1, 5])
    assert index._numbers(index._varints(x)[0])[0].tolist() == x.tolist()
