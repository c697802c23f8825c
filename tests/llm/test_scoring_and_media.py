"""Classifiers by held-out accuracy, media by exact round trips, and the pipeline's stages."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from spindle.llm import tiff
from spindle.llm.gbdt import fit_classifier, fit_isotonic, fit_trees
from spindle.llm.quality import quality_scores
from spindle.llm.toxicity import toxicity_scores


def area(score: np.ndarray, y: np.ndarray) -> float:
    wins = (score[y == 1][:, None] > score[y == 0]).mean() + 0.5 * (score[y == 1][:, None] == score[y == 0]).mean()
    return float(wins)


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_trees(x[:2000], y[:2000], trees=60, depth=3)
    raw = model.raw(x)

    def walk(row: np.ndarray) -> float:
        total = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return total

    assert np.allclose(raw[:50], [walk(r) for r in x[:50]])
    assert area(raw[2000:], y[2000:]) > 0.97
    assert len(fit_trees(x[:0], y[:0]).raw(x)) == 3000
    assert fit_classifier(x, np.zeros(3000)).score(x).max() < 0.1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=1, max_size=60))
def test_calibration_does_not_fall(pairs):
    raw, y = (np.array(v, float) for v in zip(*pairs, strict=True))
    values = fit_isotonic(raw, y)(np.linspace(-2, 12, 200))
    assert (np.diff(values) >= -1e-12).all()
    assert values.min() >= 0
    assert values.max() <= 1


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiounrstl") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic, good = int(rng.random() < 0.25), int(rng.random() < 0.7)
        for _ in range(4 * toxic):
            text[rng.randrange(len(text))] = rng.choice(["gromf", "snarkel", "You"]) + rng.choice(["", "en", "a"])
        out = " ".join(text)
        rows.append((i, out if good else out.upper().replace(" ", "!! "), "en"))
        labels.append((i, good, toxic))
    docs = spark.createDataFrame([*rows, (5000, None, "de"), (5001, "", "de"), (None, "text", None)], "doc_id long, text string, score string").repartition(4)
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), labels[0]], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("scores", "label", "threshold"), [(toxicity_scores, "toxic", 0.5), (quality_scores, "quality", 0.3)])
def test_held_out_accuracy(marked, scores, label, threshold):
    docs, labels = marked
    got = {r.doc_id: r for r in scores(docs, labels).collect()}
    assert len(got) == 1503
    truth = {r.doc_id: r[label] for r in labels.collect() if r.doc_id is not None and r[label] is not None}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in got.values())
    score, y = np.array([got[i].score for i in held]), np.array([truth[i] for i in held])
    assert area(score, y) > 0.9
    again = {r.doc_id: r.score for r in scores(docs.repartition(2), labels).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_held_out_labels_teach_nothing(marked):
    docs, labels = marked
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity_scores(docs, x).collect()} for x in (labels, flipped))
    assert one == two


@pytest.mark.parametrize("scores", [toxicity_scores, quality_scores])
def test_without_labels_or_documents(marked, scores):
    docs, labels = marked
    assert {r.predicted for r in scores(docs, labels.limit(0)).collect()} <= {0, 1}
    assert scores(docs.limit(0), labels).count() == 0


@settings(max_examples=80, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 90), st.integers(1, 70), st.sampled_from([1, 3]), st.sampled_from([1, 4, 256])), min_size=1, max_size=3),
    st.sampled_from([tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE]), st.sampled_from([1, 2]), st.sampled_from([None, 16, 64]), st.integers(1, 40), st.integers(0, 2**31),
)
def test_tiff_round_trips(shapes, compression, predictor, tile, rows, seed):
    rng = np.random.default_rng(seed)
    images = [rng.integers(0, top, (h, w, s), dtype=np.uint8) for h, w, s, top in shapes]
    pages = list(tiff.pages_of(tiff.encode_pages(images, compression, predictor, tile, rows)))
    assert [(p.page, p.height, p.width, p.samples, p.error) for p in pages] == [(i, *x.shape, None) for i, x in enumerate(images)]
    assert [p.pixels for p in pages] == [x.tobytes() for x in images]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_table_restarts():
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes() + b"ab" * 20_000
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def big_endian_file() -> bytes:
    """A page of 16-bit samples, most significant byte first, in one uncompressed strip with differences."""
    pixels = np.array([[1, 2, 700], [5, 5, 5]], ">u2")
    strip = np.concatenate([pixels[:, :1], np.diff(pixels, axis=1)], axis=1).astype(">u2").tobytes()
    entries = [(256, 3), (257, 2), (258, 16), (259, 1), (273, 8), (277, 1), (278, 2), (279, len(strip)), (317, 2)]
    fields = b"".join(t.to_bytes(2, "big") + b"\0\3" + b"\0\0\0\1" + v.to_bytes(2, "big") + b"\0\0" for t, v in entries)
    return b"MM\0*" + (8 + len(strip)).to_bytes(4, "big") + strip + len(entries).to_bytes(2, "big") + fields + b"\0\0\0\0"


def test_tiff_pages_of_good_and_broken_files(spark):
    good = tiff.encode_pages([np.arange(60, dtype=np.uint8).reshape(6, 10), np.zeros((2, 2), np.uint8)], tiff.LZW, 2)
    loop = bytearray(good)
    loop[-4:] = loop[4:8]
    files = {1: good, 2: None, 3: b"", 4: b"II*\0\xff\xff\0\0", 5: good[:-40], 6: bytes(loop), 7: big_endian_file(), 8: b"junk junk"}
    frame = spark.createDataFrame([(i, bytearray(d) if d is not None else None, "x") for i, d in files.items()], "page long, media binary, error string")
    rows = tiff.tiff_pages(frame.withColumnRenamed("page", "id"), ("id",), "media").collect()
    by = {i: [r for r in rows if r.id == i] for i in files}
    assert [len(by[i]) for i in (1, 2, 3, 4, 6, 7, 8)] == [2, 0, 1, 1, 3, 1, 1]
    assert bytes(by[1][0].pixels) == bytes(range(60))
    assert all(by[i][-1].error for i in (3, 4, 5, 6, 8))
    assert bytes(by[7][0].pixels) == np.array([[1, 2, 700], [5, 5, 5]], ">u2").tobytes()
    assert tiff.tiff_pages(frame.limit(0), ("page",), "media", nested=True).count() == 0


def test_texts_stored_as_media(spark, docs, tmp_path):
    from spindle.llm.queries import op1_tiff_media

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple("" if v is None else v for v in r) for r in op1_tiff_media(spark, str(tmp_path)).drop("media_bytes", "media_sha256", "feature", "n_pages").collect() if r.doc_id)
    expected = []
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        if r.doc_id:
            expected.append((r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert got == sorted(expected)


def test_pipeline_stages(spark, sf_dir):
    """The stages in order over a small table: columns stay, decisions take effect, clean documents stay."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, kept[-1], sf_dir).cache()
        if k + 1 < len(cp.STAGES):
            assert out.columns == list(cp.COLUMNS)
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in kept[-1].select("doc_id").collect()}
        kept.append(out)
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    after = {r.doc_id for r in kept[2].select("doc_id").collect()}
    assert sum(i in after for i in clean) >= 0.9 * len(clean)
    first = {r.text: r.doc_id for r in kept[2].orderBy(F.desc("doc_id")).collect()}
    unique = [r for r in kept[3].collect()]
    assert len({r.text for r in unique}) == len(unique)
    assert all(first[r.text] == r.doc_id for r in unique)
    pieces = kept[5].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept[4].collect()}
    assert cp.run(spark, sf_dir).count() == len(pieces)


def test_near_dedup_stage_keeps_rows_without_id(spark, docs):
    import corpus_pipeline as cp

    frame = docs.select(*cp.COLUMNS)
    out = cp.near_dedup(spark, frame, "").collect()
    assert sum(r.doc_id is None for r in out) == 1
    assert len({r.doc_id for r in out}) == len(out)


def test_pipeline_stages_on_an_empty_table(spark, sf_dir, docs):
    import corpus_pipeline as cp

    for _, stage in cp.STAGES:
        assert stage(spark, docs.select(*cp.COLUMNS).limit(0), sf_dir).count() == 0


def test_pipeline_rows_are_those_of_brute_force(spark, docs):
    """The stages after the classifiers on odd rows: which documents stay, what is cut from them, and the packed ids."""
    import corpus_pipeline as cp
    from test_dedup import brute_repeats, roots
    from test_similar_texts import jaccard

    frame = docs.where("doc_id is not null").select(*cp.COLUMNS)
    rows = sorted({(r.doc_id, r.text or "") for r in frame.collect()})
    links = [(i, j) for i, (_, x) in enumerate(rows) for j, (_, y) in enumerate(rows[:i]) if jaccard(x, y) >= 0.8]
    group = roots(range(len(rows)), links)
    expected = [r for i, r in enumerate(rows) if group[i] == i]
    kept = cp.near_dedup(spark, frame, "").cache()
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == expected
    # whole characters stay of what brute force leaves
    cut = [(i, "".join(c for c in data.decode("utf-8", "replace") if c != "\ufffd"), n) for i, _, n, _, data in brute_repeats([(i, t.encode()) for i, t in expected], 50)]
    cut = sorted((i, t) for i, t, n in cut if not n or t.strip(" "))
    left = cp.repeats(spark, kept, "").cache()
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == cut
    lengths = {}
    for r in cp.packing(spark, left, "").collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    library = Tokenizer.from_file(cp.WORD_BPE)
    assert lengths == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in cut}


def directories(media: bytes) -> list[dict[int, int]]:
    """The image directories of a little-endian TIFF: tag -> value (or where the values stand)."""
    at, out = int.from_bytes(media[4:8], "little"), []
    while at:
        n = int.from_bytes(media[at : at + 2], "little")
        entries = [media[at + 2 + 12 * i : at + 14 + 12 * i] for i in range(n)]
        wide = {3: 2, 4: 4}
        out.append({int.from_bytes(e[:2], "little"): int.from_bytes(e[8 : 8 + wide[int.from_bytes(e[2:4], "little")]], "little") for e in entries if int.from_bytes(e[2:4], "little") in wide})
        at = int.from_bytes(media[at + 2 + 12 * n : at + 6 + 12 * n], "little")
    return out


def test_media_columns_against_the_stored_bytes(spark, docs, tmp_path):
    """Size and digest are those of the stored form, the feature is that of its directories and pixels."""
    from spindle.llm.queries import op1_tiff_media

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # equal rows have equal values, so a row for each document is enough
    got = {r.doc_id: r for r in op1_tiff_media(spark, str(tmp_path)).where("doc_id is not null").collect()}
    stored = {r.doc_id: bytes(r.media) for r in tiff.stored_documents(docs.select("doc_id", "text")).where("doc_id is not null").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").collect()}
    assert got.keys() == stored.keys()
    by_text = {}
    for doc_id, media in stored.items():
        r, pages = got[doc_id], directories(media)
        assert (r.media_bytes, r.media_sha256, r.n_pages) == (len(media), hashlib.sha256(media).hexdigest(), len(pages))
        data = texts[doc_id].encode()
        payload = data + b"\xff" * (r.payload_bytes - len(data))
        first = pages[0]
        parts = r.feature.split(";")
        assert parts[:6] == [str(len(pages)), str(first[256]), str(sum(p[257] for p in pages)), str(first[259]), str(first.get(317, 1)), str(int(322 in first))]
        assert float(parts[6]) == pytest.approx(sum(payload) / len(payload), abs=2e-6)
        assert by_text.setdefault(texts[doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
