"""Hard negatives by a Voronoi-partitioned join of anchors with all vectors.

Inner products become distances: every vector gets one more component, so that
all have the length of the longest, and an anchor gets a zero there; then a
higher score is a smaller distance. Vectors are assigned to the nearest of the
pivots. Anchors of neighbouring cells form groups; for a group and a cell the
triangle inequality and the planes between pivots leave a ring around the
cell's pivot outside which no vector can serve the group. A vector is sent to
the groups in whose rings it lies, and each group is joined exactly with what
it was sent.

The join runs twice for each question: within the groups' own cells, which
gives every anchor a score that it reaches at least, and then with the rings
that follow from these scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm.common import written
from spindle.llm.multi_index import codebook

#: Anchors of a group (about), and bytes of vectors that a group's task holds at a time (more are dealt to slices).
GROUP, SLICE = 4096, 32 << 20
#: Integer components up to this size (and sums of their products below 2**62) can be scored exactly.
LARGEST = 1 << 40
#: Beyond any score.
LIMIT = (1 << 63) - 1


@dataclass
class Pivots:
    """Pivots (with the added component), each next to a near one, and the largest squared length of a vector."""

    points: np.ndarray
    longest: float

    @property
    def slack(self) -> float:
        """What rounding may change in a distance."""
        return 1e-6 * (1.0 + self.longest**0.5)

    def distances(self, x: np.ndarray, stored: bool) -> np.ndarray:
        """Distances of rows from all pivots; stored rows are brought to the common length, anchors get a zero."""
        norm = (x * x).sum(1)
        last = np.sqrt(np.maximum(self.longest - norm, 0.0)) if stored else np.zeros(len(x))
        full = np.column_stack([x, last])
        squares = (full * full).sum(1)[:, None] - 2 * full @ self.points.T + (self.points**2).sum(1)
        return np.sqrt(np.maximum(squares, 0.0))

    def radius(self, norm: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a vector has that score with an anchor of that squared length; beyond any distance for -LIMIT."""
        return np.sqrt(np.maximum(norm + self.longest - 2.0 * score, 0.0))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(len(column), width)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where that is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2.0**53:
        return a @ b.T
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def fit_pivots(stored: DataFrame, width: int, longest: float, number: int, sample: int) -> Pivots:
    """k-means centres of about ``sample`` vectors at most (chosen by a hash)."""
    n = stored.count()
    share = int(min(1_000_000, 1_000_000 * sample / max(n, 1)))
    got = stored.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < share).orderBy("id").select("vector").toPandas()
    if not len(got):
        got = stored.limit(1).select("vector").toPandas()
    x = _matrix(got["vector"], width).astype(np.float64)
    x = np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0.0))])
    number = number or int(np.clip(round(n**0.5 / 4), 4, 256))
    return Pivots(_chained(codebook(x, min(number, len(x)))), longest)


def _chained(points: np.ndarray) -> np.ndarray:
    """The points in an order that goes on to the nearest one left."""
    left, order = list(range(1, len(points))), [0]
    while left:
        d = ((points[left] - points[order[-1]]) ** 2).sum(1)
        order.append(left.pop(int(d.argmin())))
    return points[order]


def _placed(df: DataFrame, pivots, width: int, stored: bool) -> DataFrame:
    """``df`` with its nearest pivot (cell) and the distance from it."""

    def of(frames):
        for f in frames:
            for at in range(0, len(f), 4096):
                part = f.iloc[at : at + 4096]
                d = pivots.value.distances(_matrix(part["vector"], width).astype(np.float64), stored)
                cell = d.argmin(1)
                yield part.assign(cell=cell.astype(np.int32), far=d[np.arange(len(part)), cell])

    return df.mapInPandas(of, f"{_ddl(df)}, cell int, far double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _bounds(groups: DataFrame, cells: DataFrame, pivots, width: int, rows: int) -> DataFrame:
    """``part, group, cell, low, high, slices``: the ring around each pivot that can serve a group."""

    def of(anchors: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names = ["part", "group", "cell", "low", "high", "slices"]
        if not len(anchors) or not len(own):
            return pd.DataFrame(columns=names)
        p = pivots.value
        j = own["cell"].to_numpy().astype(np.int64)
        low, high = np.full(len(j), np.inf), np.full(len(j), -np.inf)
        for at in range(0, len(anchors), 512):
            some = anchors.iloc[at : at + 512]
            x = _matrix(some["vector"], width).astype(np.float64)
            d, norm = p.distances(x, False), (x * x).sum(1)
            reach, inner = p.radius(norm, some["least"].to_numpy().astype(np.float64)) + p.slack, p.radius(norm, some["most"].to_numpy().astype(np.float64)) - p.slack
            home = some["home"].to_numpy().astype(np.int64)
            # a vector of cell j is at least as far from an anchor as the plane between its pivot and the anchor's
            apart = np.sqrt(((p.points[home][:, None, :] - p.points[j][None, :, :]) ** 2).sum(2))
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart > 0, (d[:, j] ** 2 - d[np.arange(len(x)), home][:, None] ** 2) / (2 * apart), -np.inf)
            open_ = plane <= reach[:, None]
            low = np.minimum(low, np.where(open_, np.maximum(d[:, j] - reach[:, None], inner[:, None] - d[:, j]), np.inf).min(0))
            high = np.maximum(high, np.where(open_, d[:, j] + reach[:, None], -np.inf).max(0))
        take = (low <= own["high"].to_numpy() + p.slack) & (high >= own["low"].to_numpy() - p.slack)
        slices = max(1, -(-int(own["n"].to_numpy()[take].sum()) // rows))
        out = pd.DataFrame({"cell": j[take].astype(np.int32), "low": low[take], "high": high[take]})
        return out.assign(part=anchors["part"].iloc[0], group=anchors["group"].iloc[0], slices=slices)[names]

    # each group gets the list of its part's cells: at most one row for each pivot
    lists = groups.select("part", "group").distinct().join(cells, "part")
    lists = lists.select(*(F.col(c).alias(c) for c in lists.columns))
    kind = "part long, group long, cell int, low double, high double, slices long"
    return groups.groupBy("part", "group").cogroup(lists.groupBy("part", "group")).applyInPandas(of, kind)


def _home_bounds(groups: DataFrame, cells: DataFrame, rows: int) -> DataFrame:
    """The groups' own cells, whole."""
    out = groups.select("part", "group", F.col("home").alias("cell")).distinct().join(cells, ["part", "cell"])
    total = F.sum("n").over(Window.partitionBy("part", "group"))  # at most a row for each pivot
    slices = F.greatest(F.lit(1), F.ceil(total / rows)).cast("long")
    return out.select("part", "group", "cell", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), slices.alias("slices"))


def _joined(groups: DataFrame, bounds: DataFrame, stored: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """``node, ring, score, id``: of each anchor and ring the first ``k`` rows among those that the bounds let through."""
    key = ["part", "group", "slice"]
    near = (F.col("far") >= F.col("low")) & (F.col("far") <= F.col("high"))
    sent = stored.join(bounds, ["part", "cell"]).where(near)
    sent = sent.select("part", "group", F.pmod(F.xxhash64("id"), "slices").alias("slice"), "id", "label", "vector")
    slices = bounds.groupBy("part", "group").agg(F.max("slices").alias("slices"))
    own = groups.join(slices, ["part", "group"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))

    def of(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = {"node": [], "ring": [], "score": [], "id": []}
        if len(anchors) and len(rows):
            rows = rows.sort_values("id", kind="stable")
            ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
            y = _matrix(rows["vector"], width)
            for at in range(0, len(anchors), 64):
                some = anchors.iloc[at : at + 64]
                scores = _scores(_matrix(some["vector"], width), y)
                fits = (labels[None, :] == some["label"].to_numpy()[:, None]) == same
                for i, (node, lows, highs) in enumerate(zip(some["node"], some["lows"], some["highs"], strict=True)):
                    for ring, (lo, hi) in enumerate(zip(lows, highs, strict=True)):
                        hit = np.flatnonzero(fits[i] & (scores[i] >= lo) & (scores[i] <= hi))
                        if len(hit) > k:
                            # all that tie with the k-th stay until the ids decide
                            least = np.partition(scores[i, hit], len(hit) - k)[len(hit) - k]
                            hit = hit[scores[i, hit] >= least]
                            hit = hit[np.argsort(-scores[i, hit], kind="stable")[:k]]
                        found["node"] += [node] * len(hit)
                        found["ring"] += [ring] * len(hit)
                        found["score"] += scores[i, hit].tolist()
                        found["id"] += ids[hit].tolist()
        return pd.DataFrame(found).astype({"node": "int64", "ring": "int32", "score": "int64", "id": "int64"})

    met = own.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(of, "node long, ring int, score long, id long")
    rank = F.row_number().over(Window.partitionBy("node", "ring").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(anchors: DataFrame, stored: DataFrame, pivots, width: int, k: int, same: bool) -> DataFrame:
    """``node, ring, score, id, rank``: of each anchor's rings the first k rows of its own label (or of the others)."""
    part = (lambda c: F.col(c).cast("long")) if same else (lambda c: F.lit(0).cast("long"))
    stored = stored.withColumn("part", part("label"))
    cells = written(stored.groupBy("part", "cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")), "cells")
    rows = max(64, SLICE // (8 * max(width, 1)))
    placed = anchors.withColumn("part", part("label")).withColumnRenamed("cell", "home")
    # cells lie in a chain of near ones, which is cut into groups; a row for each pivot at most in a window
    count = placed.groupBy("part", "home").agg(F.count("*").alias("own"))
    before = F.sum("own").over(Window.partitionBy("part").orderBy("home")) - F.col("own")
    spot = F.col("before") + F.pmod(F.xxhash64("node"), "own")
    groups = placed.join(count.withColumn("before", before), ["part", "home"]).withColumn("group", F.floor(spot / GROUP)).drop("before", "own", "far")
    groups = written(groups, "groups")
    home = written(_home_bounds(groups, cells, rows), "home-bounds")
    first = written(_joined(groups, home, stored, width, k, same), "own-cells")
    # an anchor reaches the k-th score met in its group's cells, or else the lower end of the ring
    reached = first.where(F.col("rank") == k).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("ring", "score"))).alias("got"))
    ends = groups.join(reached, "node", "left")
    floor = F.zip_with("lows", F.sequence(F.lit(0), F.size("lows") - 1), lambda lo, i: F.coalesce(F.try_element_at("got", i.cast("int")), lo))
    ends = ends.withColumn("least", F.array_min(floor)).withColumn("most", F.array_max("highs")).drop("got")
    bounds = written(_bounds(ends, cells, pivots, width, rows), "bounds")
    return written(_joined(groups, bounds, stored, width, k, same), "met")


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, pivots: int = 0, sample: int = 20_000) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vectors(vec_id, label, vector)``.

    ``vector`` holds integers, a score is an inner product; higher scores come
    first, ties by vec_id. ``anchors`` is a condition on vec_id. An anchor's
    positives are its first ``positives`` other rows of its label; of each, the
    first ``negatives`` rows of other labels are returned whose score lies
    between ``low`` and ``high`` percent of the positive's.

    Rows with a null in any of the columns or components take no part, nor do
    rows whose scores could pass 64 bits. Rows of one vec_id count as one, the
    least by label and vector. Vectors of different lengths are not compared.
    Labels and ids are whole numbers. Of equal rows of a label only as many as
    can be returned are sent around, equal anchors are searched once. An empty
    table gives an empty table. ``pivots``: their number (0: from the number of
    rows, 256 at most), fitted on about ``sample`` vectors.
    """
    spark = vectors.sparkSession
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    base = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long"), F.col("vector").cast("array<bigint>"), anchors.alias("anchor"))
    base = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    base = base.where(~F.exists("vector", lambda x: x.isNull() | (F.abs(x) > LARGEST)))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    base = base.withColumn("norm", norm).where(F.col("norm") < 2.0**62)
    base = base.groupBy("id").agg(F.min(F.struct("label", "vector", "norm", "anchor")).alias("r")).select("id", "r.*")
    base = written(_packed(base), "vectors")
    out = None
    for width, longest in sorted((r.width, r.longest) for r in base.groupBy("width").agg(F.max("norm").alias("longest")).collect()):
        found = _of_width(base.where(F.col("width") == width).drop("width"), width, longest, positives, negatives, low, high, pivots, sample)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], kind) if out is None else out


def _packed(base: DataFrame) -> DataFrame:
    """Vectors as bytes of little-endian 64-bit integers, and their width."""

    def of(frames):
        for f in frames:
            data = [np.asarray(v, "<i8").tobytes() for v in f["vector"]]
            yield f.assign(width=[len(v) // 8 for v in data], vector=data)[["id", "label", "vector", "norm", "anchor", "width"]]

    return base.mapInPandas(of, "id long, label long, vector binary, norm double, anchor boolean, width int")


def _of_width(base: DataFrame, width: int, longest: float, positives: int, negatives: int, low: int, high: int, number: int, sample: int) -> DataFrame:
    spark = base.sparkSession
    # of equal rows no more than these can be among an anchor's positives (itself included) or negatives
    copies = Window.partitionBy("label", "vector").orderBy("id")
    most = max(positives + 1, negatives)
    stored = base.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= most).select("id", "label", "vector")
    pivots = spark.sparkContext.broadcast(fit_pivots(stored, width, longest, number, sample))
    stored = written(_placed(stored, pivots, width, True), "stored")
    anchor_rows = base.where("anchor").select("id", "label", "vector")
    nodes = anchor_rows.groupBy("label", "vector").agg(F.min("id").alias("node"))
    nodes = written(_placed(nodes.select("node", "label", "vector"), pivots, width, False), "anchors")
    named = written(anchor_rows.join(nodes.select("label", "vector", "node"), ["label", "vector"]).select("id", "node"), "names")

    every = [F.array(F.lit(x).cast("long")).alias(n) for x, n in ((-LIMIT, "lows"), (LIMIT, "highs"))]
    own = _search(nodes.select("*", *every), stored, pivots, width, positives + 1, same=True)
    # a score p allows those from low p / 100 to high p / 100: none where p is negative
    p = F.col("score").cast("decimal(38,0)")
    rings = own.where("score >= 0").select("node", "score").distinct()
    ends = F.struct("score", F.ceil(p * low / 100).cast("long").alias("lo"), F.floor(p * high / 100).cast("long").alias("hi"))
    rings = rings.select("node", ends.alias("r")).groupBy("node").agg(F.sort_array(F.collect_list("r")).alias("rings"))
    rings = written(rings.select("node", F.transform("rings", lambda r: r["score"]).alias("of"), F.transform("rings", lambda r: r["lo"]).alias("lows"), F.transform("rings", lambda r: r["hi"]).alias("highs")), "rings")
    met = _search(nodes.join(rings.drop("of"), "node"), stored, pivots, width, negatives, same=False)
    met = met.join(rings.select("node", "of"), "node").select("node", F.element_at("of", F.col("ring") + 1).alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))

    # an anchor leaves itself out of its node's list
    lists = own.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("own"))
    pairs = named.join(lists, "node").select(
        "node", F.col("id").alias("anchor_id"), F.slice(F.filter("own", lambda r: r["positive_id"] != F.col("id")), 1, positives).alias("own")
    )
    pairs = pairs.select("node", "anchor_id", F.explode("own").alias("r")).select("node", "anchor_id", "r.positive_id", "r.positive_score")
    return pairs.join(met, ["node", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
