"""Approximate nearest neighbours by shifted space-filling curves.

Method. Vectors are projected onto `CURVES` random subspaces of `DIMS` dimensions, shifted, and
each projection is ordered along a Hilbert curve. Each ordering is cut into ranges of keys, and
rows are dealt to tasks by Spark's range partitioning of these; a query is compared with all vectors
of its own range and of `m` ranges on either side, by exact inner products. What the orderings
find is merged and ranked.

The ranges' bounds and the projections' scales come from a sample of at most `SAMPLE` vectors,
picked by a hash of their id; every vector is indexed. A range has at least eight vectors of the
sample, so that bounds stay apart: it holds about `RANGE_ROWS` vectors up to 41 million and more
beyond. Windows hold a fixed share `SHARE` of all vectors, as the recall on vectors without
low-dimensional structure depends on the share alone: twelve windows of 12 per cent have about
0.96 there, at any size. So on such vectors a query is compared with 1.4 to 1.75 times the table
(repeats between orderings counted), which is more than exhaustive search does; on vectors with
structure `share` can be small. The set of queries is stated (ids divisible by `every`), so this is
no join of all with all.

A group is a block of a range's queries with a part of its candidates; candidates are taken in
stretches, and a query keeps its k + 1 best, with ties to the least id. So a group's memory doesn't
follow the table's size, nor the number of equal keys.

Exact copies: equal vectors are one class that is indexed once; each class brings its k + 1
smallest ids to a result, which is all that any result can use. So copies need no windows, and
ties go to the smaller id.

Defined cases: null, zero or non-finite vectors, and those that aren't of the most frequent
length, take no part as queries or candidates. Null ids take no part. Repeated ids are separate
rows. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import worker
from tessera.llm.scratch import Scratch

CURVES = 12
DIMS = 6
BITS = 10
SHARE = 0.12
SAMPLE = 20_000
RANGE_ROWS = 16_384
#: There are at least this many ranges, unless they'd hold fewer than 256 vectors.
RANGES = 48
#: Queries of a range that are searched together, and candidates that are shown to them at once.
QUERY_ROWS = 8192
STRETCH = 4096
SEED = 3


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (rows, dims) below 2**bits."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the reflections and exchanges of axes, from the coarsest level on
        low = bit - 1
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        bit >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where((x[-1] & bit) != 0, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> level & 1)
    return key


class Curves:
    """The orderings: projections, scales and range bounds, fitted to a sample."""

    def __init__(self, sample: np.ndarray, ranges: int, curves: int = CURVES, dims: int = DIMS):
        rng = np.random.default_rng(SEED)
        width = sample.shape[1]
        self.dims = min(dims, width)
        self.planes = [np.linalg.qr(rng.normal(size=(width, self.dims)))[0] for _ in range(curves)]
        self.shifts = rng.uniform(0, 0.25, (curves, self.dims))
        self.scales = []
        for plane in self.planes:
            low, high = np.quantile(sample @ plane, (0.005, 0.995), axis=0)
            self.scales.append((low, np.maximum(high - low, 1e-12)))
        self.bounds = [np.quantile(self.keys(sample, c), np.arange(1, ranges) / ranges, method="lower") for c in range(curves)]

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        low, size = self.scales[curve]
        unit = np.clip((vectors @ self.planes[curve] - low) / size, 0, 1) * 0.75 + self.shifts[curve]
        return hilbert_keys(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)

    def ranges(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, curves): in which range of each ordering a vector is."""
        return np.stack([np.searchsorted(b, self.keys(vectors, c), "right") for c, b in enumerate(self.bounds)], 1)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last."""
    return np.cumsum(a * b, axis=-1)[..., -1]


class _Best:
    """The `keep` nearest classes of each query among those shown so far: largest score, then least class."""

    def __init__(self, queries: np.ndarray, keep: int):
        self._queries, self._keep = queries, keep
        self._size = np.linalg.norm(queries, axis=1)
        self.scores = np.full((len(queries), keep), -np.inf)
        self.others = np.full((len(queries), keep), -1, np.int64)

    def show(self, others: np.ndarray, vectors: np.ndarray) -> None:
        # A product of matrices is right but for its last digits; whatever those can't tell apart is added up exactly.
        slack = 4 * vectors.shape[1] * np.finfo(float).eps * float(np.linalg.norm(vectors, axis=1).max(initial=0))
        for at in range(0, len(self._queries), 512):
            q = self._queries[at : at + 512]
            near = q @ vectors.T
            worst = self.scores[at : at + 512, -1]
            if len(others) > self._keep:
                worst = np.maximum(worst, np.partition(near, -self._keep, axis=1)[:, -self._keep])
            row, col = np.nonzero(near >= (worst - slack * self._size[at : at + 512])[:, None])
            score = np.concatenate([_inner(q[row[i : i + 65536]], vectors[col[i : i + 65536]]) for i in range(0, len(row), 65536)] or [np.zeros(0)])
            there, place = np.nonzero(self.others[at : at + 512] >= 0)
            row = np.concatenate([row, there])
            score = np.concatenate([score, self.scores[at : at + 512][there, place]])
            other = np.concatenate([others[col], self.others[at : at + 512][there, place]])
            order = np.lexsort((other, -score, row))
            row, score, other = row[order], score[order], other[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            good = rank < self._keep
            self.scores[at + row[good], rank[good]] = score[good]
            self.others[at + row[good], rank[good]] = other[good]


_HIT = pa.struct([("less", pa.float64()), ("other", pa.int64())])


def _search(width: int, keep: int):
    """Best classes of each group's queries. Rows come sorted by group (range, part, block), a group's
    queries (`asked` there) before its candidates, which are taken in stretches, whatever their number."""

    def run(batches):
        group, best, asked, queries, others, vectors = None, None, [], [], [], []

        def flush() -> None:
            nonlocal best, others, vectors
            if best is None and queries:
                best = _Best(np.concatenate(queries), keep)
            if best is not None and others:
                best.show(np.concatenate(others), np.concatenate(vectors))
            others, vectors = [], []

        def done() -> pa.RecordBatch:
            ids = np.concatenate(asked) if asked else np.zeros(0, np.int64)
            if best is None or not len(ids):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.list_(_HIT))], names=["class", "hits"])
            there = best.others >= 0
            hits = pa.StructArray.from_arrays([pa.array(-best.scores[there]), pa.array(best.others[there])], fields=list(_HIT))
            ends = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), hits)], names=["class", "hits"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if group != tuple(keys[a].tolist()):
                    if group is not None:
                        flush()
                        yield done()
                    group, best, asked, queries, others, vectors = tuple(keys[a].tolist()), None, [], [], [], []
                part = batch.slice(a, b - a)
                is_query = part.column(3).is_valid().to_numpy(zero_copy_only=False)
                many = int(is_query.sum())
                matrix = _matrix(part.column(5), width)
                if many:
                    asked.append(part.column(3).slice(0, many).to_numpy())
                    queries.append(matrix[:many])
                if queries and many < len(matrix):
                    others.append(part.column(4).slice(many).to_numpy())
                    vectors.append(matrix[many:])
                    if sum(map(len, others)) >= STRETCH:
                        flush()
        if group is not None:
            flush()
            yield done()

    return run


def nearest(spark: SparkSession, embeddings: DataFrame, k: int = 20, every: int = 20, curves: int = CURVES, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `every` its k nearest found."""
    scratch = Scratch(spark, "vector-search")
    schema = "query_id long, rank int, vec_id long, score double"
    vector = F.col("embedding")
    fine = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )
    lengths = fine.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    width = lengths["width"]
    fine = fine.where(F.size("embedding") == width)

    # Classes of equal vectors, with their k + 1 smallest ids.
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    least = fine.withColumn("place", place).where(F.col("place") <= k + 1)
    classes = least.groupBy("embedding").agg(F.min("vec_id").alias("class"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    classes = scratch.keep(classes, "classes")
    n = classes.count()
    asked = fine.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    asked = scratch.keep(asked.join(classes.select("embedding", "class"), "embedding").select("query_id", "class"), "queries")

    picked = classes.orderBy(F.xxhash64("class")).limit(SAMPLE).select("embedding").toArrow()
    rows = int(np.clip(n / RANGES, 256, max(RANGE_ROWS, n // (SAMPLE // 8))))
    ranges = max(1, round(n / rows))
    fitted = Curves(_matrix(picked.column(0), width), ranges, curves)
    around = max(1, int(np.ceil((share * ranges - 1) / 2)))

    def put(batches):
        worker.release()
        for batch in batches:
            at = fitted.ranges(_matrix(batch.column(1), width)) + np.arange(curves) * ranges
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, curves, dtype=np.int32)), pa.array(at.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["class", "embedding", "ranges"])

    placed = classes.select("class", "embedding").mapInArrow(put, "class long, embedding array<double>, ranges array<int>")
    placed = scratch.keep(placed, "placed")
    wanted = placed.join(asked.select("class").distinct().hint("merge"), "class", "left_semi")
    own = wanted.select(F.explode("ranges").alias("own"), "class", "embedding")
    first = F.floor(F.col("own") / ranges) * ranges
    low, high = F.greatest(F.col("own") - around, first), F.least(F.col("own") + around, first + ranges - 1)
    # A range's queries are cut into blocks, and candidates of a range that equal keys have made large
    # into parts; each block meets each part in a group of its own.
    blocks = max(1, int(np.ceil((2 * around + 1) * wanted.count() / ranges / QUERY_ROWS)))
    candidates = placed.select(F.explode("ranges").alias("range"), "class", "embedding")
    sizes = candidates.groupBy("range").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > 2 * rows).select("range", F.ceil(F.col("n") / rows).cast("int").alias("parts"))
    large = F.broadcast(scratch.keep(large, "large"))  # curves * n / (2 * rows) rows of two numbers at most
    number = lambda of, many: F.pmod(F.xxhash64(F.lit(of), "class"), many).cast("int")
    every_one = lambda many: F.explode(F.sequence(F.lit(0), many - 1))
    candidates = candidates.join(large, "range", "left").select("range", number("part", F.coalesce("parts", F.lit(1))).alias("part"), every_one(F.lit(blocks)).alias("block"), F.lit(None).cast("long").alias("asked"), "class", "embedding")
    queries = own.select(F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("range"), "class", "embedding").join(large, "range", "left")
    queries = queries.select("range", every_one(F.coalesce("parts", F.lit(1))).alias("part"), number("block", F.lit(blocks)).alias("block"), F.col("class").alias("asked"), "class", "embedding")
    key = ["range", "part", "block"]
    dealt = queries.unionByName(candidates).repartitionByRange(*key).sortWithinPartitions(*key, F.col("asked").asc_nulls_last())
    found = dealt.mapInArrow(_search(width, k + 1), "class long, hits array<struct<less:double,other:bigint>>")
    # A hit that several windows found comes with equal scores, so repeats are neighbours once sorted.
    merged = found.groupBy("class").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("all"))
    first = F.filter("all", lambda h, i: (i == 0) | (F.get("all", i - 1)["other"] != h["other"]))
    best = merged.select("class", F.slice(first, 1, k + 1).alias("hits"))
    each = best.select("class", F.inline("hits")).join(classes.select(F.col("class").alias("other"), "members"), "other")
    ranked = (
        each.select("class", "less", F.explode("members").alias("vec_id"))
        .groupBy("class")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("less", "vec_id"))), 1, k + 1).alias("hits"))
    )
    mine = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.join(ranked, "class")
        .select("query_id", F.posexplode(mine).alias("place", "hit"))
        .select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
    )
