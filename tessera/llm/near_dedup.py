"""Near-duplicate classes by a chosen-path set similarity join.

Method. A document is the set of its distinct n-word shingles. Documents with equal sets are one
class, and the search runs over one representative (least doc_id) of each. Then:

1. Trees. `TREES` independent trees branch the representatives by selected minwise tokens: a
   tree's root takes one minwise token (64 bits) of each set; a node of more than `NODE` members
   branches by two further tokens, chosen by a keyed hash of the node, of which a 4-bit sketch is
   kept. Nodes up to `NODE` are compared exhaustively by sketch. In a larger node every member is
   compared with the least one, its leader: those close to it (`CLOSE`) are linked and branch no
   further, so a group of near copies leaves the tree in one step whatever its size. What
   such a member could still be linked to is itself within `LEADER_LINK` of the leader, by the
   triangle inequality of Jaccard distances, and is linked to it too. At depth `DEPTH` the rest
   of a node is linked to its leader. A pair at similarity s is missed by a tree with
   probability q(0) = 1 - s, q(k) = 1 - s * (1 - q(k-1) ** 2); at s = 0.8 that is 0.25 or less
   at any depth, so eight trees miss about one borderline pair in 100,000.
2. Loose components. Sketch links (estimate of `LOOSE` or more, five standard errors below the
   threshold, and links to leaders) give loose components, which hold all true links that the trees reached.
3. Confirmation. Within each loose component full sets are compared exactly. A pair whose
   members are already known to be in one class isn't compared: it can't change a class. A
   component of more than `COMPONENT_SHINGLES` isn't gathered in one task; there, rounds of
   leaders are broadcast and compared to all members, until every document outside the largest
   class has been a leader, so that nothing is left out either.

Only classes are returned: copies are never expanded into pairs, and nothing about all documents
goes to the driver (only leaders of one oversized component, `LEADER_SHINGLES` at a time).

Defined cases: null text and texts without words have an empty set and are linked with nothing.
Fewer words than n: the whole sequence is the one shingle. Rows with equal doc_id are separate
documents that share the id. Null doc_ids are kept and never linked. Other columns are ignored.
`near_duplicates` says by doc_id what is kept, so that all rows of a class that have its least id
are; `keep_rows` keeps one of them. Representatives are known by a 64-bit hash of their set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import text_arrays as ta
from tessera.llm import worker
from tessera.llm.components import connected_components
from tessera.llm.scratch import Scratch

TREES = 8
SKETCH = 128  # minwise tokens, of which 4 bits each are kept
LOOSE = 0.62
CLOSE = 0.75
LEADER_LINK = 0.4
NODE = 1024
DEPTH = 7
COMPONENT_SHINGLES = 4_000_000
LEADER_SHINGLES = 200_000
LEADERS = 256
#: Sets of at most this many shingles are hashed together, to bound memory.
SET_BLOCK = 60_000

_SEEDS = ta.mix(np.arange(1, TREES + SKETCH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_NIBBLES = np.array([((x >> 4) == 0) * 1 + ((x & 15) == 0) * 1 for x in range(256)], np.uint8)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 64-bit shingles of all rows, sorted within rows; row offsets)."""
    data, offsets = ta.utf8(texts)
    data = ta.LOWER[data]
    starts, ends, by_row = ta.words(data, offsets)
    word = ta.unit_hashes(data, starts, ends)
    del data, starts, ends
    count = np.diff(by_row)
    if len(texts) == 1:
        if not count[0]:
            return np.zeros(0, np.uint64), np.zeros(2, np.int64)
        grams = np.empty(max(count[0] - n + 1, 1), np.uint64)
        for at in range(0, len(grams), SET_BLOCK):
            part = word[at : at + SET_BLOCK + n - 1]
            h = np.full(max(len(part) - n + 1, 1), n, np.uint64)
            for k in range(min(n, len(part))):
                h = ta.mix(h * np.uint64(31) + part[k : k + len(h)])
            grams[at : at + SET_BLOCK] = h
        del word
        grams.sort()
        keep = np.ones(len(grams), bool)
        keep[1:] = grams[1:] != grams[:-1]
        grams = grams[keep]
        return grams, np.array([0, len(grams)])
    n_grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    grams_by_row = np.concatenate([[0], np.cumsum(n_grams)])
    row = ta.row_of(grams_by_row)
    first = np.arange(grams_by_row[-1]) + (by_row[:-1] - grams_by_row[:-1])[row]
    h = np.full(len(first), n, np.uint64)
    last = by_row[1:][row]
    for k in range(n):
        at = first + k
        there = at < last
        h = np.where(there, ta.mix(h * np.uint64(31) + word[np.minimum(at, max(len(word) - 1, 0))]), h) if len(word) else h
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(texts) + 1))


def set_keys(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128-bit keys of sets, (rows, 2); equal sets have equal keys."""
    sums = [ta.per_row(ta.mix(sets ^ np.uint64(c)), offsets, np.uint64) for c in (0x8EBC6AF09C88C6E3, 0xA0761D6478BD642F)]
    return ta.mix(np.stack(sums, 1) + np.diff(offsets).astype(np.uint64)[:, None])


def signatures(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tree roots (rows, TREES), sketches (rows, SKETCH / 2 bytes))."""
    rows = len(offsets) - 1
    least = np.full((rows, TREES + SKETCH), np.uint64(0xFFFFFFFFFFFFFFFF))
    full = np.flatnonzero(np.diff(offsets) > 0)
    at = 0
    while at < len(full):
        base = offsets[full[at]]
        to = max(at + 1, int(np.searchsorted(offsets[full + 1], base + SET_BLOCK, "right")))
        some = full[at:to]
        block = sets[base : offsets[some[-1] + 1]]
        cuts = offsets[some] - base
        for k, seed in enumerate(_SEEDS):
            h = block * seed
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            least[some, k] = np.minimum.reduceat(h, cuts)
        at = to
    roots = ta.mix(least[:, :TREES] + np.arange(TREES, dtype=np.uint64))
    small = (ta.mix(least[:, TREES:]) >> np.uint64(60)).astype(np.uint8)
    return roots, small[:, 0::2] << 4 | small[:, 1::2]


def _binary_rows(values: np.ndarray) -> pa.Array:
    """A (rows, width) array as binary values of equal length."""
    values = np.ascontiguousarray(values)
    width = values.shape[1] * values.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(values.tobytes())]).cast(pa.binary())


_SIGNED = "doc_id long, text_key long, n_shingles long, set_key binary, roots array<long>, sketch binary"


def sign(documents: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for part in ta.blocks(batches):
            sets, offsets = shingle_sets(ta.text_column(part), n)
            keys = set_keys(sets, offsets)
            roots, sketches = signatures(sets, offsets)
            some = np.diff(offsets) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, roots.size + 1, TREES, dtype=np.int32)), pa.array(roots.ravel().view(np.int64)))
            blank = pa.nulls(len(some), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.diff(offsets)), pa.compute.if_else(pa.array(some), _binary_rows(keys), blank), lists, _binary_rows(sketches)],
                names=["doc_id", "text_key", "n_shingles", "set_key", "roots", "sketch"],
            )

    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, _SIGNED)


def _similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of the sketches in a and b, along the last axis."""
    same = _NIBBLES[a ^ b].sum(-1, dtype=np.int64) / SKETCH
    return (same - 1 / 16) / (1 - 1 / 16)


def _sketch_rows(values: pa.Array) -> np.ndarray:
    """A binary column of sketches as (rows, SKETCH / 2)."""
    offs = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(len(values), SKETCH // 2)


def _groups(i: np.ndarray, j: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first member, other members) of each connected group of the links i - j among `size` members."""
    linked = np.zeros((size, size), bool)
    linked[i, j] = linked[j, i] = True
    todo = linked.any(0)
    while todo.any():
        first = int(todo.argmax())
        group, new = np.zeros(size, bool), np.zeros(size, bool)
        group[first] = new[first] = True
        while new.any():
            new = linked[new].any(0) & ~group
            group |= new
        todo &= ~group
        group[first] = False
        yield first, np.flatnonzero(group)


def _compare_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each node's members by sketch; nodes of equal size are compared at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("reps")
        at = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
        ids = lists.flatten().to_numpy()
        sketches = _sketch_rows(batch.column("sketches").flatten())
        at = at - at[0]
        sizes = np.diff(at)
        a, b = [], []
        for size in np.unique(sizes).tolist():
            i, j = np.triu_indices(size, 1)
            nodes = np.flatnonzero(sizes == size)
            step = max(1, (4 << 20) // (len(i) * SKETCH // 2))
            for k in range(0, len(nodes), step):  # a few megabytes of pairs at once, or one node
                member = at[nodes[k : k + step], None] + np.arange(size)
                m = sketches[member]
                close = _similarity(m[:, i], m[:, j]) >= LOOSE
                for node in np.flatnonzero(close.any(1)).tolist():
                    own, hit = ids[member[node]], np.flatnonzero(close[node])
                    for x, others in _groups(i[hit], j[hit], size):
                        a += [int(own[x])] * len(others)
                        b += own[others].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _with_estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        est = _similarity(_sketch_rows(batch.column("sketch")), _sketch_rows(batch.column("leader_sketch"))) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(est)], names=["node", "rep", "sketch", "leader", "estimate"])


def loose_links(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between representatives (rep, roots, sketch) that some tree brings together."""
    level = reps.select(F.explode("roots").alias("node"), "rep", "sketch")
    links = None
    for depth in range(DEPTH + 1):
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        now = scratch.keep(level.join(sizes, "node"), f"level-{depth}")
        nodes = now.where(F.col("size") <= NODE).groupBy("node").agg(F.collect_list("rep").alias("reps"), F.collect_list("sketch").alias("sketches"))
        found = nodes.select("reps", "sketches").mapInArrow(_compare_nodes, "a long, b long")
        big = now.where(F.col("size") > NODE)
        none_big = big.isEmpty()
        if not none_big:
            leaders = big.groupBy("node").agg(F.min(F.struct("rep", "sketch")).alias("l")).select("node", F.col("l.rep").alias("leader"), F.col("l.sketch").alias("leader_sketch"))
            compared = big.join(leaders, "node").select("node", "rep", "sketch", "leader", "leader_sketch")
            compared = scratch.keep(compared.mapInArrow(_with_estimate, "node long, rep long, sketch binary, leader long, estimate double"), f"leaders-{depth}")
            near = compared if depth == DEPTH else compared.where(F.col("estimate") >= LEADER_LINK)
            found = found.unionByName(near.select(F.col("rep").alias("a"), F.col("leader").alias("b")))
        # The same links come back from several trees.
        found = scratch.keep(found.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"links-{depth}")
        links = found if links is None else links.unionByName(found)
        scratch.drop(f"level-{depth}")
        if none_big:
            break
        choice = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(SKETCH // 2)).cast("int") + 1
        byte = lambda k: F.conv(F.hex(F.substring("sketch", choice(k), F.lit(1))), 16, 10).cast("int")
        nibble = lambda k: F.when(F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(2)) == 0, F.shiftright(byte(k), 4)).otherwise(byte(k).bitwiseAND(F.lit(15)))
        rest = compared.where(F.col("estimate") < CLOSE)
        level = rest.select(F.explode(F.array(*[F.xxhash64("node", F.lit(depth), F.lit(k), nibble(k)) for k in (0, 1)])).alias("node"), "rep", "sketch")
    return links.distinct()


class _Classes:
    """Union-find over 0..n-1, with the members of each class."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, x: int, others: np.ndarray) -> None:
        tops = np.unique(np.append(self.of[others], self.of[x]))
        if len(tops) > 1:
            self.of[np.isin(self.of, tops)] = tops[0]


def _linked(inter: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (size + sizes - inter)


def exact_classes(sets: np.ndarray, offsets: np.ndarray, percent: int, ids: np.ndarray | None = None) -> np.ndarray:
    """For each set the least index of its class; sets are linked from `percent` on, or by equal ids."""
    n = len(offsets) - 1
    _, flat = np.unique(sets, return_inverse=True)
    sizes = np.diff(offsets)
    classes = _Classes(n)
    for x in np.flatnonzero(ids[1:] == ids[:-1]).tolist() if ids is not None else ():
        classes.join(x, np.array([x + 1]))
    mark = np.zeros(flat.max(initial=-1) + 1, np.int32)
    for x in range(n):
        rest = x + 1 + np.flatnonzero((classes.of[x + 1 :] != classes.of[x]) & (100 * np.minimum(sizes[x + 1 :], sizes[x]) >= percent * np.maximum(sizes[x + 1 :], sizes[x])))
        if not len(rest):
            continue
        own = flat[offsets[x] : offsets[x + 1]]
        mark[own] = 1
        if 3 * len(rest) > n:
            inter = np.add.reduceat(mark[flat], offsets[:-1])[rest]
        else:
            inter = np.fromiter((mark[flat[offsets[y] : offsets[y + 1]]].sum() for y in rest.tolist()), np.int64, len(rest))
        mark[own] = 0
        classes.join(x, rest[_linked(inter, sizes[x], sizes[rest], percent)])
    least = np.full(n, n)
    np.minimum.at(least, classes.of, np.arange(n))
    return least[classes.of]


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_rep, out_root = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for members in batch.column("members"):
                ids = members.values.field(0).to_numpy()
                each = [np.frombuffer(s.as_buffer(), np.uint64) for s in members.values.field(1)]
                order = np.argsort(ids, kind="stable")
                ids, each = ids[order], [each[k] for k in order]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in each])])
                least = exact_classes(np.concatenate(each), offsets, percent, ids)
                pairs = np.unique(np.stack([ids, ids[least]], 1)[ids != ids[least]], axis=0)
                out_rep.append(pairs[:, 0])
                out_root.append(pairs[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_rep)), pa.array(np.concatenate(out_root))], names=["node", "root"])

    return run


def _sets_of(documents: DataFrame, n: int) -> DataFrame:
    """(component, rep, shingles) for those rows (component, rep, set_key, text) whose set has that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for part in ta.blocks(batches):
            sets, offsets = shingle_sets(ta.text_column(part), n)
            own = _binary_rows(set_keys(sets, offsets))
            same = pa.compute.equal(own, part.column(2)).to_numpy(zero_copy_only=False) & (np.diff(offsets) > 0)
            raw, ends = sets.tobytes(), (8 * offsets).tolist()
            blobs = pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), blobs], names=["component", "rep", "shingles"]).filter(pa.array(same))

    return documents.select("component", "rep", "set_key", "text").mapInArrow(run, "component long, rep long, shingles binary")


def _large_component(members: DataFrame, component: int, percent: int, scratch: Scratch) -> DataFrame:
    """Exact classes (node, root) of one component that is too large for one task.

    members: (rep, n_shingles, shingles), written. Rounds of leaders are compared to all members
    in parallel; a round's leaders hold `LEADER_SHINGLES` together, or are one document.
    """
    spark = members.sparkSession
    done = scratch.keep(spark.createDataFrame([], "rep long"), f"leaders-{component}-0")
    links = None
    root = members.select("rep", F.col("rep").alias("root"))
    k = 0
    while True:
        largest = root.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").select(F.col("root").alias("top")).limit(1)
        # In the first round there is no largest class yet; any members serve.
        waiting = root.join(done, "rep", "left_anti").join(F.broadcast(largest), F.lit(True)).where((F.col("root") != F.col("top")) | F.lit(k == 0))
        chosen = waiting.orderBy(F.xxhash64("rep"), "rep").limit(LEADERS).select("rep").collect()
        if not chosen:
            return root.where("rep <> root").select(F.col("rep").alias("node"), "root")
        leaders, total = [], 0
        for r in members.join(F.broadcast(spark.createDataFrame(chosen, "rep long")), "rep").orderBy("n_shingles").select("rep", "shingles").toLocalIterator():
            if leaders and total + len(r["shingles"]) // 8 > LEADER_SHINGLES:
                break
            leaders.append((r["rep"], np.frombuffer(bytes(r["shingles"]), np.uint64)))
            total += len(r["shingles"]) // 8

        def compare(batches: Iterator[pa.RecordBatch], leaders=leaders) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                reps = batch.column(0).to_numpy(zero_copy_only=False)
                sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column(1)]
                flat = np.concatenate(sets)
                sizes = np.array([len(s) for s in sets])
                cuts = np.cumsum(sizes) - sizes
                a, b = [], []
                for rep, own in leaders:
                    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    inter = np.add.reduceat((own[at] == flat).astype(np.int64), cuts)
                    hit = np.flatnonzero(_linked(inter, len(own), sizes, percent) & (reps != rep))
                    a.append(reps[hit])
                    b.append(np.full(len(hit), rep))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        found = scratch.keep(members.select("rep", "shingles").mapInArrow(compare, "a long, b long"), f"found-{component}-{k}")
        links = found if links is None else links.unionByName(found)
        k += 1
        done = scratch.keep(done.unionByName(spark.createDataFrame([(r,) for r, _ in leaders], "rep long")), f"leaders-{component}-{k}")
        inner = Scratch(spark, f"near-dedup-component-{component}")
        classes = connected_components(links, inner)
        root = scratch.keep(
            members.select("rep").join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("root")),
            f"root-{component}-{k}",
        )
        inner.drop()


def _classes_of(spark: SparkSession, documents: DataFrame, n: int, percent: int, component_shingles: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed rows, representatives, their classes).

    Representatives: (set_key, rep, doc_id, text_key, ...), the least row of each set. Classes of
    two sets or more: (rep, least_id, least_key), by the least row of the class.
    """
    scratch = Scratch(spark, "near-dedup")
    signed = scratch.keep(sign(documents, n), "signed")
    with_set = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = with_set.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "roots", "sketch")).alias("r")).select("set_key", F.xxhash64("set_key").alias("rep"), "r.*")
    reps = scratch.keep(reps, "representatives")
    links = loose_links(reps, scratch)
    loose = connected_components(links, Scratch(spark, "near-dedup-loose"))
    loose = loose.unionByName(loose.select(F.col("root").alias("node"), "root").distinct())
    sized = scratch.keep(loose.join(reps, F.col("node") == F.col("rep")).select("rep", F.col("root").alias("component"), "set_key", "n_shingles", "doc_id"), "loose")
    totals = sized.groupBy("component").agg(F.sum("n_shingles").alias("total"))
    large = [r["component"] for r in totals.where(F.col("total") > component_shingles).select("component").collect()]  # few: each has millions of shingles
    # The members' number has no bound, so they are never broadcast.
    texts = documents.select("doc_id", "text").join(sized.select("doc_id", "rep", "component", "set_key").hint("merge"), "doc_id")
    sets = _sets_of(texts, n)
    small = sets.where(~F.col("component").isin(large)) if large else sets
    grouped = small.groupBy("component").agg(F.collect_set(F.struct("rep", "shingles")).alias("members"))
    classes = scratch.keep(grouped.select("members").mapInArrow(_confirm(percent), "node long, root long"), "classes")
    for component in large:
        members = scratch.keep(sets.where(F.col("component") == component).distinct().select("rep", F.expr("cast(octet_length(shingles) / 8 as long)").alias("n_shingles"), "shingles"), f"large-{component}")
        classes = classes.unionByName(_large_component(members, component, percent, scratch))
    members = classes.unionByName(classes.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "rep")
    least = members.hint("merge").join(reps.select("rep", "doc_id", "text_key"), "rep").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("l"))
    classes = members.join(least.hint("merge"), "root").select("rep", F.col("l.doc_id").alias("least_id"), F.col("l.text_key").alias("least_key"))
    return signed, reps, scratch.keep(classes, "least")


def near_duplicates(spark: SparkSession, documents: DataFrame, n: int = 5, percent: int = 80, component_shingles: int = COMPONENT_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents."""
    signed, reps, classes = _classes_of(spark, documents, n, percent, component_shingles)
    own_key = F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")
    out = signed.select("doc_id", "n_shingles", own_key).join(reps.select("set_key", "rep", F.col("doc_id").alias("rep_id")), "set_key", "left").join(classes, "rep", "left")
    component = F.coalesce("least_id", "rep_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_rows(spark: SparkSession, documents: DataFrame, n: int = 5, percent: int = 80, component_shingles: int = COMPONENT_SHINGLES) -> DataFrame:
    """The rows of documents, all columns: one of each class, with its least doc_id, and all rows
    that are never linked (without words or without an id).

    A row is found again by its id and a hash of its text; of rows equal in both one stays.
    """
    signed, reps, classes = _classes_of(spark, documents, n, percent, component_shingles)
    first = reps.select("rep", "doc_id", "text_key").join(classes, "rep", "left").where("least_id IS NULL OR (doc_id = least_id AND text_key = least_key)")
    blank = signed.where("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id", "text_key").distinct()
    chosen = first.select("doc_id", "text_key", F.lit(True).alias("once")).unionByName(blank.withColumn("once", F.lit(False)))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_key"), row)
    # The chosen rows' number has no bound, so they are never broadcast.
    found = rows.join(chosen.hint("merge"), ["doc_id", "text_key"])
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy(F.xxhash64("row")))
    found = found.withColumn("copy", copy).where("copy = 1 OR NOT once").select("row.*")
    return found.unionByName(documents.where("doc_id IS NULL"))
