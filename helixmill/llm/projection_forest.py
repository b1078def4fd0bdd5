"""Near-duplicates of embeddings by a forest of random-projection trees with spill.

Vectors meet only those of their label. Each tree halves a label's vectors again and again by random directions: a node
takes the projections of its vectors, a threshold at the sparsest of some quantiles around the median, and sends what is
below to one side and what is above to the other; vectors within SPILL of the threshold go to both. Leaves of a tree thus
overlap, and TREES trees cut differently, so linked vectors share some leaf. In a leaf all vectors are compared in double
precision, so no link is false; what no leaf holds together is lost (recall, see README).

Trees are fitted to a sample of each node, of about SAMPLE vectors whatever the node's size, and grown in rounds of a few
levels: a round fits a subtree to each leaf that is still larger than LEAF, all of them at once, and sends all its vectors
down. A node that no direction divides (a dense ball of near copies) stays a leaf, and is compared as a grid of cells
of bounded size, without writing its pairs.

Equal vectors are one node with a count. A pair that shares several leaves counts once: at the least of the leaves
that both are in, for which each row carries all leaves of its vector. So links are counted and never written as pairs;
for the components a cell writes a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import partitions, reachable, small, stored
from helixmill.llm.components import components

COSINE = 0.93
TREES = 10
LEAF = 1024
SPILL = 0.015  #: of unit vectors' projections
SAMPLE = 2048
FEWEST = 64  #: rows of a sample from which a node is divided
LEVELS = 6  #: of a subtree that a round grows
QUANTILES = np.linspace(0.3, 0.7, 9)
STUCK = 0.85  #: a split that leaves more than this share on one side divides nothing
MOST_SPILT = 0.25  #: share of a node that may go to both sides; so the rows of a tree stay below the square root of the nodes for each


def nodes(vectors: DataFrame) -> DataFrame:
    """Stored: node, label, embedding (doubles), n and least, of each different vector that may link; least is its smallest vec_id."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", v.alias("embedding")).where(F.col("label").isNotNull() & usable("embedding"))
    rows = rows.groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return stored(rows.withColumn("node", F.monotonically_increasing_id()))


def usable(v: str) -> F.Column:
    """Whether a vector has a direction: not null, without null or non-finite components, and not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(v).isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(v: pa.Array) -> np.ndarray:
    flat = v.flatten().to_numpy(zero_copy_only=False)
    v = flat.reshape(len(v), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _direction(leaf: int, place: int, width: int) -> np.ndarray:
    d = np.random.default_rng([leaf & 0x7FFFFFFFFFFFFFFF, place]).normal(size=width)
    return d / np.sqrt((d * d).sum())


def fitted(leaf: int, unit: np.ndarray, share: float, target: int) -> list[float]:
    """Thresholds of a subtree's places, 0 the root, 2 k + 1 and 2 k + 2 below k. share: sample to all.

    NaN where it ends; infinity where the sample is too small to go on, and a later round has a sample of that node.
    """
    out = [np.nan] * ((1 << LEVELS) - 1)
    at = {0: np.arange(len(unit))}
    for k in range(len(out)):
        rows = at.pop(k, None)
        if rows is None or len(rows) / share <= target:
            continue
        if len(rows) < FEWEST:
            out[k] = np.inf if k else np.nan  # a root was sampled for itself
            continue
        p = unit[rows] @ _direction(leaf, k, unit.shape[1])
        cuts = np.quantile(p, QUANTILES)
        kept = np.sort(p)
        spilt = np.searchsorted(kept, cuts + SPILL, "right") - np.searchsorted(kept, cuts - SPILL)
        cut = cuts[np.lexsort((np.abs(QUANTILES - 0.5), spilt))[0]]
        left, right = p <= cut + SPILL, p >= cut - SPILL
        if max(left.sum(), right.sum()) > STUCK * len(rows) or (left & right).sum() > MOST_SPILT * len(rows):
            continue
        out[k] = float(cut)
        at[2 * k + 1], at[2 * k + 2] = rows[left], rows[right]
    return out


def _grown(at: DataFrame, target: int) -> tuple[DataFrame, bool]:
    """One round. at: stored rows of node, leaf, done, size, embedding. Returns the rows after it, and whether any leaf was divided."""
    sizes = at.where("NOT done").groupBy("leaf").agg(F.count("*").alias("rows")).where(F.col("rows") > target)
    sizes = small(sizes)
    if not sizes.limit(1).count():
        return at, False
    chosen = F.pmod(F.xxhash64("node", "leaf"), F.lit(1 << 30)).cast("double") * F.col("rows") < float(SAMPLE << 30)
    sample = at.where("NOT done").join(sizes, "leaf").where(chosen).select("leaf", "rows", "embedding")

    def fit(x: pd.DataFrame) -> pd.DataFrame:
        leaf, rows = int(x["leaf"].iloc[0]), int(x["rows"].iloc[0])
        unit = _units(pa.array(x["embedding"], pa.list_(pa.float64())))
        return pd.DataFrame({"leaf": [leaf], "cuts": [fitted(leaf, unit, min(1.0, len(unit) / rows), target)]})

    cuts = small(sample.groupBy("leaf").applyInPandas(fit, "leaf long, cuts array<double>"))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, cuts = batch.column("leaf").to_numpy(), batch.column("cuts")
            took, leaves, done = [], [], []
            fresh = np.flatnonzero(cuts.is_null().to_numpy(zero_copy_only=False))  # small leaves, and those of earlier rounds
            took.append(fresh)
            leaves.append(leaf[fresh])
            done.append(np.ones(len(fresh), bool))
            for x in np.unique(leaf[cuts.is_valid().to_numpy(zero_copy_only=False)]).tolist():
                rows = np.flatnonzero(leaf == x)
                unit, cut = _units(batch.column("embedding").take(pa.array(rows))), np.array(cuts[int(rows[0])].as_py(), float)
                todo = [(0, np.arange(len(rows)))]
                while todo:
                    k, own = todo.pop()
                    if k < len(cut) and np.isfinite(cut[k]):
                        p = unit[own] @ _direction(x, k, unit.shape[1])
                        todo += [(2 * k + 1, own[p <= cut[k] + SPILL]), (2 * k + 2, own[p >= cut[k] - SPILL])]
                    elif len(own):
                        took.append(rows[own])
                        leaves.append(np.full(len(own), _child(x, k)))
                        done.append(np.full(len(own), k < len(cut) and bool(np.isnan(cut[k]))))  # others may be divided further
            order = pa.array(np.concatenate(took))
            rest = [batch.column(c).take(order) for c in ("node", "embedding")]
            yield pa.RecordBatch.from_arrays([rest[0], pa.array(np.concatenate(leaves)), pa.array(np.concatenate(done)), rest[1]], names=["node", "leaf", "done", "embedding"])

    rows = at.join(cuts, "leaf", "left").select("node", "leaf", "embedding", "cuts")
    return stored(rows.mapInArrow(down, "node long, leaf long, done boolean, embedding array<double>")), True


def _child(leaf: int, place: int) -> int:
    """The leaf at a place of a subtree: the tree's number in the first bits, a mixture of the way to it in the others."""
    if not place:
        return leaf
    x = (leaf ^ (place * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return (leaf >> 48) << 48 | (x ^ (x >> 31)) & ((1 << 48) - 1)


def forest(points: DataFrame, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """points: stored node, label, embedding. Returns node, leaf: the leaves of each node in all trees.

    Leaves of one tree that get the same number, which 48 bits make rare, are compared as one: that costs only time.
    """
    width = F.size("embedding")
    root = F.pmod(F.xxhash64("label", width, "tree"), F.lit(1 << 48)) + F.shiftleft(F.col("tree").cast("long"), 48)
    at = points.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select("node", root.alias("leaf"), F.lit(False).alias("done"), "embedding")
    at, more = stored(at), True
    while more:
        at, more = _grown(at, leaf)
    return at.select("node", "leaf")


def _unite(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not (root[root] == root).all():
            root = root[root]
    return root


def _first_shared(leaf: int, lists: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs in a leaf, whether it is the least that both are in. lists: the sorted leaves of each row."""
    width = max(map(len, lists))
    table = np.full((len(lists), width), -1, np.int64)
    for k, x in enumerate(lists):
        table[k, : len(x)] = x
    table[table >= leaf] = -1
    first = np.ones(len(a), bool)
    left = np.arange(len(a))
    for k in range(width):  # of the first row's smaller leaves one after the other; pairs that share it go out
        x = table[a[left], k]
        left = left[x >= 0]
        if not len(left):
            break
        shared = (table[b[left]] == x[x >= 0][:, None]).any(axis=1)
        first[left[shared]] = False
        left = left[~shared]
    return first


def compared(leaf: int, node: np.ndarray, label: np.ndarray, n: np.ndarray, unit: np.ndarray, lists: list[np.ndarray], one: np.ndarray, two: np.ndarray, same: bool) -> tuple[np.ndarray, ...]:
    """Of a cell: nodes and how many vectors are linked to each that weren't at a smaller leaf; and edges that span its links.

    one, two: the rows that meet, in blocks of the cell; ``same`` if they are the same rows, where each pair meets once.
    """
    add, edges = np.zeros(len(node), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(0, len(one), 512):
        part = one[k : k + 512]
        i, j = np.nonzero(unit[part] @ unit[two].T >= COSINE)
        a, b = part[i], two[j]
        ok = (label[a] == label[b]) & (~np.bool_(same) | (a < b))
        a, b = a[ok], b[ok]
        edges.append((a, b))
        for s in range(0, len(a), 1 << 18):
            x, y = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
            first = _first_shared(leaf, lists, x, y)
            np.add.at(add, x[first], n[y[first]])
            np.add.at(add, y[first], n[x[first]])
        whole = [np.concatenate(e) for e in zip(*edges, strict=True)]
        root = _unite(len(node), *whole)
        child = np.flatnonzero(root != np.arange(len(node)))
        edges = [(child, root[child])]
    hit, (u, v) = np.flatnonzero(add), edges[0]
    return node[hit], add[hit], node[u], node[v]


def links(points: DataFrame, leaves: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Stored: kind, a, b. kind 0: node a is linked to b vectors of other nodes; kind 1: an edge. Sums over all rows of a node."""
    lists = leaves.groupBy("node").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))  # a few for each tree
    rows = stored(points.select("node", "label", "n", "embedding").join(lists, "node"))
    rows = rows.withColumn("leaf", F.explode("leaves"))
    hot = rows.groupBy("leaf").agg(F.count("*").alias("c")).where(F.col("c") > 2 * leaf).select("leaf", F.ceil(F.col("c") / leaf).cast("int").alias("parts"))
    rows = rows.join(small(hot), "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    rows = rows.select("leaf", "node", "label", "n", "embedding", "leaves", mine.alias("mine"), F.explode(other).alias("other"))
    rows = rows.select("*", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    rows = rows.repartition(partitions(points.sparkSession), "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "node").drop("other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            cell = pa.Table.from_batches(held).combine_chunks()
            get = lambda c: cell.column(c).to_numpy()
            leaf, i, j = key
            vectors = cell.column("embedding").combine_chunks()
            width = vectors.value_lengths().to_numpy()
            for size in np.unique(width).tolist():  # one, but for leaves of the same number
                own = np.flatnonzero(width == size)
                lists = [np.array(x, np.int64) for x in cell.column("leaves").take(pa.array(own)).to_pylist()]
                mine = get("mine")[own]
                one, two = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
                node, n, u, v = compared(leaf, get("node")[own], get("label")[own], get("n")[own], _units(vectors.take(pa.array(own))), lists, one, two, i == j)
                kind = np.concatenate((np.zeros(len(node), np.int32), np.ones(len(u), np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate((node, u))), pa.array(np.concatenate((n, v)))], names=["kind", "a", "b"])

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("leaf", "i", "j")]
            cut = np.zeros(batch.num_rows, bool)
            for x in keys:
                cut[1:] |= x[1:] != x[:-1]
            cuts = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(int(x[a]) for x in keys) if a < b else key
                if held and now != key:
                    yield from done()
                    held = []
                if a < b:
                    key = now
                    held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    return stored(rows.mapInArrow(run, "kind int, a long, b long"))


def near_duplicates(vectors: DataFrame, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """vectors: vec_id, embedding, label. Returns vec_id, n_links, component_id, kept: a row for each row of vectors.

    n_links counts the other rows linked with it, equal ones included. Null labels and vectors, zero vectors, and those with
    null or non-finite components link with nothing; vectors of different length don't either. Rows without an id link
    like others; a component's id is the smallest that is not null, null if it has none, and kept is false for a null
    vec_id. Rows of one id are rows of their own. An empty table gives no rows; other columns are not read.
    """
    reachable(vectors.sparkSession)
    points = nodes(vectors)
    found = links(points, forest(points, trees, leaf), leaf)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("linked"))
    roots = components(found.where("kind = 1").select("a", "b"))
    points = points.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    points = stored(points.withColumn("linked", F.coalesce("linked", F.lit(0)) + F.col("n") - 1).select("label", "embedding", "linked", "root", "least"))
    least = points.groupBy("root").agg(F.min("least").alias("component_id"))
    points = points.join(least, "root").select(F.col("label").alias("_label"), F.col("embedding").alias("_v"), "linked", "component_id")
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("label", F.when(usable("embedding"), F.col("label")))
    rows = rows.join(points, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_v")), "left")
    own = F.when(F.col("linked").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    rows = rows.select("vec_id", F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
