"""SimHash near-duplicates by anchor-point covering.

A text's 64-bit fingerprint takes each bit from the majority of its shingles' hashes. Fingerprints of at most ``BITS``
differing bits are linked, all of them: the 64 bits are cut into three parts, and of two linked fingerprints some part
differs in one bit at most (three parts of two or more would be six). In each part the anchors are the words of a
covering code of radius one, a Hamming code of 15 bits beside the part's other bits. A fingerprint lives at its nearest
anchor, and is replicated to every anchor within radius plus one; so linked fingerprints meet at an anchor, where those
that live there are compared with all its replicas.

Documents of one fingerprint are one node. An anchor with more replicas than ``MOST`` is dealt out as a grid of
bounded cells, each comparing one share of its residents with one share of its replicas, and a cell returns a spanning
forest of the links that it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import partitions, reachable, small, stored
from helixmill.llm.components import components

SEED = 42
SHINGLE = 4
BITS = 4
PARTS = ((0, 21), (21, 21), (42, 22))
CODED = 15
MOST = 4096
PAIRS = 1 << 21
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``size`` words, repeats included; of the whole if there are fewer words; none without words."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return []
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1)).tolist()
    h, n = xxhash.xxh64_intdigest, max(1, len(words) - size + 1)
    return [h(flat[b:e], SEED) for b, e in zip(begins[:n], ends.tolist()[min(size, len(words)) - 1 :], strict=True)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """A fingerprint for each list: bits that are set in over half of it; 0 for an empty list."""
    out = np.zeros(len(hashes), np.uint64)
    for k, h in enumerate(hashes):
        if h:
            ones = np.zeros(64, np.int64)
            for a in range(0, len(h), 1 << 14):
                part = np.array(h[a : a + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[k] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and ``fp``: the fingerprint as a long. Null texts have the fingerprint of no words, zero."""
    reachable(docs.sparkSession)
    at = docs.select(*keep, F.col("text").alias("_text"))
    schema = at.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = majority([shingle_hashes(x.as_py()) for x in batch.column("_text")]) if batch.num_rows < 64 else np.concatenate([majority([shingle_hashes(x.as_py()) for x in batch.column("_text")[a : a + 64]]) for a in range(0, batch.num_rows, 64)])
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return at.mapInArrow(run, schema)


def _syndrome(x: int) -> int:
    s = 0
    for p in range(1, CODED + 1):
        if x >> (p - 1) & 1:
            s ^= p
    return s


def _flips(free: int) -> list[list[int]]:
    """For each syndrome: the changes of at most two bits that lead to an anchor, the way to the nearest one first."""
    bits = CODED + free
    ways: list[list[int]] = [[] for _ in range(CODED + 1)]
    for n in range(3):
        for c in combinations(range(bits), n):
            mask = sum(1 << b for b in c)
            ways[_syndrome(mask & ((1 << CODED) - 1))].append(mask)
    for s, w in enumerate(ways):
        w.sort(key=lambda m: m != (1 << (s - 1) if s else 0))
    return ways


def _syndrome_of(part: Column) -> Column:
    out = F.lit(0)
    for j in range(4):
        check = sum(1 << (p - 1) for p in range(1, CODED + 1) if p >> j & 1)
        out = out + F.pmod(F.bit_count(part.bitwiseAND(F.lit(check))), F.lit(2)) * (1 << j)
    return out


def replicas(fps: DataFrame) -> DataFrame:
    """anchor, fp, home: a row for every anchor within radius plus one of each part of fp; home at the nearest of a part."""
    def around(k: int, low: int, bits: int) -> Column:
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))
        ways = F.array(*(F.array(*(F.lit(m).cast("long") for m in w)) for w in _flips(bits - CODED)))
        ways = F.element_at(ways, (_syndrome_of(part) + 1).cast("int"))
        return F.transform(ways, lambda m, i: F.struct((part.bitwiseXOR(m) + F.lit(k << 22)).alias("anchor"), (i == 0).alias("home")))

    each = [around(k, low, bits) for k, (low, bits) in enumerate(PARTS)]
    return fps.select("fp", F.inline(F.concat(*each)))


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root: for each node a smaller or equal node of its tree. Joins the trees of a and b; returns roots."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def forest(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """Links (fp, fp) that span what is linked in each cell. Rows are sorted by cell; home rows meet copy rows of a cell."""
    order = np.lexsort((fp, cell))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(cell[order]) != 0) | (np.diff(fp[order]) != 0)
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(new) - 1
    value = fp[order][new]
    root = np.arange(len(value))
    at_home, at_copy = np.flatnonzero(home), np.flatnonzero(copy)
    low = np.searchsorted(cell[at_copy], cell[at_home], "left")
    n = np.searchsorted(cell[at_copy], cell[at_home], "right") - low
    cut = np.flatnonzero(np.diff(np.cumsum(n) // PAIRS, prepend=0)).tolist()
    for i, j in zip([0, *cut], [*cut, len(n)], strict=True):
        if i < j:
            size = n[i:j]
            left = np.repeat(at_home[i:j], size)
            right = at_copy[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[i:j], size)]
            near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= BITS
            root = _unite(root, node[left[near]], node[right[near]])
    child = np.flatnonzero(root != np.arange(len(root)))
    return np.stack([value[child], value[root[child]]])


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct longs fp. Returns a, b: edges whose components are those of all pairs within BITS bits."""
    reachable(fps.sparkSession)
    rows = replicas(fps)
    hot = small(rows.groupBy("anchor").count().where(F.col("count") > MOST).select("anchor", F.ceil(F.col("count") / MOST).cast("int").alias("_n")))
    n, salt = F.coalesce("_n", F.lit(1)), F.pmod(F.xxhash64("fp"), F.coalesce("_n", F.lit(1)).cast("long")).cast("int")
    place = lambda i, j, home, copy: F.struct(i.alias("i"), j.alias("j"), home.alias("home"), copy.alias("copy"))
    yes, no, steps = F.lit(True), F.lit(False), F.sequence(F.lit(0), n - 1)
    grid = F.concat(F.when(F.col("home"), F.transform(steps, lambda k: place(salt, k, yes, no))).otherwise(F.array()), F.transform(steps, lambda k: place(k, salt, no, yes)))
    cold = F.array(place(F.lit(0), F.lit(0), F.col("home"), yes))
    rows = rows.join(hot, "anchor", "left").select("anchor", "fp", F.inline(F.when(F.col("_n").isNull(), cold).otherwise(grid)))
    cell = F.shiftleft("anchor", 38) + F.shiftleft(F.col("i").cast("long"), 19) + F.col("j")
    rows = rows.select(cell.alias("cell"), "fp", "home", "copy").repartition(partitions(fps.sparkSession), "cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def done(table: list[tuple], last: bool) -> tuple[np.ndarray, list[tuple]]:
            cols = tuple(np.concatenate(c) for c in zip(*table, strict=True))
            end = len(cols[0]) if last or not len(cols[0]) else int(np.searchsorted(cols[0], cols[0][-1], "left"))  # its last cell may go on
            return forest(*(c[:end] for c in cols)), [tuple(c[end:] for c in cols)]

        def out(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for batch in batches:
            kept.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "home", "copy")))
            size += batch.num_rows
            if size > 100_000:
                pairs, kept = done(kept, False)
                size = len(kept[0][0])
                yield out(pairs)
        if kept:
            yield out(done(kept, True)[0])

    return rows.mapInArrow(run, "a long, b long")


def grouped(marked: DataFrame, least: Column) -> DataFrame:
    """marked: stored rows with fp. Returns fp and least: the least value of that column over the group of rows that links reach."""
    nodes = stored(marked.groupBy("fp").agg(F.min(least).alias("least")))
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = stored(named.groupBy("root").agg(F.min("least").alias("least")))
    return stored(named.drop("least").join(best, "root").select("fp", "least"))


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest id of the documents that links reach, the document itself included.

    A row for each row of docs. Null ids are never a component's id unless it has no other; null texts have no words.
    """
    marked = stored(fingerprints(docs, ["doc_id"]))
    return marked.join(grouped(marked, F.col("doc_id")), "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def repeats(docs: DataFrame) -> DataFrame:
    """row and extra, for every different row of docs that doesn't stay: docs have doc_id, text, and row, a digest of all columns.

    Of each group of near-duplicates the row of the smallest id stays; rows without an id come last, and of rows of one
    id that of the least digest is taken. ``extra`` is true where the row itself stays, but only one of its exact copies.
    """
    marked = stored(fingerprints(docs, ["doc_id", "row"]))
    best = grouped(marked, F.struct(F.col("doc_id").isNull().alias("_none"), F.col("doc_id"), F.col("row")))
    rows = marked.groupBy("fp", "row").agg(F.count("*").alias("_n")).join(best, "fp")
    stays = F.col("row") == F.col("least.row")
    return rows.where(~stays | (F.col("_n") > 1)).select("row", stays.alias("extra"))


def as_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
