"""Ranked lexical search by branch and bound over frequent-pattern trees of documents.

A narrow pass over the documents keeps, of each, the number of its terms and its vector restricted to the terms of the
query set. The vectors are dealt in blocks. In a block each vector's terms are ordered from the most frequent in the
corpus to the rarest, and the sorted vectors form a trie, in which vectors with equal beginnings share a path. A subtree
is a range of the sorted vectors; it keeps the greatest tf of each of its terms and the least m of its documents. The
score grows with tf and falls with m, so these bound what any document below can score. For each item the trie is walked
depth first, subtrees whose bound is below the item's tenth score so far are skipped, and the documents of the others
are scored exactly. The ten best of the task's blocks so far are the next block's start; at last those of all tasks meet.

All arithmetic behind the weights is in 64-bit integers. The query set is measured and sent in chunks of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm import tokens
from helixmill.llm.common import partitions, reachable, stored

FIRST = 10
BLOCK = 8192  #: documents of a tree at most
BLOCK_TERMS = 1 << 20  #: entries of a block's vectors after which it is full
LEAF = 32  #: documents of a subtree that isn't divided further
CHUNK_BYTES = 1 << 20
TABLE = tokens.byte_table(lambda c: c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else tokens.SPACE)
_NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(TABLE).split()


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Queries:
    """The items of a chunk: distinct terms (numbers in ``vocabulary``) and how often each stands in the item."""

    items: list[int]
    vocabulary: list[bytes]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def _queries(rows: list) -> Queries:
    """Rows of item and text. Different texts of one item are one query of all their terms."""
    bags: dict[int, Counter] = {}
    for r in rows:
        bags.setdefault(r.item, Counter()).update(terms(r.text))
    bags = {i: b for i, b in sorted(bags.items()) if b}
    number: dict[bytes, int] = {}
    at = [np.array([number.setdefault(t, len(number)) for t in b], np.int64) for b in bags.values()]
    return Queries(list(bags), list(number), at, [np.array(list(b.values()), np.int64) for b in bags.values()])


def restricted(docs: DataFrame, queries: Queries) -> DataFrame:
    """Stored: doc_id, n (all terms), and the vector over the query vocabulary as arrays terms and tfs. A row for each document."""
    reachable(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.binary())
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            for a, b in tokens.slices(text):
                w = tokens.words(text[a:b], TABLE)
                term = pc.fill_null(pc.index_in(w.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[w.ids]
                kept = term >= 0
                key, tf = np.unique(w.doc[kept] * len(known) + term[kept], return_counts=True)
                ends = np.searchsorted(key, np.arange(b - a + 1) * len(known)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % max(1, len(known)), tf)]
                n = pa.array(np.bincount(w.doc, minlength=b - a).astype(np.int64))
                yield pa.RecordBatch.from_arrays([ids[a:b].cast(pa.int64()), n, *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")
    return stored(rows, compression="zstd")


class Tree:
    """The trie of a block, in depth-first order: node k is the documents low[k] to high[k], its subtree the nodes k to skip[k]."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, ends: np.ndarray, ranks: np.ndarray, tfs: np.ndarray):
        """ends, ranks, tfs: the vectors of the documents, each sorted by rank, from the most frequent term to the rarest."""
        flat = ranks.tolist()
        paths = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        order = sorted(range(len(paths)), key=paths.__getitem__)
        paths = [paths[k] for k in order]
        self.ids, self.m = ids[order], m[order]
        size = np.diff(ends, prepend=0)
        begin = (ends - size)[order]
        size = size[order]
        self.ends = np.concatenate(([0], np.cumsum(size)))
        take = np.arange(self.ends[-1]) + np.repeat(begin - self.ends[:-1], size)
        self.ranks, self.tfs = ranks[take], tfs[take]
        self.size, self.shared = size, np.array([0, *map(self._common, paths, paths[1:])])
        self.low, self.high, self.skip, self.up = [], [], [], []
        self._grow(0, len(paths))
        self.low, self.high, self.skip = np.array(self.low), np.array(self.high), np.array(self.skip)
        self.leaf = self.skip == np.arange(len(self.skip)) + 1
        self.least = np.minimum.reduceat(self.m, self.low)
        for k in range(len(self.low) - 1, 0, -1):
            self.least[self.up[k]] = min(self.least[self.up[k]], self.least[k])
        self._maxima()

    @staticmethod
    def _common(a: list[int], b: list[int]) -> int:
        n = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            n += 1
        return n

    def _grow(self, low: int, high: int) -> None:
        """Nodes of the range: a child for each way its vectors go on after what all share; small neighbours are one child."""
        todo = [(low, high, -1)]
        while todo:
            low, high, up = todo.pop()
            k = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.up.append(up)
            self.skip.append(k + 1)
            inner = self.shared[low + 1 : high]
            if high - low > LEAF and inner.min() < self.size[low:high].max():  # else all are equal
                cuts = [low, *(np.flatnonzero(inner == inner.min()) + low + 1).tolist(), high]
                kids, begin = [], low
                for a, b in zip(cuts[1:-1], cuts[2:], strict=True):
                    if a - begin >= LEAF or b - a >= LEAF:
                        kids.append((begin, a, k))
                        begin = a
                kids.append((begin, high, k))
                if len(kids) > 1:
                    todo += kids[::-1]
        for k in range(len(self.up) - 1, 0, -1):
            self.skip[self.up[k]] = max(self.skip[self.up[k]], self.skip[k])

    def _maxima(self) -> None:
        """keys and most: node << 32 | rank, sorted, and the greatest tf of that term in the subtree."""
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.ends))
        node = np.zeros(len(self.ids), np.int64)
        for k in np.flatnonzero(self.leaf):
            node[self.low[k] : self.high[k]] = k
        keys, most = self._greatest(node[doc] << 32 | self.ranks, self.tfs)
        all_keys, all_most, up = [keys], [most], np.array(self.up)
        while True:  # from the leaves upwards: each round moves what it has to the parents
            on = keys >> 32 > 0
            if not on.any():
                break
            keys, most = self._greatest(up[keys[on] >> 32] << 32 | keys[on] & 0xFFFFFFFF, most[on])
            all_keys.append(keys)
            all_most.append(most)
        self.keys, self.most = self._greatest(np.concatenate(all_keys), np.concatenate(all_most))

    @staticmethod
    def _greatest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return keys, values
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.maximum.reduceat(values, first)

    def bounds(self, ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node a score that no document of its subtree exceeds."""
        key = (np.arange(len(self.low), dtype=np.int64) << 32)[:, None] | ranks
        if not len(self.keys):
            return np.zeros(len(self.low), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        tf = np.where(self.keys[at] == key, self.most[at], 0)
        return (weights * saturation(tf, self.least[:, None])).sum(axis=1)

    def scores(self, low: int, high: int, weights: np.ndarray) -> np.ndarray:
        """The scores of the documents low to high; weights: of each rank, 0 for terms that the item hasn't."""
        a, b = self.ends[low], self.ends[high]
        w, doc = weights[self.ranks[a:b]], np.repeat(np.arange(high - low), np.diff(self.ends[low : high + 1]))
        on = np.flatnonzero(w)
        out = np.zeros(high - low, np.int64)
        np.add.at(out, doc[on], w[on] * saturation(self.tfs[a + on], self.m[low + doc[on]]))
        return out

    def search(self, ranks: np.ndarray, weights: np.ndarray, of: np.ndarray, best: tuple[np.ndarray, np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray]:
        """The best (scores, ids) of those given and of the block; of: zeros for all ranks, left as such."""
        bound = self.bounds(ranks, weights)
        of[ranks] = weights
        seen = int(np.where(self.leaf, bound, -1).argmax())  # the most promising leaf first: it gives the walk its threshold
        best = merged(best, self.scores(self.low[seen], self.high[seen], of), self.ids[self.low[seen] : self.high[seen]], first)
        skip, leaf, bound, k = self.skip, self.leaf, bound.tolist(), 0
        while k < len(bound):
            if bound[k] <= 0 or len(best[0]) == first and bound[k] < best[0][-1]:
                k = int(skip[k])
                continue
            if leaf[k] and k != seen:
                a, b = self.low[k], self.high[k]
                best = merged(best, self.scores(a, b, of), self.ids[a:b], first)
            k += 1
        of[ranks] = 0
        return best


def merged(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    on = scores > (best[0][-1] - 1 if len(best[0]) == first else 0)
    if not on.any():
        return best
    scores, ids = np.concatenate((best[0], scores[on])), np.concatenate((best[1], ids[on]))
    order = np.lexsort((ids, -scores))[:first]
    return scores[order], ids[order]


def _found(vectors: DataFrame, queries: Queries, first: int, block: int) -> DataFrame:
    """item_id, doc_id, score: the best of each task, over vectors as ``restricted`` gives them."""
    spark = vectors.sparkSession
    total = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = total[0], max(1, total[1] or 0)
    df = np.zeros(len(queries.vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the chunk
        df[r.t] = r["count"]
    order = np.lexsort((np.arange(len(df)), -df))
    rank = np.empty(len(df), np.int64)
    rank[order] = np.arange(len(df))
    weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    sent = spark.sparkContext.broadcast((queries.items, [rank[t] for t in queries.terms], [weights[t] * r for t, r in zip(queries.terms, queries.repeats, strict=True)], rank))

    def trees(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[Tree]:
        held, docs, entries = [], 0, 0

        def tree() -> Tree:
            ids, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            at, terms, tfs = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            doc, ranks = np.repeat(np.arange(len(at)), at), rank[terms]
            way = np.lexsort((ranks, doc))
            return Tree(ids, 100 - 75 + (75 * n * n_docs) // n_terms, np.cumsum(at), ranks[way], tfs[way])

        for batch in batches:
            step = min(block, 1024)
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                terms, tfs = part.column("terms"), part.column("tfs")
                sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = pc.fill_null(part.column("doc_id"), int(_NO_ID)).to_numpy(zero_copy_only=False)
                held.append((ids, part.column("n").to_numpy(zero_copy_only=False), sizes, terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64), tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
                docs, entries = docs + part.num_rows, entries + int(sizes.sum())
                if docs >= block or entries >= BLOCK_TERMS:
                    yield tree()
                    held, docs, entries = [], 0, 0
        if docs:
            yield tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, ranks, weights, rank = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        of = np.zeros(len(rank), np.int64)
        for tree in trees(batches, rank):
            for k in range(len(items)):
                best[k] = tree.search(ranks[k], weights[k], of, best[k], first)
        ids = np.concatenate([b[1] for b in best] or [np.zeros(0, np.int64)])
        item = np.repeat(np.array(items, np.int64), [len(b[0]) for b in best])
        score = np.concatenate([b[0] for b in best] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == _NO_ID), pa.array(score)], names=["item_id", "doc_id", "score"])

    return vectors.select("doc_id", "n", "terms", "tfs").where(F.size("terms") > 0).mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, queries: DataFrame, first: int = FIRST, chunk_bytes: int = CHUNK_BYTES, block: int = BLOCK) -> DataFrame:
    """docs: doc_id, text; queries: item_id, text. Returns item_id, rank, doc_id, score: the best documents of each item.

    Null and empty texts have no terms. Items without an id, and those without terms, get no rows; different texts of one item_id
    are one item of all their terms. A document without an id is ranked behind others of its score, with a null; rows of
    one id are documents of their own. Documents that share no term with an item, and those of score 0, are not listed.
    Empty tables give no rows; other columns are not read. A tree holds a bounded number of documents and entries; a
    document's vector holds a term of the query set once, however long its text is.
    """
    rows = queries.select(F.col("item_id").cast("long").alias("item"), "text").where("item IS NOT NULL AND text IS NOT NULL").distinct()
    sized = rows.groupBy("item").agg(F.sum(F.octet_length("text") + 64).alias("bytes"))
    rows = stored(rows)
    n = max(1, math.ceil((sized.agg(F.sum("bytes")).first()[0] or 0) / chunk_bytes))
    out = None
    for k in range(n):
        some = _queries(rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect())  # about chunk_bytes
        found = _found(restricted(docs, some), some, first, block)
        out = found if out is None else out.unionByName(found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    share = F.pmod(F.spark_partition_id(), F.lit(partitions(docs.sparkSession)))
    out = stored(out).withColumn("share", share)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "share").orderBy(*order))).where(F.col("rank") <= first)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= first)
    return out.select("item_id", "rank", "doc_id", "score")
