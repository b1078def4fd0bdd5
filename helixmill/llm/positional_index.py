"""A distributed positional inverted index, and phrase and proximity search over it.

``build`` writes the index of the training documents: they are cut into blocks where they lie, and each block stores,
for every term, the sorted positions of the term in the block. So the index is partitioned by document, as search
engines do it: building shuffles nothing, and a search is a narrow pass over blocks with the query set at hand.

A phrase is looked up from its rarest term (by the lengths of the block's own lists): every posting of that term,
less the term's offset in the phrase, is a possible start; the starts are intersected with the offset-adjusted lists of
the phrase's other terms, rarest first, until none is left or all terms agree.

The query set is the one thing sent to all tasks. It is cut into pieces of a bounded size, measured and dealt into chunks.
One chunk is one broadcast and one narrow pass. More are searched one after another: each is fetched, sent, searched,
its documents with matches are stored, and it is released before the next one is fetched; then the matches of a document
are united. So neither driver nor tasks hold more than one chunk, however large the query set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from helixmill.llm.common import reachable, stored

BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 4 << 20
PIECE_BYTES = 64 << 10
WIDTH = 13
MOST = 1 << 21  # candidate starts that are held at a time
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = "block long, ids array<{id}>, n_words array<int>, terms array<binary>, ends array<int>, positions binary"
HITS = "block long, ord int, {key} {id}, n_words long, spans array<struct<begin:int,end:int>>, items array<long>, near_items array<long>"


def words(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters in lower case, and all characters beyond ASCII. Null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _block(number: int, ids: list, texts: list[list[bytes]]) -> dict:
    terms: dict[bytes, int] = {}
    flat = np.fromiter((terms.setdefault(w, len(terms)) for t in texts for w in t), np.int32, sum(map(len, texts)))
    order = np.argsort(flat, kind="stable")
    ends = np.cumsum(np.bincount(flat, minlength=len(terms)))
    gaps = np.diff(order, prepend=0)
    starts = np.concatenate(([0], ends[:-1])) if len(terms) else np.zeros(0, np.int64)
    gaps[starts] = order[starts]
    return {"block": number, "ids": ids, "n_words": [len(t) for t in texts], "terms": list(terms), "ends": ends.tolist(), "positions": gaps.astype("<u4").tobytes()}


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of all documents, which keeps their column ``key``, whatever its type.

    Null texts are documents of no words; repeated keys are documents of their own, and so are null ones.
    """
    reachable(docs.sparkSession)
    rows = docs.select(F.col(key).alias("ids"), F.col(text).alias("text"))
    index = INDEX.format(id=rows.schema["ids"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            fields = [("block", pa.int64()), ("ids", pa.list_(batch.column(0).type)), ("n_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("ends", pa.list_(pa.int32())), ("positions", pa.binary())]
            ids, held, size = [], [], 0
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                held.append(words(x.as_py()))
                size += sum(map(len, held[-1])) + 8
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist([_block(number, ids, held)], pa.schema(fields))
                    number, ids, held, size = number + 1, [], [], 0
            if ids:
                yield pa.RecordBatch.from_pylist([_block(number, ids, held)], pa.schema(fields))
                number += 1

    return stored(rows.mapInArrow(run, index), compression="zstd")


class Phrases:
    """Queries as a matrix of term numbers, -1 after the end of a short phrase."""

    def __init__(self, rows: list[tuple[int, list[bytes]]], width: int):
        number: dict[bytes, int] = {}
        self.terms = np.full((len(rows), width), -1, np.int32)
        for k, (_, phrase) in enumerate(rows):
            self.terms[k, : len(phrase)] = [number.setdefault(w, len(number)) for w in phrase]
        self.items = np.array([i for i, _ in rows], np.int64)
        self.sizes = (self.terms >= 0).sum(axis=1)
        self.vocabulary = list(number)


def windows(item: int, text: str | None, width: int = WIDTH) -> list[tuple[int, list[bytes]]]:
    w = words(text)
    return [(item, w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []


def whole(item: int, text: str | None) -> list[tuple[int, list[bytes]]]:
    return [(item, w)] if (w := words(text)) else []


class Postings:
    """Of one block, the lists of a vocabulary's terms: list t is ``keys[edges[t]:edges[t + 1]]``, each t << 32 | position."""

    def __init__(self, block: dict, vocabulary: list[bytes]):
        where = {t: k for k, t in enumerate(block["terms"])}
        ends, gaps = block["ends"], np.frombuffer(block["positions"], "<u4")
        lists = []
        for t in vocabulary:
            k = where.get(t, -1)
            lists.append(np.cumsum(gaps[ends[k - 1] if k else 0 : ends[k]], dtype=np.int64) if k >= 0 else np.zeros(0, np.int64))
        self.counts = np.array([len(x) for x in lists], np.int64)
        self.edges = np.concatenate(([0], np.cumsum(self.counts)))
        self.keys = np.concatenate([x | (t << 32) for t, x in enumerate(lists)] or [np.zeros(0, np.int64)])

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        key = (terms.astype(np.int64) << 32) | positions
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key


def _anchors(lists: Postings, terms: np.ndarray, column: np.ndarray, alive: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the alive queries: query number and position of every posting of its term at the given column."""
    size = lists.counts[terms[alive, column]]
    cut = np.flatnonzero(np.diff(np.cumsum(size) // MOST, prepend=0)).tolist()
    for a, b in zip([0, *cut], [*cut, len(alive)], strict=True):
        if a < b:
            q, n = alive[a:b], size[a:b]
            who = np.repeat(q, n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield who, lists.keys[lists.edges[terms[q, column[a:b]]].repeat(n) + offset] & 0xFFFFFFFF


def _rarest(lists: Postings, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Queries all of whose terms occur in the block, and for each query its columns from the rarest term to the commonest."""
    count = np.where(phrases.terms >= 0, lists.counts[phrases.terms], np.iinfo(np.int64).max)
    return np.flatnonzero(count.min(axis=1, initial=1) > 0), np.argsort(count, axis=1, kind="stable")


def phrase_starts(lists: Postings, phrases: Phrases, limits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query, start, size) of every exact occurrence that lies in one document; limits: where documents begin, and the end."""
    alive, columns = _rarest(lists, phrases)
    out = [(np.zeros(0, np.int64),) * 3]
    for who, at in _anchors(lists, phrases.terms, columns[alive, 0], alive):
        start = at - columns[who, 0]
        for step in range(1, phrases.terms.shape[1]):
            column = columns[who, step]
            term = phrases.terms[who, column]
            ok = (term < 0) | lists.has(np.maximum(term, 0), np.maximum(start + column, 0)) & (start >= 0)
            who, start = who[ok], start[ok]
        last = start + phrases.sizes[who] - 1
        ok = (start >= 0) & (np.searchsorted(limits, start, "right") == np.searchsorted(limits, last, "right"))
        out.append((who[ok], start[ok], phrases.sizes[who[ok]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near_places(lists: Postings, phrases: Phrases, limits: np.ndarray, slop: int) -> tuple[np.ndarray, ...]:
    """(query, start, size) where every term of the query stands within slop words of its place in a phrase that begins at start.

    Starts are tried around the postings of the rarest term; the lists of the others are intersected with that tolerance.
    All terms are in the document of the start, which may lie up to slop words before its first or behind its last word.
    Neighbouring equal terms of a query may be met by one word.
    """
    alive, columns = _rarest(lists, phrases)
    out = [(np.zeros(0, np.int64),) * 3]
    shift = np.arange(-slop, slop + 1)
    for who, at in _anchors(lists, phrases.terms, columns[alive, 0], alive):
        doc = np.searchsorted(limits, at, "right")
        start = ((at - columns[who, 0])[:, None] + shift).ravel()
        who, doc = np.repeat(who, len(shift)), np.repeat(doc, len(shift))
        for step in range(1, phrases.terms.shape[1]):
            term = phrases.terms[who, columns[who, step]].astype(np.int64)
            place = start + columns[who, step]
            low, high = np.maximum(place - slop, limits[doc - 1]), np.minimum(place + slop, limits[doc] - 1)
            t = np.maximum(term, 0) << 32
            ok = (term < 0) | (low <= high) & (np.searchsorted(lists.keys, t | np.maximum(low, 0)) < np.searchsorted(lists.keys, t | np.maximum(high, 0), "right"))
            who, start, doc = who[ok], start[ok], doc[ok]
        size = np.minimum(phrases.sizes[who], limits[doc] - limits[doc - 1])  # the span is moved into its document
        start = np.clip(start, limits[doc - 1], limits[doc] - size)
        out.append(tuple(np.unique(np.stack([who, start, size], axis=1), axis=0).T))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _items(limits: np.ndarray, phrases: Phrases, who: np.ndarray, start: np.ndarray) -> list[list[int]]:
    """For each document of a block the ids of the items that have a match that starts in it."""
    out = [[] for _ in limits[1:]]
    for k, i in np.unique(np.stack([np.searchsorted(limits, start, "right") - 1, phrases.items[who]], axis=1), axis=0).tolist():
        out[k].append(i)
    return out


def _spans(limits: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[list[dict]]:
    """For each document of a block the merged spans of matches."""
    cover = np.zeros(limits[-1] + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + size, -1)
    inside = (np.cumsum(cover) > 0).astype(np.int8)
    edge = np.diff(inside[:-1], prepend=0, append=0)
    out = [[] for _ in limits[1:]]
    for b, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        k = int(np.searchsorted(limits, b, "right")) - 1
        while b < e:  # a match at the end of a document and one at the next one's begin are one run
            stop = min(e, int(limits[k + 1]))
            if b < stop:
                out[k].append({"begin": b - int(limits[k]), "end": stop - int(limits[k])})
            b, k = stop, k + 1
    return out


def _pieces(item: int, text: str, width: int) -> Iterator[str]:
    """A text's words in pieces of about PIECE_BYTES that hold all its windows, each once; a shorter text is one piece."""
    w, held, size = words(text), 0, 0
    for k, x in enumerate(w):
        size += len(x) + 1
        if size >= PIECE_BYTES and k - held + 1 >= width and k + 1 < len(w):
            yield b" ".join(w[held : k + 1]).decode("utf-8", "surrogatepass")
            held, size = k + 2 - width, 0
    if w:
        yield b" ".join(w[held:]).decode("utf-8", "surrogatepass")


def _query_table(queries: DataFrame, key: str, text: str, width: int | None, chunk_bytes: int) -> tuple[DataFrame, int]:
    """The stored pieces (item, text, chunk) of the query set and the number of chunks. Without a width items stay whole."""
    rows = queries.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in (_pieces(i, t, width) if width else [t])]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([p for _, p in out], pa.string())], names=["item", "text"])

    rows = stored(rows.mapInArrow(cut, "item long, text string").distinct())
    n = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) / chunk_bytes))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n


def _searched(index: DataFrame, chunk: list[Row], exact: bool, slop: int | None, width: int | None, key: str, every: bool) -> tuple[DataFrame, Broadcast]:
    """HITS of a chunk; of documents without a match only if ``every``."""
    rows = [w for r in chunk for w in (windows(r.item, r.text, width) if width else whole(r.item, r.text))]
    sent = index.sparkSession.sparkContext.broadcast(Phrases(rows, width or max((len(w) for _, w in rows), default=1)))
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    none = (np.zeros(0, np.int64),) * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            items = pa.list_(pa.int64())
            arrow = pa.schema([("block", pa.int64()), ("ord", pa.int32()), (key, batch.schema.field("ids").type.value_type), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("items", items), ("near_items", items)])
            for k in range(batch.num_rows):
                block = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                limits = np.concatenate(([0], np.cumsum(np.array(block["n_words"], np.int64))))
                lists = Postings(block, p.vocabulary)
                some = len(lists.keys) > 0
                same = phrase_starts(lists, p, limits) if exact and some else none
                close = near_places(lists, p, limits, slop) if slop is not None and some else none
                main = same if exact else close
                found = zip(block["ids"], block["n_words"], _spans(limits, *main[1:]), _items(limits, p, *main[:2]), _items(limits, p, *close[:2]), strict=True)
                rows = [{"block": block["block"], "ord": o, key: i, "n_words": n, "spans": s, "items": a, "near_items": b} for o, (i, n, s, a, b) in enumerate(found) if every or a or b]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return index.mapInArrow(run, HITS.format(key=key, id=id_type)), sent


def search(index: DataFrame, queries: DataFrame, exact: bool = True, slop: int | None = None, width: int | None = WIDTH, out: str = "doc_id", key: str = "item_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """HITS: a row for each indexed document, with or without matches; its key is named ``out``.

    Queries are the windows of ``width`` words of the items, an item of fewer words is one; without a width whole items.
    Items with a null id or text, or without words, match nothing. spans and items are those of exact occurrences (of near
    ones if not ``exact``), near_items the items that a window of stands within ``slop`` words, none without a slop.
    """
    reachable(index.sparkSession)
    pieces, n = _query_table(queries, key, text, width, chunk_bytes)
    if n == 1:
        return _searched(index, pieces.collect(), exact, slop, width, out, True)[0]  # at most chunk_bytes
    parts = None
    for k in range(n):
        rows, sent = _searched(index, pieces.where(F.col("chunk") == k).collect(), exact, slop, width, out, False)
        rows = stored(rows.select("block", "ord", "spans", "items", "near_items"))
        sent.destroy()
        parts = rows if parts is None else parts.unionByName(rows)
    all_of = lambda c: F.flatten(F.collect_list(c))
    united = parts.groupBy("block", "ord").agg(all_of("spans").alias("spans"), *(F.array_distinct(all_of(c)).alias(c) for c in ("items", "near_items")))
    docs = index.select("block", F.posexplode(F.arrays_zip("ids", "n_words")).alias("ord", "_doc"))
    rows = docs.join(united, ["block", "ord"], "left")
    found = [F.coalesce(c, F.array().cast(parts.schema[c].dataType)).alias(c) for c in ("spans", "items", "near_items")]
    return rows.select("block", "ord", F.col("_doc.ids").alias(out), F.col("_doc.n_words").cast("long").alias("n_words"), *found)


def phrases(index: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """``search`` for exact occurrences alone."""
    return search(index, queries, **options).drop("near_items")


def near(index: DataFrame, queries: DataFrame, slop: int, width: int | None = None, **options) -> DataFrame:
    """``search`` for near occurrences alone, of whole items if no width is given."""
    return search(index, queries, False, slop, width, **options).drop("near_items")


def n_hit(spans: str = "spans") -> Column:
    """Words inside the union of spans, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))

    def add(acc: Column, s: Column) -> Column:
        end = s["end"].cast("long")
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(s["begin"].cast("long"), acc["reach"]))).alias("n"),
            F.greatest(acc["reach"], end).alias("reach"),
        )

    return F.aggregate(F.array_sort(spans), start, add)["n"]


def contamination(hits: DataFrame, out: str = "doc_id") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (a hit, and 5 % of the words or more).

    If hits has near_items, n_near too: how many items they are.
    """
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.withColumn("n_hit", n_hit()).select(
        out,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *([F.size("near_items").cast("long").alias("n_near")] if "near_items" in hits.columns else []),
    )
