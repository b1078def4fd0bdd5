"""Removal of long byte strings that repeat across documents, by buckets of q-grams whose pointers are refined.

A suffix array by bucket-pointer refinement starts from buckets of equal q-grams and sorts a bucket's suffixes on the
bucket numbers at later offsets; the new numbers serve the next sort. Only as much of it is done as strings of LENGTH
bytes need, and only where two documents may share one:

1. *Anchors.* A window of LENGTH bytes is anchored at the least of its q-grams of GRAM bytes, the leftmost of equals. Its
   content alone decides that, so equal windows have equal anchors at equal offsets.
2. *Initial buckets.* A window holds the HALF bytes before its anchor or the HALF bytes after it. With the anchor they
   are a q-gram of Q bytes, the window's initial bucket. Buckets that only one document enters hold no repeat and go.
3. *Refinement.* What is left goes to its bucket as the bytes around the anchor. There, strings of 4 bytes are numbered
   in sorted order at every offset; then strings of twice the length, by sorting on the pair of numbers at an offset and
   at the offset where the first ends, up to LENGTH. Numbers come from sorted bytes, so equality is exact. Of windows
   with one number all but the smallest document's are covered.

Hashes only pick anchors and deal buckets. Exact copies are settled first, by their 128-bit digest. Texts are dealt into
cells of about CELL bytes by id in one shuffle that all steps share, and there are as many buckets as cells, so groups
stay of that size whatever the corpus. What a cell sends is aggregated: a q-gram once, and equal surroundings once, for
their smallest document. A bucket that more than HOT windows of the corpus enter is split on all LENGTH bytes, so it
gets a window at most once from each cell.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import partitions, reachable

LENGTH = 50
GRAM = 16
SIDE = LENGTH - GRAM  # bytes beside an anchor that a window with it may reach
HALF = SIDE // 2  # a window that begins HALF bytes or more before its anchor holds those, else HALF bytes after it
Q = GRAM + HALF
AROUND = LENGTH + SIDE
CELL = 8 << 20
PIECE = 1 << 20
HOT = 1 << 14
SHORT = 5  # bytes of a key that are sent to find out whether it is shared
BITS = 21  # of a place in one sort, and of a bucket number
PACKET = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tid", "<u8"), ("pos", "<i4"), ("lo", "u1"), ("hi", "u1"), ("bytes", "u1", (AROUND,))])
MASK = np.dtype([("doc", "<i8"), ("tid", "<u8"), ("pos", "<i4"), ("like", "<i4"), ("mask", "<u8")])
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_ROWS = pa.schema([("bucket", pa.int32()), ("cell", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
ROWS = "bucket int, cell int, kind int, data binary"
COPIES, SHARED, COVERED, PACKETS = range(4)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K[0]
    x ^= x >> np.uint64(29)
    x += b
    x *= _K[1]
    x ^= x >> np.uint64(32)
    x *= _K[2]
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes at every place; raw has GRAM bytes or more."""
    word = np.ndarray((len(raw) - 7,), "<u8", raw.data, 0, (1,)).copy()
    return mixed(word[: len(raw) - GRAM + 1], word[8 : len(raw) - GRAM + 9])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] if c.ndim == 1 else (c[1:] != c[:-1]).any(axis=1) for c in columns], axis=0)
    return np.flatnonzero(new)


class Piece:
    """Stretches of texts, joined: whole texts, or parts of PIECE window starts each of a long one."""

    def __init__(self, held: list[tuple[int, int, int, bytes]]):
        size = np.array([len(x) for *_, x in held], np.int64)
        self.ends = np.cumsum(size)
        self.begins = self.ends - size
        self.doc, self.tid, self.offset = (np.array(c, t) for c, t in zip(list(zip(*held, strict=True))[:3], (np.int64, np.uint64, np.int64), strict=True))
        self.raw = np.frombuffer(b"".join(x for *_, x in held), np.uint8)

    def anchors(self) -> tuple[np.ndarray, ...]:
        """For every anchor and half: its place, bucket key, and the windows lo to hi, counted by their start before the anchor."""
        h = gram_hashes(self.raw)
        key = (h & np.uint64(0xFFFFFFFF << 32)) | np.arange(len(h), dtype=np.uint64)
        of = (_least(key, SIDE + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(len(self.raw) + 1, np.int8)
        inside[self.begins] += 1
        inside[self.ends - LENGTH + 1] -= 1
        start = np.flatnonzero(np.cumsum(inside[: len(of)], dtype=np.int8))
        of = of[start]
        first = _firsts(of)
        place, hi, lo = of[first], of[first] - start[first], of[first] - start[np.append(first[1:], len(start)) - 1]
        left, right = np.flatnonzero(hi >= HALF), np.flatnonzero(lo < HALF)
        a, b = place[left], place[right]
        beside = self.raw.astype(np.uint64)
        keys = mixed(mixed(h[a - HALF], h[a]), beside[a - 1]), mixed(mixed(h[b], h[b + GRAM]), beside[b + Q - 1] | np.uint64(256))
        lows, highs = (np.maximum(lo[left], HALF), lo[right]), (hi[left], np.minimum(hi[right], HALF - 1))
        return tuple(np.concatenate(x) for x in ((a, b), keys, lows, highs))

    def row(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, place, "right") - 1

    def packets(self, place: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out, k = np.zeros(len(place), PACKET), self.row(place)
        out["key"], out["doc"], out["tid"], out["pos"] = key, self.doc[k], self.tid[k], place - self.begins[k] + self.offset[k]
        out["lo"], out["hi"] = lo, hi
        edge = np.zeros(SIDE, np.uint8)
        out["bytes"] = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, self.raw, edge]), AROUND)[place]
        return _cleared(out)


def _cleared(packets: np.ndarray) -> np.ndarray:
    """packets with the bytes zero that none of their windows holds."""
    at = np.arange(AROUND)
    packets["bytes"][(at < SIDE - packets["hi"][:, None].astype(int)) | (at >= AROUND - packets["lo"][:, None].astype(int))] = 0
    return packets


def pieces(texts: list[tuple[int, int, bytes]]) -> Iterator[Piece]:
    """(id, text id, bytes) in pieces of about PIECE bytes. A text of fewer than LENGTH bytes has no window."""
    held, size = [], 0
    for doc, tid, x in texts:
        for a in range(0, len(x) - LENGTH + 1, PIECE):
            held.append((doc, tid, a, x[a : a + PIECE + LENGTH - 1]))
            size += len(held[-1][3])
            if size >= PIECE:
                yield Piece(held)
                held, size = [], 0
    if held:
        yield Piece(held)


def _words(packets: np.ndarray) -> np.ndarray:
    whole = np.zeros((len(packets), 88), np.uint8)
    whole[:, :AROUND], whole[:, AROUND], whole[:, AROUND + 1] = packets["bytes"], packets["lo"], packets["hi"]
    return whole.view("<u8")


def _content(packets: np.ndarray) -> np.ndarray:
    words, x = _words(packets), np.zeros(len(packets), np.uint64)
    for j in range(words.shape[1]):
        x = mixed(x, words[:, j])
    return x


def _bits(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    return (one << (hi.astype(np.uint64) + one)) - (one << lo.astype(np.uint64))


def _marks(packets: np.ndarray, like: np.ndarray | int) -> np.ndarray:
    out = np.zeros(len(packets), MASK)
    for c in ("doc", "tid", "pos"):
        out[c] = packets[c]
    out["like"], out["mask"] = like, _bits(packets["lo"], packets["hi"])
    return out


def distinct(packets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal packets, those of the smallest document, one for each text; and MASK rows that settle the others.

    Another document's are covered; another place of the same text fares like the first (``like``).
    """
    x = _content(packets)
    order = np.lexsort((packets["tid"], packets["doc"], x))
    packets = packets[order]
    first = _firsts(_words(packets))
    lead = np.repeat(first, np.diff(np.append(first, len(packets))))
    own = packets["doc"] == packets["doc"][lead]
    text = _firsts(lead, packets["doc"], packets["tid"])
    kept = np.zeros(len(packets), bool)
    kept[text] = True
    top = np.repeat(text, np.diff(np.append(text, len(packets))))
    again = own & ~kept
    marks = [_marks(packets[~own], -1), _marks(packets[again], packets["pos"][top[again]])]
    return packets[own & kept], np.concatenate(marks)


def by_window(packets: np.ndarray) -> np.ndarray:
    """A packet for each window of the given ones, in the bucket of all its bytes."""
    n = packets["hi"].astype(np.int64) - packets["lo"] + 1
    out = np.repeat(packets, n)
    out["lo"] += (np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint8)
    out["hi"] = out["lo"]
    out = _cleared(out)
    out["key"] = _content(out)
    return out


def _ranked(key: np.ndarray) -> np.ndarray:
    """Numbers of keys of at most 43 bits in sorted order, equal for equal keys; at most 2 ** BITS keys."""
    low = np.uint64((1 << BITS) - 1)
    both = np.sort((key << np.uint64(BITS)) | np.arange(len(key), dtype=np.uint64))
    at, key = (both & low).astype(np.int64), both >> np.uint64(BITS)
    out = np.empty(len(at), np.uint64)
    out[at] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))).astype(np.uint64)
    return out


def refined(packets: np.ndarray) -> np.ndarray:
    """For each packet, a bit for each window before its anchor that is also in a packet of a smaller document.

    Bucket numbers of 4 bytes are refined to 8, 16, 32 and LENGTH bytes by sorting on the numbers at later offsets.
    """
    n, out = len(packets), np.zeros(len(packets), np.uint64)
    begin, end = SIDE - packets["hi"].astype(np.int64), AROUND - packets["lo"].astype(np.int64)
    depth = 4
    size = end - begin - depth + 1
    row = np.repeat(np.arange(n), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + begin[row]
    raw = np.concatenate([np.ascontiguousarray(packets["bytes"]).ravel(), np.zeros(depth, np.uint8)])
    flat = row * AROUND + at
    number = np.zeros(n * AROUND, np.uint64)
    number[flat] = _ranked(np.ndarray((n * AROUND,), "<u4", raw.data, 0, (1,))[flat].astype(np.uint64))
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        depth += step
        whole = at + depth <= end[row]
        row, at, flat = row[whole], at[whole], flat[whole]
        number[flat] = _ranked((number[flat] << np.uint64(BITS)) | number[flat + step])
    rank = number[flat].astype(np.int64)
    doc = np.unique(packets["doc"], return_inverse=True)[1]
    least = np.full(len(rank) + 1, len(doc), np.int64)
    np.minimum.at(least, rank, doc[row])
    hit = doc[row] > least[rank]
    np.bitwise_or.at(out, row[hit], np.uint64(1) << (SIDE - at[hit]).astype(np.uint64))
    return out


def _slices(packets: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of whole buckets, as many as one sort takes; a bucket of single windows may be cut, its smallest document in each part."""
    most = (1 << BITS) // AROUND
    order = np.lexsort((packets["doc"], packets["key"]))
    key = packets["key"][order]
    edges = np.append(_firsts(key), len(key)) if len(key) else np.zeros(0, np.int64)
    a = 0
    while a < len(key):
        b = int(edges[np.searchsorted(edges, a + most, "right") - 1]) if a + most < len(key) else len(key)
        if b > a:
            yield order[a:b]
            a = b
            continue
        end = int(edges[np.searchsorted(edges, a, "right")])
        for c in range(a + 1, end, most - 1):
            yield np.concatenate((order[a : a + 1], order[c : min(end, c + most - 1)]))
        a = end


def _texts(left: pa.Table, right: pa.Table) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, int, bytes]]]:
    """(id, text id, bytes) of the rows that stand for their text, and of the other rows: copies of a smaller document's."""
    first = {(d, t) for d, t, k in zip(right["id"].to_pylist(), right["data"].to_pylist(), right["kind"].to_pylist(), strict=True) if k == COPIES}
    one, more = {}, []
    for d, t, x in zip(left["doc_id"].to_pylist(), left["digest"].to_pylist(), left["text"], strict=True):
        row = (d, int.from_bytes(t[:8], "little"), (x.as_py() or "").encode("utf-8", "surrogatepass"))
        if (d, t) in first:
            one.setdefault((d, t), []).append(row)
        else:
            more.append(row)
    return list(one.values()), more


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, _ROWS, strict=True)], schema=_ROWS)


def _split(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    first = _firsts(key[order])
    return ((int(key[i[0]]), i) for i in np.split(order, first[1:]) if len(i))


def _short(keys: np.ndarray) -> bytes:
    """The low SHORT bytes of each key; with the bucket they tell keys apart but for a few, which only costs a packet."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :SHORT]).tobytes()


def _long(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :SHORT] = np.frombuffer(data, np.uint8, n * SHORT).reshape(-1, SHORT)
    return out.view("<u8").ravel()


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(n)).astype(np.int32)


def _read(table: pa.Table, kind: int, of: np.dtype) -> np.ndarray:
    found = [np.frombuffer(x, of) for x, k in zip(table["data"].to_pylist(), table["kind"].to_pylist(), strict=True) if k == kind]
    return np.concatenate([np.zeros(0, of), *found])


def cells(docs: DataFrame) -> int:
    """As many cells as keep one at about CELL bytes, and at least as many as shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(docs.sparkSession), math.ceil(total / CELL))


def spans_removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (begin, end in bytes, maximal and in order) and kept_sha256 for every row of docs.

    A byte is removed if some LENGTH bytes that cover it also start in a document of a smaller id. Documents of one id
    don't count against each other, rows with a null id neither lose bytes nor cost others any, a null text is empty.
    Other columns of docs, whatever their names, are not read.
    """
    reachable(docs.sparkSession)
    n = cells(docs)
    text = F.coalesce("text", F.lit(""))
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumns({"digest": F.unhex(F.md5("text")), "cell": F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")})
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("id"))
    copies = least.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("cell"), F.lit(COPIES).alias("kind"), "id", F.col("digest").alias("data"))
    by_cell = rows.groupBy("cell")

    def gather(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Each bucket key of a cell once, with how often it occurs there and whether two documents have it."""
        keys, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for p in pieces([t[0] for t in _texts(left, right)[0]]):
            place, k, _, _ = p.anchors()
            keys.append(k)
            doc.append(p.doc[p.row(place)])
        keys, doc = np.concatenate(keys), np.concatenate(doc)
        order = np.argsort(keys)
        keys, doc = keys[order], doc[order]
        first = _firsts(keys)
        if not len(first):
            return _table([])
        many = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        count = np.ceil(np.log2(np.diff(np.append(first, len(keys))))).astype(np.uint8) | (many * np.uint8(128))
        keys, cell = keys[first], key[0].as_py()
        return _table([(b, cell, SHARED, _short(keys[i]) + count[i].tobytes()) for b, i in _split(_bucket(keys, n), n)])

    def shared(table: pa.Table) -> pa.Table:
        """Keys that two documents have, returned to each cell that sent them, with a bit for those above HOT."""
        size = [len(x) // (SHORT + 1) for x in table["data"].to_pylist()]
        cell = np.repeat(np.array(table["cell"].to_pylist(), np.int32), size)
        keys = np.concatenate([_long(x, s) for x, s in zip(table["data"].to_pylist(), size, strict=True)])
        count = np.concatenate([np.frombuffer(x, np.uint8, offset=SHORT * s) for x, s in zip(table["data"].to_pylist(), size, strict=True)])
        order = np.argsort(keys)
        keys, count, cell = keys[order], count[order], cell[order]
        first = _firsts(keys)
        senders = np.diff(np.append(first, len(keys)))
        keep = np.repeat((senders > 1) | (np.maximum.reduceat(count, first) > 127), senders)
        hot = np.repeat(np.add.reduceat(2.0 ** (count & 127), first) > HOT, senders)
        keys, hot, cell = keys[keep], hot[keep], cell[keep]
        return _table([(0, c, SHARED, _short(keys[i]) + np.packbits(hot[i]).tobytes()) for c, i in _split(cell, n)])

    def surroundings(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Packets of a cell's shared keys, the smallest document's of equal ones, to their buckets; others are settled."""
        keys, hot = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for x, k in zip(right["data"].to_pylist(), right["kind"].to_pylist(), strict=True):
            if k == SHARED:
                size = len(x) * 8 // (8 * SHORT + 1)  # SHORT bytes and a bit each
                keys.append(_long(x, size))
                hot.append(np.unpackbits(np.frombuffer(x, np.uint8, offset=SHORT * size), count=size).astype(bool))
        keys, hot = np.concatenate(keys), np.concatenate(hot)
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        low = np.uint64((1 << 8 * SHORT) - 1)
        sent, marks, cell = [np.zeros(0, PACKET)], [np.zeros(0, MASK)], key[0].as_py()
        for p in pieces([t[0] for t in _texts(left, right)[0]] if len(keys) else []):
            place, k, lo, hi = p.anchors()
            ok = keys[np.minimum(np.searchsorted(keys, k & low), len(keys) - 1)] == k & low
            one, rest = distinct(p.packets(place[ok], k[ok], lo[ok], hi[ok]))
            sent.append(one)
            marks.append(rest)
        one, rest = distinct(np.concatenate(sent))
        marks.append(rest)
        if hot.any():
            over = hot[np.searchsorted(keys, one["key"] & low)]
            windows, rest = distinct(by_window(one[over]))
            one = np.concatenate([one[~over], windows])
            marks.append(rest)
        marks = np.concatenate(marks)
        out = [(b, cell, PACKETS, one[i].tobytes()) for b, i in _split(_bucket(one["key"], n), n)]
        return _table(out + ([(cell, cell, COVERED, marks.tobytes())] if len(marks) else []))

    def settled(table: pa.Table) -> pa.Table:
        """Which windows of a bucket a smaller document has, returned to the cells of those that have not the smallest."""
        passed, cell, data = [], [], [np.zeros(0, PACKET)]
        for c, kind, x in zip(table["cell"].to_pylist(), table["kind"].to_pylist(), table["data"].to_pylist(), strict=True):
            if kind == COVERED:
                passed.append((0, c, COVERED, x))
            else:
                data.append(np.frombuffer(x, PACKET))
                cell.append(np.full(len(data[-1]), c, np.int32))
        rows = np.concatenate(data)
        if len(rows):
            marks, cell = _marks(rows, -1), np.concatenate(cell)
            marks["mask"] = 0
            for i in _slices(rows):
                marks["mask"][i] |= refined(rows[i])
            some = np.flatnonzero(marks["mask"])
            passed += [(0, c, COVERED, marks[some[i]].tobytes()) for c, i in _split(cell[some], n)]
        return _table(passed)

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        one, more = _texts(left, right)
        marks = _read(right, COVERED, MASK)
        marks = marks[np.lexsort((marks["tid"], marks["doc"]))]
        edges = np.append(_firsts(marks["doc"], marks["tid"]), len(marks)) if len(marks) else np.zeros(1, np.int64)
        where = {(int(marks["doc"][a]), int(marks["tid"][a])): slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)}
        out = []
        for same in one:
            d, i, t = same[0]
            spans, digest = _kept(t, marks[where[d, i]] if (d, i) in where else marks[:0])
            out += [(d, len(t), spans, digest)] * len(same)
        out += [(d, len(t), *_whole(t)) for d, _, t in more]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, _RESULT, strict=True)], schema=_RESULT)

    tidy = lambda df: df.select("cell", "kind", F.lit(0).cast("long").alias("id"), "data")
    keys = by_cell.cogroup(copies.groupBy("cell")).applyInArrow(gather, ROWS)
    common = keys.groupBy("bucket").applyInArrow(shared, ROWS)
    around = by_cell.cogroup(copies.unionByName(tidy(common)).groupBy("cell")).applyInArrow(surroundings, ROWS)
    marks = around.groupBy("bucket").applyInArrow(settled, ROWS)
    result = by_cell.cogroup(copies.unionByName(tidy(marks)).groupBy("cell")).applyInArrow(cut, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept_sha256 string")
    free = docs.where("doc_id IS NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.array().cast("array<struct<begin:long,end:long>>").alias("spans"),
        F.sha2(text, 256).alias("kept_sha256"),
    )
    return result.unionByName(free)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())])


def _resolved(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and masks of one text, those that fare like another place included; such references are followed to their end."""
    alike, known = marks[marks["like"] >= 0], marks[marks["like"] < 0]
    pos, mask = known["pos"], known["mask"]
    new = known
    while len(alike) and len(new):
        new = new[np.argsort(new["pos"], kind="stable")]
        low, high = (np.searchsorted(new["pos"], alike["like"], side) for side in ("left", "right"))
        n = high - low
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        got = np.repeat(alike, n)
        got["mask"] &= new["mask"][at]
        new = got[got["mask"] > 0]
        pos, mask = np.concatenate((pos, new["pos"])), np.concatenate((mask, new["mask"]))
    return pos, mask


def _kept(text: bytes, marks: np.ndarray) -> tuple[list[dict], str]:
    if not len(marks):
        return [], hashlib.sha256(text).hexdigest()
    pos, mask = _resolved(marks)
    x, cover = np.arange(SIDE + 1), np.zeros(len(text) + 1, np.int32)
    for a in range(0, len(pos), PIECE // LENGTH):
        part = slice(a, a + PIECE // LENGTH)
        start = (pos[part, None] - x)[(mask[part, None] >> x.astype(np.uint64)) & np.uint64(1) > 0]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + LENGTH, -1)
    gone = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return [{"begin": b, "end": e} for b, e in zip(edge[::2], edge[1::2], strict=True)], hashlib.sha256(kept).hexdigest()


def _whole(text: bytes) -> tuple[list[dict], str]:
    """Of a copy of a smaller document's text."""
    if len(text) < LENGTH:
        return [], hashlib.sha256(text).hexdigest()
    return [{"begin": 0, "end": len(text)}], hashlib.sha256(b"").hexdigest()
