"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query of the trigrams that any match must hold. Documents are
indexed in blocks: a block has, for every trigram that some rule asks for, the sorted list of its documents that hold it.
A rule's query is answered by intersecting and uniting those lists, and its expression runs over the candidates only.
A rule that has no mandatory trigram (a run of hex digits) is run over every document of the block. A block's documents
never leave their task, so nothing is shuffled and the index of a block is dropped once it has been asked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import reachable

MANY = 64
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A match counts if group ``group`` of it has at least ``least`` bytes."""

    kind: str
    pattern: bytes
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", rb"[0-9a-f]{16,}", 0, 16),  # maximal runs either way, so the bound may stand in the expression
)
# A key's block goes from its first line to its last; without a last line, on to the end of its lines of base64.
_GAP = rb"(?:\s|\\[nr])*+"
_KEY = rb"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:" + _GAP + rb"(?:[A-Za-z0-9+/=]{20,}+|[A-Z][A-Za-z-]++: [^\r\n\\]++))*+"
EXTRA = (
    Rule("pem", _KEY + rb"(?:" + _GAP + rb"[A-Za-z0-9+/=]{0,76}+" + _GAP + rb"-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----)?"),
    Rule("forge", rb"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", rb"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("maps", rb"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", rb"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("mail", rb"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("package", rb"(?:npm_[A-Za-z0-9]{36,}|pypi-[A-Za-z0-9_-]{50,})"),
    Rule("hook", rb"https://hooks\.[a-z.]{4,40}/services/[A-Za-z0-9/_+-]{20,}"),
    Rule("login", rb"://[^\s:/@]{1,64}:([^\s:/@]{6,128})@", 1, 6),
)

# A query is None (any document), a trigram, or ("and" | "or", queries).


def both(a, b):
    return b if a is None else a if b is None else ("and", (a, b))


def either(parts):
    return None if any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def of_string(s: bytes):
    return reduce(both, [s[i : i + 3] for i in range(len(s) - 2)], None)


def trigram_query(pattern: bytes):
    """The query, in lower-case trigrams, that every text with a match of pattern satisfies; None if there is none."""
    ends, query, _ = _walk(_parser.parse(pattern))
    return both(query, either([of_string(s) for s in sorted(ends)]))


def _walk(items) -> tuple[set[bytes], object, bool]:
    """The strings, all of them, that the items may end with since the last open place; the query of what was before.

    Last, whether there was no open place, so that the strings are all that the items may match.
    """
    now, query, exact = {b""}, None, True

    def close():
        nonlocal now, query, exact
        query, now, exact = both(query, either([of_string(s) for s in sorted(now)])), {b""}, False

    def follow(strings: set[bytes]):
        nonlocal now
        if len(now) * len(strings) > MANY:
            close()
        if len(strings) <= MANY:
            now = {a + b for a in now for b in strings}

    for op, arg in items:
        if op is C.LITERAL:
            follow({bytes([arg]).lower()})
        elif op is C.IN:
            chars = _chars(arg)
            follow(chars) if chars else close()
        elif op is C.SUBPATTERN or op is C.BRANCH:
            parts = [_walk(x) for x in (arg[1] if op is C.BRANCH else [arg[-1]])]
            if all(whole for _, _, whole in parts):
                follow(set().union(*(s for s, _, _ in parts)))
            else:
                close()
                query = both(query, either([both(q, either([of_string(x) for x in sorted(s)])) for s, q, _ in parts]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            strings, q, whole = _walk(inner)
            if whole and high == 1:
                follow(strings | {b""} if low == 0 else strings)
            else:
                if whole and low and len(strings) ** min(low, 4) <= MANY:
                    for _ in range(min(low, 4)):
                        follow(strings)
                close()
                query = both(query, both(q, either([of_string(x) for x in sorted(strings)]))) if low else query
        elif op is not C.AT:
            close()
    return now, query, exact


def _chars(arg) -> set[bytes] | None:
    """The characters of a class in lower case, if they are few."""
    out: set[bytes] = set()
    for op, x in arg:
        if op is C.LITERAL:
            out.add(bytes([x]).lower())
        elif op is C.RANGE and x[1] - x[0] < 4:
            out |= {bytes([c]).lower() for c in range(x[0], x[1] + 1)}
        else:
            return None
    return out if 0 < len(out) <= 8 else None


def trigrams(query) -> set[bytes]:
    return set() if query is None else {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class Index:
    """Postings of a block of texts: for each wanted trigram the sorted numbers of the texts that hold it, case folded."""

    def __init__(self, texts: list[bytes], wanted: list[bytes]):
        slot = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        slot[[int.from_bytes(t, "big") for t in wanted]] = np.arange(1, len(wanted) + 1)
        flat = np.frombuffer(b"\0\0".join(texts).lower() + b"\0\0", np.uint8)
        begins = np.cumsum([0, *(len(t) + 2 for t in texts)])
        code = flat[:-2].astype(np.int32) << 16
        code |= flat[1:-1].astype(np.int32) << 8
        code |= flat[2:]
        found = slot[code]
        at = np.flatnonzero(found)
        pairs = np.unique((found[at].astype(np.int64) << 32) | (np.searchsorted(begins, at, "right") - 1))
        edges = np.searchsorted(pairs, np.arange(1, len(wanted) + 2) << 32)
        self.n = len(texts)
        self.postings = {t: pairs[edges[i] : edges[i + 1]] & 0xFFFFFFFF for i, t in enumerate(wanted)}

    def ask(self, query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        join = np.intersect1d if query[0] == "and" else np.union1d
        return reduce(join, (self.ask(x) for x in query[1]))


def scan(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """The columns ``keep`` and ``found``: array of (kind, start, end) in code points, end exclusive.

    Sorted by start, then by the rules' order. Matches of one rule don't overlap; those of several may. A null or empty
    text has none. Equal rows stay equal rows. Texts of any length are searched whole; a text longer than a block is a
    block of its own.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    reachable(docs.sparkSession)
    at = docs.select(*keep, F.col("text").alias("_text"))
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    found = F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>")
    schema = at.drop("_text").withColumn("found", found).schema

    def block(texts: list[bytes]) -> list[list[tuple]]:
        index, out = Index(texts, wanted), [[] for _ in texts]
        for order, (rule, query) in enumerate(zip(rules, queries, strict=True)):
            search = re.compile(rule.pattern).finditer
            for k in index.ask(query):
                for m in search(texts[k]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[k].append((m.start(), order, m.end()))
        for k, spans in enumerate(out):
            if spans and not texts[k].isascii():
                points = {x: len(texts[k][:x].decode("utf-8", "surrogatepass")) for s, _, e in spans for x in (s, e)}
                spans[:] = [(points[s], o, points[e]) for s, o, e in spans]
            spans.sort()
        return [[{"kind": rules[o].kind, "start": s, "end": e} for s, o, e in spans] for spans in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column("_text")]
            held, size, out = [], 0, []
            for t in texts:
                held.append(t)
                size += len(t)
                if size >= BLOCK_BYTES:
                    out += block(held)
                    held, size = [], 0
            out += block(held) if held else []
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.list_(kind))], names=[*keep, "found"])

    return at.mapInArrow(run, schema)
