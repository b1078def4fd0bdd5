"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text the encoding's last token is unique: it is the one token that ends the prefix and
goes together with the last token of the prefix before it. A suffix automaton of the vocabulary is at each place in the
state of the longest string that ends there and lies in a token; going up its suffix links from there gives the tokens
that end there. A test of the pair decides; the winner is stored, and following the stored tokens back from the end gives
the ids. No merge is ever carried out.

Two tokens go together if merging never crosses the border between them. That is decided by their histories: the pieces
that touch the border from the left are the right edges of the left token's merge tree, from the right the left edges of
the other's. A merge of two such pieces happens if its rank comes before the merges that would consume either piece.

Texts are split as the tokenizers library splits them. The split is made in two steps: first, fast, after each run of
white space and what follows it, then, once for each different part, by the full pattern. Ids of parts are remembered by
the worker in a bounded table.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import reachable

# The pattern that byte-level BPE splits by, and Unicode's white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD_SPACES = "\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = f" \n{ODD_SPACES}"

REMEMBERED = 1_000_000
LONG = 64


class Remembered(dict):
    """Results of a function for short strings, all forgotten when they become too many."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key: str) -> bytes:
        got = self.of(key)
        if len(key) <= LONG:
            self[key] = got
        return got

    def bounded(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if it is printable in Latin-1, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class SuffixAutomaton:
    """All substrings of a set of byte strings: of each state the longest string's length, its suffix link and its moves.

    A string of the set is the longest of its state, as it stands somewhere with nothing before it.
    """

    def __init__(self, words: dict[bytes, int]):
        self.length, self.link, self.moves = array("i", [0]), array("i", [-1]), [{}]
        ends = array("i", [self._added(w) for w in words])
        token = array("i", [-1]) * len(self.length)
        for state, i in zip(ends, words.values(), strict=True):
            token[state] = i
        self.token = token
        self.up = array("i", [0]) * len(token)  # the nearest state above that ends a string of the set; 0 if there is none
        for state in sorted(range(1, len(token)), key=self.length.__getitem__):
            above = self.link[state]
            self.up[state] = above if token[above] >= 0 else self.up[above]

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.moves.append(moves)
        return len(self.moves) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the strings of q no longer than the move from p by c makes them; split off from q if q has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], self.moves[q].copy())
        self.link[q] = clone
        while p >= 0 and self.moves[p].get(c) == q:
            self.moves[p][c] = clone
            p = self.link[p]
        return clone

    def _added(self, word: bytes) -> int:
        """Adds a string and all its substrings; returns its state."""
        last = 0
        for c in word:
            q = self.moves[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
                continue
            new, p = self._new(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.moves[p]:
                self.moves[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c, self.moves[p][c])
            last = new
        return last

    def matches(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(end, string's value, its length) of every place where a string of the set stands, longer ones first at each end."""
        state, size, moves, length, link, token, up = 0, 0, self.moves, self.length, self.link, self.token, self.up
        for end, c in enumerate(text, 1):
            to = moves[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = moves[state].get(c)
            if to is None:
                continue
            state, size = to, size + 1
            at = state if size == length[state] and token[state] >= 0 else up[state]
            while at:
                yield end, token[at], length[at]
                at = up[at]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        for t, i in special.items():
            self.bytes[i] = t.encode()
        self.special = special
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.part = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self.uneven = re.compile(f"[ \\n][ \\n]|[{ODD_SPACES}]")
        self.piece = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))
        self.merge: dict[int, int] = {}  # left << 32 | right -> rank
        self.born: dict[int, tuple[int, int, int]] = {}  # token -> rank, left half, right half
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge[vocab[a] << 32 | vocab[b]] = rank
            self.born.setdefault(vocab[a + b], (rank, vocab[a], vocab[b]))
        self.edges: dict[int, list[tuple[int, float]]] = {}
        self.goes: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}
        tokens = sorted({i for t, i in vocab.items() if t not in special})
        self.token: dict[bytes, int] = {self.bytes[i]: i for i in tokens if self.whole(i)}
        self.automaton = SuffixAutomaton(self.token)
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = Remembered(self.encode_part)
        self.spaced: dict[str, bytes] = Remembered(lambda s: self.encode_part(s if s[0] == "\n" else " " + s))

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces on a token's left (0) or right (1) edge, smallest first, each with the rank of the merge that consumes it."""
        key = token << 1 | side
        if key not in self.edges:
            out, piece, until = [], token, float("inf")
            while True:
                out.append((piece, until))
                if piece not in self.born:
                    break
                until = self.born[piece][0]
                piece = self.born[piece][1 + side]
            self.edges[key] = out[::-1]
        return self.edges[key]

    def crossed(self, a: int, b: int, but: int = -1) -> bool:
        """Whether some merge joins an edge piece of a with one of b while both are there.

        Pieces are visited in the order of time. At equal ranks the left one of two merges is first.
        """
        left, right, i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            m = self.merge.get(x << 32 | y)
            if m is not None and m < x_until and m <= y_until and (x << 32 | y) != but:
                return True
            if i + 1 == len(left) and j + 1 == len(right):
                return False
            if j + 1 == len(right) or (i + 1 < len(left) and x_until <= y_until):
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes encode to it: its halves do, and nothing crosses their border before they merge."""
        if token not in self.sound:
            if token not in self.born:
                self.sound[token] = len(self.bytes[token]) == 1
            else:
                _, a, b = self.born[token]
                self.sound[token] = self.whole(a) and self.whole(b) and not self.crossed(a, b, a << 32 | b)
        return self.sound[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        if piece in self.token:
            return [self.token[piece]]
        last, before, goes = [-1] * (n + 1), [0] * (n + 1), self.goes
        for end, token, size in self.automaton.matches(piece):
            if last[end] < 0:
                start = end - size
                if start:
                    prev = last[start]
                    key = prev << 32 | token
                    ok = goes.get(key)
                    if ok is None:
                        ok = goes[key] = prev >= 0 and not self.crossed(prev, token)
                    if not ok:
                        continue
                last[end], before[end] = token, start
        out, k = [], n
        while k > 0:
            out.append(last[k])
            k = before[k]
        return out[::-1]

    def encode_part(self, part: str) -> bytes:
        out = []
        for p in self.piece.findall(part):
            got = self.pieces.get(p)
            if got is None:
                got = np.array(self.encode_piece(p.encode("utf-8")), "<u4").tobytes()
                if len(p) <= LONG:
                    self.pieces[p] = got
            out.append(got)
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        if len(self.goes) > 4 * REMEMBERED:
            self.goes.clear()
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; strings of special tokens become their ids. Null has none.

        Where white space is single spaces and line feeds, a plain split finds the parts; else an expression does.
        """
        if not text:
            return b""
        out = []
        for k, s in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if k % 2:
                out.append(np.array([self.special[s]], "<u4").tobytes())
            elif self.uneven.search(s) or not s or s[0] == " " or s[-1] == " ":
                out += map(self.parts.__getitem__, self.part.findall(s))
            else:
                first, *rest = s.replace("\n", " \n").split(" ")
                out.append(self.parts[first] if first else b"")
                out += map(self.spaced.__getitem__, rest)
        self.parts.bounded()
        self.spaced.bounded()
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Text in UTF-8; bytes that are not UTF-8 become U+FFFD."""
        raw = b"".join([self.bytes[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw.decode("utf-8", "replace").encode("utf-8")


@cache
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encoded(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and ``ids``: the token ids of column text. Null and empty texts have none."""
    reachable(docs.sparkSession)
    at = docs.select(*keep, F.col("text").alias("_text"))
    schema = at.drop("_text").withColumn("ids", F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(x.as_py()), "<i4") for x in batch.column("_text")]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(ends, flat)], names=[*keep, "ids"])

    return at.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Per document: n_tokens, ids_sha256 and decoded_sha256, each text encoded and its ids decoded again."""
    reachable(docs.sparkSession)
    at = docs.select(F.col(key), F.col("text").alias("_text"))
    schema = at.select(key, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column("_text"):
                ids = bpe.encode(x.as_py())
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return at.mapInArrow(run, schema)
