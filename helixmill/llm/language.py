"""Language identification by a byte convolutional network in numpy.

Bytes are embedded, filters of several widths run over windows of a fixed length, each filter's greatest response is
kept (max pooling), and a linear layer with softmax gives a language. A text's windows, all of them, are averaged by the
number of bytes they hold. Training fits a bounded, documented sample of labelled texts on the driver; the fitted
network, of a fixed size, is sent to the tasks. To apply it, embedding and filters are folded into tables by byte pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import reachable

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 6


class Network:
    def __init__(self, labels: list[str], seed: int = 7):
        rng, self.labels = np.random.default_rng(seed), labels
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "o": np.zeros((len(WIDTHS) * FILTERS, len(labels))), "c": np.zeros(len(labels))}
        self.p |= {f"w{k}": rng.normal(0, (k * EMBEDDING) ** -0.5, (k * EMBEDDING, FILTERS)) for k in WIDTHS} | {f"b{k}": np.zeros(FILTERS) for k in WIDTHS}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _columns(self, x: np.ndarray, k: int) -> np.ndarray:
        e = self.p["e"][x]
        return np.concatenate([e[:, j : x.shape[1] - k + 1 + j] for j in range(k)], axis=2)

    def loss_step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross entropy of windows x with labels y, and its gradients."""
        cols, best, top = {}, {}, []
        for k in WIDTHS:
            cols[k] = self._columns(x, k)
            r = cols[k] @ self.p[f"w{k}"] + self.p[f"b{k}"]
            best[k] = r.argmax(axis=1)
            top.append(np.take_along_axis(r, best[k][:, None], 1)[:, 0])
        top = np.concatenate(top, axis=1)
        h = np.maximum(top, 0)
        z = h @ self.p["o"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        n = len(x)
        loss = float(-np.log(z[np.arange(n), y] + 1e-9).mean())
        z[np.arange(n), y] -= 1
        z /= n
        g = {"o": h.T @ z, "c": z.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        dh = (z @ self.p["o"].T) * (top > 0)
        for i, k in enumerate(WIDTHS):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            at = np.take_along_axis(cols[k], best[k][:, :, None], 1)  # n, filters, width * embedding
            g[f"w{k}"] = np.einsum("nf,nfd->df", d, at)
            g[f"b{k}"] = d.sum(axis=0)
            back = (d[:, :, None] * self.p[f"w{k}"].T[None]).reshape(n, FILTERS, k, EMBEDDING)
            where = x[np.arange(n)[:, None, None], best[k][:, :, None] + np.arange(k)]
            np.add.at(g["e"], where.ravel(), back.reshape(-1, EMBEDDING))
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 600, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
        """Adam over random batches in which all labels weigh the same."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            at = np.array([rng.choice(by[k]) for k in rng.integers(len(by), size=batch)])
            _, g = self.loss_step(x[at], y[at])
            for k, p in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p -= rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
        return self

    def tables(self) -> Tables:
        return Tables(self)


class Tables:
    """The network with embedding and filters folded: a filter's response is a sum of rows looked up by byte pair or byte."""

    def __init__(self, net: Network):
        part = {(k, j): net.p["e"] @ net.p[f"w{k}"][j * EMBEDDING : (j + 1) * EMBEDDING] for k in WIDTHS for j in range(k)}
        pair = lambda a, b: (b[None] + a[:, None]).reshape(65536, FILTERS)  # noqa: E731  index: first byte << 8 | second
        self.first = np.concatenate([pair(part[k, 0], part[k, 1]) + net.p[f"b{k}"] for k in WIDTHS], axis=1)
        self.third, self.last = part[3, 2], pair(part[4, 2], part[4, 3])
        self.out, self.bias, self.labels = net.p["o"], net.p["c"], net.labels

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Softmax for each window of x."""
        out = np.empty((len(x), len(self.labels)), np.float32)
        for a in range(0, len(x), 32):
            b = x[a : a + 32].astype(np.int32)
            pair = (b[:, :-1] << 8) | b[:, 1:]
            r = self.first[pair]
            f = FILTERS
            h = np.empty((len(b), 3 * f), np.float32)
            r[:, :-1, f : 2 * f] += self.third[b[:, 2:]]
            r[:, :-2, 2 * f :] += self.last[pair[:, 2:]]
            h[:, :f] = r[:, :, :f].max(axis=1)
            h[:, f : 2 * f] = r[:, :-1, f : 2 * f].max(axis=1)
            h[:, 2 * f :] = r[:, :-2, 2 * f :].max(axis=1)
            z = np.maximum(h, 0) @ self.out + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[a : a + 32] = z / z.sum(axis=1, keepdims=True)
        return out

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Mean softmax of each text over all its windows; texts must not be empty."""
        sizes = np.array([len(t) for t in texts])
        n = -(-sizes // LENGTH)
        x = np.frombuffer(b"".join(t.ljust(k * LENGTH, b"\0") for t, k in zip(texts, n.tolist(), strict=True)), np.uint8).reshape(-1, LENGTH)
        ends = np.cumsum(n)
        weight = np.full(len(x), LENGTH, np.float64)
        weight[ends - 1] = sizes - (n - 1) * LENGTH
        return np.add.reduceat(self.windows(x) * weight[:, None], ends - n, axis=0) / sizes[:, None]


def training_rows(docs: DataFrame, per_label: int = 400, max_labels: int = 200) -> DataFrame:
    """At most per_label texts of each of the max_labels commonest languages, chosen by a hash of the id.

    Only documents outside the held-out fifth, with a text of one letter or more and a language, are used. Of a language's
    texts only those of low hash, some four times per_label whatever their number, are ranked.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.coalesce(has_letter(), F.lit(False)))
    few = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(max_labels))
    low = F.shiftrightunsigned("_h", 11) / float(1 << 53) * F.col("_n") < 4 * per_label
    ids = rows.select("doc_id", "lang", F.xxhash64(F.col("doc_id")).alias("_h")).join(few, "lang").where(low)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    ids = ids.withColumn("_k", rank).where(F.col("_k") <= per_label)
    ids = F.broadcast(ids.select("doc_id").distinct())  # per_label * max_labels ids at most
    return rows.join(ids, "doc_id").select("text", "lang").limit(per_label * max_labels)


def held_out():
    """Whether crc32 of the id as text leaves 0 by 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def has_letter():
    return F.col("text").rlike(r"\p{L}")


def train(docs: DataFrame, per_label: int = 400, max_labels: int = 200, windows_each: int = 6) -> Network | None:
    """A network fitted to windows spread evenly over each sampled text; None if there is nothing to learn from."""
    reachable(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                at = np.unique(np.linspace(0, max(0, len(raw) - LENGTH), windows_each).astype(int))
                out.append([raw[a : a + LENGTH].ljust(LENGTH, b"\0") for a in at])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.binary()))], names=["lang", "windows"])

    # Windows, of a fixed number and length for each text, go to the driver; texts don't.
    rows = training_rows(docs, per_label, max_labels).mapInArrow(cut, "lang string, windows array<binary>").collect()
    if not rows:
        return None
    labels = sorted({r.lang for r in rows})
    windows = sorted((labels.index(r.lang), bytes(w)) for r in rows for w in r.windows)
    x, y = [w for _, w in windows], [k for k, _ in windows]
    net = Network(labels)
    return net.fit(np.frombuffer(b"".join(x), np.uint8).reshape(-1, LENGTH), np.array(y))


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score. A null text, one without a letter, and any text without a network: und, 0."""
    reachable(docs.sparkSession)
    at = docs.select("doc_id", held_out().alias("held_out"), F.when(has_letter(), F.col("text")).alias("_text"))
    schema = at.select("doc_id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    sent = docs.sparkSession.sparkContext.broadcast(net.tables() if net else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for batch in batches:
            pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            held, size = [], 0
            for k, x in enumerate(batch.column(2)):
                t = x.as_py()
                if t is not None and tables is not None:
                    held.append((k, t.encode("utf-8", "surrogatepass")))
                    size += len(held[-1][1])
                if held and (size > 4 << 20 or k + 1 == batch.num_rows):
                    p = tables.texts([t for _, t in held])
                    for (i, _), row in zip(held, p, strict=True):
                        pred[i], score[i] = tables.labels[int(row.argmax())], min(1.0, float(row.max()))
                    held, size = [], 0
            if held:
                for (i, _), row in zip(held, tables.texts([t for _, t in held]), strict=True):
                    pred[i], score[i] = tables.labels[int(row.argmax())], min(1.0, float(row.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return at.mapInArrow(run, schema)
