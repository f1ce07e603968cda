"""A byte-level convolutional quality classifier in numpy (operator 9).

A text's bytes are embedded and seen by learned filters of WIDTH bytes at every STRIDE-th byte.  Chunks of
1,024 bytes overlap by half and cover the whole document; each filter is max-pooled over a chunk, the
pooled values are averaged over chunks, and a logistic layer turns them into one probability.

It is trained on the driver with Adam on about ``per_class`` labelled documents of each class, picked by a
hash of the id; training and scoring read all chunks of whole texts, a bounded number of bytes at a time.
With fewer than two classes every score is 0.5.  A null text counts as empty and is scored like any other.
Rows with a null id or label are scored but not learned from; where an id has several labels, the smallest
counts, and where it has several texts, one of them.  Repeated rows give repeated results, an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lsnframe.llm.batches import mapped, pieces
from lsnframe.llm.language_id import held_out

WIDTH, STRIDE, HALF = 24, 4, 128
EMBED, FILTERS = 6, 24
#: Bytes of texts that are scored together.
BLOCK = 1_000_000
#: Half chunks, and chunks, that are held at a time.
HELD = 1024


def layout(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded with zeros, and documents' bounds."""
    raw = [(t or "").encode() for t in texts]
    size = np.array([len(r) + WIDTH + -len(r) % STRIDE for r in raw], np.int64)
    b = np.frombuffer(b"".join([*(r + b"\0" * (WIDTH + -len(r) % STRIDE) for r in raw), b"\0" * WIDTH]), np.uint8)
    return b, np.append(0, np.cumsum(size))


def _halves(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, first bytes and windows of all half chunks; a document's last windows, which would reach
    into the next one, don't count."""
    steps = np.diff(off) // STRIDE
    n = -(-steps // HALF)
    doc = np.repeat(np.arange(len(steps)), n)
    k = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    return doc, off[doc] + k * HALF * STRIDE, np.clip(steps[doc] - (WIDTH // STRIDE - 1) - k * HALF, 0, HALF)


class Network:
    """Parameters and the passes of the classifier."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (256, EMBED)), "w": r.normal(0, (1 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)),
            "b": np.zeros(FILTERS), "v": r.normal(0, 0.3, FILTERS), "c": np.zeros(1),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.trained = False

    def pooled(self, b: np.ndarray, begin: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest value over each half chunk, and the byte where its window begins."""
        top, spot = np.zeros((len(begin), FILTERS), np.float32), np.zeros((len(begin), FILTERS), np.int64)
        reach = np.arange(HALF * STRIDE + WIDTH)
        for i in range(0, len(begin), HELD):
            part = begin[i : i + HELD]
            x = self.p["e"][b[np.minimum(part[:, None] + reach, len(b) - 1)]]
            one, step, value = x.strides
            windows = np.lib.stride_tricks.as_strided(x, (len(part), HALF, WIDTH * EMBED), (one, step * STRIDE, value))
            a = windows.reshape(-1, WIDTH * EMBED) @ self.p["w"] + self.p["b"]
            a = np.maximum(a, 0, out=a).reshape(len(part), HALF, FILTERS)
            a[np.arange(HALF) >= valid[i : i + HELD, None]] = 0
            best = a.argmax(1)
            top[i : i + HELD] = np.take_along_axis(a, best[:, None], 1)[:, 0]
            spot[i : i + HELD] = part[:, None] + best * STRIDE
        return top, spot

    @staticmethod
    def chunked(doc: np.ndarray, top: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, pooled values and spots of chunks: two neighbouring halves, or a document's only one."""
        pair = np.append(doc[1:] == doc[:-1], False)
        use = pair | np.append(True, doc[1:] != doc[:-1])
        later = pair[:, None] & (np.roll(top, -1, 0) > top)
        return doc[use], np.where(later, np.roll(top, -1, 0), top)[use], np.where(later, np.roll(spot, -1, 0), spot)[use]

    def score(self, texts: list[str | None]) -> list[float]:
        if not self.trained or not texts:
            return [0.5] * len(texts)
        b, off = layout(texts)
        doc, begin, valid = _halves(off)
        of, chunk, _ = self.chunked(doc, *self.pooled(b, begin, valid))
        n = np.bincount(of, minlength=len(texts))
        logit = np.bincount(of, (chunk @ self.p["v"]).astype(float), len(texts)) / n + float(self.p["c"][0])
        return (1 / (1 + np.exp(-np.clip(logit, -30, 30)))).tolist()

    def fit(self, texts: list[str], labels: list[int], epochs: int = 25, rate: float = 0.01, seed: int = 11) -> None:
        y = np.array(labels, np.float32)
        if len(set(labels)) < 2:
            return
        self.trained = True
        b, off = layout(texts)
        doc, begin, valid = _halves(off)
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
        r = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for i in range(0, len(order), 64):
                docs = np.sort(order[i : i + 64])
                rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
                of, pooled, spot = self.chunked(doc[rows], *self.pooled(b, begin[rows], valid[rows]))
                local = np.searchsorted(docs, of)
                n = np.bincount(local, minlength=len(docs)).astype(np.float32)
                mean = np.zeros((len(docs), FILTERS), np.float32)
                np.add.at(mean, local, pooled)
                mean /= n[:, None]
                z = mean @ self.p["v"] + self.p["c"][0]
                dz = (1 / (1 + np.exp(-z)) - y[docs]) * weight[docs] / len(docs)
                g = {"v": mean.T @ dz + 1e-4 * self.p["v"], "c": np.array([dz.sum()], np.float32)}
                da = (dz / n)[local][:, None] * self.p["v"] * (pooled > 0)
                g["b"] = da.sum(0)
                g["w"], g["e"] = 1e-4 * self.p["w"], np.zeros_like(self.p["e"])
                for f in range(FILTERS):
                    live = np.flatnonzero(da[:, f])
                    back = self.p["w"][:, f].reshape(WIDTH, EMBED)
                    for j in range(0, len(live), HELD):
                        part = live[j : j + HELD]
                        seen, d = b[spot[part, f][:, None] + np.arange(WIDTH)], da[part, f]
                        g["w"][:, f] += self.p["e"][seen].reshape(len(part), -1).T @ d
                        much = np.zeros((256, WIDTH), np.float32)  # of each byte at each place of the filter
                        np.add.at(much, (seen, np.arange(WIDTH)), d[:, None])
                        g["e"] += much @ back
                t += 1
                step = rate * min(1, 2 * (1 - epoch / epochs))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 400, label: str = "quality") -> Network:
    """A network from doc_id and text of docs and doc_id and a 0/1 column of labels."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y")).where(
        ~held_out(F.col("doc_id"))
    )
    share = {r.y: min(1.0, per_class / r["n"]) for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    net = Network()
    if len(share) < 2:
        return net
    part = F.when(F.col("y") == 0, share[0]).otherwise(share[1])
    drawn = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part * 1_000_000)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(drawn), "doc_id"
    ).dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    net.fit([r.text for r in rows], [r.y for r in rows])
    return net


def score(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 400, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    net = train(base, labels, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column(2), BLOCK):
                s = net.score(texts)
                columns = [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    pa.array(s, pa.float64()),
                    pa.array([int(x >= threshold) for x in s], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(base, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
