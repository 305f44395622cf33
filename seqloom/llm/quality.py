"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is encoded by what kinds of characters it has and how
its words repeat, through a learned layer. Gated attention (the product of a tanh and a sigmoid layer, through a
softmax over the passages) weighs the encodings; their weighted sum gives the score. All layers learn together from
the labels of whole documents, in numpy, on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.langid import bounded_rows, fold
from seqloom.llm.shared import small_batches
from seqloom.llm.words import batch_words, parts, pieces_of, text_bytes, white_space

PASSAGE = 512
SAMPLE = 3000  # labelled documents that a model is fitted on, at most
FOLDS = 3
KINDS = ["a-z", "A-Z", "0-9", " ", "\n", ".", ",", "!", "|", "%", "*", "#", "$", "&", "/", ":", "=", "'\"", "-_", "<>", "?"]
OTHER, HIGH, MIDDLE, LEAD = range(len(KINDS), len(KINDS) + 4)
WIDTH = len(KINDS) + 4 + 4
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def kind_of_byte() -> np.ndarray:
    out = np.full(256, OTHER, np.int64)
    for k, chars in enumerate(KINDS):
        span = range(ord(chars[0]), ord(chars[2]) + 1) if len(chars) == 3 and chars[1] == "-" else map(ord, chars)
        out[list(span)] = k
    out[128:160], out[160:192], out[192:] = HIGH, MIDDLE, LEAD
    return out


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(encoder input of each passage, index of the first passage of each text with the end of the last).

    Every byte of a text is in one passage; an empty text has one empty passage.
    """
    data, offsets = text_bytes(column)
    words, starts, _ = batch_words(column, white_space())
    length = np.diff(offsets)
    per = np.maximum(1, -(-length // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(per)])
    x = np.zeros((bounds[-1], WIDTH))
    kinds = kind_of_byte()
    for first, last in pieces_of(offsets):
        for a in range(int(offsets[first]), int(offsets[last]), 1 << 21):
            b = min(a + (1 << 21), int(offsets[last]))
            at = np.arange(a, b)
            doc = np.searchsorted(offsets, at, "right") - 1
            key = (bounds[doc] + (at - offsets[doc]) // PASSAGE - bounds[first]) * WIDTH + kinds[data[a:b]]
            x[bounds[first] : bounds[last]] += np.bincount(key, minlength=(bounds[last] - bounds[first]) * WIDTH).reshape(-1, WIDTH)
    size = np.maximum(1, x.sum(1))
    x /= size[:, None]
    if len(words):
        doc = np.searchsorted(offsets, starts, "right") - 1
        of = bounds[doc] + (starts - offsets[doc]) // PASSAGE
        n = np.maximum(1, np.bincount(of, minlength=len(x)))
        for k, lag in enumerate((1, 2)):
            same = np.zeros(len(words))
            same[lag:] = (words[lag:] == words[:-lag]) & (doc[lag:] == doc[:-lag])
            x[:, -4 + k] = np.bincount(of, same, len(x)) / n
        x[:, -2] = n / size
    x[:, -1] = np.log2(size) / 10
    return x, bounds


class AttentionMIL:
    """Encoder, gated attention and classifier."""

    def __init__(self, seed: int = 1, hidden: int = 16, gate: int = 8):
        r = np.random.default_rng(seed)
        draw = lambda a, b: r.normal(0, a**-0.5, (a, b))
        self.p = {"W": draw(WIDTH, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1), "c": draw(hidden, 1), "d": np.zeros(1)}
        self.mean, self.std = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> tuple:
        p, starts, bag = self.p, bounds[:-1], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = ((v * u) @ p["w"])[:, 0]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip((z @ p["c"] + p["d"])[:, 0], -30, 30)))
        return h, v, u, a, z, y, bag

    def fit(self, x: np.ndarray, bounds: np.ndarray, labels: np.ndarray, steps: int = 400, rate: float = 0.02) -> AttentionMIL:
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.std
        p, n = self.p, len(labels)
        m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            h, v, u, a, z, y, bag = self.forward(x, bounds)
            dy = ((y - labels) / n)[:, None]
            dz = dy @ p["c"].T
            da = (dz[bag] * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, bounds[:-1])[bag])
            dvu = de[:, None] @ p["w"].T
            dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
            dh = (a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
            g = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de[:, None], "c": z.T @ dy, "d": dy.sum(0)}
            for k in p:
                grad = g[k] + 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                p[k] -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.std, bounds)[5]


def fit_on(docs: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str, sample: int = SAMPLE) -> AttentionMIL | None:
    """A model of bounded_rows() of the sample labelled documents whose ids' hashes are least; None without both labels."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    chosen = [(r.id, r.y) for r in known.filter((fold("id", FOLDS) != 1)).orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    if len({y for _, y in chosen}) < 2:
        return None
    y_of = dict(chosen)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter(F.col("id").isin(list(y_of)) & F.col("text").isNotNull())
    got = sorted((r.id, r.text) for r in bounded_rows(rows.withColumn("h", F.xxhash64("id")), sample))
    if len({y_of[i] for i, _ in got}) < 2:
        return None
    x, bounds = passages(pa.array([t for _, t in got], pa.large_string()))
    return AttentionMIL().fit(x, bounds, np.array([y_of[i] for i, _ in got], float))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, over the whole text.

    Learns from labelled documents whose crc32(doc_id) modulo 3 isn't 1. A null text counts as empty; an empty text has
    one empty passage and gets that passage's score. Without rows of both labels every score is 0.5. Repeated rows give
    repeated rows; of labels repeated for one document the larger counts; an empty table gives no rows; other columns
    are not read.
    """
    ship = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels, label, text, doc_id, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ship.value
        for batch in parts(batches):
            n = batch.num_rows
            score = np.round(model.score(*passages(batch.column(2))), 6) if model and n else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return small_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold(doc_id, FOLDS) == 1).alias("held_out"), F.col(text).cast("string").alias("text"))).mapInArrow(run, SCHEMA)
