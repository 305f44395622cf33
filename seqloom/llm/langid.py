"""Language identification by averaged hashed subword embeddings with a linear softmax.

Subwords are the 2, 3 and 4 byte pieces of the text's UTF-8 bytes, with A-Z lower-cased and other ASCII characters
than letters as spaces, hashed to BUCKETS embeddings. A text's vector is the mean of its subwords' embeddings. Numpy
trains embeddings and softmax together by stochastic gradient descent on a bounded sample of labelled rows; a part of
the sample that isn't trained on sets the temperature of the softmax and the score and the share of known subwords
below which a prediction is rejected.

For prediction, embeddings and softmax weights fold into one table of logits per bucket, so a text costs a table
look-up per subword. The table is a fixed 2^16 rows by number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import small_batches
from seqloom.llm.words import parts, pieces_of, text_bytes

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
STEP = 1 << 19  # bytes whose subwords are in memory at once
SAMPLE, SAMPLE_BYTES = 2500, 1 << 26  # rows that a model is fitted on, and bytes of their texts together, at most
FOLDS = 5
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def fold(doc_id: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def folding() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    letters = {*range(97, 123), *range(128, 256)}
    for b in range(256):
        out[b] = b + 32 if 65 <= b <= 90 else b if b in letters else 32
    return out


def subwords(data: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the piece of that size at each byte, without the last size - 1 bytes."""
    folded = folding()[data]
    n = len(folded) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, size, np.uint32)
    for k in range(size):
        h = (h ^ folded[k : n + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # (BUCKETS, languages)
    known: np.ndarray  # (BUCKETS,) 1 for subwords seen in training
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    least_known: float = 0.0

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: sums of the logits and of known subwords, and number of subwords."""
        n = len(offsets) - 1
        table = np.concatenate([self.logits, self.known[:, None]], 1).astype(np.float32)
        total, count = np.zeros((n, table.shape[1])), np.zeros(n)
        for first, last in pieces_of(offsets, STEP):
            for a in range(int(offsets[first]), int(offsets[last]), STEP):
                for size in SIZES:
                    b = min(a + STEP, int(offsets[last]))
                    h = subwords(data[a : min(b + size - 1, int(offsets[last]))], size)
                    # pieces that would reach into the next text are left out
                    lo, hi = np.maximum(offsets[first:last], a) - a, np.minimum(np.maximum(offsets[first + 1 : last + 1] - size + 1, 0), b) - a
                    own = np.flatnonzero(hi > lo)
                    if len(own):
                        cuts = np.stack([lo[own], hi[own]], 1).ravel()
                        rows = np.concatenate([table[h], np.zeros((1, table.shape[1]), np.float32)])
                        total[first + own] += np.add.reduceat(rows, cuts, axis=0)[::2]
                        count[first + own] += (hi - lo)[own]
        return total, count

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, calibrated probability, share of known subwords) per text."""
        total, count = self.sums(data, offsets)
        mean = total / np.maximum(count, 1)[:, None]
        p = softmax((mean[:, :-1] + self.bias) / self.temperature)
        return p.argmax(1), p.max(1), mean[:, -1]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], dims: int = 8, epochs: int = 4, rate: float = 2.0, seed: int = 1) -> Model:
    """Fits on four of five texts and calibrates on the fifth."""
    languages = sorted(set(langs))
    r = np.random.default_rng(seed)
    embed, weights, bias = r.normal(0, 0.1, (BUCKETS, dims)), np.zeros((dims, len(languages))), np.zeros(len(languages))
    known = np.zeros(BUCKETS)
    fit, rest = [], []
    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        data = np.frombuffer(text.encode(), np.uint8)
        h = np.concatenate([subwords(data, s) for s in SIZES])
        if i % 5 == 4 and len(texts) >= 50:
            rest.append((data, languages.index(lang)))
        elif len(h):
            buckets, n = np.unique(h, return_counts=True)
            known[buckets] = 1
            fit.append((buckets, n / n.sum(), languages.index(lang)))
    steps, t = epochs * max(1, len(fit)), 0
    for _ in range(epochs):
        for i in r.permutation(len(fit)):
            buckets, share, y = fit[i]
            now, t = rate * (1 - t / steps), t + 1
            v = share @ embed[buckets]
            p = softmax((v @ weights + bias)[None])[0]
            p[y] -= 1
            back = weights @ p
            weights -= now * np.outer(v, p)
            bias -= now * 0.01 * p
            embed[buckets] -= now * len(buckets) ** 0.5 * share[:, None] * back
    model = Model(languages, embed @ weights, known, bias)
    if rest:
        data = np.concatenate([d for d, _ in rest])
        offsets = np.cumsum([0, *(len(d) for d, _ in rest)])
        total, count = model.sums(data, offsets)
        mean, y = total / np.maximum(count, 1)[:, None], np.array([y for _, y in rest])
        z = mean[:, :-1] + bias
        z = z - z.max(1, keepdims=True)
        loss = lambda t: (np.log(np.exp(z / t).sum(1)) - z[np.arange(len(y)), y] / t).mean()
        model.temperature = float(min(np.geomspace(0.5, 100, 80), key=loss))
        score = softmax((mean[:, :-1] + bias) / model.temperature).max(1)
        model.least_score = float(min(np.quantile(score, 0.002), 0.9) * 0.75)
        model.least_known = float(np.quantile(mean[:, -1], 0.002) * 0.5)
    return model


def bounded_rows(rows: DataFrame, sample: int, most: int = SAMPLE_BYTES) -> list:
    """At most sample rows (h, text, ...) of most bytes of text together, those whose h are least, then the hash of their
    text; equal ones once. What comes to the driver beforehand is sample hashes and sizes."""
    rows = rows.withColumn("own", F.xxhash64("text"))
    taken, total = [], 0
    for h, own, size in rows.select("h", "own", F.octet_length("text")).orderBy("h", "own").limit(sample).collect():
        if (h, own) in taken[-1:]:
            continue
        total += size
        if taken and total > most:
            break
        taken.append((h, own))
    if not taken:
        return []
    last = taken[-1]
    near = rows.filter((F.col("h") < last[0]) | (F.col("h") == last[0]) & (F.col("own") <= last[1]))
    return sorted(near.dropDuplicates(["h", "own"]).drop("own").limit(len(taken)).collect())


def fit_on(docs: DataFrame, text: str, lang: str, doc_id: str, sample: int = SAMPLE) -> Model | None:
    """A model of bounded_rows() of docs with text and lang, by the hashes of their ids; None without any."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.xxhash64(F.col(doc_id)).alias("h"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    got = bounded_rows(rows, sample)
    return train([r.text for r in got], [r.lang for r in got]) if got else None


LETTER = regex.compile(r"\p{L}")


def judge(model: Model | None, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, whether rejected) of each text."""
    n = len(column)
    if not model or not n:
        return ["und"] * n, np.zeros(n), np.ones(n, bool)
    data, offsets = text_bytes(column)
    best, score, known = model.predict(data, offsets)
    letter, some = ((data | 32) >= 97) & ((data | 32) <= 122), offsets[1:] > offsets[:-1]
    has = np.zeros(n, bool)
    if some.any():
        has[some] = np.logical_or.reduceat(letter, offsets[:-1][some])
    for i in np.flatnonzero(~has):
        has[i] = bool(LETTER.search(column[i].as_py() or ""))
    said = [model.languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
    return said, np.round(np.where(has, score, 0.0), 6), ~has | (score < model.least_score) | (known < model.least_known)


def identify(docs: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, rejected.

    Whole texts. A text that is null or has no letter gets 'und' with score 0 and is rejected, as is every text without
    a model. A text whose calibrated score or share of known subwords is below the model's least is rejected but keeps
    its prediction. Repeated rows give repeated rows; an empty table gives none; other columns are not read.
    """
    ship = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            said, score, rejected = judge(ship.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return small_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold(doc_id, FOLDS) == 0).alias("held_out"), F.col(text).cast("string").alias("text"))).mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of docs whose text identify() doesn't reject, all columns as they are.

    Null and empty texts and those without a letter are rejected, as is every row without a model. Rows without doc_id
    are judged like others; repeated rows stay or go together; an empty table gives none.
    """
    ship, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield batch.filter(pa.array(~judge(ship.value, batch.column(place))[2], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def known_languages(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """accepted() with a model fitted on rows with text and lang whose crc32(doc_id) modulo 5 isn't 0; a null doc_id's is 0."""
    return accepted(docs, fit_on(docs.filter(fold(doc_id, FOLDS) != 0), text, lang, doc_id, sample), text)


def identify_languages(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """identify() with a model fitted on rows whose crc32(doc_id) modulo 5 isn't 0."""
    return identify(docs, fit_on(docs.filter(fold(doc_id, FOLDS) != 0), text, lang, doc_id, sample), text, doc_id)
