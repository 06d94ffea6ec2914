"""Language identification: averaged hashed subword embeddings under a linear softmax.

Features are byte 2-, 3- and 4-grams of the lower-cased text, hashed into ``BUCKETS`` embeddings. A text's vector is the mean of its n-grams'
embeddings; a linear layer and softmax give the languages. Training is plain stochastic gradient descent in numpy over a
bounded sample of labelled rows. A held-back part of the sample fits a temperature, so that scores are probabilities, and the
evidence under which a text is rejected: the one that loses at most ``LOSS`` of the held-back texts. Evidence is how far a text's n-grams move the logits apart;
a softmax hides that, as n-grams never trained on give small logits, but some language is always ahead.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm.common import batches, record, table

BUCKETS = 1 << 14
DIM = 16
SAMPLE = 3000  # labelled rows that training reads at most (the smallest hashes of their ids)
SAMPLE_CHARS = 50_000  # longer rows are not sampled for training, so the sample's size is bounded
LOSS = 0.001
UNKNOWN = "und"

_MASKS = [np.uint64((1 << 8 * n) - 1) for n in (2, 3, 4)]
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def features(text: str) -> np.ndarray:
    """Bucket numbers of a text's n-grams."""
    data = b" " + text.lower().encode("utf-8", "surrogatepass") + b" " * 8
    n = len(data) - 8
    grams = np.ndarray((n,), "<u8", buffer=data, strides=(1,)).astype(np.uint64)
    return np.concatenate([((grams[: n + 3 - size + 1] & m) * np.uint64(0x9E3779B97F4A7C15 + 2 * size)) >> _SHIFT for size, m in enumerate(_MASKS)]).astype(np.int64)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # logits of each bucket: embeddings times output weights
    bias: np.ndarray
    temperature: float
    floor: float  # least evidence of a text that is kept

    def logits(self, text: str) -> np.ndarray:
        logits = np.zeros(len(self.labels))
        f = features(text)
        for at in range(0, len(f), 1 << 20):
            logits += self.table[f[at : at + (1 << 20)]].sum(0, dtype=np.float64)
        return logits / len(f)

    def probabilities(self, text: str) -> np.ndarray:
        return _softmax((self.logits(text) + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, calibrated score and whether the text is rejected. Null texts and texts without a letter are ``und``, score 0, rejected."""
        if not text or not any(map(str.isalpha, text)) or not self.labels:
            return UNKNOWN, 0.0, True
        logits = self.logits(text)
        p = _softmax((logits + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], round(float(p[best]), 6), bool(_evidence(logits) < self.floor)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _evidence(logits: np.ndarray) -> np.ndarray:
    return np.sqrt(((logits - logits.mean(-1, keepdims=True)) ** 2).sum(-1))


def _floor(evidence: np.ndarray) -> float:
    """The evidence that at most ``LOSS`` of such texts fall short of: the lower of the sample's own quantile and that of a log-normal (a small sample has no such quantile)."""
    logs = np.sort(np.log(np.maximum(evidence, 1e-12)))
    return float(np.exp(min(logs[int(LOSS * len(logs))], logs.mean() + NormalDist().inv_cdf(LOSS) * logs.std())))


def train(texts: list[str], labels: list[str], epochs: int = 12, rate: float = 0.5, seed: int = 7, buckets: int = BUCKETS, dim: int = DIM) -> Model:
    """Fit a model; equal inputs give equal models. No usable rows give a model that answers ``und``."""
    rows = [(t, y) for t, y in zip(texts, labels) if t and y is not None and any(map(str.isalpha, t))]
    names = sorted({y for _, y in rows})
    rng = np.random.default_rng(seed)
    if not names:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 0.0)
    bags = []
    for t, _ in rows:
        b, n = np.unique(features(t), return_counts=True)
        bags.append((b, (n / n.sum())[:, None]))
    y = np.array([names.index(k) for _, k in rows])
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 10 else np.zeros(len(rows), bool)
    emb, out, bias = rng.normal(0, 0.1, (buckets, dim)), rng.normal(0, 0.1, (dim, len(names))), np.zeros(len(names))
    own = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(own):
            b, share = bags[i]
            vector = (emb[b] * share).sum(0)
            grad = _softmax(vector @ out + bias)
            grad[y[i]] -= 1
            back = out @ grad
            out -= step * np.outer(vector, grad)
            bias -= step * grad
            emb[b] -= step * 10 * share * back  # shares are small; the embeddings take a larger step
    weights = (emb @ out).astype(np.float32)
    test = np.flatnonzero(held) if held.any() else own
    logits = np.array([(weights[bags[i][0]] * bags[i][1]).sum(0) for i in test])
    # targets are a little short of certain, or texts that are all classified right would have the temperature fall without end
    target = np.full((len(test), len(names)), 1 / (len(test) + 2) / max(1, len(names) - 1))
    target[np.arange(len(test)), y[test]] = 1 - 1 / (len(test) + 2)
    grid = np.geomspace(0.05, 20, 60)
    losses = [-(target * np.log(np.maximum(_softmax((logits + bias) / t), 1e-300))).sum(1).mean() for t in grid]
    heat = float(grid[int(np.argmin(losses))])
    return Model(names, weights, bias, heat, _floor(_evidence(logits)) if len(names) > 1 else 0.0)


def _held_out(id_col):
    return F.crc32(id_col.cast("string")) % 3 == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from a bounded sample: at most ``sample`` labelled rows outside the held-out fold, those whose ids hash lowest, with texts of at most ``sample_chars``
    characters (both bound what the driver gets; prediction reads whole texts of any length). Rows that tie are taken in text order; no labelled rows give a model that answers ``und``.
    """
    i = F.col(id_col)
    rows = docs.where(~F.coalesce(_held_out(i), F.lit(False)) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= sample_chars))
    # a share of the hashes' range that holds a little over the sample: the driver gets those rows and no others
    n, h = rows.count(), F.xxhash64(i.cast("string"))
    cut = -(1 << 63) + int((1 << 64) * min(1.0, 1.2 * sample / max(1, n))) - 1
    some = rows.where(h <= cut).select(h.alias("h"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("y")).collect()
    rows = sorted(some, key=lambda r: (r.h, r.t))[:sample]
    return train([r.t for r in rows], [r.y for r in rows])


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for every row, from its whole text and nothing else.

    Null texts and texts without a letter are ``und``, score 0, rejected, and so is everything under a model without labels. Equal texts get equal rows; ids may be
    null or repeat; languages that tie go to the lesser name; no rows give no rows; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a megabyte: buckets times languages
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(source):
        m = shared.value
        for batch in batches(source):
            got = [m.predict(t) for t in batch.column(1).to_pylist()]
            yield record(schema, batch.column(0), *map(list, zip(*got)))

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns unchanged, whatever their names; null and letterless texts go. No rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(source):
        m = shared.value
        for batch in batches(source):
            kept = pa.array([not m.predict(t)[2] for t in batch.column(at).to_pylist()])
            yield batch.filter(kept)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = classify(docs, fit(docs))
    return got.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_language_id": query}
ORACLES: dict[str, str] = {}
