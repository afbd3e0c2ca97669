"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from its bytes, word lengths and hashed
words; gated attention weighs the passages, and the weighted representation is scored. Encoder, attention
and score are learned together from document labels alone, by Adam on the log loss (numpy, on the driver).

The fit takes at most SAMPLE labelled documents, those with the least hash of their id, of them those of up to
LONGEST characters, and stops adding documents at MOST_PASSAGES passages; the bounds hold at every corpus size. Scoring reads every whole text.
Labels, language, source and id are no inputs of a score.

Defined cases: a null or empty text, or one without words, is one passage of zeros and gets a score; a null id is
scored and is not held out; of several labels for an id the least counts; without labels of both kinds
the score is the smoothed share of label 1; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm import tokens
from veritrail.llm.common import remainder, written

PASSAGE, BUCKETS, LENGTHS, HIDDEN, GATE = 64, 256, 14, 32, 16
SAMPLE, LONGEST, MOST_PASSAGES, EPOCHS, BATCH, RATE, DECAY, SEED = 5000, 40_000, 80_000, 14, 64, 3e-3, 1e-4, 11
FOLDS, THRESHOLD = 5, 0.3


def _byte_classes() -> np.ndarray:
    """A class for each byte: lower, upper, digit, space, line end, other control, non-ASCII; each punctuation its own."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            out[b] = 6
        elif c.isalnum():
            out[b] = 0 if c.islower() else 1 if c.isupper() else 2
        elif c == " ":
            out[b] = 3
        elif c in "\r\n":
            out[b] = 4
        elif b < 0x20 or b == 0x7F:
            out[b] = 5
    marks = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
    out[marks] = np.arange(7, 7 + len(marks))
    return out


_CLASS = _byte_classes()
CLASSES = int(_CLASS.max()) + 1
WIDTH = CLASSES + LENGTHS + BUCKETS + 3


def passages(chunk: tokens.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages of a chunk, and of each document the first (n + 1 entries)."""
    w = tokens.words(chunk, tokens.SPACED)
    counts = w.counts()
    bags = np.maximum(1, -(-counts // PASSAGE))
    of = np.concatenate([[0], np.cumsum(bags)])
    total = int(of[-1])
    owner = np.repeat(of[:-1], counts) + (np.arange(len(w)) - np.repeat(w.of[:-1], counts)) // PASSAGE
    words = np.bincount(owner, minlength=total).astype(np.float32)
    some = np.maximum(words, 1)
    hashed = np.bincount(owner * BUCKETS + (tokens.word_hashes(chunk, w) % np.uint64(BUCKETS)).astype(np.int64), minlength=total * BUCKETS)
    hashed = hashed.reshape(total, BUCKETS).astype(np.float32)
    sizes = np.minimum(w.ends - w.starts, LENGTHS) - 1
    lengths = np.bincount(owner * LENGTHS + sizes, minlength=total * LENGTHS).reshape(total, LENGTHS).astype(np.float32)
    first = np.searchsorted(owner, np.arange(total))
    begins = np.where(words > 0, w.starts[np.minimum(first, max(len(w) - 1, 0))] if len(w) else 0, 0)
    begins[of[:-1]] = chunk.offsets[:-1]  # a document's first passage has all bytes before its words
    spans = np.diff(np.append(begins, len(chunk.raw)))
    places = np.repeat(np.arange(total), spans)
    kinds = np.bincount(places * CLASSES + _CLASS[chunk.raw], minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float32)
    kinds /= np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    rest = np.stack([words / PASSAGE, (hashed > 0).sum(axis=1) / some, hashed.max(axis=1) / some], axis=1)
    out = np.concatenate([np.sqrt(kinds), np.sqrt(lengths / some[:, None]), np.sqrt(hashed / some[:, None]), rest], axis=1)
    return out.astype(np.float32), of


class Model:
    """Encoder, gated attention and score; ``constant`` stands in where nothing could be learned."""

    names = ("encode", "encode_0", "value", "gate", "weigh", "score", "score_0")

    def __init__(self, width: int = WIDTH, constant: float | None = None):
        rng = np.random.default_rng(SEED)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.constant = constant
        self.encode, self.encode_0 = draw(width, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.value, self.gate, self.weigh = draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE)
        self.score, self.score_0 = draw(HIDDEN), np.zeros(1, np.float32)

    def forward(self, x: np.ndarray, of: np.ndarray) -> dict[str, np.ndarray]:
        """of: first passage of each document, n + 1 entries; every document has a passage."""
        first, sizes = of[:-1], np.diff(of)
        h = np.tanh(x @ self.encode + self.encode_0)
        t, g = np.tanh(h @ self.value), 1 / (1 + np.exp(-(h @ self.gate)))
        e = (t * g) @ self.weigh
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ self.score + self.score_0, -30, 30)))}

    def predict(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(of) - 1, self.constant)
        return self.forward(x, of)["p"].astype(np.float64)

    def gradients(self, x: np.ndarray, of: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        f = self.forward(x, of)
        sizes = np.diff(of)
        d = ((f["p"] - y) / len(y)).astype(np.float32)
        dz = np.repeat(d[:, None] * self.score, sizes, axis=0)
        h, t, g, a = f["h"], f["t"], f["g"], f["a"]
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, of[:-1]), sizes))
        dt, dg = de[:, None] * self.weigh * g * (1 - t * t), de[:, None] * self.weigh * t * g * (1 - g)
        dh = a[:, None] * dz + dt @ self.value.T + dg @ self.gate.T
        du = dh * (1 - h * h)
        return {
            "encode": x.T @ du, "encode_0": du.sum(axis=0), "value": h.T @ dt, "gate": h.T @ dg,
            "weigh": ((t * g) * de[:, None]).sum(axis=0), "score": f["z"].T @ d, "score_0": d.sum(keepdims=True),
        }


def fit(bags: list[np.ndarray], y: np.ndarray) -> Model:
    """A model learned from passages of documents and their labels 0 and 1."""
    y = np.asarray(y, np.float32)
    if len(set(y.tolist())) < 2:
        return Model(constant=float((y.sum() + 1) / (len(y) + 2)))
    model, rng = Model(), np.random.default_rng(SEED)
    first = {k: np.zeros_like(getattr(model, k)) for k in Model.names}
    second = {k: np.zeros_like(getattr(model, k)) for k in Model.names}
    step, epochs = 0, max(EPOCHS, -(-40 * BATCH * EPOCHS // max(len(y), 1)) if len(y) < 40 * BATCH else EPOCHS)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in rows]).astype(np.float32)
            of = np.concatenate([[0], np.cumsum([len(bags[i]) for i in rows])])
            step += 1
            for k, grad in model.gradients(x, of, y[rows]).items():
                w = getattr(model, k)
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                w -= (rate * ((first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + DECAY * w)).astype(np.float32)
    return model


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in tokens.chunks(batches):
        x, of = passages(chunk)
        x = x.astype(np.float16)
        blobs = pa.array([x[a:b].tobytes() for a, b in zip(of[:-1], of[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([chunk.column("key"), chunk.column("label"), blobs], ["key", "label", "x"])


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model from labelled documents outside the held-out fold."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & (remainder(F.col("id"), FOLDS) != 0)).groupBy("id").agg(F.min("label").alias("label"))
    picked = known.withColumn("key", F.xxhash64("id")).orderBy("key", "id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST).join(F.broadcast(picked), "id")
    rows = rows.groupBy("key").agg(F.min("label").alias("label"), F.min("text").alias("text"))  # an id may have many rows
    rows = written(rows.mapInArrow(_encoded, "key long, label int, x binary"), "learning")
    held, last = 0, None
    for r in sorted(rows.select("key", F.octet_length("x").alias("size")).collect()):  # SAMPLE numbers at most
        if held >= MOST_PASSAGES:
            break
        held, last = held + r.size // (2 * WIDTH), r.key
    rows = sorted(rows.where(F.col("key") <= last).collect(), key=lambda r: r.key) if last is not None else []
    return fit([np.frombuffer(r.x, np.float16).reshape(-1, WIDTH) for r in rows], np.array([r.label for r in rows]))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tokens.chunks(batches):
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(model.predict(*passages(chunk)))], ["doc_id", "score"])

    return run


def _accepted(model: Model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tokens.chunks(batches, text):
            keep = model.predict(*passages(chunk)) >= THRESHOLD
            yield chunk.batch.slice(chunk.first, chunk.n).filter(pa.array(keep))

    return run


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_scored(model), "doc_id long, score double").select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that the model does not reject, as they are, without a shuffle."""
    return docs.mapInArrow(_accepted(model, text_col), docs.schema)
