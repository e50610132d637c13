"""A quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of its bytes. Every chunk goes through
a byte embedding and one layer of learned filters; each filter's strongest response in the
chunk is kept (max-pooling), and the mean and the maximum over all chunks give one
probability by a logistic layer. Training runs on the driver over a bounded sample of
labelled rows; scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm import textbatch as tb
from marketloom.llm.scratch import table

CHUNK, OVERLAP = 512, 64
EMBED, WIDTH, STRIDE, FILTERS = 8, 8, 2, 32
#: The sample for training: so many rows of each label, the lowest hashes, with texts of at
#: most so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 600, 32_768
EPOCHS, RATE, BATCH = 5, 0.01, 16
THRESHOLD = 0.7
_BLOCK = 64
#: Chunks whose bytes are looked up together.
_STREAM = 2048


def chunk_starts(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document and first byte of every chunk, and where each document's begin (n + 1). An
    empty document has one chunk of padding."""
    step = CHUNK - OVERLAP
    many = np.maximum(1, -(-(np.diff(offs) - OVERLAP) // step))
    first = np.concatenate(([0], np.cumsum(many)))
    doc = np.repeat(np.arange(len(many)), many)
    return doc, offs[:-1][doc] + (np.arange(first[-1]) - first[:-1][doc]) * step, first


def chunk_bytes(data: np.ndarray, offs: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """These chunks' bytes, padded with 0."""
    at = begin[:, None] + np.arange(CHUNK)
    inside = at < offs[1:][doc][:, None]
    at[~inside] = 0
    out = (data if len(data) else np.zeros(1, np.uint8))[at]
    out[~inside] = 0
    return out


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all documents and where each document's begin: for training samples."""
    doc, begin, first = chunk_starts(offs)
    return chunk_bytes(data, offs, doc, begin), first


class Network:
    """Weights, scoring and training."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.w = r.normal(0, 1 / np.sqrt(EMBED * WIDTH), (EMBED * WIDTH, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = np.zeros(2 * FILTERS, np.float32)
        self.c = np.zeros(1, np.float32)

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """By chunk the strongest response of each filter and, if asked, its position."""
        best, at = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64) if where else None
        for k in range(0, len(x), _BLOCK):
            emb = self.e[x[k : k + _BLOCK]]
            view = np.lib.stride_tricks.sliding_window_view(emb, WIDTH, axis=1)[:, ::STRIDE]
            flat = np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(-1, WIDTH * EMBED)
            y = (flat @ self.w).reshape(len(emb), -1, FILTERS)
            if where:
                at[k : k + _BLOCK] = y.argmax(axis=1)
            best[k : k + _BLOCK] = y.max(axis=1)
        return np.maximum(best + self.b, 0), at

    def features(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(pooled, first[:-1]) / np.diff(first)[:, None]
        return np.concatenate((mean, np.maximum.reduceat(pooled, first[:-1])), axis=1)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if len(offs) < 2:
            return np.zeros(0)
        doc, begin, first = chunk_starts(offs)
        total, most = np.zeros((len(offs) - 1, FILTERS)), np.zeros((len(offs) - 1, FILTERS), np.float32)  # responses are 0 at least
        for k in range(0, len(doc), _STREAM):  # sums and maxima are carried along, whatever a text's length
            own = doc[k : k + _STREAM]
            pooled = self.pooled(chunk_bytes(data, offs, own, begin[k : k + _STREAM]))[0]
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[cuts]] += np.add.reduceat(pooled, cuts)
            most[own[cuts]] = np.maximum(most[own[cuts]], np.maximum.reduceat(pooled, cuts))
        z = np.concatenate((total / np.diff(first)[:, None], most), axis=1) @ self.v.astype(float) + float(self.c[0])
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 7) -> None:
        """Adam on the mean logistic loss, labels weighing equally."""
        r = np.random.default_rng(seed)
        weights = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        names = ("e", "w", "b", "v", "c")
        m, s = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        t = 0
        offs_of = np.cumsum([0] + [len(x) for x in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        for _ in range(EPOCHS):
            order = r.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                pick = order[k : k + BATCH]
                own = np.concatenate([data[offs_of[i] : offs_of[i + 1]] for i in pick])
                x, first = chunks(own, np.cumsum([0] + [len(texts[i]) for i in pick]))
                pooled, at = self.pooled(x, True)
                f = self.features(pooled, first)
                p = 1 / (1 + np.exp(-np.clip(f @ self.v + self.c[0], -50, 50)))
                g = ((p - labels[pick]) * weights[pick] / len(pick)).astype(np.float32)
                grad = {"v": f.T @ g, "c": np.array([g.sum()], np.float32)}
                doc = np.repeat(np.arange(len(pick)), np.diff(first))
                d = (g[:, None] * self.v[None, :FILTERS] / np.diff(first)[:, None])[doc]
                top = pooled == np.maximum.reduceat(pooled, first[:-1])[doc]
                d = (d + np.where(top, (g[:, None] * self.v[None, FILTERS:])[doc], 0)) * (pooled > 0)
                # Only the window of a filter's strongest response has a gradient.
                where = at[:, :, None] * STRIDE + np.arange(WIDTH)
                window = x[np.arange(len(x))[:, None, None], where]
                emb = self.e[window].reshape(len(x), FILTERS, WIDTH * EMBED)
                grad["w"] = np.einsum("cfk,cf->kf", emb, d)
                grad["b"] = d.sum(axis=0)
                back = (d[:, :, None] * self.w.T[None]).reshape(-1, EMBED)
                grad["e"] = np.stack([np.bincount(window.reshape(-1), back[:, j], 256) for j in range(EMBED)], axis=1)
                t += 1
                for name in names:
                    a = grad[name]
                    m[name] = 0.9 * m[name] + 0.1 * a
                    s[name] = 0.999 * s[name] + 0.001 * a * a
                    step = RATE * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, name, (getattr(self, name) - step).astype(np.float32))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """A network fitted on at most ``rows`` labelled documents of each label.

    Rows without an id, a text or a label 0 or 1 aren't learned from, nor ids that are labelled
    both ways. Of an id's repeated texts the smallest is. If a label has no row the network stays
    as it was made and gives every text 0.5.
    """
    label = F.col(label_col)
    clear = labels.where(label.isin(0, 1)).groupBy(F.col(id_col).alias("i")).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    named = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where(F.octet_length("t") <= max_bytes)
    net = Network()
    texts: list[bytes] = []
    truth: list[int] = []
    for value in (0, 1):
        ids = clear.where(F.col("y") == value).select("i").join(named.select("i"), "i", "left_semi").orderBy(F.xxhash64("i"), "i").limit(rows)
        one = named.join(F.broadcast(ids), "i").groupBy("i").agg(F.min("t").alias("t"))  # of repeated ids one text
        for r in one.orderBy("i").collect():  # rows x max_bytes at most
            texts.append(r.t.encode())
            truth.append(value)
    if len(set(truth)) == 2:
        net.fit(texts, np.array(truth))
    return net


ADDED = ["score", "predicted"]


def classify(docs: DataFrame, net: Network, threshold: float = THRESHOLD, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or ``carry`` of them) with ``score`` and ``predicted``.

    * A null or empty text is one chunk of padding and gets that chunk's score.
    * Rows are scored alone; repeated rows agree. Columns named like an added one give way.
      An empty table stays empty. A very long text is scored over all its chunks.
    """
    keep = [c for c in (carry if carry is not None else docs.columns) if c.lower() not in ADDED]
    hide = tb.free("__text_in", keep)
    frame = docs.select(*keep, F.col(text_col).cast("string").alias(hide))
    sent = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([frame.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.slices(whole, hide, 1 << 20):
                score = sent.value.scores(*tb.flat(batch.column(hide)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], [*keep, "score"])

    return frame.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on labelled rows that aren't held out, score all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where("doc_id is not null")
    net = train(docs, labels.where(~held_out()))
    return classify(docs.withColumn("held_out", held_out()), net, carry=["doc_id", "held_out"])
