"""Quality classifier on supervised subword embeddings.

Words, pairs of neighbouring words, distances back to the same word and character n-grams are hashed to learned
vectors; a document is the mean of its vectors, and a softmax on top gives the class. Everything is learned in numpy by stochastic gradient descent.
Since mean and output layer are linear, a word's share of the class scores is computed once per worker and kept.

Cases: null and empty texts have the mean of no vectors, so their score is that of the bias alone; without
labelled rows the score is the prior 0.5; very long texts are scored whole; equal texts, so repeated rows too, get equal
scores, and there are no ties to break; an own column named score gives way to the result's, other columns stay; an empty
table gives an empty result. A doc_id may repeat in documents and in labels: so many rows a class are drawn, not ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewood.llm.common import crc_share, materialize, small_batches, table
from brinewood.llm.learned import WordTable, drawn_labels, labelled_sample

DIM = 8
BUCKETS = 1 << 17
GRAMS = (2, 4)  # shortest and longest character n-grams of a word between its marks < and >
DOCS_PER_CLASS = 1500  # bound of the labelled sample
EPOCHS, BATCH, RATE = 8, 16, 40.0
STEPS = 1000  # least number of batches; small samples are gone through more often
CACHED_WORDS = 500_000
SEED = 7
THRESHOLD = 0.7

MIX = np.uint64(0x9E3779B97F4A7C15)
#: What distances back to the same word are hashed with, and the greatest power of 2 that is told apart.
BACK, FARTHEST = np.uint64(0xC2B2AE3D27D4EB4F), 16


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * MIX
        return x ^ (x >> np.uint64(29))


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def grams(words: list[bytes], low: int = GRAMS[0], high: int = GRAMS[1]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of all words' character n-grams (over bytes), with marks < and > around each word."""
    codes = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64) + np.uint64(1)
    size = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # bytes of the word from here on
    run, owners, hashes = codes, [], []
    for n in range(2, high + 1):
        with np.errstate(over="ignore"):
            run = run[:-1] * np.uint64(1099511628211) + codes[n - 1 :]
        if not len(run):
            break
        if n >= low:
            whole = left[: len(run)] >= n
            owners.append(owner[: len(run)][whole])
            hashes.append(_mixed(run[whole] + np.uint64(n)))
    return np.concatenate(owners), np.concatenate(hashes)


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words, from the words' hashes."""
    with np.errstate(over="ignore"):
        return _mixed(hashes[:-1] * np.uint64(3) + hashes[1:])


def recurrences(hashes: np.ndarray) -> np.ndarray:
    """For each word that occurred before a hash of how far back, in powers of 2: how a text repeats itself is learned like
    its words are."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    back = np.diff(order)[same]
    with np.errstate(over="ignore"):
        return _mixed(np.minimum(np.log2(back).astype(np.uint64), np.uint64(FARTHEST)) * MIX + BACK)


def relations(hashes: np.ndarray) -> np.ndarray:
    """What is hashed of words among each other."""
    return np.concatenate([pairs(hashes), recurrences(hashes)])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Embeddings:
    """Hashed vectors, their mean, and a softmax."""

    def __init__(self, labels: list, dim: int = DIM, buckets: int = BUCKETS, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        self.labels, self.buckets = labels, buckets
        self.vectors = draw.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        self.out = np.zeros((dim, len(labels)), np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def features(self, text: str | None, seen: dict) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of a text and their shares in its mean."""
        words = words_of(text)
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        new = sorted(set(words).difference(seen))
        if new:
            owner, found = grams(new)
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(1, len(new)))
            for w, own in zip(new, np.split(found[order], ends), strict=True):
                h = word_hash(w)
                seen[w] = (h, np.concatenate([np.array([h], np.uint64), own]))
        own = np.array([seen[w][0] for w in words], np.uint64)
        every = np.concatenate([*(seen[w][1] for w in words), relations(own)]) % np.uint64(self.buckets)
        at, n = np.unique(every.astype(np.int64), return_counts=True)
        return at, (n / n.sum()).astype(np.float32)

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> float:
        """Stochastic gradient descent on cross-entropy, with a rate that falls to 0; the mean loss of the last epoch."""
        draw = np.random.default_rng(seed)
        total, step, last = epochs * -(-len(docs) // batch), 0, 0.0
        for _ in range(epochs):
            order, losses = draw.permutation(len(docs)), []
            for s in range(0, len(docs), batch):
                some = order[s : s + batch]
                now = rate * (1 - step / total)
                step += 1
                at = np.concatenate([docs[i][0] for i in some])
                share = np.concatenate([docs[i][1] for i in some])
                owner = np.repeat(np.arange(len(some)), [len(docs[i][0]) for i in some])
                mean = np.zeros((len(some), self.vectors.shape[1]), np.float32)
                np.add.at(mean, owner, self.vectors[at] * share[:, None])
                logit = mean @ self.out + self.bias
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                losses.append(-np.log(p[np.arange(len(some)), y[some]] + 1e-9).mean())
                p[np.arange(len(some)), y[some]] -= 1
                p /= len(some)
                g_mean = p @ self.out.T
                self.out -= 0.1 * now * (mean.T @ p)
                self.bias -= 0.01 * now * p.sum(0)
                np.add.at(self.vectors, at, -now * share[:, None] * g_mean[owner])
            last = float(np.mean(losses))
        return last

    def scores(self) -> np.ndarray:
        """Each bucket's share of the class scores."""
        return self.vectors @ self.out

    def key(self) -> str:
        return hashlib.sha256(self.vectors.tobytes() + self.out.tobytes() + self.bias.tobytes()).hexdigest()


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs_per_class: int = DOCS_PER_CLASS, seed: int = SEED) -> Embeddings | None:
    """Vectors for the labels, from a bounded sample of labelled whole texts; None if no row has a label.

    Pairs of id and label are counted over all rows of `labels`, and so many of each label are drawn by a hash of the id;
    only their texts are fetched, at most docs_per_class rows a label however often an id repeats. The bias makes up for
    classes that were drawn more thinly.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull()).distinct()
    drawn, counts = drawn_labels(rows, "id", "label", docs_per_class, seed)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    drawn = materialize(texts.join(F.broadcast(drawn), "id").select("text", "label", F.xxhash64(F.lit(seed), "id", "text").alias("draw")), "labelled")
    sample = labelled_sample(drawn, "label", docs_per_class)
    found = sorted(set(sample["label"]))
    if not found:
        return None
    model, seen = Embeddings(found, seed=seed), {}
    parts = [model.features(t, seen) for t in sample["text"]]
    y = sample["label"].map(found.index).to_numpy()
    model.fit(parts, y, max(EPOCHS, -(-STEPS * BATCH // len(parts))), seed=seed)
    n = np.bincount(y, minlength=len(found))
    model.bias += np.log([counts[k] / m for k, m in zip(found, n, strict=True)]).astype(np.float32)
    model.bias -= model.bias.mean()
    return model


def predict(docs: DataFrame, model: Embeddings | None, positive, *, text_col: str = "text") -> DataFrame:
    """docs with score, the probability of the label `positive`."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    if model is None or positive not in model.labels:
        return docs.withColumn("score", F.lit(0.5 if model is None else 0.0))
    # scores relative to the positive class: a document's class odds need no more
    own = model.labels.index(positive)
    scores, bias, key, at = model.scores(), model.bias, "quality" + model.key(), docs.columns.index(text_col)
    k = len(model.labels)

    def share(words: list[bytes]) -> np.ndarray:
        # class scores of the word and its n-grams, their number, and the word's hash in two exact halves
        own = np.array([word_hash(w) for w in words], np.uint64)
        owner, found = grams(words)
        owner, found = np.concatenate([np.arange(len(words)), owner]), np.concatenate([own, found])
        at = (found % np.uint64(len(scores))).astype(np.int64)
        sums = [np.bincount(owner, scores[at, c], len(words)) for c in range(k)]
        return np.stack([*sums, np.bincount(owner, minlength=len(words)), own >> np.uint64(32), own & np.uint64(0xFFFFFFFF)], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTable(key, share, k + 3, CACHED_WORDS, np.float64)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            score = np.zeros(len(texts))
            for lo in range(0, len(texts), 100):
                for i, rows in enumerate(known.look_up([words_of(t) for t in texts[lo : lo + 100]]), lo):
                    logit = bias.astype(np.float64)
                    if len(rows):
                        hashes = rows[:, k + 1].astype(np.uint64) << np.uint64(32) | rows[:, k + 2].astype(np.uint64)
                        two = (relations(hashes) % np.uint64(len(scores))).astype(np.int64)
                        logit = logit + (rows[:, :k].sum(0) + scores[two].sum(0, dtype=np.float64)) / (rows[:, k].sum() + len(two))
                    p = np.exp(logit - logit.max())
                    score[i] = round(float(p[own] / p.sum()), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("score", DoubleType()))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_share(F.col("doc_id"), 4) == 2)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_share(F.col("doc_id"), 4) != 2)
    model = train(docs.where(~F.col("held_out")), labels)
    scored = predict(docs, model, 1)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
