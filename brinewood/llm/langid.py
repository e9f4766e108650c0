"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of the whole text, forwards and backwards, and a document's probabilities are the mean over
all its bytes. It is trained in numpy by backpropagation through time. So that many places are read at once, the state is
not carried along the whole text: it starts anew in windows of WINDOW bytes, each of which reads CONTEXT bytes on either
side first, so that every position is labelled by a state that comes from the text around it, other words included, and
from no further away. Training windows have no such context. Tests compare windows with one run over all of a text: equal
with as much context as there is, within 1 in 10,000 with CONTEXT.

Cases: a null text or one without a letter is `und` with score 0; without labelled rows nothing is learned and
every text is `und`; very long texts are read whole, window by window; equal texts get equal predictions; labels that
tie go to the first in code order; columns of docs stay as they are, but for columns named lang_pred or score, which
are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewood.llm.common import crc_share, small_batches, table
from brinewood.llm.learned import labelled_sample

HIDDEN = 8
WINDOW, CONTEXT = 512, 32  # bytes that a window labels, and bytes that it reads on either side beforehand
LEARNED = 128  # bytes of a training window
DOCS_PER_LANGUAGE = 100  # bound of the labelled sample
EPOCHS, BATCH, RATE = 2, 64, 0.02
RUN = 1024  # windows that run at once
SEED = 5
UNKNOWN = "und"
PAD = 256  # no byte: the update gate is shut, so the state stays
SHUT = 1e30
MOST = 60  # bound of a logit


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter (Unicode category L), as `letters` says for columns."""
    return any(map(str.isalpha, text or ""))


def letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def soft_sign(x: np.ndarray) -> None:
    """x / (1 + |x|) in place; its slope is (1 - |result|) squared."""
    x /= np.abs(x) + np.float32(1)


class BiGru:
    """Two gated recurrent layers over bytes, one from each end, and a softmax at every position.

    Soft signs stand for tanh and, scaled to (0, 1), for the gates' sigmoid: they need no exponentials.
    Arrays are (features, batch); gates are slices of rows, in the order update, reset, new state.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        h, k = hidden, len(labels)
        self.labels, self.hidden = labels, h
        self.w = {"out": draw.normal(0, 0.2, (k, 2 * h)), "bias": np.zeros((k, 1))}
        for side in "fb":
            table_ = draw.normal(0, 0.3, (3 * h, PAD + 1))
            table_[:, PAD] = np.where(np.arange(3 * h) < h, SHUT, 0)
            self.w |= {f"in_{side}": table_, f"rec_{side}": draw.normal(0, 0.3, (3 * h, h)), f"rec_bias_{side}": np.zeros((3 * h, 1))}
        self.w = {n: v.astype(np.float32) for n, v in self.w.items()}

    def key(self) -> str:
        return hashlib.sha256(b"".join(self.w[n].tobytes() for n in sorted(self.w)) + repr(self.labels).encode()).hexdigest()

    def _run(self, side: str, x: np.ndarray, states: np.ndarray, tape: list | None = None) -> None:
        """Fill states (steps, hidden, batch) along x (steps, batch), from the first step or, for side b, from the last."""
        h = self.hidden
        table_, rec, bias = self.w[f"in_{side}"], self.w[f"rec_{side}"], self.w[f"rec_bias_{side}"]
        state = np.zeros((h, x.shape[1]), rec.dtype)
        half = np.float32(0.5)
        a, u = np.empty((2, 3 * h, x.shape[1]), rec.dtype)
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            if tape is not None:
                a, u = np.empty((2, 3 * h, x.shape[1]), rec.dtype)
            np.take(table_, x[t], axis=1, out=a, mode="clip")
            np.dot(rec, state, out=u)
            u += bias
            zr, new, u_new = a[: 2 * h], a[2 * h :], u[2 * h :]
            zr += u[: 2 * h]
            soft_sign(zr)
            zr *= half
            zr += half
            z, r = zr[:h], zr[h:]
            new += r * u_new
            soft_sign(new)
            if tape is not None:
                tape.append((t, state, z, r, new, u_new))
            step = states[t]
            np.subtract(state, new, out=step)
            step *= z
            step += new
            state = step

    def forward(self, x: np.ndarray, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (steps, labels, batch) at all positions of x (steps, batch), and the states of both sides."""
        h = self.hidden
        both = np.empty((len(x), 2 * h, x.shape[1]), self.w["out"].dtype)
        for i, side in enumerate("fb"):
            self._run(side, x, both[:, i * h : (i + 1) * h], tapes and tapes[i])
        p = np.matmul(self.w["out"], both)
        p += self.w["bias"]
        np.exp(np.clip(p, -MOST, MOST, out=p), out=p)
        p /= p.sum(1, keepdims=True)
        return p, both

    def _back(self, side: str, x: np.ndarray, tape: list, grad_states: np.ndarray, grads: dict) -> None:
        h, rec = self.hidden, self.w[f"rec_{side}"]
        g_rec, g_bias = np.zeros_like(rec), np.zeros((3 * h, 1), np.float32)
        g_all = np.empty((len(x), 3 * h, x.shape[1]), np.float32)
        carry = np.zeros((h, x.shape[1]), np.float32)
        for t, state, z, r, new, u_new in reversed(tape):
            g = carry + grad_states[t]
            g_new = g * (1 - z) * np.square(1 - np.abs(new))
            g_a = g_all[t]
            g_a[:h] = g * (state - new) * np.square(1 - np.abs(2 * z - 1)) * np.float32(0.5)
            g_a[h : 2 * h] = g_new * u_new * np.square(1 - np.abs(2 * r - 1)) * np.float32(0.5)
            g_a[2 * h :] = g_new
            g_u = g_a.copy()
            g_u[2 * h :] *= r
            g_rec += g_u @ state.T
            g_bias += g_u.sum(1, keepdims=True)
            carry = g * z + rec.T @ g_u
        flat, rows = x.ravel(), g_all.transpose(0, 2, 1).reshape(-1, 3 * h)
        order = np.argsort(flat, kind="stable")
        found, first = np.unique(flat[order], return_index=True)
        g_in = np.zeros((PAD + 1, 3 * h), np.float32)
        g_in[found] = np.add.reduceat(rows[order], first)
        g_in[PAD] = 0
        grads |= {f"in_{side}": g_in.T, f"rec_{side}": g_rec, f"rec_bias_{side}": g_bias}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions, and its gradients, back through time in both directions."""
        tapes: tuple[list, list] = ([], [])
        p, both = self.forward(x, tapes)
        real = (x != PAD)[:, None].astype(np.float32)
        n = float(real.sum())
        own = (np.arange(len(self.labels))[:, None] == y)[None]
        loss = float(-(np.log(np.where(own, p, 1) + 1e-9) * real).sum() / n)
        g = (p - own) * (real / np.float32(n))
        h = self.hidden
        grads = {"out": np.einsum("tkb,thb->kh", g, both, optimize=True), "bias": g.sum((0, 2))[:, None]}
        g_both = np.matmul(self.w["out"].T, g)
        self._back("f", x, tapes[0], g_both[:, :h], grads)
        self._back("b", x, tapes[1], g_both[:, h:], grads)
        return loss, grads

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> float:
        """Adam over batches of windows that cover the texts whole; the last mean loss."""
        draw = np.random.default_rng(seed)
        windows = [(i, a) for i, t in enumerate(texts) for a in range(0, len(t), LEARNED)]
        first = {n: np.zeros_like(v) for n, v in self.w.items()}
        second = {n: np.zeros_like(v) for n, v in self.w.items()}
        total = max(1, epochs * -(-len(windows) // batch))
        step, loss = 0, 0.0
        for _ in range(epochs):
            order = draw.permutation(len(windows))
            for s in range(0, len(order), batch):
                some = [windows[j] for j in order[s : s + batch]]
                x = padded([texts[i][a : a + LEARNED] for i, a in some])
                loss, grads = self.gradients(x, y[[i for i, _ in some]])
                step += 1
                now = rate * (1 - 0.95 * step / total)
                for name, g in grads.items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    self.w[name] -= (now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return loss

    def label(self, texts: list[bytes], window: int = WINDOW, context: int = CONTEXT) -> np.ndarray:
        """(texts, labels): mean probabilities over all positions of each text, every one of which is labelled once."""
        size = np.array([len(t) for t in texts], np.int64)
        flat = np.append(np.frombuffer(b"".join(texts), np.uint8), 0).astype(np.int16)
        n = -(-size // window)
        owner = np.repeat(np.arange(len(texts)), n)
        begin = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * window  # first byte to label
        end = np.minimum(begin + window, size[owner])
        low, high = np.maximum(begin - context, 0), np.minimum(end + context, size[owner])  # bytes to read
        base = (np.cumsum(size) - size)[owner]
        out = np.zeros((len(texts), len(self.labels)))
        order = np.argsort(high - low, kind="stable")
        for s in range(0, len(order), RUN):
            w = order[s : s + RUN]
            at = low[w] + np.arange((high - low)[w].max())[:, None]
            x = np.where(at < high[w], flat[np.minimum(base[w] + at, len(flat) - 1)], PAD)
            p, _ = self.forward(x)
            p *= ((at >= begin[w]) & (at < end[w]))[:, None]
            np.add.at(out, owner[w], p.sum(0).T.astype(np.float64))
        return out / np.maximum(size, 1)[:, None]


def padded(texts: list[bytes]) -> np.ndarray:
    """(steps, batch) of byte values, PAD after a text's end."""
    n = np.array([len(t) for t in texts])
    x = np.full((len(texts), int(n.max())), PAD, np.int16)
    x[np.arange(x.shape[1])[None] < n[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    return np.ascontiguousarray(x.T)


def bytes_of(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def train(rows: DataFrame, *, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", docs_per_label: int = DOCS_PER_LANGUAGE, seed: int = SEED) -> BiGru | None:
    """A network for the labels of rows, from a bounded sample of whole texts; None if no row has label and text."""
    rows = rows.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), F.xxhash64(F.lit(seed), id_col, text_col).alias("draw"))
    sample = labelled_sample(rows.where(letters(F.col("text")) & F.col("label").isNotNull()), "label", docs_per_label)
    labels = sorted(set(sample["label"]))
    if not labels:
        return None
    model = BiGru(labels, seed=seed)
    model.fit([bytes_of(t) for t in sample["text"]], sample["label"].map(labels.index).to_numpy())
    return model


def predict(docs: DataFrame, model: BiGru | None, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    small_batches(docs.sparkSession)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            place: dict[str, list[int]] = {}  # rows of each distinct text
            for i, t in enumerate(texts):
                if has_letter(t):
                    place.setdefault(t, []).append(i)
            for t, p in zip(place, model.label([bytes_of(t) for t in place]), strict=True):
                best = int(p.argmax())
                for i in place[t]:
                    found[i], score[i] = model.labels[best], min(1.0, round(float(p[best]), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_share(F.col("doc_id"), 3) == 1)
    model = train(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
