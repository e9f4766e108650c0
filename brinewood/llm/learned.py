"""What the learned operators share: bounded labelled samples and per-word tables in the workers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinewood.llm.common import process_cache


#: Labels that a table may hold at most; more are no labels, and an error.
MOST_LABELS = 10_000


def drawn_labels(rows: DataFrame, key: str, label: str, per_label: int, seed: int) -> tuple[DataFrame, dict]:
    """(rows drawn by a hash of the key, the counts of all labels): about per_label rows of each label, all of rarer ones."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {label}")
    kind = rows.schema[label].dataType.simpleString()
    share = rows.sparkSession.createDataFrame([(k, min(1.0, per_label / n)) for k, n in counts.items()], f"_label {kind}, _share double")
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20)) / float(1 << 20)
    return rows.join(F.broadcast(share), F.col(label) == F.col("_label")).where(draw < F.col("_share")).drop("_label", "_share"), counts


def labelled_sample(rows: DataFrame, label: str, per_label: int) -> pd.DataFrame:
    """The per_label rows (text, label) of each label that come first by `draw`, a hash of the row; all rows of rarer labels.

    Rows are drawn, not texts, so a text with many copies stands for as many rows as it holds, and no label sends the
    driver more than per_label rows. A share of each label that should hold twice as many is drawn first.
    """
    drawn, _ = drawn_labels(rows, "draw", label, 2 * per_label + 20, 0)
    first = Window.partitionBy(label).orderBy("draw", "text")
    drawn = drawn.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= per_label)
    out = pd.DataFrame([r.asDict() for r in drawn.select("text", label).collect()], columns=["text", label])
    # the order of collected rows depends on the partitions: sort, so that reruns learn the same
    return out.sort_values([label, "text"], kind="stable", ignore_index=True)


class WordTable:
    """Rows of numbers for words, made in batches by `fill` when a word is first met and kept in the worker process.

    It holds at most `limit` words and then starts anew, so its memory is bounded whatever the corpus.
    """

    def __init__(self, key: str, fill: Callable[[list[bytes]], np.ndarray], width: int, limit: int, dtype=np.float32) -> None:
        kept = process_cache("words")
        if kept.get("key") != key:
            kept.clear()
            kept.update(key=key, ids={}, rows=np.zeros((1024, width), dtype))
        self.kept, self.fill, self.limit = kept, fill, limit

    def look_up(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """For each document the rows of its words."""
        ids = self.kept["ids"]
        seen: set[bytes] = set().union(*docs) if docs else set()
        new = seen.difference(ids)
        if len(ids) + len(new) > self.limit:
            ids.clear()
            new = seen
        if new:
            words = sorted(new, key=lambda w: (len(w), w))
            rows, first = self.kept["rows"], len(ids)
            if first + len(words) > len(rows):
                grown = np.zeros((2 * (first + len(words)), rows.shape[1]), rows.dtype)
                grown[:first] = rows[:first]
                self.kept["rows"] = rows = grown
            rows[first : first + len(words)] = self.fill(words)
            ids.update(zip(words, range(first, first + len(words)), strict=True))
        rows, get = self.kept["rows"], ids.__getitem__
        return [rows[np.fromiter(map(get, d), np.int64, len(d))] for d in docs]
