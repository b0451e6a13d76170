"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted on the driver on a bounded sample of labelled rows (``max_train`` rows with the
smallest hash of their id; the only bounded part) and flattened into numpy node arrays, with which
every document is scored where it is read. Where more symbols, repeated lines or repeated words can
only make a text worse, the trees are held monotonic. A document fails without the model when it has
few words or is mostly repetition.

Defined results: a null or empty text has no words and fails; without usable labels of both classes
the model keeps all that the base rules keep; repeated rows are judged each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm import boosting
from tagloom.llm.common import bounded, numbered, slices

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Features, and whether the chance of being good may only rise (1) or fall (-1) with them.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": 0, "digit_share": 0, "punct_share": 0, "distinct_share": 0, "words_per_line": 0,
    "bar_words": -1, "other_share": 0,
}
_UPPER, _DIGITS, _LETTERS, _PUNCT = (bytes(r) for r in (range(65, 91), range(48, 58), [*range(65, 91), *range(97, 123)], b".,;:!?'\"()-"))
_SPACE = b" \t\n\x0b\x0c\r"


def statistics(text: str) -> tuple[list[int], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the features."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    chars = len(text) - (size - sum(map(len, words)))
    symbols = size - len(raw.translate(None, SYMBOLS))
    lines = Counter(raw.split(b"\n")) if b"\n" in raw else {raw: 1}
    blank = sum(k for line, k in lines.items() if not line.strip())
    n_lines = sum(lines.values()) - blank
    dup_lines = sum(k - 1 for line, k in lines.items() if k > 1 and line.strip())
    repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    if windows and len(counts := Counter(windows)) < len(windows):
        hit = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : k + len(hit)] |= hit
        repeat = int(cover.sum())
    share = lambda chosen: (size - len(raw.translate(None, chosen))) / max(1, size)
    features = [
        float(np.log1p(n)), chars / max(1, n), symbols / max(1, n), dup_lines / max(1, n_lines), repeat / max(1, n),
        share(_UPPER), share(_DIGITS), share(_PUNCT), len(set(words)) / max(1, n), n / max(1, n_lines),
        words.count(b"|") / max(1, n), 1 - share(_LETTERS) - share(_DIGITS) - share(_PUNCT) - share(_SPACE),
    ]
    return [n, chars, symbols, dup_lines, repeat], features


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


@dataclass(frozen=True)
class Model:
    forest: boosting.Forest | None
    threshold: float

    def keeps(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.forest is None:
            return np.ones(len(features), bool), np.zeros(len(features))
        odds = self.forest.score(features)
        return odds >= self.threshold, 1 / (1 + np.exp(-odds))


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_statistics(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, the five base statistics and ``features`` of every row."""
    source = docs.select(*carry, F.col(text_col).alias("_text"))
    kinds = [to_arrow_type(source.schema[c].dataType) for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *kept, texts in slices(batches):
            got = [statistics(t or "") for t in texts]
            arrays = [pa.array(v, k) for v, k in zip(kept, kinds)]
            arrays += [pa.array([g[0][i] for g in got], pa.int64()) for i in range(5)]
            arrays.append(pa.array([g[1] for g in got], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(arrays, [*carry, *_BASE, "features"])

    types = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carry]
    return bounded(source).mapInArrow(run, ", ".join([*types, *(f"{b} bigint" for b in _BASE), "features array<double>"]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 4000, keep_good: float = 0.999) -> Model:
    """Fit on at most ``max_train`` labelled rows. A fifth of them sets the threshold: the highest
    that keeps the share ``keep_good`` of its good rows, and is not above even odds."""
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .where("_id is not null and _y in (0, 1)")
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # at most max_train ids
    got = document_statistics(rows, "_text", ("_id", "_y")).orderBy(F.xxhash64("_id"), "_id", *_BASE).limit(2 * max_train).collect()
    got = [r for r in got if not base_failed(r["n_words"], r["n_repeat_words"])]
    if len({r["_y"] for r in got}) < 2:
        return Model(None, 0.0)
    x, y = np.array([r["features"] for r in got], float), np.array([r["_y"] for r in got], float)
    held = np.arange(len(y)) % 5 == 4
    forest = boosting.fit(x[~held], y[~held], tuple(FEATURES.values()))
    odds = np.sort(forest.score(x[held & (y == 1)]))
    threshold = float(odds[int((1 - keep_good) * len(odds))]) - 1e-9 if len(odds) else 0.0
    return Model(forest, min(threshold, 0.0))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base statistics, ``base_failed``, ``quality`` (probability) and ``kept``."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = to_arrow_type(source.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            got = [statistics(t or "") for t in texts]
            base = np.array([g[0] for g in got], np.int64)
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
            keeps, quality = model.keeps(np.array([g[1] for g in got], float))
            arrays = [pa.array(ids, kind), *(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(quality), pa.array(keeps & ~failed)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *_BASE, "base_failed", "quality", "kept"])

    types = ", ".join(f"{b} bigint" for b in _BASE)
    out = bounded(source).mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, {types}, base_failed boolean, quality double, kept boolean")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rules and the model keep, with all their columns."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                got = [statistics(t or "") for t in part.column(at).to_pylist()]
                keeps, _ = model.keeps(np.array([g[1] for g in got], float))
                kept = part.filter(pa.array(keeps & np.array([not base_failed(g[0][0], g[0][4]) for g in got])))
                yield pa.RecordBatch.from_arrays(kept.columns, schema.names)

    return numbered(docs).mapInArrow(run, schema)
