"""Quality classifier: a generalised additive model with pairwise interactions.

Trained by cyclic boosting: round after round, feature after feature, a tree of a few leaves is fitted to
what is left and added to the feature's lookup table over its bins. Then pairs of features are ranked by how
much a two-way split lowers the rest, and the best ones get tables over pairs of bins the same way. A score
is the logistic of the sum of the looked-up values, so scoring is vectorised additions.

Training takes a bounded sample of labelled rows (``SAMPLE_ROWS``, those with the smallest hash of their id);
everything else covers all documents. Features are of the text alone.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import sampled, table, trim, unused
from tidemark.llm.shared import rolling

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, LEAVES, RATE = 48, 12, 150, 60, 8, 4, 0.08
FEATURES = (
    "log_words", "word_length", "symbols", "capitals", "exclamations", "bars", "digits", "non_ascii", "distinct_words",
    "top_word", "repeated_lines", "ended_lines", "line_words", "marked_words", "shouted_words", "repeated_fives", "long_words",
)
_UPPER, _DIGITS, _BLANK = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c"
_ASCII = bytes(range(128))


def features(text: str | None) -> tuple[float, ...]:
    """Measures of a whole text; all defined, and 0 for the most part, where it is null or empty."""
    raw = (text or "").encode()
    words = raw.split()
    n, dense = len(words), raw.translate(None, _BLANK)
    size = max(1, len(dense))
    dropped = lambda chars: (len(dense) - len(dense.translate(None, chars))) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    fives = np.sort(rolling(np.fromiter(map(hash, words), np.int64, n).view(np.uint64), 5))
    per_word, per_line = 1 / max(1, n), 1 / max(1, len(lines))
    return (
        math.log1p(n), size * per_word, dropped(b"#*$%&|<>"), dropped(_UPPER), dropped(b"!"), dropped(b"|"), dropped(_DIGITS),
        len(dense.translate(None, _ASCII)) / size, len(counts) * per_word, max(counts.values(), default=0) * per_word,
        1 - len(set(lines)) * per_line, sum(x.rstrip()[-1:] in b".!?:;" for x in lines) * per_line, n * per_line,
        sum(w[-1:] in b"#*$%&" for w in words) * per_word, sum(w.isupper() for w in words) * per_word,
        np.count_nonzero(fives[1:] == fives[:-1]) / max(1, len(fives)), sum(len(w) > 24 for w in words) * per_word,
    )


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edges, x[:, f])]
        for a, b, values in self.pairs:
            out += values[np.searchsorted(self.pair_edges[a], x[:, a]), np.searchsorted(self.pair_edges[b], x[:, b])]
        return 1 / (1 + np.exp(-out))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.empty(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Value per bin of the regression tree that splits an ordered range of bins best-first."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)

    def best(a, b):
        if b - a < 2:
            return (-1.0, a, a, b)
        m = np.arange(a + 1, b)
        x = (G[m] - G[a]) ** 2 / (H[m] - H[a] + 1.0) + (G[b] - G[m]) ** 2 / (H[b] - H[m] + 1.0) - gain(a, b)
        return (float(x.max()), int(m[x.argmax()]), a, b)

    parts = [best(0, len(g))]
    while len(parts) < leaves and (top := max(parts))[0] > 1e-9:
        parts.remove(top)
        parts += [best(top[2], top[1]), best(top[1], top[3])]
    out = np.zeros(len(g))
    for _, _, a, b in parts:
        out[a:b] = value(a, b)
    return out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """x: rows of features; y: 0 or 1. With one class only, or no rows, every score is that class's share."""
    share = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5
    edges = [_edges(x[:, f], BINS) for f in range(len(FEATURES))]
    pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(len(FEATURES))]
    model = Model(math.log(share / (1 - share)), edges, [np.zeros(len(e) + 1) for e in edges], pair_edges, [])
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)]
    logit = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            p = 1 / (1 + np.exp(-logit))
            k = len(edges[f]) + 1
            step = RATE * _tree(np.bincount(b, y - p, k), np.bincount(b, p * (1 - p), k), LEAVES)
            model.tables[f] += step
            logit += step[b]
    p = 1 / (1 + np.exp(-logit))
    small = [np.searchsorted(e, x[:, f]) for f, e in enumerate(pair_edges)]

    def halves(cell, k):
        """Per pair of halves of the bins, at the best pair of cuts: its gain, and the values it gives each cell."""
        G, H = (np.cumsum(np.cumsum(np.bincount(cell, w, k[0] * k[1]).reshape(k), 0), 1) for w in (y - p, p * (1 - p)))
        quarters = lambda S: (S, S[-1:, :] - S, S[:, -1:] - S, S[-1, -1] - S[-1:, :] - S[:, -1:] + S)
        q = [(g, h) for g, h in zip((G, G[-1:, :] - G, G[:, -1:] - G, G[-1, -1] - G[-1:, :] - G[:, -1:] + G), quarters(H), strict=True)]
        gain = sum(g * g / (np.maximum(h, 0) + 1.0) for g, h in q)
        i, j = np.unravel_index(int(gain.argmax()), k)
        v = [float(g[i, j] / (max(h[i, j], 0) + 1.0)) for g, h in q]
        out = np.empty(k)
        out[: i + 1, : j + 1], out[i + 1 :, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, j + 1 :] = v
        return float(gain.max()), out

    ranked = []
    for a in range(len(FEATURES)):
        for b in range(a + 1, len(FEATURES)):
            k = (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
            ranked.append((halves(small[a] * k[1] + small[b], k)[0], a, b, k))
    best = [(a, b, k, small[a] * k[1] + small[b], np.zeros(k)) for _, a, b, k in sorted(ranked, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for _, _, k, cell, values in best:
            p = 1 / (1 + np.exp(-logit))
            step = RATE * halves(cell, k)[1]
            values += step
            logit += step.ravel()[cell]
    model.pairs = [(a, b, values) for a, b, _, _, values in best]
    return model


def _measured(rows: DataFrame) -> DataFrame:
    """(label, features) of rows (label, text)."""
    schema = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py()) for t in b.column(1)], schema.field(1).type)], schema=schema)

    return rows.mapInArrow(measure, "label int, x array<double>")


def held_out(doc_id):
    """False for a null doc_id, which has no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows=SAMPLE_ROWS, id_col="doc_id", text_col="text", label_col="quality") -> Model:
    """Trained on labelled rows that aren't held out, ``sample_rows`` labels and twice as many rows of theirs at most. Rows without
    an id, a label or a document are left aside."""
    picked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("_id is not null and label is not null")
    picked = sampled(picked.where(~held_out(F.col("_id"))), F.col("_id"), sample_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id").select("label", "text")
    # the features, not the texts, come together in one place
    found = sorted((r[0], tuple(r[1])) for r in _measured(rows).orderBy(F.xxhash64("label", "x")).limit(2 * sample_rows).collect())
    return train(np.array([r[1] for r in found]).reshape(-1, len(FEATURES)), np.array([float(r[0]) for r in found]))


def score_documents(docs: DataFrame, model: Model, score_col="score", text_col="text") -> DataFrame:
    """The rows, all columns kept, and as the last column their score, with underscores before its name while another column is called
    so. A null text scores as an empty one; repeated rows score alike; an empty table gives no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructType

    out = StructType([*docs.schema.fields]).add(unused(docs, score_col), DoubleType())
    at = docs.columns.index(text_col)
    arrow = to_arrow_schema(out)

    def scored(batches):
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(at)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, arrow, strict=False)] + [pa.array(model.score(x))], schema=arrow)
        trim()

    return docs.mapInArrow(scored, out)


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
