"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into quantile bins. Cyclic boosting visits the features in turn and fits a shallow tree to the
current gradients of that feature's bins alone; the trees of a feature add up to one look-up table. Then the pairs with the
largest remaining interaction get tables of their own in the same way. A score is the sigmoid of the intercept and the
tables' entries at the text's bins: additions of looked-up numbers, a batch at a time.

The model is fitted on the driver on at most SAMPLE labelled rows (those with the smallest hashes of their doc_id); every row
is scored, over its whole text. Labels, language, source and doc_id are never features.

Defined results: a null text is scored as empty, and an empty text gets a score as any other (all features zero). A null
doc_id is not held out and is never learnt from. Labels other than 0 and 1 are left out; without labels of both
kinds every score is the prior. Repeated rows get equal scores. An empty table gives no rows. Extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrail.llm.bpe import forget_pieces, map_texts
from vitrail.llm.common import fresh

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
FEATURES = (
    "log_words", "word_bytes", "upper", "symbols", "exclamations", "digits", "stops", "non_ascii",
    "distinct_words", "next_word_same", "repeated_lines", "line_words", "short_words",
)
_SYMBOLS = np.zeros(256)
_SYMBOLS[list(b"#*$%&|<>{}[]~^\\@=+_")] = 1


def features(text: str) -> list[float]:
    """The features of a whole text, in the order of FEATURES."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, size = len(words), len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        seen[65:91].sum() / size,
        float(seen @ _SYMBOLS) / size,
        seen[33] / size,
        seen[48:58].sum() / size,
        (seen[44] + seen[46] + seen[58] + seen[59]) / size,
        seen[128:].sum() / size,
        len(set(words)) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        float((lengths <= 3).mean()),
    ]


@dataclass
class Model:
    """Bin edges of each feature, the tables by feature and by pair, and the intercept."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: int = 4

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        at = self.bins(x)
        for table, b in zip(self.tables, at):
            total += table[b]
        for table, (i, j) in zip(self.pair_tables, self.pairs):
            total += table[at[i] // self.coarse, at[j] // self.coarse]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree over ordered bins: value of each bin. Splits are taken by gain until there are `leaves` leaves."""
    cuts, gain_of = [0, len(g)], lambda a, b: a * a / (b + ridge)
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(cuts) - 1 < leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gain = gain_of(cg[m] - cg[a], ch[m] - ch[a]) + gain_of(cg[b] - cg[m], ch[b] - ch[m]) - gain_of(cg[b] - cg[a], ch[b] - ch[a])
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], int(m[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a], ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best tree over a pair's grid that cuts each side once: gain and the value of each cell."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, cut = -1.0, (1, 1)
    n, m = g.shape
    a, b = np.meshgrid(np.arange(1, n), np.arange(1, m), indexing="ij")

    def part(c: np.ndarray) -> list[np.ndarray]:
        return [c[a, b], c[a, m] - c[a, b], c[n, b] - c[a, b], c[n, m] - c[a, m] - c[n, b] + c[a, b]]

    pg, ph = part(cg), part(ch)
    gain = sum(x * x / (y + ridge) for x, y in zip(pg, ph)) - cg[n, m] ** 2 / (ch[n, m] + ridge)
    if gain.size:
        k = np.unravel_index(int(gain.argmax()), gain.shape)
        best, cut = float(gain[k]), (int(k[0]) + 1, int(k[1]) + 1)
    out = np.empty((n, m))
    for rows in (slice(0, cut[0]), slice(cut[0], n)):
        for cols in (slice(0, cut[1]), slice(cut[1], m)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum(), ridge)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 4, rounds: int = 120, rate: float = 0.15, leaves: int = 3, pairs: int = 4, pair_rounds: int = 40, ridge: float = 1.0) -> Model:
    """Fit by cyclic boosting on features x and labels y (0 or 1)."""
    model = Model(coarse=coarse)
    n = len(y)
    prior = (float(np.sum(y)) + 1) / (n + 2)
    model.intercept = float(np.log(prior / (1 - prior)))
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    model.edges = [np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins)) if n else np.zeros(0) for k in range(width)]
    model.tables = [np.zeros(bins + 1) for _ in range(width)]
    if len(np.unique(y)) < 2:
        return model
    at, total = model.bins(x), np.full(n, model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k in range(width):
            g, h = gradients()
            size = len(model.edges[k]) + 1
            step = rate * _tree(np.bincount(at[k], g, size), np.bincount(at[k], h, size), leaves, ridge)
            model.tables[k][:size] += step
            total += step[at[k]]
    side = bins // coarse + 1

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = gradients()
        cell = at[i] // coarse * side + at[j] // coarse
        return cell, np.bincount(cell, g, side * side).reshape(side, side), np.bincount(cell, h, side * side).reshape(side, side)

    ranked = sorted(combinations(range(width), 2), key=lambda p: -_quadrants(*grid(*p)[1:], ridge)[0])
    model.pairs = ranked[:pairs]
    model.pair_tables = [np.zeros((side, side)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for k, pair in enumerate(model.pairs):
            cell, g, h = grid(*pair)
            step = rate * _quadrants(g, h, ridge)[1]
            model.pair_tables[k] += step
            total += step.ravel()[cell]
    return model


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the doc_id as text leaves 1 when divided by three."""
    of = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(of.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, **how) -> Model:
    """Fit on labelled documents that aren't held out, `sample` of them at most."""
    wanted = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(doc_id))
    wanted = wanted.select(F.col(doc_id).cast("bigint").alias("id"), F.col(label).cast("int").alias("y"))
    wanted = wanted.orderBy(F.xxhash64("id"), "id", "y").limit(sample)  # at most `sample` rows, so they may be broadcast
    met = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).join(F.broadcast(wanted), "id")
    made = with_features(met, "text", "x").select("id", "y", "x").orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    rows = made.toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array(rows["y"].to_pylist(), float), **how)


def with_features(df: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """Add the features of each text as array<double>."""

    def make():
        forget_pieces()
        return lambda texts: {out: pa.array([features(t) for t in texts], pa.list_(pa.float64()))}

    return map_texts(df, text, make, {out: "array<double>"})


def with_scores(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the model's score of each whole text, 0 to 1."""

    def make():
        forget_pieces()
        return lambda texts: {out: pa.array(model.score(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))))}

    return map_texts(df, text, make, {out: "double"})


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn and score: one row per document with doc_id, held_out, score, predicted."""
    model = learn(docs, labels, "quality", doc_id, text)
    scored = with_scores(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the classifier predicts to be good, in their own columns."""
    (score,) = fresh(docs, "score")
    return with_scores(docs, learn(docs, labels, "quality", doc_id, text), text, score).where(F.col(score) >= 0.5).select(docs.columns)
