"""Quality classifier: a generalised additive model with pairwise interactions, boosted in cycles."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bucket_of, written
from lodestar.llm.labelled import training_labels

FEATURES = [
    "words", "word_length", "upper", "digits", "symbols", "pipes", "marks", "other_ascii", "beyond_ascii", "distinct", "top_share",
    "dup_lines", "line_length", "ended_lines", "lower_start", "doubled", "longest_word", "noisy_words",
]
_SYMBOLS = np.frombuffer(b"#*$%&<>~^_=+@", np.uint8)
_MARKS = np.frombuffer(b"!?", np.uint8)


def features(text: str) -> list[float]:
    """Figures of a whole text; all are shares or logarithms, and zero for an empty text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    held = np.bincount(data, minlength=256)
    space = held[[9, 10, 11, 12, 13, 32]].sum()
    shown = max(1, len(data) - space)
    letters = max(1, held[65:91].sum() + held[97:123].sum() + held[128:].sum())
    symbols, pipes, marks, digits = held[_SYMBOLS].sum(), held[124], held[_MARKS].sum(), held[48:58].sum()
    known = symbols + pipes + marks + digits + held[65:91].sum() + held[97:123].sum() + held[128:].sum() + held[44] + held[46]
    count = Counter(words)
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    doubled = sum(map(str.__eq__, words, words[1:]))
    clean = sum(map(str.isalpha, count))
    return [
        float(np.log1p(len(words))), shown / len(words), held[65:91].sum() / letters, digits / shown, symbols / shown, pipes / len(words), marks / len(words),
        (shown - known) / shown, held[128:].sum() / shown, len(count) / len(words), count.most_common(1)[0][1] / len(words),
        1 - len(set(lines)) / len(lines), float(np.log1p(len(text) / len(lines))), sum(x[-1] in ".!?\"'" for x in lines) / len(lines),
        sum(x[0].islower() for x in lines) / len(lines), doubled / len(words), float(np.log1p(max(map(len, count)))), 1 - clean / len(count),
    ]


def feature_frames(batches):
    for frame in batches:
        x = [features(t) for t in frame["text"]]
        yield pd.DataFrame({"id": frame["id"], "x": x})


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, rate: float, l2: float) -> np.ndarray:
    """The steps of a shallow regression tree over ordered bins: the best splits are taken greedily."""
    n, cuts = len(grad), [0, len(grad)]
    g, h = np.concatenate([[0], grad.cumsum()]), np.concatenate([[0], hess.cumsum()])
    score = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + l2)
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = score(a, k) + score(k, b) - score(a, b)
                gain[(h[k] - h[a] < 1) | (h[b] - h[k] < 1)] = -1
                j = int(gain.argmax())
                best = max(best, (float(gain[j]), int(k[j])), key=lambda t: t[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(n)
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = rate * (g[b] - g[a]) / (h[b] - h[a] + l2)
    return out


def _tree2(grad: np.ndarray, hess: np.ndarray, rate: float, l2: float) -> np.ndarray:
    """The steps of a two-level tree over a grid of bins: one cut of an axis, then one cut of the other axis in each half."""
    best_gain, best = 0.0, np.zeros_like(grad)
    for flip in (False, True):
        g, h = (grad.T, hess.T) if flip else (grad, hess)
        for cut in range(1, len(g)):
            step, gain = np.zeros_like(g), -(g.sum() ** 2) / (h.sum() + l2)
            for part in (slice(0, cut), slice(cut, None)):
                gs, hs = g[part].sum(axis=0), h[part].sum(axis=0)
                tree = _tree(gs, hs, 2, 1.0, l2)
                step[part] = tree
                gain += float((gs * tree).sum())
            if gain > best_gain:
                best_gain, best = gain, rate * (step.T if flip else step)
    return best


class Gam:
    """Lookup tables by binned feature and by pair of coarsely binned features, on the logit scale."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 48, pairs: int = 6, pair_rounds: int = 30, grid: int = 8, l2: float = 2.0):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, grid + 1)[1:-1])) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        rate_of = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(rate_of / (1 - rate_of)))
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        at = self._bins(x, self.edges)
        logit = np.full(len(y), self.base)
        for _ in range(rounds):
            for f, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-logit))
                step = _tree(np.bincount(at[f], y - p, len(table)), np.bincount(at[f], p * (1 - p), len(table)), 3, rate, l2)
                table += step
                logit += step[at[f]]
        for f, table in enumerate(self.tables):  # each table has mean zero over the training rows
            mean = table[at[f]].mean()
            table -= mean
            self.base += float(mean)
        rough = self._bins(x, self.coarse)
        p = 1 / (1 + np.exp(-logit))
        grids = {}
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                if (gain := float((_tree2(*self._grid(rough, i, j, y - p, p * (1 - p)), 1.0, l2) * self._grid(rough, i, j, y - p, p)[0]).sum())) > 0:
                    grids[i, j] = gain
        for i, j in sorted(grids, key=grids.get, reverse=True)[:pairs]:
            self.pairs.append((i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))))
        for _ in range(pair_rounds):
            for i, j, table in self.pairs:
                p = 1 / (1 + np.exp(-logit))
                step = _tree2(*self._grid(rough, i, j, y - p, p * (1 - p)), rate, l2)
                table += step
                logit += step[rough[i], rough[j]]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]

    def _grid(self, rough, i, j, grad, hess):
        shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
        at = rough[i] * shape[1] + rough[j]
        return np.bincount(at, grad, shape[0] * shape[1]).reshape(shape), np.bincount(at, hess, shape[0] * shape[1]).reshape(shape)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: bin every column, add up the tables."""
        logit = np.full(len(x), self.base)
        for table, at in zip(self.tables, self._bins(x, self.edges), strict=True):
            logit += table[at]
        rough = self._bins(x, self.coarse)
        for i, j, table in self.pairs:
            logit += table[rough[i], rough[j]]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def quality_scores(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_out: int = 2,
    threshold: float = 0.7, sample: int = 40_000,
) -> DataFrame:
    """Scores every text for quality: id, held_out, score (0 to 1), predicted.

    One pass turns texts into a row of figures each, which is written; at most `sample` labelled rows outside the
    held-out fold are fitted on the driver (figures only); the lookup tables, a few kilobytes, go with the tasks.

    Cases: null text is empty, and empty texts are scored by the same tables; null ids are held_out = null and
    never learnt from; labels other than 0 and 1 are ignored; rows that repeat an id are scored each; without any
    label every score is 0.5; an empty table gives an empty result; other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    figures = written(texts.mapInPandas(feature_frames, f"id {kind}, x array<double>"), "features")
    chosen = training_labels(labels, id_col, label_col, folds, held_out, sample)
    known = figures.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "x").limit(sample).select("x", "y").toPandas()
    x = np.stack(known["x"].to_numpy()) if len(known) else np.zeros((0, len(FEATURES)))
    model = Gam(x, known["y"].to_numpy(np.float64)) if len(known) else None

    def run(batches):
        for frame in batches:
            if len(frame):
                x = np.stack(frame["x"].to_numpy())
                yield pd.DataFrame({"id": frame["id"], "score": model.score(x) if model else np.full(len(x), 0.5)})

    out = figures.mapInPandas(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), (bucket_of("id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
