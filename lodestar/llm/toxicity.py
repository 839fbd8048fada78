"""Toxicity: noisy-channel restoration of obfuscated words, then a linear score of the restored text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lodestar.llm.common import bucket_of, written
from lodestar.llm.labelled import training_labels
from lodestar.llm.tokens import process_cache

# fixed values: which letters a look-alike character may stand for
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
# fixed values: letters of other scripts that look like one of a to z
CONFUSABLE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t",
}
SEPARATORS = " .-_*'~,/\\+|"
#: Symbols of the character model: word boundary, a to z, any other letter.
EDGE, OTHER, SIZE = 0, 27, 28
#: Channel costs in nats: a look-alike, a separator inside a word, a word end there, a repeated letter dropped, a symbol dropped.
LOOK, INSIDE, BREAK, REPEAT, DROP = 0.5, 0.3, 2.0, 0.2, 3.0
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_MIXED = re.compile("[a-z][{0}]|[{0}][a-z]".format("".join(CONFUSABLE)))
_DOUBLE, _TRIPLE = re.compile(r"([^\W\d_])\1"), re.compile(r"(.)\1\1")
_ODD = re.compile(r"(.)\1\1|[^\W\d_][^\w\s]+[^\W\d_]|[^\W_][0-9@$!|+(€£¡]+[^\W_]|[0-9@$!|+(€£¡][^\W\d_]|[^\W\d_][0-9@$|€£]|_")
_ENDS = ".,;:!?\"'()[]{}<>#%&*|~^-_=/\\…«»“”‘’"


def symbol(c: str) -> int:
    k = ord(c)
    return k - 96 if 97 <= k <= 122 else OTHER


def trigram_frames(batches):
    """Counts of letter trigrams, with word edges, over all words of the task's texts."""
    total = np.zeros(SIZE**3)
    for frame in batches:
        words = Counter()
        for text in frame["text"]:
            words.update(text.lower().split())
        clean = Counter()
        for w, n in words.items():
            if (core := w.strip(_ENDS)).isalpha():
                clean[core] += n
        if clean:
            flat = np.frombuffer("\0\0".join(["", *clean, ""]).encode("utf-32-le"), np.uint32)
            codes = np.where(flat == 0, EDGE, np.where((flat >= 97) & (flat <= 122), flat.astype(np.int64) - 96, OTHER))
            # each word lies between two pairs of edges; a trigram counts as often as the word it ends in or closes
            starts = np.cumsum([2, *(len(w) + 2 for w in clean)])[:-1]
            weight = np.zeros(len(codes))
            for at, w, n in zip(starts.tolist(), clean, clean.values(), strict=True):
                weight[at : at + len(w) + 1] = n
            tri = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
            total += np.bincount(tri, weight[2:], SIZE**3)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"gram": at, "n": total[at].astype(np.int64)})


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs -log P(c | a, b), interpolated with shorter contexts."""
    c3 = counts.reshape(SIZE, SIZE, SIZE)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + SIZE)
    p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each observed character the ways to read it: a letter, nothing (""), or a word end (" "), with costs."""
    out, before = [], ""
    for c in token:
        ways = []
        if c.isalpha():
            ways.append((c, 0.0))
            if c in CONFUSABLE:
                ways.append((CONFUSABLE[c], LOOK))
            if c == before:
                ways.append(("", REPEAT))
        else:
            ways += [(x, LOOK) for x in LOOKS.get(c, "")]
            if c in SEPARATORS or c.isspace():
                ways += [("", INSIDE), (" ", BREAK)]
            elif c == before:
                ways.append(("", REPEAT))
            else:
                ways.append(("", DROP))
        out.append(ways)
        before = c
    return out


def decode(token: str, costs: list) -> list[str]:
    """The cheapest reading of a token under channel and character model, as words (Viterbi over pairs of letters)."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
    for ways in lattice(token):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for read, extra in ways:
                total = cost + extra
                if not read:
                    state, step = (a, b), path
                elif read == " ":
                    if b == EDGE:
                        state, step = (a, b), path
                    else:
                        state, step, total = (EDGE, EDGE), (" ", path), total + costs[a][b][EDGE]
                else:
                    s = symbol(read)
                    state, step, total = (b, s), (read, path), total + costs[a][b][s]
                if state not in new or total < new[state][0]:
                    new[state] = total, step
        states = new
    ends = [(cost + (costs[a][b][EDGE] if b != EDGE else 0.0), i, path) for i, ((a, b), (cost, path)) in enumerate(states.items())]
    path, out = min(ends, key=lambda x: x[:2])[2], []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)).split()


def restored(token: str, costs: list) -> list[str]:
    """The words that a lower-cased token stands for; only odd tokens are decoded.

    A word with one doubled letter stands for itself and for the word without the doubling, since either is common;
    with more doublings, or a letter three times, it is odd.
    """
    core = token.strip(_ENDS)
    if core.isalpha() and not _TRIPLE.search(core) and not _MIXED.search(core):
        lead = token[: token.find(core)]
        if not lead or lead[-1] not in LOOKS or len(set(lead)) < len(lead):
            doubles = len(_DOUBLE.findall(core))
            return [core] if not doubles else [core, _DOUBLE.sub(r"\1", core)] if doubles == 1 else [core, *decode(core, costs)]
    whole = token.rstrip(_ENDS).lstrip("".join(c for c in _ENDS if c not in LOOKS))
    if any(c.isalpha() for c in whole) and (_ODD.search(whole) or _MIXED.search(whole)):
        return decode(whole, costs)
    return [core] if core else []


def marks(word: str) -> list[str]:
    """The features of a word: itself and its first 4, 5 and 6 letters."""
    return ["=" + word, *(word[:k] for k in (4, 5, 6) if len(word) > k)]


def text_words(text: str, costs: list, cache: dict, most: int = 100_000) -> set[str]:
    """The distinct restored words of a whole text, spaced-out words included."""
    text = text.lower()
    out: set[str] = set()
    if len(cache) > most:
        cache.clear()
    for token in set(text.split()):
        if (got := cache.get(token)) is None:
            got = cache[token] = tuple(restored(token, costs))
        out.update(got)
    for run in _SPACED.findall(text):
        out.update(decode(run, costs))
    return out


def toxicity_scorer(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0,
    sample: int = 20_000, least_texts: int = 3, least_odds: float = 0.7,
) -> Callable[[Column], Column]:
    """Learns from the texts and labels; returns the function from a text column to its score column (0 to 1).

    The character model counts the letter trigrams of all texts (a table of fixed size). The linear model is fitted on at
    most `sample` labelled rows outside the held-out fold, on all their features that at least `least_texts` toxic ones
    have and whose log odds for toxic texts exceed `least_odds`; the bound on the rows bounds what the driver gathers and the
    tasks receive. Scoring reads each text once and shuffles nothing.

    Cases: null text is empty, and an empty text scores the base rate; null ids and labels other than 0 and 1 are
    not learnt from; without labels every score is 0.
    """
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    grams = texts.select("text").mapInPandas(trigram_frames, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3)
    counts[grams["gram"].to_numpy(int)] = grams["n"]
    table = language_model(counts)
    stamp = f"restored {zlib.crc32(counts.tobytes())}"

    def learn(batches):
        costs, cache = table.tolist(), process_cache(stamp)
        for frame in batches:
            found = [sorted({m for w in text_words(t, costs, cache) for m in marks(w)}) for t in frame["text"]]
            yield pd.DataFrame({"y": frame["y"], "features": found})

    chosen = training_labels(labels, id_col, label_col, folds, held_out, sample)
    known = written(texts.join(F.broadcast(chosen), "id").mapInPandas(learn, "y int, features array<string>").withColumn("uid", F.monotonically_increasing_id()), "toxic-features")
    totals = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    n1, n0 = totals.t, totals.n - totals.t
    spread = known.select("uid", "y", F.explode("features").alias("f"))
    held = spread.groupBy("f").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (n0 + 1.0))
    telling = written(held.where((F.col("t") >= least_texts) & (odds > least_odds)).select("f"), "toxic-telling")
    index = {r.f: i for i, r in enumerate(telling.orderBy("f").collect())}
    sets = spread.join(telling, "f").groupBy("uid").agg(F.max("y").alias("y"), F.sort_array(F.collect_list("f")).alias("f"))
    grouped = sets.groupBy("f").agg(F.sum("y").alias("t"), F.count("*").alias("n")).collect()
    rest = totals.n - sum(r.n for r in grouped), totals.t - sum(r.t for r in grouped)
    grouped += [Row(f=[], t=rest[1], n=rest[0])] if rest[0] else []
    bias, weights = fit([[index[f] for f in r.f] for r in grouped], np.array([r.t for r in grouped], float), np.array([r.n for r in grouped], float), len(index))
    scale = dict(zip(index, weights.tolist(), strict=True))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        costs, cache, told = table.tolist(), process_cache(stamp), process_cache(f"{stamp} told {bias} {len(scale)}")
        for texts in parts:
            out = []
            for text in texts:
                seen = set()
                for w in text_words(text or "", costs, cache):
                    if (got := told.get(w)) is None:
                        if len(told) > 300_000:
                            told.clear()
                        got = told[w] = tuple(m for m in marks(w) if m in scale)
                    seen.update(got)
                out.append(bias + sum(scale[m] for m in sorted(seen)))
            z = np.clip(np.array(out, float), -40, 40)
            yield pd.Series(1 / (1 + np.exp(-z)) if n1 else np.zeros(len(z)))

    return score


def toxicity_scores(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0,
    threshold: float = 0.5, **options,
) -> DataFrame:
    """Scores every text for toxicity: id, held_out, score, predicted (see toxicity_scorer).

    Null ids are held_out = null; rows that repeat an id are scored each; an empty table gives an empty result; other
    columns are ignored.
    """
    score = toxicity_scorer(df, labels, id_col, text_col, label_col, folds, held_out, **options)
    out = df.select(F.col(f"`{id_col}`").alias(id_col), (bucket_of(F.col(f"`{id_col}`"), folds) == held_out).alias("held_out"), score(F.col(f"`{text_col}`")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(df: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of df, all columns kept, whose text scores under the threshold."""
    return df.where(toxicity_scorer(df, labels, text_col=text_col, **options)(F.col(f"`{text_col}`")) < threshold)


def fit(rows: list[list[int]], toxic: np.ndarray, total: np.ndarray, n: int, l2: float = 0.05, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression on sets of features, `total` texts with each set of which `toxic` are labelled 1."""
    bias, w = 0.0, np.zeros(n)
    if not total.sum():
        return bias, w
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    f = np.array([i for r in rows for i in r], np.int64)
    often = np.bincount(f, total[at], n) + l2
    rate = (toxic.sum() + 0.5) / (total.sum() + 1)
    bias = float(np.log(rate / (1 - rate)))
    m = [np.zeros(n + 1), np.zeros(n + 1)]
    for k in range(1, rounds + 1):
        z = bias + np.bincount(at, w[f], len(rows))
        err = total / (1 + np.exp(-np.clip(z, -40, 40))) - toxic
        grad = np.append((np.bincount(f, err[at], n) + l2 * w) / often, err.sum() / total.sum())
        m = [0.9 * m[0] + 0.1 * grad, 0.99 * m[1] + 0.01 * grad**2]
        step = 0.1 * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.99**k)) + 1e-8)
        w, bias = w - step[:n], bias - float(step[n])
    return bias, w
