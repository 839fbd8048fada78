"""Language-model scores of whole texts: corpus word counts, distributed training, one scoring pass."""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import lm
from lodestar.llm.common import bucket_of, written
from lodestar.llm.tokens import ByteWords, default_path, groups_of, words_of

#: The id of the end of a text.
END_ID = 49407


def count_words(batches, most: int = 300_000):
    """(word, n) of the texts, the end of a text being the empty word; counts are handed on when there are many."""
    total: Counter = Counter()
    for frame in batches:
        for text in frame["text"]:
            total.update(words_of(text))
            total[b""] += 1
            if len(total) > most:
                yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                total = Counter()
    if total:
        yield pd.DataFrame({"word": list(total), "n": list(total.values())})


def text_ids(texts: list[str], tokens: ByteWords) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, ids of all texts end to end (each closed by the end id), and ids per text."""
    words = [words_of(t) for t in texts]
    end = np.array([END_ID], "<u4").tobytes()
    joined = [b"".join(tokens.ids(w)) + end for w in words]
    return words, np.frombuffer(b"".join(joined), "<u4"), np.fromiter(map(len, joined), np.int64, len(joined)) // 4


def tokenised(batches, path: str, hot: dict[bytes, int], most_chars: int = 500_000):
    """Per text: its number, its ids and the end id (16 bits each), tokens, number and log counts of frequent words, and its
    other words."""
    from pyspark import TaskContext

    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 40
    tokens, end = ByteWords(path), np.array([END_ID], "<u4").tobytes()
    for frame in batches:
        texts, docs, folds = (frame[c].tolist() for c in ("text", "id", "held_out"))
        for a, b in groups_of(texts, most_chars):
            out, split = [], [words_of(t) for t in texts[a:b]]
            # the new words of many texts are encoded in one call; a cache emptied in between is filled again text by text
            tokens.learn(list(chain.from_iterable(split)))
            for doc, held, words in zip(docs[a:b], folds[a:b], split, strict=True):
                ids = np.frombuffer(b"".join(tokens.ids(words)) + end, "<u4").astype("<u2").tobytes()
                words.append(b"")
                count = np.fromiter(map(hot.get, words, repeat(0)), np.int64, len(words))
                known = count > 0
                rare = [words[i] for i in np.flatnonzero(~known).tolist()]
                out.append((doc, held, number, ids, len(words), int(known.sum()), float(np.log10(count[known] + 0.1).sum()), rare))
                number += 1
            frame_out = pd.DataFrame(out, columns=["id", "held_out", "uid", "ids", "n_tokens", "n_hot", "hot_base", "rare"])
            yield frame_out.astype({"id": frame["id"].dtype, "held_out": frame["held_out"].dtype})


def windows_of(ids: bytes) -> list[bytes]:
    """A text's ids after an end id, cut so that every id is the target of one window."""
    row = END_ID.to_bytes(2, "little") + ids
    return [row[at : at + 2 * lm.LENGTH + 2] for at in range(0, len(ids), 2 * lm.LENGTH)]


def as_windows(rows: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as a matrix of model indices, and the number of targets of each."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows)) // 2 - 1
    width = 2 * (lm.LENGTH + 1)
    flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), "<u2")
    return table[flat.reshape(len(rows), lm.LENGTH + 1)], lengths


def target_counts(batches):
    """How often each id stands in the task's texts."""
    total = np.zeros(1 << 16, np.int64)
    for frame in batches:
        for ids in frame["ids"]:
            total += np.bincount(np.frombuffer(ids, "<u2"), minlength=1 << 16) if len(ids) > 1 << 15 else 0
        total += np.bincount(np.frombuffer(b"".join(x for x in frame["ids"] if len(x) <= 1 << 15), "<u2"), minlength=1 << 16)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"id": at, "n": total[at]})


def compact(ids: np.ndarray) -> np.ndarray:
    """Model index by tokenizer id: the given ids in order, then one index that stands for all others."""
    table = np.full(1 << 16, len(ids), np.int32)
    table[ids] = np.arange(len(ids))
    return table


def train_rows(batches, model: lm.AttentionModel, table: np.ndarray, rate: float, turn: int, rounds: int, piece: int = 1 << 13, most: int = 1 << 13):
    """A task's pass over this round's windows of its texts, at most so many at a time: its number, and in pieces its
    table counts and its parameters times its targets, which can be summed over the tasks."""
    from pyspark import TaskContext

    context = TaskContext.get()
    model = model.copy()
    adam, counts, weight, rng = lm.Adam(model, rate), np.zeros_like(model.tables), 0.0, np.random.default_rng(11)

    def learn(rows: list[bytes]) -> float:
        windows, lengths = as_windows(rows, table)
        order = rng.permutation(len(windows))
        lm.train_part(model, windows[order], lengths[order], adam, counts)
        return float(lengths.sum())

    held: list[bytes] = []
    for frame in batches:
        for ids in frame["ids"]:
            held += windows_of(ids)[(turn + len(ids) // 2) % rounds :: rounds]
            if len(held) >= most:
                weight += learn(held)
                held = []
    if held:
        weight += learn(held)
    if weight:
        flat = np.concatenate([p.ravel() * np.float64(weight) for p in model.parameters().values()] + [counts.ravel(), [weight]])
        for k, a in enumerate(range(0, len(flat), piece)):
            yield pd.DataFrame({"task": [context.partitionId() if context else 0], "piece": [k], "x": [flat[a : a + piece]]})


def added(parts: DataFrame, tasks: int, fan_in: int = 32) -> np.ndarray:
    """The sum of the tasks' vectors: groups of `fan_in` tasks are added, then groups of groups, so that a group holds
    no more rows however many tasks there are."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"task": frame["task"].iloc[:1], "piece": frame["piece"].iloc[:1], "x": [np.sum(np.stack(frame["x"].to_numpy()), axis=0)]})

    while tasks > 1:
        tasks = -(-tasks // fan_in)
        parts = parts.withColumn("task", F.floor(F.col("task") / fan_in).cast("int")).groupBy("task", "piece").applyInPandas(add, "task int, piece int, x array<double>")
    return np.concatenate(list(parts.orderBy("piece").toPandas()["x"]))


def train(texts: DataFrame, parts: int, steps: int, first: int, rounds: int, rate: float) -> tuple[lm.AttentionModel, np.ndarray]:
    """The model and its id table, from the tokenised training texts.

    At most `first` windows, in hash order, start the model on the driver, so that the tasks improve one and the same
    solution. Then all windows, dealt to `rounds` rounds, train it: every window is learnt from once, in the
    task that reads it, and at the end of a round the tasks' parameters are averaged by Spark, weighted by targets. The
    vocabulary (no more than the tokenizer's ids) and the parameters have a fixed bound.
    """
    tally = texts.select("ids").mapInPandas(target_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    ids = np.union1d(tally["id"].to_numpy(np.int64), [END_ID])
    table, size = compact(ids), len(ids) + 1
    unigram = np.full(size, 0.5)
    unigram[table[tally["id"].to_numpy(np.int64)]] += tally["n"].to_numpy(float)
    unigram /= unigram.sum()
    # the last index shares its probability among all ids that it stands for
    model = lm.AttentionModel(size, parts)
    every, width = 2 * lm.LENGTH, 2 * lm.LENGTH + 2
    some = texts.select("ids", F.explode(F.sequence(F.lit(1), F.octet_length("ids"), F.lit(every))).alias("at")).selectExpr(f"substring(ids, at, {width}) AS ids")
    start = some.orderBy(F.xxhash64("ids"), "ids").limit(first).toPandas()
    lm.warm_up(model, *as_windows([r for r in start["ids"] if len(r) > 2], table), unigram, steps)
    for turn in range(rounds if len(start) else 0):
        now = model.copy()
        results = written(texts.select("ids").mapInPandas(lambda b, m=now, k=turn: train_rows(b, m, table, rate, k, rounds), "task int, piece int, x array<double>"), "lm-round")
        tasks = results.agg(F.max("task")).first()[0]
        if tasks is None:
            continue
        flat = added(results, tasks + 1)
        weight, at = flat[-1], 0
        for name, p in model.parameters().items():
            setattr(model, name, (flat[at : at + p.size] / weight).reshape(p.shape).astype(np.float32))
            at += p.size
        model.set_tables(flat[at:-1].reshape(model.tables.shape), unigram)
    return model, table


def score_rows(batches, model: lm.AttentionModel, table: np.ndarray, most: int = 1 << 19):
    """The score of each tokenised text; about `most` ids at a time."""
    lookup = model.lookup()
    start, unknown = int(table[END_ID]), int((table == model.vocabulary - 1).sum())
    lookup["next"] = lookup["next"].copy()
    lookup["next"][-1] /= max(1, unknown)
    for frame in batches:
        sizes = np.fromiter(map(len, frame["ids"]), np.int64, len(frame)) // 2
        cuts = [0, *(np.flatnonzero(np.diff(sizes.cumsum() // most)) + 1).tolist(), len(frame)]
        scores = np.empty(len(frame))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                flat = np.frombuffer(b"".join(frame["ids"].iloc[a:b]), "<u2")
                got = model.log10_probabilities(table[flat], sizes[a:b], lookup, start)
                scores[a:b] = np.add.reduceat(got, sizes[a:b].cumsum() - sizes[a:b])
        yield pd.DataFrame({"uid": frame["uid"], "score": scores})


def lm_scores(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_out: int = 0, tokenizer_path: str | None = None,
    parts: int = 64, steps: int = 1600, first: int = 1 << 14, rounds: int = 2, rate: float = 0.01, hot_words: int = 1 << 16,
) -> DataFrame:
    """Scores every text under a self-attention model and under corpus word counts.

    One row per input row: the id, held_out, n_tokens (words and one end), n_known (those seen in training),
    train_tokens, base_score (unigram, add 0.1), score (the attention model's log10 probability of all subword ids
    of the text and its end).

    Plan: (1) word counts of all training texts, pre-counted in the tasks, then one shuffle by word; (2) one pass
    tokenises all texts and writes their ids; (3) all ids of all training texts train the model in all tasks (see ``train``);
    (4) one pass over the ids scores all texts. The most frequent words, at most `hot_words` of them by a cut-off from a
    histogram of counts, are looked up in the second pass; the others meet their counts in a join on the word, whose keys are
    rare by construction.

    Cases: null text is empty (one end token); null ids are held_out = null and not learnt from; rows that repeat
    an id are scored each; without training texts every count is 0; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = df.sparkSession
    path = tokenizer_path or default_path()
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    training = texts.where(bucket_of("id", folds) != held_out).select("text")
    counts = written(training.mapInPandas(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    # the histogram's bins are an eighth of a doubling wide, so there are a few hundred at any size
    bin_of = F.floor(F.log2(F.col("n").cast("double")) * 8)
    bins = counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("words")).orderBy(F.desc("bin")).collect()
    cut, room = None, hot_words
    for r in bins:
        if r.words > room:
            break
        cut, room = r.bin, room - r.words
    frequent = counts.where(bin_of >= cut).collect() if cut is not None else []
    hot = spark.sparkContext.broadcast({bytes(r.word): r.n for r in frequent})

    found = texts.withColumn("held_out", bucket_of("id", folds) == held_out).mapInPandas(
        lambda b: tokenised(b, path, hot.value), f"id {kind}, held_out boolean, uid long, ids binary, n_tokens long, n_hot long, hot_base double, rare array<binary>"
    )
    found = written(found, "lm-ids")
    model, table = train(found.where("NOT held_out"), parts, steps, first, rounds, rate)
    held = spark.sparkContext.broadcast(model)
    # written, so that no join of the result or second reading of it scores the texts again
    scores = written(found.select("uid", "ids").mapInPandas(lambda b: score_rows(b, held.value, table), "uid long, score double"), "lm-scores")
    rest = counts if cut is None else counts.where(bin_of < cut)
    rare = found.select("uid", F.explode("rare").alias("word"))
    looked = rare.join(rest, "word", "left").groupBy("uid").agg(F.count("n").alias("n_rare"), F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.1)).alias("rare_base"))
    whole = math.log10(total + 0.1 * (distinct + 1))
    return found.join(looked, "uid", "left").join(scores, "uid").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score",
    )
