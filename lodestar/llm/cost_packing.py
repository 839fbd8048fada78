"""Packing documents into sequences of equal length and balanced attention cost."""

from __future__ import annotations

import heapq
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_slices, written
from lodestar.llm.tokens import ByteWords, default_path, groups_of

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
COLUMNS = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def balanced(lengths: list[int], capacities: list[int], linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """(item, start, length, bin) of every piece placed and (item, start, length) of what is left when all bins are full.

    Items come in descending order. Each goes to the bin of the lowest cost, linear * n + quadratic * n^2 summed over its pieces,
    among those with room for the whole. If none has, the cheapest bin with any room takes what it can hold and the rest
    of the item goes back in line; that fills the bin, so there are at most as many cuts as bins.
    """
    room, cost = np.array(capacities, np.int64), np.zeros(len(capacities))
    line, left, placed = [(-n, i, 0) for i, n in enumerate(lengths)], int(sum(capacities)), []
    heapq.heapify(line)
    while line and left:
        n, item, start = heapq.heappop(line)
        fits = room >= -n
        if fits.any():
            took = -n
        else:
            fits, took = room > 0, 0
        b = int(np.where(fits, cost, np.inf).argmin())
        if not took:
            took = int(room[b])
            heapq.heappush(line, (n + took, item, start + took))
        placed.append((item, start, took, b))
        room[b] -= took
        cost[b] += linear * took + quadratic * took * took
        left -= took
    return placed, [(i, start, -n) for n, i, start in line]


def powers_of_two(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length()) if n >> k & 1]


class Cell:
    """Pieces held by a task with their ids, packed whenever they make `most` tokens."""

    def __init__(self, level: int, capacity: int, most: int, linear: float, quadratic: float):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.sequence = (level << 54) + ((context.partitionId() if context else 0) << 32)
        self.capacity, self.most, self.linear, self.quadratic = capacity, most, linear, quadratic
        self.held, self.tokens, self.out = [], 0, []

    def place(self, doc, start: int, ids: bytes, doc_tokens: int, sequence: int, offset: int) -> None:
        self.out.append((doc, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, sequence, offset, None))

    def add(self, doc, start: int, ids: bytes, doc_tokens: int) -> None:
        """A document from its place `start`; full pieces are sequences of their own at once."""
        step = 4 * self.capacity
        while len(ids) >= step:
            self.place(doc, start, ids[:step], doc_tokens, self.sequence, 0)
            self.sequence += 1
            start, ids = start + self.capacity, ids[step:]
        if ids:
            self.held.append((doc, start, ids, doc_tokens))
            self.tokens += len(ids) // 4
            if self.tokens >= self.most:
                self.pack()

    def pack(self, last: bool = False) -> None:
        """Fills as many sequences as there are tokens for; with `last` the rest, too, in sequences of powers of two."""
        sizes = [self.capacity] * (self.tokens // self.capacity) + (powers_of_two(self.tokens % self.capacity) if last else [])
        placed, left = balanced([len(h[2]) // 4 for h in self.held], sizes, self.linear, self.quadratic)
        ends = [0] * len(sizes)
        for item, start, n, b in placed:
            doc, before, ids, total = self.held[item]
            self.place(doc, before + start, ids[4 * start : 4 * (start + n)], total, self.sequence + b, ends[b])
            ends[b] += n
        self.sequence += len(sizes)
        held = [(*self.held[i], start, n) for i, start, n in left]
        self.held = [(doc, before + start, ids[4 * start : 4 * (start + n)], total) for doc, before, ids, total, start, n in held]
        self.tokens = sum(n for _, _, n in left)

    def frame(self, kind, rest: bool = False) -> pd.DataFrame:
        """What was placed since the last call; with `rest` what is held, too, with its ids and no sequence."""
        out, self.out = self.out, []
        if rest:
            out += [(doc, start, len(ids) // 4, zlib.crc32(ids), total, None, None, ids) for doc, start, ids, total in self.held]
        columns = dict(zip(COLUMNS, zip(*out, strict=True), strict=True)) if out else dict.fromkeys(COLUMNS, ())
        kinds = {"id": kind, "sequence_id": "Int64", "offset": "Int64"}  # nulls must not turn these into floats
        return pd.DataFrame({c: pd.array(list(v), kinds[c]) if c in kinds else list(v) for c, v in columns.items()})


def pack_texts(batches, path: str, end_id: int, cell):
    """(id, text) frames in, frames of pieces out; the last frame has what the task could not place."""
    tokenizer, end, kind, own = ByteWords(path), end_id.to_bytes(4, "little"), object, cell()
    for frame in batches:
        kind = frame["id"].dtype
        texts, docs = frame["text"].tolist(), frame["id"].tolist()
        for a, b in groups_of(texts):
            for doc, ids in zip(docs[a:b], tokenizer.encode_texts(texts[a:b]), strict=True):
                own.add(doc, 0, ids + end, len(ids) // 4 + 1)
            yield own.frame(kind)
    own.pack()
    yield own.frame(kind, rest=True)


def pack_rest(batches, last: bool, cell):
    """Frames of pieces with their ids in, frames of pieces out."""
    kind, own = object, cell()
    for frame in batches:
        kind = frame["id"].dtype
        for row in zip(*(frame[c].tolist() for c in ("id", "start", "ids", "doc_tokens")), strict=True):
            own.add(*row)
        yield own.frame(kind)
    own.pack(last)
    yield own.frame(kind, rest=True)


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 1,
    linear: float = 1.0, quadratic: float = 1 / 6144, cell_tokens: int = 1 << 20, task_tokens: int = 1 << 22,
) -> DataFrame:
    """Packs all documents, each its ids and `end_id`, into sequences of `capacity` tokens of nearly equal attention cost, without padding.

    Returns per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset (gapless from 0 in each sequence).
    The cost of a piece of n tokens is linear * n + quadratic * n^2 (as defaults, the ratio of a layer of width 1,024, where a token costs
    24 d^2 and its attention 4 n d).

    Plan: a task tokenises its texts and packs them as it goes, a cell of ``cell_tokens`` at a time (see ``balanced``), so
    neither texts nor ids are shuffled and no cell depends on a key. Documents longer than the capacity give full pieces and a
    rest. What a task has left in the end, less than one sequence, is written with its ids; these rests are dealt to new tasks of about
    ``task_tokens``, again and again, until one task holds them: it ends with sequences of 1, 2, 4, ... tokens, at most
    one of each length in the whole result.

    Cases: null text is an empty document (one end id); null ids and repeated rows are documents of their own; an empty table gives an
    empty result; other columns are ignored.
    """
    path, level, done = tokenizer_path or default_path(), 0, []
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, {PIECE}"
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    cell = lambda: Cell(0, capacity, cell_tokens, linear, quadratic)
    pieces = written(map_slices(texts, lambda b: pack_texts(b, path, end_id, cell), schema), "packed")
    while True:
        done.append(pieces.where(F.col("sequence_id").isNotNull()))
        rest, level = pieces.where(F.col("sequence_id").isNull()).select("id", "start", "ids", "doc_tokens", "length"), level + 1
        tokens = rest.agg(F.sum("length")).first()[0]
        if not tokens:
            break
        tasks, n = -(-tokens // task_tokens), level
        cell = lambda n=n: Cell(n, capacity, cell_tokens, linear, quadratic)
        dealt = rest.coalesce(1) if tasks == 1 else rest.repartition(tasks)
        pieces = written(map_slices(dealt, lambda b, last=tasks == 1, cell=cell: pack_rest(b, last, cell), schema), "packed")
    out = [d.select(F.col("id").alias(id_col), *COLUMNS[1:7]) for d in done]
    return reduce(DataFrame.unionByName, out)
