"""Packing documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import zlib
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.llm.common import written
from lodestar.llm.tokens import ByteWords, default_path, groups_of

PIECE = "piece int, start long, length long, ids_crc32 long, uid long, file string, row long"


def cut(batches, path: str, capacity: int, end_id: int):
    """Pieces of at most `capacity` ids of each document; (id, text, file, row) frames in, piece frames out."""
    from pyspark import TaskContext

    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 40
    tokenizer = ByteWords(path)
    end = end_id.to_bytes(4, "little")
    for frame in batches:
        texts = frame["text"].tolist()
        for a, b in groups_of(texts):
            out = []
            docs, files, rows = (frame[c].iloc[a:b].tolist() for c in ("id", "file", "row"))
            for doc, file, row, ids in zip(docs, files, rows, tokenizer.encode_texts(texts[a:b]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece), number, file, row))
                    number += 1
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32", "uid", "file", "row"]).astype({"id": frame["id"].dtype, "piece": "int32"})


def numbered(pieces: DataFrame, block: int = 1024) -> DataFrame:
    """Pieces with their place in the order of (file, row, piece), from 0 without gaps, as uid.

    Windows run over the pieces of `block` rows of a file, over a file's blocks and over the files.
    """
    pieces = pieces.withColumn("block", F.floor(F.col("row") / block))
    blocks = pieces.groupBy("file", "block").agg(F.count("*").alias("n"))
    files = blocks.groupBy("file").agg(F.sum("n").alias("n")).select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("earlier"))
    before = blocks.withColumn("before", F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")).join(files, "file")
    own = F.row_number().over(W.partitionBy("file", "block").orderBy("row", "piece", "uid"))
    return pieces.withColumn("own", own).join(before, ["file", "block"]).withColumn("uid", F.col("earlier") + F.col("before") + F.col("own") - 1)


class Packing:
    """Groups (bins) of item positions over lengths, with best-fit insertion."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity, self.bins, self.fills = lengths, capacity, [], []

    def insert(self, items: list[int], order: list[float] | None = None) -> Packing:
        """Best fit, longest first (or by falling `order`): each item goes where it leaves the least room."""
        lengths, capacity = self.lengths, self.capacity
        by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        mask = 0  # bit r: some bin has exactly r free
        for b, fill in enumerate(self.fills):
            by_room[capacity - fill].append(b)
            mask |= 1 << (capacity - fill)
        for i in sorted(items, key=(lengths if order is None else order).__getitem__, reverse=True):
            n = lengths[i]
            fits = mask >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    mask &= ~(1 << room)
                self.bins[b].append(i)
                self.fills[b] += n
            else:
                b, room = len(self.bins), capacity
                self.bins.append([i])
                self.fills.append(n)
            by_room[room - n].append(b)
            mask |= 1 << (room - n)
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: the mean squared fill."""
        return len(self.bins), -sum(f * f for f in self.fills) / max(1, len(self.fills))

    def assigned(self) -> list[int]:
        out = [0] * len(self.lengths)
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out

    @classmethod
    def of(cls, lengths: list[int], capacity: int, assigned: list[int]) -> Packing:
        self = cls(lengths, capacity)
        self.bins = [[] for _ in range(max(assigned, default=-1) + 1)]
        for i, b in enumerate(assigned):
            self.bins[b].append(i)
        self.fills = [sum(lengths[i] for i in items) for items in self.bins]
        return self


def crossover(one: Packing, two: Packing, rng: random.Random) -> Packing:
    """Injects some of the fullest bins of `two`, whole, into `one`: bins of `one` that hold any injected
    item dissolve and their other items are best-fitted again, with those of its emptiest bin."""
    ranked = sorted(range(len(two.bins)), key=two.fills.__getitem__, reverse=True)
    best = ranked[: max(1, len(ranked) // 2)]
    chosen = rng.sample(best, max(1, len(best) // 2))
    taken = {i for b in chosen for i in two.bins[b]}
    child, displaced = Packing(one.lengths, one.capacity), []
    emptiest = min(range(len(one.bins)), key=one.fills.__getitem__)
    for b, (items, fill) in enumerate(zip(one.bins, one.fills, strict=True)):
        if b == emptiest or not taken.isdisjoint(items):
            displaced += [i for i in items if i not in taken]
        else:
            child.bins.append(list(items))
            child.fills.append(fill)
    for b in chosen:
        child.bins.append(list(two.bins[b]))
        child.fills.append(two.fills[b])
    return child.insert(displaced)


def evolve(
    lengths: list[int], capacity: int, seed: int, migrants: list[list[int]], population: int, generations: int, least_generations: int = 2
) -> tuple[Packing, int]:
    """One epoch of one island, from the migrants or from best fit of all items in several orders: the best packing and
    the number of crossovers. Once the lower bound on the number of bins is reached, only `least_generations` are run, which still
    gather the free room in few bins."""
    rng, least = random.Random(seed), -(-sum(lengths) // capacity)
    items, crossovers = list(range(len(lengths))), 0
    people = [Packing.of(lengths, capacity, m) for m in migrants] or [Packing(lengths, capacity).insert(items)]
    while len(people) < population:
        people.append(Packing(lengths, capacity).insert(items, [n * rng.uniform(0.8, 1.25) for n in lengths]))
    for k in range(generations if len(items) > 1 else 0):
        people.sort(key=Packing.fitness)
        if len(people[0].bins) <= least and k >= least_generations:
            break
        half = people[: max(2, population // 2)]
        people = people[: population - len(half)] + [crossover(*rng.sample(half, 2), rng) for _ in half]
        crossovers += len(half)
    return min(people, key=Packing.fitness), crossovers


def evolve_rows(batches, capacity: int, epoch: int, population: int, generations: int):
    for frame in batches:
        out = []
        for row in frame.itertuples():
            lengths = [int(n) for n in row.lengths]
            migrants = [[int(b) for b in m] for m in row.migrants]
            found, crossovers = evolve(lengths, capacity, hash((int(row.cell), int(row.island), epoch)), migrants, population, generations)
            out.append((row.cell, row.island, found.assigned(), *found.fitness(), crossovers))
        yield pd.DataFrame(out, columns=["cell", "island", "bins", "n_bins", "cost", "crossovers"])


def elites_of(cells: DataFrame, n_cells: int, capacity: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """The best packing of each island of each cell after all epochs: (cell, island, bins, n_bins, cost, crossovers).

    Every island of every cell is one row and a task's unit of work; after an epoch it goes on with its own best
    packing and that of the island before it.
    """
    lengths = F.transform("items", lambda x: x["length"].cast("int"))
    base = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), lengths.alias("lengths"))
    state, elites = base.withColumn("migrants", F.array().cast("array<array<int>>")), None
    for epoch in range(epochs):
        run = lambda b, e=epoch: evolve_rows(b, capacity, e, population, generations)
        # a number given here is kept by adaptive execution, which would merge such small rows into one task
        dealt = state.repartition(max(1, min(n_cells * islands, 20_000)), "cell", "island")
        elites = written(dealt.mapInPandas(run, "cell long, island int, bins array<int>, n_bins int, cost double, crossovers int"), "elites")
        own = elites.select("cell", "island", "bins")
        come = elites.select("cell", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("bins").alias("guest"))
        state = base.join(own, ["cell", "island"]).join(come, ["cell", "island"]).select("cell", "island", "lengths", F.array("bins", "guest").alias("migrants"))
    return elites


def in_file_order(df: DataFrame) -> tuple[DataFrame, list]:
    """df, read from files, and each row's file (as text that sorts like the files' numbers) and place in it."""
    name = F.col("_metadata.file_name")
    file = F.concat(F.lpad(F.regexp_extract(name, r"^part-(\d+)", 1), 12, "0"), name).alias("file")
    place = [file, F.col("_metadata.row_index").alias("row")]
    try:
        df.select(*place)
    except AnalysisException:
        df = written(df, "ordered")
    return df, place


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 0,
    cell_items: int = 4096, islands: int = 2, epochs: int = 2, population: int = 6, generations: int = 6, ordered: bool = False, open_below: float = 0.9,
) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens, as few as it can.

    A document is its ids and `end_id`; only those longer than the capacity are cut, into full pieces
    and a rest. Returns per piece: the id, piece, start, length, ids_crc32, sequence_id, offset
    (gapless from 0 in each sequence).

    Plan: one pass tokenises the texts and writes the small piece table; texts are not shuffled. Pieces are
    dealt by hash to cells of about ``cell_items``, so that no cell depends on a source or key and every cell
    is one bounded row. Each cell evolves on ``islands`` islands, one row and task unit each; after an
    epoch every island hands its best packing to the next, and the best of all islands is placed. Sequences filled to less
    than ``open_below`` are opened again: their pieces, a small part, are dealt to new cells and evolve together, until one cell
    holds what is left. So the room that cells lose is lost once, not in every cell.

    ``ordered``: the rows of df stand in an order, that of its files and of the rows in them (Spark numbers the files of
    a sorted DataFrame in its order; a df that is not read from files is written first). A cell is then a run of
    ``cell_items`` consecutive pieces, a sequence's pieces stand in order, and its id is the place of the first, so ids ascend with the cells.

    Cases: null text is an empty document (one end id); null ids and repeated rows are documents of their own;
    an empty table gives an empty result; other columns are ignored.
    """
    path = tokenizer_path or default_path()
    id_type = df.schema[id_col].dataType.simpleString()
    df, place = in_file_order(df) if ordered else (df, [F.lit(None).cast("string").alias("file"), F.lit(0).cast("long").alias("row")])
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *place)
    pieces = written(texts.mapInPandas(lambda b: cut(b, path, capacity, end_id), f"id {id_type}, {PIECE}"), "pieces")

    if ordered:
        dealt, n_cells = numbered(pieces).withColumn("cell", F.floor(F.col("uid") / cell_items)), max(1, -(-pieces.count() // cell_items))
    else:
        dealt, n_cells = _dealt(pieces, cell_items)
    item = F.struct((-F.col("length")).alias("order"), "id", "piece", "start", "length", "ids_crc32", "uid")
    bins, done, level = W.partitionBy("cell", "bin"), [], 0
    while True:
        cells = written(dealt.groupBy("cell").agg(F.array_sort(F.collect_list(item)).alias("items")), "cells")
        elites = elites_of(cells, n_cells, capacity, islands, epochs, population, generations)
        best = elites.groupBy("cell").agg(F.min_by("bins", F.struct("n_bins", "cost", "island")).alias("bins"))
        spread = cells.join(best, "cell").select("cell", F.explode(F.arrays_zip("items", "bins")).alias("z")).select("cell", "z.items.*", F.col("z.bins").alias("bin"))
        sequence = F.min("uid").over(bins) if ordered else F.lit(level << 56) + F.col("cell") * (1 << 20) + F.col("bin")
        seats = bins.orderBy("uid") if ordered else bins.orderBy("order", "uid")
        seat = F.sum("length").over(seats.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("length")
        placed = spread.select("*", sequence.alias("sequence_id"), seat.alias("offset"))
        if ordered or n_cells == 1:
            done.append(placed)
            break
        placed = written(placed.withColumn("fill", F.sum("length").over(bins)), "placed")
        done.append(placed.where(F.col("fill") >= open_below * capacity))
        dealt, left = _dealt(placed.where(F.col("fill") < open_below * capacity).select("id", "piece", "start", "length", "ids_crc32", "uid"), cell_items)
        # where hardly anything fits together the cells stay as they are
        if left >= n_cells:
            done[-1] = placed
            break
        n_cells, level = left, level + 1
    out = [d.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset") for d in done]
    return reduce(DataFrame.unionByName, out)


def _dealt(pieces: DataFrame, cell_items: int) -> tuple[DataFrame, int]:
    """Pieces with a cell by hash, and the number of cells."""
    n_cells = max(1, -(-pieces.count() // cell_items))
    return pieces.withColumn("cell", F.pmod(F.xxhash64("uid", F.lit(n_cells)), F.lit(n_cells))), n_cells
