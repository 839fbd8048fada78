"""Mixing sources to target weights by proportionate-fair scheduling, in DataFrame functions only."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction
from functools import cmp_to_key

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def slot_table(weights: list[int], blocks: list[int]) -> list[tuple[int, int]]:
    """(source, block) by slot, for sources with whole-number weights and so many blocks each, by earliest deadline first.

    In the ideal division, which the schedule follows, every source with blocks left is served at each moment in
    proportion to its weight. With w * v blocks of a source served at its virtual time v, the slots used up by v are
    t(v) = sum of min(w_i * v, n_i). Block j of source i is released at floor(t(j / w_i)) and due at
    ceil(t((j + 1) / w_i)), in exact whole-number arithmetic. The ideal division itself meets all these windows, so
    earliest deadline first meets them too: after any number of slots every source is less than one block from its ideal.
    """
    order = sorted(range(len(weights)), key=cmp_to_key(lambda a, b: blocks[a] * weights[b] - blocks[b] * weights[a]))
    # t(v) = rate[k] * v + done[k] while the first k sources of the order have run out
    rate, done = [sum(weights)], [0]
    for i in order:
        rate.append(rate[-1] - weights[i])
        done.append(done[-1] + blocks[i])

    def phase(i: int, j: int, k: int) -> int:
        """The sources that have run out before virtual time j / weights[i]; at least k have."""
        while k < len(order) and blocks[order[k]] * weights[i] <= j * weights[order[k]]:
            k += 1
        return k

    def time(i: int, j: int, k: int) -> tuple[int, int]:
        """Floor and ceiling of the slots used up by then."""
        return done[k] + rate[k] * j // weights[i], done[k] - (-rate[k] * j // weights[i])

    waiting = [(0, i, 0, 0) for i, n in enumerate(blocks) if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot:
            _, i, j, k = heapq.heappop(waiting)
            k = phase(i, j + 1, k)
            heapq.heappush(ready, (time(i, j + 1, k)[1], i, j, k))
        _, i, j, k = heapq.heappop(ready)
        out.append((i, j))
        if j + 1 < blocks[i]:
            heapq.heappush(waiting, (time(i, j + 1, k)[0], i, j + 1, k))
    return out


def whole_weights(weights: list[float]) -> list[int]:
    """The same proportions in whole numbers, exactly."""
    exact = [Fraction(w) for w in weights]
    common = math.lcm(*(x.denominator for x in exact)) if exact else 1
    return [int(x * common) for x in exact]


def mix_sources(
    df: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
    block: int = 1 << 20, most_blocks: int = 1 << 17, chunk_rows: int = 4096, exponent: float = 0.5,
) -> DataFrame:
    """Gives every row its place in an interleaving of the sources by target weight.

    A source's rows stand in a fixed pseudo-random order and form blocks of ``block`` units
    (``size``: the units of a row, at least 1; 1 each if None); a row belongs to the block in which it
    starts. Blocks are dealt to slots 0, 1, 2... by earliest deadline first over the whole timeline, from the weights
    themselves (``slot_table``): at every point a source has had its share of blocks to within less than one block; when a source
    runs out, the others go on in their proportions. Every row appears once.

    ``weights``: positive target weight by source (those absent or not positive get the smallest given); if
    None, the total size of the source to the power ``exponent``.

    Returns the input rows as struct ``row`` with ``source_block`` (from 0), ``slot`` (one for each
    block) and ``place`` (order within the block); sort by (slot, place) for the mix.

    Plan: one aggregation sizes each (source, chunk), where a chunk is a hash share of a source with about
    ``chunk_rows`` rows, so a source with a third of all rows spreads over many tasks; prefix sums run over
    those summary rows and, within a chunk, over its rows. The sources (name, size) and the slot table pass through the driver:
    ``most_blocks`` rows and one for each source, since the block grows so that no more are needed.
    Any number of sources is scheduled; the two tables are joined as Spark sees fit for their size.

    Cases: null is a source of its own; null ids, ties and repeated rows keep all their rows, in some order;
    an empty table gives an empty result; other columns stay in ``row`` whatever their names.
    """
    spark = df.sparkSession
    source = F.col("row")[source_col].cast("string")
    units = F.lit(1) if size is None else size
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.greatest(F.coalesce(units.cast("long"), F.lit(1)), F.lit(1)).alias("units"))
    rows = rows.select("row", "units", F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")).alias("src"), F.xxhash64(F.col("row")[id_col], F.lit("mix")).alias("h"))

    found = rows.groupBy("src").agg(F.count("*").alias("n"), F.sum("units").alias("size")).orderBy("src").collect()
    if weights is None:
        target = [float(r["size"]) ** exponent for r in found]
    else:
        least = min((w for w in weights.values() if w > 0), default=1.0)
        target = [w if (w := weights.get(None if r.src.none else r.src.name, 0)) > 0 else least for r in found]
    block = max(block, -(-sum(r["size"] for r in found) // most_blocks))
    order = slot_table(whole_weights(target), [-(-r["size"] // block) for r in found])
    # a source of its own number each; both tables are small, and Spark decides by their size how to join them
    plan = spark.createDataFrame(
        [((r.src.none, r.src.name), k, max(1, -(-r.n // chunk_rows))) for k, r in enumerate(found)], "src struct<none: boolean, name: string>, number int, chunks long"
    )
    slots = spark.createDataFrame([(i, j, slot) for slot, (i, j) in enumerate(order)], "number int, source_block long, slot long")

    dealt = rows.join(plan, "src").drop("src").withColumn("chunk", F.pmod("h", "chunks"))
    sizes = dealt.groupBy("number", "chunk").agg(F.sum("units").alias("chunk_size"))
    before = sizes.select("number", "chunk", (F.sum("chunk_size").over(W.partitionBy("number").orderBy("chunk")) - F.col("chunk_size")).alias("before"))
    within = W.partitionBy("number", "chunk").orderBy("h", F.col("row")[id_col])
    start = F.col("before") + F.sum("units").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("units")
    placed = dealt.join(before, ["number", "chunk"]).withColumn("start", start).withColumn("source_block", F.floor(F.col("start") / block).cast("long"))
    return (
        placed.select("row", "number", "source_block", F.pmod("start", F.lit(block)).alias("place"))
        .join(slots, ["number", "source_block"])
        .select("row", "source_block", "slot", "place")
    )


def mixed(df: DataFrame, **options) -> DataFrame:
    """The rows of df in mixed order (see mix_sources), with its own columns."""
    placed = mix_sources(df, **options)
    return placed.orderBy("slot", "place").select("row.*")
