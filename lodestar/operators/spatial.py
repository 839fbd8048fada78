"""Joins of geometries on a quadtree that is as deep as the data are dense."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.geometry import bounds
from lodestar.functions.relate import NAMES, relations, turned
from lodestar.sources.scratch import stored

_BOX = ["x0", "y0", "x1", "y1"]


def _cell(v: Column, axis: int, level: Column | int, world: tuple[float, float, float, float]) -> Column:
    """The number of the column (axis 0) or row (axis 1) at a level; what lies outside the world belongs to its edge."""
    n = F.shiftleft(F.lit(1), level) if isinstance(level, int) else F.expr("shiftleft(1, level)")
    scaled = F.floor((v - world[axis]) / ((world[axis + 2] - world[axis]) or 1.0) * n).cast("int")
    return F.greatest(F.lit(0), F.least(n - 1, scaled))


def candidates(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_geometry: str = "geometry", right_geometry: str = "geometry",
    most: int = 4096, step: int = 2, deepest: int = 25, world: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """(left_id, right_id) of all pairs whose boxes meet, each once.

    Both sides are listed in the cells of a quadtree over their common extent (or `world`) that their boxes meet. A cell in which there are more than ``most`` pairs to be
    compared is split into 4^step and its rows are listed again, so only dense places go deep; a cell of one side alone is dropped. Where
    that would not halve the pairs, as boxes are as large as the cell or share a place, a cell is cut into blocks of ``most`` pairs instead.
    So no task's cell has more than ``most`` pairs. Of the cells that hold a pair only that with the lower left corner of the common box gives it. Ids must be unique; rows without an id or with
    an empty or null geometry have no pairs. Only ids and boxes pass through the cells.
    """
    box = lambda df, key, g: df.select(F.col(f"`{key}`").alias("key"), bounds(F.col(f"`{g}`")).alias("box")).where("key IS NOT NULL AND box IS NOT NULL").select("key", "box.*")
    a, b = box(left, left_id, left_geometry), box(right, right_id, right_geometry)
    none = lambda df: F.lit(None).cast(df.schema["key"].dataType)
    items = a.select(F.col("key").alias("l"), none(b).alias("r"), *_BOX).union(b.select(none(a).alias("l"), F.col("key").alias("r"), *_BOX))

    items = stored(items, "boxes")
    seen = items.agg(F.count("l").alias("l"), F.count("r").alias("r"), F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    world = world or tuple(seen[2:]) if seen.l + seen.r else (0.0, 0.0, 1.0, 1.0)
    level, leaves = 0, []
    while level < min(4, deepest) and seen.l * seen.r > most * 16**level:
        level += 1
    items = items.select("*", *[_cell(F.col(f"{c}{e}"), k, level, world).alias(f"s{c}{e}") for k, c in enumerate("xy") for e in (0, 1)])
    while True:
        for c in "xy":
            items = items.withColumn(f"c{c}", F.explode(F.sequence(f"s{c}0", f"s{c}1")))
        # where the row would be listed one step deeper, within its cell
        below = [
            (f"s{c}{e}", clip(_cell(F.col(f"{c}{e}"), k, level + step, world), F.shiftleft(F.col(f"c{c}"), step) + ((1 << step) - 1) * e))
            for k, c in enumerate("xy") for e, clip in ((0, F.greatest), (1, F.least))
        ]
        items = items.select("l", "r", *_BOX, "cx", "cy", *[v.alias(n) for n, v in below])
        kids = (F.col("sx1") - F.col("sx0") + 1).cast("double") * (F.col("sy1") - F.col("sy0") + 1)
        items = stored(items.withColumn("kids", kids), "cells")
        of = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("kids")).otherwise(0.0))
        counts = items.groupBy("cx", "cy").agg(F.count("l").alias("nl"), F.count("r").alias("nr"), of("l").alias("kl"), of("r").alias("kr")).where("nl > 0 AND nr > 0")
        pairs = F.col("nl") * F.col("nr")
        split = (pairs > most) & F.lit(level + step <= deepest) & (F.col("kl") * F.col("kr") / 4**step <= pairs / 2)
        counts = counts.select("cx", "cy", "nl", "nr", split.alias("split"))
        if 4**level <= 1 << 16:  # a row a cell at most
            counts = F.broadcast(counts)
        judged = items.join(counts, ["cx", "cy"])
        leaves.append(judged.where(~F.col("split")).withColumn("level", F.lit(level)))
        items, level = judged.where("split").drop("cx", "cy", "nl", "nr", "kids", "split"), level + step
        if items.isEmpty():
            break

    cells = reduce(DataFrame.unionByName, [leaf.select("l", "r", *_BOX, "level", "cx", "cy", "nl", "nr") for leaf in leaves])
    side = int(most**0.5)
    blocks = lambda n: F.when(F.col("nl") * F.col("nr") <= most, 1).otherwise(F.ceil(F.col(n) / side)).cast("int")
    own = lambda key, n: F.pmod(F.xxhash64(key), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    # few bytes make many pairs, so the number of tasks goes by the pairs
    tasks = task_count(left.sparkSession, cells.where("l IS NOT NULL").agg(F.sum(F.col("nr").cast("double"))).first()[0])
    where = ["level", "cx", "cy", "i", "j"]
    one = cells.where("l IS NOT NULL").select("l", *_BOX, "level", "cx", "cy", own("l", "nl").alias("i"), every("nr").alias("j"))
    two = cells.where("r IS NOT NULL").select("r", *[F.col(c).alias(f"r_{c}") for c in _BOX], "level", "cx", "cy", own("r", "nr").alias("j"), every("nl").alias("i"))
    pairs = one.repartition(tasks, *where).join(two.repartition(tasks, *where), where)
    meet = (F.col("x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("x1")) & (F.col("y0") <= F.col("r_y1")) & (F.col("r_y0") <= F.col("y1"))
    corner = [_cell(F.greatest(f"{c}0", f"r_{c}0"), k, F.col("level"), world) == F.col(f"c{c}") for k, c in enumerate("xy")]
    return pairs.where(meet & corner[0] & corner[1]).select(F.col("l").alias("left_id"), F.col("r").alias("right_id"))


def task_count(spark: SparkSession, rows: float | None, each: int = 4_000_000) -> int:
    """Tasks for a step that makes so many rows: two a core, and no more than `each` rows in one while 20,000 tasks are enough."""
    return int(min(20_000, max(2 * spark.sparkContext.defaultParallelism, (rows or 0) / each + 1)))


class Classes:
    """The rows of a table by equal value: ``distinct`` has each value once (rep: a number that stands for it, n: how many rows), ``members`` the
    ids of each, in lists of about `most`. Ids may be of any type that can be hashed, and repeat. With `read` the values are text; each distinct
    one is read once, and ``distinct`` has what was read."""

    def __init__(self, df: DataFrame, key: str, value: str, most: int = 256, read: Callable[[Column], Column] | None = None):
        rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{value}`").alias("value")).where("id IS NOT NULL AND value IS NOT NULL")
        rows = stored(rows, "rows")
        made = rows.groupBy("value").agg(F.count("*").alias("n"))
        number = [F.monotonically_increasing_id().alias("rep"), "value", "n", F.ceil(F.col("n") / most).cast("int").alias("lists")]
        if read:  # few bytes of text are read at some cost, so they are spread before
            made = made.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "value")
            number.append(read(F.col("value")).alias("geometry"))
        known = stored(made.select(*number), "distinct")
        self.distinct = known.select("rep", F.col("geometry").alias("value"), "n", "lists") if read else known
        placed = rows.join(known.select("rep", "value", "lists"), "value").select("rep", F.pmod(F.xxhash64("id"), "lists").cast("int").alias("list"), "id")
        self.members = stored(placed.groupBy("rep", "list").agg(F.collect_list("id").alias("ids")), "members")
        n = self.distinct.agg(F.count("*"), F.sum("n")).first()
        self.mean = (n[1] or 0) / max(1, n[0])


def _with_facts(pairs: DataFrame, left: Classes, right: Classes) -> DataFrame:
    """``expanded`` for pairs with facts, which pass the lists as plain columns."""
    flat = pairs.select("*", *[F.col(f"facts.{n}").alias(n) for n in NAMES]).drop("facts")
    out = expanded_smaller_first(flat, left, right)
    return out.select(*[c for c in out.columns if c not in NAMES], F.struct(*NAMES).alias("facts"))


def expanded(pairs: DataFrame, left: Classes, right: Classes) -> DataFrame:
    """(left_id, right_id, all other columns) from pairs (left_rep, right_rep, ...) of classes: every member of one with every member of the other.
    The rows that a pair makes are shared out among tasks by the lists of members."""
    pairs = pairs.join(left.distinct.selectExpr("rep AS left_rep", "n AS left_n"), "left_rep").join(right.distinct.selectExpr("rep AS right_rep", "n AS right_n", "lists"), "right_rep")
    pairs = stored(pairs, "pairs")
    tasks = task_count(pairs.sparkSession, pairs.agg(F.sum(F.col("left_n").cast("double") * F.col("right_n"))).first()[0])
    kept = [c for c in pairs.columns if c not in ("left_rep", "right_rep", "left_n", "right_n", "lists")]
    listed = pairs.withColumn("right_list", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)))
    listed = listed.join(left.members.selectExpr("rep AS left_rep", "ids AS left_ids"), "left_rep").select("right_rep", "right_list", "left_ids", *kept)
    both = listed.repartition(tasks, "right_rep", "right_list").join(right.members.selectExpr("rep AS right_rep", "list AS right_list", "ids AS right_ids"), ["right_rep", "right_list"])
    return both.withColumn("left_id", F.explode("left_ids")).withColumn("right_id", F.explode("right_ids")).select("left_id", "right_id", *kept)


def spatial_join(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_geometry: str = "geometry", right_geometry: str = "geometry", where: Column | None = None,
    once: bool = False, left_read: Callable[[Column], Column] | None = None, right_read: Callable[[Column], Column] | None = None, **cells
) -> DataFrame:
    """(left_id, right_id, facts) of the pairs that have a point in common, or for which `where` (over facts) holds.

    facts is a struct: contains, within, touches, crosses, overlaps, disjoint, equals, the left geometry being the first. Rows with equal
    geometries are compared as one: ``candidates`` finds the pairs of distinct geometries whose boxes meet, these are compared exactly in Arrow
    batches, and those that hold are expanded to the ids. With `once` both sides are the left table, each pair comes once, with left_id < right_id, and is compared once.
    With `left_read` (`right_read`) the column holds text that this function makes a geometry, such as ``from_wkt``; each distinct text is read once.
    """
    a = Classes(left, left_id, left_geometry, read=left_read)
    b = a if once else Classes(right, right_id, right_geometry, read=right_read)
    where = ~F.col("facts.disjoint") if where is None else where
    pairs = candidates(a.distinct, b.distinct, "rep", "rep", "value", "value", **cells)
    if once:
        pairs = pairs.where("left_id <= right_id")
    one, two = (c.distinct.select(F.col("rep").alias(f"{side}_id"), F.col("value").alias(side)) for c, side in ((a, "left"), (b, "right")))
    found = pairs.join(one, "left_id").join(two, "right_id").select(F.col("left_id").alias("left_rep"), F.col("right_id").alias("right_rep"), relations(F.col("left"), F.col("right")).alias("facts"))
    if not once:
        return _with_facts(found.where(where), a, b)
    # members of a pair of classes come in either order
    either = found.withColumns({"holds": where, "as_found": F.col("facts")}).withColumn("facts", turned(F.col("facts"))).withColumn("holds", F.col("holds") | where)
    either = either.where("holds").select("left_rep", "right_rep", F.col("as_found").alias("facts"), (F.col("left_rep") == F.col("right_rep")).alias("same"))
    out = _with_facts(either, a, a).where("left_id < right_id OR (left_id > right_id AND NOT same)")
    back = F.col("left_id") > F.col("right_id")
    facts = F.when(back, turned(F.col("facts"))).otherwise(F.col("facts"))
    return out.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), facts.alias("facts")).where(where)


def expanded_smaller_first(pairs: DataFrame, left: Classes, right: Classes) -> DataFrame:
    """``expanded``, where the shorter lists of members are the ones that go with the pairs."""
    if left.mean <= right.mean:
        return expanded(pairs, left, right)
    swap = lambda df, what: df.select(F.col(f"right_{what}").alias(f"left_{what}"), F.col(f"left_{what}").alias(f"right_{what}"), *[c for c in df.columns if not c.endswith(f"_{what}")])
    return swap(expanded(swap(pairs, "rep"), right, left), "id")
