"""Embedding near-duplicates: inverted lists with product-quantised residuals and exact rerank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_groups, written
from lodestar.llm.components import components


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of at most k clusters of the rows of x."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


class Index:
    """Coarse centres and residual codebooks, fitted on a bounded sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codes: int):
        self.dim = sample.shape[1]
        self.subspaces = next(m for m in range(min(subspaces, self.dim), 0, -1) if self.dim % m == 0)
        self.centres = kmeans(sample, lists, 8, 1)
        rest = sample - self.centres[self.nearest(sample, 1)[:, 0]]
        parts = rest.reshape(len(rest), self.subspaces, -1)
        self.books = [kmeans(np.ascontiguousarray(parts[:, m]), codes, 8, 2 + m) for m in range(self.subspaces)]

    def ranks(self, x: np.ndarray) -> np.ndarray:
        """The place of every list among those nearest to each query, from 0."""
        return self.nearest(x, len(self.centres)).argsort(axis=1)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        far = (self.centres**2).sum(axis=1) - 2 * x @ self.centres.T
        n = min(n, len(self.centres))
        some = np.argpartition(far, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.take_along_axis(far, some, axis=1).argsort(axis=1, kind="stable"), axis=1)

    def encode(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        parts = (x - self.centres[home]).reshape(len(x), self.subspaces, -1)
        return np.stack([((b**2).sum(axis=1) - 2 * parts[:, m] @ b.T).argmin(axis=1) for m, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, x: np.ndarray, listed: int) -> np.ndarray:
        """By subspace and code, the squared distance to each query's residual in a list; the queries of a code lie side by side,
        so that a lookup copies a run of them."""
        parts = (x - self.centres[listed]).reshape(len(x), self.subspaces, -1)
        return np.stack([(b**2).sum(axis=1)[:, None] + (parts[:, m] ** 2).sum(axis=1) - 2 * b @ parts[:, m].T for m, b in enumerate(self.books)])


def probes_needed(batches, index: Index, asked: pd.DataFrame, cosine: float, rows: int = 512):
    """How many links between the batches and the asked vectors, by exact comparison with all, need so many probes: that
    of the two which meets the other sooner counts, since either visit finds the link."""
    own = np.stack(asked["vector"].to_numpy())
    own_ranks, own_label, own_id = index.ranks(own), asked["label"].to_numpy(), asked["id"].to_numpy()
    own_home, found = own_ranks.argmin(axis=1), np.zeros(len(index.centres), np.int64)
    for frame in batches:
        for at in range(0, len(frame), rows):
            part = frame.iloc[at : at + rows]
            x = np.stack(part["vector"].to_numpy())
            i, j = np.nonzero(x @ own.T >= cosine)
            new = (part["label"].to_numpy()[i] == own_label[j]) & (part["id"].to_numpy()[i] != own_id[j])
            i, j = i[new], j[new]
            if len(i):
                ranks = index.ranks(x)
                found += np.bincount(np.minimum(ranks[i, own_home[j]], own_ranks[j, ranks.argmin(axis=1)[i]]), minlength=len(found))
    some = np.flatnonzero(found)
    yield pd.DataFrame({"probes": (some + 1).astype(np.int32), "links": found[some]})


def assign(batches, index: Index, probes: int):
    """Home list, residual code and probed lists of each unit vector; one of another length than the index's is in the
    list of all vectors of its length, which has a negative number and is searched without codes."""
    for frame in batches:
        size = np.fromiter(map(len, frame["vector"]), np.int64, len(frame))
        for part in (frame[size == index.dim].copy(), frame[size != index.dim].copy()):
            if not len(part):
                continue
            if len(part["vector"].iloc[0]) == index.dim:
                x = np.stack(part["vector"].to_numpy())
                near = index.nearest(x, probes).astype(np.int32)
                part["code"] = [c.tobytes() for c in index.encode(x, near[:, 0])]
            else:
                near = -np.fromiter(map(len, part["vector"]), np.int32, len(part))[:, None]
                part["code"] = b""
            part["home"], part["lists"] = near[:, 0], list(near)
            yield part[["id", "label", "copies", "vector", "home", "code", "lists"]]


def cells_of(visits: DataFrame, block: int) -> DataFrame:
    """The visits in cells of a list, each of a part of its members and a part of its visitors (its members among them), of about `block` rows
    at most. A visitor goes with every part of members and a member with every part of visitors, so each visitor meets each member in
    one cell; visitors do not meet each other. A row is there once as a visitor and once more, ``held``, as a member.
    """
    member = F.col("home") == F.col("list")
    sizes = visits.groupBy("label", "list").agg(F.ceil(F.count_if(member) / block).cast("int").alias("ones"), F.ceil(F.count("*") / block).cast("int").alias("twos"))
    rows = visits.join(sizes, ["label", "list"])
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asks = rows.where("ones > 0").select("*", F.lit(False).alias("held"), F.explode(upto("ones")).alias("one"), own("twos").alias("two"))
    holds = rows.where(member).select("*", F.lit(True).alias("held"), own("ones").alias("one"), F.explode(upto("twos")).alias("two"))
    # visitors bring no code and no visits
    kept = lambda c: F.when(F.col("held"), F.col(c)).alias(c)
    return asks.union(holds).select("label", "list", "one", "two", "held", "id", "copies", "vector", "home", kept("code"), kept("lists"))


def search(frame: pd.DataFrame, index: Index, cosine: float, slack: float) -> pd.DataFrame:
    """Links found in one cell of a list, between its visitors and its members; only rows with a link come out.

    Table-lookup distances keep candidates up to `slack` beyond the threshold's distance; exact cosines
    in double precision decide. A pair of different lists is found in either list by whoever visits; to be
    counted once, the visitor is credited where it visits, and the member too if it does not visit back.
    """
    held = frame["held"].to_numpy(bool)
    asks, base = np.flatnonzero(~held), np.flatnonzero(held)
    ids, home, copies = (frame[c].to_numpy() for c in ("id", "home", "copies"))
    listed = int(frame["list"].iloc[0])
    x = np.stack(frame["vector"].to_numpy())
    codes = np.frombuffer(b"".join(frame["code"].iloc[base]), np.uint8).reshape(len(base), index.subspaces if listed >= 0 else 0)
    limit = (2 - 2 * cosine) * (1 + slack) + slack
    lists = frame["lists"].to_numpy()
    names, node = np.unique(ids, return_inverse=True)
    docs, label = np.zeros(len(names), np.int64), np.arange(len(names))
    for at in range(0, len(asks), 256):
        some = asks[at : at + 256]
        far = np.zeros((len(base), len(some)))
        if listed >= 0:
            for table, code in zip(index.tables(x[some], listed), codes.T, strict=True):
                far += table[code]
        c, q = np.nonzero(far <= limit)
        q, c = some[q], base[c]
        hit = np.einsum("ij,ij->i", x[q], x[c]) >= cosine
        q, c = q[hit], c[hit]
        same = ids[q] == ids[c]
        same[same] = (x[q[same]] == x[c[same]]).all(axis=1)  # the row itself
        q, c = q[~same], c[~same]
        if len(q):
            np.add.at(docs, node[q], copies[c])
            back = home[q] != listed
            back[back] = [int(home[i]) not in lists[j] for i, j in zip(q[back], c[back], strict=True)]
            np.add.at(docs, node[c[back]], copies[q[back]])
            label = _forest(np.stack([np.concatenate([node[q], np.arange(len(names))]), np.concatenate([node[c], label])], axis=1), len(names))
    some = (docs > 0) | (label != np.arange(len(names)))
    return pd.DataFrame({"id": names[some], "docs": docs[some], "first": names[label[some]]})


def _forest(edges: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, edges[:, 0], label[edges[:, 1]])
        np.minimum.at(new, edges[:, 1], label[edges[:, 0]])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def embedding_dedup(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, sample: int = 20_000,
    list_size: int = 256, most_lists: int = 4096, probes: int = 16, subspaces: int = 16, codes: int = 64, slack: float = 0.35, block: int = 2048, asked: int = 1024,
) -> DataFrame:
    """Links vectors of equal label whose cosine reaches the threshold.

    One row per input row: the id, ``n_links`` (other vectors linked directly), ``component_id`` (smallest id
    reachable, itself included), ``kept`` (id = component_id), ``class_id`` (smallest id of the same vector).

    Plan: equal vectors of a label become one class by partial aggregation. Centres and codebooks are fitted on
    `sample` unit vectors at most (the hash order decides which) and shipped with the tasks; every vector is indexed. Each class sends its
    vector to its nearest lists of its label: `probes` of them, or more if any link of `asked` vectors, found by exact
    comparison with all others in one pass, needs more; a list's visitors meet its members in cells of `block` rows at most of either
    (`cells_of`), where table lookups choose candidates and exact cosines decide. Only counts and
    least partners leave a cell.

    Cases: vectors that are null, zero, or hold null or non-finite components, and rows with a
    null label, link with nothing; vectors of another length than most link with those of their label and length, all of which
    are compared; rows that repeat an id are vectors of their own and link like others;
    null ids are left out of links; an empty table gives an empty result; other columns are ignored. Ids may be of any type
    that can be ordered.
    """
    kind = df.schema[id_col].dataType.simpleString()
    cols = [F.col(f"`{id_col}`").alias("id"), F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double")).alias("raw"), F.col(f"`{label_col}`").cast("string").alias("label")]
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, v: a + v * v))
    fine = F.forall("raw", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(*cols).withColumn("norm", F.when(fine, norm))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    unit = F.when(usable, F.transform("raw", lambda v: v / F.col("norm")))
    rows = written(rows.select("id", "label", unit.alias("vector")), "vectors")
    valid = rows.where("vector IS NOT NULL")
    dims = valid.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    key = F.struct(F.xxhash64("label", "vector").alias("a"), F.xxhash64(F.lit(7), "label", "vector").alias("b"))
    classes = written(valid.groupBy("label", key.alias("key")).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector")), "vector-classes")
    n, n_labels = classes.agg(F.count("*"), F.count_distinct("label")).first()
    if not n:
        none = F.lit(0).cast("long").alias("n_links")
        return rows.select(F.col("id").alias(id_col), none, F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"), F.col("id").alias("class_id"))

    most = classes.where(F.size("vector") == dims[0].dim)
    chosen = most.orderBy(F.xxhash64("key"), "rep").limit(sample).select("vector").toPandas()
    index = Index(np.stack(chosen["vector"].to_numpy()), int(np.clip(n / n_labels / list_size, 1, most_lists)), subspaces, codes)
    named = classes.select(F.col("rep").alias("id"), "label", "copies", "vector")
    alike = named.where(F.size("vector") == dims[0].dim)
    trial = alike.orderBy(F.xxhash64("id", F.lit("asked")), "id").limit(asked).select("id", "label", "vector").toPandas()
    needed = alike.select("id", "label", "vector").mapInPandas(lambda b: probes_needed(b, index, trial, cosine), "probes int, links long")
    probes = max(probes, needed.agg(F.max("probes")).first()[0] or 0)
    coded = named.mapInPandas(
        lambda b: assign(b, index, probes), f"id {kind}, label string, copies long, vector array<double>, home int, code binary, lists array<int>"
    )
    visits = written(coded, "coded").withColumn("list", F.explode("lists"))
    links = written(map_groups(cells_of(visits, block), ["label", "list", "one", "two"], lambda f: search(f, index, cosine, slack), f"id {kind}, docs long, first {kind}"), "links")
    joint = components(links.select(F.col("id").alias("u"), F.col("first").alias("v")))
    counts = links.groupBy("id").agg(F.sum("docs").alias("docs"))
    found = counts.join(joint.withColumnRenamed("node", "id"), "id", "left")
    per_class = classes.join(found, classes.rep == found.id, "left").select("label", "key", "rep", "copies", "docs", F.coalesce("component", "rep").alias("component"))
    return (
        rows.withColumn("key", F.when(F.col("vector").isNotNull(), key)).join(per_class, ["label", "key"], "left")
        .select(
            F.col("id").alias(id_col), F.coalesce(F.coalesce("docs", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"), F.coalesce("rep", "id").alias("class_id"),
        )
    )
