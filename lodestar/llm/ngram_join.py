"""N-gram Jaccard self-join: MinHash banding finds candidates, full n-gram sets verify them."""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_groups, map_slices, written
from lodestar.llm.components import components
from lodestar.llm.tokens import process_cache


def choose_bands(threshold: float, recall: float, most_hashes: int = 128, most_chance: float = 0.05) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold shares a band with at least the target recall.

    Of the pairs of numbers with bands * rows <= most_hashes it takes that with the most rows, which sends the
    fewest dissimilar pairs to the same bucket, and the fewest bands that reach the recall.
    """
    for rows in range(most_hashes, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no banding reaches the recall within so many hashes")


def word_hashes(words: list[str], most: int = 100_000) -> np.ndarray:
    """A 64-bit hash for each word, kept for the process."""
    import xxhash

    cache = process_cache("word hashes")
    if len(cache) > most:
        cache.clear()
    try:
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in [w for w in set(words) if w not in cache]:
            cache[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's windows of `width` lower-cased words; a shorter text is one window."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9) ^ (out >> np.uint64(32)))


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(grams: np.ndarray, mul: np.ndarray, add: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """The minimum over the set of each of the hash functions."""
    x = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), block):
        part = x[at : at + block, None] * mul + add
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(axis=0), out=least)
    return least


def sign(batches, width: int, bands: int, rows: int):
    """(id, one, two, set digest, 16-bit signature, band hashes) of each text; the last three are null if it has no word."""
    mul, add = coefficients(bands * rows)
    for frame in batches:
        out = []
        for doc, one, two, text in frame[["id", "one", "two", "text"]].itertuples(index=False):
            grams = shingles(text, width)
            if not len(grams):
                out.append((doc, one, two, None, None, None))
                continue
            least = signature(grams, mul, add)
            folded = (least.reshape(bands, rows).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(7)
            band = np.zeros(bands, np.uint64)
            for r in range(rows):
                band = (band ^ folded[:, r]) * np.uint64(0xD6E8FEB86659FD93)
            out.append((doc, one, two, hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), (least & 0xFFFF).astype(np.uint16).tobytes(), band.astype(np.int64)))
        yield pd.DataFrame(out, columns=["id", "one", "two", "digest", "sig", "bands"]).astype({"id": frame["id"].dtype})


def blocked(df: DataFrame, key: list[str], size: str, by: Column, block: int) -> DataFrame:
    """Splits large groups: the members of a group of up to `block` get the cell (0, 0); those of a larger one are
    dealt to k parts and each row goes to the k cells that hold its part, so that every two members meet.

    Adds columns ``one``, ``two`` (the cell) and ``part``.
    """
    parts = F.ceil(F.col(size) / block).cast("int")
    df = df.withColumn("part", F.pmod(by, parts).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(F.col("part"), j).alias("one"), F.greatest(F.col("part"), j).alias("two")))
    return df.withColumn("cell", F.explode(cells)).withColumns({"one": F.col("cell.one"), "two": F.col("cell.two")}).drop("cell")


def alike(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """A spanning forest of a bucket's graph of signatures that agree in at least the share `least`.

    Breadth first: a visited member is compared with the unvisited only, so a tight group costs one pass.
    """
    ids, out = frame["id"].to_numpy(), []
    if len(ids) < 2:
        return pd.DataFrame({"u": ids[:0], "v": ids[:0]})
    sig = np.frombuffer(b"".join(frame["sig"]), np.uint16).reshape(len(ids), -1)
    unseen = np.arange(len(ids))
    while len(unseen) > 1:
        queue, unseen = [unseen[0]], unseen[1:]
        while queue and len(unseen):
            i = queue.pop()
            same = (sig[unseen] == sig[i]).mean(axis=1) >= least
            out += [(ids[i], j) for j in ids[unseen[same]]]
            queue += unseen[same].tolist()
            unseen = unseen[~same]
    return pd.DataFrame(out, columns=["u", "v"])


def joined_sets(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every shingle that at least two of the sets hold, columns numbered from 0."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[col] > 1
    _, dense = np.unique(col[keep], return_inverse=True)
    return row[keep], dense


def intersections(sets: list[np.ndarray], left: int, columns: int = 4096) -> np.ndarray:
    """|A & B| for each of the first `left` sets against all, as products of 0/1 matrices."""
    row, col = joined_sets(sets)
    out = np.zeros((left, len(sets)), np.int64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        a, b = np.searchsorted(col, [at, at + columns])
        held = np.zeros((len(sets), min(columns, int(col[-1]) + 1 - at)), np.float32)
        held[row[a:b], col[a:b] - at] = 1
        out += (held[:left] @ held.T).astype(np.int64)
    return out


def verify(frame: pd.DataFrame, width: int, threshold: Fraction) -> pd.DataFrame:
    """Links of one cell: for each member how many texts, and how many documents, share a bucket with it and reach the threshold by
    exact Jaccard over the full shingle sets, with a spanning forest of them.

    If the frame has a column ``band``, the cell belongs to a bucket of that band; a pair that shares a bucket of an earlier
    band is left to that. Without the members' ``bands`` every two are compared.
    """
    frame = frame.sort_values(["part", "id"])
    ids, part, copies = frame["id"].to_numpy(), frame["part"].to_numpy(), frame["copies"].to_numpy()
    one, two = int(frame["one"].iloc[0]), int(frame["two"].iloc[0])
    sets = [shingles(t, width) for t in frame["text"]]
    size = np.array([len(s) for s in sets], np.int64)
    left = int((part == one).sum())
    both = intersections(sets, left)
    # both / (|A| + |B| - both) >= threshold, in whole numbers
    linked = both * (threshold.numerator + threshold.denominator) >= threshold.numerator * (size[:left, None] + size[None, :])
    bands = np.stack(frame["bands"].to_numpy()) if "bands" in frame else np.zeros((len(frame), 1), np.int64)
    if "band" in frame:
        for earlier in range(int(frame["band"].iloc[0])):
            linked &= bands[:left, earlier, None] != bands[None, :, earlier]
    else:
        shared = np.zeros_like(linked)
        for band in range(bands.shape[1]):
            shared |= bands[:left, band, None] == bands[None, :, band]
        linked &= shared
    if one == two:
        np.fill_diagonal(linked, False)
        texts, docs = linked.sum(axis=1), linked @ copies
    else:  # members of two parts: only pairs across them are new
        linked = linked[:, left:]
        texts = np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])
        docs = np.concatenate([linked @ copies[left:], copies[:left] @ linked])
    label = np.arange(len(ids))
    offset = 0 if one == two else left
    while True:  # the least member in reach, over the links of this cell
        new = label.copy()
        reach = np.where(linked, label[None, offset : offset + linked.shape[1]], len(ids)).min(axis=1, initial=len(ids))
        new[:left] = np.minimum(new[:left], reach)
        back = np.where(linked, new[:left, None], len(ids)).min(axis=0, initial=len(ids))
        new[offset : offset + linked.shape[1]] = np.minimum(new[offset : offset + linked.shape[1]], back)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return pd.DataFrame({"id": ids, "texts": texts.astype(np.int64), "docs": np.asarray(docs).astype(np.int64), "first": ids[label]})


def marked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, one, two): the last two are hashes of a row's id and text, and of its text, which together name it."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("one"), F.xxhash64(text).alias("two"))


def ngram_join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.9999,
    most_hashes: int = 128, block: int = 1024, margin: float = 0.15,
) -> DataFrame:
    """Which documents have a near-duplicate by Jaccard similarity of their sets of `width`-word shingles.

    One row per input row: the id; ``class_id``, the smallest id with the same shingle set; ``n_links``, the other
    rows with similarity >= threshold (copies included); ``n_linked_texts``, the different
    shingle sets among them; ``component_id``, the smallest id reachable over links; ``kept``: whether the row is the
    first of its component by id, then by its hashes ``one`` and ``two`` (see ``marked``), which are returned too.

    Plan: (1) one pass signs each text; (2) documents with equal sets become one class, by partial aggregation, so
    thousands of copies are one row from there on; (3) classes meet on band hashes, and buckets with one member
    leave; (4) in a bucket, members whose signatures agree within `margin` of the threshold are
    tied by a spanning forest, never by all pairs; (5) candidate components; (6) two members of a component that share a bucket
    are compared on their full shingle sets: of a component of up to `block` members in one cell, of a larger one in the first bucket that
    they share. The rule is the same at every size, so growth changes no answer. Large buckets are dealt to cells of `block` members a part (``blocked``). The
    sets are computed where needed; only counts and least members leave a cell, never pairs.

    Cases: null, empty and blank texts link with nothing and are classes of their own; texts shorter than `width`
    words are one shingle; rows that repeat an id are documents of their own, of equal or different texts; a row without
    id links like others, and its component is named by null if no member has an id; an empty table gives an empty result;
    other columns are ignored. Ids may be of any type that can be ordered.
    """
    bands, rows = choose_bands(threshold, recall, most_hashes)
    exact = Fraction(str(threshold))
    kind = df.schema[id_col].dataType.simpleString()
    texts = marked(df, id_col, text_col)
    signed = written(map_slices(texts, lambda b: sign(b, width, bands, rows), f"id {kind}, one long, two long, digest binary, sig binary, bands array<long>"), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "one", "two")).alias("first")
    classes = signed.where("digest IS NOT NULL").groupBy("digest").agg(first, F.count("*").alias("copies"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
    classes = written(classes.withColumnRenamed("digest", "id"), "classes")

    banded = classes.select("id", F.posexplode("bands").alias("band", "h"))
    buckets = banded.groupBy("band", "h").agg(F.count("*").alias("size")).where("size > 1")
    members = banded.join(buckets, ["band", "h"]).join(classes.select("id", "sig"), "id")
    cells = blocked(members, ["band", "h"], "size", F.xxhash64("id"), block)
    ties = map_groups(cells, ["band", "h", "one", "two"], lambda f: alike(f, threshold - margin), "u binary, v binary").distinct()
    candidates = written(components(ties), "candidates")

    sizes = candidates.groupBy("component").agg(F.count("*").alias("size"))
    chosen = candidates.join(sizes, "component").withColumnRenamed("node", "class").join(classes.select(F.col("id").alias("class"), "first", "copies", "bands"), "class")
    named = chosen.select("class", "component", "size", "copies", "bands", "first.one", "first.two")
    held = texts.join(named, ["one", "two"]).groupBy("class", "component", "size", "copies", "bands").agg(F.any_value("text").alias("text"))
    held = written(held.withColumnRenamed("class", "id"), "candidate-texts")
    compared = "id binary, texts long, docs long, first binary"
    small = blocked(held.where(F.col("size") <= block), ["component"], "size", F.xxhash64("id"), block)
    found = map_groups(small, ["component", "one", "two"], lambda f: verify(f, width, exact), compared)
    large = held.where(F.col("size") > block).drop("size").select("*", F.posexplode("bands").alias("band", "h"))
    shared = large.groupBy("component", "band", "h").agg(F.count("*").alias("size")).where("size > 1")
    meet = blocked(large.join(shared, ["component", "band", "h"]), ["component", "band", "h"], "size", F.xxhash64("id"), block)
    links = written(found.union(map_groups(meet, ["component", "band", "h", "one", "two"], lambda f: verify(f, width, exact), compared)), "links")
    joint = components(links.select(F.col("id").alias("u"), F.col("first").alias("v")))

    counts = links.groupBy("id").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    grouped = classes.select("id", "first", "copies").join(counts, "id", "left").join(joint.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    leads = grouped.groupBy("component").agg(F.min("first").alias("lead"))
    per_class = written(grouped.join(leads, "component").select(F.col("id").alias("digest"), "first", "lead", "copies", "texts", "docs"), "per-class")
    lead = F.col("lead")
    return signed.select("id", "one", "two", "digest").join(per_class, "digest", "left").select(
        F.col("id").alias(id_col), F.when(lead.isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce(F.coalesce("docs", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
        F.when(lead.isNull(), F.col("id")).otherwise(lead["id"]).alias("component_id"),
        (lead.isNull() | ((F.col("one") == lead["one"]) & (F.col("two") == lead["two"]))).alias("kept"), "one", "two",
    )


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of ``ngram_join``, with all columns of df; of rows equal in id and text one."""
    kept = ngram_join(df, id_col, text_col, **options).where("kept").select("one", "two")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("one"), F.xxhash64(text).alias("two"))
    return rows.join(kept, ["one", "two"], "left_semi").dropDuplicates(["one", "two"]).select("row.*")
