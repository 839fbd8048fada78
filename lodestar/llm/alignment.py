"""Alignment of two tokenizers over the same texts: minimal groups, links and how many documents hold each linked pair."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from lodestar.llm.common import slices, written
from lodestar.llm.tokens import groups_of, process_cache

#: White space before which neither tokenizer joins anything to the character in front, unless that is white space.
CUT_CHARS = " \t\n\x0b\x0c"
#: From one such place to the next: white space, then other characters; white space of other kinds does not end a unit.
UNIT = re.compile(rf"\s*\S+(?:[^\S{CUT_CHARS}]\s*\S+)*(?:[^\S{CUT_CHARS}]\s*\Z)?|\s+")
SPACE = "▁"


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for edges (u, v) over nodes 0 to n - 1.

    Rounds of union (the larger of two roots hangs on the smaller) over all edges at once, each followed by finds that halve the paths.
    """
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        open_ = parent[u] != parent[v]
        u, v = u[open_], v[open_]
    return parent


class Aligner:
    """Groups and links of units of text, found once and kept by the process.

    A text is cut into units at places where both tokenizers certainly end a token, so its ids and groups are
    those of its units in order. If the tokenizers do not allow that, a text is one unit.
    """

    def __init__(self, a_path: str, b_path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = process_cache(f"aligner {a_path} {b_path}")
        if "known" not in cache:
            cache["known"] = {}
            cache["vocabularies"] = self.load(a_path, b_path)
        self.known, self.most = cache["known"], most
        self.a, self.b, self.a_bytes, self.b_bytes, self.a_sizes, self.b_sizes, self.local, self.written = cache["vocabularies"]

    @staticmethod
    def load(a_path: str, b_path: str):
        import json

        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        # the byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on
        shown = [c for r in (range(33, 127), range(161, 173), range(174, 256)) for c in r]
        hidden = [c for c in range(256) if c not in set(shown)]
        byte_of = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(hidden)}
        if set(byte_of) != set(pre_tokenizers.ByteLevel.alphabet()):
            raise ValueError("the byte-level alphabet is not the expected one")
        a_bytes = [b""] * a.get_vocab_size(with_added_tokens=True)
        for piece, i in a.get_vocab(with_added_tokens=True).items():
            a_bytes[i] = bytes(byte_of[c] for c in piece) if set(piece) <= byte_of.keys() else piece.encode()

        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items() <= (spec["pre_tokenizer"] or {}).items() and not spec["normalizer"]
        joins = re.compile(rf"[^\s{SPACE}][{CUT_CHARS}{SPACE}]")
        local = plain and not any(joins.search(p) for i, p in enumerate(pieces) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i)))
        local = local and b.encode("a\n  b") == b.encode("a") + b.encode("a\n  b")[1:]
        sizes = lambda data: np.array([len(x) for x in data], np.int64)
        written = [f"{mark}{i}" for table, marks in ((a_bytes, ";,"), (b_bytes, "|,")) for mark in marks for i in range(len(table))]
        return a, b, a_bytes, b_bytes, sizes(a_bytes), sizes(b_bytes), local, written

    def units(self, text: str) -> list[str]:
        return UNIT.findall(" " + text) if self.local else [" " + text]

    def encode_b(self, text: str) -> list[int]:
        """B's ids; it adds a space in front itself. A text that does not begin with one is put behind a letter, whose id is taken off."""
        return self.b.encode(text[1:]) if len(text) > 1 and text[0] == " " else self.b.encode("a" + text)[1:]

    def learn(self, units: list[str]) -> None:
        """Aligns the units that are not known: (n_a, n_b, n_groups, groups, linked pairs), or None if the bytes differ.

        New units stand one after another in texts of some thousand characters, which both tokenizers cut between them; only
        a unit that ends in white space stands alone.
        """
        new = [u for u in units if u not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = units
        together, size = [[]], 0
        for u in new:
            alone = not self.local or u[-1].isspace()
            if alone or size > 8000:
                together.append([])
                size = 0
            together[-1].append(u)
            size = 8001 if alone else size + len(u)
        together = [g for g in together if g]
        texts = ["".join(g) for g in together]
        in_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        in_b = [self.encode_b(t) for t in texts]
        good = []
        for g, t, x, y in zip(together, texts, in_a, in_b, strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            if b"".join(map(self.a_bytes.__getitem__, x)) == raw and b"".join(map(self.b_bytes.__getitem__, y)) == raw:
                good.append((g, x, y))
            elif len(g) == 1:
                self.known[g[0]] = None
            else:  # some unit of these: one by one
                for u in g:
                    ids = self.a.encode(u, add_special_tokens=False).ids, self.encode_b(u)
                    raw = u.encode("utf-8", "surrogatepass")
                    if all(b"".join(map(table.__getitem__, i)) == raw for table, i in zip((self.a_bytes, self.b_bytes), ids, strict=True)):
                        good.append(([u], *ids))
                    else:
                        self.known[u] = None
        if good:
            done = list(chain.from_iterable(g for g, _, _ in good))
            flat = (np.fromiter(chain.from_iterable(x[k] for x in good), np.int64) for k in (1, 2))
            self.known.update(zip(done, self.align(done, *flat), strict=True))

    def align(self, units: list[str], a: np.ndarray, b: np.ndarray):
        """The figures of each unit, from the ids of all units in order. They stand one after another on one line of bytes.

        Every stretch between two neighbouring token ends, of either tokenizer, is the overlap of one token of A and one of B:
        these are the links, the edges of the overlap graph. Its components, by union-find, are the minimal groups.
        """
        end_a, end_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        stops = np.cumsum(np.fromiter((len(u) if u.isascii() else len(u.encode("utf-8", "surrogatepass")) for u in units), np.int64, len(units)))
        ends = np.union1d(end_a, end_b)
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        root = union_find(len(a) + len(b), link_a, link_b + len(a))
        # a component's least node is its first token of A; components stand in order
        first = np.flatnonzero(np.diff(root[: len(a)], prepend=-1))
        of_a, of_b = (np.searchsorted(first, r) for r in (root[: len(a)], root[len(a) :]))
        new_a, new_b = np.diff(of_a, prepend=-1) > 0, np.diff(of_b, prepend=-1) > 0
        # written one after another: ";a" opens a group, "|b" its other side, ",a" and ",b" go on
        n = len(self.a_bytes)
        codes = np.concatenate([np.where(new_a, a, a + n), np.where(new_b, b, b + len(self.b_bytes)) + 2 * n])
        order = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), np.concatenate([of_a, of_b])))
        words = list(map(self.written.__getitem__, codes[order].tolist()))
        pairs = (a[link_a] << 32) | b[link_b]
        cuts = [np.searchsorted(e, stops, side="right") for e in (end_a, end_b, ends)] + [np.searchsorted(end_a[np.append(first[1:], len(a)) - 1], stops, side="right")]
        table = np.diff(np.stack(cuts, axis=1), axis=0, prepend=0)
        at = (cuts[0] + cuts[1]).tolist()
        text = ["".join(words[p:q])[1:] for p, q in zip([0, *at], at, strict=False)]
        at = cuts[2].tolist()
        own = [pairs[p:q] for p, q in zip([0, *at], at, strict=False)]
        return zip(*table[:, [0, 1, 3]].T.tolist(), text, own, strict=True)

    def block(self, texts: list[str]) -> dict:
        """Figures of each text, and the block's distinct pairs with the number of its texts that hold them.

        links: for each text in turn (up to ends), the places of its distinct pairs among the block's, and how often it has them.
        """
        split = [self.units(t) if t else [] for t in texts]
        n_units = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        place = dict.fromkeys(flat)
        self.learn(list(place))
        place = dict(zip(place, range(len(place)), strict=True))
        codes = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        empty = (0, 0, 0, "", np.zeros(0, np.int64))
        facts = [self.known[u] for u in place]
        bad = np.fromiter((f is None for f in facts), bool, len(facts))
        facts = [f or empty for f in facts]
        doc = np.repeat(np.arange(len(texts)), n_units)
        if bad.any():
            spoilt = np.zeros(len(texts), bool)
            spoilt[doc[bad[codes]]] = True
            codes, doc, n_units = codes[~spoilt[doc]], doc[~spoilt[doc]], np.where(spoilt, 0, n_units)
        columns = list(zip(*facts, strict=True)) if facts else [()] * 5
        sizes = np.fromiter(map(len, columns[4]), np.int64, len(facts))
        table = np.stack([*(np.array(columns[k], np.int64) for k in range(3)), sizes], axis=1)
        ends = np.cumsum(n_units)
        run = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(table[codes], axis=0)])
        sums = run[ends] - run[ends - n_units]
        pairs, of_unit = np.unique(np.concatenate(columns[4]) if facts else np.zeros(0, np.int64), return_inverse=True)
        first, n_links = np.cumsum(sizes) - sizes, sizes[codes]
        link = of_unit[np.repeat(first[codes] - (np.cumsum(n_links) - n_links), n_links) + np.arange(n_links.sum())]
        owned, times = np.unique(np.repeat(doc, n_links) * max(1, len(pairs)) + link, return_counts=True)
        owner, link = owned // max(1, len(pairs)), owned % max(1, len(pairs))
        listed, at = codes.tolist(), ends.tolist()
        groups = [";".join(map(columns[3].__getitem__, listed[p:q])) for p, q in zip([0, *at], at, strict=False)]
        held = np.bincount(link, minlength=len(pairs))
        used = np.flatnonzero(held)  # pairs of texts that were set aside are not held
        link = np.searchsorted(used, link)
        ends = np.searchsorted(owner, np.arange(len(texts)), side="right")
        return {"sums": sums, "groups": groups, "pairs": pairs[used], "held": held[used], "link": link, "times": times, "ends": ends}


def align_rows(batches, a_path: str, b_path: str, kind, most_chars: int):
    """Arrow batches of (id, text) in, Arrow batches of the aligned rows of one block out."""
    import pyarrow as pa
    from pyspark import TaskContext

    context = TaskContext.get()
    number, aligner = (context.partitionId() if context else 0) << 32, Aligner(a_path, b_path)
    for frame in slices(batches):
        texts = frame["text"].tolist()
        for a, b in groups_of(texts, most_chars):
            found, n = aligner.block(texts[a:b]), b - a
            lists = lambda values, ends, t: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, t))
            whole = np.full(n, len(found["pairs"]))  # the block's pairs stand in its first row
            columns = [
                pa.array(np.full(n, number), pa.int64()), pa.array(frame["id"].tolist()[a:b], kind.field("id").type),
                *(pa.array(found["sums"][:, k], pa.int64()) for k in range(4)), pa.array(found["groups"], pa.string()),
                lists(found["link"], found["ends"], pa.int32()), lists(found["times"], found["ends"], pa.int32()),
                lists(found["pairs"], whole, pa.int64()), lists(found["held"], whole, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)
            number += 1


def looked_up(rows, counts):
    """The rows of one block (an Arrow table) with the sums over their links of the counts of the block's pairs."""
    import pyarrow as pa

    ends = np.cumsum([len(x) for x in rows["link"]])
    doc = np.repeat(np.arange(rows.num_rows), np.diff(ends, prepend=0))
    link, times = (rows[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("link", "times"))
    n, top = (np.zeros(int(link.max(initial=-1)) + 1, np.int64) for _ in range(2))
    places, c, t = (counts[x].combine_chunks().flatten().to_numpy(zero_copy_only=False) for x in ("place", "n", "top"))
    n[places], top[places] = c, t
    out = rows.select(["id", "n_a", "n_b", "n_groups", "n_links"])
    for name, values in (("n_best", top[link]), ("count_sum", n[link])):
        total = np.zeros(rows.num_rows, np.int64)
        np.add.at(total, doc, times * values)
        out = out.append_column(name, pa.array(total))
    return out.append_column("groups", rows["groups"])


def aligned(df: DataFrame, id_col: str, text_col: str, a_path: str | None = None, b_path: str | None = None, most_chars: int = 2_000_000) -> DataFrame:
    """One row per document: block, id, n_a, n_b, n_groups, n_links, groups and what the counts need (link, times, pairs, held).

    groups is the text `a1,a2|b1;a3|b2,b3` of the minimal groups in order.
    """
    import public_tokenizers

    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    figures = "n_a long, n_b long, n_groups long, n_links long, groups string"
    schema = f"block long, id {df.schema[id_col].dataType.simpleString()}, {figures}, link array<int>, times array<int>, pairs array<long>, held array<long>"
    kind = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.mapInArrow(lambda b: align_rows(b, a_path, b_path, kind, most_chars), schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, a, b, n, top) of every pair of ids that is linked in a document: n counts those documents, top says whether no other
    pair of a has more. A pair is a * 2^32 + b; blocks have counted their documents already."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "held")).alias("z"))
    n = each.groupBy(F.col("z.pairs").alias("pair")).agg(F.sum("z.held").alias("n"))
    a = F.shiftright("pair", 32)
    counts = n.select("pair", a.alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), "n")
    return counts.withColumn("top", F.col("n") == F.max("n").over(W.partitionBy("a")))


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, derive: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every text in both tokenizers (A on space + text, B on the text, which adds the space), cut into minimal groups, with its links' counts.

    Returns per document: the id, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by the most documents
    among the pairs of its A id), count_sum (of the pair's documents, over the links) and groups (``a1,a2|b1;...``, or what `derive` makes of it, so that
    long texts need not be stored).

    Plan: one pass tokenises and aligns. Distinct units (words with the white space in front) are aligned once in a process; union-find
    over the overlap graph gives the groups. Up to 512 texts or two million characters are a block: it counts the texts of each of its distinct
    pairs, so what is shuffled are (block, pair) rows and not links. Counts are summed by pair, joined back by pair, gathered by
    block (no more than its links) and looked up there. A pair that every block holds is split by adaptive execution.

    Cases: null and empty texts and texts whose tokens do not give the bytes back have no tokens: zeros and '' (not passed through `derive`);
    null ids and repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
    """
    rows = aligned(df, id_col, text_col, a_path, b_path)
    groups = F.when(F.col("groups") == "", "").otherwise((derive or (lambda c: c))(F.col("groups")))
    rows = written(rows.withColumn("groups", groups), "aligned")
    counts = written(pair_counts(rows.where(F.size("pairs") > 0)).select("pair", "n", "top"), "pairs")
    each = rows.where(F.size("pairs") > 0).select("block", F.posexplode("pairs").alias("place", "pair"))
    found = each.join(counts, "pair").groupBy(F.col("block").alias("found")).agg(*(F.collect_list(c).alias(c) for c in ("place", "n", "top")))
    schema = f"id {df.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    out = rows.drop("pairs", "held").groupBy("block").cogroup(found.groupBy("found")).applyInArrow(looked_up, schema)
    return out.withColumnRenamed("id", id_col)
