"""Fill-in-middle texts, cut at line ends that succinct rank and select find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUTS = "n long, first int, second int, prefix_chars long, middle_chars long"


class Bits:
    """A packed bit vector with a directory of the bits set before every block of 512.

    ``rank`` and ``select`` read the directory and one block, whatever the length of the vector.
    """

    BLOCK = 512

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.blocks = np.zeros((len(bits) // self.BLOCK + 1, self.BLOCK // 8), np.uint8)
        self.blocks.reshape(-1)[: len(packed)] = packed
        counts = np.bitwise_count(self.blocks.view(np.uint64)).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each position."""
        block, inside = at // self.BLOCK, at % self.BLOCK
        bits = np.unpackbits(self.blocks[block], axis=1, bitorder="little")
        return self.before[block] + (bits & (np.arange(self.BLOCK) < inside[:, None])).sum(axis=1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th set bit, counted from 0."""
        block = np.searchsorted(self.before, k, side="right") - 1
        bits = np.unpackbits(self.blocks[block], axis=1, bitorder="little")
        return block * self.BLOCK + (np.cumsum(bits, axis=1, dtype=np.int16) == (k - self.before[block] + 1)[:, None]).argmax(axis=1)


def cuts_of(data: np.ndarray, offsets: np.ndarray, one: np.ndarray, two: np.ndarray) -> dict[str, np.ndarray]:
    """n, the two cuts in bytes and the code points before and between them, for UTF-8 texts that stand one after another in `data`.

    A bit marks the last byte of every line; the bits between two texts' ends are a text's n, and the bit of a text's u-th
    line, by select, is the last byte of its first u lines. Code points are counted by rank over the bytes that begin one.
    """
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    data = data[offsets[0] : offsets[-1]]
    last = data == 10
    last[ends[ends > starts] - 1] = True
    lines = Bits(last)
    before = lines.rank(starts)
    n = lines.rank(ends) - before
    units = np.sort(np.stack([one % (n + 1), two % (n + 1)]), axis=0)
    cut = np.repeat(starts[None], 2, axis=0)
    for side in (0, 1):
        some = units[side] > 0
        if some.any():
            cut[side, some] = lines.select(before[some] + units[side, some] - 1) + 1
    heads = Bits((data & 0xC0) != 0x80)
    at, first, second = heads.rank(starts), heads.rank(cut[0]), heads.rank(cut[1])
    return {"n": n, "first": cut[0] - starts, "second": cut[1] - starts, "prefix_chars": first - at, "middle_chars": second - first}


def _cuts(texts: pa.Array, one: pa.Array, two: pa.Array, most: int = 4 << 20) -> pa.Array:
    """Arrow arrays in and a struct array of CUTS out, about `most` bytes of text at a time."""
    wide = pa.types.is_large_string(texts.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, ends, values = texts.buffers()
    offsets = np.frombuffer(ends, kind, len(texts) + 1, texts.offset * kind.itemsize).astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    one, two = one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False)
    out, a = [], 0
    while a < len(texts):
        b = max(a + 1, min(a + 2048, int(np.searchsorted(offsets, offsets[a] + most))))
        out.append(cuts_of(data, offsets[a : b + 1], one[a:b], two[a:b]))
        a = b
    kinds = {f: pa.int32() if f in ("first", "second") else pa.int64() for f in ("n", "first", "second", "prefix_chars", "middle_chars")}
    return pa.StructArray.from_arrays([pa.array(np.concatenate([o[f] for o in out]) if out else [], t) for f, t in kinds.items()], list(kinds))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """Every text as prefix, suffix and middle, cut at ends of lines that a hash of its id chooses.

    Returns (row, n, form, first, second, prefix_chars, middle_chars, output): row holds the input's columns, n is the
    number of lines (``[^\\n]*\\n|[^\\n]+``), first and second are the cuts in bytes of UTF-8, output is the transformed text. `rate` of 100 texts are
    transformed, `spm_rate` of 100 of those with the suffix in front. ``restored`` gives the text back.

    Plan: one pass without a shuffle. The texts of an Arrow batch, as they lie in its buffer, get one packed vector of
    line ends with a directory of popcounts; rank gives n of each text and select its two cuts. Hashes, sentinels and the new
    texts stay in the JVM: the batch returns numbers only.

    Cases: null text is an empty one; empty texts and texts that contain a sentinel stay as they are (form plain, characters null, cuts null);
    a null id is hashed as the empty string; repeated rows give equal rows; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]

    @F.arrow_udf(CUTS)
    def cuts(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        return _cuts(texts, one, two)

    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    cut = df.select(F.struct("*").alias("row"), text.alias("text"), form.alias("form"), cuts(text, h[0], h[1]).alias("cut"))

    data, first, second = F.col("text").cast("binary"), F.col("cut.first"), F.col("cut.second")
    prefix = F.substr(data, F.lit(1), first).cast("string")
    middle = F.substr(data, first + 1, second - first).cast("string")
    suffix = F.substr(data, second + 1).cast("string")
    p, s, m = map(F.lit, (PREFIX, SUFFIX, MIDDLE))
    output = (
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(F.col("text"))
    )
    moved = F.col("form") != "plain"
    where = [F.when(moved, F.col(f"cut.{c}")).alias(c) for c in ("first", "second", "prefix_chars", "middle_chars")]
    return cut.select("row", F.col("cut.n").alias("n"), "form", *where, output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Each sentinel occurs once in a transformed text, so it splits at them."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    part = lambda first, mark: (F.substr(F.substring_index(head, mark, 1), F.lit(len(first) + 1)), F.substring_index(head, mark, -1))
    p1, s1 = part(PREFIX, SUFFIX)
    s2, p2 = part(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p1, middle, s1)).when(form == "spm", F.concat(p2, middle, s2)).otherwise(output)
