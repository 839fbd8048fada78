"""Fill-in-middle, cost-balanced packing and tokenizer alignment on odd rows and against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import alignment, cost_packing, fim

TEXTS = [
    "one line", "one\ntwo\n", "\n\n\n", "\nä é\n漢字\n𝄞 clef", "no end\nlast", "a<P>b\nc", "x <S> y", "<M>", "<\n<S\nP>\n<", "", None, " \r\n\r\n ", "tab\tend\x0b\x0c",
    "nul\x00 in", "word " * 5000 + "\nend", "é\n" * 3000,
]


def rows_of(spark, texts):
    from tests.llm.conftest import documents

    return documents(spark, [(i, t, "s") for i, t in enumerate(texts)])


# --- fill in middle


@pytest.mark.parametrize("size", [0, 1, 63, 64, 511, 512, 513, 5000])
def test_rank_and_select_against_counting(size):
    rng = np.random.default_rng(size)
    for share in (0.0, 0.01, 0.5, 1.0):
        bits = rng.random(size) < share
        found = fim.Bits(bits)
        assert found.before[-1] == bits.sum()
        at = np.arange(size + 1)
        assert found.rank(at).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
        assert found.select(np.arange(bits.sum())).tolist() == np.flatnonzero(bits).tolist()


def plain_fim(doc, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_plain_python(spark, odd, none):
    for df in (odd, rows_of(spark, TEXTS), rows_of(spark, [t for t in TEXTS for _ in range(40)])):
        for rate, share in ((100, 50), (70, 0), (70, 100)):
            out = fim.fill_in_middle(df, rate=rate, spm_rate=share).select("*", fim.restored(F.col("output"), F.col("form")).alias("again")).collect()
            got = Counter((r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out)
            assert got == Counter(plain_fim(r.doc_id, r.text, rate=rate, spm=share) for r in df.collect())
            assert all(r.again == (r.row.text or "") for r in out)
    assert fim.fill_in_middle(odd).select("row.*").columns == odd.columns
    assert fim.fill_in_middle(none).count() == 0


def test_fill_in_middle_cuts_lie_in_long_batches():
    texts = [("line %d\n" % i) * (i % 50) + "é" * (i % 3) for i in range(6000)]
    import pyarrow as pa

    one, two = np.arange(6000) * 7919, np.arange(6000) * 104729
    got = fim._cuts(pa.array(["skipped", *texts]).slice(1), pa.array(one), pa.array(two), most=50_000).to_pylist()
    for i, (t, g) in enumerate(zip(texts, got, strict=True)):
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        a, b = sorted((one[i] % (len(units) + 1), two[i] % (len(units) + 1)))
        p, m = "".join(units[:a]), "".join(units[a:b])
        assert g == {"n": len(units), "first": len(p.encode()), "second": len((p + m).encode()), "prefix_chars": len(p), "middle_chars": len(m)}


# --- cost-balanced packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_packing(df, out, tokenizer, capacity, end_id=1):
    """Every id lies in one piece, offsets have no gaps, sequences are full or a power of two, one of each at most."""
    want = Counter()
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, end_id], "<u4")
        want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    rows, seats, cover = out.collect(), defaultdict(list), defaultdict(Counter)
    for r in rows:
        seats[r.sequence_id].append((r.offset, r.length))
        cover[r.doc_id, r.doc_tokens][r.start, r.length] += 1
    ids_of = {}
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, end_id], "<u4")
        ids_of.setdefault((r.doc_id, len(ids)), []).append(ids)
    lengths = []
    for seq in seats.values():
        at = 0
        for offset, n in sorted(seq):
            assert offset == at and n > 0
            at += n
        lengths.append(at)
    short = [n for n in lengths if n != capacity]
    assert all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short) and sum(lengths) == sum(n * c for (_, n, _), c in want.items())
    for key, docs in ids_of.items():
        covered = np.zeros(key[1], int)
        for (start, n), c in cover[key].items():
            covered[start : start + n] += c
        assert (covered == len(docs)).all()
    crcs = {k: {(s, n) for s, n in c} for k, c in cover.items()}
    for r in rows:
        assert any(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in ids_of[r.doc_id, r.doc_tokens])
    assert crcs.keys() == ids_of.keys()


def test_cost_packing_holds_every_id_once(spark, odd, none, tokenizer):
    check_packing(odd, cost_packing.pack(odd), tokenizer, 2048)
    many = rows_of(spark, [t for t in TEXTS for _ in range(20)] + ["w " * (37 * i % 900) for i in range(300)]).repartition(7)
    check_packing(many, cost_packing.pack(many), tokenizer, 2048)
    check_packing(many, cost_packing.pack(many, capacity=128, cell_tokens=5000, task_tokens=300), tokenizer, 128)
    assert cost_packing.pack(none).count() == 0


def test_balanced_cuts_no_more_than_it_has_bins_and_levels_costs():
    rng = np.random.default_rng(5)
    lengths = [int(n) for n in np.minimum(1000, rng.lognormal(5, 1, 4000)).astype(int) + 1]
    bins = [2048] * (sum(lengths) // 2048)
    placed, left = cost_packing.balanced(lengths, bins, 1.0, 1 / 6144)
    assert len(placed) + len(left) <= len(lengths) + len(bins)
    fill, cost, got = np.zeros(len(bins), int), np.zeros(len(bins)), np.zeros(len(lengths), int)
    for item, _, n, b in placed:
        fill[b] += n
        cost[b] += n + n * n / 6144
        got[item] += n
    for item, _, n in left:
        got[item] += n
    assert (fill == 2048).all() and got.tolist() == lengths
    order = rng.permutation(len(lengths))  # documents one after another, cut where a sequence is full
    starts = np.cumsum(np.array(lengths)[order]) - np.array(lengths)[order]
    plain = np.zeros(len(bins) + 1)
    for s, n in zip(starts, np.array(lengths)[order], strict=True):
        while n > 0:
            take = min(n, 2048 - s % 2048)
            plain[s // 2048] += take + take * take / 6144
            s, n = s + take, n - take
    assert cost.max() < plain[:-1].max() and cost.std() < 0.7 * plain[:-1].std()


# --- tokenizer alignment


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_alignment(text, both):
    """(groups, links) of a whole text by the definition: common ends, overlaps of byte ranges."""
    from tokenizers.decoders import ByteLevel  # noqa: F401

    a, b = both
    if not text:
        return [], []
    hidden = [c for c in range(256) if not (33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255)]
    byte_of = {chr(256 + i): c for i, c in enumerate(hidden)} | {chr(c): c for c in range(256) if c not in hidden}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b), strict=True)]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
        p, q = int(np.searchsorted(ends_a, cut)) + 1, int(np.searchsorted(ends_b, cut)) + 1
        groups.append((ids_a[i:p], ids_b[j:q]))
        i, j = p, q
    links, j = [], 0
    for i, end in enumerate(ends_a):
        start = end - len(bytes_a[i])
        while ends_b[j] <= start:
            j += 1
        k = j
        while k < len(ids_b) and ends_b[k] - len(bytes_b[k]) < end:
            links.append((ids_a[i], ids_b[k]))
            k += 1
    return groups, links


ODD_TEXTS = [
    "Hello world", "  two spaces", "end ", " \n", "\nfoo\nbar", "a\r\nb\r\n\r\nc();\r\n  }", "tabs\t\tand\x0bmore\x0c x", "it's we'll 'twas x's", "naïve café 漢字テスト 한국어 🙂🙂",
    "<|endoftext|> <s> </s> <unk> <0x0A>", "under▁score", "　wide　space 　x", "nb sp thin \x85 nel", "\x1c\x1d ctl!\x1c !\x1c\x1c x", "x​y᠎z ᠎",
    "é combining", "12345 3.14 1,000", "    indent\n        deep\n\n\n", "", None, "▁", " ", "\r", "\x00nul", "ﬁ ligature ² ½", "a" * 3000, "ab " * 2000, "don’t “quote”",
]


def expected(texts, both):
    found = [plain_alignment(t, both) for t in texts]
    held = Counter(p for _, links in found for p in set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    for groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), text,
        )


def test_alignment_against_whole_texts(spark, odd, none, both):
    fixture = rows_of(spark, ODD_TEXTS + ["the cat sat on the mat, again.", "the cat sat on the mat, again."] + ODD_TEXTS[:9]).repartition(5)
    for df in (fixture, odd, none):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = Counter((d, *x) for (d, _), x in zip(rows, expected([t for _, t in rows], both), strict=True))
        out = alignment.align(df)
        assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        got = Counter(tuple(r) for r in out.collect())
        assert got == want
    digest = alignment.align(fixture, derive=lambda c: F.sha2(c, 256)).collect()
    assert all((r.groups == "") == (r.n_a == 0) and len(r.groups) in (0, 64) for r in digest)


def test_alignment_by_units_equals_whole_texts_in_many_blocks(both):
    rng = np.random.default_rng(3)
    marks = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " \n ", "　", "\x1c", "!\x1c ", "\xa0", "'s", "▁"]
    words = ["alpha", "Beta", "x1", "naïve", "漢字", "<s>", "..", "᠎", "🙂", "İ", "don't"]
    import public_tokenizers

    aligner = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), most=60)
    assert aligner.local
    for _ in range(40):
        texts = ["".join(rng.choice(words if k % 2 else marks) for k in range(rng.integers(0, 30))) for _ in range(20)]
        found, want = aligner.block(texts), list(expected(texts, both))
        assert [tuple(int(x) for x in s) for s in found["sums"]] == [w[:4] for w in want] and found["groups"] == [w[6] for w in want]
        links = [Counter(p for p in plain_alignment(t, both)[1]) for t in texts]
        for i, own in enumerate(links):
            a, b = (found["ends"][i - 1] if i else 0), found["ends"][i]
            assert {int(found["pairs"][k]): int(n) for k, n in zip(found["link"][a:b], found["times"][a:b], strict=True)} == {(x << 32) + y: n for (x, y), n in own.items()}
        assert dict(zip(found["pairs"].tolist(), found["held"].tolist(), strict=True)) == Counter((x << 32) + y for own in links for x, y in own)


def test_union_find_against_merging_sets():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (10, 5), (300, 200), (300, 2000)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        sets = [{i} for i in range(n)]
        for x, y in zip(u, v, strict=True):
            if sets[x] is not sets[y]:
                merged = sets[x] | sets[y]
                for z in merged:
                    sets[z] = merged
        assert alignment.union_find(n, u, v).tolist() == [min(s) for s in sets]
