"""Line dedup, quality rules, mixing, packing, n-gram join and language-model scoring on odd rows and against plain Python."""

import itertools
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import line_dedup, lm, lm_scoring, mixing, ngram_join, packing, quality_rules, tokens

WS = " \t\n\x0b\x0c\r"


def ascii_lower(s):
    return s.encode().lower().decode()


def test_line_dedup_against_plain_python(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    held = defaultdict(set)
    key = lambda line: ascii_lower(line.strip(WS))
    for d, t in docs:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 20:
                held[key(line)].add(d)
    want = Counter()
    for d, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(held[key(x)]) < 3 or max(held[key(x)]) == d]
        want[d, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    out = line_dedup.line_dedup(odd)
    got = Counter((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect())
    assert got == want and any(k[2] for k in got)
    assert out.select("row.*").columns == odd.columns
    assert line_dedup.line_dedup(none).count() == 0


def plain_rules(text):
    words = _words(text)
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {i + k for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(WS)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(cover)


def _words(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_quality_rules_against_plain_python(odd, none):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(odd).collect())
    assert got == Counter((r.doc_id, *plain_rules(r.text)) for r in odd.collect())
    assert quality_rules.quality_rules(none).count() == 0


def test_quality_rules_reject_depleted_documents(spark):
    from tests.llm.conftest import documents

    common = " ".join(f"c{i}" for i in range(25))
    rows = [(i, common + f"\nown {i}", "h") for i in range(12)] + [(100 + i, common + f"\nown {i}", f"g{i}") for i in range(12)]
    got = {r.doc_id: (r.n_boilerplate_words, r.kept) for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    assert all(got[i] == (25, False) for i in range(12)) and all(got[100 + i] == (0, True) for i in range(12))
    copies = [(i, common, "h") for i in range(12)]  # documents are counted, not texts
    assert not any(r.kept for r in quality_rules.quality_rules(documents(spark, copies)).collect())
    again = [(1, common, "h")] * 12 + [(2, common, "h")]
    assert all(r.kept for r in quality_rules.quality_rules(documents(spark, again)).collect())
    unnamed = [(None, common + f"\nown {i % 11}", "h") for i in range(22)]
    assert not any(r.kept for r in quality_rules.quality_rules(documents(spark, unnamed)).collect())


def ideal(weights, blocks, slots):
    """How many blocks each source has had in the ideal division after each number of slots, in exact fractions."""
    had, out = [Fraction(0)] * len(blocks), [[Fraction(0)] * len(blocks)]
    for _ in range(slots):
        left = Fraction(1)
        while left and any(h < n for h, n in zip(had, blocks, strict=True)):
            alive = [i for i in range(len(blocks)) if had[i] < blocks[i]]
            speed = {i: Fraction(weights[i], sum(weights[k] for k in alive)) for i in alive}
            step = min([left, *((blocks[i] - had[i]) / speed[i] for i in alive)])
            for i in alive:
                had[i] += step * speed[i]
            left -= step
        out.append(list(had))
    return out


@pytest.mark.parametrize(
    ("weights", "blocks"),
    [
        ([5, 3, 1, 0.5, 20], [3000, 1800, 600, 300, 12000]),
        ([5, 3, 1, 0.5, 20], [40, 7, 90, 300, 2]),
        ([math.sqrt(x) for x in range(1, 60)], [7 * x % 50 for x in range(1, 60)]),
        ([1_000_000, 1], [3000, 2]),
        ([1] * 3000 + [50_000], [1] * 3000 + [2000]),
        ([2.5], [4]),
        ([], []),
    ],
)
def test_mixing_deviates_by_less_than_a_block_from_the_weights(weights, blocks):
    whole = mixing.whole_weights(weights)
    assert all(Fraction(w) * whole[0] == Fraction(weights[0]) * n for w, n in zip(weights, whole, strict=True))
    order = mixing.slot_table(whole, blocks)
    assert sorted(order) == [(i, j) for i, n in enumerate(blocks) for j in range(n)]
    had, checked = [0] * len(blocks), min(len(order), 400 if len(blocks) < 100 else 12)
    for slot, (want, (i, j)) in enumerate(zip(ideal(whole, blocks, checked)[1:], order, strict=False)):
        assert had[i] == j
        had[i] += 1
        assert all(abs(h - w) < 1 for h, w in zip(had, want, strict=True)), slot
    if blocks == [3000, 1800, 600, 300, 12000]:  # 5,900 turns with nobody run out: exact shares throughout
        had = [0] * 5
        for slot, (i, _) in enumerate(order[:17_000], 1):
            had[i] += 1
            assert all(abs(h * sum(whole) - slot * w) < sum(whole) for h, w in zip(had, whole, strict=True))


def test_mixing_keeps_every_row(spark, odd, none):
    out = mixing.mix_sources(odd, weights={"a": 3, "b": 1}, block=2, chunk_rows=2)
    assert Counter((r.row.doc_id, r.row.text) for r in out.collect()) == Counter((r.doc_id, r.text) for r in odd.collect())
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() == odd.count()
    assert mixing.mix_sources(none).count() == 0
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("source"))
    rows = mixing.mix_sources(many, weights={"x": 2, "y": 1, None: 1}, block=10, chunk_rows=300).orderBy("slot", "place").collect()
    shares, had = {"x": 0.5, "y": 0.25, None: 0.25}, Counter()
    assert [r.slot for r in rows] == [i // 10 for i in range(6000)]
    for r in rows[:3900]:
        had[r.row.source] += 1
        assert all(abs(had[s] - sum(had.values()) * m) < 20 for s, m in shares.items())
    sources = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))
    assert sorted(r.slot for r in mixing.mix_sources(sources).collect()) == list(range(5000))
    coarse = mixing.mix_sources(many, block=1, most_blocks=16).collect()
    assert len(coarse) == 6000 and len({r.slot for r in coarse}) <= 16 + 3


def test_packing_round_trip(odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    rows = packing.pack(odd, capacity=64, cell_items=200).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0])
    want = Counter((d, k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for d, all_ids in texts.items() for ids in all_ids for k, a in enumerate(range(0, len(ids), 64)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    total = sum(r.length for r in rows)
    assert len(sequences) <= math.ceil(total / 64) + 8
    assert packing.pack(none).count() == 0


def test_genetic_search_beats_best_fit():
    """Items cut from full bins, which best fit does not put together again."""
    better = 0
    for seed in range(6):
        rng, lengths = np.random.default_rng(seed), []
        for _ in range(40):
            cuts = np.sort(rng.choice(np.arange(10, 91), 2, replace=False))
            lengths += [int(x) for x in np.diff([0, *cuts, 100])]
        plain = packing.Packing(lengths, 100).insert(list(range(len(lengths))))
        found, crossovers = packing.evolve(lengths, 100, seed, [], 8, 60)
        assert crossovers and sorted(i for b in found.bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) == f <= 100 for b, f in zip(found.bins, found.fills, strict=True))
        assert found.fitness() <= plain.fitness()
        better += found.fitness() < plain.fitness()
    assert better >= 4


def test_islands_run_in_many_tasks(spark):
    item = "struct<order: long, id: long, piece: int, start: long, length: long, ids_crc32: long, uid: long>"
    rng = np.random.default_rng(2)
    rows = [(c, [(0, 0, 0, 0, int(n), 0, 0) for n in rng.integers(1, 64, 50)]) for c in range(24)]
    elites = packing.elites_of(spark.createDataFrame(rows, f"cell long, items array<{item}>"), 24, 64, 2, 2, 4, 4)
    assert elites.count() == 48 and elites.where("crossovers > 0").count() == 48
    assert elites.select(F.input_file_name().alias("file")).distinct().count() >= 20


def test_open_sequences_of_cells_are_packed_together(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('river ', cast(1 + id * 13 % 37 as int)) AS text")
    rows = packing.pack(df, capacity=64, cell_items=100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    fills = Counter()
    for r in rows:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 64 and len(fills) <= math.ceil(sum(fills.values()) / 64) + 2


def test_mixing_decides_the_sequences(spark):
    import corpus_pipeline
    from lodestar.llm.common import written

    docs = spark.range(700).select(
        F.col("id").alias("doc_id"), F.expr("repeat('river city ', cast(1 + id * 7 % 23 as int))").alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 5 == 0, "x").otherwise("y").alias("source"), F.lit(0).cast("long").alias("n_chars"),
    )
    size = F.char_length("text")
    slots = mixing.mix_sources(docs, size=size, block=200).orderBy("slot", "place").select("row.doc_id").collect()
    place = {r.doc_id: i for i, r in enumerate(slots)}
    plain = written(docs, "docs")
    mixed = written(mixing.mixed(plain, size=size, block=200).repartitionByRange(4, F.udf(place.__getitem__, "int")("doc_id")).sortWithinPartitions(F.udf(place.__getitem__, "int")("doc_id")), "mixed")
    assert len(mixed.inputFiles()) > 1
    rows = packing.pack(mixed, capacity=64, cell_items=100, ordered=True).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    assert sorted(r.doc_id for r in rows) == list(range(700)) and len(by) < 700
    for k, group in by.items():
        places = [place[r.doc_id] for r in sorted(group, key=lambda r: r.offset)]
        assert places == sorted(places) and places[0] == k and len({p // 100 for p in places}) == 1
    sets = lambda rows: {frozenset(r.doc_id for r in g) for _, g in itertools.groupby(sorted(rows, key=lambda r: r.sequence_id), key=lambda r: r.sequence_id)}
    stage = dict(corpus_pipeline.STAGES)["packing"]
    piped = stage(spark, mixed, "").collect()
    assert [r.sequence_id for r in sorted(piped, key=lambda r: place[r.doc_id])][0] == 0
    assert sets(packing.pack(plain, capacity=64, cell_items=100, ordered=True).collect()) != sets(rows)
    assert packing.pack(docs, capacity=64, cell_items=100, ordered=True).count() == 700  # not read from files


def test_genetic_packing_improves_on_best_fit():
    import random

    rng = random.Random(4)
    lengths = sorted((x for _ in range(40) for x in (lambda a, b: (a, b, 100 - a - b))(rng.randint(20, 45), rng.randint(20, 45))), reverse=True)
    plain = packing.Packing(lengths, 100).insert(list(range(len(lengths))))
    found, _ = packing.evolve(lengths, 100, 1, [], 8, 30)
    assert sorted(i for b in found.bins for i in b) == list(range(len(lengths))) and max(found.fills) <= 100
    assert len(found.bins) <= len(plain.bins)
    child = packing.crossover(plain, packing.Packing(lengths, 100).insert(list(range(len(lengths))), [rng.random() for _ in lengths]), rng)
    assert sorted(i for b in child.bins for i in b) == list(range(len(lengths)))


def plain_join(docs):
    """(id, links, component id) of each (id, text) row, by exact Jaccard of at least 4/5."""
    sets, ids = [], [d for d, _ in docs]
    for _, t in docs:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].add(i)
    links = []
    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in holders[g])
        links.append({j for j, n in both.items() if j != i and 5 * n >= 4 * (len(s) + len(sets[j]) - n)})
    out, seen = [None] * len(docs), set()
    for i in range(len(docs)):
        todo, group = [i], set()
        while todo and i not in seen:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += links[x]
        seen |= group
        for x in group:
            out[x] = (ids[x], len(links[x]), min((ids[y] for y in group if ids[y] is not None), default=None))
    return out


@pytest.mark.parametrize("block", [1024, 2])
def test_ngram_join_against_plain_python(spark, odd, none, block):
    from tests.llm.conftest import BODY, documents

    words = BODY.split()
    more = [(100 + i, " ".join(w if j != 5 * i else f"new{i}" for j, w in enumerate(words)), "z") for i in range(9)]
    a, b = "alpha " * 3 + "beta gamma delta", "one other text of seven words here"
    more += [(200, a, "z"), (200, b, "z"), (201, a, "z"), (202, b, "z"), (None, a, "z"), (None, "without id " * 9, "z"), (203, b.upper(), "z")]
    df = odd.unionByName(documents(spark, more))
    rows = ngram_join.ngram_join(df, block=block).collect()
    want = plain_join([(r.doc_id, r.text) for r in df.collect()])
    assert Counter((r.doc_id, r.n_links, r.component_id) for r in rows) == Counter(want)
    assert all((r.doc_id == r.component_id) for r in rows if r.kept)
    kept = ngram_join.without_near_duplicates(df, block=block)
    assert kept.columns == df.columns
    stay = Counter(r.doc_id for r in kept.collect())
    assert stay[200] == 2 and not (stay[201] or stay[202] or stay[203]) and stay[None] == 2 and stay[7] == 1
    assert ngram_join.ngram_join(none).count() == 0 and ngram_join.without_near_duplicates(none).count() == 0


def test_ngram_join_by_text_ids(spark):
    rows = [("b", "the same five words here and more"), ("a", "The same five words here and more"), ("c", "nothing like it at all, really not")]
    got = {r.key: (r.n_links, r.component_id, r.kept) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "key string, body string"), "key", "body").collect()}
    assert got == {"a": (1, "a", True), "b": (1, "a", False), "c": (0, "c", True)}


@pytest.mark.parametrize("block", [1024, 16])
def test_ngram_join_loses_no_link(spark, block):
    """Families whose members differ by a few words, so that similarities lie on both sides of the threshold, chains among them."""
    rng, rows = np.random.default_rng(8), []
    for family in range(60):
        base = [f"f{family}w{rng.integers(400)}" for _ in range(int(rng.integers(60, 200)))]
        for _ in range(int(rng.integers(2, 40))):
            text = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, 1 + len(base) // 30))):
                text[at] = f"x{rng.integers(10**6)}"
            if rng.random() < 0.1:
                base = text
            rows.append((len(rows), " ".join(text)))
    got = {r.doc_id: (r.n_links, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    want = {d: (n, c) for d, n, c in plain_join(rows)}
    links, found = sum(n for n, _ in want.values()), sum(n for n, _ in got.values())
    assert all(got[d][0] <= want[d][0] for d in want) and links > 5000
    # each pair at the threshold is met with probability 0.999
    assert found >= 0.999 * links and sum(got[d][1] == want[d][1] for d in want) >= 0.99 * len(want)


def test_ngram_join_decides_ties_in_whole_numbers():
    import pandas as pd

    shared = [f"s{i}" for i in range(20_000)]
    texts = [" ".join(shared + [f"{k}{i}" for i in range(n)]) for k, n in (("a", 2500), ("b", 2496), ("c", 2505))]
    frame = pd.DataFrame({"id": [b"a", b"b", b"c"], "part": 0, "one": 0, "two": 0, "copies": 1, "text": texts})
    got = ngram_join.verify(frame, 5, Fraction(4, 5)).set_index("id")["texts"].to_dict()
    sets = [set(ngram_join.shingles(t, 5).tolist()) for t in texts]
    want = {k: sum(5 * len(x & y) >= 4 * len(x | y) for y in sets if y is not x) for k, x in zip([b"a", b"b", b"c"], sets, strict=True)}
    assert got == want and set(want.values()) != {0}


def test_bands_reach_the_recall():
    for s, recall in ((0.8, 0.999), (0.7, 0.95), (0.9, 0.9999)):
        bands, rows = ngram_join.choose_bands(s, recall)
        assert 1 - (1 - s**rows) ** bands >= recall and bands * rows <= 128


def test_word_tokenizer_equals_the_tokenizer():
    from tokenizers import Tokenizer

    texts = ["Hello, World. don't 's-x y z\n\n", "É café ΣΑΣ <|endoftext|>x a.b,c,. 12,3. ..", "", " \t\r\n", "x" * 5000]
    plain = Tokenizer.from_file(tokens.default_path())
    texts += ["a\x01b \x01 c", "WE'LL It's"]
    for most in (400_000, 1):
        tok = tokens.ByteWords(tokens.default_path(), most)
        assert [np.frombuffer(b, "<u4").tolist() for b in tok.encode_texts(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_attention_windows_score_each_id_once_and_sum_to_one():
    model, rng = lm.AttentionModel(11, parts=4, width=6, heads=4), np.random.default_rng(0)
    sizes = np.array([1, 70, 33, 5])
    ids = rng.integers(0, 11, sizes.sum()).astype(np.int32)
    got = model.log10_probabilities(ids, sizes, model.lookup(), 3, most=2)
    assert len(got) == len(ids) and (got < 0).all()
    total = sum(10.0 ** model.log10_probabilities(np.array([1, 2, k], np.int32), np.array([3]), model.lookup(), 3)[2] for k in range(11))
    assert total == pytest.approx(1, abs=1e-5)
    later = ids.copy()
    later[60] = (later[60] + 1) % 11
    changed = model.log10_probabilities(later, sizes, model.lookup(), 3)
    assert np.allclose(changed[:60], got[:60])


def test_attention_windows_against_a_plain_pass():
    model, rng = lm.AttentionModel(9, parts=3, width=5, heads=4), np.random.default_rng(4)
    ids = rng.integers(0, 9, 150)
    got, seq = model.log10_probabilities(ids, np.array([len(ids)]), model.lookup(), 2), [2, *ids.tolist()]
    for i in range(len(ids)):
        first = max(0, i // lm.SCORED * lm.SCORED - lm.CONTEXT)
        q, _, _, own = model.split(model.embed[seq[i]] @ model.project)
        score, value = [], []
        for j in range(first, i + 1):
            _, k, v, _ = model.split(model.embed[seq[j]] @ model.project)
            score.append(math.exp(float(q @ k) + float(model.near[i - j])))
            value.append(v)
        gate = np.exp(sum(w * v for w, v in zip(score, value, strict=True)) / sum(score) @ model.lift + own + model.bias)
        assert got[i] == pytest.approx(math.log10(float(gate @ model.tables[ids[i]] / gate.sum())), abs=1e-4)


def test_attention_gradients():
    model = lm.AttentionModel(7, parts=3, width=4, heads=3)
    for n, p in model.parameters().items():
        setattr(model, n, p.astype(np.float64) + 0.01)
    model.tables = model.tables.astype(np.float64)
    rng = np.random.default_rng(1)
    x, lengths = rng.integers(0, 7, (3, 7)), np.array([6, 4, 2])
    grads = model.step(x, lengths)[0]
    for n, places in {"project": [(0, 0), (1, 4), (2, 7), (0, 15)], "lift": [(1, 2)], "near": [(0,), (2,)], "bias": [(1,)], "embed": [(int(x[0, 0]), 1)]}.items():
        for at in places:
            p = getattr(model, n)
            old, eps = p[at], 1e-4
            p[at] = old + eps
            up = model.step(x, lengths)[3]
            p[at] = old - eps
            down = model.step(x, lengths)[3]
            p[at] = old
            assert grads[n][at] == pytest.approx(-(up - down) / (2 * eps), rel=1e-2, abs=1e-4)


def test_attention_step_gives_expected_counts_by_target(monkeypatch):
    rng = np.random.default_rng(2)
    windows, lengths = rng.integers(0, 7, (5, 7)), np.array([6, 4, 2, 6, 1])
    for loud in (1, 60):  # logits beyond what an exponential takes, too
        model = lm.AttentionModel(7, parts=4, width=4, heads=3)
        model.lift *= loud
        want = np.zeros((7, 4))
        for row, size in zip(windows, lengths, strict=True):
            q, k, v, own = model.split(model.embed[row] @ model.project)
            for i in range(size):
                a = np.exp([q[i] @ k[j] + model.near[i - j] for j in range(i + 1)])
                z = (a @ v[: i + 1] / a.sum()).astype(float) @ model.lift + own[i]
                share = np.exp(z - z.max()) * model.tables[row[i + 1]]
                want[row[i + 1]] += share / share.sum()
        for piece in (1, 2, 32):
            monkeypatch.setattr(lm, "PIECE", piece, raising=False)
            _, found, sums, _ = model.step(windows, lengths)
            got = np.zeros((7, 4))
            got[found] = sums
            assert len(set(found.tolist())) == len(found) and got == pytest.approx(want, abs=1e-3)


def test_new_words_of_many_texts_are_encoded_together(monkeypatch):
    import pandas as pd

    calls, encode = [], tokens.ByteWords.encode
    monkeypatch.setattr(tokens.ByteWords, "encode", lambda self, words: calls.append(len(words)) or encode(self, words))
    letters = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    texts = [f"qz{letters(k)} {letters(k)}éq, ((ж{letters(k)}$$ '{letters(k)} {letters(k)}7 ﬁ{letters(k)}" for k in range(200)]
    frame = pd.DataFrame({"id": range(200), "held_out": False, "text": texts})
    (got,) = lm_scoring.tokenised([frame], tokens.default_path(), {})
    assert len(calls) == 1
    plain = tokens.ByteWords(tokens.default_path()).tokenizer
    assert [np.frombuffer(i, "<u2").tolist()[:-1] for i in got["ids"]] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_training_windows_hold_every_id_once():
    import pandas as pd

    texts = ["one two three " * 100, "", "short text"]
    frame = pd.DataFrame({"id": range(3), "held_out": False, "text": texts})
    ids = [i for f in lm_scoring.tokenised([frame], tokens.default_path(), {}) for i in f["ids"]]
    rows = [w for i in ids for w in lm_scoring.windows_of(i)]
    targets = [i for r in rows for i in np.frombuffer(r, "<u2")[1:].tolist()]
    plain = tokens.ByteWords(tokens.default_path())
    assert targets == [i for t in texts for i in [*np.frombuffer(plain.encode_texts([t])[0], "<u4").tolist(), lm_scoring.END_ID]]
    (counts,) = lm_scoring.target_counts([pd.DataFrame({"ids": ids})])
    assert dict(zip(counts["id"], counts["n"], strict=True)) == Counter(targets)
    windows, lengths = lm_scoring.as_windows(rows, np.arange(1 << 16))
    assert windows.shape == (len(rows), lm.LENGTH + 1) and lengths.sum() == len(targets)


def test_training_on_all_windows_beats_training_on_a_sixth(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    stems = [["bal", "cor", "dim", "fen"], ["gul", "hax", "jor", "kib"]]
    texts = [" ".join("".join(rng.choice(stems[d % 2], 3)) for _ in range(200)) for d in range(300)]
    df = spark.createDataFrame([(d, t) for d, t in enumerate(texts)], "doc_id int, text string")
    held = [F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0]
    few = df.where(held[0] | (F.col("doc_id") % 6 == 0))
    options = {"steps": 3, "parts": 8, "first": 16, "rate": 0.02}
    total = lambda frame: lm_scoring.lm_scores(frame, **options).where("held_out").agg(F.sum("score")).first()[0]
    assert total(df) > total(few)


def test_sums_of_task_vectors(spark):
    rows = [(t, k, [float(t), float(k)]) for t in range(70) for k in range(3)]
    got = lm_scoring.added(spark.createDataFrame(rows, "task int, piece int, x array<double>"), 70, fan_in=4)
    assert got.tolist() == [v for k in range(3) for v in (sum(range(70)), 70.0 * k)]


def test_reading_the_scores_again_scores_nothing(spark):
    df = spark.createDataFrame([(i, f"one two three {i % 5} four") for i in range(40)], "doc_id long, text string")
    got = lm_scoring.lm_scores(df, steps=2, first=16, rounds=1)
    assert "MapInPandas" not in got._jdf.queryExecution().toString()
    assert got.collect() == got.collect() and got.count() == 40 and all(r.score < 0 for r in got.collect())


def test_lm_scores_counts(odd, none):
    rows = lm_scoring.lm_scores(odd, steps=5, parts=8, hot_words=4).collect()
    train, texts = Counter(), defaultdict(list)
    for r in odd.collect():
        words = [*(r.text or "").encode().lower().split(), b""]
        texts[r.doc_id].append(words)
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10:
            train.update(words)
    whole = math.log10(sum(train.values()) + 0.1 * (len(train) + 1))
    want = Counter((d, len(w), sum(train[x] > 0 for x in w), round(sum(math.log10(train[x] + 0.1) - whole for x in w), 4)) for d, ws in texts.items() for w in ws)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == want
    assert all(r.train_tokens == sum(train.values()) and r.score < 0 for r in rows)
    assert lm_scoring.lm_scores(none, steps=2, parts=4).count() == 0




def fewest(lengths, capacity):
    """The fewest bins, by trying all placements with the longest first."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def place(k, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if k == len(lengths):
            best = len(fills)
            return
        for b in range(len(fills)):
            if fills[b] + lengths[k] <= capacity and fills[b] not in fills[:b]:
                place(k + 1, [*fills[:b], fills[b] + lengths[k], *fills[b + 1 :]])
        place(k + 1, [*fills, lengths[k]])

    place(0, [])
    return best


def test_genetic_packing_of_small_cells_against_all_placements():
    rng, saved, missed = np.random.default_rng(12), 0, 0
    for seed in range(150):
        lengths = [int(n) for n in rng.integers(15, 60, rng.integers(1, 11))]
        found, _ = packing.evolve(lengths, 100, seed, [], 6, 40)
        plain = packing.Packing(lengths, 100).insert(list(range(len(lengths))))
        want = fewest(lengths, 100)
        assert want <= len(found.bins) <= len(plain.bins) and max(found.fills, default=0) <= 100
        assert sorted(i for b in found.bins for i in b) == list(range(len(lengths)))
        saved, missed = saved + len(plain.bins) - len(found.bins), missed + len(found.bins) - want
    assert saved > 0 and missed <= 2, (saved, missed)
