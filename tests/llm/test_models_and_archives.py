"""Toxicity, quality, embeddings, WARC archives and the pipeline."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import embedding_dedup, quality_model, toxicity, warc
from lodestar.llm.common import written

WORDS = ["the", "river", "flows", "north", "of", "city", "and", "mountain", "rises", "quiet", "idiot", "village", "water", "moron", "stupid"]


@pytest.fixture(scope="module")
def costs():
    counts = np.zeros(toxicity.SIZE**3)
    import pandas as pd

    for f in toxicity.trigram_frames([pd.DataFrame({"text": [" ".join(WORDS * 40)]})]):
        counts[f["gram"]] = f["n"]
    return toxicity.language_model(counts).tolist()


@pytest.mark.parametrize(
    ("token", "words"),
    [("1d10t", ["idiot"]), ("m.o.r.o.n", ["moron"]), ("iiidiiioot", ["idiot"]), ("$tup1d!!", ["stupid"]), ("m0r0n.", ["moron"]), ("river***", ["river"]), ("river!!", ["river"]), ("###", []), ("don't", ["dont"])],
)
def test_restored_words(costs, token, words):
    assert toxicity.restored(token, costs) == words


def test_spaced_letters(costs):
    assert "idiot" in toxicity.text_words("you are an i d i o t indeed", costs, {})
    assert toxicity.text_words("", costs, {}) == set()


def labelled(spark, n=400):
    rng = np.random.default_rng(3)
    clean = [w for w in WORDS if w not in ("idiot", "moron", "stupid")]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(clean, 30))
        toxic, junk = i % 4 == 0, i % 5 == 0
        if toxic:
            words[int(rng.integers(30))] = str(rng.choice(["idiot", "moron", "1d10t", "s t u p i d"]))
        text = " ".join(f"{w}###" if junk else w for w in words)
        docs.append((i, text))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_doubled_and_spaced_letters(costs):
    for token in ("iddiioott", "idiiot", "iidiot", "idiott", "id1ioot"):
        assert "idiot" in toxicity.restored(token, costs), token
    for text in ("an i  d  i o   t indeed", "an\ni\nd\ni\no\nt\nindeed", "i d\ti o t"):
        assert "idiot" in toxicity.text_words(text, costs, {}), text
    for gap in (" " * 5, "\t" * 40, " \n " * 7):
        assert "idiot" in toxicity.text_words("an " + gap.join("idiot") + " indeed", costs, {})
    assert toxicity.restored("letter", costs)[0] == "letter"


def test_letters_of_other_scripts(costs):
    for token in ("mоron", "ѕtupid", "idіоt", "m0rоn"):
        assert toxicity.restored(token, costs) in (["moron"], ["stupid"], ["idiot"]), token
    assert toxicity.restored("город", costs) == ["город"] and toxicity.restored("είναι", costs) == ["είναι"]


def test_decode_equals_an_exhaustive_search(costs):
    """The cheapest of all readings of the lattice, each costed from scratch."""
    import itertools

    def cost(ways):
        total, a, b = 0.0, toxicity.EDGE, toxicity.EDGE
        for read, extra in ways:
            total += extra
            if read == " ":
                if b != toxicity.EDGE:
                    total, a, b = total + costs[a][b][toxicity.EDGE], toxicity.EDGE, toxicity.EDGE
            elif read:
                s = toxicity.symbol(read)
                total, a, b = total + costs[a][b][s], b, s
        return total + (costs[a][b][toxicity.EDGE] if b != toxicity.EDGE else 0.0)

    for token in ("1d10t", "s-t-u-p", "m0r0n!", "aa.bb", "!d!o+", "l@@mp"):
        best = min(cost(ways) for ways in itertools.product(*toxicity.lattice(token)))
        readings = {"".join(r for r, _ in ways).split().__str__() for ways in itertools.product(*toxicity.lattice(token)) if cost(ways) <= best + 1e-9}
        assert str(toxicity.decode(token, costs)) in readings


def test_toxicity_takes_a_very_long_odd_token(costs):
    assert toxicity.restored("1d" * 5000, costs)


def test_toxicity_held_out(spark, odd, none):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.toxicity_scores(docs, labels).collect() if r.held_out]
    assert {r.doc_id for r in rows} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.95
    out = toxicity.toxicity_scores(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.without_toxic(odd, labels).columns == odd.columns
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert all(r.score == 0 for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect())


def test_quality_held_out(spark, odd, none):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality_model.quality_scores(docs, labels).collect() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.97
    out = quality_model.quality_scores(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert quality_model.quality_scores(none, labels).count() == 0
    assert all(r.score == 0.5 for r in quality_model.quality_scores(odd, labels.limit(0)).collect())


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.Gam(x, y, rounds=20, pair_rounds=40)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


@pytest.mark.parametrize("block", [2048, 7])
def test_embeddings_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(v) for v in base[i % 40] + 0.05 * (i // 40) * rng.standard_normal(16)], i % 2 if i % 11 else 1) for i in range(200)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] * 16, 1), (504, rows[0][1], None), (505, rows[0][1], rows[0][2]), (506, [1.0, 2.0], 1), (507, [2.0, 4.1], 1), (508, [2.0, -4.0], 1), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.embedding_dedup(df, list_size=20, block=block).collect()
    ok = [r for r in df.collect() if r.embedding and len(r.embedding) == 16 and r.label is not None and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]
    x = np.array([r.embedding for r in ok], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= 0.93) & (np.array([r.label for r in ok])[:, None] == np.array([r.label for r in ok])[None, :])
    np.fill_diagonal(link, False)
    want = Counter((r.vec_id, int(n)) for r, n in zip(ok, link.sum(axis=1), strict=True))
    want.update([*((r, 0) for r in (500, 501, 502, 503, 504, 508)), (506, 1), (507, 1)])
    assert Counter((r.vec_id, r.n_links) for r in got) == want
    label = np.array([r.vec_id for r in ok])
    for _ in ok:
        label = np.minimum(label, np.where(link, label[None, :], 1 << 40).min(axis=1))
    named = Counter((r.vec_id, r.component_id) for r in got)
    rest = {500: 500, 501: 501, 502: 502, 503: 503, 504: 504, 506: 506, 507: 506, 508: 508}
    assert named == Counter([*((r.vec_id, int(c)) for r, c in zip(ok, label, strict=True)), *rest.items()])
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_visitors_of_a_list_meet_each_member_once(spark):
    """A list of 20 members and 76 other visitors in blocks of 16: visitors are not dealt out to meet one another."""
    rows = [(i, "a", 1, [1.0, float(i)], 1 if i < 20 else 2, b"", [1, 2], 1) for i in range(96)]
    rows += [(i, "a", 1, [1.0, float(i)], 5, b"", [4, 5], 4) for i in range(9)]  # a list without members
    visits = spark.createDataFrame(rows, "id long, label string, copies long, vector array<double>, home int, code binary, lists array<int>, list int")
    cells = {}
    for r in embedding_dedup.cells_of(visits, 16).collect():
        cells.setdefault((r.list, r.one, r.two), ([], []))[r.held].append(r.id)
    met = Counter((q, c) for asks, holds in cells.values() for q in asks for c in holds)
    assert met == Counter((q, c) for q in range(96) for c in range(20))
    assert sum(len(a) + len(b) for a, b in cells.values()) == 96 * 2 + 20 * 6  # in cells of all pairs of parts: 96 * 6, and 9 more


def test_embeddings_of_random_neighbours_lose_no_link(spark):
    """Pairs of cosine 0.93 to 0.95 in 64 dimensions, without clusters that lists could follow, over 200 lists."""
    rng, n = np.random.default_rng(6), 4000
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal((n, 64))
    side -= (side * x).sum(axis=1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(0.9301, 0.95, n)[:, None]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, c * x + np.sqrt(1 - c * c) * side]))]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), list_size=40).groupBy("n_links").count().collect()
    assert {r.n_links: r["count"] for r in got}.get(1, 0) >= 0.99 * 2 * n and sum(r["count"] for r in got) == 2 * n


def test_embeddings_find_links_across_hundreds_of_lists(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    x = base[np.arange(600) % 30] + 0.22 * rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    link = x @ x.T >= 0.93
    np.fill_diagonal(link, False)
    for options in ({"probes": 1}, {}):
        got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_dedup(df, list_size=2, **options).collect()}
        assert link.sum() > 1000 and got == dict(enumerate(link.sum(axis=1).tolist()))


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "x" * 50), (2, "http://b\r\nX-Page-Id: 9", "x" * 50), (3, None, "é\r\n\r\n漢字 \x1f"), (4, "u", None), (5, "v", ""), (None, "w", "z"), (None, "w", "x" * 50), (6, "q", "".join(chr(32 + (i * i) % 90) for i in range(200_000)))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", __import__("pyspark").sql.functions.lit(1)).repartition(3)
    manifest = warc.write_warc(df, f"file://{tmp_path}/w", roll_bytes=3000)
    whole = None
    for split in (64 << 20, 997, 60):
        rows = warc.read_warc(manifest, split).collect()
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
        whole = whole or got
        assert got == whole
        assert all(r.payload is None or base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest for r in rows)
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = Counter()
    for p, _, h in pages:
        h = h or ""
        keeper = max((q for q, _, o in pages if (o or "") == h and q is not None), default=None)
        revisit = keeper is not None and p != keeper
        want[p, len(h.encode()), digest(h), "revisit" if revisit else "response", keeper if revisit else None] += 1
    assert whole == want
    assert warc.read_warc(warc.write_warc(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_warc_ranges_are_read_by_many_tasks(spark, tmp_path):
    df = spark.range(2000).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "concat('page ', sha2(cast(id AS string), 512)) AS html").repartition(10)
    manifest = warc.write_warc(df, f"file://{tmp_path}/w")
    records = warc.read_warc(manifest, 5000).select("page_id", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.page_id for r in records) == list(range(2000)) and len({r.task for r in records}) >= 20


def test_warc_attempts_do_not_touch_each_other(spark, tmp_path):
    from pyspark.sql import Row

    class Context:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):  # noqa: N802
            return 0

        def taskAttemptId(self):  # noqa: N802
            return self.attempt

    import pandas as pd
    from pyspark import TaskContext

    paths, before = [], TaskContext.get
    try:
        for attempt, payload in ((1, b"abc"), (2, b"other payload")):
            TaskContext.get = lambda a=attempt: Context(a)
            row = {"page_id": 1, "url": "u", "payload": payload, "payload_digest": "X", "refers_to": None}
            paths += [m for f in warc.write_part([pd.DataFrame([row])], f"file://{tmp_path}", "d", 1 << 20) for m in f.itertuples(index=False)]
    finally:
        TaskContext.get = before
    for m in paths:
        assert warc.read_warc(spark.createDataFrame([Row(path=m.path, bytes=m.bytes)])).count() == 1


def test_warc_reader_skips_false_magic_and_damage(spark, tmp_path):
    class Row:
        page_id, url, payload, payload_digest, refers_to = 1, "u", b"abc", "D", None

    good = warc.record_bytes(Row, "d")
    data = b"\x1f\x8b\x08junk" + good + b"\x1f\x8b\x08" + b"\0" * 40 + good + good[: len(good) // 2]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    files = spark.createDataFrame([(f"file://{path}", len(data), 1)], "path string, bytes long, records long")
    for split in (10_000, 13):
        assert [r.payload for r in warc.read_warc(files, split).collect()] == [b"abc", b"abc"]


def test_pipeline_stages(spark, odd, tmp_path):
    import corpus_pipeline

    _, labels = labelled(spark, 80)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert docs.columns == before.columns
        if name in ("line_dedup", "mixing"):
            assert docs.count() == before.count()
        if name == "near_duplicates":
            assert docs.where("doc_id in (1, 2, 3)").count() == 1
    assert {r.doc_id for r in docs.collect()} >= {7, 11, 12}


def test_pipeline_stages_without_documents_or_labels(spark, odd, none, tmp_path):
    import corpus_pipeline

    _, labels = labelled(spark, 4)
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_quality_score_is_the_sum_of_its_tables():
    """Every row looked up by hand: the bin of each figure by counting the edges at or below it, the tables and pairs added, then the logistic function."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.normal(size=600), rng.integers(0, 4, 600).astype(float), np.zeros(600), rng.exponential(size=600)], axis=1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 1)).astype(float)
    model = quality_model.Gam(x, y, rounds=20, pair_rounds=10)
    probe = np.vstack([x[:200], [[np.inf, -1, 5, 0], [-np.inf, 9, -5, 1e9]]])
    got = model.score(probe)
    for row, score in zip(probe, got, strict=True):
        bins = lambda edges: [sum(e <= v for e in es) for es, v in zip(edges, row, strict=True)]  # noqa: B023, E731
        fine, rough = bins(model.edges), bins(model.coarse)
        logit = model.base + sum(t[b] for t, b in zip(model.tables, fine, strict=True)) + sum(t[rough[i], rough[j]] for i, j, t in model.pairs)
        assert abs(score - 1 / (1 + np.exp(-np.clip(logit, -40, 40)))) < 1e-12
    assert model.pairs and ((got[:200] > 0.5) == (y[:200] > 0.5)).mean() > 0.9
