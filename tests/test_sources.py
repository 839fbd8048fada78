"""Numbered lines, issues of ingestion, array files, and stored tables that survive killed attempts."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.sources import ingest, readers, tables, writers

FIELDS = {"id": ["string"], "question": ["string"], "score": ["number"], "entities": ["array"], "map": ["object"]}


def lines_of(i):
    good = {"id": f"r{i}", "question": "问", "score": i / 2, "entities": [], "map": {"a": 1}, "more": True}
    odd = [good, good | {"question": None}, {k: v for k, v in good.items() if k != "id"}, good | {"score": "1"}, good | {"entities": {}, "map": []}]
    texts = [json.dumps(o, ensure_ascii=False) for o in odd]
    return [*texts, "", "  ", '{"id": ', "[1, 2]", "7", json.dumps(good)][i % 11]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("lines")
    for f, n in (("a.jsonl", 2000), ("b.jsonl", 1), ("c.jsonl", 0), ("d.jsonl", 37)):
        (path / f).write_text("\n".join(lines_of(i) for i in range(n)) + ("\n" if n % 2 == 0 and n else ""))
    return path


@pytest.mark.parametrize("block", ["128m", "4k"])
def test_lines_are_numbered_across_blocks(spark, folder, block):
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        rows = ingest.numbered_lines(spark, str(folder)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for f in ("a.jsonl", "b.jsonl", "d.jsonl"):
        want = (folder / f).read_text().split("\n")
        want = want[:-1] if want[-1] == "" else want
        assert [r.text for r in sorted((r for r in rows if r.file.endswith(f)), key=lambda r: r.line)] == want
        assert sorted(r.line for r in rows if r.file.endswith(f)) == list(range(1, len(want) + 1))


def test_issues_and_figures_by_file(spark, folder):
    rows = ingest.records(ingest.numbered_lines(spark, str(folder)), FIELDS)
    got = {(r.file.rpartition("/")[2], r.line, r.check, r.field, r.actual) for r in ingest.issues(rows, FIELDS).collect()}
    want = set()
    for f, n in (("a.jsonl", 2000), ("b.jsonl", 1), ("d.jsonl", 37)):
        for i in range(n):
            k = i % 11
            bad = {1: [("L1-1", "question", "null")], 2: [("L1-1", "id", "missing")], 3: [("L1-2", "score", "string")], 4: [("L1-2", "entities", "object"), ("L1-2", "map", "array")]}.get(k, [])
            bad += [("L1-4", "", lines_of(i)[:80])] if k in (7, 8, 9) else []
            want |= {(f, i + 1, *b) for b in bad}
    assert got == want
    files = {r.file.rpartition("/")[2]: r for r in ingest.by_file(rows, FIELDS).collect()}
    a = files["a.jsonl"]
    count = lambda *ks: sum(i % 11 in ks for i in range(2000))
    assert (a.records, a.blank, a.bad) == (count(0, 1, 2, 3, 4, 10), count(5, 6), count(7, 8, 9))
    assert (a.has_id, a.has_question, a.wrong_score, a.wrong_map) == (count(0, 1, 3, 4, 10), count(0, 1, 2, 3, 4, 10), count(3), count(4))


def test_array_files_are_read_again(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"问{i}", None if i % 3 else "x") for i in range(50)], "id string, question string, answer string").repartition(4)
    ingest.json_arrays(df, str(tmp_path / "out"))
    files = list((tmp_path / "out").rglob("part-*"))
    assert sum(len(json.loads(f.read_text())) for f in files) == 50 and len(files) == 4
    again = readers.json_documents(spark, str(tmp_path / "out" / "*"), "id string, question string, answer string")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))


def rows(table):
    return sorted(map(tuple, table.read().collect()))


def test_updates_and_appends_survive_killed_attempts(spark, tmp_path, monkeypatch):
    table = tables.StoredTable(spark, f"file://{tmp_path}/t", "id", buckets=8)
    base = spark.createDataFrame([(i, f"v{i}", float(i)) for i in range(100)], "id int, v string, x double")
    assert table.append(base, "first") and not table.append(base, "first")
    more = spark.createDataFrame([(5, "other", 0.0), (100, "new", 1.0), (100, "new", 1.0), (None, "lost", 2.0)], "id int, v string, x double")
    changes = spark.createDataFrame([(3, "three", None), (7, None, 7.5), (999, "nobody", 1.0)], "id int, v string, x double")

    def killed(*_):
        raise KeyboardInterrupt

    for change in (lambda: table.append(more, "second"), lambda: table.update(changes, ["v", "x"], "third")):
        before = rows(table)
        with monkeypatch.context() as m:
            m.setattr(tables.StoredTable, "_commit", killed)
            with pytest.raises(KeyboardInterrupt):
                change()
        assert rows(table) == before
        assert change() and not change()
    want = [(i, f"v{i}", float(i)) for i in range(100)] + [(100, "new", 1.0)]
    want[3], want[7] = (3, "three", 3.0), (7, "v7", 7.5)
    assert rows(table) == sorted(want)
    one = [d for d in (tmp_path / "t" / "data").iterdir()]
    assert table.clean() > 0 and len(list((tmp_path / "t" / "data").iterdir())) < len(one) and rows(table) == sorted(want)
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(table._list()[0], {})


def test_writers_keep_the_split_and_refuse_to_cut(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "dev")], "id int, split string")
    writers.by_split(df, str(tmp_path / "s"))
    assert sorted((r.id, r.split) for r in spark.read.json(str(tmp_path / "s")).select("id", "split").collect()) == [(1, "train"), (2, "dev")]
    with pytest.raises(ValueError, match="rows"):
        writers.markdown(spark.range(5).select(F.col("id")), 4)
