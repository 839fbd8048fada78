import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, kept string, id int, slot int"
LINE = "this line of boilerplate is in many documents"
BODY = " ".join(f"word{i} lorem ipsum dolor sit amet number {i}" for i in range(12))


def documents(spark, rows):
    """(doc_id, text, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), "r", None, "k", 7, None) for d, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a long text, ties, repeated rows, copies and near copies."""
    near = BODY.replace("word7", "other7")
    rows = [
        (1, BODY, "a"), (2, BODY, "b"), (3, near, None), (4, None, "a"), (5, "", "a"), (6, " \n\t ", "b"), (7, "one two", "c"), (7, "one two", "c"),
        (None, "no id here but some words", "a"), (8, LINE + "\nfirst own line\n" + LINE, "a"), (9, LINE.upper() + "  \nsecond own line", "a"), (10, "third\n" + LINE, "a"),
        (11, " ".join(f"w{i % 977}x{i}" for i in range(30_000)), "d"), (12, "a b c d e f g h " * 9, "d"), (13, "é Éa ÄÖ <|endoftext|> 'S x's..", "d"),
    ]
    return documents(spark, rows).coalesce(2)


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])
