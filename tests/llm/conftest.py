import pytest

ODD = [None, "", " ", "\n\t ", "a", "Ein kurzer Satz.", "The same text again.", "The same text again.", "x" * 70_000, "wort " * 30_000,
       "call +1 (988) 555-2485 or bosbt.42@mail8.example.com", "日本語 テスト 😀", "a\x00b <|endoftext|> c", "\u0301 combining", "1234567890123456"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, very long and repeated texts, repeated and null ids, and extra columns with clashing names."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "s", None if t is None else len(t), i, "x") for i, t in enumerate(ODD)]
    rows += [(3, "A repeated id.", "en", "s", 14, 1, "y"), (None, "No id at all.", "en", "s", 13, 2, "z"), rows[6]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key long, `_Order` string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
