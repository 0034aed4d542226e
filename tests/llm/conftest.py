"""Small tables with the cases every operator defines: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import pytest

LONG = "lorem ipsum dolor sit amet " * 8000
ROWS = [
    (1, "the cat sat on the mat and looked at the dog", "en", "a", 44, "x"), (2, None, "en", "a", None, "x"),
    (3, "", None, None, 0, None), (4, " \n\t ", "de", "b", 4, "x"), (5, LONG, "la", "b", len(LONG), "x"),
    (6, "der hund und die katze sitzen auf der matte", "de", "b", 43, "x"),
    (7, "der hund und die katze sitzen auf der matte", "de", "a", 43, "x"),
    (7, "der hund und die katze sitzen auf der matte", "de", "a", 43, "x"), (None, "who has no id at all", "en", "a", 20, "x"),
    (8, "123 456 ... !!!", "en", None, 15, "x"), (9, "één ‘twee’ ½ ñandú 日本語 текст x\x1cy <|endoftext|> it's", "nl", "c", 50, "x"),
    (10, "one", "en", "c", 3, "x"), (11, "one", "en", "d", 3, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `{}` string"


@pytest.fixture
def docs(spark):
    """Odd documents with one extra column of the given name."""
    def make(extra="rank", rows=ROWS):
        return spark.createDataFrame(rows, SCHEMA.format(extra)).repartition(3)
    return make


@pytest.fixture
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
