import pytest

from pyspark.sql import Row, types as T

SF = "/root/testdata/sf0.001"
LONG = "thing and that with " * 60_000


def schema(*extra):
    return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in extra)])


#: names that the operators use inside
CLASHING = ["id", "u", "v", "k", "h", "h1", "n", "size", "kind", "bin", "keep", "_s", "_r", "_gone", "_rep", "_rn", "_redacted", "word", "label", "group_id"]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it again today.", "en", "a", 78),
        (1, "The quick brown fox jumps over the lazy dog and runs away from it again today.", "en", "a", 78),
        (2, "The quick brown fox jumps over the lazy dog and runs away from it again today.", None, "a", 78),
        (3, None, "en", "b", None),
        (3, None, "en", "b", None),
        (4, "", "en", None, 0),
        (5, "", "en", "c", 0),
        (None, "Write to jo.doe@example.com or call +1 (212) 555-0187 soon.", "en", "d", 58),
        (None, None, None, None, None),
        (6, LONG, "en", "e", len(LONG)),
        (7, "   \n\t ", "en", "f", 6),
        (8, "!!! ??? ...", "en", "g", 11),
        (9, "!!! ??? ...", "en", "g", 11),
        (10, "ß É ñ 中文 🙂 d'été it's", "fr", "h", 24),
        (11, "x", "en", "i", 1),
        (12, "a\n" * 500, "en", "j", 1000),
    ]
    return spark.createDataFrame([(*r, *("z" * len(CLASHING))) for r in rows], schema(*CLASHING))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], schema())


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([Row(doc_id=1, quality=1, toxic=0), Row(doc_id=1, quality=None, toxic=0), Row(doc_id=8, quality=0, toxic=None)], "doc_id long, quality int, toxic int")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
