import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASHES = ["uid", "k", "t", "row", "c", "d", "b", "name", "level", "kept", "held_out", "score", "size", "taken", "i", "key", "v",
           "normal", "tokens", "host", "slot", "sid", "cid", "label", "id"]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]) tuples, with clashing extra columns."""

    def build(rows, extra=True):
        full = [(r[0], r[1], *(list(r[2:]) + ["en", "src1"][len(r) - 2:])[:2], None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.select("*", *[F.lit(n).alias(c) for n, c in enumerate(CLASHES)]) if extra else df

    return build


LONG = " ".join(f"w{i * 7919 % 100003}" for i in range(60000))


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (4, ""), (None, "a b c d e f g h"), (None, None),
            (5, LONG), (6, LONG), (6, LONG), (7, LONG + " tail"), (8, "é ü 漢字 x"), (9, "é ü 漢字 x", None, None),
            (-3, " \t\n"), (10, "x" * 50000), (10, "x" * 50000)]


@pytest.fixture(scope="session")
def sf_mid():
    return "/root/testdata/sf0.01"
