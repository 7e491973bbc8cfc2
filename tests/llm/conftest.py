import pytest

NAMES = "doc_id long, text string, lang string, source string, n_chars int"
#: Columns that share names with working columns of the operators.
CLASHES = ("row", "digest", "id", "n", "key", "hash", "node", "score", "kept", "copy", "place", "words", "place2")


@pytest.fixture
def documents(spark):
    """Documents of (doc_id, text) or (doc_id, text, source) rows, with columns whose names clash."""

    def build(rows, clashes=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, NAMES)
        if clashes:
            for name in CLASHES:
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return build


@pytest.fixture
def awkward(documents):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(20000))
    return documents(
        [(1, None), (2, ""), (3, "one"), (4, "the same text again"), (4, "the same text again"), (5, "the same text again"),
         (None, "without a number"), (None, "without a number"), (7, long), (8, long), (9, "  \n\t "), (10, "naïve Straße 漢字 🙂", None)]
    )
