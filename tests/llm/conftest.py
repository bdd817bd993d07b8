import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        rows = [(*r, *("en", "s")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOC)
        if extra:
            from pyspark.sql import functions as F

            for name in ("size", "row", "digest", "kept", "copies", "block", "target", "key", "n", "text_sha256", "fences"):
                docs = docs.withColumn(name, F.lit("x"))
        return docs

    return make


#: Nulls, empties, ties, repeated rows, white space of all kinds, a very long text.
ODD = [
    (1, "a b c"),
    (2, "a  b\tc"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "a b c"),
    (7, "word " * 30_000),
    (7, "word " * 30_000),
    (8, "für über ÄRGER x  y"),
    (9, "one\x0btwo\x0cthree\r\nfour"),
    (10, "x"),
]
