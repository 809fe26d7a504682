import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])

#: Columns that operators might use for themselves.
CLASHES = ["hits", "gone", "node", "class_id", "score", "ids", "key", "__hits", "__gone", "bucket"]

LONG = " ".join(f"word{k % 997} and{k % 31}" for k in range(12_000))
ODD_TEXTS = [
    None, "", " ", "\n", "\n\n", "...", "one", "One two three four", "one two three four five",
    "ONE two three four five", "tab\tand\x0bvertical\x0cfeed\rreturn", "é è ß Σας ΣΑΣ İstanbul",
    "a b c", "<|endoftext|> in a text <|startoftext|>", "don't I'll we've 'tis 's",
    "same line of some length\nsame line of some length\nother", "漢字かな交じり文 の テスト です",
    "12345 67 8 ½ Ⅷ ²", "👩‍👩‍👧 emoji", "x" * 3000, LONG, "aaaa aaaa aaaa aaaa aaaa aaaa aaaa",
]


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of (doc_id, text) rows in the columns of the documents table."""
    def make(rows, extra=()):
        frame = spark.createDataFrame(
            [(i, t, "en" if i is not None and i % 2 else "fr", "s", None if t is None else len(t))
             for i, t in rows], DOCS)
        for name in extra:
            from pyspark.sql import functions as F
            frame = frame.withColumn(name, F.lit("mine"))
        return frame

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Odd texts, a repeated row, and rows without an id; clashing columns."""
    rows = [*enumerate(ODD_TEXTS), (6, "one"), (None, "no id here"), (None, None)]
    return documents(rows, CLASHES)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
