"""Plain versions of what the operators compute, and tables with awkward rows."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
AWKWARD = "doc_id long, text string, DOC_ID2 string, n_words long, component_id long, _score double, a string"


def words(text, pattern=SPACED):
    return re.findall(pattern, text or "")


def awkward_rows():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [None, "", "   \n\t", "one", "One TWO", "é ß İ 日本", long, long, "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n", "x\x1cy   z", "$$$ !!! ***", "<|endoftext|> x"]
    rows = [(i, t, "x", 1, 2, 0.5, "a") for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[8], (None, texts[8], None, None, None, None, None), (None, None, None, None, None, None, None)]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), AWKWARD)


def empty(spark):
    return spark.createDataFrame([], AWKWARD)
