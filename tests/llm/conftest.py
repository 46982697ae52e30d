import pytest
from pyspark.sql import types as T

#: Extra columns carry names that the operators use inside.
CLASHING = ["n_words", "kept", "lines", "h", "component", "size", "s", "start", "score", "node", "text_key", "key", "t", "_row", "_text", "digest", "rank", "page", "starts", "id", "k1"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in CLASHING])


def prose(seed: int, words: int) -> str:
    """Reproducible words, in lines of twelve."""
    state, out = seed * 7919 + 1, []
    for i in range(words):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append("w%x" % (state >> 12) + ("\n" if i % 12 == 11 else " "))
    return "".join(out).strip()


def edge_rows():
    base = prose(1, 300)
    near = base.replace(base.split()[150], "changed")
    passage = " ".join(prose(9, 90).split())
    texts = [
        (1, base, "a"), (2, base, "b"), (3, near, "a"), (3, near, "a"), (4, None, "a"), (5, "", "b"), (6, " \t\n\x0b\x0c\r ", None), (7, "one two three", "a"), (8, "One TWO three", "b"), (9, "é ñ 日本語 😀   　x", None),
        (10, prose(3, 200) + "\n" + passage + "\n" + prose(4, 80), "a"), (11, prose(5, 60) + " " + passage, "b"), (12, passage + "\nPASSAGE", "c"), (13, "a" * 3000, "c"), (14, "same line here\n" * 60, "c"),
        (15, "x y z " * 400, "a"), (None, base, None), (None, None, "a"), (None, prose(6, 120), "b"), (16, "#$% *a* &b& | <c>\n" * 3 + prose(7, 70), "a"), (17, prose(8, 20000), "a"), (18, "  double  spaces  and ▁ marks ", "b"),
    ]
    return [(i, t, None if i == 7 else "en", s, None if t is None else len(t)) + (None,) * len(CLASHING) for i, t, s in texts]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
