import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [(1, "The cat sat on the mat and slept all day", "en", "s1"), (1, "The cat sat on the mat and slept all day", "en", "s1"), (2, None, None, None), (3, "", "en", "s2"),
        (4, " \n\t ", "de", "s2"), (5, "word", None, "s1"), (None, "a text without any number of its own", "en", None), (6, LONG, "en", "s3"),
        (7, "the CAT sat on the mat and slept all day", "en", "s3"), (8, "12 34 !", "fr", "s1"), (9, "Größe é 😀 😀 naïve", "de", "s1")]
CLASH = {"shard": "x", "slot": 1, "bits": "b", "tile": 2, "node": 3, "size": 4, "copies": 5, "key": "k", "text_key": "t", "_rank": 6, "score": 0.5, "lang_pred": "zz"}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names the operators use themselves."""
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASH]
    rows = [(i, t, la, s, len(t) if t is not None else None, *CLASH.values()) for i, t, la, s in ROWS]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in CLASH.items())
    df = spark.createDataFrame(rows, kinds)
    assert df.columns == names
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
