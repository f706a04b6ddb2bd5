import pytest

HARD_TEXTS = [None, "", " ", "one", "one two", "a\n\nb\n", "word " * 3000, "é ñ 中文 \x1c x", "<|endoftext|> </s>[INST] x", "same text here", "same text here", "x" * 5000, "  lead  and   gaps  ", "tab\tand\r\nline"]


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with nulls, empty and long texts, repeats, equal ids and columns of clashing names."""
    rows = [(i, t, None if i % 2 else "en", "kept", 5, i) for i, t in enumerate(HARD_TEXTS)] + [(3, "one", "en", "kept", 5, 0), (3, "other", "en", "kept", 5, 0), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, score int, start long")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no tables here")
    return path


@pytest.fixture(scope="session")
def byte_bpe():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def piece_bpe():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
