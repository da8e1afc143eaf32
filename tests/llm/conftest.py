import zlib

import pytest

SF = "/root/testdata/sf0.001"

SYLLABLES = "al be ga del ep ze et the io ka lam mu nu xi om pi rho sig tau up phi chi psi ome".split()


def sentence(seed: int, n: int) -> str:
    """n words, different for each seed."""
    numbers = [zlib.crc32(f"{seed}-{i}".encode()) for i in range(n)]
    return " ".join("".join(SYLLABLES[x // 24**k % 24] for k in range(3)) for x in numbers)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, null and empty texts, repeated rows, a very long text, and extra columns with names that operators use."""
    long_text = " ".join(sentence(i, 50) for i in range(800))
    rows = [
        (1, sentence(1, 60), "en"), (1, sentence(1, 60), "en"), (2, sentence(1, 60), None), (3, None, "en"), (4, "", "en"),
        (5, "   \n\n ", "en"), (6, long_text, "en"), (None, sentence(2, 60), "en"), (7, "one two", "en"), (8, "!!! 123", "en"),
        (9, sentence(2, 60), "fr"), (10, sentence(9, 40) + "\n" + sentence(1, 60), "fr"),
    ]
    rows = [(a, b, c, i, "x", i, "y", 0.5, "k", "z", "u", "v", b) for i, (a, b, c) in enumerate(rows)]
    names = "doc_id long, text string, lang string, node long, key string, label int, text_hash string, score double, class_id string, _part string, file string, `_language` string, media string"
    return spark.createDataFrame(rows, names)
