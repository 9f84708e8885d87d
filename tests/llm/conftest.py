import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti") for c in ("", "n", "st", "del", "vor")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def odd_texts():
    """(doc_id, text): nulls, empty, blank, very long, ties and repeated texts, odd characters."""
    rng = random.Random(3)
    long = "\n".join(sentence(rng, rng.randint(3, 30)) for _ in range(4000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d"), (6, sentence(rng, 40)), (7, long), (8, "x" * 60_000), (9, sentence(rng, 40)), (10, "same text here for two rows of it"),
        (11, "same text here for two rows of it"), (11, "same text here for two rows of it"), (12, "Été — “quoted” 日本語 text… ﬁ İ Σας\r\nline two\x0bthree"), (13, "1234 !!! ??"), (14, "<|endoftext|> and <|im_start|> and \\ <| back"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """With other columns, some named as an operator's own."""
    rows = [(i, t, "en", "src", -1, 0.5, True, "k") for i, t in odd_texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, score double, kept boolean, k1 string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def tokenizer():
    from docspark.llm.queries import tokenizer_path

    return tokenizer_path()
