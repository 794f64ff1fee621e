import pytest

#: Texts that every operator must take.
EDGES = [
    None, "", " ", "  ", "a  b", "\n", "a\n\n b  \n c", "x\xa0 y\u3000\n z", "it's 'S ''s don't\t\tx", "<s> </s> [INST]", "é" * 50, " a", "a ", "a ", "ﬁn \x1c x",
    "<|endoftext|> <|startoftext|>x", "<|ENDOFTEXT|>, 3.14, it's, end.,", "word " * 3000, "ΑΣ ΣΑΣ ǅ İx", "a b c", "A b C", "a b", "x x x x", "l1\nl1\n \n \nl2",
]


@pytest.fixture(scope="session")
def edges():
    return list(enumerate(EDGES))


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (id, text) as a table with more columns, some named like those that operators use inside."""

    def make(rows):
        extra = [(i, t, "n", 1, "k", 2, None) for i, t in rows]
        return spark.createDataFrame(extra, "doc_id long, text string, node string, n int, _rows string, _starts int, _quality string")

    return make


@pytest.fixture(scope="session")
def corpus():
    """Some hundred texts, with near copies, exact copies and passages that several share."""
    import random

    rng = random.Random(3)
    words = lambda n, v=3000: [f"v{rng.randrange(v)}" for _ in range(n)]
    base, passage, short = words(120, 5000), words(60), words(50)
    texts = []
    for _ in range(60):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(len(near))] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(near))
    for k in range(40):
        texts.append(" ".join(words(rng.randrange(90)) + passage[: rng.choice([49, 50, 55, 60])] + words(rng.randrange(60)) + (short if k % 3 == 0 else [])))
    texts += [" ".join(["a"] * 200), " ".join(["a"] * 70), " ".join(["a"] * 49), " ".join(["a", "b"] * 60), " ".join(["b", "a"] * 60), *[texts[65]] * 3, texts[67] + " tail"]
    return [(1000 - 3 * i, t) for i, t in enumerate(texts)]
