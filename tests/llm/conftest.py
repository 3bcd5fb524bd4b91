import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, body string, rest string, node long, batch int"


def near_copies(seed: int, groups: int = 6, copies: int = 9) -> list[str]:
    """Texts in groups of near copies, with edits of one to four words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([4, 40, 90]))]
        out.append(" ".join(base))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(1, 4)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    return out


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and unusual characters."""
    texts = [None, "", " \n\t ", "a", "one two", "Wait a minute, this is one line\nsecond line of it\n\nshort", "wait A MINUTE, this is one line \nother", "x" * 50_000, "word " * 20_000, "é ß İ 中文 🙂\r\n\x0b", "mail me@example.org or +1 (212) 555-0100 now"]
    rows = [(i, t, "en" if i % 2 else None, "s", None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "a text without an id", "fr", None, 3), (None, None, None, None, None), (90, texts[5], "en", "t", 1)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, "b", "r", 3, 4) for r in odd_rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
