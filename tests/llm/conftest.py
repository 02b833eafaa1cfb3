import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["ab", "the", "river", "été", "x", "stone", "of", "and", "green", "Hill", "über", "9", "a,b"]


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """Short random documents with copies, near copies, shared passages, nulls, blanks and a repeated row."""
    r = random.Random(seed)
    sentence = lambda k: " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing"]) for _ in range(k))
    passages = ["\n".join(sentence(r.randint(3, 8)) for _ in range(r.randint(3, 6))) for _ in range(3)]
    texts: list = [None, "", " \n\t", "one", "two words", "\n\n\n\n", "x" * 120, "same line\n" * 6]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.15 and len(texts) > 10:
            texts.append(r.choice(texts))
        elif kind < 0.35 and len(texts) > 10 and (base := r.choice(texts)):
            words = base.split(" ")
            words[r.randrange(len(words))] = r.choice(WORDS)
            texts.append(" ".join(words))
        else:
            body = [sentence(r.randint(1, 25)) for _ in range(r.randint(1, 5))]
            if r.random() < 0.5:
                body.insert(r.randint(0, len(body)), r.choice(passages))
            texts.append("\n".join(body))
    rows = [(3 * k % 181, t, r.choice(["en", "fr", None]), "s", len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[20]]


@pytest.fixture(params=[1])
def rows(request):
    return corpus(request.param)


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
