import random

import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from evidex.llm.ship import ship

    ship(spark)


WORDS = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "io", "un", "ent")]
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, text_sha256 string, sig bigint, place int, h int, runs int, "
          "shingle string, component string, ids int, position int, slot int, shard string, v int, tree int")


def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, short texts, names that clash."""
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base, long = prose(120), prose(30_000)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \t\n", base, base.upper(), " ".join(near), base, long, long + " end", "a b c", "A B C", "a b c d e", prose(60) + " " + base,
             "12 34 ...", "x" * 5000, "mail bob.1@mail2.example.com now", "É", "日本語" * 40, "word " * 200, "word " * 300]
    rows = [(k, t, None if k % 5 == 0 else "en", None, None) + (None,) * 13 for k, t in enumerate(texts)]
    return rows + [rows[3], rows[7]]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """Texts with copies, near copies and shared passages, by id."""
    r = random.Random(11)
    make = lambda n: [r.choice(WORDS) for _ in range(n)]
    passage = make(70)
    out = []
    for _ in range(25):
        base = make(r.randint(1, 150))
        for _ in range(r.randint(1, 5)):
            text = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 5))):
                text[r.randrange(len(text))] = r.choice(WORDS)
            if r.random() < 0.3:
                at = r.randint(0, len(text))
                text[at:at] = passage
            out.append(r.choice((" ", "\n", "  ")).join(text))
    r.shuffle(out)
    return dict(enumerate(out))
