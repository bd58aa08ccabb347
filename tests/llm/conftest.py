import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, row long, size long, key string, bucket string, content string"


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    full = [(i, t, "en", s, len(t or ""), 1, 2, 3, "k", "b", "c") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu Nu. Xi, omicron é".split()) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, source): null, empty, blank, very long, repeated, near and exact copies, shared passages."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    passage = prose(rng, 60)
    out = [(0, None, None), (1, "", "a"), (2, " \n\t ", "a"), (3, "one two", "b"), (4, "One  two", "b"), (5, "x" * 300, None)]
    out += [(6, base, "a"), (7, base, "c"), (8, base.upper(), "a")]
    for k in range(9, 30):
        near = list(words)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = f"edit{rng.randint(0, 9)}"
        out.append((k, " ".join(near), rng.choice("abc")))
    out += [(k, prose(rng, rng.randint(3, 90)) + " " + passage + " " + prose(rng, rng.randint(0, 90)), rng.choice("abc")) for k in range(30, 45)]
    out += [(k, prose(rng, rng.randint(1, 200)), rng.choice(["a", "b", "c", None])) for k in range(45, 70)]
    out += [(70, prose(rng, 12000), "a"), (71, "ab " * 4000, "b"), (72, "<|endoftext|> <|im_end|> ünḯ 　 ﷺ 1٣ it's", "c")]
    out += [(6, base, "a"), (80, "same id, one text", "b"), (80, "same id, other text", "b"), (-5, "negative", "c"), (2**40, "large", "c")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
