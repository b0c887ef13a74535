"""Small document tables with the odd cases: nulls, empty and long texts, repeated rows, clashing columns."""

import random

VOCABULARY = [a + b for a in ("ta", "ri", "mo", "ske", "ul", "ver", "ony", "pla") for b in ("n", "del", "rost", "ik", "um", "ea")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def documents(spark, texts, first=0):
    """Ids from ``first`` on; other columns clash with names that operators use."""
    rows = [(first + k, t, "en", 7, 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, node int, n_words int")


def changed(rng, text, n):
    """The text with n single words replaced."""
    words = text.split(" ")
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def seeded(seed=0):
    return random.Random(seed)
