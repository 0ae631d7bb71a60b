"""Small corpora with the odd cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rank int"


def rows(n=60, seed=3):
    """Texts with exact copies, nulls, empties, odd white space, non-ASCII and one long text."""
    r = random.Random(seed)
    words = ["the", "river", "Stone", "größe", "señal", "ligne", "of", "x", "token", "data", "été", "walks"]
    make = lambda k: " ".join(r.choice(words) + r.choice(["", "", ",", "."]) for _ in range(k))
    texts = [make(r.randint(1, 120)) for _ in range(n)]
    texts += [texts[0], texts[1].replace(" ", "\t"), " " + texts[2], "", None, None, "  \n ", "a", make(20000)]
    sources = ["s1", "s1", "s1", "s2", None, "s3"]
    return [(i * 3 + 1, t, "en", sources[i % 6], None if t is None else len(t), "clash", 1) for i, t in enumerate(texts)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
