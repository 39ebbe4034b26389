"""Small documents with every awkward case, shared by the operator tests."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, k_id string, row string, n int, word string"


def odd_texts():
    r = random.Random(11)
    words = [f"{a}{b}" for a in ("al", "be", "ga", "de", "ep", "zé") for b in ("ra", "ton", "mi", "lok", "ßu", "ner")]
    body = lambda n: " ".join(r.choice(words) for _ in range(n))
    long_, near, twice = body(20_000), body(400), body(60)
    return [
        (1, None), (2, ""), (3, "   \t\n "), (4, "one two"), (5, "One  TWO"),
        (6, near), (7, near), (8, near.replace("al", "AL", 1)), (9, near + " " + body(4)),
        (10, long_), (11, long_[: len(long_) // 2] + " cut " + long_[len(long_) // 2 :]),
        (12, "x" * 1000), (13, ("same line of text here\n") * 40), (14, "\x1f\u00a0\u2003 odd  spaces\x85 kept"),
        (15, twice), (15, twice), (16, near), (16, near), (None, body(80)), (None, near), (None, None),
        (17, "mail me.at+1@ex-am.ple.org, 10.0.0.255 or +1 (980) 555-6268; card 4111 1111 1111 1111."),
    ]


def odd_documents(spark):
    """The texts above with columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), 7, "key", "k", "row", 1, "w") for i, t in odd_texts()]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)
