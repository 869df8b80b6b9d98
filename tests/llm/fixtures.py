"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeats, shared passages, clashing columns."""

import random


def words(rnd, n):
    return " ".join("".join(rnd.choice(["th", "er", "on", "an", "re", "ou"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def documents(spark, seed=0, extra=()):
    rnd = random.Random(seed)
    texts = [words(rnd, rnd.choice([3, 20, 120, 300])) for _ in range(40)]
    passage = words(rnd, 70)
    texts += [f"{words(rnd, 30)} {passage} {words(rnd, 25)}" for _ in range(3)] + [passage]
    copy = texts[2]
    texts += [copy, copy.replace(" ", "\n\t "), copy.upper(), copy + " more", copy.replace("on", "an", 1), " ", "", None, "é ñ ü", "!!! ??? 123", "Größe ÉCOLE İstanbul 数 学", words(rnd, 30_000)]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 7 else None, "clash") for i, t in enumerate([*texts, *extra])]
    rows += [rows[5], (None, "a text without an id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, size string")
