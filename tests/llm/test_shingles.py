import random
import re

import corpus_pipeline
from barloom.llm import shingles


LOWER = {i: i + 32 for i in range(65, 91)}


def shingled(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) / len(a | b)


def jaccard_groups(texts):
    """Sets of the keys of `texts` that are joined by links of 0.8 or more, all pairs compared."""
    own = {d: shingled(t) for d, t in texts.items()}
    group = {d: {d} for d in texts}
    for a in own:
        for b in own:
            if a < b and group[a] is not group[b] and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]):
                group[a] |= group[b]
                for d in group[b]:
                    group[d] = group[a]
    return {id(g): g for g in group.values()}.values()


def copies(rnd, n, changed, of):
    """A text of n words, and `of` copies with `changed` words replaced far from each other."""
    base = [f"w{rnd.randrange(5000)}" for _ in range(n)]
    for k in range(of):
        own = list(base)
        for i in range(changed if k else 0):
            own[(i * n) // changed + rnd.randrange(n // changed - 6)] = f"new{rnd.randrange(10**9)}"
        yield " ".join(own)


def test_near_stage_drops_near_copies(spark, sf):
    rnd = random.Random(3)
    texts = [t for n, changed in ((100, 1), (300, 5), (1000, 20), (300, 20)) for _ in range(10) for t in copies(rnd, n, changed, 2)]
    pairs = [jaccard(texts[i], texts[i + 1]) >= 0.8 for i in range(0, len(texts), 2)]
    assert sum(pairs) == 30  # those with 20 of 300 words replaced are below
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, sf).collect()}
    assert kept == {i for i in range(len(texts)) if i % 2 == 0 or not pairs[i // 2]}


def test_groups_against_all_pairs_whatever_the_bucket(spark):
    rnd = random.Random(4)
    texts = [t for _ in range(3) for t in copies(rnd, 200, 2, 30)] + ["", None, " ", "one two", "One  TWO", "one three"]
    rnd.shuffle(texts)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "no id"), (3, "an id of another row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket in (8, 1000):
        kept = shingles.drop_near_copies(docs, bucket=bucket).collect()
        assert len(kept) == 8  # three groups, the wordless, two short texts, no id, and the id that is used twice
        assert all(jaccard(a.text or "", b.text or "") < 0.8 for i, a in enumerate(kept) for b in kept[:i] if (a.text or "").split() and (b.text or "").split())
    assert shingles.drop_near_copies(docs.limit(0)).count() == 0


def test_components_of_large_bands_are_those_of_all_pairs(spark):
    """Clusters of texts that are made of one, a few words changed in each: most pairs are near the limit, and bands are large."""
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(3000)}" for _ in range(200)]
    texts = {}
    for i in range(400):
        own = list(base)
        for at in rnd.sample(range(200), rnd.randint(3, 5)):
            own[at] = f"new{rnd.randrange(10**9)}"
        texts[i] = " ".join(own)
    want = {min(g) for g in jaccard_groups(texts)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in shingles.drop_near_copies(docs).collect()} == want


def test_recall_of_pairs_just_above_the_limit(spark):
    rnd = random.Random(12)
    texts = [t for _ in range(400) for t in copies(rnd, 230, rnd.choice([3, 4, 5]), 2)]
    near = [i for i in range(0, 800, 2) if 0.8 <= jaccard(texts[i], texts[i + 1]) < 0.88]
    kept = {r.doc_id for r in shingles.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    missed = [i for i in near if i + 1 in kept]
    assert len(near) > 150 and len(missed) <= len(near) // 200


def test_near_stage_links_by_simhash_too(spark, sf):
    """Pairs below the limit whose fingerprints differ in 3 or fewer bits; a third text is linked to the second by shingles alone."""
    from test_dedup import fingerprint

    rnd = random.Random(13)
    texts = [t for _ in range(600) for t in copies(rnd, 300, 13, 2)]
    pairs = [(a, b) for a, b in zip(texts[::2], texts[1::2], strict=True) if (fingerprint(a) ^ fingerprint(b)).bit_count() <= 3 and jaccard(a, b) < 0.8]
    assert len(pairs) >= 3
    rows = [t for a, b in pairs for t in (a, b, " ".join(b.split()[:-40]))]
    assert all(jaccard(b, c) >= 0.8 > jaccard(a, c) and (fingerprint(a) ^ fingerprint(c)).bit_count() > 3 for a, b, c in zip(*[rows[i::3] for i in range(3)], strict=True))
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(rows)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, sf).collect()}
    assert kept == {1, *range(3, len(rows), 3)}  # null is last
