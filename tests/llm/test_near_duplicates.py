"""Near duplicates are linked by their shingle sets; fingerprints only search."""

import random

from riskframe.llm import simhash


def test_near_duplicate_links_have_the_stated_similarity(spark):
    rng = random.Random(17)
    vocab = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(60):
        text = rng.choices(vocab, k=300)
        other = list(text)
        at = 40
        for _ in range(rng.randint(4, 14)):  # each changed word takes 5 of 296 shingles: 0.87 to 0.62
            other[at] = "changed"
            at += rng.randint(6, 17)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    # Fingerprints of these two are alike, as one shingle fills them; their shingle sets are not.
    rows += [(200, "spam " * 400 + " ".join(vocab[:40])), (201, "spam " * 400 + " ".join(vocab[50:90]))]

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(2 * i, 2 * i + 1) for i in range(60)]
    links = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert 5 < len(links) < 55
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == {i for i, _ in rows} - {b for _, b in links}
