"""The divergence audit against a plain reading of its definition."""

import random
import re
from collections import Counter, defaultdict

import pytest

from riskframe.llm.source_divergence import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def by_hand(rows, least, top=50):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        bag = TERM.findall((text or "").translate(LOWER))
        groups[lang, source].update(bag)
        docs[lang].update(set(bag))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def shares(counts):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1000000000 * (counts[t] + 5) // total for t in kept}

        mine = {s: c for (l, s), c in groups.items() if l == lang}
        p = {s: shares(c) for s, c in mine.items()}
        q = shares(sum(mine.values(), Counter()))
        for s in mine:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -v, r) for r, (v, _, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                                 "text string, lang string, source string, v int, item string, n int")


@pytest.mark.parametrize("least", [1, 3, 30])
def test_divergence_matches_brute_force(spark, least):
    draw = random.Random(least)
    words = ["Ab", "aB", "été", "ÉTÉ", "日本", "don't", "x_y", "K", "ſ", "½", "a1b"] + [f"{c}{d}" for c in "abcd" for d in "efg"]
    rows = []
    for _ in range(300):
        lang, source = draw.choice(["en", "en", "de", None, ""]), draw.choice(["a", "a", "b", "c", None, "é"])
        own = words[:20] if source == "a" else words[8:]
        rows.append((" ".join(draw.choices(own, k=draw.randrange(12))), lang, source))
    rows += [rows[0]] * 60 + [(None, "en", "empty"), ("", "fr", "a"), ("12 _", "fr", "b"), ("word " * 40000, "es", "a"),
                              ("other", "it", "alone"), (None, None, None)]
    got = sorted(tuple(r) for r in source_divergence(table(spark, rows).repartition(4), least).collect())
    assert got == by_hand(rows, least)


def test_only_the_first_terms_and_an_empty_table(spark):
    rows = [(f"w{chr(97 + i // 26)}{chr(97 + i % 26)} common", "en", "s" if i % 3 else "t") for i in range(200)]
    got = sorted(tuple(r) for r in source_divergence(table(spark, rows), 1, 5).collect())
    assert got == by_hand(rows, 1, 5)
    assert source_divergence(table(spark, rows).limit(0)).count() == 0
