"""Ranked search against a plain reading of its definition."""

import math
import random
import re
from collections import Counter

import pytest

from riskframe.llm import lexical_search
from riskframe.llm.lexical_search import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def by_hand(documents, items, top=10):
    bags = [(key, TERM.findall((text or "").translate(LOWER))) for key, text in documents]
    n_docs = sum(bool(b) for _, b in bags)
    n_terms = sum(len(b) for _, b in bags)
    holding = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        found = []
        for key, bag in bags:
            counts = Counter(bag)
            m = 100 - 75 + (75 * len(bag) * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                        * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m))
                        for t in TERM.findall((text or "").translate(LOWER)) if counts[t])
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        for rank, (score, _, _, key) in enumerate(sorted(found)[:top], 1):
            out.append((item, rank, key, -score))
    return sorted(out, key=str)


def tables(spark, documents, items):
    docs = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in documents],
                                 "doc_id long, text string, item_id int, item int, score int")
    return docs, spark.createDataFrame([(k, t, 4) for k, t in items], "item_id long, text string, rank int")


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(8)
    words = ["Ab", "aB", "c3", "été", "ÉTÉ", "x_y", "日本", "naïve", "don't", "q", "zz", "K", "ſ", "a\x00b", "½"]
    words += [f"w{i}" for i in range(40)]
    docs = [(draw.randrange(10**9), " ".join(draw.choices(words, k=draw.randrange(60)))) for _ in range(150)]
    docs += [(5, docs[0][1]), (4, docs[0][1]), (5, docs[0][1]), (None, docs[0][1]), (None, None), (7, ""), (8, " \n.")]
    docs += [(9, "w1 " * 30000 + "w2")]
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 9)))) for i in range(20)]
    items += [(20, None), (21, ""), (22, "nowhere"), (None, "w1 w1 w2"), (3, "w5"), (3, "w5"), (23, docs[0][1])]
    return docs, items


def test_ranked_search_matches_brute_force(spark, corpus):
    docs, items = corpus
    d, i = tables(spark, docs, items)
    got = [tuple(r) for r in ranked_search(d.repartition(5), i).collect()]
    assert sorted(got, key=str) == by_hand(docs, items)


def test_blocks_of_items_and_small_heaps(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_CHARS", 100)
    docs, items = corpus
    d, i = tables(spark, docs, items)
    got = [tuple(r) for r in ranked_search(d.repartition(3), i, top=3).collect()]
    assert sorted(got, key=str) == by_hand(docs, items, 3)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    d, i = tables(spark, docs, items)
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.where("text IS NULL"), i)):
        out = ranked_search(a, b)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_terms():
    assert lexical_search.terms("Ab-aÉ_3".encode()) == [b"ab", "aÉ".encode(), b"3"]
