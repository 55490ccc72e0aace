"""Passages that are one line, or begin and end inside lines, are deleted where they occurred before."""

import random
import time

import pytest

import corpus_pipeline
from riskframe.llm import line_dedup
from riskframe.llm.line_dedup import passage_dedup


def passages_by_hand(rows, run):
    import re
    seen, out = set(), []
    for key, text in sorted(rows):
        found = list(re.finditer(r"\S+\s*", text, re.A))
        words = [m.group().strip() for m in found]
        gone = set()
        for s in range(len(words) - run + 1):
            window = tuple(words[s:s + run])
            if window in seen:
                gone.update(range(s, s + run))
            seen.add(window)
        head = text[:found[0].start()] if found else text
        out.append((key, head + "".join(m.group() for i, m in enumerate(found) if i not in gone)))
    return out


@pytest.mark.parametrize("run", [3, 4, 17, 51])
def test_passages_match_brute_force(spark, run):
    draw = random.Random(run)
    stock = [[draw.choice("abcdefghijklmnop") for _ in range(run + 9)] for _ in range(6)]
    rows = []
    for i in range(60):
        words = [draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(2 * run))]
        for _ in range(draw.randrange(3)):
            part, at = draw.choice(stock), draw.randrange(len(words) + 1)
            start = draw.randrange(9)
            words[at:at] = part[start:start + run + draw.randrange(-2, 6)]
        rows.append((i, draw.choice(["", " ", "\n"]) + "".join(w + draw.choice([" ", "  ", "\n", " \n\n"]) for w in words)))
    rows += [(60, rows[0][1]), (61, "a " * 3 * run), (62, "a " * 3 * run), (63, ""), (64, " \n")]
    got = passage_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if run == 51 else \
        passage_dedup(spark.createDataFrame(rows, "doc_id long, text string"), run).collect()
    assert sorted((r.doc_id, r.text) for r in got) == passages_by_hand(rows, run)
    assert passage_dedup(spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")).count() == 2


def test_pipeline_deletes_a_long_line_seen_before(spark):
    line = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"first start\n{line}\nfirst end", "en", "s", 0), (2, f"second begin {line} second end", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: r.text for r in corpus_pipeline.remove_repeated_lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "second begin second end"}


@pytest.mark.parametrize("name, limit", [("HOT", 1), ("SENT_ROWS", 0)])
def test_hot_marks_and_many_changed_texts(spark, monkeypatch, name, limit):
    monkeypatch.setattr(line_dedup, name, limit)
    draw = random.Random(limit)
    stock = [[draw.choice("abcdefgh") for _ in range(30)] for _ in range(3)]
    rows = [(i, " ".join(draw.choice(stock)[draw.randrange(6):] + [draw.choice("xyz")] * draw.randrange(4)
                         + draw.choice(stock))) for i in range(40)]
    rows += [(40, rows[3][1]), (41, rows[3][1])]
    got = passage_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    assert sorted((r.doc_id, r.text) for r in got) == passages_by_hand(rows, 20)


def test_long_texts_take_linear_time(spark):
    """A text of 40,000 words and lines, twice with a change in the middle, and columns with names used inside."""
    words = [f"w{i}" for i in range(40_000)]
    one, two = "\n".join(words), "\n".join([*words[:20_000], "other", *words[20_000:]])
    schema = "doc_id long, text string, id string, digest int, gone int, parts int, at int"
    docs = spark.createDataFrame([(1, one, "x", 1, 1, 1, 1), (2, two, "y", 2, 2, 2, 2), (None, None, "z", 3, 3, 3, 3)], schema)
    start = time.time()
    got = {r.doc_id: r for r in passage_dedup(docs).collect()}
    lines = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert time.time() - start < 90
    assert got[1].text == one and got[2].text.split() == ["other"] and got[2].id == "y" and got[None].text is None
    assert lines[1].text == one and lines[2].text.split() == ["other"] and lines[None].gone == 3
