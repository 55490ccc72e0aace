"""Copies of one labelled text do not push other entries out of the lexicon."""

import random

import pytest

from riskframe.llm import toxicity

MARKS = ["worthless", "idiot", "loser", "scum"]


def _letters(i):
    return "".join(chr(97 + i // 26 ** k % 26) for k in range(4))


@pytest.mark.parametrize("alike", [False, True])
def test_a_group_of_copies_keeps_other_entries(spark, alike):
    draw = random.Random(3)
    common = [f"plain{_letters(i)}" for i in range(30)]
    rows = [(0, " ".join(draw.sample(common, 12))) for _ in range(300)]
    rows += [(1, " ".join([*draw.sample(common, 11), MARKS[i % 4]])) for i in range(32)]
    long = " ".join(f"{_letters(i * 97)}q" for i in range(2600))
    rows += [(1, f"{long} {common[i % 30]} {i if alike else ''}".strip() if alike else long) for i in range(60)]
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "y int, text string"))
    for mark in MARKS:
        assert any(mark == e or e.endswith("*") and mark.startswith(e[:-1]) for e in found), mark
    if not alike:
        assert len(found) < 20
    starts = {e[:-1] for e in found if e.endswith("*")}
    assert not [e for e in found for k in range(1, len(e.rstrip("*"))) if e.rstrip("*")[:k] in starts]


def test_a_group_of_copies_is_sampled_in_part(spark):
    from riskframe.llm import quality_rank
    rows = [(i, "one good text, the same for all.", 1) for i in range(3000)] + [(5000 + i, f"bad !!! {i}", 0) for i in range(3000)]
    model = quality_rank.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int"), sample_rows=1000)
    scores = {r.doc_id: r.score for r in quality_rank.rank(spark.createDataFrame(rows[:1] + rows[-1:], "doc_id long, text string, quality int"), model).collect()}
    assert scores[0] > quality_rank.CUT > scores[7999]
