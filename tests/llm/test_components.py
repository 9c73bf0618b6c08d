"""Stars are seen without a round, and more links join what is known without the old ones."""

import random

import pytest

from memloom.llm import components as C
from memloom.llm import similar


def edge_table(spark, edges):
    return spark.createDataFrame(edges, "u long, v long").repartition(4)


def found(table):
    rows = [tuple(r) for r in table.select("node", "root").collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_stars_take_no_round(spark, monkeypatch):
    def round_of(*_):
        raise AssertionError("a round over edges that are stars")

    monkeypatch.setattr(C, "_star", round_of)
    edges = [(5, 1), (1, 7), (9, 1), (4, 3), (4, 3), (6, 6)]
    assert found(C.components(edge_table(spark, edges))) == {1: 1, 5: 1, 7: 1, 9: 1, 3: 3, 4: 3}
    with pytest.raises(AssertionError):  # 3 is below 9, which is below 1
        C.components(edge_table(spark, [*edges, (9, 3)]))


@pytest.mark.parametrize("seed", range(3))
def test_more_links(spark, seed):
    rng = random.Random(seed)
    draw = lambda n, top: [(rng.randrange(top), rng.randrange(top)) for _ in range(n)]
    old, new = draw(25, 60), [(a + 20, b + 20) for a, b in draw(25, 70)]
    whole = C.merged(C.components(edge_table(spark, [e for e in old if e[0] != e[1]])), edge_table(spark, [e for e in new if e[0] != e[1]]))
    expected = found(C.components(edge_table(spark, old + new)))
    assert found(whole) == expected


def test_a_turn_that_leaves_most_rows_is_the_last(spark, monkeypatch):
    """More turns would each read all that is left."""
    frame = [f"frame{i}" for i in range(60)]
    rows = []
    for i in range(60):  # all apart
        words = frame[:48] + [f"own{i}x{j}" for j in range(8)] + frame[48:]
        rows.append((i, " ".join(words)))
    turns, one = [], similar.one_for_each
    monkeypatch.setattr(similar, "one_for_each", lambda *a: (turns.append(a[2]), one(*a))[1])
    monkeypatch.setattr(similar, "_regrouped", lambda left, links: similar.stored(left, "same"))
    monkeypatch.setattr(similar, "_differing", lambda a, b: similar.F.lit(0))
    monkeypatch.setattr(similar, "verified", lambda pairs, *_: similar.stored(pairs, "pairs"))
    similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert turns == [0]
