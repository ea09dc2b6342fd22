"""Components against a plain walk, and how many tables are written for them."""
import random

from rowproof.llm import graph


def plain(edges):
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for x, y in edges:
            low = min(label[x], label[y])
            changed |= label[x] != low or label[y] != low
            label[x] = label[y] = low
    return label


def run(spark, monkeypatch, edges):
    written, land = [], graph.land
    monkeypatch.setattr(graph, "land", lambda df, name: (written.append(name), land(df, name))[1])
    found = graph.components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()
    monkeypatch.undo()
    assert len(found) == len({r.node for r in found})
    return {r.node: r.label for r in found}, len(written)


def test_against_a_plain_walk(spark, monkeypatch):
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    loose = [(draw.randrange(100, 160), draw.randrange(100, 160)) for _ in range(35)]
    edges = [*chain, *loose, (200, 201), (201, 200), (300, 301), (301, 302), (302, 300), (-5, 41)]
    want = plain([e for e in edges if e[0] != e[1]])
    assert run(spark, monkeypatch, edges)[0] == want


def test_stars_are_written_once(spark, monkeypatch):
    stars = [(1, 5), (6, 1), (7, 1), (2, 9), (9, 2), (3, 3)]
    assert run(spark, monkeypatch, stars) == (plain(stars[:5]), 1)
    assert run(spark, monkeypatch, [(4, 4)]) == ({}, 1)
    # Two leaves of one star, a leaf of two stars and a chain have to be worked on.
    for more in ([(5, 6)], [(5, 2)], [(5, 8)]):
        got, written = run(spark, monkeypatch, stars[:5] + more)
        assert got == plain(stars[:5] + more) and written > 1
