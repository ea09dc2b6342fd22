"""The filter audit against a plain count over every order, and its packed counters."""
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from rowproof.llm import interactions

DOCS = "doc_id bigint, text string, lang string, mask int, part string, sha string, n bigint"
RESULT = ["part", "filter_order", "step", *interactions.FIGURES, "shapley"]


def plain(docs, labels):
    marked = []
    known = {}
    for i, q, t in labels:
        if i is not None:
            g, x = known.get(i, (0, 0))
            known[i] = (g or q == 1, x or t == 1)
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            fails.add("C")
        if set(t) & set("#$%&*|"):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            fails.add("E")
        good, bad = known.get(i, (0, 0)) if i is not None else (0, 0)
        marked.append((lang or "", fails, good, bad))
    out = {}
    for part in {m[0] for m in marked}:
        rows = [m for m in marked if m[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[:step - 1])
                here = [m for m in rows if f in m[1] and not m[1] & before]
                share[f] += len(here)
                out[part, "".join(order), step] = [
                    sum(not m[1] & (before | {f}) for m in rows), len(here), sum(f in m[1] and bool(m[1] & before) for m in rows),
                    sum(m[1] == {f} for m in rows), sum(bool(m[2]) for m in here), sum(bool(m[3]) for m in here)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(share[order[step - 1]])
    return out


def rows_of(spark, docs, labels):
    frame = spark.createDataFrame([(i, t, lang, 7, "x", "y", 1) for i, t, lang in docs], DOCS)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return interactions.audit(frame, marks)


def test_against_every_order_counted_plainly(spark):
    draw = random.Random(8)
    texts = [None, "", " \n\x0b", "é" * 300, "Word", "a # b", "x y " * 210, "same " * 250,
             " ".join(f"w{i}" for i in range(220)), " ".join(f"W{i}" for i in range(220)),
             " ".join(f"w{i % 110}" for i in range(220)), " ".join(f"w{i % 109}" for i in range(219)), "🙂|" * 5, "long " * 50000]
    docs = [(i, draw.choice(texts), draw.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [docs[3], docs[3], (None, texts[5], "en"), (None, None, None), (-5, "a # b", "only")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    got = rows_of(spark, docs, labels)
    assert got.columns == RESULT
    assert {tuple(r)[:3]: list(r)[3:] for r in got.collect()} == plain(docs, labels)


def test_empty_tables(spark):
    assert rows_of(spark, [], []).collect() == []
    lone = rows_of(spark, [(1, "a", "en")], []).collect()
    assert len(lone) == 600 and {r.good_lost + r.toxic_lost for r in lone} == {0}


def test_large_counts_stay_in_their_fields(spark):
    n = (1 << 40) + 255
    counts = spark.createDataFrame([("p", 31, 1, 1, n), ("p", 0, 0, 0, n)], "part string, mask int, good int, toxic int, n bigint")
    rows = interactions.step_counts(counts, "ABCDE").collect()
    assert {(r.kept, r.removed, r.redundant) for r in rows} == {(n, n, 0), (n, 0, n)}
    assert {r.shapley for r in rows} == {24 * n} and {r.unique_fails for r in rows} == {0}


@pytest.mark.parametrize("width", [1, 2, 5, 8])
def test_packing_round_trip(width):
    bits = interactions.outcomes(0b10110, True, False, 5)
    most = (1 << 8 * width - (width == 8)) - 1
    whole = interactions.unpacked(most * interactions.packed(bits, width), bits.size, width)
    assert (whole == bits.ravel().astype("int64") * most).all()


def test_own_filters(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "bb", None), (3, "bb", None)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = interactions.audit(docs, labels, {"A": F.length("text") > 1}).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in got} == {
        ("AE", 1): (1, 2, 0, 3), ("AE", 2): (1, 0, 1, 1), ("EA", 1): (2, 1, 0, 1), ("EA", 2): (1, 1, 1, 3)}
