"""Collocations against a plain count, with several rounds of merging, and the quotient filters by themselves."""
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from rowproof.llm import collocations as co
from rowproof.llm.base import prepare

DOCS = "doc_id bigint, text string, lang string, n bigint, phrase string, chunk string, id string"


def plain(rows, least, best):
    found = {}
    for _, text, lang in rows:
        f = found.setdefault(lang or "und", Counter())
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            f.update(tuple(words[i:i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, f in found.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        phrases = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        within = Counter()
        for p, a in phrases.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        within[p[i:j]] = max(within[p[i:j]], a)
        kept = []
        for p, a in phrases.items():
            if 100 * within[p] >= 100 * a:
                continue
            cuts = [(Fraction(1000 * a * n, f[p[:k]] * f[p[k:]]).__floor__(), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], n, score))
        for rank, (_, _, phrase, *rest) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, phrase.decode(), *rest))
    return sorted(out)


def run(spark, rows, **settings):
    prepare(spark)
    docs = spark.createDataFrame([(i, t, lang, 1, "p", "c", "x") for i, t, lang in rows], DOCS)
    out = co.collocations(docs.repartition(6, "doc_id"), **settings)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(12)
    vocabulary = ["The", "the", "of", "é", "Éa", "b\x1fc", "x-y", "日本", "new", "york", "city", "a"] + [f"w{i}" for i in range(30)]
    out = []
    for i in range(90):
        words = []
        for _ in range(draw.randint(0, 60)):
            words += ["new", "york", "city", "hall", "x"][:draw.randint(2, 5)] if draw.random() < 0.2 else [draw.choice(vocabulary[:draw.choice([8, 42])])]
        text = "".join(w + draw.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "!? ", "\x0b"]) for w in words)
        out.append((i, text, draw.choice(["en", "en", "de", None])))
    out += [(1, None, "en"), (2, "", "fr"), (None, " .,; \n", "fr"), (3, "one", "it"), out[5], out[5], (None, "new york " * 3000, "en")]
    return out


@pytest.mark.parametrize("settings", [dict(), dict(chunk_bytes=300, fan_bits=1), dict(chunk_bytes=1, fan_bits=2)])
def test_against_a_plain_count(spark, rows, settings):
    assert run(spark, rows, least=5, best=2000, **settings) == plain(rows, 5, 2000)


def test_only_the_best_and_ties_by_spelling(spark, rows):
    want = plain(rows, 3, 7)
    assert run(spark, rows, least=3, best=7) == want and len(want) > 14
    ties = [(i, "b c. a d. é f. z", "en") for i in range(4)]
    got = run(spark, ties, least=4, best=2)
    assert [(r[1], r[2]) for r in got] == [(1, "a d"), (2, "b c")] and got == plain(ties, 4, 2)


def test_empty_tables_and_nothing_frequent(spark, rows):
    assert run(spark, [], least=2) == []
    assert run(spark, rows, least=10 ** 6) == []


def test_products_beyond_64_bits(spark):
    vocabulary = spark.createDataFrame([(1, "en", "a", 1), (2, "en", "b", 1)], "id bigint, lang string, word string, a bigint")
    big, n = 3 * 10 ** 12 + 1, 9 * 10 ** 14 + 7
    grams = spark.createDataFrame([([1], big), ([2], big + 5), ([1, 2], big - 1)], "ids array<bigint>, a bigint")
    got = co.scored(grams, vocabulary, spark.createDataFrame([("en", n)], "lang string, n bigint")).collect()
    assert [(r.l, r.r, r.score) for r in got] == [(big, big + 5, 1000 * (big - 1) * n // (big * (big + 5)))]


@pytest.mark.parametrize("n, bits", [(2, 1), (2, 17), (3, 17), (4, 20), (5, 13), (5, 25), (5, 40), (3, 62)])
def test_permutation_is_lossless(n, bits):
    layout = co.Layout(n, bits)
    draw = np.random.default_rng(n * 100 + bits)
    words = [draw.integers(0, 1 << bits, 2000, dtype=np.uint64, endpoint=False) for _ in range(n)]
    words[0][:2], words[1][:2] = 0, (1 << bits) - 1
    lanes = layout.permute(layout.pack(words))
    assert all(int(x.max()) < 1 << layout.width for x in lanes)
    assert all((a == b).all() for a, b in zip(layout.unpack(layout.restore(lanes)), words))


@pytest.mark.parametrize("n, bits", [(2, 3), (2, 16), (5, 14), (5, 30)])
def test_filters_are_lossless_counters(n, bits):
    layout = co.Layout(n, bits)
    draw = np.random.default_rng(bits)
    words = [draw.integers(0, min(1 << bits, 6), 5000) for _ in range(n)]
    words[0][:700] = words[1][:700] = 1
    lanes = layout.permute(layout.pack(words))
    whole = co.Filter.of(layout, lanes)
    want = Counter(zip(*(w.tolist() for w in words)))
    assert Counter(dict(zip(zip(*(w.tolist() for w in layout.unpack(layout.restore(whole.lanes)))), whole.counts.tolist()))) == want
    parts = [co.Filter.of(layout, [x[i::3] for x in lanes]) for i in range(3)]
    parts = [co.Filter.merge([co.Filter.load(layout, f.dump()) for _, f in p.cut(2)]) for p in parts]
    merged = co.Filter.merge(parts)
    assert all((a == b).all() for a, b in zip([*merged.lanes, merged.counts], [*whole.lanes, whole.counts]))
    half = whole.where(np.arange(len(whole)) % 2 == 0)
    assert (half.has(whole.lanes) == (np.arange(len(whole)) % 2 == 0)).all()
    assert not co.Filter.of(layout, [x[:0] for x in lanes]).has(lanes).any()
    assert len(co.Filter.load(layout, whole.where(slice(0, 0)).dump())) == 0
