"""Extra columns whose names are those the operators and the pipeline work with; scores that are fractions."""
import dataclasses
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowproof.llm import fingerprint, language, lines, mixing, neardup, passages, pieces, toxicity
from rowproof.llm.base import prepare

CLASHES = ["slot", "release", "due", "rows_before", "key", "rank", "block", "bucket", "n", "id", "line", "node", "label", "a", "b", "bits",
           "ids", "n_tokens", "__flags", "__left", "__id", "__slot", "__key", "__rank", "__block", "__spread", "__bucket", "__k", "__s",
           "__stays", "__turn", "__e", "__encoded", "toxic", "predicted", "held_out", "component_id", "kept", "seed", "at", "run"]
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain(spark):
    draw = random.Random(11)
    lines_ = [" ".join(draw.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(draw.randint(0, 60)) for _ in range(12)) for _ in range(30)]
    rows = [(i, "\n".join(lines_[(i * 3 + k) % 30] for k in range(3)) if i % 9 else None, "en", f"s{i % 3}", 10) for i in range(40)]
    return prepare(spark).createDataFrame(rows + [(None, "x y", None, None, None)],
                                          "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


KEEPING = {
    "lines": lines.drop_repeated_lines, "neardup": neardup.one_of_each, "mixing": mixing.mix,
    "mixing_weights": lambda d: mixing.mix(d, {"s1": .5, "s2": .5}),
}
READING = {
    "line_classes": lines.line_classes, "near_duplicates": neardup.near_duplicates, "passages": lambda d: passages.passages(d.withColumn("text", F.concat_ws(" ", "text", "text"))),
    "fingerprints": fingerprint.fingerprints, "language": lambda d: language.score(d, language.held_out_fifth()),
}


@pytest.mark.parametrize("name", KEEPING)
def test_operators_that_return_documents(plain, clashing, name):
    out = KEEPING[name](clashing)
    assert out.columns == clashing.columns
    got = out.collect()
    assert all(r[c] == f"own {c}" for r in got for c in CLASHES)
    without = KEEPING[name](plain).collect()
    assert sorted(map(repr, (r[:5] for r in got))) == sorted(map(repr, (r[:] for r in without)))


@pytest.mark.parametrize("name", READING)
def test_operators_that_read_documents(plain, clashing, name):
    a, b = (sorted(map(repr, READING[name](d).collect())) for d in (plain, clashing))
    assert a == b and a


def test_pipeline_stages(spark, plain, clashing):
    docs, bare = clashing, plain
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, bare = stage(spark, docs, FOLDER), stage(spark, bare, FOLDER)
        assert docs.columns == clashing.columns, name
    last = corpus_pipeline.STAGES[-1][1]
    docs, bare = last(spark, docs, FOLDER), last(spark, bare, FOLDER)
    assert len(set(docs.columns)) == len(docs.columns)
    slots = [sorted(r.slot for r in d.select("slot").collect()) for d in (docs, bare)]
    assert slots[0] == slots[1] == list(range(len(slots[0])))


def test_toxicity_reads_no_column_but_id_and_text(spark, clashing, plain):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id bigint, toxic int")
    a, b = (sorted(map(repr, toxicity.score_documents(d, labels).collect())) for d in (plain, clashing))
    assert a == b
    assert toxicity.reject_toxic(clashing, labels).columns == clashing.columns


def test_fractional_scores_are_not_cut():
    p = pieces.load_pieces()
    draw = np.random.default_rng(2)
    p = dataclasses.replace(p, scores=-draw.uniform(0.01, 3.0, len(p.scores)), unknown=-13.0)
    held = pieces.by_points(p)

    def greatest(text):
        points = ("▁" + text.replace(" ", "▁")) if text else ""
        best = [0.0] + [-np.inf] * len(points)
        for end in range(1, len(points) + 1):
            for start in range(max(0, end - p.longest), end):
                place = held.get(points[start:end].encode("utf-32-le"))
                if place is not None or end - start == 1:
                    best[end] = max(best[end], best[start] + (p.scores[place] if place is not None else p.unknown))
        return best[-1]

    score = dict(zip(p.ids.tolist(), p.scores.tolist()))
    texts = ["the quick brown fox", "retitioning of nations and stations", "a", "", "internationalisation   twice", "word " * 150 + "x" * 500]
    ids, starts = pieces.encode(pa.array(texts), p)
    for i, text in enumerate(texts):
        assert sum(score[x] for x in ids[starts[i]:starts[i + 1]].tolist()) == pytest.approx(greatest(text), abs=1e-6)
