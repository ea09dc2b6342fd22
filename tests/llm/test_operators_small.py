"""The operators on small tables against plain versions: nulls, empty and long texts, ties, repeats, clashing columns."""
import base64
import hashlib
import random
import re
import zlib
from fractions import Fraction as F_

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowproof.llm import base, fingerprint, language, lines, mixing, neardup, passages, pieces, topk, toxicity, warc
from rowproof.llm.base import prepare

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, label string"


def sentence(draw, n):
    return " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    base = [sentence(draw, 120) for _ in range(12)]
    texts = [None, "", "   \n", "One", "x" * 5000, "🙂 end\n\nof é"]
    for b in base:
        words = b.split()
        texts += [b, b.upper() if b.isascii() else b, " ".join(words[:60] + ["zz"] + words[61:]), b + "\n" + sentence(draw, 30)]
    texts += [base[0] * 40]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 0.5, "a") for i, t in enumerate(texts)]
    return out + [out[6], (None, "null id", None, "s1", 7, 0.1, "b")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return prepare(spark).createDataFrame(rows, DOCS)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_near_duplicates(docs, rows, nothing):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        if i is not None:
            sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                common = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * common >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[label[i]] == label[i] for i in label):
            break
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], r.doc_id == label[r.doc_id])
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(label.values())) and ids.count(None) == 1
    assert neardup.near_duplicates(nothing).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
        row = after
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_line_links(spark, edits, nothing):
    draw = random.Random(edits)
    base = ["".join(draw.choice("abé 🙂") for _ in range(draw.randint(14, 30))) for _ in range(15)]

    def change(s):
        s = list(s)
        for _ in range(draw.choice([0, 1, 2, 3])):
            i = draw.randrange(len(s))
            s[i:i + draw.randint(0, 1)] = draw.choice(["", "q"])
        return "".join(s)

    docs = spark.createDataFrame([(d, "\n".join(change(draw.choice(base)) for _ in range(4))) for d in range(30)], "doc_id bigint, text string")
    ids = {r.line: r.id for r in lines.lines_of(docs).select("line", "id").distinct().collect()}
    long = [x for x in ids if len(x) >= 16]
    want = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for k, a in enumerate(long) for b in long[k + 1:]
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits}
    assert {(r.x, r.y) for r in lines.line_links(docs, edits).collect()} == want and want
    assert lines.line_classes(nothing).count() == 0


def test_repeated_lines_go(docs, rows):
    out = lines.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[6].text == rows[6][1] and got[9].text not in (None, rows[9][1]) and got[9].n_chars == len(got[9].text)
    assert got[0].text is None and got[1].text == "" and got[None].text == "null id" and 7 not in got or rows[7][1] != rows[6][1]


def test_mixing(docs, rows, nothing):
    got = mixing.mixed_order(docs, parts=10).collect()
    assert sorted(r["__slot"] for r in got) == list(range(len(rows)))
    assert all(r["__release"] <= r["__slot"] < r["__due"] for r in got)
    assert mixing.mix(docs, {"s1": 0.7, "s2": 0.2, "absent": 0.1}).count() == len(rows)
    assert mixing.mix(nothing).count() == 0
    order = [r.source for r in sorted(mixing.mixed_order(docs, {"s0": .5, "s1": .3, "s2": .2}, parts=10).collect(), key=lambda r: r["__slot"])]
    for source, share in (("s0", 5), ("s1", 3), ("s2", 2)):
        assert all(abs(order[:n].count(source) - share / 11 * n) < 1 for n in range(1, 12))


def test_mixing_keeps_within_a_block_of_the_given_weights(spark):
    def order(sizes, weights):
        names = [name for name, n in sizes.items() for _ in range(n)]
        docs = spark.createDataFrame([(i, s) for i, s in enumerate(names)], "doc_id bigint, source string")
        got = sorted(mixing.mixed_order(docs, weights).collect(), key=lambda r: r["__slot"])
        assert [r["__slot"] for r in got] == list(range(len(names)))
        assert sorted(r.doc_id for r in got) == list(range(len(names)))
        assert all(r["__release"] <= r["__slot"] < r["__due"] for r in got)
        return [r.source for r in got]

    def held(got, shares, slots):
        taken = dict.fromkeys(shares, 0)
        for t, source in enumerate(got[:slots], 1):
            taken[source] = taken.get(source, 0) + 1
            for name in shares:
                assert abs(taken[name] - shares[name] * t) < 1, (name, t)

    # Many small sources beside a large one.
    small = {f"s{i}": F_(1, 1000) for i in range(150)}
    shares = {"big": F_(85, 100), **small}
    got = order({"big": 2550, **dict.fromkeys(small, 3)}, {k: float(v) for k, v in shares.items()})
    held(got, shares, 2990)
    # Square roots of the sizes, over many cuts, and a source that runs out early.
    sizes = {"a": 2000, "b": 1300, "c": 700, "d": 11, "e": 3}
    roots = {k: n ** 0.5 for k, n in sizes.items()}
    first = min(int(n * sum(roots.values()) / roots[k]) for k, n in sizes.items())
    held(order(sizes, None), {k: r / sum(roots.values()) for k, r in roots.items()}, first)
    # Irrational weights; no slot for a weight of 0 while another source is left.
    shares = {"a": 2 ** 0.5 / 2, "b": 1 - 2 ** 0.5 / 2, "none": 0}
    got = order({"a": 800, "b": 400, "none": 30}, shares)
    held(got, shares, int(800 / shares["a"]))
    assert got[-30:] == ["none"] * 30


def test_toxicity(spark, docs, nothing):
    draw = random.Random(8)
    rows = [(i, sentence(draw, 40) + (" idiot" if i % 4 == 0 else "")) for i in range(400)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, None), (None, 1)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(texts, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got)
    assert toxicity.reject_toxic(texts, labels).count() == 300
    none = toxicity.score_documents(docs, labels.limit(0))
    assert none.where("score > 0.7 OR score IS NULL").count() == 0 and none.count() == docs.count()
    assert toxicity.score_documents(nothing, labels).count() == 0


def test_toxicity_learns_a_pair_whose_terms_are_neutral_alone(spark):
    draw = random.Random(9)
    kinds = [(draw.random() < .5, draw.random() < .5) for _ in range(900)]
    rows = [(i, sentence(draw, 12) + " zebra" * a + " quill" * b) for i, (a, b) in enumerate(kinds)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(a == b)) for i, (a, b) in enumerate(kinds)], "doc_id bigint, toxic int")
    held = toxicity.score_documents(texts, labels, 0.5).where("held_out").collect()
    right = sum(r.predicted == int(kinds[r.doc_id][0] == kinds[r.doc_id][1]) for r in held)
    assert len(held) > 200 and right > 0.9 * len(held)


def test_toxicity_driver_gets_only_terms_that_can_count(spark, monkeypatch):
    rows = [(i, f"often{i % 7} both{i // 2 % 5} idiot" if i % 3 == 0 else f"often{i % 7} both{i // 2 % 5} alone{i}") for i in range(300)]
    texts = spark.createDataFrame([*rows, (300, ""), (301, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(302)], "doc_id bigint, toxic int")
    got, numbered = [], toxicity.numbered
    monkeypatch.setattr(toxicity, "numbered", lambda *a: got.append(numbered(*a)) or got[-1])
    machine = toxicity.train(texts, labels)
    ids, label, terms, ends = got[0]
    assert sorted(ids.tolist()) == list(range(302)) and label.sum() == 101 and len(ends) == 302
    # Terms of a single row stay with the tasks.
    per_row = dict(zip(ids.tolist(), np.diff(ends, prepend=0).tolist()))
    assert per_row[300] == per_row[301] == 0 and len(np.unique(terms)) <= 15 and ends[-1] == len(terms) <= 302 * 4
    low, high = machine.scores(pa.array(["often1 idiot", "often1 alone7"]))[::-1]
    assert low < 0.3 and high > 0.7


def test_pieces_round_trip_and_greatest_score(docs):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece
    p = pieces.load_pieces()
    got = docs.select("text", pieces.encode_checked(F.col("text"), p).alias("e")).collect()
    assert all(r.e.round_trip for r in got)
    back = docs.select("text", pieces.decode_pieces(pieces.encode_pieces(F.col("text"), p), p).alias("t")).collect()
    assert all((r.text or "") == r.t for r in back)
    model = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    score = [x.score for x in model.pieces]
    total = lambda ids: sum(score[i] for i in ids)
    import pyarrow as pa
    for text in ["the of and", "Is retitioning", "a é", "  two  spaces", "tion"]:
        ids, _ = pieces.encode(pa.array([text]), p)
        assert total(ids.tolist()) == max(map(total, library.nbest_encode(text, nbest_size=20)))


def test_warc(spark):
    pages = [(1, "u", "<p>a</p>"), (2, "u\r\nx", "<p>a</p>"), (3, None, None), (4, "v", ""), (5, "w", "é" * 400_000), (None, "z", "q"), (2, "u", "b")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    parts = warc.write_bundles(df.coalesce(1), frame_bytes=1000)
    read = warc.read_bundles(parts).collect()
    assert len(read) == len(pages) and all(r.intact for r in read)
    kinds = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in read}
    assert kinds[1, 8] == ("revisit", 2) and kinds[2, 8] == ("response", None) and kinds[3, 0] == ("revisit", 4)
    assert {r.payload_digest for r in read if r.page_id == 1} == {base64.b32encode(hashlib.sha1(b"<p>a</p>").digest()).decode()}
    rows = sorted(parts.collect(), key=lambda r: (r.bundle, r.part))
    whole = b"".join(r.bytes for r in rows)
    import io
    import zstandard
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(whole), read_across_frames=True).read()
    assert len(list(warc.records(plain))) == len(pages)
    assert [len(r.bytes) for r in rows if r.kind == "frame"] == [a for a, _ in warc.read_seek_table(whole)]
    assert [r.page_id for r in warc.fetch(parts, df.where("page_id = 5").select("page_id")).collect()] == [5]
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0


def test_fingerprints(docs, rows, nothing):
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == len(rows)
    known = sorted([(i, t or "") for i, t, *_ in rows if i is not None], key=lambda r: -r[0])
    unique = [k for k in known if [x[0] for x in known].count(k[0]) == 1]
    by = {r.doc_id: r for r in got}
    for i, t in unique[1:-10]:
        following = next(x for j, x in known if j < i)
        changed = fingerprint.edited(t, following)
        assert (by[i].n_chars, by[i].edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= by[i].near_edited <= 1 and (by[i].near_edited == 1) == (t == changed)
    a, b = fingerprint.Tree("One. Two.\nThree.\n\nFour."), fingerprint.Tree("One. Two.\nOther.\n\nFour.")
    assert fingerprint.changed_paragraphs(a, b) == [(0, 1)] and 0.5 < fingerprint.likeness(a, b) < 1
    assert fingerprint.fingerprints(nothing).count() == 0


def test_top_k(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(0, 0.3, (300, 8)).round(2)
    vectors[40:90] = vectors[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(400, None), (500, [1.0, None]), (600, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, topk.Settings(pivots=6, rings=3, cell_rows=16, block_queries=2)).collect()
    whole = np.floor(vectors.astype(np.float32).astype(float) * 1024).astype(int)
    for q in range(0, 300, 50):
        scores = sorted((-int(whole[q] @ whole[i]), i) for i in range(300) if i != q)[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == scores
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_passages(spark, nothing):
    draw = random.Random(5)
    shared = sentence(draw, 70).split()
    fuzzy = shared[:35] + ["new", "words"] + shared[36:]
    rows = [(1, sentence(draw, 90) + " " + " ".join(shared)), (2, " ".join(shared) + " " + sentence(draw, 40)),
            (3, sentence(draw, 30) + "\n" + " ".join(fuzzy)), (4, sentence(draw, 300)), (5, None), (6, ""), (None, " ".join(shared))]
    got = passages.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2, 3}
    assert all(r.end_word - r.start_word >= 50 for r in got) and max(r.end_word - r.start_word for r in got) >= 65
    assert passages.passages(nothing).count() == 0


def test_passages_whose_seeds_have_other_first_and_last_documents(spark):
    draw = random.Random(6)
    whole = sentence(draw, 60).split()
    rows = [(i, f"{sentence(draw, 40)} {' '.join(part)} {sentence(draw, 40)}") for i, part in (
        (1, whole[:35]), (2, whole[25:]), (100, whole), (101, whole), (102, whole), (200, whole[:35]), (201, whole[25:]))]
    got = passages.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in got} >= {(100, 102), (101, 100), (101, 102), (102, 100)}
    assert {r.doc_id for r in got} == {100, 101, 102}
    assert len(got) == len({(r.doc_id, r.other_id) for r in got})
    assert all(r.end_word - r.start_word >= 60 and r.start_word <= 40 for r in got)


def test_runs_of_texts_that_repeat_one_word_chain_along_diagonals(spark):
    from dataclasses import replace
    s = passages.Settings()
    known = spark.createDataFrame([(1, "w " * 200), (2, "w " * 150)], "doc_id bigint, text string")
    held = passages.seed_rows(known, s).select("seed", "doc_id", "at")
    none = spark.createDataFrame([], "doc_id bigint, start_word int, end_word int, other_id bigint, other_start int, other_end int")
    matches = passages.run_matches(known, held, none, s).collect()
    assert sorted((m.doc_id, m.at) for m in matches) == [(1, i) for i in range(151)] + [(2, i) for i in range(101)]
    got = passages.chains(spark.createDataFrame(matches, "doc_id bigint, other_id bigint, at int, there int"), replace(s, kmer=50)).collect()
    assert sorted((r.doc_id, len(r.at)) for r in got) == [(1, 50), (1, 101), (2, 101)]


def test_runs_within_spans():
    draw = np.random.default_rng(4)
    for _ in range(200):
        starts = np.unique(draw.integers(0, 300, draw.integers(0, 60)))
        low = draw.integers(0, 300, draw.integers(0, 6))
        spans = [[int(x), int(x + y)] for x, y in zip(low, draw.integers(0, 150, len(low)))]
        plain = [any(a <= k and k + 50 <= b for a, b in spans) for k in starts]
        assert passages.covered(starts, spans, 50).tolist() == plain


def test_hashes_of_runs_are_sums_over_their_own_bytes():
    codes, unit = base.BYTE_CODES, base.STRETCH
    data = np.frombuffer(random.Random(6).randbytes(4 * unit), np.uint8)
    cuts = np.array([0, 1, 3, 9, unit - 5, unit + 2, 3 * unit + 7, 3 * unit + 9, 4 * unit])
    begin, end = cuts[:-1], cuts[1:] - np.array([0, 1, 0, 0, 0, 2, 1, 0])

    def plain(run):
        total = sum(int(codes[x]) * pow(base.BYTE_BASE, i, 1 << 64) for i, x in enumerate(run.tolist()))
        return base.mix_number((total & base.MASK) ^ (len(run) * base.WORD_BASE & base.MASK))

    for longest in (None, 5):
        got = base.span_hashes(data, begin, end, longest)
        assert got.tolist() == [plain(data[a:b][:longest]) for a, b in zip(begin, end)]


def test_chains_are_those_found_one_at_a_time(spark):
    s = passages.Settings()
    draw = np.random.default_rng(4)
    at, there = np.sort(draw.integers(0, 60, 90)), draw.integers(0, 40, 90)
    order = np.lexsort((there, at))
    at, there = at[order], there[order]
    rows = [(1, 2, int(x), int(y)) for x, y in zip(at, there)]
    got = passages.chains(spark.createDataFrame(rows, "doc_id bigint, other_id bigint, at int, there int").coalesce(1), s).collect()
    left, sizes = np.arange(90), []
    while len(left):
        score, back = passages.chain_scores(at[left], there[left], s)
        k, chain = int(score.argmax()), []
        while k >= 0:
            chain.append(left[k])
            k = back[k]
        if len(chain) == 1:
            sizes += [1] * len(left)
            break
        sizes.append(len(chain))
        left = left[(at[left] < at[chain[-1]]) | (at[left] > at[chain[0]])]
    assert sorted(len(r.at) for r in got) == sorted(sizes)


def test_language(docs, rows, nothing):
    got = language.score(docs, language.held_out_fifth()).collect()
    assert len(got) == len(rows)
    from collections import Counter
    from math import log10
    counts = Counter()
    for i, t, *_ in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update(words(t) + ["\0end"])
    total, kinds = sum(counts.values()), len(counts)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        w = words(texts[r.doc_id]) + ["\0end"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(log10((counts[x] + .5) / (total + .5 * (kinds + 1))) for x in w))
        assert r.score < 0
    assert language.score(nothing, language.held_out_fifth()).count() == 0


def test_tables_of_kept_sweeps_are_written_once(spark):
    s = language.Settings()
    text = " ".join(random.Random(2).choices(["a", "b", "c", "d"], k=400))
    docs = spark.createDataFrame([(i, text) for i in range(20)], "doc_id bigint, text string")
    (row,) = (r.asDict() for r in language.merge_counts(language.count_rows(docs, 1)).collect())
    known = [language.unpacked(row).totals()] * (s.burn_in + s.samples)
    (kept,) = (r.asDict() for r in language.seated(spark.createDataFrame([row], language.STATE), known, 5, s).collect())
    swept = [(x.tables.tolist(), x.root_tables.tolist()) for x in language.run_sweeps(language.unpacked(row), known, 5, s)]
    assert [(x.tables.tolist(), x.root_tables.tolist()) for x in language.kept_states(kept, s.samples)] == swept[s.burn_in:]


def test_packed_states_are_views_and_counts_take_four_bytes():
    few, many = np.array([3, 2 ** 32 - 1]), np.array([3, 2 ** 32])
    assert len(language.packed_counts(few)) == 8 and len(language.packed_counts(many)) == 16
    for counts in (few, many):
        fields = {"words": np.array([5, 9], np.uint64), "sizes": np.array([1, 1], np.uint16), "classes": np.array([7, 200], np.uint8)}
        columns = {c: pa.array([b"", v.tobytes()], pa.binary()) for c, v in fields.items()}
        batch = pa.record_batch({"part": pa.array([0, 4], pa.int32()), **columns, "counts": pa.array([b"", language.packed_counts(counts)], pa.binary())})
        (_, empty), (own, row) = language.each([batch])
        assert language.unpacked(empty).counts.tolist() == [] and own.num_rows == 1
        state = language.unpacked(row)
        assert state.part == 4 and state.counts.tolist() == counts.tolist() and state.words.tolist() == [5, 9]
        # The words lie where the batch has them.
        held = batch["words"].buffers()[2]
        assert held.address <= state.words.ctypes.data < held.address + held.size


def test_confirming_few_pairs_moves_no_texts(spark, monkeypatch):
    from rowproof.llm import neardup
    plans, land = [], neardup.land

    def kept(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return land(df, label)

    monkeypatch.setattr(neardup, "land", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.createDataFrame([(i, "one two three four five six seven" + (" eight" if i > 1 else "")) for i in range(4)], "doc_id bigint, text string")
        pairs = spark.createDataFrame([(2, 3), (0, 2), (0, 1)], "x bigint, y bigint")
        got = neardup.confirmed(pairs, texts, neardup.Settings())
        assert {tuple(r) for r in got.collect()} == {(2, 3), (0, 2), (0, 1)} - {p for p in [(0, 2)] if 100 * 3 < 75 * 4}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (plan,) = [p for label, p in plans if label == "sets"]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
