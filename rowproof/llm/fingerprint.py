"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A text falls into sections at blank lines, a section into paragraphs at newlines, a paragraph into
sentences, each with the blanks that follow it, so no byte of the text is left out. A sentence
longer than sixteen words is cut there. Leaves are hashes of sentences; every node above hashes its
children's hashes and their number; the root tests equality. The fingerprint is the root's hash and,
level by level, its leaves: sections split by '/', paragraphs by '.', four characters a sentence.

Two trees are compared from the root: equal nodes are the same to the last byte, and only differing
branches are entered. Their likeness is the share of sentences, by position-free count, that both
hold: 2 * common / (left + right). Empty texts have an empty tree, alike only to each other (1.0).

A null text counts as empty. The next document is the one with the next smaller id, after the last
the first; a table of one document has itself. Rows with a null id come after all others, and rows
that repeat an id follow each other, ordered by text.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowproof.session import land

# A sentence ends after a full stop, a question or an exclamation mark and the blanks after it.
SENTENCE = re.compile(r"[^.!?]*[.!?]+[ \t]+|[^.!?]+\Z|[^.!?]*[.!?]+", re.S)
LEAF_BYTES = 3
WORDS = 16


def node(children: list[bytes]) -> bytes:
    return hashlib.blake2b(len(children).to_bytes(8, "little") + b"".join(children), digest_size=16).digest()


def leaves_of(paragraph: str) -> list[bytes]:
    """Hashes of a paragraph's sentences; beyond WORDS words a sentence goes on in further leaves."""
    out = []
    for sentence in SENTENCE.findall(paragraph) if paragraph else ():
        pieces = [sentence]
        if sentence.count(" ") >= WORDS:
            words = sentence.split(" ")
            pieces = [" ".join(words[i:i + WORDS]) for i in range(0, len(words), WORDS)]
        out += [hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).digest() for p in pieces]
    return out


class Tree:
    """Hashes of a text's root, sections and paragraphs, and the sentences below each paragraph."""

    def __init__(self, text: str) -> None:
        self.sections = []
        if text:
            for section in text.split("\n\n"):
                paragraphs = [leaves_of(p) for p in section.split("\n")]
                self.sections.append(([node(p) for p in paragraphs], paragraphs))
        self.section_hashes = [node(hashes) for hashes, _ in self.sections]
        self.root = node(self.section_hashes)
        self.size = sum(len(p) for _, paragraphs in self.sections for p in paragraphs)

    def fingerprint(self) -> str:
        # Every leaf's first bytes, four characters for three.
        short = lambda p: base64.b64encode(b"".join(h[:LEAF_BYTES] for h in p), altchars=b"-_").decode()
        return self.root.hex() + ":" + "/".join(".".join(short(p) for p in ps) for _, ps in self.sections)


def likeness(a: Tree, b: Tree) -> float:
    """Share of sentences in both; equal branches are taken whole and not entered."""
    if a.root == b.root:
        return 1.0
    same = 0
    left, right = Counter(), Counter()
    spare = Counter(b.section_hashes)
    rest_a, rest_b = [], []
    for h, s in zip(a.section_hashes, a.sections):
        if spare[h] > 0:
            spare[h] -= 1
            same += sum(map(len, s[1]))
        else:
            rest_a.append(s)
    for h, s in zip(b.section_hashes, b.sections):
        if spare[h] > 0:
            spare[h] -= 1
            rest_b.append(s)
    pool = Counter(h for hashes, _ in rest_b for h in hashes)
    for hashes, paragraphs in rest_a:
        for h, p in zip(hashes, paragraphs):
            if pool[h] > 0:
                pool[h] -= 1
                same += len(p)
            else:
                left.update(p)
    for hashes, paragraphs in rest_b:
        for h, p in zip(hashes, paragraphs):
            if pool[h] > 0:
                pool[h] -= 1
                right.update(p)
    same += sum((left & right).values())
    return 2 * same / (a.size + b.size) if a.size + b.size else 0.0


def changed_paragraphs(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) of `a` that `b` does not have in the same place: only differing branches are entered."""
    if a.root == b.root:
        return []
    out = []
    for i, (hashes, _) in enumerate(a.sections):
        if i < len(b.sections) and a.section_hashes[i] == b.section_hashes[i]:
            continue
        other = b.sections[i][0] if i < len(b.sections) else []
        out += [(i, j) for j, h in enumerate(hashes) if j >= len(other) or other[j] != h]
    return out


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
          ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edge", pa.string()),
          ("part", pa.int64()), ("text", pa.string())]
SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, edge string, part bigint, text string")


def compare(doc_id, text: str, tree: Tree, following: str, next_tree: Tree) -> tuple:
    changed = edited(text, following)
    other = Tree(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), tree.fingerprint(),
            other.fingerprint(), likeness(tree, other), likeness(tree, next_tree), None, None, None)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    One shuffle sorts the texts by descending id. A task compares each text with the one after it and
    leaves its first and last text, whose neighbours lie in other tasks, to a second step over those alone.
    """
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text").repartitionByRange(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").desc_nulls_last(), "text")

    def walked(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before = None
        out, size = [], 0

        def batch_of(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, FIELDS)], [n for n, _ in FIELDS])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                tree = Tree(text)
                if before is None:
                    out.append((doc_id, *[None] * 6, "first", part, text))
                else:
                    out.append(compare(*before, text, tree))
                before = (doc_id, text, tree)
                size += 1
                if size >= 500:
                    yield batch_of(out)
                    out, size = [], 0
        if before is not None:
            out.append((before[0], *[None] * 6, "last", part, before[1]))
        if out:
            yield batch_of(out)

    done = land(ordered.mapInArrow(walked, SCHEMA), "fingerprints")
    # Two rows per task that had rows: the last one's neighbour is the first of the next such task.
    parts = done.where("edge = 'first'").select("part")
    turn = W.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(turn), F.first("part").over(turn)).alias("after"))
    edges = (done.where("edge = 'last'").select("doc_id", "part", "text").join(after, "part")
             .join(done.where("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following")), "after"))

    def joined(batches):
        for batch in batches:
            rows = [compare(d, t, Tree(t), f, Tree(f))[:7] for d, t, f in
                    zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "following")))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), FIELDS)], [n for n, _ in FIELDS[:7]])

    shown = [n for n, _ in FIELDS[:7]]
    return done.where("edge IS NULL").select(*shown).union(
        edges.select("doc_id", "text", "following").mapInArrow(joined, SCHEMA.split(", edge")[0]))
