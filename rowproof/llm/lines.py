"""Near-duplicate lines by a segment-partition edit join, in DataFrame operations only.

Lines are the pieces of a text between newlines. Two lines of at least `least_chars` characters are
linked when at most `edits` insertions, deletions or substitutions turn one into the other; shorter
lines are alike only when equal; blank lines (white space at most) are never compared and all stay.

With `edits` + 1 segments at least one is left untouched by the edits. Every distinct line is indexed
by its segments and probes, for its own length and the shorter ones in reach, the substrings that
could be another line's segment (the start may move by as many edits as fit on either side). Lines
that meet are compared by a bit-parallel automaton over the diagonals of the band, once their common
ends are cut off. Equal lines are one from the first grouping on, so a line that fills the corpus is
indexed once. Parities of hashed words and letter pairs, of which an edit turns few, keep lines that
share a segment by template from being paired.

Classes are the connected groups of linked lines; the class is named by its first line, in order of
document and position. A null text has no lines. Rows with a null doc_id are left alone. Where rows
repeat an id, their lines count as lines of one document, and equal positions share their fate.
Line identities are 64-bit hashes; links are made by the lines themselves.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowproof.llm.base import checked_broadcast, unused
from rowproof.llm.graph import components
from rowproof.session import land


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, id) of every line that is not blank."""
    return (docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
            .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
            .where(F.col("line").rlike(r"[^\x09-\x0D\x20]")).withColumn("id", F.xxhash64("line")))


def segment_key(line: Column, length: Column, k: int, segments: int, shift: int) -> Column:
    """Key of the substring where segment k of a line of `length` may lie, moved by `shift`."""
    start = F.floor(length * k / segments)
    size = F.floor(length * (k + 1) / segments) - start
    return F.xxhash64(length, F.lit(k), F.substring(line, (start + 1 + shift).cast("int"), size.cast("int")))


def segment_rows(distinct: DataFrame, edits: int) -> DataFrame:
    """(key, id, indexed): a line's segments, by which it is found and looks for lines of its length, and the
    other substrings with which it looks for lines of its length or shorter ones."""
    n, line, segments = F.length("line"), F.col("line"), edits + 1
    rows = [F.struct(segment_key(line, n, k, segments, 0).alias("key"), F.lit(True).alias("indexed")) for k in range(segments)]
    for less in range(edits + 1):
        for k in range(segments):
            # Edits before the segment move it by k at most, those after it by what is left.
            for shift in range(max(-k, less - (edits - k)), min(k, less + (edits - k)) + 1):
                if less or shift:
                    rows.append(F.struct(segment_key(line, n - less, k, segments, shift).alias("key"), F.lit(False).alias("indexed")))
    return distinct.select("id", F.explode(F.array(*rows)).alias("row")).select("row.key", "id", "row.indexed")


def parity(parts: str, shift: int = 0) -> str:
    """SQL for 64 parities: one bit, named by the hash from bit `shift` on, is turned for every element."""
    return f"aggregate({parts}, 0L, (a, w) -> a ^ shiftleft(1L, shiftright(hash(w), {shift}) & 63))"


STEPS = ", ".join(str(1 << b) for b in range(26, -1, -1))


def bound(value: str, name: str, result: str) -> str:
    """SQL for `result` with `name` standing for `value`, which is worked out once."""
    return f"transform(array({value}), {name} -> {result})[0]"


# Letters side by side.
LETTER_PAIRS = bound("split(line, '')", "c", "zip_with(c, slice(c, 2, size(c)), (x, y) -> concat(x, coalesce(y, '')))")
# Parities of a line's parts, and how many of each an edit can turn: a new space makes two words of one,
# a letter two letter pairs of two. Four hashes of the pairs, as some that differ meet in a bit of one.
PARITIES = {"words": (parity("split(line, ' ')"), 3), **{f"pairs{i}": (parity("pairs", 6 * i), 4) for i in range(4)}}


def common(end: str, x: str, y: str) -> str:
    """SQL for the length of the common head ('left') or tail ('right') of two texts, by halving steps."""
    return f"""aggregate(array({STEPS}), 0, (k, step) -> if(k + step <= least(length({x}), length({y}))
        AND {end}({x}, k + step) = {end}({y}, k + step), k + step, k))"""


def automaton(edits: int) -> str:
    """SQL for whether `edits` edits turn the characters c.xs into c.ys, whose numbers differ by no more.

    State e holds a bit per diagonal of the band: set where the prefix of ys read so far matches the
    prefix of xs ending on that diagonal with at most e edits.
    """
    full = (1 << (2 * edits + 1)) - 1
    match = " | ".join(f"if(coalesce(get(c.xs, j - {edits + 1} + {b}) = get(c.ys, j - 1), false), {1 << b}, 0)"
                       for b in range(2 * edits + 1))
    states = ["(a.r0 & m)"]
    for e in range(1, edits + 1):
        # Match; substitution; a further letter of ys; a further letter of xs.
        states.append(f"((a.r{e} & m) | a.r{e - 1} | shiftright(a.r{e - 1}, 1) | (shiftleft({states[-1]}, 1) & {full}))")
    fields = ", ".join(f"'r{e}', {s}" for e, s in enumerate(states))
    start = ", ".join(f"'r{e}', {sum(1 << (edits + i) for i in range(e + 1))}" for e in range(edits + 1))
    return f"""(abs(size(c.xs) - size(c.ys)) <= {edits} AND shiftright(aggregate(
        if(size(c.ys) > 0, sequence(1, size(c.ys)), cast(array() as array<int>)), named_struct({start}),
        (a, j) -> {bound(match, "m", f"named_struct({fields})")}).r{edits}, size(c.xs) - size(c.ys) + {edits}) & 1 = 1)"""


def characters(text: str) -> str:
    return f"if({text} = '', cast(array() as array<string>), split({text}, ''))"


def within_edits(edits: int) -> Column:
    """Whether `edits` edits turn xline into yline: the band is only walked between their common ends."""
    inner = bound(f"named_struct('xs', {characters('left(b.x, length(b.x) - t)')}, 'ys', {characters('left(b.y, length(b.y) - t)')})",
                  "c", automaton(edits))
    cut = bound(common("right", "b.x", "b.y"), "t", inner)
    rest = bound("named_struct('x', substring(xline, h + 1), 'y', substring(yline, h + 1))", "b", cut)
    return F.expr(bound(common("left", "xline", "yline"), "h", rest))


def line_links(docs: DataFrame, edits: int = 2, least_chars: int = 16) -> DataFrame:
    """Pairs (x, y) of ids of different lines within `edits` edits; x < y."""
    distinct = lines_of(docs).where(F.length("line") >= least_chars).groupBy("line").agg(F.count("*").alias("n"))
    rows = segment_rows(distinct.select("line", F.xxhash64("line").alias("id")), edits)
    # One shuffle brings the lines of a key together; a key of one line, or without an index entry, ends there.
    over = lambda c: c.over(W.partitionBy("key"))
    shared = land(rows.withColumn("low", over(F.min("id"))).withColumn("high", over(F.max("id")))
                  .withColumn("held", over(F.max("indexed")))
                  .where("low < high AND held").select("key", "id", "indexed"), "segments")
    ids = checked_broadcast(shared.select("id").distinct())
    texts = land(lines_of(docs).select("id", "line").join(ids, "id").distinct()
                 .withColumn("pairs", F.expr(LETTER_PAIRS)).withColumn("chars", F.length("line"))
                 .withColumns({name: F.expr(sql) for name, (sql, _) in PARITIES.items()}).drop("pairs"), "lines")
    fields = ["id", "chars", *PARITIES]
    placed = shared.join(texts.select(fields), "id")
    left, right = (rows.select("key", *(F.col(c).alias(side + c) for c in fields))
                   for side, rows in (("x", placed), ("y", placed.where("indexed"))))
    near = (F.abs(F.col("xchars") - F.col("ychars")) <= edits) & (F.col("xid") != F.col("yid"))
    for name, (_, turned) in PARITIES.items():
        near &= F.bit_count(F.col(f"x{name}").bitwiseXOR(F.col(f"y{name}"))) <= turned * edits
    pairs = land(left.join(right, "key").where(near)
                 .select(F.least("xid", "yid").alias("x"), F.greatest("xid", "yid").alias("y")).distinct(), "pairs")
    both = (pairs.join(texts.select(F.col("id").alias("x"), F.col("line").alias("xline")), "x")
            .join(texts.select(F.col("id").alias("y"), F.col("line").alias("yline")), "y"))
    return both.where(within_edits(edits)).select("x", "y").distinct()


def line_classes(docs: DataFrame, edits: int = 2, least_chars: int = 16) -> DataFrame:
    """(doc_id, line_no, class_doc, class_line, copies, links, kept) of every line that is not blank.

    copies: lines equal to it, itself included; links: different lines near it; kept: it is the
    first of its class.
    """
    links = land(line_links(docs, edits, least_chars), "links")
    numbered = lines_of(docs).select("doc_id", "line_no", "id")
    first = land(numbered.groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("copies")), "first")
    labels = components(links)
    degree = links.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    member = labels.withColumnRenamed("node", "id").join(first.drop("copies"), "id").join(degree, "id")
    head = member.groupBy("label").agg(F.min("first").alias("head"))
    linked = land(member.join(head, "label").select("id", "head", "links"), "linked")
    of_id = (first.join(linked, "id", "left")
             .select("id", "copies", F.coalesce("head", "first").alias("head"), F.coalesce("links", F.lit(0)).alias("links")))
    return numbered.join(of_id, "id").select(
        "doc_id", "line_no", F.col("head.doc_id").alias("class_doc"), F.col("head.line_no").alias("class_line"), "copies", "links",
        (F.struct("doc_id", "line_no") == F.col("head")).alias("kept"))


def drop_repeated_lines(docs: DataFrame, edits: int = 2, least_chars: int = 16) -> DataFrame:
    """`docs` without the lines whose class began earlier; n_chars follows the text.

    Documents that lose every line that was not blank are repeats as a whole and go too.
    """
    classes = line_classes(docs, edits, least_chars).where("NOT kept").select("doc_id", "line_no").distinct()
    # A bit per line, 32 to a number, so that a text of very many lines stays linear.
    word = F.expr("line_no div 32").alias("at")
    bits = classes.groupBy("doc_id", word).agg(F.sum(F.expr("shiftleft(1L, cast(line_no % 32 as int))")).alias("bits"))
    id_, flags, left = unused(docs.columns, "__id", "__flags", "__left")
    gone = bits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m"), F.max("at").alias("last")).select(
        F.col("doc_id").alias(id_), F.expr("transform(sequence(0L, last), i -> coalesce(m[i], 0L))").alias(flags))
    joined = docs.join(gone, F.col("doc_id") == F.col(id_), "left")
    left_over = F.expr(f"filter(split(text, '\\n'), (l, i) -> shiftright(coalesce(get({flags}, cast(i div 32 as int)), 0L), cast(i % 32 as int)) & 1 = 0)")
    joined = joined.withColumn(left, F.when(F.col(flags).isNotNull(), left_over))
    blank = ~F.exists(left, lambda x: x.rlike(r"[^\x09-\x0D\x20]"))
    joined = joined.where(F.col(flags).isNull() | ~blank)
    text = F.coalesce(F.array_join(left, "\n"), F.col("text"))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(flags).isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in docs.columns))
