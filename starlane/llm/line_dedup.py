"""Line dedup: segment-partition edit join over the distinct lines of a corpus.

A line (between ``\\n``) of at least ``MIN_CHARS`` code points takes part;
shorter ones are left alone.  Equal lines are one, and two lines link when
at most ``TAU`` edits (insert, delete, replace a code point) apart.  Of each
component of links the earliest line (smallest ``doc_id``, then line number)
stays where it first occurs; every other occurrence is removed.

1. Lines are grouped by their text: a hot line shrinks to one row a task
   before the shuffle.
2. A line is cut into ``TAU + 1`` even segments; a line within ``TAU`` edits
   keeps one of them whole.  Each line probes, for its own length and up to
   ``TAU`` less, the substrings that can equal a segment (multi-match-aware
   windows around the segment's place).  Here only hashes are shuffled: of
   (length, segment, substring) and of the line.
3. One window over each hash finds the lines that met (a bucket is sorted and
   spilled, never held in memory).  A small bucket gives its pairs; in a
   large one every line is paired with the hub only, the indexed line that
   most documents hold.
4. The texts of candidates are fetched once, and each pair is verified once:
   all but ``TAU`` of ``PIECES`` parts must be found near their place, equal
   ends are cut off, and what is left is measured by banded bit-parallel edit
   distance (a band of ``2 * TAU + 1`` bits, as a fold over the code points;
   lines beyond ``LONG`` use the built-in banded ``levenshtein``, which needs
   less memory).
5. Lines of large buckets that are not in their hub's component are compared
   with the lines of other components there, past a filter on the parities
   of their characters and bigrams, and verified in the same way.

Everything is DataFrame expressions.  Lines are named by a 64-bit hash.
Null or empty texts have no lines and stay as they are.  Rows that share
a ``doc_id`` count as one document when the earliest line is chosen, and so do
rows without one, which come last.  Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starlane.llm.graph import components
from starlane.session import write_and_read

TAU = 2
MIN_CHARS = 20
SMALL_BUCKET = 16
LONG = 4096
PIECES = 8  # parts of a line of which a pair must share all but TAU
BROADCAST_ROWS = 1_000_000  # ids or short rows (tens of MB) that may be broadcast
LAST = (1 << 63) - 1  # stands for a null doc_id, which sorts last

_INDEXED = 1 << 40  # added to a line's document count where it is its own segment


def _small(df: DataFrame) -> DataFrame:
    """Hint a broadcast for a written table of at most ``BROADCAST_ROWS``."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _lines(docs: DataFrame) -> DataFrame:
    """``doc, text_id, no, line, id`` of every line that takes part."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc")
    split = F.posexplode(F.split("text", "\n")).alias("no", "line")
    lines = docs.select(doc, F.xxhash64("text").alias("text_id"), split).filter(F.char_length("line") >= MIN_CHARS)
    return lines.withColumn("id", F.xxhash64("line"))


def _segment(length: Column, i: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment ``i`` of a line of this length."""
    base, extra = F.floor(length / (TAU + 1)).cast("int"), length % (TAU + 1)
    longer_before = F.greatest(extra - (TAU + 1 - i), F.lit(0))
    return base * i + longer_before + 1, base + (extra >= TAU + 1 - i).cast("int")


def _probes() -> Column:
    """Hashes under which a line is looked for, and whether it is indexed there."""
    rows = []
    for shorter in range(TAU + 1):
        length = F.col("len") - shorter
        for i in range(TAU + 1):
            start, size = _segment(length, i)
            for shift in range(max(-i, shorter - (TAU - i)), min(i, shorter + (TAU - i)) + 1):
                key = F.xxhash64(length, F.lit(i), F.substring(F.col("line"), start + shift, size))
                own = F.lit(_INDEXED if shorter == 0 and shift == 0 else 0)
                rows.append(F.struct(key.alias("k"), (F.col("n") + own).alias("w")))
    return F.array(*rows)


def _buckets(lines: DataFrame) -> DataFrame:
    """Rows ``k, id, hub, n, indexed`` of the hashes under which lines met."""
    distinct = lines.groupBy("line").agg(F.count("*").alias("n")).withColumn("len", F.char_length("line"))
    met = distinct.select(F.xxhash64("line").alias("id"), F.explode(_probes()).alias("p")).select("p.k", "p.w", "id")
    order = W.partitionBy("k").orderBy(F.desc("w"), "id")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    met = met.select(
        "k", "id", "w", F.first("id").over(whole).alias("hub"), F.first("w").over(whole).alias("top"), F.count("*").over(whole).alias("size")
    )
    met = met.filter((F.col("size") > 1) & (F.col("top") >= _INDEXED))
    return write_and_read(met.select("k", "id", "hub", "size", (F.col("w") >= _INDEXED).alias("indexed")), "line-buckets")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _candidates(met: DataFrame) -> DataFrame:
    small = met.filter(F.col("size") <= SMALL_BUCKET)
    left = small.filter("indexed").select("k", F.col("id").alias("i"))
    pairs = left.join(small.select("k", "id"), "k").select(*_pair("i", "id"))
    stars = met.filter(F.col("size") > SMALL_BUCKET).select(*_pair("hub", "id"))
    return pairs.union(stars).filter("a <> b").distinct()


def _bit_parallel(a: Column, b: Column) -> Column:
    """Edit distance of ``a`` and ``b`` (arrays of characters, ``a`` at least
    as long, by at most ``TAU``), right up to ``TAU``."""
    width = 2 * TAU + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    steps = F.size(a) - TAU  # from here on the band follows the last row
    start = F.struct(
        F.lit(full ^ ((1 << TAU) - 1)).cast("int").alias("vp"),
        F.lit(0).alias("vn"),
        F.lit(TAU).alias("dist"),
        F.lit(top >> 1).cast("int").alias("row"),
    )
    bit = lambda c: c.cast("int")

    def step(s: Column, i: Column) -> Column:
        char = F.get(b, i)
        same = [F.when(F.get(a, i - TAU + k) == char, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)]
        match = same[0]
        for x in same[1:]:
            match = match.bitwiseOR(x)

        def diagonal(m: Column) -> Column:
            carried = (m.bitwiseAND(s.vp) + s.vp).bitwiseXOR(s.vp)
            return carried.bitwiseOR(m).bitwiseOR(s.vn).bitwiseAND(F.lit(full))

        def finish(d: Column) -> Column:
            hp = s.vn.bitwiseOR(F.lit(full).bitwiseXOR(d.bitwiseOR(s.vp)))
            hn = d.bitwiseAND(s.vp)
            down = F.shiftright(d, 1)
            along = bit(hp.bitwiseAND(s.row) != 0) - bit(hn.bitwiseAND(s.row) != 0)
            return F.struct(
                hn.bitwiseOR(F.lit(full).bitwiseXOR(down.bitwiseOR(hp))).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                (s.dist + F.when(i < steps, bit(d.bitwiseAND(F.lit(top)) == 0)).otherwise(along)).alias("dist"),
                F.when(i < steps, s.row).otherwise(F.shiftright(s.row, 1)).alias("row"),
            )

        return _let(_let(match, diagonal), finish)

    return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, step, lambda s: s.dist)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces_found(a: Column, b: Column) -> Column:
    """How many of ``PIECES`` even parts of ``a`` occur in ``b`` within ``TAU``
    places of where they are in ``a``: an edit spoils one part at most."""
    size = F.floor(F.char_length(a) / PIECES).cast("int")
    found = F.lit(0)
    for i in range(PIECES):
        start = size * i + 1
        around = F.substring(b, F.greatest(start - TAU, F.lit(1)), size + 2 * TAU)
        found = found + F.contains(around, F.substring(a, start, size)).cast("int")
    return found


def _without_ends(a: Column, b: Column, body) -> Column:
    """``body`` of two texts without leading and trailing parts (sixteenths of
    the shorter) that are equal in both: they do not change the distance."""
    parts = 16
    size = F.floor(F.least(F.char_length(a), F.char_length(b)) / parts).cast("int")

    def equal(side) -> Column:
        same = [F.when(side(a, size * k) == side(b, size * k), k).otherwise(0) for k in range(1, parts - 1)]
        return F.greatest(*same)

    def cut(ends: Column) -> Column:
        head = size * ends.head
        tail = size * F.least(ends.tail, F.lit(parts - 2) - ends.head)
        inner = lambda t: F.substring(t, head + 1, F.char_length(t) - head - tail)
        return _let(F.struct(inner(a).alias("a"), inner(b).alias("b")), lambda rest: body(rest.a, rest.b))

    return _let(F.struct(equal(F.left).alias("head"), equal(F.right).alias("tail")), cut)


def _distance(a: Column, b: Column) -> Column:
    """Edit distance, right up to ``TAU``: bit-parallel but for very short rests."""
    long_first = F.char_length(a) >= F.char_length(b)
    p, t = F.when(long_first, a).otherwise(b), F.when(long_first, b).otherwise(a)
    banded = _let(F.split(p, ""), lambda x: _let(F.split(t, ""), lambda y: _bit_parallel(x, y)))
    return F.when(F.least(F.char_length(a), F.char_length(b)) <= 2 * TAU, F.levenshtein(a, b)).otherwise(banded)


def within_tau(x: Column, y: Column) -> Column:
    """Whether two lines are within ``TAU`` edits."""
    return (
        F.when(F.abs(F.char_length(x) - F.char_length(y)) > TAU, F.lit(False))
        .when(_pieces_found(x, y) < PIECES - TAU, F.lit(False))
        .when(F.char_length(x) > LONG, F.levenshtein(x, y, TAU) >= 0)
        .otherwise(_without_ends(x, y, _distance) <= TAU)
    )


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
    met = pairs.join(left, "a").join(right, "b")
    return write_and_read(met.filter(within_tau(F.col("x"), F.col("y"))).select("a", "b"), "line-links")


def _parity(parts: Column) -> Column:
    one = F.lit(1).cast("long")
    bit = lambda p: F.call_function("shiftleft", one, F.pmod(F.xxhash64(p), F.lit(64)).cast("int"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc.bitwiseXOR(bit(p)))


def _rest(met: DataFrame, comps: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of large buckets whose components still differ."""
    large = met.filter(F.col("size") > SMALL_BUCKET).select("k", "id", "hub", "indexed")
    large = large.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    hubs = comps.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    large = large.join(hubs, "hub", "left").withColumn("out", F.coalesce("hub_comp", "hub") != F.col("comp")).drop("hub_comp")
    split = large.groupBy("k").agg(F.bool_or("out").alias("some")).filter("some").select("k")
    large = write_and_read(large.join(split, "k"), "line-large")
    if large.isEmpty():
        return large.select(*_pair("id", "hub")).limit(0)
    chars = F.split("line", "")
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("line") - 1), lambda i: F.substring(F.col("line"), i, F.lit(2)))
    pairs = F.when(F.char_length("line") <= LONG, _parity(pairs)).otherwise(F.lit(0).cast("long"))
    marks = texts.join(large.select("id").distinct(), "id", "left_semi").select("id", _parity(chars).alias("c"), pairs.alias("g"))
    large = write_and_read(large.join(marks, "id"), "line-marked")
    left = large.filter("out").select("k", *[F.col(c).alias(f"o_{c}") for c in ("id", "comp", "indexed", "c", "g")])
    near = (F.bit_count(F.col("o_c").bitwiseXOR(F.col("c"))) <= 2 * TAU) & (
        (F.col("o_g") == 0) | (F.col("g") == 0) | (F.bit_count(F.col("o_g").bitwiseXOR(F.col("g"))) <= 4 * TAU)
    )
    met = left.join(large, "k").filter((F.col("o_comp") != F.col("comp")) & (F.col("indexed") | F.col("o_indexed")) & near)
    return met.select(*_pair("o_id", "id")).distinct()


def line_components(docs: DataFrame) -> DataFrame:
    """``node, comp`` of the lines (by hash) that link with a smaller hash."""
    met = _buckets(_lines(docs))
    pairs = write_and_read(_candidates(met), "line-pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = _small(write_and_read(wanted, "line-wanted"))
    texts = _lines(docs).select("id", "line").join(wanted, "id", "left_semi").distinct()
    texts = write_and_read(texts, "line-texts")
    comps = components(_verify(pairs, texts))
    rest = write_and_read(_rest(met, comps, texts), "line-rest")
    if not rest.isEmpty():
        more = _verify(rest, texts)
        comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
    return comps


def _removed(docs: DataFrame) -> DataFrame:
    """``doc, text_id, gone``: the numbers of the lines that each text loses."""
    comps = line_components(docs)
    places = write_and_read(_lines(docs).select("doc", "text_id", "no", "id"), "line-places")
    first = places.groupBy("id").agg(F.min(F.struct("doc", "no")).alias("at"), F.count("*").alias("n")).select("id", "at.*", "n")
    linked = comps.select(F.col("node").alias("id"), "comp").union(comps.select(F.col("comp").alias("id"), "comp").distinct())
    classes = first.join(linked, "id", "left").filter((F.col("n") > 1) | F.col("comp").isNotNull())
    classes = write_and_read(classes.withColumn("comp", F.coalesce("comp", "id")).drop("n"), "line-classes")
    keep = classes.groupBy("comp").agg(F.min(F.struct(F.col("doc").alias("keep_doc"), F.col("no").alias("keep_no"))).alias("at")).select("comp", "at.*")
    classes = write_and_read(classes.select("id", "comp").join(keep, "comp").drop("comp"), "line-kept")
    gone = places.join(_small(classes), "id").filter("doc <> keep_doc OR no <> keep_no")
    return gone.groupBy("doc", "text_id").agg(F.collect_set("no").alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as ``row``, the lines that stay as ``lines``
    (null for a null text), and ``n_lines``, ``n_removed``."""
    gone = _small(write_and_read(_removed(docs), "line-gone"))
    row = docs.select(F.struct("*").alias("row")).withColumns(
        {"doc": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)), "text_id": F.xxhash64("row.text")}
    )
    joined = row.join(gone, ["doc", "text_id"], "left")
    lines = F.split("row.text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), lines).otherwise(_let(lines, lambda x: F.transform(stay, lambda i: F.get(x, i))))
    return joined.select(
        "row",
        left.alias("lines"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text`` (``n_chars``, if
    there, counts again).  Documents that lose all their words go."""
    done = dedup_lines(docs)
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.array_join("lines", "\n"))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    columns = []
    for name, kind in docs.dtypes:
        value = F.col("row").getField(name)
        if name == "text":
            value = F.col("text")
        elif name == "n_chars":
            value = F.when(F.col("n_removed") == 0, value).otherwise(F.char_length("text")).cast(kind)
        columns.append(value.alias(name))
    return done.select("row", "n_removed", text.alias("text")).filter(~F.coalesce(emptied, F.lit(False))).select(*columns)
