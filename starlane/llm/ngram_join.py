"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document is its set of distinct word n-grams (hashed to 64 bits).  Two
documents link when ``100 * |A and B| >= percent * |A or B|``.

1. *Sketch.*  One pass counts n-grams in a table of ``2**COUNT_BITS`` bins
   (a fixed 1 MB once scaled to bytes, whatever the corpus) and gives every
   document the signature of its set.  Equal sets are one node from here on.
2. *Prefixes.*  N-grams are ordered rare-first, by (bin count, hash).  Linked
   sets share an n-gram among the rarest ``n - ceil(t * n) + 1`` of each.
   The prefix postings are dealt by hash range as packed binary rows.
3. *Buckets.*  Postings of one n-gram meet.  A small bucket gives its pairs, a
   large one only pairs with its hub, the member whose n-grams are the most
   frequent on average (an original rather than an altered copy).  Length
   and positional filters apply, and a pair leaves a task once.
4. *Verification.*  A suffix filter bounds the overlap of a pair by the counts
   of its sets in each hash range; the sets of the pairs that are left meet
   once, for the exact intersection.
5. *The rest of large buckets.*  Members that ended in another component than
   their hub are paired with the members of other components, verified in
   the same way, and the components are formed again.  So no link that would
   join two components is lost, and a group of N near copies costs about N.

Nulls and empty texts have an empty set (``n_shingles`` 0) and link with
nothing; a text with fewer than five words is one n-gram.  Repeated rows share
a node, and each row keeps its own line in the result.  Extra columns are
not read.  A null ``doc_id`` is never a ``component_id`` unless its whole
component has none.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlane.llm import text as tx
from starlane.llm.graph import components
from starlane.session import write_and_read

N_WORDS = 5
PERCENT = 75
COUNT_BITS = 20  # bins of the frequency sketch
CHUNKS = 256  # pieces in which the sketch is added up
SMALL_BUCKET = 4  # up to here a bucket gives all its pairs
RANGES = 256  # hash ranges of the suffix filter
FLUSH = 250_000  # postings a task holds before it hands them on
GROUPS = 4  # hash ranges of postings for each partition; a task holds one at a time
MEMO = 1_000_000  # signatures a task remembers
NO_ID = (1 << 63) - 1  # stands for a null doc_id inside
BROADCAST_IDS = 1_000_000  # document ids (8 MB) that may be broadcast

_MASK = np.uint64((1 << COUNT_BITS) - 1)


def shingle_sets(texts: pa.Array, n: int = N_WORDS):
    """Yield the sorted distinct n-gram hashes of each text, in order."""
    for lo, hi, first, words, _, _ in tx.word_blocks(texts, tx.SPACED):
        grams = tx.rolling(words, n)
        for k in range(hi - lo):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield tx.rolling(words[a:b], b - a) + np.uint64(b - a)
            else:
                yield words[:0]


def _signature(grams: np.ndarray) -> int:
    mixed = tx.mix(grams + np.uint64(0x1F83D9ABFB41BD6B))
    return int(tx.mix(np.array([mixed.sum(dtype=np.uint64) ^ np.uint64(len(grams) * 0x9E3779B1)]))[0].astype(np.int64))


def _spread(grams: np.ndarray) -> bytes:
    """How many n-grams fall into each of ``RANGES`` hash ranges (at most 255)."""
    return np.minimum(np.bincount((grams >> np.uint64(56)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes()


def prefix_length(n, percent: int = PERCENT):
    """How many of the rarest n-grams of a set of ``n`` must be looked at."""
    return n - (n * percent + 99) // 100 + 1


def needed_overlap(na, nb, percent: int = PERCENT):
    """Least intersection of linked sets of these sizes."""
    return (percent * (na + nb) + 99 + percent) // (100 + percent)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _sketch(docs: DataFrame) -> DataFrame:
    def run(batches):
        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            sizes, sigs, spread, bins, held = [], [], [], [], 0
            for grams in shingle_sets(batch.column(1)):
                sizes.append(len(grams))
                sigs.append(_signature(grams) if len(grams) else 0)
                spread.append(_spread(grams))
                bins.append((grams & _MASK).astype(np.int32))
                held += len(grams)
                if held > 1 << COUNT_BITS:
                    counts += np.bincount(np.concatenate(bins), minlength=len(counts)).astype(np.uint32)
                    bins, held = [], 0
            if bins:
                counts += np.bincount(np.concatenate(bins), minlength=len(counts)).astype(np.uint32)
            m = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(spread, pa.binary())],
                names,
            )
        if counts.any():
            parts = [c.tobytes() for c in counts.reshape(CHUNKS, -1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary()), *[pa.nulls(CHUNKS, pa.int64())] * 3, pa.nulls(CHUNKS, pa.binary())],
                names,
            )

    out = "chunk int, counts binary, doc_id long, n long, sig long, spread binary"
    names = [f.split()[0] for f in out.split(", ")]
    return write_and_read(docs.select(_id().alias("doc_id"), "text").mapInArrow(run, out), "ngram-sketch")


def _ranks(sketch: DataFrame) -> np.ndarray:
    """Bin counts on a logarithmic scale, one byte a bin."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.uint32)
                if c not in total:
                    total[c] = np.zeros(len(part), np.uint64)
                total[c] += part
        keys = list(total)
        bytes_ = [np.minimum(255, np.round(6 * np.log2(1.0 + total[c]))).astype(np.uint8).tobytes() for c in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(bytes_, pa.binary())], ["chunk", "ranks"])

    parts = sketch.filter("chunk IS NOT NULL").select("chunk", "counts")
    rows = parts.repartition(min(CHUNKS, 32), "chunk").mapInArrow(add, "chunk int, ranks binary").collect()
    ranks = np.zeros((CHUNKS, (1 << COUNT_BITS) // CHUNKS), np.uint8)
    for r in rows:
        ranks[r.chunk] = np.frombuffer(r.ranks, np.uint8)
    return ranks.reshape(-1)


#: A posting: hash, node (its signature), set size, position, mean rank of the
#: node's n-grams.  Bytes of the hash that the group implies are not stored.
_POSTING = np.dtype([("h", "<u8"), ("sig", "<i8"), ("n", "<u4"), ("pos", "<u4"), ("centre", "<u2")])
_STORED = np.array([*range(5), *range(8, _POSTING.itemsize)])


def _pack(postings: np.ndarray, groups: int):
    """Postings dealt into hash ranges, as ``(group, bytes)``; like bytes are
    stored together, which compresses well."""
    group = ((postings["h"] >> np.uint64(40)).astype(np.int64) * groups) >> 24
    order = np.argsort(group, kind="stable")
    postings, group = postings[order], group[order]
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        planes = postings[a:b].view(np.uint8).reshape(b - a, -1)[:, _STORED].T
        yield int(group[a]), np.ascontiguousarray(planes).tobytes()


def _unpack(raw) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(len(_STORED), -1)
    out = np.zeros((planes.shape[1], _POSTING.itemsize), np.uint8)
    out[:, _STORED] = planes.T
    return out.view(_POSTING).ravel()


def _postings(docs: DataFrame, ranks, groups: int) -> DataFrame:
    def run(batches):
        table = ranks.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush():
            rows = list(_pack(np.concatenate(held), groups)) if held else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["g", "postings"])

        for batch in batches:
            for grams in shingle_sets(batch.column(0)):
                n = len(grams)
                if not n or (sig := _signature(grams)) in seen:
                    continue
                if len(seen) < MEMO:  # a memo of copies met in this task; a miss only costs a repeated posting
                    seen.add(sig)
                rank = table[(grams & _MASK).astype(np.int64)]
                rows = np.empty(prefix_length(n), _POSTING)
                rows["h"] = grams[np.argsort(rank, kind="stable")[: len(rows)]]  # grams are sorted, so ties go by hash
                rows["sig"], rows["n"], rows["pos"], rows["centre"] = sig, n, np.arange(len(rows)), int(rank.mean() * 256)
                held.append(rows)
                size += len(rows)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        yield flush()

    return docs.select("text").mapInArrow(run, "g int, postings binary")


def _bucket_pairs(rows: np.ndarray, small: int):
    """Candidate pairs of the buckets (runs of equal ``h``), and large buckets."""
    rows = rows[np.lexsort((rows["sig"], -rows["centre"].astype(np.int64), rows["h"]))]
    h, sig, n, pos = rows["h"], rows["sig"], rows["n"].astype(np.int64), rows["pos"].astype(np.int64)
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])
    h, sig, n, pos = h[fresh], sig[fresh], n[fresh], pos[fresh]
    starts = np.flatnonzero(np.diff(h, prepend=h[:1] - np.uint64(1))) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(starts, append=len(h))
    size, hub = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    left, right = [], []
    at = np.arange(len(h))
    big = size > small
    star = at[big & (at != hub)]
    left.append(hub[star])
    right.append(star)
    rank_in = at - hub
    for d in range(1, small):
        a = at[~big & (rank_in + d < size)]
        if not len(a):
            break
        left.append(a)
        right.append(a + d)
    a, b = np.concatenate(left), np.concatenate(right)
    na, nb = n[a], n[b]
    fits = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * PERCENT
    fits &= np.minimum(na - pos[a], nb - pos[b]) >= needed_overlap(na, nb)
    a, b, na, nb = a[fits], b[fits], na[fits], nb[fits]
    swap = sig[a] > sig[b]
    lo, hi = np.where(swap, sig[b], sig[a]), np.where(swap, sig[a], sig[b])
    pairs, once = np.unique(np.stack([lo, hi], 1), axis=0, return_index=True)
    sums = (na + nb)[once]
    return pairs[:, 0], pairs[:, 1], sums, (h[big].astype(np.int64), sig[hub[big]], sig[big], n[big], pos[big])


_FOUND = "a long, b long, total long, bucket long, hub long, node long, n long, pos long"


def _meet(postings: DataFrame, partitions: int, small: int = SMALL_BUCKET) -> DataFrame:
    def run(batches):
        parts = ((g.as_py(), raw) for batch in batches for g, raw in zip(*batch.columns, strict=True))
        for _, group in groupby(parts, key=itemgetter(0)):
            rows = np.concatenate([_unpack(raw.as_buffer()) for _, raw in group])
            rows = rows[np.argsort(rows["h"], kind="stable")]
            twin = np.zeros(len(rows), bool)
            twin[1:] = rows["h"][1:] == rows["h"][:-1]
            twin[:-1] |= twin[1:]
            rows = rows[twin]  # an n-gram of one node only joins nothing
            a, b, total, big = _bucket_pairs(rows, small)
            names = [f.split()[0] for f in _FOUND.split(", ")]
            none, big_none = pa.nulls(len(a), pa.int64()), pa.nulls(len(big[0]), pa.int64())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total), *[none] * 5], names)
            if len(big[0]):
                yield pa.RecordBatch.from_arrays([*[big_none] * 3, *map(pa.array, big)], names)

    return write_and_read(postings.repartition(partitions, "g").sortWithinPartitions("g").mapInArrow(run, _FOUND), "ngram-candidates")


def _suffix_filter(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Drop pairs whose counts by hash range already rule out the overlap."""
    met = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    spread = sketch.filter("n > 0").join(met, "sig", "left_semi").groupBy("sig", "n").agg(F.first("spread").alias("spread"))
    left = spread.select(F.col("sig").alias("a"), F.col("spread").alias("x"), F.col("n").alias("na"))
    right = spread.select(F.col("sig").alias("b"), F.col("spread").alias("y"), F.col("n").alias("nb"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "na", "nb")

    def compare(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, RANGES) for c in (2, 3))
            need = needed_overlap(batch.column(4).to_numpy(), batch.column(5).to_numpy())
            full = (x == 255).any(1) | (y == 255).any(1)
            at = pa.array(np.flatnonzero(full | (np.minimum(x, y).sum(1, dtype=np.int64) >= need)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return write_and_read(met.mapInArrow(compare, "a long, b long"), "ngram-filtered")


def _verify(pairs: DataFrame, sketch: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that link, each compared once."""
    pairs = _suffix_filter(pairs, sketch)
    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    ids = sketch.filter("n > 0").join(wanted, "sig").groupBy("sig").agg(F.min("doc_id").alias("rep")).select("rep")
    ids = write_and_read(ids, "ngram-wanted")
    texts = docs.select(_id().alias("rep"), "text")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = texts.join(ids, "rep", "left_semi")

    def sets(batches):
        done: set[int] = set()
        for batch in batches:
            sig, raw = [], []
            for grams in shingle_sets(batch.column(0)):
                if len(grams) and (s := _signature(grams)) not in done:
                    sig.append(s)
                    raw.append(grams.tobytes())
                    if len(done) < MEMO:
                        done.add(s)
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(raw, pa.large_binary()).cast(pa.binary())], ["sig", "grams"])

    held = texts.select("text").mapInArrow(sets, "sig long, grams binary")
    left = held.select(F.col("sig").alias("a"), F.col("grams").alias("x"))
    right = held.select(F.col("sig").alias("b"), F.col("grams").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                need = needed_overlap(len(x), len(y))
                keep[i] = len(np.intersect1d(x, y, assume_unique=True)) >= need
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return write_and_read(met.mapInArrow(compare, "a long, b long").distinct(), "ngram-links")


def _rest(found: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs of large buckets that the hubs have not settled."""
    members = found.filter("bucket IS NOT NULL").select("bucket", "hub", "node", "n", "pos")
    label = comps.select("node", "comp")
    members = members.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    hubs = label.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    members = members.join(hubs, "hub", "left").withColumn("hub_comp", F.coalesce("hub_comp", "hub"))
    members = write_and_read(members, "ngram-members")
    out = members.filter("comp <> hub_comp").select(
        "bucket", F.col("node").alias("u"), F.col("comp").alias("uc"), F.col("n").alias("un"), F.col("pos").alias("up")
    )
    met = out.join(members, "bucket").filter(
        (F.col("uc") != F.col("comp"))
        & (F.least("un", "n") * 100 >= F.greatest("un", "n") * PERCENT)
        & (F.least(F.col("un") - F.col("up"), F.col("n") - F.col("pos")) >= F.expr(f"({PERCENT} * (un + n) + {99 + PERCENT}) div {100 + PERCENT}"))
    )
    return met.select(F.least("u", "node").alias("a"), F.greatest("u", "node").alias("b")).distinct()


def jaccard_groups(docs: DataFrame, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (the
    smallest ``doc_id`` reachable by links, its own included)."""
    spark: SparkSession = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketch = _sketch(docs)
    ranks = spark.sparkContext.broadcast(_ranks(sketch))
    rows = sketch.filter("chunk IS NULL").select("doc_id", "n", "sig")
    nodes = rows.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    found = _meet(_postings(docs, ranks, GROUPS * partitions), partitions, small_bucket)
    pairs = write_and_read(found.filter("a IS NOT NULL").select("a", "b").distinct(), "ngram-pairs")
    links = _verify(pairs, sketch, docs)
    comps = components(links)
    rest = write_and_read(_rest(found, comps), "ngram-rest")
    if not rest.isEmpty():
        more = _verify(rest, sketch, docs)
        comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
    named = nodes.join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "comp").select("sig", "component_id")
    return rows.join(named, "sig", "left").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif(F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")), F.lit(NO_ID)).alias("component_id"),
    )


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """The documents whose id is the smallest of their component, with the
    columns of ``docs``.  Documents without words or without an id all stay;
    rows that repeat a ``doc_id`` are one document and share its fate."""
    groups = jaccard_groups(docs)
    dropped = groups.filter((F.col("component_id") != F.col("doc_id")) & (F.col("n_shingles") > 0))
    dropped = write_and_read(dropped.select("doc_id").distinct(), "ngram-dropped")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
