"""Array tokenisation shared by the operators that run Python inside tasks.

Texts reach Python as Arrow batches.  Words are found and hashed with numpy
over the UTF-8 bytes of many documents at once, in blocks of a quarter of a
megabyte, so the working memory follows the block (or the longest document),
never the partition.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlane.session import bound_batches

BLOCK_BYTES = 1 << 18
ROWS = 1000  # texts that a task works on at once

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash like a-z

#: Bytes that belong to a word.  All non-ASCII bytes do in both classes, so
#: the byte view of UTF-8 gives the same words as the code point patterns.
SPACED = np.ones(256, bool)  # [^\x20\x09-\x0D]+
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)  # digits, letters, everything non-ASCII
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, and bound
    the Arrow batches that its tasks get from this session."""
    bound_batches(spark)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="starlane-code-")) / "starlane_code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))


_shipped: set[str] = set()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_PRIME, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that any bits of them can be used."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _hash_words(data: np.ndarray, cuts: np.ndarray, word: np.ndarray):
    """Starts, ends and hashes of the words of ``data``; no word crosses a cut."""
    inside = word[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    at = cuts[(cuts > 0) & (cuts <= len(data))] - 1
    after[at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts])


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each (null: empty)."""
    if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    else:
        texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes; a longer document is its own run."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_blocks(texts: pa.Array, word: np.ndarray):
    """For each run of documents ``lo:hi``: ``lo, hi, first, hashes, starts, ends``.

    Document ``lo + k`` has the words ``first[k]:first[k + 1]``; starts and
    ends are byte positions counted from the start of document ``lo``.
    """
    data, offsets = byte_view(texts)
    for lo, hi in blocks(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= 2 * BLOCK_BYTES:
            cuts = offsets[lo : hi + 1] - a
            starts, ends, hashes = _hash_words(data[a:b], cuts, word)
            yield lo, hi, np.searchsorted(starts, cuts), hashes, starts, ends
            continue
        parts, at = [], a  # one long document, in pieces cut between words
        while at < b:
            to = min(at + BLOCK_BYTES, b)
            while to < b and word[data[to - 1]] and word[data[to]]:
                gap = np.flatnonzero(~word[data[at:to]])
                if len(gap):
                    to = at + int(gap[-1]) + 1
                else:  # a word longer than a block
                    more = np.flatnonzero(~word[data[to : to + BLOCK_BYTES]])
                    to = to + int(more[0]) + 1 if len(more) else min(to + BLOCK_BYTES, b)
            s, e, h = _hash_words(data[at:to], np.zeros(0, np.int64), word)
            parts.append((s + (at - a), e + (at - a), h))
            at = to
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield lo, hi, np.array([0, len(starts)]), hashes, starts, ends


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(_PRIME) + hashes[k : k + len(total)]
    return mix(total)


def annotate_rows(
    table: DataFrame,
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    schema: str,
    keep: list[str] | None,
    column: str,
    rows: int = ROWS,
) -> DataFrame:
    """Add columns computed from one column by ``make()(values)``.

    The kept columns travel as one struct ``row``, so the new names can never
    clash with theirs; the result has ``row`` and the new columns.
    ``make`` runs once in each task and may load models there.
    """
    columns = table.columns if keep is None else keep
    carried = columns if column in columns else [*columns, column]
    quoted = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in carried]
    packed = table.select(F.struct(*quoted).alias("row"))
    added = T._parse_datatype_string(schema)
    types = T.StructType([packed.schema["row"], *added.fields])
    names = [f.name for f in types.fields]

    def run(batches):
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.column(0).slice(at, rows)
                out = work(pc.struct_field(some, [carried.index(column)]))
                yield pa.RecordBatch.from_arrays([some, *out], names)

    done = packed.mapInArrow(run, types)
    if len(carried) != len(columns):
        done = done.withColumn("row", F.struct(*[F.col("row").getField(c).alias(c) for c in columns]))
    return done


def annotate(
    docs: DataFrame,
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    schema: str,
    keep: list[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """``annotate_rows`` for the text column of documents."""
    return annotate_rows(docs, make, schema, keep, text)
