"""Vector code compression: member-resident Lloyd iteration.

Vectors of whole numbers are cut into equal parts, and each part position has
a codebook of a few entries; a vector is stored as the numbers of its nearest
entries.  The books are fitted by Lloyd iteration in which the rows, not the
books, stay where they are:

1. Every part goes to its owner (position, entry, salt) in one shuffle; the
   owners' members are written in the shared folder.  Equal parts of a batch
   travel as one row with a count, so a vector that holds a third of all rows
   is a row a batch.  The salt splits the members of an entry over many owners.
2. In each round the members are read where they lie and compared with the
   entries of their position.  Those whose nearest entry is still their owner's
   stay: they are neither shuffled nor written again.  Only the others migrate,
   in one shuffle, and are written as a further generation of members.
3. Owners keep sums and counts and update them from the migrants alone, plus
   what arrives and minus what leaves.  All are whole numbers, so sums kept this
   way equal sums taken anew.  A row of a generation is no member any more once
   an entry of a later round was nearer; that is seen by comparing it with the
   books of those rounds again.

What reaches the driver are sums by position, entry and component, as many
numbers as the books have, whatever the table's size.  Rows are coded at the
end from the table itself, so no row ever needs to be put together from parts.

Defined results: rows are dropped whose vector is null or holds null or
non-finite components, or has another length than most rows have (a length
that can be cut evenly; ties: the longer).  Equal and repeated rows are coded
alike.  The first entries are the parts of the rows of the smallest ids (equal
ids: by vector; null ids last), fewer if there are fewer rows.  An empty table
gives no rows.  Components of 65,536 and more are an error.  Extra columns stay
in ``row`` whatever their names; null labels are a label.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlane.llm.text import annotate_rows
from starlane.session import read_table_of, remove_path, write_table

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
LARGEST = 1 << 28  # of a whole-number component: squared distances stay exact
SLICE = 4096  # vectors, and SLICE * PARTS member parts, that a task works on at once
BROADCAST_LABELS = 1 << 20  # labels whose sums (16 bytes each) are broadcast; more are joined by a shuffle

MEMBER = "pos int, entry int, origin int, n long, part array<int>"


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def usable(vector: Column) -> Column:
    """Whether a vector can be coded."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """Components times ``SCALE``, rounded down."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component of {LARGEST // SCALE} or more cannot be coded")
    return scaled.astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(parts: np.ndarray, pos: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest entry of each part's
    position; the lower number of equally near ones."""
    best = np.zeros(len(parts), np.int64)
    least = np.full(len(parts), np.iinfo(np.int64).max)
    for entry in range(book.shape[1]):
        off = parts - book[pos, entry]
        square = np.einsum("ij,ij->i", off, off)
        closer = square < least
        best[closer], least[closer] = entry, square[closer]
    return best, least


@dataclass
class Codebooks:
    """Entries by position, and the columns they were fitted on."""

    entries: np.ndarray  # position, entry, component
    vector: str = "embedding"
    parts: int = PARTS
    history: list[int] = field(default_factory=list)  # parts that migrated in each round

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _kept(vectors: DataFrame, vector: str, length: int | None) -> DataFrame:
    good = vectors.filter(usable(_name(vector)))
    return good if length is None else good.filter(F.size(_name(vector)) == length)


def common_length(vectors: DataFrame, vector: str, parts: int = PARTS) -> int:
    """The length that most usable vectors have (0 if there is none)."""
    size = F.size(_name(vector))
    sizes = _kept(vectors, vector, None).groupBy(size.alias("size")).count()
    row = sizes.filter((F.col("size") > 0) & (F.col("size") % parts == 0)).orderBy(F.desc("count"), F.desc("size")).first()
    return row["size"] if row else 0


def _first_members(book: np.ndarray):
    """Parts of vectors with their first owners, equal ones of a batch as one row."""
    parts, _, width = book.shape

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                whole = whole_numbers(_matrix(batch.column(0).slice(at, SLICE), parts * width)).astype(np.int32)
                for p in range(parts):
                    part = np.ascontiguousarray(whole[:, p * width : (p + 1) * width])
                    same, first, n = np.unique(part.view(f"V{4 * width}").ravel(), return_index=True, return_counts=True)
                    part = part[first]
                    pos = np.full(len(part), p)
                    entry, _ = nearest(part.astype(np.int64), pos, book)
                    yield _members(pos, entry, entry, n, part)

    return run


def _members(pos, entry, origin, n, part) -> pa.RecordBatch:
    offsets = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
    rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(part).ravel(), pa.int32()))
    columns = [pa.array(pos, pa.int32()), pa.array(entry, pa.int32()), pa.array(origin, pa.int32()), pa.array(n, pa.int64()), rows]
    return pa.RecordBatch.from_arrays(columns, ["pos", "entry", "origin", "n", "part"])


def _migrants(books: list[np.ndarray]):
    """Members of any generation whose nearest entry changes with the last
    book; ``origin`` is the entry that they leave.  ``generation`` is the
    number of the book that a row was last dealt by."""
    width = books[0].shape[2]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE * PARTS):
                some = batch.slice(at, SLICE * PARTS)
                pos, entry, born, n = (some.column(i).to_numpy() for i in (0, 1, 2, 3))
                part = _matrix(some.column(4), width)
                here = np.arange(len(pos))
                for k in range(1, len(books)):
                    aged = born[here] < k
                    asked = here[aged]
                    now, _ = nearest(part[asked].astype(np.int64), pos[asked], books[k])
                    moved = now != entry[asked]
                    if k == len(books) - 1:
                        go = asked[moved]
                        yield _members(pos[go], now[moved], entry[go], n[go], part[go])
                    gone = np.zeros(len(pos), bool)
                    gone[asked[moved]] = True
                    here = here[~gone[here]]

    return run


def _changes(parts: int, entries: int, width: int):
    """What members add to their owners and, unless they are new, take from
    the owners that they left: one short table a task."""

    def run(batches):
        total = np.zeros((parts * entries, width + 1), np.int64)
        moved = 0
        for batch in batches:
            pos, entry, origin, n = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            gain = np.column_stack([_matrix(batch.column(4), width).astype(np.int64) * n[:, None], n])
            np.add.at(total, pos * entries + entry, gain)
            left = entry != origin
            np.subtract.at(total, (pos * entries + origin)[left], gain[left])
            moved += int(n[left].sum())
        owner, k = np.nonzero(total)
        owner, k = np.r_[owner, -1], np.r_[k, 0]
        values = np.r_[total[owner[:-1], k[:-1]], moved]
        columns = [pa.array(owner, pa.int32()), pa.array(k, pa.int32()), pa.array(values, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["owner", "k", "change"])

    return run


def _apply(members: DataFrame, sums: np.ndarray) -> int:
    """Add the changes that ``members`` make to the owners' sums; how many migrated."""
    entries, width = sums.shape[1], sums.shape[2] - 1
    partial = members.mapInArrow(_changes(sums.shape[0], entries, width), "owner int, k int, change long")
    moved = 0
    for owner, k, change in partial.groupBy("owner", "k").agg(F.sum("change")).collect():
        if owner < 0:
            moved = change
        else:
            sums[owner // entries, owner % entries, k] += change
    return moved


def _updated(book: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Each entry as the mean of its members, rounded down; unused ones stay."""
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), book)


def fit(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of all usable vectors (None: there are none)."""
    length = common_length(vectors, vector, parts)
    if not length:
        return None
    spark, width = vectors.sparkSession, length // parts
    table = _kept(vectors, vector, length).select(_name(vec_id).alias("id"), _name(vector).alias("v"))
    seeds = table.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    start = whole_numbers(np.array([r.v for r in seeds], np.float64))
    book = np.ascontiguousarray(start.reshape(len(start), parts, width).transpose(1, 0, 2))
    sums = np.zeros((parts, book.shape[1], width + 1), np.int64)
    salts = 1 + 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // (parts * entries)

    def settle(rows: DataFrame) -> str:
        salt = F.pmod(F.xxhash64("part"), F.lit(salts))
        return write_table(rows.repartition("pos", "entry", salt), "vector-members")

    generations, books, history = [], [book], []
    try:
        for r in range(rounds):
            if r == 0:
                rows = table.select("v").mapInArrow(_first_members(book), MEMBER)
            else:
                aged = [
                    read_table_of(spark, path, rows.schema).select("pos", "entry", F.lit(g).alias("born"), "n", "part")
                    for g, path in enumerate(generations)
                ]
                members = aged[0]
                for more in aged[1:]:
                    members = members.unionByName(more)
                rows = members.mapInArrow(_migrants(books), MEMBER)
            generations.append(settle(rows))
            history.append(_apply(read_table_of(spark, generations[-1], rows.schema), sums))
            book = _updated(book, sums)
            books.append(book)
    finally:
        for path in generations:
            remove_path(spark, path)
    return Codebooks(book, vector, parts, history)


def encode(vectors: DataFrame, books: Codebooks, keep: list[str] | None = None) -> DataFrame:
    """The kept columns as ``row``, the ``code`` (two hexadecimal digits a
    part) and the ``error`` of every usable vector."""
    book, parts = books.entries, books.parts
    width = book.shape[2]

    def code(column: pa.Array) -> list[pa.Array]:
        whole = whole_numbers(_matrix(column, books.length))
        digits, error = np.zeros((len(whole), parts), np.uint8), np.zeros(len(whole), np.int64)
        for p in range(parts):
            entry, square = nearest(whole[:, p * width : (p + 1) * width], np.full(len(whole), p), book)
            digits[:, p] = entry
            error += square
        return [pa.array([row.tobytes().hex() for row in digits], pa.string()), pa.array(error, pa.int64())]

    return annotate_rows(_kept(vectors, books.vector, books.length), lambda: code, "code string, error long", keep, books.vector, SLICE)


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", keep: list[str] | None = None) -> DataFrame:
    """``encode`` with books fitted on the same vectors, the ``label_error``
    (errors summed over equal labels) and the digest of the books."""
    columns = vectors.columns if keep is None else keep
    books = fit(vectors, vec_id, vector)
    if books is None:
        packed = F.struct(*[_name(c).alias(c) for c in columns]).alias("row")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]
        return vectors.limit(0).select(packed, *none)
    spark = vectors.sparkSession
    coded = encode(vectors, books, list(dict.fromkeys([*columns, label]))).withColumn("label", F.col("row").getField(label))
    path = write_table(coded, "vector-codes")
    coded = read_table_of(spark, path, coded.schema)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    row = F.struct(*[F.col("row").getField(c).alias(c) for c in columns]).alias("row")
    return joined.select(row, "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
