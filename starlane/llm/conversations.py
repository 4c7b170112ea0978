"""Conversation structure repair: a run-length min-plus programme.

A conversation is rows of ``conv_id, turn, role, text``, read by turn.  A row may
be blank, a duplicate of an earlier one, or truncated.  Repair keeps, re-roles
or deletes rows and inserts empty ones so that the role initials read
``(s?(ua)+)?``, at the least cost.

Every row is a symbol (its role initial, and whether it must go or lacks its
end).  Four states say what has been kept so far; a symbol is a 4 x 4 matrix
of least costs from state to state, in which "plus" is the minimum and "times"
the sum.  Equal consecutive symbols are one run, and a run of n is passed by the
cached binary powers of its matrix, so its cost takes log n products.  Costs are
taken from the end backwards; choices are then unrolled forwards, a run being
halved by the same powers until it is short.  At each choice the letter
that is first in ASCII of those on a cheapest way is taken, which gives the
least of all cheapest audits, since a letter decides where it leads.

On Spark: faults that a row shows by itself are expressions.  Duplicates are
found from a digest of role and text: the first place of each digest in its
conversation is aggregated before it is shuffled, and joined to the digests
again.  Narrow rows (no texts) are then sorted by conversation, and a task reads
them as a stream, holding a byte a row of one conversation at a time.  Its plan
is sorted in front of the texts, which are shuffled once, and a second
stream writes the repaired rows: no conversation is ever held as a whole.
A digest of a whole conversation and its audit (one string) are sequential by
nature; all else is split.

Defined results: null values count as one space (a null turn stays null
and is first; a null ``conv_id`` is a conversation of its own).  Rows of one turn are ordered by role, then by the
digest of role and text.  Roles whose first letter is not s, u or a can
only be re-roled or deleted.  An empty table gives no rows; a
conversation none of whose rows are left has zeros, an empty audit and the
digest of the empty string.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema as _arrow

from starlane.llm.text import ROWS

SPACE = r"[\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5  # costs; CUT: a truncated row that stays
SHORT_RUN = 16  # rows of a run that are unrolled one by one
MEMO = 50_000  # symbol strings of up to MEMO_ROWS rows whose audit a task remembers
MEMO_ROWS = 64

#: States: nothing yet, after the system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a user or assistant row leads to; only one of both fits each state.
NEXT = (USER, USER, ASSISTANT, USER)
NEXT_ROLE = ("user", "user", "assistant", "user")
#: Cost of ending in each state: what is missing is inserted.
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60

#: A symbol is ``initial + 4 * fault``; GONE is a row that must go.
INITIALS = "sua"
OTHER, SOUND, CUT_OFF = 3, 0, 4
GONE = 8


def _kept_state(symbol: int, state: int) -> int | None:
    """Where keeping a row of the symbol leads."""
    initial = symbol % 4
    if symbol == GONE or initial == OTHER:
        return None
    if initial == 0:
        return SYSTEM if state == NOTHING else None
    return NEXT[state] if (initial == 2) == (state == USER) else None


Matrix = tuple[tuple[int, ...], ...]


def _choices(symbol: int, state: int) -> Iterator[tuple[str, int, int, bool]]:
    """Edits of a row, in ASCII order: letter, cost, next state, whether the row is used up."""
    yield "D", DELETE, state, True
    yield "I", INSERT, NEXT[state], False
    if symbol != GONE:
        more = CUT if symbol >= CUT_OFF else 0
        kept = _kept_state(symbol, state)
        if kept is not None:
            yield "K", KEEP + more, kept, True
        yield "R", REROLE + more, NEXT[state], True


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(x + y for x, y in zip(row, column, strict=True)) for column in zip(*b, strict=True)) for row in a)


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """Least costs from state to state over ``2 ** k`` rows of a symbol."""
    if k:
        half = power(symbol, k - 1)
        return _product(half, half)
    insert = [[0 if i == j else NEVER for j in range(4)] for i in range(4)]
    edit = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        at = state
        for steps in (1, 2, 3):  # three insertions lead back to where one did
            at = NEXT[at]
            insert[state][at] = min(insert[state][at], steps * INSERT)
        for _, cost, to, used in _choices(symbol, state):
            if used:
                edit[state][to] = min(edit[state][to], cost)
    return _product(tuple(map(tuple, insert)), tuple(map(tuple, edit)))


def costs_before(symbol: int, n: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs to the end before a run of ``n``, from those after it."""
    k = 0
    while n >> k:
        if n >> k & 1:
            after = tuple(min(x + y for x, y in zip(row, after, strict=True)) for row in power(symbol, k))
        k += 1
    return after


def _unroll(symbol: int, n: int, state: int, after: tuple[int, ...], out: list[str]) -> int:
    """Append the edits of a run to ``out``; the state after it."""
    if n > SHORT_RUN:
        first = n // 2
        middle = costs_before(symbol, n - first, after)
        return _unroll(symbol, n - first, _unroll(symbol, first, state, middle, out), after, out)
    left = [after]
    for _ in range(n):
        left.append(costs_before(symbol, 1, left[-1]))
    for k in range(n, 0, -1):
        used = False
        while not used:
            for letter, cost, to, used in _choices(symbol, state):
                if left[k][state] == cost + left[k - 1 if used else k][to]:
                    break
            else:
                raise AssertionError("no edit is on a cheapest way")
            out.append(letter)
            state = to
    return state


def solve(symbols: bytes) -> tuple[int, str]:
    """Least cost of a conversation and the first of its cheapest audits."""
    runs = [(s, sum(1 for _ in same)) for s, same in groupby(symbols)]
    after = [END]
    for symbol, n in reversed(runs):
        after.append(costs_before(symbol, n, after[-1]))
    after.reverse()
    state, out = NOTHING, []
    for (symbol, n), rest in zip(runs, after[1:], strict=True):
        state = _unroll(symbol, n, state, rest, out)
    return after[0][NOTHING], "".join(out) + "I" * (END[state] // INSERT)


def damage(rows: DataFrame) -> DataFrame:
    """The rows as the contract of the query damages them: ``copy`` is 0 or, for
    the repetition of a row, 1; a dropped row stays with a null ``text``."""
    space = F.lit(" ")
    told = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    some = rows.select("conv_id", "turn", kind.alias("kind"), told("role").alias("role"), told("text").alias("text"))
    text = (
        F.when(F.col("kind") == 0, F.lit(None).cast("string"))
        .when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return some.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


ORDER = ["turn", "role", "digest", "copy"]
PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _initial() -> Column:
    return F.coalesce(*[F.when(F.substring("role", 1, 1) == c, k) for k, c in enumerate(INITIALS)], F.lit(OTHER))


def _symbol() -> Column:
    """The symbol of a row by itself: its initial, and whether it is blank or cut off."""
    number = _initial()
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?]" + SPACE + r"*\z")
    return F.when(blank, GONE).when(ended, number).otherwise(number + CUT_OFF)


def _same(before: tuple | None, conv) -> bool:
    return before is not None and before[0] == conv


class _Plan:
    """Counts and symbols of the conversation that a stream is in."""

    def __init__(self) -> None:
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = None
        self.turns = 0
        self.last, self.digest = -1, None

    def add(self, turn: int | None, symbol: int, initial: int, digest: bytes, first: bool) -> None:
        first = first and digest != self.digest  # repeated rows of the table are all first, and adjacent
        self.digest = digest
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        if self.last >= 0 and (self.last, initial) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.last = initial
        if symbol == GONE:
            self.blank += 1
        elif not first:
            self.duplicate += 1
            symbol = GONE
        elif symbol >= CUT_OFF:
            self.truncated += 1
        self.symbols.append(symbol)

    def values(self, solved: Callable[[bytes], tuple[int, str]]) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        cost, audit = solved(bytes(self.symbols))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


OUT_ROWS, OUT_CHARS = 2000, 1 << 22


def _slices(batches) -> Iterator[Iterator[tuple]]:
    """The rows of Arrow batches, a thousand at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True)


def _stream(schema: pa.Schema, begin: Callable, add: Callable, end: Callable):
    """A task over rows sorted by conversation (first column): ``begin`` makes
    a state, ``add`` takes a row, ``end`` gives the values of the result."""

    def run(batches):
        at, state, out, chars = None, None, [], 0
        for some in _slices(batches):
            for row in some:
                if not _same(at, row[0]):
                    if at is not None:
                        out.append((at[0], *end(state)))
                        chars += sum(len(v) for v in out[-1] if isinstance(v, str))
                    at, state = (row[0],), begin()
                    if len(out) >= OUT_ROWS or chars >= OUT_CHARS:
                        yield _batch(out, schema)
                        out, chars = [], 0
                add(state, row)
        if at is not None:
            out.append((at[0], *end(state)))
        if out:
            yield _batch(out, schema)

    return run


def plans(marked: DataFrame) -> DataFrame:
    """``conv_id`` and the plan of each conversation (``PLAN``) from ``marked`` rows."""
    left = F.col("symbol").isNotNull()
    firsts = marked.filter(left).groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("same")).agg(
        F.min(F.struct(*[c for c in ORDER if c != "digest"])).alias("first")
    )
    here = F.struct(*[c for c in ORDER if c != "digest"])
    joined = marked.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & F.col("digest").eqNullSafe(F.col("same")), "left")
    narrow = joined.select("conv_id", *ORDER, "symbol", "initial", here.eqNullSafe(F.col("first")).alias("is_first"))
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    ordered = ordered.select("conv_id", "turn", "symbol", "initial", "digest", "is_first")
    schema = T.StructType([marked.schema["conv_id"], *T._parse_datatype_string(PLAN).fields])

    def run(batches):
        known = lru_cache(maxsize=MEMO)(solve)
        solved = lambda symbols: known(symbols) if len(symbols) <= MEMO_ROWS else solve(symbols)
        add = lambda state, row: None if row[2] is None else state.add(*row[1:])
        yield from _stream(_arrow(schema), _Plan, add, lambda state: state.values(solved))(batches)

    return ordered.mapInArrow(run, schema)


class _Editor:
    """Follows an audit over the rows of a conversation."""

    def __init__(self) -> None:
        self.plan, self.at, self.state = None, 0, NOTHING
        self.rows = 0

    def _edit(self, letter: str, role: str, text: str) -> tuple[str, str, str]:
        self.at += 1
        if letter == "K":
            self.state = SYSTEM if role[:1] == "s" else NEXT[self.state]
        elif letter != "D":
            role, self.state = NEXT_ROLE[self.state], NEXT[self.state]
        self.rows += 1
        return letter, role, text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """Rows that the audit inserts here."""
        while self.plan["audit"][self.at : self.at + 1] == "I":
            yield self._edit("I", "", "")

    def edits(self, row: tuple) -> Iterator[tuple[str, str, str]]:
        """Letter, role and text of a row, and of those inserted before it."""
        _, plan, role, text = row
        if plan is not None:
            self.plan = plan
        elif text is not None:
            yield from self.inserted()
            yield self._edit(self.plan["audit"][self.at], role, text)


class _Digest(_Editor):
    def __init__(self) -> None:
        super().__init__()
        self.hash, self.begun = hashlib.sha256(), False

    def write(self, edits: Iterator[tuple[str, str, str]]) -> None:
        for letter, role, text in edits:
            if letter != "D":
                self.hash.update((("\n" if self.begun else "") + role + ":").encode())
                self.hash.update(text.encode())
                self.begun = True

    def add(self, row: tuple) -> None:
        self.write(self.edits(row))

    def values(self) -> tuple:
        self.write(self.inserted())
        return *self.plan.values(), self.hash.hexdigest()


def _with_plans(rows: DataFrame) -> tuple[DataFrame, T.StructType]:
    """Plans and, after each, the rows of its conversation in order, in one
    partition: ``conv_id, plan, role, text``; and the schema of the plans."""
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    full = rows.select("conv_id", "turn", "role", "copy", "text", digest.alias("digest"))
    left = F.col("text").isNotNull()
    planned = plans(full.select("conv_id", *ORDER, F.when(left, _symbol()).alias("symbol"), _initial().alias("initial")))
    plan_type = T.StructType(planned.schema.fields[1:])
    first = planned.select("conv_id", F.struct(*planned.columns[1:]).alias("plan"), F.lit(0).alias("late"))
    for c in [*ORDER, "text"]:
        first = first.withColumn(c, F.lit(None).cast(full.schema[c].dataType))
    later = full.filter(left).withColumn("plan", F.lit(None).cast(plan_type)).withColumn("late", F.lit(1))
    both = first.unionByName(later).repartition("conv_id").sortWithinPartitions("conv_id", "late", *ORDER)
    return both.select("conv_id", "plan", "role", "text"), planned.schema


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id``, the counts, ``cost``, ``audit`` and ``repaired_sha256`` of each
    conversation of ``rows(conv_id, turn, role, text, copy)``, as ``damage``
    makes them (rows of null text are gone, but their conversation is told)."""
    both, planned = _with_plans(rows)
    schema = T.StructType([*planned.fields, T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        yield from _stream(_arrow(schema), _Digest, _Digest.add, _Digest.values)(batches)

    return both.mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired rows themselves: ``conv_id``, ``place`` (from 0, with the
    deleted rows), ``edit`` (its letter), ``role`` and ``text``."""
    both, planned = _with_plans(rows)
    schema = T.StructType([planned["conv_id"], *T._parse_datatype_string("place long, edit string, role string, text string").fields])

    def run(batches):
        at, editor, arrow = None, None, _arrow(schema)

        def told(edits):
            return [(at[0], editor.rows - 1, *edit) for edit in edits]

        for some in _slices(batches):
            out = []
            for row in some:
                if not _same(at, row[0]):
                    out += told(editor.inserted()) if editor else []
                    at, editor = (row[0],), _Editor()
                out += told(editor.edits(row))
            yield _batch(out, arrow)
        if editor:
            yield _batch(told(editor.inserted()), arrow)

    return both.mapInArrow(run, schema)
