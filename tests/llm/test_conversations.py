"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from starlane.llm import conversations as cv
from starlane.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """Symbol numbers of rows ``(role, text)``, and the counts."""
    seen, out, counts = set(), [], [0, 0, 0, 0]
    for k, (role, text) in enumerate(rows):
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        if k and rows[k - 1][0][:1] + role[:1] not in ("su", "ua", "au"):
            counts[3] += 1
        if not solid:
            out.append("gone")
            counts[0] += 1
        elif (role, text) in seen:
            out.append("gone")
            counts[1] += 1
        elif solid[-1] not in ".!?":
            out.append("cut")
            counts[2] += 1
        else:
            out.append("")
        seen.add((role, text))
    return out, counts


def brute_audit(rows):
    """Least cost and the first of the cheapest audits, row by row: the best
    way to every string that the grammar can be in, kept as whole strings."""
    fault, _ = faults(rows)
    short = ("", "s", "u", "ua")  # strings that can go on in the same ways
    place = lambda said: 0 if not said else 1 if said == "s" else 2 if said[-1] == "u" else 3
    start = {0: (0, "", "", ())}

    def inserted(ways):
        ways = dict(ways)
        for _ in range(3):
            for cost, audit, said, out in list(ways.values()):
                role = "assistant" if said[-1:] == "u" else "user"
                k = place(said + role[0])
                new = (cost + 5, audit + "I", short[k], (*out, (role, "")))
                if k not in ways or new[:2] < ways[k][:2]:
                    ways[k] = new
        return ways

    ways = start
    for (role, text), bad in zip(rows, fault, strict=True):
        after = {}
        for cost, audit, said, out in inserted(ways).values():
            tries = [(cost + 2, audit + "D", said, out)]
            if bad != "gone":
                more = 5 if bad == "cut" else 0
                tries.append((cost + more, audit + "K", said + (role[:1] or "?"), (*out, (role, text))))
                tries += [(cost + more + 1, audit + "R", said + r[0], (*out, (r, text))) for r in ("user", "assistant")]
            for new in tries:
                said = new[2]
                if any(GOOD.fullmatch(said + end) for end in ("", "a", "ua")):
                    k = place(said)
                    new = (*new[:2], short[k], new[3])
                    if k not in after or new[:2] < after[k][:2]:
                        after[k] = new
        ways = after
    cost, audit, _, out = min((w for k, w in inserted(ways).items() if k in (0, 3)), key=lambda w: w[:2])
    return cost, audit, out


def brute_all(rows):
    """The same by trying every string of edits (few rows)."""
    fault, _ = faults(rows)
    best = None
    for letters in itertools.chain.from_iterable(itertools.product("DIKR", repeat=n) for n in range(len(rows) + 4)):
        if sum(x != "I" for x in letters) != len(rows):
            continue
        for roles in itertools.product("ua", repeat=sum(x in "IR" for x in letters)):
            chosen, at, cost, said = iter(roles), 0, 0, ""
            for x in letters:
                if x == "I":
                    cost, said = cost + 5, said + next(chosen)
                    continue
                bad, role = fault[at], rows[at][0]
                at += 1
                if x == "D":
                    cost += 2
                elif bad == "gone":
                    cost += 1000
                else:
                    cost += (5 if bad == "cut" else 0) + (x == "R")
                    said += (role[:1] or "?") if x == "K" else next(chosen)
            if cost < 1000 and GOOD.fullmatch(said) and (best is None or (cost, "".join(letters)) < best):
                best = cost, "".join(letters)
    return best


ROWS = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["a.", "b?", "c", " ", "d!", "e\t."]))


@given(st.lists(ROWS, max_size=4))
@settings(max_examples=60, deadline=None)
def test_plain_twin_against_all_strings(rows):
    assert brute_audit(rows)[:2] == brute_all(rows)


def symbols(rows):
    number = {"s": 0, "u": 1, "a": 2}
    return bytes(cv.GONE if f == "gone" else number.get(r[:1], 3) + (4 if f == "cut" else 0) for (r, _), f in zip(rows, faults(rows)[0], strict=True))


@given(st.lists(st.tuples(ROWS, st.integers(1, 40)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_runs_against_plain_twin(runs):
    rows = [(role, f"{k}.{j} {text}" if text.strip() else text) for k, ((role, text), n) in enumerate(runs) for j in range(n)]
    assert cv.solve(symbols(rows)) == brute_audit(rows)[:2]


def test_powers_are_products():
    for symbol in range(9):
        row = (0, 3, 7, 1)
        for n in (1, 5, 13, 32):
            slow = row
            for _ in range(n):
                slow = cv.costs_before(symbol, 1, slow)
            assert cv.costs_before(symbol, n, row) == slow


def brute(table):
    """Expected result of the query from ``conv_id, turn, role, text`` tuples."""
    told = lambda v: " " if v is None else str(v)
    by = {}
    for conv, turn, role, text in table:
        rows = by.setdefault(conv, [])
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in by.items():
        md5 = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r)))
        turns = {t for t, _, _ in rows if t is not None}
        said = [r[1:] for r in rows]
        cost, audit, fixed = brute_audit(said)
        _, counts = faults(said)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_repair"](spark, SF)
    assert result(got) == brute(rows)
    assert got.count() == len({r[0] for r in rows})


def test_nulls_ties_repeats_and_long_conversations(spark):
    rows = [(None, 0, "user", "Hello."), (None, None, "assistant", "Early!"), (1, None, None, None), (1, None, "user", "x"), (2, 0, "tool", "y.")]
    rows += [(3, 5, "user", "same."), (3, 5, "user", "same."), (3, 5, "assistant", "other."), (3, 9, "user", "same.")]
    rows += [(4, t, ["user", "assistant", "user"][t % 3], f"row {t}" + ".?! "[t % 4]) for t in range(3000)]
    rows += [(5, t, "user", "again and again.") for t in range(500)]
    rows += [(6, t, "user", "long. " * 200_000) for t in range(3)]
    dropped = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "gone.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("a.b", cv.F.lit(1)).repartition(7)
    got = result(cv.repair(cv.damage(table)))
    assert got == brute(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Yes."), (1, 2, "user", " "), (2, 0, "user", "Only.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copy", cv.F.lit(0))
    done = cv.repaired(table).orderBy("conv_id", "place").collect()
    plans = {r.conv_id: r.audit for r in cv.repair(table).collect()}
    for conv, audit in plans.items():
        mine = [r for r in done if r.conv_id == conv]
        assert "".join(r.edit for r in mine) == audit and [r.place for r in mine] == list(range(len(audit)))
        assert GOOD.fullmatch("".join(r.role[0] for r in mine if r.edit != "D"))


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert cv.repair(cv.damage(table)).collect() == [] and cv.repaired(cv.damage(table)).collect() == []
