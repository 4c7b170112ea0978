"""Benchmark decontamination with a generalised suffix automaton of test items.

Texts are word sequences: A-Z lower-cased, words of letters, digits and all
non-ASCII characters.  A window is ``WINDOW`` consecutive words of a test item,
or a whole shorter item.  Document words inside any occurrence of a window
are hit, and a document is contaminated when it has hits and they are at
least ``1 / COVERAGE`` of its words.

The items become one suffix automaton over words (``MAX_WORDS`` words at most;
a larger benchmark makes several, used one after the other).  Training words
stream through it while the length of the longest match ending at each word
is tracked, so one step a word finds every window, however many items there
are.  Stretches that share no run of a few words with any item (a hashed
table says so, for a whole block at once) are skipped: nothing in them can be
as long as a window.

Null and empty texts have no words, an empty benchmark or item hits nothing,
and repeated items each count.  Each row is treated by itself, in constant
memory beyond its own words; extra columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlane.llm import text as tx

WINDOW = 13
COVERAGE = 20
MAX_WORDS = 50_000  # item words in one automaton (tens of MB in a task)
SHORT_RUN = 4  # words in a row that a stretch must share with an item
TABLE_BITS = 20


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with what each state tells
    about windows.  ``next[s]`` maps a word to a state; ``longest[s]`` is the
    length of the longest string of state ``s`` and ``link[s]`` its suffix
    state, whose strings are all shorter."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.window = window
        ends: list[tuple[int, int]] = []  # (state of a prefix, item)
        whole: list[tuple[int, int]] = []  # (state of an item shorter than a window, item)
        for number, (_, words) in enumerate(items):
            last = 0
            for word in words:
                last = self._extend(last, word)
                ends.append((last, number))
            if 0 < len(words) < window:
                whole.append((last, number))
        self.items: list[set[int]] = [set() for _ in self.next]  # items with the window-long string of a state
        self.short: list[tuple[int, set[int]]] = [(0, set())] * len(self.next)  # whole short items that end here
        for state, number in ends:  # a prefix's windows are suffixes of it: climb to the state that holds one
            while self.longest[self.link[state]] >= window:
                state = self.link[state]
            if self.longest[state] >= window:
                self.items[state].add(number)
        for state, number in whole:
            self.short[state] = (len(items[number][1]), self.short[state][1] | {number})
        self.names = [name for name, _ in items]
        self.has_short = bool(whole)

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.longest[known] == self.longest[last] + 1 else self._split(last, word, known)
        state = self._state({}, self.longest[last] + 1)
        while last != -1 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last != -1:
            known = self.next[last][word]
            self.link[state] = known if self.longest[known] == self.longest[last] + 1 else self._split(last, word, known)
        else:
            self.link[state] = 0
        return state

    def _split(self, last: int, word: int, state: int) -> int:
        """Give the shorter strings of ``state``, up to ``last + word``, their own state."""
        part = self._state(dict(self.next[state]), self.longest[last] + 1)
        self.link[part], self.link[state] = self.link[state], part
        while last != -1 and self.next[last].get(word) == state:
            self.next[last][word] = part
            last = self.link[last]
        return part

    def _state(self, moves: dict[int, int], longest: int) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.longest.append(longest)
        return len(self.next) - 1

    def scan(self, words: list[int], hit: np.ndarray, at: int, found: set[int]) -> None:
        """Stream ``words``; mark ``hit[at:]`` and collect the items found."""
        state, length, window = 0, 0, self.window
        for i, word in enumerate(words, at + 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.longest[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length >= window:
                hit[i - length : i] = True
                s = state
                while self.longest[self.link[s]] >= window:
                    s = self.link[s]
                found |= self.items[s]
            if self.has_short and state:
                s, most = state, length
                while s > 0:
                    size, numbers = self.short[s]
                    if numbers and size <= most:
                        hit[i - size : i] = True
                        found |= numbers
                    s = self.link[s]
                    most = self.longest[s]


class Scanner:
    """An automaton with the vocabulary and the table that skips stretches."""

    def __init__(self, items: list[tuple[str, str]]):
        hashed = [(name, _words(text)) for name, text in items]
        hashed = [(name, h) for name, h in hashed if len(h)]
        vocabulary = np.unique(np.concatenate([h for _, h in hashed] or [np.zeros(0, np.uint64)]))
        self.number = {int(h): i for i, h in enumerate(vocabulary)}
        self.automaton = SuffixAutomaton([(name, [self.number[int(x)] for x in h]) for name, h in hashed])
        self.least = min([len(h) for _, h in hashed] + [WINDOW])
        self.run = min(SHORT_RUN, self.least)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        for _, h in hashed:
            self.table[_slots(tx.rolling(h, self.run))] = True

    def hits(self, words: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Hit flags and items of one document; ``known[i]``: a run of item
        words may start at ``i``."""
        hit, found = np.zeros(len(words), bool), set()
        at = np.flatnonzero(known)
        if len(at):
            gaps = np.flatnonzero(np.diff(at) > 1)
            for a, b in zip(at[np.r_[0, gaps + 1]], at[np.r_[gaps, len(at) - 1]] + self.run, strict=True):
                if b - a >= self.least:
                    self.automaton.scan([self.number.get(int(x), -1) for x in words[a:b]], hit, int(a), found)
        return hit, found


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)


def _words(text: str) -> np.ndarray:
    parts = [h for _, _, _, h, _, _ in tx.word_blocks(pa.array([text], pa.large_string()), tx.ALNUM)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _blocks(benchmark: DataFrame) -> list[list[tuple[str, str]]]:
    """Items in blocks of at most ``MAX_WORDS`` words (or one longer item)."""
    out: list[list[tuple[str, str]]] = [[]]
    total = 0
    texts = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").filter("text IS NOT NULL")
    for name, text in texts.toLocalIterator():
        size = len(text) // 2 + 1  # no more words than this
        if out[-1] and total + size > MAX_WORDS:
            out.append([])
            total = 0
        out[-1].append((name, text))
        total += size
    return out


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns as ``row``; ``n_words``, ``n_hit``, ``items`` (sorted
    ids of the items found), ``spans`` (hit byte ranges of the text) and
    ``contaminated``."""
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(block) for block in _blocks(benchmark)]
    several = len(shared) > 1

    def make():
        held = [] if several else [Scanner(shared[0].value)]

        def work(texts: pa.Array) -> list[pa.Array]:
            n = len(texts)
            counts, hits = np.zeros(n, np.int64), np.zeros(n, np.int64)
            items: list[set[str]] = [set() for _ in range(n)]
            flags: dict[int, np.ndarray] = {}
            spans: list[list[dict[str, int]]] = [[] for _ in range(n)]
            for scanner in held or (Scanner(block.value) for block in shared):
                for lo, hi, first, words, _, _ in tx.word_blocks(texts, tx.ALNUM):
                    counts[lo:hi] = np.diff(first)
                    known = scanner.table[_slots(tx.rolling(words, scanner.run))]
                    busy = np.flatnonzero(np.add.reduceat(np.r_[known, np.zeros(len(words) - len(known) + 1, bool)], first[:-1])) if len(words) else []
                    for k in busy:
                        a, b = int(first[k]), int(first[k + 1])
                        if b - a < scanner.run:
                            continue
                        hit, found = scanner.hits(words[a:b], known[a : b - scanner.run + 1])
                        if found:
                            flags[lo + k] = flags.get(lo + k, False) | hit
                            items[lo + k] |= {scanner.automaton.names[i] for i in found}
            for lo, hi, first, words, starts, ends in tx.word_blocks(texts, tx.ALNUM) if flags else ():
                offsets = None
                for k in range(lo, hi):
                    if k not in flags:
                        continue
                    if offsets is None:
                        offsets = tx.byte_view(texts)[1]
                    hit = flags[k]
                    hits[k] = hit.sum()
                    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                    begin = int(offsets[k] - offsets[lo])
                    a = int(first[k - lo])
                    spans[k] = [{"start": int(starts[a + s]) - begin, "end": int(ends[a + e - 1]) - begin} for s, e in zip(edges[::2], edges[1::2], strict=True)]
            return [
                pa.array(counts),
                pa.array(hits),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array((hits > 0) & (COVERAGE * hits >= counts)),
            ]

        return work

    schema = "n_words long, n_hit long, items array<string>, spans array<struct<start: bigint, `end`: bigint>>, contaminated boolean"
    return tx.annotate(docs, make, schema, keep)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated documents (hits over the coverage
    limit); hit spans (over the length limit) are cut out of the others."""
    done = scan(docs, benchmark).filter("NOT contaminated")
    raw = F.col("row.text").cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length("row.text").cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(raw, a.cast("int") + 1, (b - a).cast("int")).cast("string"))
    text = F.when(F.col("n_hit") > 0, F.concat_ws("", pieces)).otherwise(F.col("row.text"))
    columns = []
    for name, kind in docs.dtypes:
        value = F.col("row").getField(name)
        if name == "text":
            value = text
        elif name == "n_chars":
            value = F.when(F.col("n_hit") > 0, F.char_length(text)).otherwise(value).cast(kind)
        columns.append(value.alias(name))
    return done.select(*columns)
