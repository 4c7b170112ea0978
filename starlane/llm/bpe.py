"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

1. The pieces (pre-tokens) of all documents are counted; the
   most frequent, ``LEXICON`` at most, come to one task.  The lexicon only
   saves work: which words it holds changes no id.
2. They are merged exactly and compiled into a minimal acyclic automaton over
   their bytes, in which equal suffixes share states.  Arcs carry outputs
   whose sum along a word is the word's number, which names its ids.  The
   arrays, and a bitmap that turns most other pieces away, go into one file that every executor gets and maps into memory.
3. Texts are cut into pieces; a piece is read through the automaton, and one
   that it does not hold is merged exactly (lowest rank first, leftmost on
   ties, with a heap, so that a very long piece is no problem).  A bounded
   memo keeps results during a task.

Decoding joins the bytes of the ids and reads them as UTF-8, replacing what
is not valid, as byte-level decoders do.  Added tokens of the file (such as an
end-of-text mark) are cut out of the text before it is split into pieces.

Null and empty texts have no ids.  Each row is treated by itself, so ties,
repeated rows and extra columns change nothing.  The vocabulary file is a
parameter and is read on the driver only.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import unicodedata
import uuid
from collections import Counter
from itertools import chain
from operator import itemgetter
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlane.llm import text as tx
from starlane.session import read_table_of, remove_path, write_file, write_table

LEXICON = 400_000  # words compiled into the automaton, at most
LARGEST = 1 << 20  # beyond the steps of any count
FILTER_BITS = 23  # size of the bitmap that tells most other pieces apart
RARE = 20_000  # pieces outside the lexicon that a task remembers
SHORT = 64  # bytes of a piece that is merged without a heap
FLUSH = 300_000  # distinct pieces a task counts before it hands them on

# Code points that Unicode 16 added, as the public tokenizers
# class them; the rest follows from the general category.
_NEW_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 "
    "113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
)
_NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
_SPACES = "9-D 20 85 A0 1680 2000-200A 2028-2029 202F 205F 3000"


def _class(kind: str, more: str, top: int) -> str:
    """Body of a character class: a general category and more ranges."""
    flags = np.zeros(top + 1, bool)
    for part in more.split():
        a, _, b = part.partition("-")
        flags[int(a, 16) : int(b or a, 16) + 1] = True
    if kind:
        flags[:top] |= [unicodedata.category(chr(c))[0] == kind for c in range(top)]
    flags[top] = False
    edges = np.flatnonzero(np.diff(np.r_[False, flags].astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


def _pattern(top: int) -> re.Pattern[str]:
    letter, number, space = _class("L", _NEW_LETTERS, top), _class("N", _NEW_NUMBERS, top), _class("", _SPACES, top)
    return re.compile(
        f" ?[{letter}]++|'(?:[smtd]|re|ve|ll)| ?[{number}]++| ?[^{space}{letter}{number}]++|[{space}]+(?![^{space}])|[{space}]+"
    )


class Pieces:
    """Cuts a text into pieces; texts within Latin-1 use a smaller pattern."""

    def __init__(self) -> None:
        self.latin, self.full = _pattern(0x100).findall, None

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.full is None:
                self.full = _pattern(0x110000).findall
            return self.full(text)
        return self.latin(text)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file, as plain tables."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        symbols = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.bytes = {i: bytes(symbols[c] for c in token) for token, i in vocab.items()}
        self.single = [0] * 256
        for char, b in symbols.items():
            self.single[b] = vocab[char]
        self.pairs: dict[tuple[int, int], int] = {}  # rank of a pair
        self.joined: list[int] = []  # id that the merge of each rank makes
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((vocab[a], vocab[b]), rank)
            self.joined.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: repeatedly join the adjacent pair of lowest rank,
        the leftmost of equal ones."""
        if len(piece) > SHORT:
            return self._merge_long(piece)
        ids, get, none = [self.single[b] for b in piece], self.pairs.get, 1 << 30
        found = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            ids[i] = self.joined[best]
            del ids[i + 1], found[i]
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for a long piece, with a heap of pairs and linked places."""
        ids = [self.single[b] for b in piece]
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        pairs = self.pairs
        heap = [(pairs[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != pair[0] or ids[j] != pair[1]:
                continue  # one of the two has been joined meanwhile
            joined = self.joined[rank]
            ids[i], ids[j] = joined, -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (right := (joined, ids[k])) in pairs:
                    heapq.heappush(heap, (pairs[right], i, right))
            if (h := before[i]) >= 0 and (left := (ids[h], joined)) in pairs:
                heapq.heappush(heap, (pairs[left], h, left))
        return [x for x in ids if x >= 0]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic transducer of the words, as one block of arrays.

    Words are added in order; once a branch cannot grow any more its states
    are replaced by equal ones met before, from the ends backwards, so all
    common suffixes are shared.  The output of an arc is the number of words
    that pass earlier from its state: the outputs along a word add up to its
    place in the sorted list.
    """
    ordered = sorted(words)
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    register: dict[tuple[bool, tuple[tuple[int, int], ...]], int] = {}

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open states: is a word's end, arcs so far
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))

    for word in ordered:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared)
        path.extend([False, []] for _ in range(len(word) - shared))
        path[-1][0] = True
        last = word
    close(0)
    root = settle(path[0])

    size = [0] * len(states)  # words that can be read from a state; arcs lead to earlier states
    first, labels, targets, outputs = [0], bytearray(), [], []
    for s, (end, arcs) in enumerate(states):
        total = int(end)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            outputs.append(total)
            total += size[target]
        size[s] = total
        first.append(len(labels))
    ids = [words[w] for w in ordered]
    marks = np.zeros(1 << FILTER_BITS, bool)
    marks[[crc32(w) >> (32 - FILTER_BITS) for w in ordered]] = True
    arrays = [
        np.array([root], np.int32),
        np.array(first, np.int32),
        np.array([end for end, _ in states], np.uint8),
        np.frombuffer(bytes(labels), np.uint8),
        np.array(targets, np.int32),
        np.array(outputs, np.int32),
        np.cumsum([0, *map(len, ids)]).astype(np.int32),
        np.array(list(chain.from_iterable(ids)), np.int32),
        np.packbits(marks, bitorder="little"),
    ]
    head, body, at = [], [], 8 * (2 * len(arrays) + 1)
    for a in arrays:
        raw = a.tobytes()
        head += [at, len(raw)]
        body.append(raw + bytes(-len(raw) % 8))
        at += len(body[-1])
    return np.array([len(arrays), *head], np.int64).tobytes() + b"".join(body)


class Lexicon:
    """A compiled lexicon, read where it is mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        count = view[:8].cast("q")[0]
        head = view[8 : 8 * (2 * count + 1)].cast("q")
        part = [view[head[2 * i] : head[2 * i] + head[2 * i + 1]] for i in range(count)]
        self.root = part[0].cast("i")[0]
        self.first, self.end = part[1].cast("i"), part[2]
        self.base = head[6]  # where the labels begin in the file
        self.target, self.output, self.place, self.ids = (p.cast("i") for p in part[4:8])
        self.marks = part[8]

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None."""
        mark = crc32(word) >> (32 - FILTER_BITS)
        if not self.marks[mark >> 3] >> (mark & 7) & 1:
            return None
        state, number, base, find, first = self.root, 0, self.base, self.map.find, self.first
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            number += self.output[arc]
            state = self.target[arc]
        if not self.end[state]:
            return None
        return self.ids[self.place[number] : self.place[number + 1]].tolist()


class Memo(dict):
    """Ids of the lexicon words met, and apart from them of a few other pieces met
    last; a piece that neither holds is looked up in the lexicon, or else merged.  With ``as_text`` an entry is what a digest needs of the ids:
    their number, the ids in decimal and the bytes that they decode to."""

    def __init__(self, merges: Merges, lexicon: Lexicon, as_text: bool = False):
        self.merges, self.lexicon, self.as_text = merges, lexicon, as_text
        self.rare: dict[str, object] = {}

    def entry(self, ids: list[int]):
        if self.as_text:
            return len(ids), ",".join(map(str, ids)), b"".join(map(self.merges.bytes.__getitem__, ids))
        return ids

    def __missing__(self, piece: str):
        found = self.rare.get(piece)
        if found is None:
            raw = piece.encode()
            ids = self.lexicon.get(raw)
            if ids is not None:
                found = self[piece] = self.entry(ids)
            else:
                found = self.entry(self.merges.merge(raw))
                if len(raw) <= 64:
                    if len(self.rare) >= RARE:
                        self.rare.clear()
                    self.rare[piece] = found
        return found


class Codec:
    """Encodes and decodes texts in one Python worker."""

    def __init__(self, merges: Merges, lexicon: Lexicon):
        self.merges, self.pieces = merges, Pieces()
        self.ids, self.texts = Memo(merges, lexicon), Memo(merges, lexicon, as_text=True)
        self.added = re.compile("|".join(map(re.escape, sorted(merges.added, key=len, reverse=True)))) if merges.added else None

    def _entries(self, text: str, memo: Memo) -> list:
        if not (self.added and self.added.search(text)):
            return list(map(memo.__getitem__, self.pieces(text)))
        out, at = [], 0
        for found in self.added.finditer(text):
            out += map(memo.__getitem__, self.pieces(text[at : found.start()]))
            out.append(memo.entry([self.merges.added[found[0]]]))
            at = found.end()
        return out + list(map(memo.__getitem__, self.pieces(text[at:])))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self._entries(text, self.ids)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.merges.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids and of the decoded text."""
        entries = self._entries(text, self.texts)
        coded = ",".join(map(itemgetter(1), entries)).encode()
        decoded = b"".join(map(itemgetter(2), entries)).decode("utf-8", "replace").encode()
        return sum(map(itemgetter(0), entries)), hashlib.sha256(coded).hexdigest(), hashlib.sha256(decoded).hexdigest()


def piece_counts(docs: DataFrame, merges_added: list[str]) -> DataFrame:
    """``piece, n``: how often each piece occurs in all texts."""

    def run(batches):
        pieces, counts = Pieces(), Counter()
        cut = re.compile("|".join(map(re.escape, merges_added))) if merges_added else None

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])
            counts.clear()
            return rows

        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                for part in cut.split(text) if cut else [text]:
                    counts.update(pieces(part))
                if len(counts) >= FLUSH:
                    yield flush()
        yield flush()

    seen = docs.select("text").filter("text IS NOT NULL").mapInArrow(run, "piece string, n long")
    return seen.filter(F.length("piece") <= 64).groupBy("piece").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, raw: str, words: int = LEXICON) -> str:
    """Compile the most frequent pieces of ``docs``; the name of the file that
    the executors get."""
    merges, spark = Merges(raw), docs.sparkSession
    counted = piece_counts(docs, list(merges.added))
    path = write_table(counted, "piece-counts")
    counts = read_table_of(spark, path, counted.schema)
    # The least count that no more than ``words`` pieces reach, in steps of a sixteenth
    # of an octave: one task compiles those pieces, however many others there are.
    step = F.floor(F.log2("n") * 16).cast("int")
    left, least = words, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, least = left - r["count"], r.step
    shared = spark.sparkContext.broadcast(raw)

    def compiled(batches):
        merges, frequent = Merges(shared.value), {}
        for batch in batches:
            for piece in batch.column(0):
                word = piece.as_py().encode()
                frequent[word] = merges.merge(word)
        yield pa.RecordBatch.from_arrays([pa.array([compile_lexicon(frequent)], pa.binary())], ["lexicon"])

    chosen = counts.filter(step >= (LARGEST if least is None else least)).select("piece")
    row = chosen.repartition(1).mapInArrow(compiled, "lexicon binary").first()  # ``words`` pieces at most
    remove_path(spark, path)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(write_file(spark, name, bytes(row.lexicon) if row else compile_lexicon({})))
    return name


_tables: dict[str, tuple[Merges, Lexicon]] = {}


def _codec(name: str, raw: str) -> Codec:
    """A codec for one task; a worker that serves several tasks keeps the
    tables, but not what a task remembered."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = Merges(raw), Lexicon(SparkFiles.get(name))
    return Codec(*_tables[name])


def read_vocabulary(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def encode_decode(docs: DataFrame, vocabulary: str, keep: list[str] | None = None, outputs: str = "full") -> DataFrame:
    """The kept columns as ``row``; with ``outputs="full"`` the ``ids`` of the
    text and the text ``decoded`` from them, with ``"digest"`` the number of
    ids and the SHA-256 of both (ids in decimal, joined by commas)."""
    spark: SparkSession = docs.sparkSession
    raw = read_vocabulary(vocabulary)
    name = build_lexicon(docs, raw)
    shared = spark.sparkContext.broadcast(raw)

    def make():
        codec = _codec(name, shared.value)

        def full(texts: pa.Array) -> list[pa.Array]:
            ids = [codec.encode(t.as_py() or "") for t in texts]
            return [pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())]

        def digest(texts: pa.Array) -> list[pa.Array]:
            sizes, coded, decoded = zip(*(codec.digest(t.as_py() or "") for t in texts), strict=True)
            return [pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]

        return full if outputs == "full" else digest

    schema = "ids array<int>, decoded string" if outputs == "full" else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return tx.annotate(docs, make, schema, keep)
