import tracemalloc

import numpy as np
import pyarrow as pa

from starlane.llm import decontaminate, ngram_join
from starlane.llm import text as tx

TEXTS = [" ".join(f"w{(7 * i + k) % 5000}" for k in range(400)) for i in range(4000)]  # about 8 MB


def peak_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_word_blocks_hold_little_beyond_the_texts():
    texts = pa.array(TEXTS[:1000])
    assert peak_mb(lambda: [len(words) for _, _, _, words, _, _ in tx.word_blocks(texts, tx.ALNUM)]) < 25


def test_words_do_not_depend_on_blocks():
    """Texts below, between and above the sizes at which blocks are cut, and a word longer than a block."""
    size = tx.BLOCK_BYTES
    texts = ["Short one", "ab " * (size // 4), "cd, " * (size // 2), "x" * (2 * size + 5) + " end", None, "Last words"]
    got = {}
    for lo, hi, first, words, _, _ in tx.word_blocks(pa.array(texts), tx.ALNUM):
        for k in range(hi - lo):
            got[lo + k] = words[first[k] : first[k + 1]].tolist()
    assert [len(got[i]) for i in range(6)] == [2, size // 4, size // 2, 2, 0, 2]
    assert len(set(got[1])) == len(set(got[2])) == 1
    assert got[5] == decontaminate._words("last WORDS").tolist()


def test_arrow_batches_are_bounded_by_bytes(spark):
    tx.ship_package(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").coalesce(1)
    got = rows.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == len(TEXTS)
    assert max(r.bytes for r in got) < 2.5e6


def test_a_smaller_batch_size_of_the_session_stays(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "300k")
        tx.ship_package(spark)
        assert spark.conf.get(name) == "300k"
    finally:
        spark.conf.set(name, before)


class Table:
    """Takes the place of a DataFrame to get at the function of a task."""

    def select(self, *columns):
        return self

    repartition = sortWithinPartitions = select

    def mapInArrow(self, run, schema):
        return run


def test_a_task_holds_the_postings_of_one_range(monkeypatch):
    """A task's postings come in as they are read; only those of one range are unpacked at a time."""
    monkeypatch.setattr(ngram_join, "write_and_read", lambda table, name: table)
    rng = np.random.default_rng(5)
    rows = np.zeros(800_000, ngram_join._POSTING)
    rows["h"] = rng.integers(0, 1 << 63, len(rows), dtype=np.uint64) << np.uint64(1)
    rows["sig"], rows["n"] = np.arange(len(rows)), 100
    rows[1::1000]["h"][:] = rows[::1000]["h"]  # pairs that meet
    dealt = list(ngram_join._pack(rows, 16))
    batches = [pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([raw], pa.binary())], ["g", "postings"]) for g, raw in dealt]
    found = []
    peak = peak_mb(lambda: found.extend(b for b in ngram_join._meet(Table(), 1)(iter(batches))))
    met = {(a, b) for out in found for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)}
    assert {(i, i + 1) for i in range(0, len(rows), 1000)} <= met
    assert peak < 15


def test_postings_are_handed_on_early(monkeypatch):
    class Ranks:
        value = np.zeros(1 << ngram_join.COUNT_BITS, np.uint8)

    rng = np.random.default_rng(6)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 1200))) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    run = ngram_join._postings(Table(), Ranks, 16)
    sizes = []
    assert peak_mb(lambda: sizes.extend(b.nbytes for b in run(iter([batch])))) < 45
    per_text = int(ngram_join.prefix_length(1196)) * len(ngram_join._STORED)
    assert abs(sum(sizes) - len(texts) * per_text) < 0.01 * sum(sizes)
