import random
import re

import pytest
from pyspark.sql import functions as F

from starlane.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return [(m.start(), m.end(), m[0]) for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def brute(text, items):
    words = [w for _, _, w in words_of(text)]
    hit, found = [False] * len(words), set()
    for name, item in items:
        seq = [w for _, _, w in words_of(item)]
        size = min(len(seq), 13)
        for start in range(len(seq) - size + 1) if size else ():
            window = seq[start : start + size]
            for i in range(len(words) - size + 1):
                if words[i : i + size] == window:
                    hit[i : i + size] = [True] * size
                    found.add(str(name))
    n = sum(hit)
    return len(words), n, sorted(found), n > 0 and 20 * n >= len(words), hit


def corpus(seed, short):
    rng = random.Random(seed)
    vocab = ["a", "B", "c1", "Éa", "x", "yy", "z"][: 4 if seed % 2 else 7]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice(short + [13, 14, 20, 40])))) for i in range(12)]
    items += [(100, items[0][1]), (101, ""), (102, None), (103, items[1][1] + " q " + items[2][1])]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choices([*vocab, "q", "rr"], k=rng.choice([0, 3, 30, 200]))
            if rng.random() < 0.6:
                piece = (rng.choice(items[:12])[1]).split()
                at = rng.randrange(len(piece))
                parts += piece[at : at + rng.randint(1, 30)] if rng.random() < 0.5 else piece
        docs.append((i, rng.choice([" ", "-\n"]).join(parts)))
    return items, [*docs, (900, None), (901, "!!!"), (902, items[4][1].upper())]


@pytest.mark.parametrize(("seed", "short", "most"), [(1, [13], 50_000), (2, [1, 2, 5], 50_000), (3, [3, 6, 12], 30)])
def test_against_brute_force(spark, monkeypatch, seed, short, most):
    monkeypatch.setattr(decontaminate, "MAX_WORDS", most)
    items, rows = corpus(seed, short)
    docs = spark.createDataFrame([(d, t, len(t or ""), 5) for d, t in rows], "doc_id long, text string, n_chars int, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.scan(docs, bench, ["doc_id"]).select("row.doc_id", "*").collect()}
    cleaned = {r.doc_id: r for r in decontaminate.remove_spans(docs, bench).collect()}
    for doc_id, text in rows:
        n_words, n_hit, found, contaminated, hit = brute(text, items)
        r = got[doc_id]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n_words, n_hit, found, contaminated)
        assert (doc_id in cleaned) == (not contaminated)
        if not contaminated:
            left = cleaned[doc_id]
            assert left.n_hit == 5 and left.n_chars == len(left.text or "")
            kept = [w for (_, _, w), h in zip(words_of(text), hit, strict=True) if not h]
            assert [w for _, _, w in words_of(left.text)] == kept or n_hit
            if not n_hit:
                assert left.text == text


def test_edges(spark):
    item = " ".join(f"w{i}" for i in range(20))
    long_text = "k " * 600_000 + item + " k" * 600_000
    docs = spark.createDataFrame([(1, long_text), (1, long_text), (None, item), (2, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (None, "zz")], "item_id long, text string")
    got = decontaminate.scan(docs, bench).select("row.doc_id", "n_words", "n_hit", F.size("items").alias("n"), "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 1_200_020, 20, 1, False)] * 2 + [(2, 0, 0, 0, False), (None, 20, 20, 1, True)]
    left = decontaminate.remove_spans(docs, bench).collect()
    assert len(left) == 3 and all(item not in r.text for r in left)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs, none).filter("n_hit > 0").count() == 0
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
