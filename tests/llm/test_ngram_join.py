import random
import re

import pytest

from starlane.llm import ngram_join


def brute(rows, percent=75, n=5):
    sets = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
        sets.append((doc_id, grams))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return sorted((d, len(g), find(d)) for d, g in sets)


def corpus(seed, groups, size):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["é", "Ünd", "x-y,"]
    shared = [rng.choices(vocab, k=60) for _ in range(2)]
    texts = []
    for g in range(groups):
        base = rng.choices(vocab, k=rng.choice([3, 5, 8, 40, 120]))
        if g % 3 == 0:
            base += shared[g % 2]
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "\n", "\t "]).join(words).upper() if rng.random() < 0.2 else " ".join(words))
    texts += ["", " \n", None, "a", "A", "a b"]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("groups", "size", "bucket"), [(25, 5, 16), (6, 60, 1)])
def test_against_all_pairs(spark, groups, size, bucket):
    rows = corpus(groups, groups, size)
    docs = spark.createDataFrame([(i, t, "other") for i, t in rows], "doc_id long, text string, sig string")
    got = sorted(tuple(r) for r in ngram_join.jaccard_groups(docs, bucket).collect())
    assert got == brute(rows)
    kept = ngram_join.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, n, c in brute(rows) if d == c or not n]


def test_edges(spark):
    long_text = " ".join(f"t{i}" for i in range(250_000))
    rows = [(1, long_text), (2, long_text + " end"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None), (None, "p q r s t u"), (None, "P q r s\nt u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1) for r in ngram_join.jaccard_groups(docs).collect())
    assert got == [(-1, 2, -1), (-1, 2, -1), (-1, 2, 7), (1, 249_996, 1), (2, 249_997, 1), (7, 2, 7), (7, 2, 7), (9, 0, 9)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_groups(empty).count() == 0
    assert ngram_join.keep_one_per_group(empty).count() == 0
