import math
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from starlane.llm import queries, sharding


def chained(key, name):
    """Spark's xxhash64(long, string): the first hash seeds the second."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    return xxhash.xxh64_intdigest(name.encode(), seed)


def descend(key, tree, path=""):
    level = path.count("/")
    if level == 3:
        return tree[0].shard
    children = {}
    for s in tree:
        if s.weight > 0:
            children.setdefault((s.region, s.rack, str(s.shard))[level], []).append(s)

    def draw(name):
        u = ((chained(key, f"{path}{name}") >> 11) + 0.5) / 2**53
        return -math.log(u) / sum(s.weight for s in children[name])

    name = min(sorted(children), key=draw)
    return descend(key, children[name], f"{path}{name}/")


def placed(spark, tree, n=4000):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"))
    return {r.doc_id: r.shard for r in sharding.assign(rows, tree).select("row.doc_id", "shard").collect()}


def test_descent_matches_brute_force(spark):
    tree = sharding.reweighted(sharding.even_tree(8), 3, 2.5)
    got = placed(spark, tree, 500)
    assert got == {k: descend(k, tree) for k in range(500)}


def test_growth_moves_only_into_the_new_shard(spark):
    tree = sharding.even_tree(8)
    before, after = placed(spark, tree), placed(spark, sharding.with_new_shard(tree))
    moved = {k for k in before if before[k] != after[k]}
    assert moved and {after[k] for k in moved} == {8}
    sizes = Counter(after.values())
    assert all(abs(sizes[s] - 4000 / 9) < 100 for s in range(9))


def test_movement_stays_in_reweighted_subtrees(spark):
    """A lighter shard only loses keys; other subtrees of its region and rack
    only gain, and no key moves between subtrees of unchanged weight."""
    tree = sharding.even_tree(8)
    before, after = placed(spark, tree), placed(spark, sharding.reweighted(tree, 0, 0.25))
    at = {s.shard: (s.region, s.rack) for s in tree}
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    assert moved
    for old, new in moved:
        assert at[old][0] == at[0][0]  # nothing leaves the region whose weight stayed
        if at[new][0] == at[0][0] and at[old] != at[new]:
            assert at[old] == at[0]  # nor, within the region, the rack whose weight stayed
        if at[old] == at[new]:
            assert old == 0


def test_query(spark, tmp_path):
    texts = ["a", "", None, "é" * 5, "same", "same", "x" * 300_000]
    rows = [(i, texts[i % len(texts)], "l") for i in range(200)] + [(5, "same", "l")] * 3 + [(None, "a", "l"), (None, None, "l")]
    spark.createDataFrame(rows, "doc_id long, text string, slot string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_hash_tree_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    tree = sharding.even_tree(8)
    want = Counter()
    for doc_id, text, _ in rows:
        raw = (text or "").encode()
        want[doc_id, len(raw) + 1, zlib.crc32(raw), "key", descend(doc_id, tree), descend(doc_id, sharding.with_new_shard(tree))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for shard in range(8):
        numbers = sorted(r.slot for r in got if r.shard == shard)
        assert numbers == list(range(len(numbers)))
    empty = tmp_path / "none"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{empty}/documents.parquet")
    assert queries.op7_hash_tree_sharding(spark, str(empty)).count() == 0


def test_slots_of_many_copies_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STRIDE", 7)
    rows = [(k % 3, "copy" if k < 60 else f"t{k}", k % 2, 5) for k in range(90)]
    table = spark.createDataFrame(rows, "shard int, `a.b` string, _bucket int, times int").repartition(5)
    got = sharding.slots(table).collect()
    assert sorted((r.shard, r["a.b"], r._bucket, r.times) for r in got) == sorted(rows)
    for shard in range(3):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(30))
