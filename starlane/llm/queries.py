"""One registered query per operator, and the SQL that checks it where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlane.llm import (
    bpe,
    conversations,
    decontaminate,
    html_extract,
    language_id,
    learning,
    license_scan,
    line_dedup,
    ngram_join,
    quality_classifier,
    quality_rules,
    sharding,
    toxicity,
    vector_codes,
)
from starlane.llm.text import ship_package

SHARDS = 8


def vocabulary_path() -> str:
    """The public vocabulary file that the codec query uses."""
    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, those removed as repeated or nearly so, and a
    digest of the text that stays."""
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    left = F.sha2(F.coalesce(F.array_join("lines", "\n"), F.lit("")), 256)
    return done.select("row.doc_id", "n_lines", "n_removed", left.alias("left_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = learning.fold(F.col("doc_id"), 3) == 1
    model = language_id.fit(docs.filter(~held_out))
    done = language_id.identify(docs.select("doc_id", "text"), model, ["doc_id"]).select("row.doc_id", "lang_pred", "score")
    return done.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and the decoded text of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode_decode(docs, vocabulary_path(), ["doc_id"], "digest")
    return done.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = learning.fold(F.col("doc_id"), 4) == 2
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out & F.col("quality").isNotNull())
    model = quality_classifier.fit(docs, labels, "quality")
    done = quality_classifier.score(docs, model, ["doc_id"]).select("row.doc_id", "score")
    return done.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and benchmark items found in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decontaminate.scan(docs, _table(spark, sf_dir, "benchmark"), ["doc_id"])
    items = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return done.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, "contaminated")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under 5-word n-gram links."""
    return ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"))


def op7_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and the shard after growth of every document (law ``key``)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    tree = sharding.even_tree(SHARDS)
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = sharding.assign(docs, tree).select("row.*", "shard")
    grown = sharding.shard_of(F.col("doc_id"), sharding.with_new_shard(tree))
    return sharding.slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labels that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = learning.fold(F.col("doc_id"), 4) == 2
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out & F.col("toxic").isNotNull())
    model = toxicity.fit(docs, labels, "toxic")
    done = toxicity.score(docs, model, ["doc_id"]).select("row.doc_id", "score")
    return done.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence declarations and families of every document, and its paragraphs
    that mention a licence without declaring one.  Rows that share a
    ``doc_id`` are told apart by the digest of their texts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = docs.withColumn("digest", F.md5("text"))
    found = license_scan.summary(license_scan.scan(keyed, license_scan.fit(docs), ["doc_id", "digest"]))
    same = F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("digest") == F.col("row.digest"))
    joined = keyed.select("doc_id", "digest").join(found, same, "left")
    none = F.lit(0).cast("long")
    counts = [F.coalesce(c, none).alias(c) for c in ("n_licensed", "n_unknown")]
    return joined.select("doc_id", *counts, F.coalesce(F.concat_ws(",", "families"), F.lit("")).alias("families"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base rule and the verdict on every document."""
    done = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), ["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return done.select("row.doc_id", *counts, "base_failed", "kept", "d2")


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = html_extract.main_text(pages, keep=["page_id", "url"])
    return done.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every usable embedding, with books fitted on all of them."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    done = vector_codes.compress(vectors, keep=["vec_id"])
    return done.select("row.vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired rows of every
    conversation, after the damage that the contract states."""
    return conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_bpe": op3_bpe,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_decontaminate": op5_decontaminate,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_hash_tree_sharding": op7_hash_tree_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_html_extract": op11_html_extract,
    "op12_vector_codes": op12_vector_codes,
    "op13_conversation_repair": op13_conversation_repair,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED_WORD = r"[^\x20\x09-\x0D]+"



def _vector_codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Plain Lloyd rounds: all distances, the least of each part, means of groups."""
    with_parts = [
        """v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS e, len(embedding) // 8 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda q: q IS NULL OR NOT isfinite(q))) = 0),
places AS (SELECT r, vec_id, label, w, e, unnest(range(0, len(e))) AS i FROM v),
x AS (SELECT r, vec_id, label, i // w AS pos, i % w AS k, CAST(floor(4096 * CAST(e[i + 1] AS DOUBLE)) AS BIGINT) AS c FROM places),
b0 AS (SELECT pos, r - 1 AS entry, k, c FROM x WHERE r <= 16)"""
    ]
    nearest = """SELECT r, pos, min(16 * d + entry) AS best FROM (
  SELECT x.r, x.pos, b.entry, CAST(sum((x.c - b.c) * (x.c - b.c)) AS BIGINT) AS d FROM x JOIN b{n} b ON b.pos = x.pos AND b.k = x.k GROUP BY ALL) GROUP BY ALL"""
    for n in range(rounds):
        with_parts.append(f"a{n} AS ({nearest.format(n=n)})")
        with_parts.append(f"""s{n} AS (SELECT x.pos, a.best % 16 AS entry, x.k, CAST(sum(x.c) AS BIGINT) AS s, count(*) AS n
  FROM x JOIN a{n} a ON a.r = x.r AND a.pos = x.pos GROUP BY ALL)""")
        with_parts.append(f"""b{n + 1} AS (SELECT b.pos, b.entry, b.k, coalesce((s.s - (s.s % s.n + s.n) % s.n) // s.n, b.c) AS c
  FROM b{n} b LEFT JOIN s{n} s ON s.pos = b.pos AND s.entry = b.entry AND s.k = b.k)""")
    return f"""WITH {", ".join(with_parts)},
a{rounds} AS ({nearest.format(n=rounds)}),
coded AS (SELECT r, string_agg(printf('%02x', best % 16), '' ORDER BY pos) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY pos, entry, k)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN v USING (r)
"""


ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ITEM_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ITEM_WORD}') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM starts),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
found AS (SELECT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN windows x
          ON x.size = p.size AND x.k = array_to_string(p.w[p.i:p.i + p.size - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, i + unnest(range(0, size)) AS word FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.names, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op6_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED_WORD}') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, min(reach.b) AS component_id
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY 1, 2
""",
    "op12_vector_codes": _vector_codes_sql(),
}
