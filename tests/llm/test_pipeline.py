import hashlib
import re

from tokenizers import Tokenizer

import corpus_pipeline
from starlane.llm import decontaminate, line_dedup, quality_rules
from starlane.llm.queries import vocabulary_path
from test_decontaminate import brute as contamination
from test_line_dedup import brute as line_brute
from test_ngram_join import brute as groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage on what the one before it kept, against its plain definition."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, SF).persist()
    assert good.columns == docs.columns
    judged = quality_rules.judge(docs).filter("kept").select("row.doc_id")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in judged.collect())

    rows = [(r.doc_id, r.text) for r in good.collect()]
    want = {d: t for d, t in line_brute(rows, line_dedup.TAU, line_dedup.MIN_CHARS).items() if t.strip() or not dict(rows)[d].strip()}
    lines = stages["line_dedup"](spark, good, SF).persist()
    assert lines.columns == docs.columns
    assert {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    one = stages["ngram_jaccard_join"](spark, lines, SF).persist()
    assert one.columns == docs.columns
    keep = {d for d, n, c in groups(sorted(want.items())) if d == c or not n}
    assert {r.doc_id for r in one.collect()} == keep

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = stages["benchmark_decontamination"](spark, one, SF).persist()
    assert left.columns == docs.columns
    found = {d: contamination(want[d], items) for d in keep}
    texts = {r.doc_id: r.text for r in left.collect()}
    assert set(texts) == {d for d in keep if not found[d][3]}
    assert all(texts[d] == want[d] for d in texts if not found[d][1])

    public = Tokenizer.from_file(vocabulary_path())
    done = stages["bpe"](spark, left, SF).collect()
    assert len(done) == len(texts)
    for r in done:
        assert r.ids == public.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(r.ids) and r.decoded == texts[r.doc_id]
    run = {r.doc_id: hashlib.sha256(r.decoded.encode()).hexdigest() for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()}


def test_empty_documents_pass_through(spark, tmp_path):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0


def test_import_guard_is_in_the_entry_file_alone():
    with open(corpus_pipeline.__file__, encoding="utf-8") as file:
        assert not re.search(r"except\s*(ImportError|ModuleNotFoundError|Exception|:)", file.read())
    for module in (decontaminate, line_dedup, quality_rules):
        with open(module.__file__, encoding="utf-8") as file:
            assert "except ImportError" not in file.read()
