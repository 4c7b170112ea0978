import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starlane.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    alphabet = ["the", "ing", " ", "  ", "\n", "\t", "é", "ß", "日本", "𝄞", "'s", "'re", "'", "12", "٣", "½", "\x1c", "​", "　", "!!", "_", "<|endoftext|>", "Ᲊ", "\U00013460", "́", "Ω", "🙂", "a"]
    out = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(300)]
    every = "".join(chr(c) + rng.choice(["", " ", "a", "1"]) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return [*out, *(every[i : i + 50_000] for i in range(0, len(every), 50_000)), "", "x" * 30_000, "ab" * 20_000, " " * 1000, "<|endoftext|>" * 3]


def test_same_as_tokenizers(spark, texts):
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(-1, None, "c"), (0, texts[0], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    public = Tokenizer.from_file(PATH)
    got = bpe.encode_decode(docs, PATH).select("row.doc_id", "ids", "decoded").collect()
    assert len(got) == len(rows)
    digests = {r.doc_id: r for r in bpe.encode_decode(docs, PATH, ["doc_id"], "digest").select("row.doc_id", "*").collect()}
    for r in got:
        text = "" if r.doc_id < 0 else texts[r.doc_id]
        want = public.encode(text, add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == public.decode(want, skip_special_tokens=False) == text
        d = digests[r.doc_id]
        assert d.n_tokens == len(want)
        assert d.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w: [i, i + 1] for i, w in enumerate([b"tap", b"taps", b"top", b"tops", b"", b"a", b"\xff\x00"])}
    path = tmp_path / "lexicon.bin"
    path.write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(path))
    assert {w: lexicon.get(w) for w in words} == words
    assert [lexicon.get(w) for w in (b"t", b"tapss", b"b", b"\xff")] == [None] * 4
    assert len(lexicon.first) - 1 == 6  # tap/top and taps/tops share all states after the vowel; a ends where taps does
    path.write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(path)).get(b"a") is None


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(docs, PATH).count() == 0


def test_lexicon_counts_all_documents(spark, tmp_path, monkeypatch):
    """Every piece of a table of any size is counted, none of a drawn part only."""
    n = 45_000
    docs = spark.range(n, numPartitions=8).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    monkeypatch.setattr(bpe, "write_file", lambda spark, name, content: (tmp_path / name).write_bytes(content) and str(tmp_path / name))
    lexicon = bpe.Lexicon(str(tmp_path / bpe.build_lexicon(docs, bpe.read_vocabulary(PATH), words=n)))
    missing = [r.text for r in docs.collect() if lexicon.get(r.text.encode()) is None]
    assert not missing
