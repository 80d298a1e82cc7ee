import random

import pytest

from peakflow.llm import token_counts as t


def library(pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement=t.MARK, prepend_scheme="always", split=True)
    return tok


@pytest.fixture(scope="module")
def real():
    return t.load()


def test_equal_to_library_on_table(spark, real):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tok = library(real)
    got = {r.doc_id: r.n_tokens for r in t.token_counts(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == len(tok.encode(r.text, add_special_tokens=False).ids)


def test_equal_to_library_on_odd_texts(real):
    rnd = random.Random(3)
    c, tok = t.Counter(real), library(real)
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "日本", "😀", "▁", "<s>", "<0x41>", "ß", "ing", "́", "𝔘", "xyzzy", "aaaaaaa"]
    texts = ["", " ", "  ", "▁", "▁a", " ▁", "a ▁ b", "日" * 50, "x" * 500] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 15))) for _ in range(3000)]
    for x in texts:
        assert c.total(x) == len(tok.encode(x, add_special_tokens=False).ids), repr(x)


def test_ties_as_in_library():
    """Small whole scores, so that many paths are equal."""
    rnd = random.Random(5)
    for round_ in range(40):
        pieces = {"".join(rnd.choice("ab▁") for _ in range(rnd.randint(1, 4))) for _ in range(12)}
        vocab = [("<unk>", 0.0)] + [(p, -float(rnd.randint(1, 3))) for p in sorted(pieces)]
        c, tok = t.Counter(vocab), library(vocab)
        for _ in range(50):
            x = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 12)))
            assert c.total(x) == len(tok.encode(x, add_special_tokens=False).ids), (vocab, x)


def test_nulls_and_bound(spark, real, monkeypatch):
    df = spark.createDataFrame([(1, None), (None, "a b"), (2, ""), (2, "a b")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in t.token_counts(df).collect()))) == sorted(map(str, [(1, 0), (None, 2), (2, 0), (2, 2)]))
    assert t.token_counts(df.limit(0)).count() == 0
    monkeypatch.setattr(t, "REMEMBERED", 3)
    c = t.Counter(real)
    c.total("a b c d e f")
    assert len(c) <= 3
