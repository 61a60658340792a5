"""BPE by the rank array against the tokenizers library, and the decoder."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from martloom.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def exact(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own(ids):
    return np.frombuffer(ids, "<u4").tolist()


@pytest.mark.parametrize("short", [2, 64])
def test_ids_and_texts_are_the_librarys(short):
    """Odd white space, special tokens, letters newer than Python's tables, long words."""
    r = random.Random(3)
    pieces = ["the", " ", "\n", "  ", ",", "###", "é", "don't", "0", "10", "\t", " ", "漢", ".", "THE", "\0", "'s", "é",
              "<|endoftext|>", "<|endof", "࢏", "a", "!", "\U0003fc36", "ab" * 40, "　", "🙂"]
    texts = ["".join(r.choices(pieces, k=r.randint(0, 12))) for _ in range(4000)]
    texts += ["", "a" * 3000, "漢字" * 200 + " x", "ab" * 2000, " " * 1000, "\n" * 300, "<|endoftext|>"]
    own_bpe = bpe.Bpe(PATH, short)
    for remember in (0, 10**6):
        for text, ids in zip(texts, own_bpe.encode(texts, remember)):
            assert own(ids) == exact(text), text[:80]
            assert own_bpe.decode(own(ids)) == LIBRARY.decode(own(ids), skip_special_tokens=False) == text


def test_decoding_of_any_ids():
    r, own_bpe = random.Random(5), bpe.Bpe(PATH)
    for _ in range(2000):
        ids = [r.randint(0, 50_300) for _ in range(r.randint(0, 20))]  # the last ones are no tokens
        assert own_bpe.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_operator_on_odd_rows(spark, docs, texts, empty):
    coded = bpe.encode(docs, PATH, size=1000)
    back = bpe.decode(coded, PATH, size=1000).collect()
    want = sorted((str(i), exact(t), t) for i, t in texts)
    assert sorted((str(r.doc_id), own(r.ids), r.text) for r in back) == want
    assert all(r.n_tokens == len(own(r.ids)) for r in back)
    assert bpe.encode(empty, PATH).count() == bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0
    odd = spark.createDataFrame([(1, bytes(4), "kept"), (2, None, "kept")], "text long, ids binary, `a``b.c` string")
    assert {(r["a`b.c"], r.text) for r in bpe.decode(odd, PATH).collect()} == {("kept", "!"), ("kept", "")}


def test_query_digests(spark, docs, texts, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in queries.op11_rank_array_bpe(spark, str(tmp_path)).collect())
    assert got == sorted((str(i), len(exact(t)), hashlib.sha256(np.array(exact(t), "<u4").tobytes()).hexdigest(),
                          hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
