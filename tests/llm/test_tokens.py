"""Packing and token files: exact ids against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from martloom.llm import pack, repair
from martloom.llm.tokens import Encoder

BYTES, WORDS = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json"))


def exact(path, end=None):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids + ([] if end is None else [end])


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_parts_have_the_ids_of_the_whole(path):
    r = random.Random(3)
    pieces = ["the", " ", "\n", "  ", ",", "###", "é", "don't", "0", "10", "\t", " ", "漢", ".", "THE", "\0", "'s", "é"]
    texts = ["".join(r.choices(pieces, k=r.randint(0, 12))) for _ in range(3000)] + ["", " ", "\n", "a ", " a", "a\n"]
    flat, ends = Encoder(path).encode(pa.array(texts))
    want = list(map(exact(path), texts))
    at = 0
    for text, ids, end in zip(texts, want, ends):
        assert flat[at:end].tolist() == ids, repr(text)
        at = end


def test_encoder_forgets(monkeypatch):
    e = Encoder(BYTES, remember=3)
    for text in ["a b c d e", "f g", "a b"]:
        assert e.encode(pa.array([text]))[0].tolist() == exact(BYTES)(text)
    assert len(e.known) <= 8


def test_packing_covers_every_id_once(docs, texts):
    got = pack.pack(docs, BYTES, 64, 1).toPandas()
    assert got.sequence_id.is_unique and (got.offset == 0).all()
    assert set(got.length) <= {1 << b for b in range(7)} and (2 ** got.bucket == got.length).all()
    want = sorted((str(i), exact(BYTES, 1)(t)) for i, t in texts)
    got["doc_id"] = [str(int(i)) if i == i and i is not None else "None" for i in got.doc_id.astype(object)]
    pieces = {(d, s): np.frombuffer(x, "<u4").tolist() for d, s, x in zip(got.doc_id, got.start, got.ids)}
    for doc, ids in want:
        at = 0
        while at < len(ids):
            piece = pieces[doc, at] if (doc, at) in pieces else pytest.fail(f"{doc} {at}")
            assert piece == ids[at:at + len(piece)] or doc == str(2**62)  # pandas rounds that id
            at += len(piece)
    assert got.length.sum() == sum(len(ids) for _, ids in want)
    assert (got[got.doc_tokens == 1].length == 1).all()


def test_packing_of_nothing(empty):
    assert pack.pack(empty, BYTES).count() == 0
    with pytest.raises(ValueError):
        pack.pack(empty, BYTES, 100)


def test_pieces_are_the_binary_digits():
    doc, start, length = pack.cuts(np.array([5, 0, 16, 23]), 8)
    assert list(zip(doc, start, length)) == [
        (0, 0, 4), (0, 4, 1), (2, 0, 8), (2, 8, 8), (3, 0, 8), (3, 8, 8), (3, 16, 4), (3, 20, 2), (3, 22, 1)]


def test_digest(docs):
    for r in pack.pieces_digest(pack.pack(docs, BYTES)).join(
            pack.pack(docs, BYTES).select("sequence_id", "ids"), "sequence_id").limit(20).collect():
        assert r.ids_crc32 == zlib.crc32(r.ids)


@pytest.mark.parametrize("seed", range(12))
def test_grammar_round_trip(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(0 if seed % 2 else 1, 2000, 9)
    ids = (r.zipf(1.4, sizes.sum()) % 300).astype(np.uint32)
    if seed == 3:
        ids[:] = 7  # runs of one id
    ends = np.cumsum(sizes)
    symbols, symbol_ends, rules = repair.grammar(ids, ends, 300, least=3)
    assert (repair.expand(symbols.astype(np.int64), 300, rules) == ids).all()
    assert seed == 3 or len(symbols) < len(ids)
    shard = {"first": 300, "symbols": symbols.astype("<u2").tobytes(), "rules": rules.astype("<u4").tobytes(),
             "lengths": repair.expansions(rules, 300)[1].astype("<u4").tobytes(), "symbol_ends": symbol_ends.tolist()}
    for d, (end, size) in enumerate(zip(ends, sizes)):
        own = ids[end - size:end]
        a, b = sorted(r.integers(0, size + 1, 2))
        assert (repair.decode(shard, d) == own).all() and (repair.decode(shard, d, a, b) == own[a:b]).all()


def test_files_hold_all_documents_in_order(spark, docs, texts, tmp_path):
    path = f"file://{tmp_path}/shards"
    repair.write_shards(docs, path, WORDS, shard_tokens=500)
    got = sorted(repair.read_shards(spark, path).collect(), key=lambda r: r.start)
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    at = 0
    for r, (_, text) in zip(got, order):
        ids = exact(WORDS, 2)(text)
        assert (r.start, r.n_tokens) == (at, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)


def test_files_of_nothing(spark, empty, tmp_path):
    repair.write_shards(empty, f"file://{tmp_path}/none", WORDS)
    assert repair.read_shards(spark, f"file://{tmp_path}/none").count() == 0
