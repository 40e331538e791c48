"""Byte-level BPE against the library whose files it reads."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from terralode.llm import queries
from terralode.llm.bpe import SPACED, Decoder, Encoder, Transducer, decode_ids, encode_texts, read_ranks, utf8_step

FILES = [public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.tiktoken")]


def library(path, pattern=SPACED):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def ids_of(encode, text):
    return np.frombuffer(encode(text), "<i4").tolist()


@pytest.mark.parametrize("path", FILES)
def test_ids_are_those_of_the_library(path):
    """Random texts of letters, digits, marks and all sorts of white space; long runs; every kind of code point."""
    r, encode, whole = random.Random(3), Encoder(path, SPACED), library(path)
    texts = ["".join(r.choice("abeE1 ' \n\t.?éß日  \x85\x1c٣Ⅷ'stl🙂") for _ in range(r.randint(0, 30))) for _ in range(4000)]
    texts += ["a" * 5000, "ab" * 3000, " the" * 2000, "é" * 3000, "日本" * 1000, " ", "  ", "\n ", "a  b", "<|endoftext|> it's 12", "aaaaaaaab" * 500]
    texts += [f"a{chr(c)}b {chr(c)} 1" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    assert all(ids_of(encode, t) == whole.encode_ordinary(t) for t in texts)
    decode = Decoder(path)
    assert all(decode(np.frombuffer(encode(t), "<i4")) == t for t in texts)


def test_other_patterns_and_small_memories(monkeypatch):
    pattern = r"\p{L}{1,3}|\s|[^\s]"
    encode, whole = Encoder(FILES[0], pattern), library(FILES[0], pattern)
    text = "It's a  longer, text! " * 50
    assert ids_of(encode, text) == whole.encode_ordinary(text)
    monkeypatch.setattr("terralode.llm.bpe.STATES", 20)
    monkeypatch.setattr("terralode.llm.bpe.PAIRS", 20)
    monkeypatch.setattr("terralode.llm.bpe.MEMORY_BYTES", 2000)
    encode, whole, r = Encoder(FILES[0], SPACED), library(FILES[0]), random.Random(1)
    for _ in range(300):
        text = " ".join("".join(r.choice("abcdeinorst,.") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 20)))
        assert ids_of(encode, text) == whole.encode_ordinary(text)
    assert len(encode.run.states) < 400 and encode.size < 12000


def test_unreachable_tokens_and_ties():
    """A token that its own bytes don't merge to is only ever a whole word; equal ranks merge leftmost first."""
    ranks = {bytes((b,)): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259, b"aa": 260, b"aaaa": 261}
    encode, whole = Transducer(ranks), tiktoken.Encoding("own", pat_str=r"\S+|\s", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    for word in ["xyz", "xyzx", "abc", "aaa", "aaaaa", "a" * 33] + ["".join(r.choice("abcxyz") for _ in range(r.randint(1, 12))) for _ in range(500)]:
        assert encode(word.encode()) == whole.encode_ordinary(word)


def test_the_utf8_machine():
    """Cut anywhere, broken anyhow, it says what Python's replacement says."""
    r = random.Random(4)
    for _ in range(5000):
        data = bytes(r.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xE2, 0x82]) for _ in range(r.randint(0, 9)))
        out, held = "", b""
        for b in data:
            text, held = utf8_step(held, bytes((b,)))
            out += text
        assert out + ("�" if held else "") == data.decode("utf-8", "replace")
    ranks = read_ranks(FILES[0])
    broken = np.array([ranks[b"\xe2"], ranks[b"a"], ranks[b"\xc3"], ranks[b"\xa9"], ranks[b"\xf0"]], "i4")
    assert Decoder(FILES[0])(broken) == "�aé�"
    with pytest.raises(ValueError, match="no token"):
        Decoder(FILES[0])(np.array([10**6], "i4"))


def test_odd_rows(spark, odd_docs, no_docs):
    got = encode_texts(odd_docs, FILES[0])
    assert got.columns == ["doc_id", "ids"] and got.count() == odd_docs.count()
    whole = library(FILES[0])
    want = sorted((r.doc_id or -1, whole.encode_ordinary(r.text or "")) for r in odd_docs.collect())
    assert sorted((r.doc_id or -1, list(r.ids)) for r in got.collect()) == want
    assert sorted((r.doc_id or -1, r.text) for r in decode_ids(got, FILES[0]).collect()) == sorted((r.doc_id or -1, r.text or "") for r in odd_docs.collect())
    assert encode_texts(no_docs, FILES[0]).collect() == [] and decode_ids(encode_texts(no_docs, FILES[0]), FILES[0]).collect() == []
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [tuple(r) for r in decode_ids(null, FILES[0]).collect()] == [(1, None, None), (2, [], "")]


def test_query(spark, sf_dir):
    whole, hexed = library(FILES[0]), lambda b: hashlib.sha256(b).hexdigest()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = []
    for d in docs:
        ids = whole.encode_ordinary(d.text or "")
        want.append((d.doc_id, len(ids), hexed(",".join(map(str, ids)).encode()), hexed((d.text or "").encode())))
    assert sorted(map(tuple, queries.op13_byte_bpe(spark, sf_dir).collect())) == sorted(want)
