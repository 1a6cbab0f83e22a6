import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strophe.llm import tokens
from strophe.llm.rans import BLOCK, Table, decode_segment, encode_segment, frequencies
from strophe.llm.shingles import hashes
from strophe.llm.tokens import PIECE, WordEncoder, tokenizer_path

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ENCODERS = {n: WordEncoder(tokenizer_path(n), most_words=500) for n in NAMES}


UNTOUCHED = {n: Tokenizer.from_file(tokenizer_path(n)) for n in NAMES}


def direct(name, text):
    """By the library as it is loaded."""
    return np.array(UNTOUCHED[name].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aZé'́sß9.,-!  　\t\n\r\x1c\x85 \n<|>ﬁΣ中")), max_size=40))
def test_words_give_the_ids_of_the_whole_text(name, text):
    assert list(ENCODERS[name].documents(pa.array([text, "so", text]), b"")) == [direct(name, t) for t in (text, "so", text)]


@pytest.mark.parametrize("name", NAMES)
def test_real_texts_and_special_strings(name):
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    texts += ["<|endoftext|> a <|startoftext|>", "", " ", "\n", "\n\n a \n b  c\n"]
    assert list(ENCODERS[name].documents(pa.array([None, *texts]), b"end!")) == [b"end!", *(direct(name, t) + b"end!" for t in texts)]


SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", "<", "a", "É", " ", "  ", "\n", ".", "\u3000"]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SPECIAL), max_size=12))
def test_special_strings_are_the_librarys(name, parts):
    text = "".join(parts)
    texts = [text, "<|endof", "text|> so", text, f"it {text} is"]
    assert list(ENCODERS[name].documents(pa.array(texts), b"")) == [direct(name, t) for t in texts]


def test_a_special_token_in_the_middle():
    assert np.frombuffer(next(ENCODERS[NAMES[0]].documents(pa.array(["stop <|endoftext|> here"]), b"")), "<u4").tolist() == [11338, 220, 50256, 994]


@pytest.mark.parametrize("name", NAMES)
def test_texts_longer_than_a_piece(name):
    for text in ("one two\nthree  four " * (PIECE // 15), "one two <|endoftext|> three four " * (PIECE // 30)):
        assert list(ENCODERS[name].documents(pa.array(["a", text, "b"]), b"")) == [direct(name, t) for t in ("a", text, "b")]
    other = b"x" * (PIECE + 10)
    assert list(WordEncoder.pieces(other)) == [other]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000, BLOCK, BLOCK + 1, 3 * BLOCK + 777])
@pytest.mark.parametrize("kinds", [1, 2, 300, 60000])
def test_segments_round_trip(n, kinds):
    rng = np.random.default_rng(n)
    tokens = np.minimum(rng.geometric(0.01, n) * rng.integers(1, 50, n), kinds - 1).astype(np.uint32)
    packed = encode_segment(tokens)
    got = np.concatenate(list(decode_segment(packed["table_ids"], packed["table_f"], packed["blocks"])))
    assert (got == tokens).all()


def test_size_is_near_the_entropy_and_damage_is_found():
    rng = np.random.default_rng(7)
    tokens = np.minimum(rng.geometric(0.02, 400_000), 1000).astype(np.uint32)
    packed = encode_segment(tokens)
    p = np.bincount(tokens) / len(tokens)
    p = p[p > 0]
    bits = -(p * np.log2(p)).sum() * len(tokens)
    assert sum(len(b["words"]) + len(b["states"]) for b in packed["blocks"]) * 8 < bits * 1.05
    bad = [dict(b) for b in packed["blocks"]]
    bad[1]["words"] = bad[1]["words"][:100] + bytes([bad[1]["words"][100] ^ 1]) + bad[1]["words"][101:]
    with pytest.raises(ValueError, match="checksum"):
        list(decode_segment(packed["table_ids"], packed["table_f"], bad))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=400))
def test_frequencies_fill_the_range(counts):
    f = frequencies(np.array(counts), 12)
    assert f.sum() == 4096 and f.min() >= 1


def test_tables_survive_packing():
    table, _ = Table.of(np.array([5, 5, 70000, 2**31, 9], np.uint32))
    again = Table.unpack(*table.pack())
    assert (again.ids == table.ids).all() and (again.f == table.f).all() and zlib.crc32(b"") == 0


def thue_morse(letters, n=1024):
    out = letters[0]
    while len(out) < n:
        out += out.translate(str.maketrans(letters, letters[::-1]))
    return out


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("size", [64, 256, 1024])
def test_words_made_to_collide_and_long_words(name, size):
    """Their sums of letters times powers of any odd base agree modulo 2**64."""
    texts = [f"so xxxxxxxxx{thue_morse(x, size)} end" for x in ("ab", "ba")] + ["é" * 200 + " a", "x" * 255 + " " + "x" * 256 + " " + "x" * 257]
    assert list(ENCODERS[name].documents(pa.array(texts), b"")) == [direct(name, t) for t in texts]


def test_words_with_one_hash_are_told_apart(monkeypatch):
    """All words of a length share a hash: their bytes decide."""
    monkeypatch.setattr(tokens, "hashes", lambda data, lo, size: size.astype(np.uint64))
    encoder = WordEncoder(tokenizer_path(NAMES[0]))
    texts = ["the cat sat", "cat the sat", "abcdefghij abcdefghik", "abcdefghik abcdefghij sat"]
    for _ in range(2):
        assert list(encoder.documents(pa.array(texts), b"")) == [direct(NAMES[0], t) for t in texts]


def test_hashes_of_words_do_not_depend_on_what_is_beside_them():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in rng.integers(1, 300, 400)]
    alone = [int(hashes(np.frombuffer(w + bytes(8), np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
    size = np.array([len(w) for w in words])
    together = hashes(np.frombuffer(b"".join(words) + bytes(8), np.uint8), np.cumsum(size) - size, size)
    assert together.tolist() == alone and len(set(alone)) == len(set(words))
    assert len({int(hashes(np.frombuffer(w + bytes(8), np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in (b"a", b"a\0", b"a\0\0", b"a" + bytes(9))}) == 4
