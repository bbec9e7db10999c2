"""Codecs, hashing and chunking against plain versions, without Spark."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import bpe, media, wordnum
from corvane.llm.common import buffers
from corvane.llm.queries import tokenizer_path

ODD = ["one, two. three; x: y! z? w,. v.", "a\n \nb", "w \n x  y   z \t q", "a\u00a0 b \u00a0c \u2003 d", " x", "x ", "a <|endoftext|> b  <|endoftext|>", "", None, "a", "x" * 30000, "word " * 5000, "é" * 9000, "a b  c\n\n d", "don't you'll <|endoftext|> it's", "日本語テキスト" * 3000, "\n" * 100, "  lead", "tail  ", "1234567890" * 2000, "a b" * 7000 + "\t\t" * 5000]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(tokenizer_path("byte_bpe_50k.json"))


def test_chunks_give_the_ids_of_the_whole_text(codec):
    random.seed(3)
    texts = ODD + ["".join(random.choice("ab \n\t'sé1! ") for _ in range(random.choice([5, 900, 20000]))) for _ in range(40)]
    want = [codec.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from the kept chunks
        got = codec.block(pa.array(texts))
        assert [x.tolist() for x in got] == want
    assert [codec.decode(x.tolist()).decode("utf-8", "replace") for x in got] == [codec.tokenizer.decode(i, skip_special_tokens=False) for i in want]
    assert codec.reused > 0


def test_unsafe_joins_are_mended(codec, monkeypatch):
    monkeypatch.setattr(bpe, "LONGEST", 7)
    monkeypatch.setattr(bpe, "safe_places", lambda raw, f=bpe.safe_places: f(raw)[::40])
    texts = ["don't do it's that   way\n\n now", "x" * 50, "aé" * 40, "<|endoftext|> and <|endoftext|>" * 9]
    want = [codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in codec.block(pa.array(texts))] == want


def test_words_and_shingles_as_by_hand():
    texts = ["Aa b\tc", "", None, "aa B c d e F aa b c d e", "ß b"]
    raw, at = buffers(pa.array(texts))
    starts, ends, offs = wordnum.words(raw, at, wordnum.SPACED)
    h = wordnum.word_hashes(raw, starts, ends)
    plain = [w.lower() for t in texts if t for w in t.split()]
    assert len(h) == len(plain) and len(set(h.tolist())) == len(set(plain))
    sets = [set(wordnum.shingles(h[a:b], 5).tolist()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    assert [len(s) for s in sets] == [1, 0, 0, 6, 1]


def test_adpcm_blocks_as_one_at_a_time():
    data = np.random.default_rng(1).integers(0, 256, 64 * 5).astype(np.uint8)
    got = media.decode_adpcm(data)
    for row, block in zip(got, data.reshape(-1, 64), strict=True):
        value, index = int(np.array([block[0], block[1]], np.uint8).view("<i2")[0]), min(int(block[2]), 88)
        want = [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + int(media.INDEX_STEP[code & 7])))
                want.append(value)
        assert row.tolist() == want


def test_wav_round_trip_and_known_levels():
    for tag in (media.MULAW, media.ALAW, media.IMA_ADPCM):
        assert media.read_wav(media.wav(bytes(range(64)), tag)) == (tag, bytes(range(64)))
    assert media.TABLES[media.MULAW][[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert media.TABLES[media.ALAW][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
