import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from talus.llm import token_blocks as tb

TEXTS = [
    None, "", " ", "  ", "Hello, World's end", "a  b   c\n d \n e\t f", "x\n \ny", "<|endoftext|> y<|endoftext|>z", "tail ", "tail \n", " \n lead", "ΑΣ 漢字 🙂 é",
    "a\x1c \x1cb \x85 c", "ab" * 3000, "word " * 5000, "\n" * 50 + " " * 50 + "z", "it's 'tis don't ' s",
]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 60), max_size=700), st.sampled_from([1, 3, 64, 256]))
def test_round_trip(values, block):
    raw = tb.pack(np.array(values, np.uint32), block)
    assert tb.unpack(raw).tolist() == values
    assert tb.unpack(raw, 1, 2).tolist() == values[block : 2 * block]


def test_outliers_are_exceptions():
    values = np.arange(256, dtype=np.uint32) % 7
    values[[3, 200]] = 4_000_000_000
    raw = tb.pack(values)
    assert len(raw) == 16 + 4 + 8 + 256 * 3 // 8 + 2 * 6
    assert tb.unpack(raw).tolist() == values.tolist()
    with pytest.raises(ValueError):
        tb.unpack(b"nothing of the kind")


@pytest.fixture(scope="module")
def both():
    raw = open(tb.default_tokenizer(), encoding="utf-8").read()
    return Tokenizer.from_str(raw), tb.Pieces(raw)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab.,'s1 \n\t\x1c\x85 é<|", "\n", " ", "<|endoftext|>", "ñandú, "]), max_size=24).map("".join), min_size=1, max_size=3))
def test_pieces_like_whole_texts(both, texts):
    tk, p = both
    ids, counts = p.encode(pa.array(texts), 0)
    own = [[*tk.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert ids.tolist() == sum(own, [])
    assert counts.tolist() == [len(x) for x in own]


def test_pieces_after_words_are_forgotten(both, monkeypatch):
    tk, p = both
    monkeypatch.setattr(tb, "CACHE", 3)
    for text in ("one two, three.\nFour five six", "one seven. eight " + "long" * 30, "three\nFour. nine" + " ten" * 5):
        assert p.encode(pa.array([text]))[0].tolist() == tk.encode(text, add_special_tokens=False).ids
    assert not any(len(w) > 64 for w in p.spaced.words.to_pylist())


def test_files(spark, tmp_path):
    tk = Tokenizer.from_file(tb.default_tokenizer())
    rows = [(i * 3, t, "x") for i, t in enumerate(TEXTS)] + [(3, "again", "y"), (None, "null id", "z")]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string, start string")
    tb.write(docs, str(tmp_path / "t"), tb.default_tokenizer(), partitions=3, segment_tokens=500)
    got = {(r.doc_id, bytes(r.tokens)): r for r in tb.read(spark, str(tmp_path / "t")).collect()}
    at = 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = np.array([*tk.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        r = got[doc_id, ids.tobytes()]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


def test_empty_table(spark, tmp_path):
    tb.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), tb.default_tokenizer())
    assert tb.read(spark, str(tmp_path / "t")).count() == 0
