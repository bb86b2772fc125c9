import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from talus.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello, World's end", "it's the 'street' 123 4567", "ΑΣ ΣΑΣ ǅ İstanbul", "éà ﬁ", "a\x1cb \x1f c　d᠎e",
    "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|> <| z", "漢字かな交じり文 🙂🙂👩‍👩‍👧", "ab" * 3000, "." * 700, "word " * 5000, "\x00\x7f\x80", "!!?? --- ***", "don't we'll I'd",
]


def whole(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_like_the_library(text):
    b = bpe.Bpe(open(PATH, encoding="utf-8").read())
    ids = [int.from_bytes(x, "little") for x in (lambda raw: [raw[i : i + 4] for i in range(0, len(raw), 4)])(b.encode(text or ""))]
    assert ids == whole(text)
    assert b.decode(ids) == Tokenizer.from_file(PATH).decode(ids, skip_special_tokens=False)


def test_scan_and_heap_agree():
    b = bpe.Bpe(open(PATH, encoding="utf-8").read())
    for w in ("internationalization", "aaaaaaaaaaaaaaaaaaaaaaa", "thththththerrrrr", "mississippi"):
        raw = w.encode()
        assert b.word(w) == b._long([*map(b.inner.__getitem__, raw[:-1]), b.last[raw[-1]]])


def test_query_form(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y"), (None, "null id", "z")], "doc_id long, text string, ids string")
    rows = bpe.digests(docs, PATH).collect()
    assert len(rows) == len(TEXTS) + 2
    tk = Tokenizer.from_file(PATH)
    for r in rows:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id]
        ids = whole(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_every_code_point_like_the_library():
    raw = open(PATH, encoding="utf-8").read()
    tk, own = Tokenizer.from_str(raw), bpe.Bpe(raw)
    texts = [f"a{chr(c)}b {chr(c)}. X{chr(c)}," for c in range(1, 0x33480) if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(texts), 4096):
        for t, e in zip(texts[k : k + 4096], tk.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False), strict=True):
            assert np.frombuffer(own.encode(t), "<i4").tolist() == e.ids, ascii(t)


def test_batches_like_the_library(monkeypatch):
    """Words that merge as columns, with a cache that is emptied again and again."""
    monkeypatch.setattr(bpe, "CACHE", 500)
    raw, draw = open(PATH, encoding="utf-8").read(), np.random.default_rng(7)
    tk, own = Tokenizer.from_str(raw), bpe.Bpe(raw)
    parts = ["th", "er", "ing", "on", "a", "é", "ß", "z", "Ж", "漢", "&&&", ",", "'s", "7", "<|endoftext|>", "́", "İ", "\n", " ", " ", "\x1c"]
    texts = ["".join(draw.choice(parts, draw.integers(0, 200))) for _ in range(600)] + [t or "" for t in TEXTS]
    for k in range(0, len(texts), 100):
        ids = own.encode_all(texts[k : k + 100])
        assert ids.to_pylist() == [e.ids for e in tk.encode_batch(texts[k : k + 100], add_special_tokens=False)]
        assert own.decode_all(ids).to_pylist() == [own.decode(x) for x in ids.to_pylist()] == [tk.decode(x, skip_special_tokens=False) for x in ids.to_pylist()]


def test_batches_of_every_code_point_like_the_library():
    raw = open(PATH, encoding="utf-8").read()
    tk, own = Tokenizer.from_str(raw), bpe.Bpe(raw)
    texts = [f"a{chr(c)}b {chr(c)}. X{chr(c)}," for c in range(1, 0x33480) if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(texts), 4096):
        for t, e, ids in zip(texts[k : k + 4096], tk.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False), own.encode_all(texts[k : k + 4096]).to_pylist(), strict=True):
            assert ids == e.ids, ascii(t)


def test_columns_and_scan_agree():
    own, draw = bpe.Bpe(open(PATH, encoding="utf-8").read()), np.random.default_rng(8)
    words = sorted({"".join(draw.choice(list("thernioaésß"), n)) for n in range(1, 70) for _ in range(60)})
    ids, starts, sizes = own.words(words)
    assert [ids[a : a + n].tolist() for a, n in zip(starts, sizes, strict=True)] == [own.word(w) for w in words]


def test_odd_ids_decode():
    own = bpe.Bpe(open(PATH, encoding="utf-8").read())
    lists = [None, [], [320, -1, 10**6, None, 49407], [None], [49406]]
    assert own.decode_all(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [own.decode(x or []) for x in lists]
    assert own.decode_all(pa.array([], pa.list_(pa.int32()))).to_pylist() == []


def test_query_goes_to_python_once(spark):
    """Ids that went to the JVM and on to another worker for decoding cost more than the encoding."""
    out = bpe.digests(spark.createDataFrame([(1, "x")], "doc_id long, text string"), PATH)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_encode_and_decode_apart(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    apart, once = bpe.decode(bpe.encode(docs, PATH), PATH), bpe.there_and_back(docs, PATH)
    assert once.columns == ["doc_id", "ids", "decoded"]
    assert sorted(apart.drop("text").collect()) == sorted(once.collect())
