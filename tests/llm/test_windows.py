import random

import numpy as np

from talus.llm import decontaminate
from talus.llm.decontaminate import Windows


def plain(items, words, n):
    spans, found = set(), set()
    for item, text in items:
        own = text.split()
        k = min(n, len(own))
        for i in range(len(own) - k + 1) if k else ():
            for p in range(len(words) - k + 1):
                if words[p : p + k] == own[i : i + k]:
                    spans.add((p, p + k))
                    found.add(item)
    return spans, found


def cases():
    rng = random.Random(4)
    items = [(str(rng.randrange(12)), " ".join(rng.choices("abc", k=rng.choice([0, 1, 2, 3, 9])))) for _ in range(30)] + [("x", "a " * 40), ("y", "a " * 40), ("x", "a " * 40)]
    for _ in range(20):
        yield items, rng.choices("abcd", k=30)
    yield items, []
    yield [], ["a"]


def test_windows_like_brute_force():
    for items, words in cases():
        spans, found = Windows(items, 3).hits([w.encode() for w in words])
        assert (set(spans), found) == plain(items, words, 3)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "_hashes", lambda ids, n: np.full(len(ids) - n + 1, 7, np.uint64))
    for items, words in cases():
        spans, found = Windows(items, 3).hits([w.encode() for w in words])
        assert (set(spans), found) == plain(items, words, 3)


def test_repeated_windows_take_one_entry():
    w = Windows([("x", "a " * 1000), ("y", "a " * 1000)], 13)
    known, _, start, item = w.sorted[13]
    assert len(known) == 1 and start.tolist() == [0, 2] and len(item) == 2
