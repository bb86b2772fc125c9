"""Operators on documents against plain Python, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from talus.llm import decontaminate, line_dedup, merkle, near_dedup, preferences, substring_dedup

WORDS = [f"w{i}" for i in range(40)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    shared = [" ".join(rng.choices(WORDS, k=70)) for _ in range(3)]
    out = []
    for i in range(n):
        parts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 60)))]
        if rng.random() < 0.5:
            s = rng.choice(shared).split()
            a = rng.randint(0, 30)
            parts.append(" ".join(s[a : a + rng.randint(30, 70)]))
        out.append((i * 2, rng.choice(["\n", " ", "\t "]).join(parts)))
    return [*out, (500, None), (501, ""), (502, " \n "), (503, out[3][1]), (504, "same " * 300), (505, "same " * 120)]


def frame(spark, rows, extra="n_words string, items int"):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"doc_id long, text string, {extra}").repartition(3)


def test_substrings_like_brute_force(spark):
    rows = corpus()
    window, first = 50, {}
    split = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for i, t in rows}
    for i in sorted(split):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k : k + window]), i)
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, words in split.items():
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone |= set(range(k, k + window))
        assert (got[i].n_words, got[i].n_removed) == (len(words), len(gone))
        if gone:
            assert got[i].text == " ".join(w for k, w in enumerate(words) if k not in gone)
        else:
            assert got[i].text == dict(rows)[i]
    assert any(r.n_removed for r in got.values())


def test_substrings_of_odd_rows(spark):
    text = " ".join(map(str, range(80)))
    rows = [(None, text), (4, text), (4, text), (9, text)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect())
    assert got == [(-1, 0), (4, 0), (4, 0), (9, 80)]
    assert substring_dedup.dedup_substrings(frame(spark, rows).limit(0)).count() == 0
    # rows that share an id and have other texts are each judged by their own
    long = " ".join(f"l{i}" for i in range(200))
    rows = [(1, long), (5, f"x y z {long}"), (5, "tiny text"), (5, " ".join(f"m{i}" for i in range(220))), (6, " ".join(f"m{i}" for i in range(100, 220)))]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect())
    assert got == [(1, 200, 0), (5, 2, 0), (5, 203, 200), (5, 220, 0), (6, 120, 120)]


def test_lines_of_repeated_ids_like_sql(spark, tmp_path):
    import duckdb

    line = "a line that is long enough to be counted, and repeated"
    rows = [(1, line)] * 5 + [(7, f"{line}\nown"), (7, "other"), (8, None)]
    docs = frame(spark, rows).select("doc_id", "text")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    out = line_dedup.dedup_lines(docs, n_batches=3)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, sha(r.text or "")) for r in out.collect()) == sorted(duckdb.sql(line_dedup.SQL).fetchall())


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_lines_like_brute_force(spark, batches):
    rng = random.Random(8)
    lines = [f"  Line number {i} of the shared ones, long enough to count " for i in range(6)] + ["short", "", "ÄÖ" * 30]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 6)) + [f"a line that document {i} alone has, long enough"])) for i in range(40)] + [(90, None), (91, ""), (92, "\n\n")]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(i)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows), n_batches=batches).collect()}
    for i, t in rows:
        own = (t or "").split("\n")
        left = [x for x in own if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != i)]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(own), len(own) - len(left), "\n".join(left))
    assert sum(r.n_dropped for r in got.values()) > 20


def test_lines_of_odd_rows(spark):
    line = "this line is long enough to be a key of the operator"
    rows = [(None, line)] * 2 + [(1, line), (2, line), (7, line), (7, line)]
    got = sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == [(0, 1), (0, 1), (1, 1), (2, 1), (7, 0), (7, 0)]
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(fanout=2)
    for ids in ([9, 8], [7, 6], [5], [4]):
        runs.add(spark.createDataFrame([(i, b"k") for i in ids] + [(ids[0], bytes([ids[0]]))], "doc_id long, key binary"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    rows = {bytes(r.key): (r.n_docs, r.holder) for r in runs.all().collect()}
    assert rows[b"k"] == (6, 9) and rows[bytes([5])] == (1, 5)


def hits(words, items, n=13):
    hit, found = set(), set()
    for item, own in items:
        k = min(n, len(own))
        wins = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1) if k else ():
            if tuple(words[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return hit, sorted(found)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 150])
def test_decontamination_like_brute_force(spark, slice_bytes):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([3, 13, 20])))) for i in range(8)] + [(20, ""), (21, None), (None, "w1 w2"), (3, "W1, w2 w3!")]
    rows = [(i, rng.choice(["", "Xé "]) + " ".join(rng.choices(WORDS, k=30)) + rng.choice([" ", ", "]) + (rng.choice(items[:8])[1].upper() if rng.random() < 0.6 else "") + " tail") for i in range(40)] + [(80, None), (81, ""), (82, "w1 w2 w3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = {r.doc_id: r for r in decontaminate.decontaminate(frame(spark, rows), bench, slice_bytes=slice_bytes, clean=True).collect()}
    for i, t in rows:
        words = split(t)
        hit, found = hits(words, [(k, split(x)) for k, x in items if k is not None])
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(words), len(hit), found, len(hit) > 0 and 20 * len(hit) >= len(words))
        assert t is None or split(r.clean_text) == [w for k, w in enumerate(words) if k not in hit]
    assert any(r.n_hit for r in got.values())
    assert decontaminate.decontaminate(frame(spark, rows), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(frame(spark, rows).limit(0), bench).count() == 0


def test_merkle(spark):
    rows = [(None, "zero"), (3, "a b\nc d e f g h i j k l"), (3, "a b"), (7, None), (8, ""), (20, "x" * 50_000), (21, "ÄÖÜ🙂\n\n  \nend ")]
    got = merkle.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), ranges=3).collect()
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    want = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        want[i, len(t)] = sha(t[: len(t) - h] + nxt[:h])
    assert {(r.doc_id, r.n_chars): r.edited_sha256 for r in got} == want
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[7, 0].fingerprint == by[8, 0].fingerprint and by[7, 0].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = merkle.fingerprints(spark.createDataFrame([(1, "only one")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    assert merkle.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merkle_locates_edits(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("p one\np two\np three", "p one\np 2\np three")], "s string, t string")
    df = merkle.tree(merkle.tree(df, "s", "a"), "t", "b")
    r = df.select(merkle.edits("a", "b").alias("e"), (F.col("a_root") == F.col("b_root")).alias("same")).first()
    assert r.e == [1] and not r.same


def test_preferences(spark):
    ddl = "pair_id long, turn int, role string, text string"
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes <|im_end|>"), (2, 0, "user", "a"), (3, 0, "user", "only"), (None, 0, None, None)]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"), (2, 0, "user", "a"), (4, 0, "user", "other")]
    out = {r.pair_id: r for r in preferences.preference_format(preferences.pair_up(spark.createDataFrame(chosen, ddl), spark.createDataFrame(rejected, ddl))).collect()}
    assert out[1].n_prefix == 1 and out[1].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert out[1].chosen == "<|im_start|>assistant\nyes < |im_end|><|im_end|>\n"
    for side in ("chosen", "rejected"):
        assert all(len(r[side]) == len(r[f"{side}_mask"]) for r in out.values())
    trained = "".join(c for c, m in zip(out[1].rejected, out[1].rejected_mask) if m == "1")
    assert trained == "no<|im_end|>"
    assert out[2].chosen == out[2].rejected == "" and out[2].n_prefix == 1
    assert out[3].rejected == "" and out[4].chosen == "" and out[3].n_prefix == 0 and len(out) == 5
    empty = spark.createDataFrame([], ddl)
    assert preferences.preference_format(preferences.pair_up(empty, empty)).count() == 0


def near_truth(rows, threshold=0.8):
    """Classes of all pairs by tuples of words, without anything of the operator's."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    tf = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for w in words]
    df = Counter(x for own in tf for x in own)
    weight = [{x: (1 + math.log(c)) * math.log1p(len(rows) / df[x]) for x, c in own.items()} for own in tf]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            low = sum(min(w, weight[b][x]) for x, w in weight[a].items() if x in weight[b])
            high = sum(weight[a].values()) + sum(weight[b].values()) - low
            if words[a] == words[b] or high and low / high >= threshold:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    out = {}
    for k, (i, _) in enumerate(rows):
        out[i] = min(least[find(k)], out.get(i, i))
    return out


def test_near_classes_like_brute_force(spark):
    rng = random.Random(11)
    base = [" ".join(f"v{rng.randint(0, 900)}" for _ in range(120)) for _ in range(12)]
    rows = []
    for i in range(90):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6, 30])):
            words[rng.randrange(len(words))] = f"z{rng.randint(0, 9999)}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "?!"), (203, "one two"), (204, "One, two."), (205, "De " * 4000), (206, "De " * 3900)]
    rows += [(300, base[0]), (300, base[1]), (300, "a text that shares its id with two others")]
    got = {r["doc_id"]: r["class"] for r in near_dedup.near_classes(frame(spark, rows)).collect()}
    assert got == near_truth(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("talus_")]
    assert got[200] == got[201] == got[202] == 200 and got[203] == got[204]


def test_near_dedup_keeps_one_of_each(spark):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g!"), (9, "else"), (None, "a b c d e f g")]
    assert sorted((r.doc_id or -1) for r in near_dedup.dedup(frame(spark, rows)).collect()) == [-1, 3, 9]
    assert near_dedup.near_classes(frame(spark, rows).limit(0)).count() == 0


def test_consistent_sampling_estimates_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(0)
    s = near_dedup.Sampler(1.0, samples=3000)
    for shared in (30, 60, 95):
        a = np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:shared], rng.integers(0, 1 << 63, 100 - shared, dtype=np.uint64)]))
        wa, wb = np.where(a % np.uint64(3) == 0, 2.5, 1.0), np.where(b % np.uint64(3) == 0, 2.5, 1.0)
        assert abs((s(a, wa) == s(b, wb)).mean() - near_dedup.similarity(a, wa, b, wb)) < 0.04
