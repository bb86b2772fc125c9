"""BPE encoding and decoding with a contiguous rank array.

A short word is held as the list of its parts and the list of the ranks of adjacent pairs. The smallest rank is
searched by a scan, the boundary between its two parts deleted, and the ranks on either side refreshed, until no pair can
merge. Words of one length are the columns of such arrays and merge together, one pair each at a time; fewer than FEW are
taken one by one. Words of more than SCAN_PARTS parts take a heap over a linked list instead, which merges in the same order
without quadratic time. Pieces between white space are numbered as they come and cached by each worker; the cache is emptied
after a batch that leaves more than CACHE pieces or 16 times as many letters or ids, and within one beyond twice as many pieces.

It reads tokenizer files of this make: NFC, white space, lower case; a split pattern; byte level; BPE with word ends. Others
raise ValueError.

Results that are defined here: a null or empty text has no ids and decodes to the empty text; null ids decode to the empty text.
Special tokens in a text are found as the file says. A column named like a new one is replaced.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import caches, extend, table, tidy

SCAN_PARTS = 64
CACHE = 400_000
FEW = 24
#: Runs of ids that are put together at once, which bounds the memory of their places.
RUNS = 1 << 17
_NONE = 1 << 40
#: White_Space of Unicode; Python's isspace() has four more.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else one from 256 on, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def classes() -> dict[str, str | dict[str, str]]:
    """Of \\p{L} and \\p{N} as the tokenizers library has them, whose Unicode is not Python's: ranges of letters for a set of the re module. lower: lower case of letters for which Python has another one."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
    code, out = np.concatenate([np.arange(1, 0xD800), np.arange(0xE000, 0x110000)]), {}
    for name in ("\\p{L}", "\\p{N}"):
        rest = [at for _, at in pre_tokenizers.Split(Regex(f"{name}+"), "removed").pre_tokenize_str(every)]
        starts, stops = [0, *(b for _, b in rest)], [*(a for a, _ in rest), len(every)]
        runs = [(code[a], code[b - 1]) for a, b in zip(starts, stops, strict=True) if a < b]
        out[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    lower = normalizers.Lowercase().normalize_str("\n".join(every)).split("\n")
    plain = "\n".join(every).split("\n")
    out["lower"] = {a: b for a, b in zip(plain, lower, strict=True) if a.lower() != b}
    return out


def _taken(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after another."""
    out, so_far = np.empty(int(sizes.sum()), flat.dtype), 0
    for k in range(0, len(sizes), RUNS):
        n = sizes[k : k + RUNS]
        ends = np.cumsum(n)
        at = np.repeat(starts[k : k + RUNS] - ends + n, n)
        at += np.arange(len(at))
        out[so_far : so_far + len(at)] = flat[at]
        so_far += len(at)
    return out


def _sums(sizes: np.ndarray, counts: Iterable[int]) -> np.ndarray:
    """Sums of as many sizes as counts say, one after another."""
    return np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *counts])])


class Ranks:
    """Ranks of pairs of ids, by open addressing, for whole arrays."""

    def __init__(self, ranks: dict[int, int]):
        self.bits = max(8, (4 * len(ranks)).bit_length())
        self.keys = np.full(1 << self.bits, -1)
        self.ranks = np.full(1 << self.bits, -1, np.int32)
        left, value = np.array([*ranks], np.int64), np.array([*ranks.values()], np.int32)
        at = self._home(left)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]], self.ranks[at[free]] = left[free], value[free]
            lost = self.keys[at] != left  # one got the place, if it was free
            left, value, at = left[lost], value[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1: no such pair."""
        keys = (a.astype(np.int64) << 20 | b).ravel()
        at = self._home(keys)
        there, out = self.keys[at], self.ranks[at]
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            there[rest], out[rest] = self.keys[at[rest]], self.ranks[at[rest]]
            rest = rest[(there[rest] != keys[rest]) & (there[rest] >= 0)]
        return out.reshape(a.shape)


class Bpe:
    def __init__(self, text: str, letters: dict[str, str | dict[str, str]] | None = None):
        """letters: those of classes(), by default made here."""
        letters = letters or classes()
        spec = json.loads(text)
        model, steps = spec["model"], (spec.get("normalizer") or {}).get("normalizers", [])
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError("a tokenizer of another make")
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("added tokens of another make")
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if split["type"] != "Split" or not split["invert"] or level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"]:
            raise ValueError("a pre-tokenizer of another make")
        pattern = split["pattern"]["Regex"].replace("[^\\s", f"[^{_SPACE}")
        for name in ("\\p{L}", "\\p{N}"):
            pattern = pattern.replace(name, letters[name])
        if "\\p" in pattern:
            raise ValueError("a split pattern of another make")
        self.pattern = re.compile(f"{pattern}|\n")
        self.lower = str.maketrans(letters["lower"])
        self.strange = np.zeros(0x110000, bool)
        self.strange[[*map(ord, letters["lower"])]] = True
        self.spaces = re.compile(f"[{_SPACE}]+")
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + "</w>"] for c in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in reversed([*enumerate(pairs)])}
        self.made = [vocab[a + b] for a, b in pairs]
        self.table, self.all_made = Ranks(self.ranks), np.array(self.made, np.int32)
        self.all_inner, self.all_last = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        names = [self.tokens.get(i) for i in range(max(self.tokens, default=-1) + 1)]
        self.names, self.named = pa.array(names, pa.string()), np.array([x is not None for x in names], bool)
        self._empty()

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        parts = [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]
        if len(parts) > SCAN_PARTS:
            return self._long(parts)
        rank, made = self.ranks.get, self.made
        ranks = [rank(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (low := min(ranks)) != _NONE:
            i = ranks.index(low)
            parts[i] = made[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 20 | parts[i + 1], _NONE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if parts[i] < 0 or (j := after[i]) < 0 or rank(parts[i] << 20 | parts[j], _NONE) != r:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (q := rank(parts[a] << 20 | parts[after[a]], _NONE)) != _NONE:
                    heapq.heappush(heap, (q, a))
        return [p for p in parts if p >= 0]

    def _empty(self) -> None:
        """No piece is known but the special tokens, which have a blank before them, as no piece has."""
        self.cache: dict[str, int] = defaultdict(itertools.count().__next__)
        for x in self.special:
            self.cache[f" {x}"]
        self.ids = np.array([*self.special.values()], np.int32)
        self.starts, self.sizes = np.arange(len(self.special)), np.ones(len(self.special), np.int64)
        self.letters = 0

    def _column(self, parts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merges words of one length, which are columns: numbers of words and their ids, for those that end with as many parts."""
        out, at, rank = [], np.arange(parts.shape[1]), self.table.of
        none, places = 1 << 24, np.arange(len(parts), dtype=np.int32)[:, None]

        def keys(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:  # rank and place, so that the least is the leftmost
            found = rank(a, b)
            return np.where(found < 0, none, found) << 6 | place

        ranks = keys(parts[:-1], parts[1:], places[: len(parts) - 1])
        while len(parts) > 1 and len(at):
            low = ranks.min(axis=0)
            live = low < none << 6
            if not live.all():
                out.append((at[~live], parts[:, ~live]))
                at, parts, ranks, low = at[live], parts[:, live], ranks[:, live], low[live]
            n, i, columns = len(parts), low & 63, np.arange(len(at))
            parts[i, columns] = self.all_made[low >> 6]
            parts = np.where(places[: n - 1] > i, parts[1:], parts[:-1])
            ranks = np.where(places[: n - 2] < i, ranks[:-1], ranks[1:] - 1)
            for here in (i - 1, i):
                has = columns[(here >= 0) & (here < n - 2)]
                j = here[has]
                ranks[j, has] = keys(parts[j, has], parts[j + 1, has], j.astype(np.int32))
        return [*out, (at, parts)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all, and where each word's begin and how many they are. No word is empty or has a line feed."""
        raw = np.frombuffer("\n".join([*words, ""]).encode("utf-8"), np.uint8)
        ends = np.flatnonzero(raw == 10)
        begins = np.concatenate([[0], ends[:-1] + 1])
        length = ends - begins
        starts, sizes, flat, so_far = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        order = np.argsort(length, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            n = int(length[group[0]])
            if len(group) < FEW or n > SCAN_PARTS:
                done = [(group[k : k + 1], np.array(self.word(words[w]), np.int32)[:, None]) for k, w in enumerate(group)]
            else:
                letters = raw[begins[group] + np.arange(n)[:, None]]
                parts = np.concatenate([self.all_inner[letters[:-1]], self.all_last[letters[-1:]]])
                done = [(group[at], x) for at, x in self._column(parts)]
            for at, x in done:
                sizes[at], starts[at] = len(x), so_far + len(x) * np.arange(len(at))
                flat.append(x.T.ravel())
                so_far += x.size
        return np.concatenate(flat), starts, sizes

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces that just got the next numbers."""
        numbers: dict[str, int] = defaultdict(itertools.count().__next__)
        found = np.fromiter(map(numbers.__getitem__, ["\n", *self.pattern.findall("\n".join([*pieces, ""]))]), np.int64)
        marks = np.flatnonzero(found == 0)
        counts, found = np.diff(marks) - 1, found[found > 0] - 1
        ids, sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(found):
            ids, starts, sizes = self.words([*numbers][1:])
            ids, sizes = _taken(ids, starts[found], sizes[found]), sizes[found]
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, _sums(sizes, counts)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters += sum(map(len, pieces))

    def _pieces(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        if not text.isascii() and self.strange[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            text = text.translate(self.lower)
        text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        return text.split() if not _ODD.search(text) else [x for x in self.spaces.split(text) if x]

    def encode_all(self, texts: list[str | None]) -> pa.Array:
        """A list of ids for each text."""
        counts, slots, sizes, ids = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]

        def settle() -> None:
            if new := len(self.cache) - len(self.sizes):
                self._learn([*itertools.islice(reversed(self.cache), new)][::-1])
            at = np.concatenate([np.zeros(0, np.int64), *slots])
            slots.clear()
            sizes.append(self.sizes[at])
            ids.append(_taken(self.ids, self.starts[at], sizes[-1]))
            if len(self.cache) > CACHE or max(self.letters, len(self.ids)) > 16 * CACHE:
                self._empty()

        for text in texts:
            if not text:
                pieces = []
            elif self.marks is None or "<" not in text:
                pieces = self._pieces(text)
            else:
                pieces = [p for k, x in enumerate(self.marks.split(text)) for p in ([f" {x}"] if k % 2 else self._pieces(x))]
            counts.append(len(pieces))
            for k in range(0, len(pieces), CACHE):
                part = pieces[k : k + CACHE]
                slots.append(np.fromiter(map(self.cache.__getitem__, part), np.int64, len(part)))
                if len(self.cache) > 2 * CACHE:
                    settle()
        settle()
        ends = np.cumsum([0, *_sums(np.concatenate(sizes), counts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))

    def encode(self, text: str) -> bytes:
        """Ids of one text as 32-bit little-endian numbers, word by word; encode_all() is faster for many."""
        out = []
        for k, x in enumerate(self.marks.split(text) if self.marks else [text]):
            out += [self.special[x]] if k % 2 else [i for p in self._pieces(x) for w in self.pattern.findall(p) for i in self.word(w)]
        return np.array(out, "<i4").tobytes()

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """The text of each list of ids, as decode() gives it; of a null list the empty one."""
        codes = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        known = (codes >= 0) & (codes < len(self.named))
        known[known] = self.named[codes[known]]
        if not known.all():
            sizes, codes = _sums(known, sizes), codes[known]
        ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(ends, self.names.take(pa.array(codes))), " ")

    def decode(self, ids: list[int]) -> str:
        """Tokens with spaces between, as without a decoder; unknown ids are left out."""
        get = self.tokens.get
        return " ".join([t for t in map(get, ids) if t is not None])


_made: dict[str, Bpe] = {}
caches(__name__, _made.clear)


def bpe_of(text: str, letters: dict[str, str | dict[str, str]]) -> Bpe:
    """One for all tasks of a worker, so that its pieces are known to the next task."""
    if text not in _made:
        _made.clear()
        _made[text] = Bpe(text, letters)
    return _made[text]


def _extended(docs: DataFrame, tokenizer_path: str, columns: Callable[[Bpe, Callable[[str], pa.Array]], dict[str, pa.Array]], new: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with what columns gives for a batch, whose columns it gets by name."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast((f.read(), classes()))

    def make():
        bpe = bpe_of(*shipped.value)
        return lambda batch: columns(bpe, lambda name: batch.column(batch.schema.get_field_index(name)))

    return extend(docs, make, new, drop)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """docs with ids array<int>."""
    return _extended(tidy(docs), tokenizer_path, lambda bpe, of: {"ids": bpe.encode_all(of("text").to_pylist())}, "ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """encoded with decoded, the text of its ids."""
    return _extended(tidy(encoded), tokenizer_path, lambda bpe, of: {"decoded": bpe.decode_all(of("ids"))}, "decoded string")


def there_and_back(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """decode() of encode() without the text, in one pass: ids don't go from one worker to another to be decoded."""

    def columns(bpe: Bpe, of: Callable[[str], pa.Array]) -> dict[str, pa.Array]:
        ids = bpe.encode_all(of("text").to_pylist())
        return {"ids": ids, "decoded": bpe.decode_all(ids)}

    return _extended(tidy(docs), tokenizer_path, columns, "ids array<int>, decoded string", drop=("text",))


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    out = there_and_back(tidy(docs).select("doc_id", "text"), tokenizer_path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_tokenizer())
