"""Token ids in binary files of patched frame-of-reference blocks.

Documents are range-partitioned and sorted by doc_id, so each task writes one shard of ascending ids. A shard is a run of
segments: rows of a Parquet file, which any store can hold and whose writing survives lost tasks; the segment's payload
is the binary format of this module:

    header   "PFB1", count of values, values a block, count of blocks (little-endian 32 bits)
    index    the start of each block, from the payload's start (32 bits each)
    block    minimum (32 bits), width (8), 0 (8), count of exceptions (16); the differences from the minimum, packed at
             the width, most significant bit first; positions of exceptions (16 each); their differences (32 each)

The width is the least that holds PERCENTILE per cent of a block's differences; larger ones are exceptions, and 0 is packed in
their place. The last block is filled up with its first value. A segment also holds its documents' ids, where their tokens end, and
how many tokens of the shard come before.

Results that are defined here: a null or empty text has the end id alone; a null doc_id comes before all others; rows with the same
doc_id are ordered by text and each written; an empty table gives an empty file.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import caches, documents, map_arrow, shared, table

BLOCK = 256
PERCENTILE = 90
SEGMENT_TOKENS = 1 << 17
#: Word pieces that a task keeps with their ids.
CACHE = 1_000_000
#: Bytes of text whose distinct pieces are looked up together.
GATHERED = 16 << 20
END_ID = 0
SEGMENT = "shard int, segment long, before long, doc_ids array<long>, ends array<long>, payload binary"


def pack(values: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    values = np.asarray(values, np.uint32)
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return b"PFB1" + np.array([0, block, 0], "<u4").tobytes()
    grid = np.empty(blocks * block, np.uint32)
    grid[:n] = values
    grid[n:] = values[(blocks - 1) * block]
    grid = grid.reshape(blocks, block)
    least = grid.min(axis=1)
    grid = grid - least[:, None]
    k = max(0, -(-block * percentile // 100) - 1)
    widths = np.ceil(np.log2(np.partition(grid, k, axis=1)[:, k].astype(np.float64) + 1)).astype(np.uint8)
    over = (grid >> np.minimum(widths, 31)[:, None].astype(np.uint32) != 0) & (widths < 32)[:, None]
    size = 2 if int(widths.max(initial=0)) <= 16 else 4
    low = np.where(over, 0, grid).astype(f">u{size}")
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == w)
        bits = np.unpackbits(low[rows].view(np.uint8).reshape(len(rows), block, size), axis=2)[:, :, 8 * size - w :]
        for r, own in zip(rows.tolist(), np.packbits(bits.reshape(len(rows), block * w), axis=1), strict=True):
            packed[r] = own.tobytes()
    at, where = np.nonzero(over)
    counts = np.bincount(at, minlength=blocks)
    stops = np.cumsum(counts)
    where, what = where.astype("<u2"), grid[over].astype("<u4")
    heads = np.zeros(blocks, [("least", "<u4"), ("width", "u1"), ("zero", "u1"), ("count", "<u2")])
    heads["least"], heads["width"], heads["count"] = least, widths, counts
    body = [heads[i].tobytes() + packed[i] + where[e - c : e].tobytes() + what[e - c : e].tobytes() for i, (c, e) in enumerate(zip(counts.tolist(), stops.tolist(), strict=True))]
    starts = 16 + 4 * blocks + np.cumsum([0, *map(len, body[:-1])])
    return b"".join([b"PFB1", np.array([n, block, blocks], "<u4").tobytes(), starts.astype("<u4").tobytes(), *body])


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values of the blocks from first to last (exclusive), all by default; other blocks aren't touched."""
    if payload[:4] != b"PFB1":
        raise ValueError("not a payload of patched frame-of-reference blocks")
    n, block, blocks = np.frombuffer(payload, "<u4", 3, 4).tolist()
    last = blocks if last is None else min(last, blocks)
    if last <= first:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    starts = np.frombuffer(payload, "<u4", blocks, 16)[first:last].astype(np.int64)
    heads = np.ascontiguousarray(raw[starts[:, None] + np.arange(8)]).view([("least", "<u4"), ("width", "u1"), ("zero", "u1"), ("count", "<u2")])[:, 0]
    out = np.zeros((len(starts), block), np.uint32)
    for w in np.unique(heads["width"]).tolist():
        rows = np.flatnonzero(heads["width"] == w)
        if 0 < w <= 17:  # a value lies in three bytes
            bit = np.arange(block) * w
            own = raw[np.minimum((starts[rows] + 8)[:, None] + np.arange(-(-block * w // 8) + 2), len(raw) - 1)].astype(np.uint32)
            out[rows] = ((own[:, bit >> 3] << 16 | own[:, (bit >> 3) + 1] << 8 | own[:, (bit >> 3) + 2]) >> (24 - w - (bit & 7)).astype(np.uint32)) & ((1 << w) - 1)
        elif w:
            bits = np.unpackbits(raw[(starts[rows] + 8)[:, None] + np.arange(-(-block * w // 8))], axis=1)[:, : block * w].reshape(len(rows), block, w)
            full = np.zeros((len(rows), block, 32), np.uint8)
            full[:, :, 32 - w :] = bits
            out[rows] = np.packbits(full, axis=2).view(">u4")[:, :, 0]
    for r in np.flatnonzero(heads["count"]).tolist():
        c, at = int(heads["count"][r]), int(starts[r]) + 8 + -(-block * int(heads["width"][r]) // 8)
        out[r, np.frombuffer(payload, "<u2", c, at)] = np.frombuffer(payload, "<u4", c, at + 2 * c)
    return (out + heads["least"][:, None]).reshape(-1)[: min(n - first * block, out.size)]


def joined(ids: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs number at of ids, which has runs of these lengths one after another, and their lengths."""
    n = lengths[at]
    stops = np.cumsum(n)
    return ids[np.repeat((np.cumsum(lengths) - lengths)[at] - (stops - n), n) + np.arange(int(n.sum()))], n


class Known:
    """Distinct words as one Arrow array and their ids one after another: no Python object for each."""

    def __init__(self):
        self.words, self.ids, self.lengths = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each, -1 if it isn't there."""
        at = pc.index_in(words, value_set=self.words)
        return pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.words, self.ids, self.lengths = pa.concat_arrays([self.words, words]), np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])

    def keep(self, at: np.ndarray) -> None:
        """Those at these places alone."""
        self.ids, lengths = joined(self.ids, self.lengths, at)
        self.words, self.lengths = self.words.take(pa.array(at)), lengths


class Pieces:
    """Ids of texts by the tokenizers library, which gets each distinct word once. A text may be cut before a space or a line's end between two
    letters of other kinds than white space, and between a Latin letter and a mark before white space: there a new piece of the byte-level pattern begins whatever
    stands around it. Texts are cut, and words numbered and looked up, by Arrow. New words go to the library in long strings; their ids are told apart by the tokens that
    begin with a space, or are a line's end. Words of Latin letters alone are one piece whatever the pattern, so the library's model gets them without it."""

    # for Arrow; of the letters that str.isspace() knows
    _white = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
    _near = f"{_white} {_white}"
    _crowded = f"(?:^|{_white})\n|\n(?:{_white}|$)"
    _letter = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
    _safe = re.compile(r"(?<=\S) (?=\S)")
    _blank = re.compile(r"\s")

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.marks = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(["\n", ".", ","], add_special_tokens=False)]
        spec = json.loads(tokenizer)
        level = spec.get("pre_tokenizer") or {}
        self.model = None
        if level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space") and not spec.get("normalizer"):
            self.model = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}}))
            self.model.no_truncation()
            self.model.no_padding()
            self.model.model._resize_cache(0)  # each word comes once
            self.letters = {b: c for b, c in enumerate(byte_letters()) if b != 32}
        self.spaced, self.bare = Known(), Known()

    def _learn(self, words: pa.Array, known: Known, lead: str) -> np.ndarray:
        """The places of the distinct new words, whose ids with lead before them are put into known."""
        latin = pc.match_substring_regex(words, f"^{self._letter}+$").to_numpy(zero_copy_only=False) if self.model else np.zeros(len(words), bool)
        other = words.filter(pa.array(~latin)).to_pylist()
        odd = np.zeros(len(words), bool)
        odd[~latin] = [not w or bool(self._blank.search(w)) for w in other]
        ids, lengths, order = [], [], []

        def one_by_one(some: list[str]) -> None:
            for e in self.tokenizer.encode_batch_fast([lead + w for w in some], add_special_tokens=False):
                ids.append(np.array(e.ids, np.uint32))
                lengths.append(np.array([len(e.ids)]))

        for rows, simple in ((latin, True), (~latin & ~odd, False)):
            order.append(np.flatnonzero(rows))
            some = words.filter(pa.array(rows)).to_numpy(zero_copy_only=False).tolist()
            for k in range(0, len(some), 512):
                part = some[k : k + 512]
                if simple:
                    text = " ".join(part).encode().decode("latin-1").translate(self.letters)
                    text = "\u0120" + text.replace(" ", " \u0120") if lead else "\u010a " + text.replace(" ", " \u010a ")
                else:
                    text = lead + " ".join(part) if lead else "\n".join(["", *part])
                got = np.array((self.model if simple else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                opens = self.opens[got] if lead else got == self.marks[0][0]
                at = np.flatnonzero(opens)
                if len(at) != len(part) or at[0]:
                    one_by_one(part)
                else:
                    ids.append(got if lead else got[~opens])
                    lengths.append(np.diff(at, append=len(got)) - (not lead))
        order.append(np.flatnonzero(odd))
        one_by_one(words.filter(pa.array(odd)).to_pylist())
        order, places = np.concatenate(order), np.zeros(len(words), np.int64)
        places[order] = len(known) + np.arange(len(order))
        known.add(words.take(pa.array(order)), np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *lengths]))
        return places

    def _entries(self, entries: pa.Array, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and their lengths. bare: those without a space before them."""
        # lines of a piece: the first is as bare as the piece, the others follow a line's end
        lined = pc.and_(pc.match_substring(entries, "\n"), pc.invert(pc.match_substring_regex(entries, self._crowded)))
        cut = pc.split_pattern(entries.filter(lined), "\n")
        lined = lined.to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.concatenate([np.flatnonzero(~lined), np.repeat(np.flatnonzero(lined), sizes)])
        rank = np.concatenate([np.zeros(int((~lined).sum()), np.int64), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)])
        words = pa.concat_arrays([entries.filter(pa.array(~lined)), cut.flatten()])
        # a word of letters with . or , after it is the word's ids and the mark's
        marked = pc.match_substring_regex(words, f"^{self._letter}+[.,]$")
        mark = np.where(pc.ends_with(words, ".").to_numpy(zero_copy_only=False), 1, 2)
        words = pc.if_else(marked, pc.utf8_rtrim(words, ".,"), words)
        bare, place = bare[of] | (rank > 0), np.zeros(len(words), np.int64)
        for known, lead, rows in ((self.spaced, " ", ~bare), (self.bare, "", bare)):
            coded = pc.dictionary_encode(words.filter(pa.array(rows)))
            own = coded.dictionary
            at = known.find(own)
            if len(known) > CACHE:  # frequent words are among those of any batch
                known.keep(at[at >= 0])
                at = known.find(own)
            if (at < 0).any():
                at[at < 0] = self._learn(own.filter(pa.array(at < 0)), known, lead)
            place[rows] = at[coded.indices.to_numpy()] + (0 if lead else len(self.spaced))
        ids = np.concatenate([self.spaced.ids, self.bare.ids, *self.marks])
        lengths = np.concatenate([self.spaced.lengths, self.bare.lengths, [len(m) for m in self.marks]])
        line = len(lengths) - 3
        parts = np.stack([np.where(rank > 0, line, -1), place, np.where(marked.to_numpy(zero_copy_only=False), line + mark, -1)], axis=1)
        parts, of = parts[(order := np.argsort(of, kind="stable"))], of[order]
        there = parts >= 0
        out, n = joined(ids, lengths, parts[there])
        for known in (self.spaced, self.bare):
            long = pc.greater(pc.utf8_length(known.words), 64)
            if pc.any(long).as_py():
                known.keep(np.flatnonzero(~long.to_numpy(zero_copy_only=False)))
        return out, np.bincount(np.repeat(of, there.sum(axis=1)), weights=n, minlength=len(entries)).astype(np.int64)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, with end_id after each, and the count of each text's."""
        near = pc.match_substring_regex(texts, self._near).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts.cast(pa.large_string()), " ")
        flat, sizes, order = cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64), None
        if near.any():
            apart = [self._safe.split(texts[i].as_py()) for i in np.flatnonzero(near).tolist()]
            starts, more = np.cumsum(sizes) - sizes, np.array([len(x) for x in apart])
            starts[near], sizes[near] = len(flat) + np.cumsum(more) - more, more
            flat = pa.concat_arrays([flat, pa.array([x for own in apart for x in own], pa.large_string())])
            order = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        words = pc.dictionary_encode(flat)
        at, names = words.indices.to_numpy().astype(np.int64), words.dictionary
        if order is not None:
            at = at[order]
        first = np.cumsum(sizes) - sizes  # of each text: it has no space before it
        heads, which = np.unique(at[first], return_inverse=True)
        ids, lengths = self._entries(pa.concat_arrays([names, names.take(pa.array(heads))]), np.arange(len(names) + len(heads)) >= len(names))
        at[first] = len(names) + which
        if end_id is not None:
            at, sizes = np.insert(at, first + sizes, len(lengths)), sizes + 1
            ids, lengths = np.append(ids, np.uint32(end_id)), np.append(lengths, 1)
        out, n = joined(ids, lengths, at)
        return out, np.diff(np.cumsum(n)[np.cumsum(sizes) - 1], prepend=0)


_pieces: dict[str, Pieces] = {}
caches(__name__, _pieces.clear)


def pieces_of(tokenizer: str) -> Pieces:
    """One for all tasks of a worker, so that its pieces are known to the next task."""
    if tokenizer not in _pieces:
        _pieces.clear()
        _pieces[tokenizer] = Pieces(tokenizer)
    return _pieces[tokenizer]


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, partitions: int | None = None, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The segments of docs, a shard for each task."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def make():
        from pyspark import TaskContext

        pieces, shard = pieces_of(shipped.value), TaskContext.get().partitionId()
        state = {"segment": 0, "before": 0}

        def f(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("shard", "segment", "before", "doc_ids", "ends", "payload")}
            ids, counts = pieces.encode(batch.column(1), end_id)
            doc_ids, ends = batch.column(0).to_pylist(), np.cumsum(counts)
            i, done = 0, 0
            while i < len(doc_ids):  # a segment ends with the document that fills it
                j = min(int(np.searchsorted(ends, done + segment_tokens)) + 1, len(doc_ids))
                stop = int(ends[j - 1])
                out["shard"].append(shard)
                out["segment"].append(state["segment"])
                out["before"].append(state["before"])
                out["doc_ids"].append(doc_ids[i:j])
                out["ends"].append((ends[i:j] - done).tolist())
                out["payload"].append(pack(ids[done:stop]))
                state["segment"] += 1
                state["before"] += stop - done
                i, done = j, stop
            return out

        return f

    return map_arrow(ordered, make, SEGMENT, least_bytes=GATHERED)


def write(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    encode(docs, tokenizer_path, **options).write.option("compression", "uncompressed").parquet(path)


def shard_starts(segments: DataFrame) -> DataFrame:
    """shard and shard_start, the tokens of the shards before it: a row for each task that wrote, so one window is enough."""
    by = segments.groupBy("shard").agg(F.min(F.col("doc_ids")[0]).alias("least"), F.max(F.col("before") + F.element_at("ends", -1)).alias("n"), F.max(F.col("doc_ids")[0].isNull()).alias("null_id"))
    before = Window.orderBy(F.col("null_id").desc(), "least", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return by.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def read(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, tokens (as 32-bit little-endian numbers), decoded from the files."""
    segments = spark.read.schema(SEGMENT).parquet(path)

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", *(["tokens"] if tokens else []))}
            for start, before, ids, ends, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                raw, a = unpack(payload).astype("<u4").tobytes(), 0
                for doc_id, e in zip(ids, ends, strict=True):
                    own = raw[4 * a : 4 * e]
                    out["doc_id"].append(doc_id)
                    out["start"].append(start + before + a)
                    out["n_tokens"].append(e - a)
                    out["ids_crc32"].append(zlib.crc32(own))
                    if tokens:
                        out["tokens"].append(own)
                    a = e
            return out

        return f

    rows = segments.join(F.broadcast(shard_starts(segments)), "shard").select("shard_start", "before", "doc_ids", "ends", "payload")  # a row for each shard
    return map_arrow(rows, make, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", tokens binary" * tokens)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_blocks(spark, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return read(spark, path, tokens=False)
