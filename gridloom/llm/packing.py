"""Token packing by best-two-fit.

Every document is tokenised once. Pieces of the full length are sequences of
their own; the shorter ones, at most one for each document, are dealt round
robin into groups of a bounded size, so that each group holds a fair sample of
the lengths, and each group is packed by itself: a bin takes the largest piece
that fits until none does, then its smallest piece gives way to two unpacked
ones that fill the gap so opened more tightly.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import durable, id_and_text, mapped
from gridloom.llm.merges import Memory, MergeRounds

CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs, about.
GROUP_PIECES = 32_768
#: Parts of texts whose ids a worker remembers at most, and the longest of them.
CACHED_PARTS, CACHED_CHARS = 500_000, 64
#: Characters that are cut into parts at once.
SLICE_CHARS = 1 << 21
#: Characters of Latin scripts end here; texts with others are taken word by word.
_LATIN_END = 0x250


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


_BLANK, _LETTER, _DIGIT, _SIGN = range(4)


def latin_kinds() -> np.ndarray:
    """What a lower-cased Latin character is to the tokenizer's pattern, by its code point."""
    known = {x for c in range(_LATIN_END) for x in chr(c).lower()}  # a few small letters lie beyond
    kinds = np.full(1 + max(map(ord, known)), _SIGN, dtype=np.uint8)
    for c in known:
        kinds[ord(c)] = {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(c)[0], _SIGN)
    kinds[[*range(9, 14), 0x20, 0x85, 0xA0]] = _BLANK
    return kinds


def _cut(text: str) -> Iterator[str]:
    """A text in parts of SLICE_CHARS characters, each up to the next blank."""
    at = 0
    while at < len(text):
        blank = text.find(" ", at + SLICE_CHARS)
        end = len(text) if blank < 0 else blank
        yield text[at:end]
        at = end


class PartTable:
    """Ids of the parts met lately, found by a 64-bit hash of the part and compared by its characters."""

    def __init__(self, most: int):
        self.most, self.batch = most, 0
        self.keys, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.codes, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for those without ids, -2 where another part has the key.

        The parts' characters are the runs of ``codes`` at ``begin``, of ``size``.
        """
        self.batch += 1
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at = np.where(self.keys[at] == keys, at, -1)
        hit = np.flatnonzero(at >= 0)
        same = equal_runs(codes, begin[hit], size[hit], self.codes, self.begin[at[hit]], self.size[at[hit]])
        self.used[at[hit[same]]] = self.batch
        at[hit[~same]] = -2
        return at

    def add(self, keys: np.ndarray, codes: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Keeps new ``keys``; with more than ``most`` of them those used longest ago go."""
        keys, used = np.r_[self.keys, keys], np.r_[self.used, np.full(len(keys), self.batch)]
        first, count = np.r_[self.first, len(self.ids) + np.cumsum(count) - count], np.r_[self.count, count]
        begin, size = np.r_[self.begin, len(self.codes) + np.cumsum(size) - size], np.r_[self.size, size]
        ids, codes = np.r_[self.ids, ids], np.r_[self.codes, codes]
        if len(keys) > self.most:
            stay = np.sort(np.argsort(-used, kind="stable")[: self.most // 2])
            keys, used, first, count, begin, size = (x[stay] for x in (keys, used, first, count, begin, size))
            ids, codes = ids[spread(first, count)], codes[spread(begin, size)]
            first, begin = np.cumsum(count) - count, np.cumsum(size) - size
        by = np.argsort(keys)
        self.keys, self.used, self.first, self.count, self.begin, self.size = (x[by] for x in (keys, used, first, count, begin, size))
        self.ids, self.codes = ids, codes


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``first`` and are ``count`` long."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(count.sum())


def equal_runs(a: np.ndarray, at_a: np.ndarray, size_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which runs of ``a`` equal those of ``b``; none is empty."""
    same = size_a == size_b
    own = np.flatnonzero(same)
    if len(own):
        size = size_a[own]
        alike = a[spread(at_a[own], size)] == b[spread(at_b[own], size)]
        same[own] = np.logical_and.reduceat(alike, np.cumsum(size) - size)
    return same


class WordEncoder:
    """Ids of texts under a byte-level BPE that drops white space and case.

    Such a tokenizer cuts a text into parts (contractions, runs of letters,
    single digits, runs of other signs) and encodes each by itself. The texts of
    a batch are cut in one array; parts met lately are remembered, new ones are
    merged together. A text with characters beyond Latin scripts, or with the
    name of a special token, is parted at its white space first, and only the
    words that have such go through the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(Path(path).read_text())
        special = [re.escape(x["content"]) for x in model["added_tokens"]]
        normalizers = [x["type"] for x in model["normalizer"]["normalizers"]]
        if normalizers != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"no rule for parts under {normalizers}")
        self.foreign = re.compile("|".join([f"[^\0-{chr(_LATIN_END - 1)}]", *special])).search
        suffix, vocab = model["model"]["end_of_word_suffix"], model["model"]["vocab"]
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], dtype=np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.rounds = MergeRounds({(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)})
        self.kinds = latin_kinds()
        draw = np.random.default_rng(0)
        self.noise = draw.integers(1 << 63, size=len(self.kinds), dtype=np.uint64)
        self.step = draw.integers(1 << 62, dtype=np.uint64) * np.uint64(4) + np.uint64(3)
        self.known, self.foreign_words = PartTable(CACHED_PARTS), Memory(CACHED_PARTS)

    def _starts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which characters begin a part, and which are in one; the last four must be blanks."""
        kind = self.kinds[codes]
        inside = kind != _BLANK
        start = inside.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        q = np.flatnonzero((codes == ord("'")) & start)
        a, b = codes[q + 1], codes[q + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for at, size in ((q[one], 2), (q[two], 3)):
            start[at + 1] = False
            start[at + size] = inside[at + size]
        return start, inside

    def _merged(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and how many each has."""
        raw = [p.encode() for p in parts]
        sizes = np.array([len(x) for x in raw])
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[flat[ends - 1]]
        ids, n = self.rounds.merge(symbols, sizes)
        return ids.astype(np.uint32), n

    def _latin(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of Latin characters."""
        lower = [t.lower() for t in texts]
        joined = " ".join([*lower, "   "])
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        start, inside = self._starts(codes)
        at = np.flatnonzero(start)
        if not len(at):
            return [b""] * len(texts)
        size = np.add.reduceat(inside, at, dtype=np.int64)
        flat = codes[inside]
        first = np.cumsum(size) - size
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size.max() - 1, self.step)])
        place = np.arange(len(flat)) - np.repeat(first, size)
        key = np.add.reduceat(self.noise[flat] * power[place], first)
        keys, one, of = np.unique(key, return_index=True, return_inverse=True)
        # Parts are the same only where their characters are, whatever their hashes.
        of_same = one[of]
        twin = np.minimum(np.repeat(first[of_same], size) + place, len(flat) - 1)
        odd = np.flatnonzero(~np.logical_and.reduceat(flat[twin] == flat, first) | (size != size[of_same]))
        found = self.known.find(keys, flat, first[one], size[one])
        new = np.flatnonzero(found < 0)
        ids, begin, count = self.known.ids, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        old = found >= 0
        begin[old], count[old] = self.known.first[found[old]], self.known.count[found[old]]
        if len(new):
            begins, sizes = at[one[new]], size[one[new]]
            own, n = self._merged([joined[a : a + k] for a, k in zip(begins.tolist(), sizes.tolist(), strict=True)])
            begin[new], count[new] = len(ids) + np.cumsum(n) - n, n
            ids = np.r_[ids, own]
            short = (sizes <= CACHED_CHARS) & (found[new] == -1)
            kept = one[new][short]
            self.known.add(keys[new][short], flat[spread(first[kept], size[kept])], size[kept], own[np.repeat(short, n)], n[short])
        begin, count = begin[of], count[of]
        if len(odd):
            own, n = self._merged([joined[a : a + k] for a, k in zip(at[odd].tolist(), size[odd].tolist(), strict=True)])
            begin[odd], count[odd] = len(ids) + np.cumsum(n) - n, n
            ids = np.r_[ids, own]
        out = ids[spread(begin, count)].astype("<u4").tobytes()
        # The parts before the end of each text, and the ids of these.
        ends = np.cumsum([len(t) + 1 for t in lower])
        stops = np.r_[0, np.cumsum(4 * count)][np.searchsorted(at, ends)].tolist()
        return [out[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _near(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, some SLICE_CHARS characters at a time; longer texts are cut at blanks."""
        held: list[str] = []
        size = 0
        for text in texts:
            if len(text) > SLICE_CHARS:
                yield from self._latin(held)
                held, size = [], 0
                yield b"".join(self._latin([part])[0] for part in _cut(text))
                continue
            if size + len(text) > SLICE_CHARS:
                yield from self._latin(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        yield from self._latin(held)

    def _library(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plan: list[list[tuple[bool, str]]] = []
        for text in texts:
            if not text or text.isascii() and "<|" not in text or not self.foreign(text):
                plan.append([(False, text or "")])
            else:
                words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                runs = groupby(words, lambda w: bool(self.foreign(w)))
                plan.append([x for far, run in runs for x in ([(True, w) for w in run] if far else [(False, " ".join(run))])])
        near = self._near([t for own in plan for far, t in own if not far])
        words = self.foreign_words.missing({t for own in plan for far, t in own if far})
        other = self.foreign_words.young
        other.update((w, self._library(w)) for w in words)
        out = [b"".join(other[t] if far else next(near) for far, t in own) for own in plan]
        for w in words:
            if len(w) > CACHED_CHARS:
                del other[w]
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """One encoder for a worker, so that later tasks find its parts known."""
    return WordEncoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids, END_ID added, cut at CAPACITY.

    A null text counts as empty: one piece with END_ID alone.
    """

    def run(texts: list[str | None]) -> dict[str, list[int]]:
        end, step = np.array([END_ID], dtype="<u4").tobytes(), 4 * CAPACITY
        out: dict[str, list[int]] = {k: [] for k in ("rows", "piece", "start", "length", "ids_crc32")}
        for k, ids in enumerate(encoder_of(tokenizer_path).encode_batch(texts)):
            ids += end
            for j, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                for column, value in zip(out.values(), (k, j, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    column.append(value)
        return out

    schema = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}
    return mapped(id_and_text(docs, id_col, text_col), run, schema)


class _Lengths:
    """The lengths still unpacked: distinct values in order, and their counts."""

    def __init__(self, lengths: np.ndarray):
        values, counts = np.unique(lengths, return_counts=True)
        self.values = values.tolist()
        self.count = dict(zip(self.values, counts.tolist(), strict=True))

    def take(self, value: int) -> None:
        self.count[value] -= 1
        if not self.count[value]:
            del self.values[bisect_right(self.values, value) - 1]

    def put_back(self, value: int) -> None:
        if not self.count[value]:
            self.values.insert(bisect_right(self.values, value), value)
        self.count[value] += 1

    def largest(self, most: int) -> int:
        at = bisect_right(self.values, most)
        return self.values[at - 1] if at else 0

    def best_two(self, most: int) -> tuple[int, int]:
        """Two lengths with the largest sum up to ``most``; (0, 0) if none."""
        values = np.array(self.values[: bisect_right(self.values, most)])
        if not len(values):
            return 0, 0
        at = np.searchsorted(values, most - values, side="right") - 1
        # A length may pair with itself only if two are left.
        own = (at == np.arange(len(values))) & np.array([self.count[v] < 2 for v in values.tolist()])
        at = np.where(own, at - 1, at)
        total = np.where(at >= 0, values + values[at], 0)
        best = int(total.argmax())
        return (int(values[best]), int(values[at[best]])) if total[best] else (0, 0)


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins, each a list of lengths that together are ``lengths``."""
    left, bins = _Lengths(lengths), []
    while left.values:
        chosen, gap = [], capacity
        while value := left.largest(gap):
            left.take(value)
            chosen.append(value)
            gap -= value
        while gap and left.values:
            smallest = min(chosen)
            a, b = left.best_two(gap + smallest)
            if a + b <= smallest:
                break
            chosen.remove(smallest)
            left.take(a)
            left.take(b)
            left.put_back(smallest)
            chosen += [a, b]
            gap += smallest - a - b
        bins.append(sorted(chosen, reverse=True))
    return bins


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, done = TaskContext.get().partitionId(), 0

    def packed(pieces: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal done
        # The order of arrival plays no part, so a task that runs again packs alike.
        pieces = pieces.sort_by([(k, "ascending") for k in ("length", "id", "piece", "ids_crc32")])
        length = pieces["length"].to_numpy()
        bins = best_two_fit(length)
        flat = np.fromiter((v for b in bins for v in b), dtype=np.int64, count=len(length))
        of = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        end = np.cumsum(flat)
        first = np.r_[0, np.flatnonzero(np.diff(of)) + 1]
        offset = end - flat - (end - flat)[first][of]
        # The k-th place for a length goes to the k-th piece of that length.
        place = np.argsort(flat, kind="stable")
        pieces = pieces.append_column("sequence_id", pa.array(2 * ((part << 33) + done + of[place]) + 1))
        pieces = pieces.append_column("offset", pa.array(offset[place]))
        done += len(bins)
        yield from pieces.to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= 2 * GROUP_PIECES:
            yield from packed(pa.Table.from_batches(held))
            held = []
    if held:
        yield from packed(pa.Table.from_batches(held))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    Pieces of one sequence lie end to end from offset 0 and hold at most
    CAPACITY tokens together. Repeated rows are packed as often as they come;
    a null id is kept; an empty table gives no row. Other columns are ignored.
    """
    pieces = durable(token_pieces(docs, tokenizer_path, id_col, text_col))
    full = pieces.where(F.col("length") == CAPACITY).select(
        "*", (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < CAPACITY)
    groups = max(1, -(-rest.count() // GROUP_PIECES))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.schema)
    return full.unionByName(rest.repartition(groups).mapInArrow(_pack, schema))


def packed_tables(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each sequence: its id, tokens used, and pieces in order."""
    placed = pack(docs, tokenizer_path, id_col, text_col)
    piece = F.struct("offset", "id", "piece", "start", "length")
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"), F.sort_array(F.collect_list(piece)).alias("pieces")
    )
