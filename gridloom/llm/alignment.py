"""Alignment of two tokenizers' tokens over the bytes of a text.

Both token lists end at byte offsets in order. Offsets at which tokens of both
end are found by galloping: the shorter list drives, each of its ends is sought
in the longer one by steps that double and a binary search of the last step.
These offsets cut the text into groups; within a group every token of one list
overlaps or borders the other's, and the places of the common ends in the two
lists (their ranks) give each group's ranges.

How many documents hold a pair of ids linked is counted over the corpus. Texts
are aligned once, in chunks; a chunk keeps its distinct pairs and, for each, the
documents that hold it, and the pairs' counts return to the chunks by a join. A
worker remembers the stretches between blanks that it has aligned lately.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WIDE_ROWS, discard, durable, id_and_text, mapped, small_batches
from gridloom.llm.merges import Memory
from gridloom.llm.packing import byte_letters, spread
from gridloom.llm.pieces import PieceCoder

#: Characters of text in a chunk, about, and of those that are aligned at once.
CHUNK_CHARS, SLICE_CHARS = 2 << 20, 1 << 19
#: Chunks in a row group of Parquet: its reader holds a whole group at once, and its writer what it has not yet written.
GROUP_CHUNKS = 2
#: Driving ends between two that are sought from the text's beginning.
STRIDE = 16
#: Stretches of texts whose byte-level ids a worker remembers at most, and the longest of them.
UNITS, UNIT_CHARS = 200_000, 64
#: Characters, and pairs, of the stretches that a worker remembers as aligned, about.
CACHED_CHARS = 2 << 20
#: Groups with more pairs than this are counted by their distinct ids.
WIDE_GROUP = 256
#: How the byte-level vocabulary's pre-tokenizer cuts a text: a fixed value.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these characters two libraries' tables of letters may differ.
_foreign = re.compile("[^\0-ɏ]").search


def _sizes(spelling: dict[int, bytes]) -> np.ndarray:
    """How many bytes each id has."""
    out = np.zeros(1 + max(spelling), np.int64)
    out[list(spelling)] = [len(s) for s in spelling.values()]
    return out


class BytePieces:
    """Ids of texts under a byte-level BPE, special tokens taken as plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        model = json.loads(Path(path).read_text())
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        special = {x["content"] for x in model["added_tokens"]}
        self.spelling: dict[int, bytes] = {i: bytes(map(byte_of.__getitem__, t)) for t, i in model["model"]["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        vocab = model["model"]["vocab"]
        made = [vocab[a + b] for a, b in merges]
        plain = model["pre_tokenizer"].get("type") == "ByteLevel" and not model["pre_tokenizer"]["add_prefix_space"] and not model["normalizer"]
        self.sizes = _sizes(self.spelling)
        self.known = Memory(UNITS)
        # Where merges rank as their results' ids do, ranks alone give the same ids, faster.
        self.quick = None
        if plain and made == sorted(made) and len(made) + 256 == len(self.spelling):
            self.quick = tiktoken.Encoding("pieces", pat_str=_PATTERN, mergeable_ranks={s: i for i, s in self.spelling.items()}, special_tokens={})

    def _quick(self, text: str) -> bytes:
        return np.array(self.quick.encode_ordinary(text), dtype="<u4").tobytes()

    def cuttable(self, text: str) -> bool:
        """Whether the ids of a text are those of its stretches between blanks, each with a blank before it."""
        return not (self.quick is None or "  " in text or text[0] == " " or text[-1] == " " or not text.isascii() and _foreign(text))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of stretches of cuttable texts, encoded as one text of them; they are not remembered."""
        if any(w[0].isspace() or w[-1].isspace() for w in words):
            inner = [w for w in words if not (w[0].isspace() or w[-1].isspace())]
            known = dict(zip(inner, self.encode_words(inner), strict=True))
            return [known[w] if w in known else self._quick(" " + w) for w in words]
        if not words:
            return []
        text = " " + " ".join(words)
        ids = np.array(self.quick.encode_ordinary(text), dtype="<u4")
        size = np.fromiter(map(len, text.encode("utf-8", "surrogatepass")[1:].split(b" ")), np.int64, len(words)) + 1
        ends, stop = np.cumsum(self.sizes[ids]), np.cumsum(size)
        last = np.searchsorted(ends, stop)
        if last[-1] >= len(ends) or (ends[last] != stop).any():
            return [self._quick(" " + w) for w in words]
        raw = ids.tobytes()
        return [raw[s:e] for s, e in zip([0, *(last[:-1] * 4 + 4).tolist()], (last * 4 + 4).tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text with a blank put before it.

        A blank begins a part of the text unless another one is beside it, so the
        stretches between single blanks are encoded by themselves, and those met
        lately are remembered.
        """
        out: list[bytes] = [b""] * len(texts)
        far, cut = [], {}
        for k, t in enumerate(texts):
            if self.quick is None or not t.isascii() and _foreign(t):
                far.append(k)
            elif "  " in t or t[0] == " " or t[-1] == " ":
                out[k] = self._quick(" " + t)
            else:
                cut[k] = t.split(" ")
        for k, e in zip(far, self.library.encode_batch([" " + texts[k] for k in far], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, dtype="<u4").tobytes()
        new = self.known.missing(set().union(*cut.values()))
        known = self.known.young
        known.update(zip(new, self.encode_words(new), strict=True))
        for k, units in cut.items():
            out[k] = b"".join(map(known.__getitem__, units))
        for u in new:
            if len(u) > UNIT_CHARS:
                del known[u]
        return out


class SentencePieces:
    """Ids of texts under a SentencePiece model, and the bytes of its pieces."""

    def __init__(self, path: str):
        self.coder = PieceCoder(path)
        self.spelling = dict(enumerate(self.coder.spelling))
        self.sizes = _sizes(self.spelling)

    def encode_words(self, words: list[str]) -> list[bytes]:
        return self.coder.encode_words(words)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, without those of its begin and end."""
        return [x[4:-4] for x in self.coder.encode_batch(texts)]


def gallop(short: np.ndarray, long: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each of ``short`` the place of the first of ``long`` in [first, end) that is no less; ``end`` if none is.

    Steps from ``first`` double until they pass the value, then the last step is halved.
    """
    low, step = first.copy(), np.ones(len(first), np.int64)
    # Everything before ``low`` is less; what is at ``high`` is not, or is the end.
    high = end.copy()
    going = np.flatnonzero(low < end)
    while len(going):
        at = low[going] + step[going] - 1
        inside = at < end[going]
        less = np.zeros(len(going), bool)
        less[inside] = long[at[inside]] < short[going[inside]]
        over = going[inside & ~less]
        high[over] = low[over] + step[over] - 1
        going = going[less]
        low[going] += step[going]
        step[going] *= 2
        going = going[low[going] < end[going]]
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        less = long[mid] < short[open_]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the ends they share, text by text.

    ``a`` and ``b`` hold the ends of all texts, which grow over the whole array;
    those of a text stop before ``ends_a`` and ``ends_b``.
    """
    if len(ends_a) and ((size_a := np.diff(ends_a, prepend=0)) > (size_b := np.diff(ends_b, prepend=0))).any():
        if (size_a >= size_b).all():
            x, y = common_ends(b, a, ends_b, ends_a)
            return y, x
        # Texts whose first list is the shorter one, then the others the other way round.
        swap = size_a > size_b
        out = []
        for other, which in ((False, ~swap), (True, swap)):
            pick_a, pick_b = spread((ends_a - size_a)[which], size_a[which]), spread((ends_b - size_b)[which], size_b[which])
            x, y = common_ends(*((b[pick_b], a[pick_a], np.cumsum(size_b[which]), np.cumsum(size_a[which])) if other else (a[pick_a], b[pick_b], np.cumsum(size_a[which]), np.cumsum(size_b[which]))))
            out.append((pick_a[y if other else x], pick_b[x if other else y]))
        x, y = (np.concatenate(z) for z in zip(*out, strict=True))
        by = np.argsort(x)
        return x[by], y[by]
    size = np.diff(ends_a, prepend=0)
    text = np.repeat(np.arange(len(size)), size)
    first, end = (ends_b - np.diff(ends_b, prepend=0))[text], ends_b[text]
    place = np.arange(len(a)) - (ends_a - size)[text]
    anchor = np.flatnonzero(place % STRIDE == 0)
    found = np.empty(len(a), np.int64)
    found[anchor] = gallop(a[anchor], b, first[anchor], end[anchor])
    rest = np.flatnonzero(place % STRIDE)
    found[rest] = gallop(a[rest], b, found[rest - place[rest] % STRIDE], end[rest])
    hit = found < end
    hit[hit] = b[found[hit]] == a[hit]
    x = np.flatnonzero(hit)
    return x, found[x]


class Numbers(dict):
    """Numbers keys from 0, as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Grown:
    """Whole numbers that are added to."""

    def __init__(self):
        self.held, self.size = np.empty(1024, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.held):
            held = np.empty(max(2 * len(self.held), self.size + len(values)), np.int64)
            held[: self.size] = self.whole()
            self.held = held
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)

    def whole(self) -> np.ndarray:
        return self.held[: self.size]


class Aligner:
    """Both tokenizers, and the groups of batches of texts."""

    def __init__(self, bytes_path: str, pieces_path: str):
        self.sides = BytePieces(bytes_path), SentencePieces(pieces_path)
        self.sizes = [side.sizes for side in self.sides]
        self.forget()
        n = max(map(len, self.sizes))
        # An id with what follows it in a text's groups: another token, its group's second list, the next group.
        self.written = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(n)]
        self.width = n

    def batch(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """Flat arrays over the texts that have tokens (``rows``).

        ``a``, ``b``: ids; ``ends_a``, ``ends_b``: where each text's stop;
        ``last_a``, ``last_b``: the last token of each group in either;
        ``groups``: where each text's groups stop.
        """
        rows = [k for k, t in enumerate(texts) if t]
        ids = self._whole([texts[k] for k in rows])
        kept = [k for k, x in enumerate(ids[0]) if x]
        return {"rows": np.array(rows, np.int64)[kept]} | self._grouped([[side[k] for k in kept] for side in ids])

    def _whole(self, read: list[str]) -> list[list[bytes]]:
        """Both sides' ids of each text; none where a side's bytes are not the text's."""
        ids = [side.encode(read) for side in self.sides]
        for k, (t, *own) in enumerate(zip(read, *ids, strict=True)):
            whole = b" " + t.encode("utf-8", "surrogatepass")
            if any(b"".join(map(side.spelling.__getitem__, np.frombuffer(z, "<u4").tolist())) != whole for side, z in zip(self.sides, own, strict=True)):
                ids[0][k] = ids[1][k] = b""
        return ids

    def _words(self, words: list[str]) -> list[list[bytes]]:
        """As ``_whole`` for stretches of cuttable texts."""
        ids = [side.encode_words(words) for side in self.sides]
        spelt = (" " + " ".join(words)).encode("utf-8", "surrogatepass")
        size = np.fromiter(map(len, spelt[1:].split(b" ")), np.int64, len(words)) + 1
        good = np.ones(len(words), bool)
        for side, own in zip(self.sides, ids, strict=True):
            flat = np.frombuffer(b"".join(own), "<u4")
            ends = np.cumsum(side.sizes[flat])
            stop = np.cumsum([len(x) // 4 for x in own])
            if not len(flat) or b"".join(map(side.spelling.__getitem__, flat.tolist())) != spelt or (ends[stop - 1] != np.cumsum(size)).any():
                one = lambda x, side=side: b"".join(map(side.spelling.__getitem__, np.frombuffer(x, "<u4").tolist()))
                good &= [one(x) == b" " + w.encode("utf-8", "surrogatepass") for x, w in zip(own, words, strict=True)]
        return ids if good.all() else [[x if g else b"" for x, g in zip(side, good.tolist(), strict=True)] for side in ids]

    def _grouped(self, ids: list[list[bytes]]) -> dict[str, np.ndarray]:
        """The arrays of ``batch`` but ``rows``, from the ids of texts on both sides."""
        flat = [np.frombuffer(b"".join(side), "<u4").astype(np.int64) for side in ids]
        stops = [np.cumsum([len(x) // 4 for x in side], dtype=np.int64) for side in ids]
        # The texts of a batch lie one after another, so the byte offsets grow over all of them.
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, flat, strict=True)]
        last_a, last_b = common_ends(*ends, *stops)
        return {"a": flat[0], "b": flat[1], "ends_a": stops[0], "ends_b": stops[1], "last_a": last_a, "last_b": last_b, "groups": np.searchsorted(last_a, stops[0])}

    def forget(self) -> None:
        """Drops all stretches that are remembered."""
        self.known, self.chars = Numbers(), 0
        self.said: list[bytes] = []
        # Of each stretch: tokens on both sides, groups, links, and where its pairs begin.
        self.numbers = [Grown() for _ in range(5)]
        self.pair, self.times = Grown(), Grown()

    def summed(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, counts, digests, links) of the texts that have tokens.

        ``rows`` are their places, ``counts`` their tokens on both sides, groups
        and links, ``links`` as for ``links``, with places in ``rows`` as texts.
        Both tokenizers begin a token at a blank without another one beside it,
        so a group ends before it, and a text's groups are those of its stretches
        between such blanks. A stretch is aligned when a worker first meets it
        and remembered with its groups and pairs; any other text is one stretch.
        """
        if max(self.chars, self.pair.size) > CACHED_CHARS:
            self.forget()
        rows, cut, met = [k for k, t in enumerate(texts) if t], self.sides[0].cuttable, len(self.known)
        parts = [t.split(" ") if cut(t) else [t] for t in map(texts.__getitem__, rows)]
        sizes = np.array(list(map(len, parts)), np.int64)
        places = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, sizes.sum())
        if len(self.known) > met:
            self._learn(list(islice(reversed(self.known), len(self.known) - met))[::-1])
        n_a, _, _, _, first = (x.whole() for x in self.numbers)
        good = np.bincount(np.repeat(np.arange(len(rows)), sizes)[(n_a == 0)[places]], minlength=len(rows)) == 0
        places, sizes = places[np.repeat(good, sizes)], sizes[good]
        stops = np.cumsum(sizes)
        begin = stops - sizes
        counts = np.array([np.add.reduceat(x.whole()[places], begin) if len(begin) else np.zeros(0, np.int64) for x in self.numbers[:4]])
        said = list(map(self.said.__getitem__, places.tolist()))
        digests = [hashlib.sha256(b";".join(said[s:e])).hexdigest() for s, e in zip(begin.tolist(), stops.tolist(), strict=True)]
        # The pairs of each text's distinct stretches, summed.
        own, often = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(n_a) + places, return_counts=True)
        text, place = np.divmod(own, max(1, len(n_a)))
        many = np.diff(np.r_[first, self.pair.size])[place]
        take = spread(first[place], many)
        names, pair = np.unique(self.pair.whole()[take], return_inverse=True)
        key, times = pair * max(1, len(sizes)) + np.repeat(text, many), self.times.whole()[take] * np.repeat(often, many)
        by = np.argsort(key)
        key, times = key[by], times[by]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        pair, text = np.divmod(key[start], max(1, len(sizes)))
        return np.array(rows, np.int64)[good], counts, digests, (names[pair], text, np.add.reduceat(times, start) if len(start) else times)

    def _learn(self, new: list[str]) -> None:
        """Aligns stretches that are new, in the order of their numbers."""
        cut = self.sides[0].cuttable
        words, whole = [u for u in new if " " not in u and cut(u)], [u for u in new if " " in u or not cut(u)]
        ids = self._words(words) if words else [[], []]
        if whole:
            own = [dict(zip([*words, *whole], side + more, strict=True)) for side, more in zip(ids, self._whole(whole), strict=True)]
            ids = [list(map(side.__getitem__, new)) for side in own]
        x = self._grouped(ids)
        pair, unit, times = self.links(x)
        by = np.argsort(unit, kind="stable")
        many = np.bincount(unit, minlength=len(new))
        links = np.zeros(len(new), np.int64)
        np.add.at(links, unit, times)
        for column, values in zip(self.numbers, (*(np.diff(x[k], prepend=0) for k in ("ends_a", "ends_b", "groups")), links, self.pair.size + np.cumsum(many) - many), strict=True):
            column.add(values)
        self.pair.add(pair[by])
        self.times.add(times[by])
        self.said += self.written_groups(x)
        self.chars += sum(map(len, new))

    def written_groups(self, x: dict[str, np.ndarray]) -> list[bytes]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        a, b, last_a, last_b = x["a"], x["b"], x["last_a"], x["last_b"]
        code_a, code_b = a.copy(), b.copy()
        code_a[last_a] += self.width
        code_b[last_b] += 2 * self.width
        per_a, per_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        group_a, group_b = np.repeat(np.arange(len(per_a)), per_a), np.repeat(np.arange(len(per_b)), per_b)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + (last_b - per_b + 1)[group_a]] = code_a
        codes[np.arange(len(b)) + (last_a + 1)[group_b]] = code_b
        stops = (x["ends_a"] + x["ends_b"]).tolist()
        parts = list(map(self.written.__getitem__, codes.tolist()))
        return [b"".join(parts[s:e])[:-1] for s, e in zip([0, *stops], stops, strict=False)]

    def links(self, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, text, times): the pairs of ids that each text holds linked, in order, and how often."""
        a, b, last_a, last_b = x["a"], x["b"], x["last_a"], x["last_b"]
        na, nb = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        text = np.repeat(np.arange(len(x["groups"])), np.diff(x["groups"], prepend=0))
        small = na * nb <= WIDE_GROUP
        many = (na * nb)[small]
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        per = np.repeat(nb[small], many)
        pair = a[np.repeat((last_a - na + 1)[small], many) + k // per] << 32 | b[np.repeat((last_b - nb + 1)[small], many) + k % per]
        pairs, texts, times = [pair], [np.repeat(text[small], many)], [np.ones(len(pair), np.int64)]
        for g in np.flatnonzero(~small).tolist():
            u, cu = np.unique(a[last_a[g] - na[g] + 1 : last_a[g] + 1], return_counts=True)
            v, cv = np.unique(b[last_b[g] - nb[g] + 1 : last_b[g] + 1], return_counts=True)
            pairs.append((u[:, None] << 32 | v[None, :]).ravel())
            times.append((cu[:, None] * cv[None, :]).ravel())
            texts.append(np.full(len(pairs[-1]), text[g]))
        pair, text, times = np.concatenate(pairs), np.concatenate(texts), np.concatenate(times)
        by = np.lexsort((text, pair))
        pair, text, times = pair[by], text[by], times[by]
        start = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])]) if len(pair) else np.zeros(0, np.int64)
        return pair[start], text[start], np.add.reduceat(times, start) if len(start) else times


@lru_cache(maxsize=2)
def aligner_of(bytes_path: str, pieces_path: str) -> Aligner:
    """One pair of tokenizers for a worker."""
    return Aligner(bytes_path, pieces_path)


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b, last_a, last_b): both tokenizers' ids of each text, and the last token of each group in either.

    A text that is null or empty, or whose bytes either tokenizer does not give
    back, has empty arrays. Repeated rows come back as often; null ids are kept.
    """

    def run(texts: list[str | None]) -> dict[str, list]:
        x = aligner_of(bytes_path, pieces_path).batch(texts)
        out: dict[str, list] = {k: [[]] * len(texts) for k in ("a", "b", "last_a", "last_b")}
        begin = np.zeros(3, np.int64)
        for row, *stop in zip(x["rows"].tolist(), x["ends_a"], x["ends_b"], x["groups"], strict=True):
            own = [slice(s, e) for s, e in zip(begin, stop, strict=True)]
            out["a"][row], out["b"][row] = x["a"][own[0]], x["b"][own[1]]
            out["last_a"][row], out["last_b"][row] = x["last_a"][own[2]] - begin[0], x["last_b"][own[2]] - begin[1]
            begin = np.array(stop)
        return out

    return mapped(id_and_text(docs, id_col, text_col), run, {k: "array<int>" for k in ("a", "b", "last_a", "last_b")})


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def chunks_of(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each chunk: its documents' ids, counts and digests; its distinct pairs, how many documents hold each, which, and how often."""
    read = id_and_text(docs, id_col, text_col)
    kind = read.schema["id"].dataType.simpleString()

    class Chunk:
        """Aligns texts a slice at a time and keeps what a chunk's row has."""

        def __init__(self):
            self.aligner = aligner_of(bytes_path, pieces_path)
            self.ids, self.counts, self.sha, self.links, self.size, self.held = [], [], [], [], 0, 0

        def add(self, ids: pa.Array, texts: list[str | None]) -> None:
            rows, own, digests, (pair, text, times) = self.aligner.summed(texts)
            counts, sha = np.zeros((4, len(texts)), np.int64), [""] * len(texts)
            counts[:, rows] = own
            for k, digest in zip(rows.tolist(), digests, strict=True):
                sha[k] = digest
            if len(rows):
                self.links.append((pair, (rows[text] + self.held).astype(np.int32), times))
            self.ids.append(ids)
            self.counts.append(counts)
            self.sha += sha
            self.held += len(texts)
            self.size += sum(len(t) for t in texts if t)

        def row(self, chunk: int) -> pa.RecordBatch:
            pair, doc, times = (np.concatenate(c) for c in zip(*self.links, strict=True)) if self.links else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
            by = np.argsort(pair, kind="stable")
            pair, doc, times = pair[by], doc[by], times[by]
            start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
            held = np.diff(np.r_[start, len(pair)])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            own = [pa.array([chunk]), one(pa.concat_arrays(self.ids)), *(one(pa.array(c)) for c in np.concatenate(self.counts, axis=1)), one(pa.array(self.sha))]
            own += [one(pa.array(c)) for c in (pair[start], held, doc, times)]
            return pa.RecordBatch.from_arrays(own, names=["chunk", "ids", *_COUNTS, "groups_sha256", "pairs", "held", "docs", "times"])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, now = TaskContext.get().partitionId() << 32, None
        for batch in found:
            begin, size, texts = 0, 0, batch.column(1).to_pylist()
            for k, text in enumerate(texts):
                size += len(text) if text else 0
                if size >= SLICE_CHARS or k == len(texts) - 1:
                    now = now or Chunk()
                    now.add(batch.column(0).slice(begin, k + 1 - begin), texts[begin : k + 1])
                    begin, size = k + 1, 0
                    if now.size >= CHUNK_CHARS:
                        yield now.row(chunk)
                        chunk, now = chunk + 1, None
        if now:
            yield now.row(chunk)

    small_batches(docs.sparkSession)
    arrays = [f"{c} array<long>" for c in _COUNTS]
    rest = "groups_sha256 array<string>, pairs array<long>, held array<long>, docs array<int>, times array<long>"
    return read.mapInArrow(batches, f"chunk long, ids array<{kind}>, {', '.join(arrays)}, {rest}")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents a pair is linked, and whether that is the most of its first id."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.held").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_counts(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row.

    Links are the pairs of tokens that share a group; the count of a link is the
    number of documents (rows) that hold its ids linked. A text that is null or
    empty, or whose bytes either tokenizer does not give back, has zeros and an
    empty digest. Pairs that tie for the most of an id are all best. Repeated
    rows and rows that share an id count and come back each by itself; null ids
    are kept; texts of any length are taken whole; an empty table gives no row;
    other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = durable(chunks_of(docs, bytes_path, pieces_path, id_col, text_col), **WIDE_ROWS | {"parquet.block.row.count.limit": str(GROUP_CHUNKS)})
    counts = durable(pair_counts(chunks))
    # A chunk's own row, then its pairs' counts in order, so that no side of it is gathered before it is needed.
    own = chunks.select("chunk", F.posexplode("pairs").alias("k", "pair")).join(counts, "pair").select("chunk", "k", "count", "best")
    body = F.struct("ids", *_COUNTS, "groups_sha256", "held", "docs", "times").alias("body")
    whole = chunks.select("chunk", body).unionByName(own, allowMissingColumns=True)
    whole = whole.repartition("chunk").sortWithinPartitions("chunk", F.col("k").asc_nulls_first()).drop("chunk", "k")

    def row(body: pa.StructScalar, counts: list[pa.Array], best: list[pa.Array]) -> pa.RecordBatch:
        at = {c: body[c].values for c in body}
        held, docs_of, times = (at[c].to_numpy() for c in ("held", "docs", "times"))
        size = len(at["ids"])
        n_best, count_sum = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for out, of in ((count_sum, counts), (n_best, best)):
            if of:
                np.add.at(out, docs_of, times * np.repeat(np.concatenate([x.to_numpy(zero_copy_only=False) for x in of]), held))
        columns = [at["ids"], *(at[c] for c in _COUNTS), pa.array(n_best), pa.array(count_sum), at["groups_sha256"]]
        return pa.RecordBatch.from_arrays(columns, names=["id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[pa.StructScalar, list[pa.Array], list[pa.Array]] | None = None
        for batch in found:
            body, count, best = (batch.column(c) for c in ("body", "count", "best"))
            heads = np.flatnonzero(body.is_valid().to_numpy(zero_copy_only=False)).tolist()
            for head, end in zip([-1, *heads], [*heads, len(batch)], strict=True):
                if head >= 0:
                    if now:
                        yield row(*now)
                    now = body[head], [], []
                if now and end > head + 1:
                    now[1].append(count.slice(head + 1, end - head - 1))
                    now[2].append(best.slice(head + 1, end - head - 1))
        if now:
            yield row(*now)

    longs = ", ".join(f"{c} long" for c in (*_COUNTS, "n_best", "count_sum"))
    found = whole.mapInArrow(batches, f"id {kind}, {longs}, groups_sha256 string")
    return found
