"""Near duplicates by SimHash over an inverted index of positional bytes.

A 64-bit fingerprint has eight bytes, each with its position. Two fingerprints
that differ in at most two bits share at least six of their eight positional
bytes. Posting lists of single bytes would grow with the input, and counting
their pairs with its square. The index therefore posts every distinct
fingerprint under five positional bytes at a time, for 11 sets of the three left
out that hold every two positions between them: whichever two bytes a pair
differs in, one set leaves both out, and the pair meets in its list. Lists hold
2**24 fingerprints at most, whatever the input. Within a list the shared
positional bytes are tallied per pair, pairs that reach the guaranteed minimum
of six are kept, and those are verified bit by bit.

Copies collapse to one fingerprint before they are indexed, and a list passes on
a spanning set of its verified links rather than all of them, so a large group
of near copies costs time in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_digest

from gridloom.llm.common import discard, durable, small_batches
from gridloom.llm.components import components, least_reached

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Positional bytes that a pair within MAX_BITS shares at least.
MIN_SHARED = 8 - MAX_BITS
#: The positions left out of the bytes of a list: the lines of a plane on the first seven, and the eighth with pairs of them.
LEFT_OUT = [*((i, (i + 1) % 7, (i + 3) % 7) for i in range(7)), (0, 1, 7), (2, 3, 7), (4, 5, 7), (0, 6, 7)]
_CHUNK = 1 << 16
#: In lists up to this many each pair is tallied; in longer ones only pairs that a flip of MAX_BITS bits leads to, with the same links.
_MATRIX = 256
_PROBES = np.array(
    [(1 << a) | (1 << b) for a in range(64) for b in range(a, 64)], dtype=np.uint64
)


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; 0 without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    if len(words) < width:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digests = b"".join(map(xxh64_digest, shingles, repeat(SEED)))
    rows = np.frombuffer(digests, dtype=np.uint8).reshape(n, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        ones += np.unpackbits(rows[at : at + _CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def simhash_udf(width: int = SHINGLE):
    """The fingerprint of shingles of ``width`` words as a column function."""

    @F.pandas_udf(T.LongType())
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(x, width) for x in texts], dtype="int64")

    return fingerprint


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes are equal, given the XOR."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)


def linked(x: np.ndarray) -> np.ndarray:
    """Count filter, then verification, given the XOR of pairs."""
    keep = shared_bytes(x) >= MIN_SHARED
    keep[keep] = np.bitwise_count(x[keep]) <= MAX_BITS
    return keep


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges with the same components as the links (a, b) on 0..n-1."""
    root = least_reached(n, a, b)
    hung = np.flatnonzero(root != np.arange(n))
    return hung, root[hung]


def list_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links within one posting list of distinct fingerprints."""
    fps = np.sort(fps)
    n = len(fps)
    if n <= _MATRIX:
        a, b = np.nonzero(np.triu(linked(fps[:, None] ^ fps[None, :]), 1))
    else:
        differing = np.bitwise_or.reduce(fps ^ fps[0])
        a_all, b_all = [], []
        for probe in _PROBES[(_PROBES & ~differing) == 0]:
            at = np.minimum(np.searchsorted(fps, fps ^ probe), n - 1)
            hit = np.flatnonzero((fps[at] == fps ^ probe) & (fps > fps ^ probe))
            a_all.append(hit)
            b_all.append(at[hit])
        a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a_all, b_all))
        keep = linked(fps[a] ^ fps[b])
        a, b = a[keep], b[keep]
    a, b = _spanning(n, a, b)
    return fps[a], fps[b]


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Posting lists arrive one after another; one may span batches."""
    held_key = np.zeros(0, dtype=np.uint64)
    held_fp = np.zeros(0, dtype=np.uint64)

    def links(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.r_[start, len(key)])
        two = start[size == 2]
        two = two[linked(fp[two] ^ fp[two + 1])]
        us, vs = [fp[two]], [fp[two + 1]]
        for s, n in zip(start[size > 2], size[size > 2], strict=True):
            u, v = list_links(fp[s : s + n])
            us.append(u)
            vs.append(v)
        out = pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})
        return out.drop_duplicates()

    for pdf in batches:
        key = np.concatenate([held_key, pdf["posting"].to_numpy(np.int64).view(np.uint64)])
        fp = np.concatenate([held_fp, pdf["fp"].to_numpy(np.int64).view(np.uint64)])
        if not len(key):
            continue
        last = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
        yield links(key[:last], fp[:last])
        held_key, held_fp = key[last:], fp[last:]
    yield links(held_key, held_fp)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fps(fp)``.

    Every pair within MAX_BITS is joined by a path of edges, and every edge is
    such a pair or the end of such a path inside one posting list.
    """
    postings = []
    for i, left_out in enumerate(LEFT_OUT):
        mask = ~sum(0xFF << (8 * p) for p in left_out) & (2**64 - 1)
        tag = i << (8 * min(left_out))  # the lowest byte left out names the set
        kept = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))
        postings.append(kept.bitwiseOR(F.lit(tag).cast("long")))
    index = fps.select(F.explode(F.array(*postings)).alias("posting"), "fp")
    index = index.repartition("posting").sortWithinPartitions("posting")
    return index.mapInPandas(_links, "u long, v long")


def fingerprint_components(distinct: DataFrame) -> DataFrame:
    """(fp, least_id, root): ``distinct(fp, least_id)`` with the least fingerprint that each reaches."""
    roots = components(fingerprint_links(distinct.select("fp")))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``.

    ``component_id`` is the least id that reaches the row over links between
    fingerprints of shingles of ``width`` words that differ in at most MAX_BITS
    bits. A null, empty or blank text has fingerprint 0. Repeated rows each come
    back. A null id comes back with the component of its fingerprint, which has
    the least of the other ids, or null if it has none. Texts of any length are
    taken whole; an empty table gives no row. Columns other than the two are
    ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    marked = durable(docs.select(F.col(id_col).alias("id"), simhash_udf(width)(F.col(text_col)).alias("fp")))
    distinct = durable(marked.groupBy("fp").agg(F.min("id").alias("least_id")))
    nodes = fingerprint_components(distinct)
    named = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    nodes = durable(nodes.select("fp", "root").join(named, "root").select("fp", "component_id"))
    discard(distinct)
    return marked.join(nodes, "fp").select("id", "fp", "component_id")


def fingerprint_text(fp: str = "fp"):
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the least id, of equal ids that of the least fingerprint.

    Rows are told apart by id and fingerprint. Of rows that have both in common
    one stays; rows that share an id and differ in text stay or go by
    themselves. Rows whose id is null are no one's copy by name and stay. Null,
    empty and blank texts are copies of one another. Texts of any length are
    taken whole; an empty table stays empty; columns of any name come back as
    they are.
    """
    small_batches(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = durable(docs.select(F.col(id_col).alias("id"), simhash_udf(width)(F.col(text_col)).alias("fp"), whole))
    keys = marked.where("id is not null").groupBy("fp").agg(F.min("id").alias("least_id"))
    distinct = durable(keys)
    nodes = fingerprint_components(distinct)
    first = nodes.groupBy("root").agg(F.min(F.struct(F.col("least_id").alias("id"), "fp")).alias("stay"))
    stay = durable(first.select(F.col("stay.id").alias("stay_id"), F.col("stay.fp").alias("stay_fp")))
    discard(distinct)
    # Merged at every size: the rows that stay grow with the input, so they are never broadcast.
    kept = marked.join(stay.hint("merge"), (marked.id == stay.stay_id) & (marked.fp == stay.stay_fp))
    once = kept.select("id", "fp", "row").dropDuplicates(["id", "fp"]).select("row.*")
    return once.unionByName(marked.where("id is null").select("row.*"))
