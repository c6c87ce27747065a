"""N-gram Jaccard join by adaptive multi-match prefixes.

Rows with the same set of shingles are one node. Shingles have one global order,
the rarer first, and a node's l-prefix are its first ``size - required + l``
shingles, ``required`` being what any partner must share with it. Two nodes that
link share at least min(l, l') shingles of their prefixes, whatever l each has
chosen: of the two prefixes the one that ends first misses fewer than its own
``required - l`` shared shingles. Each node takes the l of least estimated cost,
from how many others hold each shingle of the prefix.

The order need not rest on all shingles. Those in the lowest part of the hash
space (``early_end``) come first, by how many nodes hold them; a prefix is
short at a high similarity, so it lies among them. Nodes for which it may not,
small ones mostly, have all their shingles counted.

A dense group would have as many links as pairs. So each node is first compared
with one hub of its lists, in a few rounds; lists that lie within one component
are then done with, and in the others only pairs of different components are
tallied. Long lists are dealt in blocks, so that no task holds one. Pairs that
share enough of their prefixes, and whose parity bitmaps do not rule them out,
are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from gridloom.llm.common import discard, durable, mapped, small_batches
from gridloom.llm.components import components
from gridloom.llm.packing import spread

SHINGLE = 3
PERCENT = 90
#: The matches that a node may ask for.
MATCHES = (1, 2, 3, 4, 6, 8, 12)
#: Cost of a candidate's verification, in postings met.
VERIFY_COST = 8
#: Rounds in which each node is compared with one hub.
HUB_ROUNDS = 2
#: Nodes of a list that one block holds, about.
BLOCK = 256
#: Pairs of a group that are looked at together.
PAIRS_AT_ONCE = 1 << 17
#: Bits of a parity bitmap.
BITS = 1024
#: Hashes of words that a worker remembers at most.
CACHED_WORDS = 500_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class ShingleSets:
    """Sets of shingle hashes of texts: sorted distinct 64-bit numbers."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def words(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, out = self.known, []
        for w in text.encode("utf-8", "surrogatepass").lower().split():
            h = known.get(w)
            if h is None:
                h = known[w] = xxh64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        """With fewer words than ``width`` the whole sequence is one shingle; without words there is none."""
        w = self.words(text)
        if not len(w):
            return w
        k = min(self.width, len(w))
        h = np.full(len(w) - k + 1, np.uint64(k))
        for i in range(k):
            h = _mixed(h * _M1 + w[i : len(w) - k + 1 + i])
        return np.unique(h)


def needed(size: int | np.ndarray, percent: int):
    """Shingles that any partner shares with a set of this size, at least."""
    return -(-percent * size // 100)


def bitmap(own: np.ndarray) -> bytes:
    """Parities of the shingles in each of BITS cells.

    Two bitmaps differ in at most as many bits as the sets do in shingles.
    """
    return np.packbits(np.bincount((own >> np.uint64(17)).astype(np.int64) % BITS, minlength=BITS) & 1).tobytes()


def early_end(percent: int) -> int:
    """Shingles of hashes below this come first in the order: 2.5 prefixes of the hash space."""
    return int(min(1.0, 2.5 * (100 - percent) / 100) * (2**64 - 1))


def counted(own: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The shingles whose nodes are counted, and how many of them are early.

    These are the early ones, or all where the longest prefix may pass them.
    """
    early = int(np.searchsorted(own, np.uint64(early_end(percent))))
    return (own[:early] if early >= len(own) - needed(len(own), percent) + MATCHES[-1] else own), early


def marked_sets(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, text_hash, size, early, key_a, key_b, counted, bits) for each row."""

    schema = {"size": "long", "early": "long", "key_a": "long", "key_b": "long", "counted": "binary", "bits": "binary"}

    def run(texts: list[str | None]) -> dict[str, list]:
        sets = ShingleSets(width)
        out: dict[str, list] = {k: [] for k in schema}
        for text in texts:
            own = sets.of(text)
            a, b = np.frombuffer(xxh3_128_digest(own.tobytes()), np.int64).tolist()
            some, early = counted(own, percent)
            for column, value in zip(out.values(), (len(own), early, a, b, some.tobytes(), bitmap(own)), strict=True):
                column.append(value)
        return out

    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return mapped(read, run, schema)


def postings(rows: DataFrame) -> DataFrame:
    """A row for each ``token`` of the last column, which has them as bytes; the other columns stay."""

    def run(blobs: list[bytes]) -> dict[str, np.ndarray]:
        n = np.array([len(x) // 8 for x in blobs], dtype=np.int64)
        return {"rows": np.repeat(np.arange(len(blobs)), n), "token": np.frombuffer(b"".join(blobs), np.int64)}

    return mapped(rows, run, {"token": "long"})


def choose(size: int, early: int, n_counted: int, held: np.ndarray, held_early: int, percent: int) -> tuple[int, int]:
    """(l, shared shingles in the l-prefix) of least estimated cost.

    ``held`` tells how many nodes hold each shingle that others hold too, in
    order, the first ``held_early`` of them early ones; before each of the two
    kinds come those that are the node's own alone. A candidate with l matches
    is met l times, which bounds the candidates' number.
    """
    most = needed(size, percent)
    met = np.r_[0, np.cumsum(held - 1)]
    best = (0.0, 1, 0)
    for k, l in enumerate(MATCHES):
        if l > max(1, most):
            break
        length = size - most + l
        n = min(held_early, max(0, length - (early - held_early)))
        n += min(len(held) - held_early, max(0, length - early - (n_counted - early - (len(held) - held_early)))) if n_counted > early else 0
        cost = met[n] + VERIFY_COST * met[n] / l
        if not k or cost < best[0]:
            best = (cost, l, n)
    return best[1], best[2]


def prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """(node, size, bits, l, prefix) of the nodes whose prefix others may share.

    ``shared(node, size, early, n_counted, bits, held)`` has the shingles that
    others hold too, as structs of (nodes, token). ``prefix`` is in global order.
    """
    end = np.uint64(early_end(percent))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            lists = batch.column("held")
            flat = lists.flatten()
            nodes, token = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            node_of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            late = token.view(np.uint64) >= end
            by = np.lexsort((token, nodes, late, node_of))
            nodes, token, late = nodes[by], token[by], late[by]
            ends = np.searchsorted(node_of, np.arange(len(lists) + 1)).tolist()
            rows, ls, blobs = [], [], []
            sizes = zip(*(batch.column(c).to_pylist() for c in ("size", "early", "n_counted")), strict=True)
            for k, ((size, early, n_counted), a, b) in enumerate(zip(sizes, ends, ends[1:], strict=False)):
                l, n = choose(size, early, n_counted, nodes[a:b], int((~late[a:b]).sum()), percent)
                if n:
                    rows.append(k)
                    ls.append(l)
                    blobs.append(token[a : a + n].tobytes())
            at = pa.array(rows, pa.int64())
            own = [batch.column(c).take(at) for c in ("node", "size", "bits")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(ls, pa.int32()), pa.array(blobs, pa.binary())], names=["node", "size", "bits", "l", "prefix"])

    small_batches(shared.sparkSession)
    return shared.mapInArrow(batches, "node long, size long, bits binary, l int, prefix binary")


def _similar(a: str, b: str, percent: int) -> str:
    """SQL: the two sizes allow the similarity."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): the components of the ``pairs(node, other, u, v)`` whose sets are similar enough, each two once."""
    left, right = sets.select("node", F.col("own").alias("own_u")), sets.select(F.col("node").alias("other"), F.col("own").alias("own_v"))
    both = pairs.join(left, "node").join(right, "other").select("u", "v", "own_u", "own_v")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    small_batches(pairs.sparkSession)
    return both.mapInArrow(batches, "u long, v long").distinct()


def _rooted(index: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``index(token, node, size)`` with each node's component."""
    return index.withColumn("root", F.col("node")) if roots is None else _with_roots(index, roots, root="root")


def _open_lists(placed: DataFrame, *more) -> DataFrame:
    """The lists that hold more than one component: (token, n) and what ``more`` aggregates."""
    lists = placed.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), *more)
    return lists.where("low < high").drop("low", "high")


def _with_roots(rows: DataFrame, roots: DataFrame, name: str = "node", root: str | None = None) -> DataFrame:
    """``rows`` with the component of the node ``name``, as ``root`` or in its place."""
    own = roots.select(F.col("node").alias("_of"), F.col("component").alias("_component"))
    return rows.join(own, rows[name] == own["_of"], "left").withColumn(root or name, F.coalesce("_component", name)).drop("_of", "_component")


def _joined(roots: DataFrame | None, more: DataFrame) -> DataFrame:
    """(node, component) once the components ``more`` joins are one. Durable."""
    if roots is None:
        return more
    further = more.select(F.col("node").alias("of"), F.col("component").alias("least"))
    moved = roots.join(further, roots.component == further["of"], "left").select("node", F.coalesce("least", "component").alias("component"))
    found = durable(moved.union(more.join(roots, "node", "left_anti")))
    discard(more)
    return found


def hub_pairs(index: DataFrame, roots: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """(node, other, u, v): each node with the hub that most of its open lists name, of a like size and another component, and both components.

    A list's hub is its node of the least hash, another one each turn.
    """
    placed = _rooted(index, roots)
    hub = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "root", "size")).alias("hub")
    hubs = _open_lists(placed, hub).select("token", F.col("hub.node").alias("hub"), F.col("hub.root").alias("hub_root"), F.col("hub.size").alias("hub_size"))
    met = placed.join(hubs, "token").where(f"root <> hub_root and {_similar('size', 'hub_size', percent)}")
    votes = met.groupBy("node", "root", "hub", "hub_root").agg(F.count("*").alias("n"))
    best = votes.groupBy("node", "root").agg(F.max(F.struct("n", "hub", "hub_root")).alias("best"))
    return best.select("node", F.col("best.hub").alias("other"), F.col("root").alias("u"), F.col("best.hub_root").alias("v"))


def _binary_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as 64-bit numbers, and where each value begins among them; one more for the end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.int64), (offsets - offsets[0]) // 8


def _tallied(rows: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """The pairs of whole groups of blocks that share enough of their prefixes."""
    token, node, root, size, l, block, i, j = (rows.column(c).to_numpy() for c in ("token", "node", "root", "size", "l", "block", "i", "j"))
    bits = _binary_rows(rows.column("bits"))[0].view(np.uint64).reshape(len(rows), -1)
    prefix, begin = _binary_rows(rows.column("prefix"))
    fresh = np.r_[True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    end = np.r_[np.flatnonzero(fresh)[1:], len(rows)][np.cumsum(fresh) - 1]
    met = np.cumsum(end - np.arange(len(rows)) - 1)
    out, at = [], 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(met, (met[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        own = np.arange(at, stop)
        x = np.repeat(own, end[own] - own - 1)
        y = spread(own + 1, end[own] - own - 1)
        at = stop
        fit = (root[x] != root[y]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])) & ((block[x] != block[y]) | (i[x] == j[x]))
        x, y = x[fit], y[fit]
        total = size[x] + size[y]
        apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(apart <= total - 2 * -(-percent * total // (100 + percent)))
        for k in near.tolist():
            p, q = x[k], y[k]
            first, other = prefix[begin[p] : begin[p + 1]], prefix[begin[q] : begin[q + 1]]
            same = np.isin(first, other)
            # Each pair is tallied in the list of its first shared shingle.
            if first[same.argmax()] == token[p] and same.sum() >= min(l[p], l[q]):
                out.append((min(root[p], root[q]), max(root[p], root[q]), apart[k], node[p], node[q]))
    columns = zip(*out, strict=True) if out else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v", "apart", "node", "other"])


def _block_pairs(percent: int):
    """Groups of blocks arrive one after another; one may span batches."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in found:
            rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()
            if not rows:
                continue
            rows = rows[0]
            last = [rows.column(c).to_numpy() for c in ("token", "i", "j")]
            start = len(rows) - int(np.argmax(np.r_[np.any([c[::-1] != c[-1] for c in last], axis=0), True]))
            if start:
                yield _tallied(rows.slice(0, start), percent)
            held = rows.slice(start)
        if held is not None and len(held):
            yield _tallied(held, percent)

    return batches


def block_pairs(index: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(u, v, apart, node, other): pairs of different components ``u`` and ``v`` that share enough of their prefixes and may be similar.

    A list of n nodes is dealt into n / BLOCK blocks, and every two of them meet
    in a group of their own. ``apart`` are the bits in which bitmaps differ.
    """
    placed = _rooted(index, roots)
    rows = placed.join(_open_lists(placed), "token").withColumn("blocks", F.expr(f"int((n + {BLOCK} - 1) div {BLOCK})"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root")
    rows = rows.join(nodes.select("node", "size", "bits", "l", "prefix"), "node")
    rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return rows.mapInArrow(_block_pairs(percent), "u long, v long, apart long, node long, other long")


def whole_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, own): the sets of ``nodes(node, id, text_hash)``, from the texts of the rows that stand for them."""
    wanted = nodes.select("node", F.col("id").alias("of"), F.col("text_hash").alias("hash"))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    read = read.join(wanted, (read.text_hash == wanted["hash"]) & read.id.eqNullSafe(wanted["of"])).select("node", "text")

    def run(texts: list[str | None]) -> dict[str, list]:
        sets = ShingleSets(width)
        return {"own": [sets.of(t).tobytes() for t in texts]}

    return mapped(read, run, {"own": "binary"}).dropDuplicates(["node"])


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``.

    A row's set has the distinct shingles of ``width`` words, of the whole
    sequence if it is shorter; rows link at ``percent`` per cent of similarity.
    ``component_id`` is the least id reachable over links, the row's own
    included. A null or blank text has an empty set and links with nothing, so
    its component is its own id. Repeated rows and rows that share an id each
    come back. A null id comes back with the least of the other ids of its
    component, or null if there is none. Ties in cost go to the smaller l.
    Texts of any length are taken whole. An empty table gives no row. Columns
    other than the two are ignored, whatever their names.
    """
    marked = durable(marked_sets(docs, id_col, text_col, width, percent))
    key = ["key_a", "key_b"]
    rep = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("rep")
    some = [F.first(c).alias(c) for c in ("size", "early", "counted", "bits")]
    nodes = durable(
        marked.where("size > 0").groupBy(*key).agg(rep, *some).select(*key, "rep.id", "rep.text_hash", "size", "early", "counted", "bits", F.monotonically_increasing_id().alias("node"))
    )
    every = postings(nodes.select("node", "counted"))
    common = every.groupBy("token").agg(F.count("*").alias("nodes")).where("nodes > 1")
    held = every.join(common, "token").groupBy("node").agg(F.collect_list(F.struct("nodes", "token")).alias("held"))
    counts = nodes.select("node", "size", "early", "bits", F.expr("length(counted) div 8").alias("n_counted"))

    chosen = durable(prefixes(held.join(counts, "node").select("node", "size", "early", "n_counted", "bits", "held"), percent))

    index = durable(postings(chosen.select("node", "size", "prefix")))
    sets = durable(whole_sets(docs, nodes.join(chosen.select("node"), "node", "left_semi"), id_col, text_col, width))
    # Edges join components of the turn before, so they shrink from turn to turn.
    roots = None
    for turn in range(HUB_ROUNDS):
        edges = durable(verified(hub_pairs(index, roots, turn, percent), sets, percent))
        old, roots = roots, _joined(roots, components(edges))
        discard(old, edges)
    pairs = durable(block_pairs(index, chosen, roots, percent))
    likeliest = F.min(F.struct("apart", "node", "other")).alias("best")
    edges = durable(verified(pairs.groupBy("u", "v").agg(likeliest).select("best.node", "best.other", "u", "v"), sets, percent))
    more = components(edges)
    left = _with_roots(_with_roots(pairs, more, "u"), more, "v").where("u <> v")
    last = durable(verified(left.select("node", "other", "u", "v"), sets, percent))
    old, roots = roots, _joined(roots, more)
    discard(old, edges)
    old, roots = roots, _joined(roots, components(last))
    discard(old, last, pairs)
    discard(sets, index, chosen)
    linked = _with_roots(nodes.select(*key, "id", "node"), roots, root="root")
    named = linked.groupBy("root").agg(F.min("id").alias("component_id"))
    found = durable(linked.join(named, "root").select(*key, "component_id"))
    discard(nodes, roots)
    own = F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component_id"))
    return marked.join(found, key, "left").select("id", F.col("size").alias("n_shingles"), own.alias("component_id"))
