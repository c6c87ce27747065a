"""Collocations of each language from exact counts of word n-grams.

Texts are read once, in chunks. A chunk has a vocabulary of its own and its
texts as numbers in it; words that occur often enough in a language get a number
there, which returns to the chunks that hold them by a join, so no task holds
the vocabulary of the corpus. n-grams of frequent words are packed and counted
in quotient filters (``quotient``), one for each chunk and block, which are
merged block by block. From three words on, only n-grams whose two parts of one
word less are frequent are counted; a bitmap of at most BITMAP_BITS tells which
may be, and what it lets through beside them the exact counts drop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WIDE_ROWS, discard, durable, small_batches
from gridloom.llm.quotient import Layout

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: Bytes of text in a chunk, about; of those numbered at once; words whose n-grams are counted at once.
CHUNK_BYTES, SLICE_BYTES, SLICE_WORDS = 8 << 20, 1 << 20, 1 << 20
#: Bytes of a block's filters that are merged at once.
MERGE_BYTES = 16 << 20
#: n-grams in a block, about, while a chunk's filter of a block is not too small for that.
BLOCK_GRAMS, MOST_BLOCK_BITS = 1 << 20, 17
#: Bits of a bitmap for each frequent n-gram, and in all.
BITS_EACH, BITMAP_BITS = 16, 1 << 27
_CAPITALS, _SMALL, _ENDS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b".,;:!?\n\x0b\x0c\r"
#: Lower-cases A-Z, makes each end of a piece a line feed and each tab a blank.
_PLAIN = bytes.maketrans(_CAPITALS + _ENDS + b"\t", _SMALL + b"\n" * len(_ENDS) + b" ")


class _Numbers(dict):
    """Numbers words as they come; 0 is no word, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(texts: list[bytes], numbers: _Numbers) -> np.ndarray:
    """The texts' words as numbers from 0, in order, and -1 between pieces."""
    tokens = b"\n".join(texts).translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
    return np.maximum(ids[ids > 0] - 2, -1)


class _Numbered:
    """Texts of one language as numbers of their words, a slice at a time."""

    def __init__(self):
        self.numbers, self.done, self.texts, self.size = _Numbers(), [], [], 0

    def add(self, text: bytes) -> None:
        self.texts.append(text)
        self.size += len(text)
        if self.size >= SLICE_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.texts:
            self.done += [squeezed(numbered(self.texts, self.numbers)).astype("<i4"), np.array([-1], "<i4")]
            self.texts, self.size = [], 0

    def whole(self) -> tuple[np.ndarray, list[bytes]]:
        self._flush()
        return np.concatenate(self.done), list(self.numbers)[2:]


def squeezed(ids: np.ndarray) -> np.ndarray:
    """One -1 for each run of them."""
    return ids[(ids >= 0) | np.r_[True, ids[:-1] >= 0]]


def chunked(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(chunk, lang, stream, words, counts): numbers of a chunk's words, little-endian, its words and how often each comes."""

    def rows(chunk: int, held: dict[str, _Numbered]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for lang, own in held.items():
            ids, words = own.whole()
            counts = np.bincount(ids[ids >= 0], minlength=len(words))
            for column, value in zip(out, (chunk, lang, ids.tobytes(), words, counts), strict=True):
                column.append(value)
        types = (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["chunk", "lang", "stream", "words", "counts"])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, held = TaskContext.get().partitionId() << 32, 0, {}
        for batch in found:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in held:
                    held[lang] = _Numbered()
                held[lang].add(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield rows(chunk, held)
                    chunk, size, held = chunk + 1, 0, {}
        if held:
            yield rows(chunk, held)

    small_batches(docs.sparkSession)
    read = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    return read.mapInArrow(batches, "chunk long, lang string, stream binary, words array<binary>, counts array<long>")


def frequent_words(chunks: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id): words that come ``least`` times in a language, numbered from 0. Durable."""
    each = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    often = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    place = F.monotonically_increasing_id()
    often = durable(often.select("lang", "word", "f", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("k")))
    # One row for each task of the write, so one task may order them.
    sizes = often.groupBy("part").agg(F.count("*").alias("n"))
    first = sizes.select("part", F.expr("sum(n) over (order by part) - n").alias("first"))
    found = durable(often.join(first, "part").select("lang", "word", "f", (F.col("first") + F.col("k")).alias("id")))
    discard(often)
    return found


def renumbered(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(ids): each chunk's stream in the corpus's numbers; -1 for other words and between pieces."""
    own = chunks.select("chunk", "lang", F.posexplode("words").alias("k", "word"))
    # Words without a number stay in the join and are left out of the lists, which a task makes of its own rows first.
    known = F.when(F.col("id").isNotNull(), F.struct("k", "id"))
    ids = own.join(words.select("lang", "word", "id"), ["lang", "word"], "left").groupBy("chunk", "lang").agg(F.collect_list(known).alias("ids"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out = []
            for stream, of in zip(batch.column("stream"), batch.column("ids"), strict=True):
                local = np.frombuffer(stream.as_buffer(), "<i4")
                k, to = (of.values.field(x).to_numpy() for x in (0, 1))
                # The place -1 is the last one, which stands for no word.
                table = np.full(2 + max(int(local.max(initial=-1)), int(k.max(initial=-1))), -1, np.int64)
                table[k] = to
                out.append(squeezed(table[local]).astype("<i8" if to.max(initial=0) >> 31 else "<i4").tobytes())
            wide = [len(x) and bool(of.values.field(1).to_numpy().max(initial=0) >> 31) for x, of in zip(out, batch.column("ids"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(wide, pa.bool_())], names=["ids", "wide"])

    joined = chunks.select("chunk", "lang", "stream").join(ids, ["chunk", "lang"])
    return joined.select("stream", "ids").mapInArrow(batches, "ids binary, wide boolean")


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Where n frequent words in a row begin."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    good = np.r_[0, np.cumsum(ids >= 0)]
    return np.flatnonzero(good[n:] - good[:-n] == n)


def _bit_places(parts: list[np.ndarray], bits: int) -> np.ndarray:
    """A place in a bitmap of 2**bits for each permuted number."""
    mixed = parts[0] * np.uint64(0x9E3779B97F4A7C15)
    for p in parts[1:]:
        mixed = (mixed ^ p) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(grams: DataFrame, layout: Layout, count: int) -> np.ndarray:
    """Bits of the n-grams ``grams(ids)``: bounded, whatever their number."""
    bits = max(6, min(BITMAP_BITS, BITS_EACH * max(1, count)).bit_length())

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, layout.n)
            at = _bit_places(layout.pack(list(ids.T)), bits)
            one = np.uint64(1) << (at & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(one.view(np.int64))], names=["word", "bits"])

    spans = grams.select("ids").mapInArrow(batches, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = spans.toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def counted(streams: DataFrame, layout: Layout, least: int, shorter: tuple[Layout, np.ndarray] | None) -> DataFrame:
    """(ids, f): the n-grams of ``streams`` that come ``least`` times at least."""
    spark, n = streams.sparkSession, layout.n
    sieve = spark.sparkContext.broadcast(shorter[1]) if shorter else None
    before = shorter[0] if shorter else None

    def build(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # short streams are counted together
        for batch in found:
            for raw, wide in zip(batch.column(0), batch.column(1), strict=True):
                held += [np.frombuffer(raw.as_buffer(), "<i8" if wide.as_py() else "<i4").astype(np.int64), np.array([-1])]
                size += len(held[-2]) + 1
                if size >= SLICE_WORDS + n:
                    ids = np.concatenate(held)
                    at = range(0, size - SLICE_WORDS - n + 2, SLICE_WORDS)
                    for k in at:
                        # A slice has the words after it that its last n-grams need.
                        yield from filters_of(ids[k : k + SLICE_WORDS + n - 1])
                    held = [ids[at[-1] + SLICE_WORDS :].copy()]
                    size = len(held[0])
        if held:
            yield from filters_of(np.concatenate(held))

    def filters_of(ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if before:
            bits = (len(sieve.value) * 64 - 1).bit_length()
            at = windows(ids, before.n)
            places = _bit_places(before.pack([ids[at + k] for k in range(before.n)]), bits)
            may = np.zeros(len(ids) + 1, bool)
            may[at] = sieve.value[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1) > 0
            at = np.flatnonzero(may[:-1] & may[1:])
        else:
            at = windows(ids, n)
        parts, counts = layout.summed(layout.pack([ids[at + k] for k in range(n)]))
        if len(counts):
            block = layout.block(parts)
            start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist()
            out = [layout.encode([p[a:b] for p in parts], counts[a:b]) for a, b in zip(start, [*start[1:], len(block)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block[start]), pa.array(out, pa.binary())], names=["block", "filter"])

    def kept(filters: list[bytes], block: int) -> pa.RecordBatch:
        parts, counts = layout.merge(filters, block)
        often = counts >= least
        words = np.stack(layout.unpack([p[often] for p in parts]), axis=1).astype(np.int64)
        ids = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * n), pa.array(words.ravel()))
        return pa.RecordBatch.from_arrays([ids, pa.array(counts[often])], names=["ids", "f"])

    def merge(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in found:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now and held:
                    yield kept(held, now)
                    held, size = [], 0
                now = block
                held.append(raw)
                size += len(raw)
                if size >= MERGE_BYTES and len(held) > 1:
                    held = [layout.encode(*layout.merge(held, now))]
                    size = len(held[0]) // 2  # what is merged weighs less, so that it is not merged at each step
        if held:
            yield kept(held, now)

    filters = streams.mapInArrow(build, "block long, filter binary").repartition("block").sortWithinPartitions("block")
    return filters.mapInArrow(merge, "ids array<long>, f long")


def frequent_phrases(streams: DataFrame, words: DataFrame, least: int, longest: int) -> list[DataFrame]:
    """(ids, f) for each number of words from 1 to ``longest``, durable from 2 on."""
    total, size = words.agg(F.sum("f"), F.count("*")).first()
    grams = [words.select(F.array("id").alias("ids"), "f")]
    width = max(1, max(0, (size or 0) - 1).bit_length())
    blocks = min(MOST_BLOCK_BITS, max(0, ((total or 0) // BLOCK_GRAMS).bit_length()))
    shorter = None
    for n in range(2, longest + 1):
        layout = Layout(n, width, blocks)
        grams.append(durable(counted(streams, layout, least, shorter)))
        if n < longest:
            shorter = layout, bitmap(grams[-1], layout, grams[-1].count())
    return grams


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, longest: int = LONGEST, top: int | None = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    ``a`` is how often a phrase comes, ``least`` times at least; it is cut where
    its score floor(1000 * a * n / (l * r)) is lowest, after the fewest words
    among equals, ``l`` and ``r`` being the counts of the two parts and ``n`` the
    language's words. A phrase that comes within a longer one each time goes.
    The rest are ranked by score, count and phrase; ``top`` None keeps them all.

    A null language is ``und``; null, empty and blank texts have no words.
    Repeated rows count as often as they come, whatever their ids; texts of any
    length are taken whole. An empty table, or one without a phrase that comes
    often enough, gives no row. Columns other than the two are ignored, whatever
    their names. Counts are exact: products are decimals of 38 digits.
    """
    chunks = durable(chunked(docs, text_col, lang_col), **WIDE_ROWS)
    words = frequent_words(chunks, least)
    streams = durable(renumbered(chunks, words), **WIDE_ROWS)
    size = chunks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    sizes = durable(size.groupBy("lang").agg(F.sum("n").alias("n")))
    discard(chunks)
    grams = frequent_phrases(streams, words, least, longest)
    discard(streams)
    every = grams[0]
    for g in grams[1:]:
        every = every.union(g)
    phrases = every.where("size(ids) > 1")
    inside = F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids")
    around = every.where("size(ids) > 2").select(inside, "f").groupBy("ids").agg(F.max("f").alias("longer"))
    phrases = phrases.join(around, "ids", "left").where("longer is null or longer < f").select("ids", F.col("f").alias("a"))
    cut = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.select("ids", "a", "k", F.expr("slice(ids, 1, k)").alias("left"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("right"))
    cut = cut.join(every.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(every.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    of = words.select(F.col("id").alias("first"), "lang").join(sizes, "lang")
    cut = cut.withColumn("first", F.col("ids")[0]).join(of, "first")
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast(1000 as decimal(4, 0)) * cast({whole('a')} * {whole('n')} as decimal(34, 0)) div ({whole('l')} * {whole('r')})")
    best = cut.withColumn("score", score).groupBy("ids", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    spelled = best.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("said"))
    spelled = spelled.select("ids", F.array_join(F.transform("said", lambda x: x["word"].cast("string")), " ").alias("phrase"))
    found = best.join(spelled, "ids").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    ranked = found.selectExpr("lang", "row_number() over (partition by lang order by score desc, a desc, phrase) as rank", "phrase", "a", "l", "r", "n", "score")
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


#: The words of a phrase are parted by one blank, so its parts are those of its text.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS size)),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang),
often AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f FROM counts WHERE f >= 100),
candidates AS (SELECT * FROM often WHERE size > 1),
inner_phrases AS (
  SELECT c.lang, array_to_string(c.w[i:i + k - 1], ' ') AS phrase, max(c.f) AS longer
  FROM candidates c, (SELECT unnest([2, 3, 4]) AS k), (SELECT unnest([1, 2, 3, 4]) AS i)
  WHERE k < c.size AND i + k - 1 <= c.size GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, t.n,
    (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM candidates c, (SELECT unnest([1, 2, 3, 4]) AS k), often x, often y, totals t
  WHERE k < c.size AND x.lang = c.lang AND y.lang = c.lang AND t.lang = c.lang
    AND x.phrase = array_to_string(c.w[1:k], ' ') AND y.phrase = array_to_string(c.w[k + 1:c.size], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_phrases i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
