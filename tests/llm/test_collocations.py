import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import collocations
from gridloom.llm.common import WIDE_ROWS, discard, durable
from gridloom.llm.queries import oracle_sql, queries
from gridloom.llm.quotient import Layout


def brute(rows, least=100, longest=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from counts in Python, whose integers have no bound."""
    small = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(small)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = {}
    for (lang, w), a in often.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(a, inside.get((lang, w[i:j]), 0))
    out = []
    for lang in total:
        found = []
        for (of, w), a in often.items():
            if of == lang and not 100 * inside.get((lang, w), 0) >= 100 * a:
                cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(t, g, i, "w", 5) for i, (t, g) in enumerate(rows)], "text string, lang string, chunk int, word string, n int")


def drawn(seed, n, langs=("a", "b", None, "und")):
    rng = random.Random(seed)
    words = ["the", "The", "of", "wind", "öl", "x.y", "a,b", "\tq", "not", "Éa", "im\x0bage", "end\n", "one", "two", "three"]
    rows = []
    for _ in range(n):
        w = rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 60))
        if rng.random() < 0.3:
            w[3:3] = ["in", "the", "event", "of", "fire", "run"]
        rows.append((rng.choice([" ", "  "]).join(w), rng.choice(langs)))
    return rows


@pytest.mark.parametrize("least, longest, top", [(3, 5, 2000), (20, 3, 7), (2, 2, 50), (5, 6, None)])
def test_against_brute_force(spark, monkeypatch, least, longest, top):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 3000)
    for name, value in (("BLOCK_GRAMS", 500), ("SLICE_BYTES", 700), ("SLICE_WORDS", 90), ("MERGE_BYTES", 2000)):
        monkeypatch.setattr(collocations, name, value)
    rows = [*drawn(1, 150), (None, "a"), ("", "b"), ("  \t ", "only blanks"), ("x " * 5000, "long"), ("one two " * 40, "rep")]
    got = collocations.collocations(frame(spark, rows), least=least, longest=longest, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, longest, top or 10**9)


def test_small_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITMAP_BITS", 64)
    rows = drawn(2, 80)
    got = collocations.collocations(frame(spark, rows), least=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3)


def test_products_beyond_64_bits(spark):
    """Counts as of a corpus of 10**13 words: the score is exact."""
    big = 10**13
    row = spark.createDataFrame([(big // 3, big, big // 2, big // 2 + 1)], "a long, n long, l long, r long")
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    score = row.selectExpr(f"cast(1000 as decimal(4, 0)) * cast({whole('a')} * {whole('n')} as decimal(34, 0)) div ({whole('l')} * {whole('r')}) as s").first()["s"]
    assert score == 1000 * (big // 3) * big // ((big // 2) * (big // 2 + 1))


def test_rows_of_chunks_are_bounded(spark):
    """However large a task's input is, a row that passes between Spark and Python has some MB at most."""
    text = " ".join(map(str, range(100_000)))
    docs = spark.range(0, 40, 1, 1).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("text"), F.lit("x").alias("lang"))
    rows = collocations.chunked(docs, "text", "lang").selectExpr("length(stream) as stream", "size(words) as words").collect()
    assert sum(r.stream for r in rows) > 40 * 4 * 100_000
    assert max(r.stream for r in rows) < 8 << 20


def test_pages_of_wide_rows_are_bounded(spark):
    rows = spark.range(0, 20, 1, 1).selectExpr("repeat(uuid(), 1 << 16) as stream")
    kept = durable(rows, **WIDE_ROWS)
    path = spark._jvm.org.apache.hadoop.fs.Path(kept.inputFiles()[0])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
    pages = reader.readOffsetIndex(reader.getFooter().getBlocks().get(0).getColumns().get(0)).getPageCount()
    reader.close()
    discard(kept)
    assert pages >= 10


def test_nothing_frequent(spark):
    assert collocations.collocations(frame(spark, [("a b c", "x")])).count() == 0
    assert collocations.collocations(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n, width, blocks", [(1, 1, 0), (2, 1, 1), (2, 16, 5), (3, 20, 7), (4, 16, 3), (5, 17, 8), (5, 25, 17), (5, 31, 4), (6, 40, 9)])
def test_filters_lose_nothing(n, width, blocks):
    rng = np.random.default_rng(n * width)
    layout = Layout(n, width, blocks)
    words = [rng.integers(1 << width, size=4000, dtype=np.uint64) for _ in range(n)]
    parts = layout.pack(words)
    assert all((a == b).all() for a, b in zip(layout.unpack(parts), words, strict=True))
    weights = rng.choice([1, 2, 254, 255, 256, 10**12], 4000)
    want = Counter()
    for *w, c in zip(*(x.tolist() for x in words), weights.tolist(), strict=True):
        want[tuple(w)] += c
    shards = []
    for s in range(3):
        some = slice(s, None, 3)
        own, counts = layout.summed([p[some] for p in parts], weights[some])
        block = layout.block(own)
        assert (np.diff(block) >= 0).all()
        shards.append({b: layout.encode([p[block == b] for p in own], counts[block == b]) for b in np.unique(block).tolist()})
    got = Counter()
    for b in set().union(*shards):
        own, counts = layout.merge([s[b] for s in shards if b in s], b)
        again, same = layout.decode(layout.encode(own, counts), b)
        assert all((x == y).all() for x, y in zip(own, again, strict=True)) and (counts == same).all()
        for *w, c in zip(*(x.tolist() for x in layout.unpack(own)), counts.tolist(), strict=True):
            assert tuple(w) not in got
            got[tuple(w)] = c
    assert got == want


def test_empty_filter():
    layout = Layout(3, 10, 2)
    raw = layout.encode([np.zeros(0, np.uint64)] * 2, np.zeros(0, np.int64))
    assert len(layout.decode(raw, 1)[1]) == 0


def test_filter_is_compact():
    """A slot takes its remainder, a byte for its counter and little more."""
    layout = Layout(2, 16, 4)
    rng = np.random.default_rng(1)
    parts, counts = layout.summed(layout.pack([rng.integers(1 << 16, size=1 << 20, dtype=np.uint64) for _ in range(2)]))
    block = layout.block(parts)
    size = sum(len(layout.encode([p[block == b] for p in parts], counts[block == b])) for b in range(16))
    assert size < len(counts) * 3.3  # 32 bits less four of the block and sixteen of the quotient, counter, two bits and a half


def test_query_on_given_table(spark, sf_dir):
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries()["op13_phrase_collocations"](spark, sf_dir).collect())
    assert got == brute(docs)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(con.sql(oracle_sql()["op13_phrase_collocations"]).fetchall()) == got
