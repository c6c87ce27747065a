import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridloom.llm import alignment
from gridloom.llm.queries import queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_table():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    far = iter(range(256, 512))
    return {chr(b) if b in own else chr(next(far)): b for b in range(256)}


def brute_groups(libraries, text):
    """[(A ids, B ids)] for each group; None without tokens."""
    if not text:
        return None
    a, b = libraries
    letters = byte_table()
    spell = {i: bytes(letters[c] for c in t) for t, i in json.loads(open(A).read())["model"]["vocab"].items() if t != "<|endoftext|>"}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [spell[i] for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return out


def brute(libraries, rows):
    groups = [brute_groups(libraries, t) for _, t in rows]
    count = Counter()
    for own in groups:
        count.update({(x, y) for ga, gb in own or [] for x in ga for y in gb})
    most = defaultdict(int)
    for (x, _), c in count.items():
        most[x] = max(most[x], c)
    out = []
    for (i, _), own in zip(rows, groups, strict=True):
        links = Counter((x, y) for ga, gb in own or [] for x in ga for y in gb)
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in own or [])
        out.append(
            (i, sum(len(g[0]) for g in own or []), sum(len(g[1]) for g in own or []), len(own or []), links.total(), sum(m for p, m in links.items() if count[p] == most[p[0]]),
             sum(m * count[p] for p, m in links.items()), hashlib.sha256(said.encode()).hexdigest() if own else "")
        )
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


TEXTS = [
    None, "", " ", "\n", "a", "Hello world, it's 1234 fine.", "  two  blanks ", "tab\tand\r\nline", "<|endoftext|> is plain", "<s> and </s>", "▁ low line", "naïve café Äpfel ßtraße",
    "日本語のテキスト and 한국어", "emoji 😀😃 here", "don't we're I'll he'd", "é combining", " nbsp wide", "x" * 3000, "ab" * 700 + " " + "é" * 300, "\x00\x01ctrl", "ﬁ ligature",
    "the the the", "zürich " * 200, " ".join(f"w{i}" for i in range(900)),
]


def test_against_brute_force(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 2000)
    monkeypatch.setattr(alignment, "SLICE_CHARS", 300)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 20)
    rng = random.Random(2)
    letters = "abcdeéöß  .,'12\n-"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    rows = [(k if k != 5 else None, t) for k, t in enumerate(texts)]
    rows += [(1, "one id"), (1, "two texts"), *rows[10:14]]
    df = spark.createDataFrame([(i, t, "a", 1, [2]) for i, t in rows], "doc_id long, text string, chunk string, pair int, ids array<int>")
    got = [tuple(r) for r in alignment.alignment_counts(df, A, B).collect()]
    assert ordered(got) == ordered(brute(libraries, rows))


def test_aligned_rows(spark, libraries):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in alignment.aligned(df, A, B).collect():
        own, i, j = [], 0, 0
        for x, y in zip(r.last_a, r.last_b, strict=True):
            own.append((r.a[i : x + 1], r.b[j : y + 1]))
            i, j = x + 1, y + 1
        assert own == (brute_groups(libraries, TEXTS[r.id]) or [])


def test_quick_ids_equal_the_library(libraries):
    rng = random.Random(9)
    side = alignment.BytePieces(A)
    assert side.quick is not None
    points = [c for c in range(0x250) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(rng.choice(points)) if rng.random() < 0.4 else rng.choice(letters) for _ in range(rng.randint(1, 60))) for letters in ("aet no's 12  \n\t", "aet' n1,\n\t") for _ in range(1500)]
    want = [e.ids for e in libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in side.encode(texts)] == want


def test_gallop_finds_every_place():
    rng = np.random.default_rng(3)
    for _ in range(200):
        long = np.sort(rng.choice(400, rng.integers(0, 60), replace=False)).astype(np.int64)
        short = np.sort(rng.choice(450, rng.integers(0, 20), replace=False)).astype(np.int64)
        first, end = np.zeros(len(short), np.int64), np.full(len(short), len(long))
        assert alignment.gallop(short, long, first, end).tolist() == np.searchsorted(long, short).tolist()


def test_common_ends_of_many_texts():
    """Texts whose first list is the shorter one beside others, and empty ones."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b, stop_a, stop_b, want, at = [], [], [], [], [], 0
        for _ in range(int(rng.integers(0, 6))):
            size = int(rng.integers(0, 80))
            x = np.unique(np.r_[rng.integers(1, size + 1, int(rng.integers(0, size + 1))), [size] * (size > 0)]).astype(int) + at
            y = np.unique(np.r_[rng.integers(1, size + 1, int(rng.integers(0, size + 1))), [size] * (size > 0)]).astype(int) + at
            want += sorted(set(x.tolist()) & set(y.tolist()))
            a, b, at = [*a, *x.tolist()], [*b, *y.tolist()], at + size
            stop_a.append(len(a))
            stop_b.append(len(b))
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        x, y = alignment.common_ends(a, b, np.array(stop_a, np.int64), np.array(stop_b, np.int64))
        assert a[x].tolist() == b[y].tolist() == want


def test_long_text_in_bounded_time():
    """A group as long as the text: its pairs are counted by distinct ids."""
    aligner = alignment.aligner_of(A, B)
    x = aligner.batch(["a" * 400_000])
    pair, _, times = aligner.links(x)
    na, nb = np.diff(x["last_a"], prepend=-1), np.diff(x["last_b"], prepend=-1)
    assert times.sum() == (na * nb).sum() and len(pair) < 1000


def test_stretches_are_aligned_once_and_texts_are_sums_of_them(libraries, monkeypatch):
    aligner = alignment.Aligner(A, B)
    rng = random.Random(5)
    words = ["the", "naïve", "don't", "x.y", "a\nb", "\tq", "end\n", "1234", "Äpfel", "supercalifragilistic"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(300)] + TEXTS
    work = []
    monkeypatch.setattr(alignment, "common_ends", lambda a, b, *rest, f=alignment.common_ends: (work.append(len(a)), f(a, b, *rest))[1])
    for most in (1 << 22, 0):
        monkeypatch.setattr(alignment, "CACHED_CHARS", most)
        for some in (texts[:150], texts[150:], texts[:150]):
            rows, counts, digests, links = aligner.summed(some)
            x = aligner.batch(some)
            assert rows.tolist() == x["rows"].tolist()
            assert [c.tolist() for c in counts[:3]] == [np.diff(x[k], prepend=0).tolist() for k in ("ends_a", "ends_b", "groups")]
            assert digests == [hashlib.sha256(g).hexdigest() for g in aligner.written_groups(x)]
            assert all((u == v).all() for u, v in zip(links, aligner.links(x), strict=True))
            assert counts[3].tolist() == np.bincount(x["rows"].searchsorted(x["rows"][links[1]]), weights=links[2], minlength=len(rows)).astype(int).tolist()
    work.clear()
    monkeypatch.setattr(alignment, "CACHED_CHARS", 1 << 22)
    aligner.summed(["the cat sat on " * 500 + "it"] * 20)
    aligner.summed(["it sat on the cat " * 500 + "it"] * 20)
    assert sum(work) < 20


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_counts(df, A, B).count() == 0


def test_query_on_given_table(spark, sf_dir, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r) for r in queries()["op12_token_alignment"](spark, sf_dir).collect()]
    assert ordered(got) == ordered(brute(libraries, docs))


def test_a_row_group_has_few_chunks(spark, monkeypatch):
    """A reader of Parquet holds a row group at once, so a task's many chunks are not one group."""
    written = []
    durable = alignment.durable
    monkeypatch.setattr(alignment, "durable", lambda df, **options: (written.append(durable(df, **options)), written[-1])[1])
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 200)
    monkeypatch.setattr(alignment, "SLICE_CHARS", 100)
    rows = [(k, f"The cat number {k} sat on mat {k % 7}, and it was happy there.") for k in range(60)]
    found = alignment.alignment_counts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B)
    assert found.count() == 60
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in written[0].inputFiles()]
    sizes = [m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)]
    assert sum(sizes) > 10 and max(sizes) <= alignment.GROUP_CHUNKS
