import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import packing as pk
from gridloom.llm.queries import queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(t, text):
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def verify(rows, texts, tokenizer):
    ids = {k: whole_ids(tokenizer, v) for k, v in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for k, own in by_doc.items():
        at = 0
        for j, r in enumerate(sorted(own, key=lambda r: r.piece)):
            part = ids[k][at : at + 2048]
            assert (r.piece, r.start, r.length) == (j, at, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            at += len(part)
        assert at == len(ids[k])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_seq), -(-sum(map(len, ids.values())) // 2048)


def test_word_ids_are_those_of_the_whole_text():
    t = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    letters = list("abcdeIst'' .,!\n\t\r") + ["ﬁ", "Ⱥ", "Ŀ", "ª", "²", "'ll", "'RE", "\0", "<|", "é", "é", "́", "Σ", "İ", "\x85", " ", "\x1c", "\xa0", "漢", "🙂", "12", "<|endoftext|>"]
    encoder = pk.WordEncoder(PATH)
    given = ["", " ", "<|startoftext|>x", "don't I'll", "x" * 3000]
    given += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    latin = [x for x in letters if max(x) < "ɐ"] + [chr(c) for c in range(0x250)]
    given += ["".join(rng.choice(latin) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for text, got in zip(given, encoder.encode_batch(given), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    for text in given[:50]:
        assert encoder.encode_batch([text, None]) == [pk.WordEncoder.encode_batch(encoder, [text])[0], b""]


def test_word_ids_when_memory_is_full(monkeypatch):
    monkeypatch.setattr(pk, "CACHED_PARTS", 3)
    monkeypatch.setattr(pk, "SLICE_CHARS", 12)
    t, encoder = Tokenizer.from_file(PATH), pk.WordEncoder(PATH)
    for text in ["a b", "c d e f g h", "a b c", "x" * 70 + " a", "l m n o", "a l", "it's a  longer text, cut twice or more"]:
        assert np.frombuffer(encoder.encode_batch([text])[0], dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert len(encoder.known.keys) <= 3 + 16


def test_long_unbroken_text_takes_time_in_proportion():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    encoder, began = pk.WordEncoder(PATH), time.process_time()
    got = encoder.encode_batch([text])[0]
    assert time.process_time() - began < 6
    assert np.frombuffer(got, dtype="<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_large_ids_beside_a_null_one(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    df = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string").coalesce(1)
    assert sorted(pk.pack(df, PATH).toArrow()["id"].to_pylist(), key=str) == sorted(ids, key=str)
    named = spark.createDataFrame([("x", "a b"), (None, "c")], "doc_id string, text string")
    assert {r.id for r in pk.pack(named, PATH).collect()} == {"x", None}


def test_best_two_fit():
    rng = random.Random(1)
    for _ in range(60):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 80))]
        bins = pk.best_two_fit(np.array(lengths, dtype=np.int64), 100)
        assert sorted(v for b in bins for v in b) == sorted(lengths)
        assert all(sum(b) <= 100 for b in bins)
    # Greedy takes 6 and 3 of 10; two that fill the gap of 4 replace the 3.
    assert pk.best_two_fit(np.array([6, 3, 2, 2]), 10)[0] == [6, 2, 2]


def test_pack_odd_rows(spark):
    texts = {1: None, 2: "", 3: "hello world " * 3000, 4: "a"}
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in texts.items()], "doc_id long, text string, piece int, length int")
    rows = pk.pack(df, PATH).withColumnRenamed("id", "doc_id").collect()
    assert verify(rows, texts, Tokenizer.from_file(PATH))[0] == 3
    twice = pk.pack(df.where("doc_id = 3").union(df.where("doc_id = 3")), PATH).collect()
    assert len(twice) == 6 and len({r.sequence_id for r in twice}) in (5, 6)
    assert pk.pack(df.limit(0), PATH).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert [r.offset for r in pk.pack(nulls, PATH).orderBy("offset").collect()] == [0, 2]


def test_query_on_given_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries()["op9_best_fit_packing"](spark, sf_dir).collect()
    used, least = verify(rows, docs, Tokenizer.from_file(PATH))
    assert used <= least * 1.02 + 1
    tables = pk.packed_tables(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH)
    assert tables.agg({"tokens": "max"}).first()[0] <= 2048


def thue_morse(size, flip=False):
    return "".join("ba"[(bin(k).count("1") + flip) % 2] for k in range(size))


def test_parts_of_one_hash_keep_their_own_ids(monkeypatch):
    """Words whose polynomial hashes agree whatever the multiplier, in one batch and in two; then all hashes agree."""
    t, encoder = Tokenizer.from_file(PATH), pk.WordEncoder(PATH)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    got = lambda e, texts: [np.frombuffer(x, "<u4").tolist() for x in e.encode_batch(texts)]
    for size in (1024, 2048):
        pair = [thue_morse(size), thue_morse(size, True)]
        assert got(encoder, [" ".join(pair)])[0] == ids(" ".join(pair))
        assert [got(encoder, [x])[0] for x in pair] == [ids(x) for x in pair]
    clash = pk.WordEncoder(PATH)
    clash.noise = np.zeros_like(clash.noise)
    texts = ["one two three two", "three four one", "five six seven eight", "eight one! two's", "", "four"]
    for _ in range(2):
        assert got(clash, texts) == [ids(x) for x in texts]
        assert [got(clash, [x])[0] for x in texts] == [ids(x) for x in texts]
