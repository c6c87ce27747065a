import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from gridloom.llm.pieces import BLANK, PieceCoder, coded, coded_digests
from gridloom.llm.queries import queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(5)
    alphabet = list("aaabbeeinorst.,  \n\t") + ["é", "ß", "▁", "漢", "🙂", "́", "A", "1"]
    out = ["", " ", "  ", "\n", "a", " a ", "a  b", "\n\n a\n  b", "the the the", "aaaa" * 50, "\x00x", "<s> </s>", "<0x0A>", "x\r\ny", BLANK]
    out += [" " * n + w for n in range(1, 140, 3) for w in ("", "a", "the", "\n", "é")]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(1500)]
    out += ["".join(rng.choice("ab") for _ in range(5000)), "".join(rng.choice("the isa") for _ in range(20000))]
    return out


def check(sp, coder, given):
    for t, got in zip(given, coder.encode_batch(given), strict=True):
        want = sp.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got, dtype="<u4").tolist() == want, repr(t)[:200]
        assert coder.decode(got) == sp.decode(want), repr(t)[:200]


def test_matches_library(sp):
    check(sp, PieceCoder(MODEL), [*texts(), None])


def test_matches_library_one_at_a_time(sp):
    coder = PieceCoder(MODEL)
    for t in texts()[:200]:
        check(sp, coder, [t])


def test_forgets_when_full(sp, monkeypatch):
    monkeypatch.setattr("gridloom.llm.pieces.CACHED_UNITS", 20)
    coder = PieceCoder(MODEL)
    for t in texts()[200:260]:
        check(sp, coder, [t])


def test_odd_tables(spark, sp):
    df = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (2, "", 7), (2, "", 7)], "doc_id long, text string, ids int")
    got = sorted(((r.id or 0), tuple(r.ids), r.decoded) for r in coded(df, MODEL).collect())
    assert got == [(0, tuple(sp.encode("a b", add_bos=True, add_eos=True)), "a b"), (1, (1, 2), ""), (2, (1, 2), ""), (2, (1, 2), "")]
    assert coded(df.limit(0), MODEL).count() == 0


def test_query_on_given_table(spark, sf_dir, sp):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op7_sentencepiece_coding"](spark, sf_dir).collect()}
    for r in rows:
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        sha = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[r.doc_id] == (len(ids), sha, hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert len(got) == len(rows)


def test_large_ids_beside_a_null_one(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    df = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string").coalesce(1)
    assert coded_digests(df, MODEL).toArrow()["id"].to_pylist() == ids
    assert coded(df, MODEL).toArrow()["id"].to_pylist() == ids


def test_long_unbroken_text_takes_time_in_proportion():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    coder, began = PieceCoder(MODEL), time.process_time()
    got = coder.encode_batch([text])[0]
    assert time.process_time() - began < 6
    sp = SentencePieceProcessor(model_file=MODEL)
    assert np.frombuffer(got, dtype="<u4").tolist() == sp.encode(text, add_bos=True, add_eos=True)
