"""Pieces by longest match, their offsets, and what is put together of them."""

import random
import re

import pytest

from gridloom.operators import text as tx


def greedy(text, vocabulary):
    """(place, piece, id, start, end) of each piece, by looking for the longest entry at each place."""
    out = []
    for m in re.finditer(r"[^\W_]+|[^\w\s]|_", text):
        word, at, own = m[0].lower(), 0, []
        while at < len(word):
            fits = [p for p in vocabulary if p != "[UNK]" and (p[2:] if at and p.startswith("##") else p if not at else None) and word.startswith(p[2:] if at else p, at) and (not at or p.startswith("##"))]
            if not fits:
                own = [("[UNK]", 0, len(word))]
                break
            best = max(fits, key=len)
            end = at + len(best) - (2 if at else 0)
            own.append((best, at, end))
            at = end
        out += [(p, m.start() + a, m.start() + b) for p, a, b in own]
    return [(k, p, vocabulary.index(p), a, b) for k, (p, a, b) in enumerate(out)]


VOCABULARY = ["[UNK]", "un", "##aff", "##able", "a", "##a", "##b", "b", "ab", "##ab", "the", "##s", ".", ",", "é", "##é", "unaff", "12", "##3"]


def test_longest_match_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["unaffable", "The  unaffables, the abba.", "xyz the", "", None, " \t ", "123 12", "éa É", "abc" * 50, "a_b"]
    texts += ["".join(rng.choice("abthes. é123") for _ in range(rng.randint(1, 40))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {}
    for r in tx.wordpieces(df, "k", "text", VOCABULARY).collect():
        got.setdefault(r.k, []).append((r.place, r.token, r.id, r.start, r.end))
    for k, text in enumerate(texts):
        want = greedy(text or "", VOCABULARY)
        if text == "abc" * 50:
            want = [(0, "[UNK]", 0, 0, 150)]
        assert sorted(got.get(k, [])) == want, text
        for _, piece, _, a, b in want:
            assert piece == "[UNK]" or text[a:b].lower() == piece.removeprefix("##")


def test_put_together_and_spans(spark):
    df = spark.createDataFrame([("q", "The unaffable abba. The end")], "k string, text string")
    pieces = tx.wordpieces(df, "k", "text", VOCABULARY)
    assert tx.joined_pieces(pieces, "k").first().text == "the unaffable abba . the [UNK]"
    answers = spark.createDataFrame([("q", 4, 13)], "k string, answer_start int, answer_end int")
    span = tx.span_tokens(pieces, answers, "k").first()
    own = {r.place: r.token for r in pieces.collect()}
    assert [own[p] for p in range(span.start_token, span.end_token)] == ["unaff", "##able"]


def test_plain_vocabulary(spark):
    df = spark.createDataFrame([("aa bb aa c. Aa",), (None,)], "text string")
    assert tx.piece_vocabulary(df) == ["[UNK]", ".", "a", "b", "c", "##.", "##a", "##b", "##c", "aa", "bb"]
    assert tx.piece_vocabulary(df, size=10)[-1] == "aa" or len(tx.piece_vocabulary(df, size=10)) <= 10
    with pytest.raises(ValueError):
        tx.wordpieces(df.selectExpr("1 AS k", "text"), "k", "text", ["a"])
