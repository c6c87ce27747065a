import random
from itertools import combinations

import numpy as np
import pytest

from gridloom.llm import jaccard
from gridloom.llm.queries import queries


def brute_set(text, width=3):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(zip(*(words[i:] for i in range(width)), strict=False))


def brute_groups(rows, width=3, percent=90):
    """(id, size, component) for each (id, text), by comparing all pairs of different sets."""
    sets = [brute_set(t, width) for _, t in rows]
    own = sorted(set(sets) - {frozenset()}, key=len)
    at = {s: k for k, s in enumerate(own)}
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in range(len(own)):
        for a in range(b - 1, -1, -1):
            if 100 * len(own[a]) < percent * len(own[b]):
                break
            same = len(own[a] & own[b])
            if 100 * same >= percent * (len(own[a]) + len(own[b]) - same):
                root[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            k = find(at[s])
            least[k] = min(i, least.get(k, i))
    return [(i, len(s), least.get(find(at[s])) if s else i) for (i, _), s in zip(rows, sets, strict=True)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(-1 if x is None else x for x in r))


def check(spark, rows, **params):
    df = spark.createDataFrame([(i, t, "x", 1, b"y") for i, t in rows], "doc_id long, text string, node string, size int, token binary")
    got = [tuple(r) for r in jaccard.jaccard_groups(df, **params).collect()]
    assert ordered(got) == ordered(brute_groups(rows, params.get("width", 3), params.get("percent", 90)))


def copies(rng, words, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        yield " ".join(w)


@pytest.mark.parametrize("width, percent", [(3, 90), (2, 70)])
def test_groups_against_brute_force(spark, width, percent):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n\t", "one", "One", "one two", "one TWO", "ONE two three", "é É", "é é", "x " * 3000, "x " * 2999]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([2, 4, 12, 30, 60, 200, 500]))]
        texts += copies(rng, words, base, rng.randint(1, 8), rng.choice([0, 1, 2, 6]))
    rows = list(enumerate(texts))
    rows += rows[20:30]  # repeated rows
    rows += [(None, texts[40]), (None, "no id and no copy at all"), (7, texts[50])]  # null ids, one id with two texts
    check(spark, rows, width=width, percent=percent)


def test_dense_group_in_blocks(spark, monkeypatch):
    """Copies near the threshold: lists of several blocks, and pairs that no hub joins."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", 1)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(90)]
    check(spark, list(enumerate(copies(rng, words, base, 150, 5))))


def test_chain_links_across_hubs(spark):
    """Each text shares enough with the next one alone."""
    words = [f"w{i}" for i in range(160)]
    rows = [(k, " ".join(words[k * 3 : k * 3 + 100])) for k in range(20)]
    check(spark, rows)
    assert {c for _, _, c in brute_groups(rows)} == {0}


def test_one_passage_in_many_short_texts(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(k, f"{passage} own{k} word{k} of{k} text{k} here{k}") for k in range(300)] + [(1000, passage), (1001, passage + " more")]
    check(spark, rows)


def test_prefixes_of_different_matches_share_enough():
    """Whatever l each side takes, linked sets share at least the smaller l in their prefixes."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.integers(1, 80))
        a = set(rng.choice(200, size, replace=False).tolist())
        b = set(a)
        for _ in range(int(rng.integers(0, 4))):
            b.discard(int(rng.integers(200)))
            b.add(int(rng.integers(200)))
        same = len(a & b)
        if 100 * same < 90 * (len(a) + len(b) - same):
            continue
        for la, lb in combinations(jaccard.MATCHES, 2):
            if la <= jaccard.needed(len(a), 90) and lb <= jaccard.needed(len(b), 90):
                pa, pb = (set(sorted(x)[: len(x) - jaccard.needed(len(x), 90) + l]) for x, l in ((a, la), (b, lb)))
                assert len(pa & pb) >= min(la, lb)


def test_cost_lengthens_the_prefix():
    few, many = np.full(20, 2), np.full(20, 2)
    assert jaccard.choose(200, 50, 50, few, 20, 90)[1] == 0  # its own alone fill the prefix
    many = np.r_[np.full(4, 3), np.full(16, 3)]
    l_even, _ = jaccard.choose(100, 20, 20, many, 20, 90)
    l_steep, _ = jaccard.choose(100, 20, 20, np.r_[np.full(11, 3), np.full(9, 90_000)], 20, 90)
    assert l_even > l_steep == 1


def test_bitmap_never_rules_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(100):
        a = np.unique(rng.integers(1 << 63, size=300, dtype=np.uint64))
        b = np.unique(np.r_[a[int(rng.integers(20)) :], rng.integers(1 << 63, size=int(rng.integers(20)), dtype=np.uint64)])
        x, y = (np.frombuffer(jaccard.bitmap(z), np.uint64) for z in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_groups(df).count() == 0


def test_query_on_given_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in queries()["op11_jaccard_join"](spark, sf_dir).collect()]
    assert ordered(got) == ordered(brute_groups(docs))
