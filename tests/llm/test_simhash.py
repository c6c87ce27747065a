import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from gridloom.llm import simhash as sh
from gridloom.llm.components import components
from gridloom.llm.queries import queries


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    """Smallest id reachable, by comparing all pairs of fingerprints."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = sorted(set(fps))
    arr = np.array(own, dtype=np.uint64)
    for i, f in enumerate(own):
        for j in np.flatnonzero(np.bitwise_count(arr[:i] ^ arr[i]) <= 2):
            root[find(f)] = find(own[j])
    least = defaultdict(lambda: None)
    for i, f in zip(ids, fps, strict=True):
        k = find(f)
        if i is not None and (least[k] is None or i < least[k]):
            least[k] = i
    return [least[find(f)] for f in fps]


def test_fingerprint_matches_brute_force():
    for text in [None, "", " \t\n", "one", "one Two", "A b c", "a b c d e f g a b c", "é É x y\x0bz w", "x " * 500]:
        assert sh.simhash(text) & (2**64 - 1) == brute_fingerprint(text)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    whole = sh.simhash(text)
    monkeypatch.setattr(sh, "_CHUNK", 100)
    assert sh.simhash(text) == whole


@pytest.mark.parametrize("matrix", [256, 2])
def test_list_links_keep_components(monkeypatch, matrix):
    monkeypatch.setattr(sh, "_MATRIX", matrix)
    rng = random.Random(7)
    base = rng.getrandbits(64)
    fps = sorted({base ^ (rng.getrandbits(16) << 8) for _ in range(60)})
    u, v = sh.list_links(np.array(fps, dtype=np.uint64))
    want = brute_components(fps, fps)
    root = dict(zip(u.tolist(), v.tolist(), strict=True))
    assert [root.get(f, f) for f in fps] == want


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "  \n"), (None, "no id here at all"), (4, "no id here at all")]
    k = 10
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 400]))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((k, " ".join(w)))
            k += 1
    rows += rows[5:9]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted((r.id if r.id is not None else -1, r.fp & (2**64 - 1), r.component_id) for r in sh.simhash_groups(df).collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components([i for i, _ in rows], fps)
    want = sorted((i if i is not None else -1, f, c) for (i, _), f, c in zip(rows, fps, comp, strict=True))
    assert got == want


def test_chain_of_close_fingerprints(spark):
    chain = [0]
    for b in range(0, 62, 2):
        chain.append(chain[-1] ^ (3 << b))
    edges = sh.fingerprint_links(spark.createDataFrame([(f,) for f in chain], "fp long"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {f: min(chain) for f in chain if f != min(chain)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sh.simhash_groups(df).count() == 0
    assert sh.drop_near_copies(df).count() == 0


def test_drop_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "other words are here now"), (3, "other words are here now"), (None, "a b c d")]
    out = sh.drop_near_copies(spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, n long"))
    assert sorted(((r.doc_id or 0), r.text, r.n) for r in out.collect()) == [(0, "a b c d", None), (1, "a b c d", 1), (3, "other words are here now", 3)]


def test_query_on_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    comp = brute_components([r.doc_id for r in docs], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op2_simhash_near_dedup"](spark, sf_dir).collect()}
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(docs, fps, comp, strict=True)}


def test_index_covers_every_pair_and_the_tally_rejects():
    assert {p for x in sh.LEFT_OUT for p in combinations(sorted(x), 2)} == set(combinations(range(8), 2))
    base = np.uint64(0x0123456789ABCDEF)
    three_bytes, two_bytes = base ^ np.uint64(0x010101), base ^ np.uint64(0x0101)
    # Both share a list with the base; only the second shares six bytes.
    assert sh.shared_bytes(np.array([base ^ three_bytes, base ^ two_bytes])).tolist() == [5, 6]
    assert sh.linked(np.array([base ^ three_bytes, base ^ two_bytes])).tolist() == [False, True]
    u, v = sh.list_links(np.array([base, three_bytes]))
    assert len(u) == len(v) == 0


def test_rows_that_share_an_id_go_by_their_text(spark):
    a, b = "a text of some words here", "quite another text than the first one"
    rows = [(1, a), (5, a), (5, b), (7, b), (None, a), (9, None), (8, "  "), (5, b), (None, None)]
    df = spark.createDataFrame([(i, t, k, 1, 2, "r", 3) for k, (i, t) in enumerate(rows)], "doc_id long, text string, fp int, _kept_rows int, id int, row string, stay_id int")
    out = sh.drop_near_copies(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id or 0, (r.text or "").strip()) for r in out.collect())
    assert got == sorted([(1, a), (5, b), (0, a), (8, ""), (0, "")])


def test_wider_shingles(spark):
    text = " ".join(f"w{i}" for i in range(50))
    assert sh.simhash(text, 5) != sh.simhash(text, 3)
    words = text.encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 42) for i in range(46)]
    assert sh.simhash(text, 5) & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    df = spark.createDataFrame([(1, text), (2, text), (3, text + " more words")], "doc_id long, text string")
    assert {r.fp for r in sh.simhash_groups(df, width=5).where("id < 3").collect()} == {sh.simhash(text, 5)}
