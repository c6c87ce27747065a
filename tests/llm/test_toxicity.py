import math
import random
import zlib
from collections import Counter

import numpy as np

from gridloom.llm import toxicity as tx
from gridloom.llm.queries import queries


def brute(text):
    text = (text or "").lower()
    chars = " " * 8 + "".join(c if c.isalpha() else " " for c in text) + " " * 8
    out = Counter()
    for n in tx.GRAMS:
        for i in range(9 - n, 8 + len(text)):
            g = chars[i : i + n]
            if g[0] == g[-1] == " ":
                continue
            h = 0
            for c in g:
                h = (h * 0x01000193 + ord(c)) % 2**32
            out[((h ^ (h >> 15)) * 0x9E3779B1 % 2**32) >> 12] += 1
    words = max(1, len(chars.split()))
    return {k: math.log1p(tx.RATE * n / words) for k, n in out.items()}


def test_buckets_against_brute_force():
    texts = [None, "", "a", "Hello, World", "x1y é\nß", "hello world", "İstanbul is long"]
    text, bucket, value = tx.buckets(texts)
    for i, t in enumerate(texts):
        own, want = text == i, brute(t)
        assert set(bucket[own].tolist()) == want.keys(), t
        assert np.allclose(value[own], [want[b] for b in bucket[own].tolist()])
        assert set(tx.buckets([t])[1].tolist()) == want.keys()


def test_scores_do_not_depend_on_the_batch():
    table = np.full(tx.BUCKETS, -1, dtype=np.int32)
    own = sorted(brute("you idiot"))
    table[own] = np.arange(len(own))
    m = tx.Model(table, np.linspace(-1, 2, len(own)), -0.5)
    texts = ["you idiot", None, "nice day", "idiot", ""]
    assert np.allclose(m.scores(texts), [m.scores([t])[0] for t in texts])


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "you awful idiot", 1), (2, "nice day", 1), (2, "nice day", 1), (3, None, 1), (None, "x", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = tx.scored(docs, tx.learn(docs, labels)).collect()
    assert len(rows) == 5 and all(r.score < 0.5 for r in rows)
    assert tx.keep_civil(docs, tx.learn(docs, labels)).columns == docs.columns
    assert tx.scored(docs.limit(0), tx.learn(docs.limit(0), labels)).count() == 0


def test_fit_against_a_plain_one(spark):
    """Counts, log-count ratios and the ridge fit from Python's counts and Newton steps; some labels are wrong, so the classes overlap."""
    rng = random.Random(2)
    mild, harsh = ["table", "river", "green", "walking"], ["idiots", "stupid", "river", "table"]
    given = [(k, " ".join(rng.choice(harsh if k % 3 == 0 else mild) for _ in range(rng.randrange(4, 12))), int((k % 3 == 0) != (k % 10 == 5))) for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in given], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in given], "doc_id long, toxic int")
    model = tx.learn(docs, labels)
    y = np.array([y for _, _, y in given], dtype=float)
    own = [brute(t) for _, t, _ in given]
    n1, n0 = (Counter(g for x, k in zip(own, y, strict=True) for g in x if k == c) for c in (1, 0))
    kept = sorted(g for g in n0.keys() | n1.keys() if n0[g] + n1[g] >= tx.MIN_TEXTS)
    assert np.flatnonzero(model.table >= 0).tolist() == kept
    ratio = np.array([math.log((n1[g] + 0.5) / (y.sum() + 1)) - math.log((n0[g] + 0.5) / ((1 - y).sum() + 1)) for g in kept])
    x = np.array([[f.get(g, 0.0) for g in kept] for f in own]) * ratio
    x1 = np.column_stack([x, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    ridge = np.r_[np.full(len(kept), tx.RIDGE / len(y)), 0.0]
    w = np.zeros(len(kept) + 1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x1 @ w))
        step = np.linalg.lstsq((x1.T * (share * p * (1 - p))) @ x1 + np.diag(ridge), x1.T @ (share * (p - y)) + ridge * w, rcond=None)[0]
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    assert np.allclose(model.scores([t for _, t, _ in given]), 1 / (1 + np.exp(-x1 @ w)), atol=0.003)
    # The minimum is flat along n-grams that come together, so the objective is compared, not each weight.
    objective = lambda w: share @ np.logaddexp(0, np.where(y == 1, -1, 1) * (x1 @ w)) + (ridge * w**2).sum() / 2
    got = np.r_[model.weights[model.table[kept]] / ratio, model.bias]
    assert objective(w) <= objective(got) + 1e-12 and objective(got) <= objective(w) * 1.01, (objective(w), objective(got))


def test_query_is_accurate_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries()["op8_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    hit = sum(r.predicted for r in held if toxic[r.doc_id])
    false = sum(r.predicted for r in held if not toxic[r.doc_id])
    n1 = sum(toxic[r.doc_id] for r in held)
    assert hit >= 0.9 * n1 and false <= 0.01 * (len(held) - n1), (hit, n1, false, len(held))
