import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import rules
from gridloom.llm.queries import queries

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = [w for w in re.split(f"[{SPACE}]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
    )


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "one", "a\n\na\n \na", "x y z w v x y z w v", "the " * 12, "é ü\x0bß 🙂 #*$%&|<>\r\nA B"]
    for _ in range(150):
        n = rng.choice([3, 8, 30, 90])
        out.append("".join(rng.choice(["a", "b", "c", "Dd", "#", "!"]) + rng.choice([" ", "  ", "\n", "\t", " "]) for _ in range(n)))
    return out


def test_statistics_against_brute_force(spark):
    given = texts()
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(given)], "doc_id long, text string, w string, h int")
    got = rules.with_statistics(df).orderBy("doc_id").collect()
    for r in got:
        want = brute(given[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(given[r.doc_id])
        assert (r.w, r.h) == ("clash", 3)


def test_statistics_stay_in_spark(spark):
    plan = rules.with_statistics(spark.createDataFrame([], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_learns_planted_rules(spark):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        a, b, c = rng.random(), rng.random(), rng.random()
        rows.append((i, a, b, c, a > 0.9 or (b < 0.2 and c > 0.5)))
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, bad boolean")
    tested = {k: F.col(k) for k in "abc"}
    found = rules.learn(df, tested, F.col("bad"), F.col("i") % 3 == 0, min_precision=0.8)
    wrong = df.where(found.kept(tested) == F.col("bad")).count()
    assert wrong < 0.05 * len(rows), str(found)
    assert {c.feature for c in found.rules[0]} <= set("abc") and "reject" in str(found)


def plain_list(rows, names, max_rules, max_conditions, min_precision, min_share):
    """Sequential covering over all rows: each rule grown by gain on two parts of three, pruned on the third."""
    cuts = {}
    for j, k in enumerate(names):
        values = sorted(r[j] for r in rows)
        own = {values[max(0, math.ceil(q * len(values)) - 1)] for q in rules.QUANTILES}
        cuts[k] = sorted(own | {min(v for v in values if v > 0)})
    meets = lambda r, rule: all((r[names.index(k)] >= t) == up for k, up, t in rule)
    count = lambda part: (sum(r[-2] for r in part), sum(not r[-2] for r in part))
    found, left = [], rows
    while len(found) < max_rules:
        rule, met = [], [r for r in left if not r[-1]]
        while len(rule) < max_conditions and all(before := count(met)):
            options = [(k, up, t) for k in names for t in cuts[k] for up in (True, False)]
            gains = [rules._gain(*count([r for r in met if meets(r, [c])]), *before) for c in options]
            best = 0.0, None
            for gain, c in zip(gains, options, strict=True):
                if gain > best[0] + 1e-9:
                    best = gain, c
            if not best[1]:
                break
            rule.append(best[1])
            met = [r for r in met if meets(r, rule[-1:])]
        if not rule:
            break
        scored = []
        for j in range(1, len(rule) + 1):
            own = [r for r in left if meets(r, rule[:j])]
            p, n = count([r for r in own if r[-1]] or own)
            scored.append(((p - n) / (p + n), -j, p / (p + n), len(own)))
        _, j, precision, size = max(scored)
        rule = rule[:-j]
        if precision < min_precision or size < max(2, min_share * len(rows)):
            break
        found.append(rule)
        left = [r for r in left if not meets(r, rule)]
    return found


@pytest.mark.parametrize("seed", range(3))
def test_same_list_as_plain_covering(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(900):
        a, b, c = (rng.choice([0.0, rng.randrange(1, 60) / 64]) for _ in range(3))
        rows.append((a, b, c, (a > 0.8 or (b > 0.5 and c < 0.3)) != (rng.random() < 0.04), rng.random() < 0.33))
    df = spark.createDataFrame(rows, "a double, b double, c double, bad boolean, aside boolean")
    tested = {k: F.col(k) for k in "abc"}
    found = rules.learn(df, tested, F.col("bad"), F.col("aside"), 6, 3, 0.7, 0.001)
    want = plain_list(rows, "abc", 6, 3, 0.7, 0.001)
    assert len(want) > 1 and [[(c.feature, c.at_least, c.threshold) for c in r] for r in found.rules] == want


def test_learns_nothing_without_labels(spark):
    df = spark.createDataFrame([], "a double, bad boolean")
    assert rules.learn(df, {"a": F.col("a")}, F.col("bad"), F.lit(False)).rules == []
    good = spark.createDataFrame([(1.0, False), (2.0, None)], "a double, bad boolean")
    assert rules.learn(good, {"a": F.col("a")}, F.col("bad"), F.lit(False)).rules == []


def test_empty_and_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, None), (1, None), (2, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id or 0, r.base_failed, r.kept) for r in rules.judged(docs, labels).collect())
    assert got == [(0, True, False), (1, True, False), (1, True, False), (2, False, True)]
    assert [r.doc_id for r in rules.keep_good(docs.withColumn("n_words", F.lit("x")), labels).collect()] == [2]
    assert rules.judged(docs.limit(0), labels).count() == 0


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries()["op1_quality_rules"](spark, sf).collect()
    assert len(rows) == len(docs)
    right = clean = 0
    for r in rows:
        if len(docs[r.doc_id].text) < 4000:
            want = brute(docs[r.doc_id].text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
        if quality.get(r.doc_id) == 1 and not r.base_failed:
            clean += 1
            right += r.kept
    assert right >= 0.98 * clean
