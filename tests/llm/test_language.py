from collections import Counter

from gridloom.llm import language as lg
from gridloom.llm.queries import queries


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        out.update(w)
        p = f" {w} "
        for n in (2, 3):
            out.update(p[i : i + n] for i in range(len(p) - n + 1))
    return out


def decode(code):
    out = ""
    while code:
        out = chr(code & (2**21 - 1)) + out
        code >>= 21
    return out


def test_grams_against_brute_force():
    for text in ["", " ", "123 !", "a", "a b", "Abc, déf!! ghi\n\nj", "ñ ñ 漢字 x1y", "  lead and trail  "]:
        assert Counter(decode(c) for c in lg.gram_codes(text).tolist()) == brute_grams(text), text


def test_out_of_place_distance():
    grams = lambda s: [int.from_bytes(b"", "big") | ord(c) for c in s]
    p = lg.Profiles({"x": grams("abc"), "y": grams("cba")})
    own = lg.top_grams(*__import__("numpy").unique(lg.gram_codes("aab"), return_counts=True))
    want = []
    for prof in ("abc", "cba"):
        ranks = {ord(c): i for i, c in enumerate(prof)}
        want.append(sum(abs(ranks[g] - i) if g in ranks else lg.PROFILE for i, g in enumerate(own.tolist())))
    assert p.distances("aab")[0].tolist() == want
    assert p.predict("aab")[0] == "x" and p.predict(None) == ("und", 0.0) and p.predict("12 !") == ("und", 0.0)
    assert lg.Profiles({}).predict("abc") == ("und", 0.0)


def test_odd_tables(spark):
    df = spark.createDataFrame(
        [(1, "hello there world", "en", 1), (2, "bonjour le monde", "fr", 1), (2, "bonjour le monde", "fr", 1), (3, None, "fr", 1), (None, "hello", None, 2)],
        "doc_id long, text string, lang string, gram int",
    )
    profiles = lg.learn_profiles(df)
    assert profiles.langs == ["en", "fr"]
    got = sorted((r.id or 0, r.lang_pred) for r in lg.identified(df, profiles).collect())
    assert got == [(0, "en"), (1, "en"), (2, "fr"), (2, "fr"), (3, "und")]
    assert lg.identified(df.limit(0), lg.learn_profiles(df.limit(0))).count() == 0


def test_query_is_accurate_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries()["op5_language_id"](spark, sf).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_large_ids_beside_a_null_one(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    df = spark.createDataFrame([(i, "ab", "en") for i in ids], "doc_id long, text string, lang string").coalesce(1)
    assert lg.identified(df, lg.learn_profiles(df)).toArrow()["id"].to_pylist() == ids


def test_profiles_against_plain_counts(spark):
    rows = [(i, f"{w} {w[::-1]} x{i}", lang) for i, (w, lang) in enumerate([("hello", "en"), ("there", "en"), ("monde", "fr"), ("a" * 50_000, "fr")])]
    profiles = lg.learn_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for lang in ("en", "fr"):
        counts = Counter()
        for _, text, own in rows:
            counts.update(lg.gram_codes(text).tolist() if own == lang else [])
        want = [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][: lg.PROFILE]
        row = profiles.ranks[profiles.langs.index(lang)]
        assert [int(profiles.codes[at]) for at in sorted((r, i) for i, r in enumerate(row.tolist()) if r >= 0) for at in at[1:]] == want
