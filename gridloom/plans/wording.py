"""Strings, words, tokens and answer spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars as sc
from gridloom.operators import text as tx
from gridloom.plans.preparation import tokens_sql
from gridloom.plans.registry import query
from gridloom.sources.tables import table


@query("SELECT p_partkey, reverse(p_name) AS reversed, starts_with(p_type, 'S') AS small, ends_with(p_type, 'L') AS ends FROM part")
def string_tests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", F.reverse("p_name").alias("reversed"), F.col("p_type").startswith("S").alias("small"), F.col("p_type").endswith("L").alias("ends")
    )


_PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


# RE2 has no look-around: neighbours are captured, and a second pass takes articles next to each other.
_ARTICLES = "(^|[^\\p{L}\\p{N}_])(a|an|the)($|[^\\p{L}\\p{N}_])"


def _normal(column: str) -> str:
    bare = f"translate(lower({column}), {_PUNCT}, '')"
    once = f"regexp_replace({bare}, '{_ARTICLES}', '\\1 \\3', 'g')"
    twice = f"regexp_replace({once}, '{_ARTICLES}', '\\1 \\3', 'g')"
    return f"trim(regexp_replace({twice}, '{sc.WHITE_SPACE}+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, {_normal('text')} AS normal FROM conversations")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", sc.normalize_text(F.col("text")).alias("normal"))


@query(f"SELECT conv_id, turn, trim(regexp_replace(text, '{sc.WHITE_SPACE}+', ' ', 'g')) AS squeezed FROM conversations")
def squeeze_ws(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", sc.squeeze(F.col("text")).alias("squeezed"))


@query("SELECT conv_id, turn, substr(text, 4, greatest(0, least(12, length(text)) - 3)) AS span FROM conversations")
def substr_span(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", sc.span(F.col("text"), F.lit(3), F.lit(12)).alias("span"))


@query("SELECT conv_id, turn, replace(replace(role, 'user', '0'), 'assistant', '1') AS label FROM conversations")
def label_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", sc.replaced(F.col("role"), {"user": "0", "assistant": "1"}).alias("label"))


@query("SELECT p_partkey, p_size::BIGINT AS nx, (p_size + 1)::BIGINT AS ny, (p_size + 1)::BIGINT AS nz FROM part WHERE p_size > 0")
def dimension_parse(spark: SparkSession, sf: str) -> DataFrame:
    spec = F.concat(F.col("p_size"), F.lit("x9:"), F.col("p_size") + 1)
    return table(spark, sf, "part").where("p_size > 0").select("p_partkey", *[c.alias(k) for k, c in sc.dimensions(spec).items()])


_WORDS = "(SELECT unnest(string_split(regexp_replace(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), '[^a-z ]', '', 'g'), ' ')) AS word FROM documents)"


@query(f"SELECT word, count(*) AS n FROM {_WORDS} WHERE word <> '' GROUP BY word")
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tx.word_counts(table(spark, sf, "documents"))


_PREFIX = f"(SELECT word, n, unnest(list_transform(range(1, length(word) + 1), lambda k: left(word, k::BIGINT))) AS prefix FROM (SELECT word, count(*) AS n FROM {_WORDS} WHERE word <> '' GROUP BY word))"


@query(f"SELECT prefix, sum(CASE WHEN word = prefix THEN n ELSE 0 END)::BIGINT AS n FROM {_PREFIX} GROUP BY prefix")
def trie_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tx.prefixes(table(spark, sf, "documents"))


@query(f"SELECT count(DISTINCT prefix) + 1 AS nodes FROM {_PREFIX}")
def trie_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return tx.trie_size(table(spark, sf, "documents"))


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws("-", "conv_id", "turn")
    return table(spark, sf, "conversations").select(key.alias("key"), "text")


_KEYED = "(SELECT conv_id || '-' || turn AS key, text FROM conversations)"


@query(f"SELECT * FROM {tokens_sql(_KEYED)}")
def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return tx.tokens(_keyed(spark, sf), "key", "text")


@query(
    f"""WITH toks AS (SELECT key, start, lower(token) AS word FROM {tokens_sql(_KEYED)}),
    counts AS (SELECT word, count(*) AS n FROM toks GROUP BY word),
    signs AS (SELECT c, sum(n) AS n FROM (SELECT n, unnest(list_distinct(string_split(word, ''))) AS c FROM counts) GROUP BY c),
    letters AS (SELECT c, row_number() OVER (ORDER BY c) AS k, count(*) OVER () AS m FROM (SELECT c FROM signs ORDER BY n DESC, c LIMIT 7499)),
    common AS (SELECT word, 2 * m + row_number() OVER (ORDER BY n DESC, word) AS id FROM counts, (SELECT any_value(m) AS m FROM letters) WHERE length(word) > 1 QUALIFY id < 30000),
    heads AS (SELECT w.word, max(length(p.word)) AS m FROM (SELECT word, unnest(range(2, length(word) + 1)) AS l FROM counts) w JOIN common p ON p.word = substring(w.word, 1, l) GROUP BY 1),
    placed AS (SELECT word, coalesce(m, 1) AS m, unnest(range(0, length(word) - coalesce(m, 1) + 1)) AS o FROM counts LEFT JOIN heads USING (word)),
    cut AS (SELECT word, o, CASE WHEN o = 0 THEN 0 ELSE m + o - 1 END AS off, CASE WHEN o = 0 THEN m ELSE 1 END AS size FROM placed),
    named AS (SELECT c.word, off, size, CASE WHEN o = 0 THEN '' ELSE '##' END || substring(c.word, off + 1, size) AS token, CASE WHEN size > 1 THEN p.id WHEN o = 0 THEN l.k ELSE l.m + l.k END AS id
      FROM cut c LEFT JOIN common p ON c.size > 1 AND p.word = substring(c.word, 1, size) LEFT JOIN letters l ON c.size = 1 AND l.c = substring(c.word, off + 1, 1))
    SELECT key, row_number() OVER (PARTITION BY key ORDER BY start + off) - 1 AS place, token, id, start + off AS start, start + off + size AS "end" FROM toks JOIN named USING (word)"""
)
def wordpiece_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of each turn, by a vocabulary of the turns' letters and commonest words."""
    turns = _keyed(spark, sf)
    return tx.wordpieces(turns, "key", "text", tx.piece_vocabulary(turns))


@query(f'SELECT key, min(place) AS start_token, max(place) + 1 AS end_token FROM {tokens_sql(_KEYED)} WHERE start < 20 AND "end" > 5 GROUP BY key')
def span_align(spark: SparkSession, sf: str) -> DataFrame:
    """The tokens that characters 5 to 20 of each turn touch."""
    turns = _keyed(spark, sf)
    answers = turns.select("key", F.lit(5).alias("answer_start"), F.lit(20).alias("answer_end"))
    return tx.span_tokens(tx.tokens(turns, "key", "text"), answers, "key")


@query(
    f"SELECT round(avg(({_normal('text')} = {_normal('upper(text)')})::INTEGER::DOUBLE), 6) AS exact, count(*) AS n FROM conversations"
)
def exact_match(spark: SparkSession, sf: str) -> DataFrame:
    hit = tx.exact_match(F.col("text"), F.upper("text"))
    return table(spark, sf, "conversations").agg(F.round(F.avg(hit), 6).alias("exact"), F.count("*").alias("n"))


_WORDS_OF = f"SELECT conv_id, turn, list_filter(string_split({_normal('text')}, ' '), lambda w: w <> '') AS w FROM conversations"
_BAGS = "SELECT conv_id, turn, word, count(*) AS c FROM (SELECT conv_id, turn, unnest(w) AS word FROM words) GROUP BY ALL"


@query(
    f"WITH words AS ({_WORDS_OF}), bags AS ({_BAGS}), common AS (SELECT a.conv_id, a.turn, sum(least(a.c, b.c)) AS c FROM bags a JOIN bags b"
    " ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn AND b.word = a.word GROUP BY a.conv_id, a.turn)"
    " SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 1 ELSE 2 * coalesce(c.c, 0)::DOUBLE / (len(a.w) + len(b.w)) END, 6) AS f1"
    " FROM words a JOIN words b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn LEFT JOIN common c ON c.conv_id = a.conv_id AND c.turn = a.turn"
)
def token_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn against the one before it in its conversation."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    met = rows.join(before, ["conv_id", "turn"])
    return met.select("conv_id", "turn", F.round(tx.token_f1(F.col("before"), F.col("text")), 6).alias("f1"))


@query("SELECT vec_id, size, ones FROM (SELECT vec_id, 20 AS size, label % 5 + 3 + 2 AS ones FROM embeddings)")
def model_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-length inputs of a context of label % 5 + 3 ids and a question of 3."""
    ids = table(spark, sf, "embeddings").select(
        "vec_id", F.array_repeat(F.lit(7), (F.col("label") % 5 + 3).cast("int")).alias("c"), F.array(F.lit(1), F.lit(8), F.lit(9)).alias("q")
    )
    made = tx.model_inputs(ids, "c", "q", 20)
    return made.select("vec_id", F.size("input_ids").alias("size"), F.size(sc.masked(F.col("input_ids"), F.col("attention_mask"))).alias("ones"))
