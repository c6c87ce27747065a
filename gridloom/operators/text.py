"""Words, prefixes, token offsets, answer spans and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import mask, normalize_text, padded, squeeze


#: A token: a run of letters and digits, or a single other sign.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def token_ids(text: Column, vocabulary: int) -> Column:
    """An id from 1 to ``vocabulary`` for each token, from a digest of it in lower case: the same in any engine."""
    id_of = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % vocabulary + 1
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), id_of)


#: Entries of a vocabulary that tasks hold, at most; the longest word that is cut into pieces.
VOCABULARY, LONGEST_WORD = 100_000, 100
UNKNOWN, INNER = "[UNK]", "##"


def piece_vocabulary(docs: DataFrame, text: str = "text", size: int = 30_000) -> list[str]:
    """A plain vocabulary of pieces for texts: the unknown piece, letters and signs, then the commonest whole words.

    Nothing is learned: single characters stand both for beginnings and, after
    ``##``, for what follows; words come by falling count, then in order. The
    list has ``size`` entries at most, so tasks may hold it.
    """
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    signs = found.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"), "n").where("c <> ''").groupBy("c").agg(F.sum("n").alias("n"))
    half = max(1, (min(size, VOCABULARY) - 1) // 4)
    letters = sorted(r["c"] for r in signs.orderBy(F.desc("n"), "c").limit(half).collect())
    head = [UNKNOWN, *letters, *(INNER + c for c in letters)]
    common = [r["word"] for r in found.where(F.char_length("word") > 1).orderBy(F.desc("n"), "word").limit(max(0, min(size, VOCABULARY) - len(head))).collect()]
    return head + common


def word_pieces(word: str, ids: dict[str, int], longest: int) -> list[tuple[str, int, int]]:
    """(piece, start, end) of a word by the longest entries from the left; the unknown piece alone if some part has none."""
    out, at = [], 0
    while at < len(word) and len(word) <= LONGEST_WORD:
        for end in range(min(len(word), at + longest), at, -1):
            piece = (INNER if at else "") + word[at:end]
            if piece in ids:
                break
        else:
            return [(UNKNOWN, 0, len(word))]
        out.append((piece, at, end))
        at = end
    return out if at else [(UNKNOWN, 0, len(word))]


def wordpieces(df: DataFrame, key: str, text: str, vocabulary: list[str], lower: bool = True) -> DataFrame:
    """(key, place, token, id, start, end) for each piece of each text, characters from 0.

    Texts are cut into words and signs (TOKEN), and each of these into the
    longest pieces of ``vocabulary`` from the left, whose places are the ids;
    pieces within a word begin with ``##``. A word with a part that no piece
    covers, or longer than LONGEST_WORD, is ``[UNK]``. Offsets are those of the
    text as given: ``lower`` changes no length, letters whose small form has
    another length stay. Null and blank texts have no piece; other columns are
    ignored. At most VOCABULARY entries are taken, so every task may hold them.
    """
    if len(vocabulary) > VOCABULARY or UNKNOWN not in vocabulary:
        raise ValueError(f"a vocabulary has {VOCABULARY} entries at most, and {UNKNOWN}")
    kind = df.schema[key].dataType.simpleString()
    ids = {p: k for k, p in enumerate(vocabulary)}
    longest = max(map(len, vocabulary))
    # Words with their places: the lengths of what is between tokens and of tokens add up.
    split = F.regexp_extract_all(F.col(text), F.lit(rf"(?s)({TOKEN})|[^\S]+"), F.lit(0))
    read = df.select(F.col(key).alias("_key"), split.alias("_parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[str, int, int]]] = {}
        for batch in batches:
            rows, out = [], []
            for k, parts in enumerate(batch.column(1).to_pylist()):
                at = place = 0
                for part in parts or ():
                    if not part.isspace():
                        word = "".join(c.lower() if len(c.lower()) == 1 else c for c in part) if lower else part
                        if word not in known:
                            known[word] = word_pieces(word, ids, longest)
                        for piece, a, b in known[word]:
                            rows.append(k)
                            out.append((place, piece, ids[piece], at + a, at + b))
                            place += 1
                    at += len(part)
            if len(known) > VOCABULARY:
                known.clear()
            columns = list(zip(*out, strict=True)) or [()] * 5
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *made], names=[key, "place", "token", "id", "start", "end"])

    return read.mapInArrow(run, f"`{key}` {kind}, place long, token string, id long, start long, end long")


def joined_pieces(pieces: DataFrame, key: str) -> DataFrame:
    """(key, text): pieces of ``wordpieces`` put together, words parted by single blanks."""
    whole = F.array_sort(F.collect_list(F.struct("place", "token")))
    glued = F.regexp_replace(F.array_join(F.transform(whole, lambda p: p["token"]), " "), f" {INNER}", "")
    return pieces.groupBy(key).agg(glued.alias("text"))


def words(text: Column) -> Column:
    """Runs of ASCII letters, lower-cased; all else parts words."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z]+", " ")), " "), lambda w: w != "")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def prefixes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(prefix, n): a trie's nodes but the root, and the words that end at each.

    Words are counted before their prefixes are made, so repeats cost nothing.
    """
    counted = word_counts(docs, text)
    ends = F.sequence(F.lit(1), F.length("word"))
    nodes = counted.select("n", "word", F.explode(F.transform(ends, lambda k: F.substring("word", F.lit(1), k))).alias("prefix"))
    return nodes.groupBy("prefix").agg(F.sum(F.when(F.col("word") == F.col("prefix"), F.col("n")).otherwise(0)).alias("n"))


def trie_size(docs: DataFrame, text: str = "text") -> DataFrame:
    return prefixes(docs, text).agg((F.count("*") + 1).alias("nodes"))


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, token, start, end) for each token of each text, characters from 0.

    Tokens are runs of letters and digits, or single other signs; white space
    is none. The text is split without loss, so running lengths give the places.
    Keys tell texts apart.
    """
    alnum, space = r"[\p{L}\p{N}]", r"\s"
    edge = rf"(?<={alnum})(?!{alnum})|(?<!{alnum})(?={alnum})|(?<={space})(?!{space})|(?<!{space})(?={space})|(?<=[^\s\p{{L}}\p{{N}}])"
    parts = df.select(key, F.posexplode(F.split(F.col(text), edge)).alias("_k", "token"))
    upto = Window.partitionBy(key).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    is_token = F.col("token").rlike(r"\S")
    placed = parts.select(
        key,
        (F.count_if(is_token).over(upto) - 1).alias("place"),
        "token",
        F.sum(F.char_length("token")).over(upto).alias("end"),
    )
    return placed.where(is_token).select(key, "place", "token", (F.col("end") - F.char_length("token")).alias("start"), "end")


def span_tokens(tokens_of: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """(key, start_token, end_token): first and last + 1 of the tokens that overlap an answer's characters."""
    a = answers.select(F.col(key).alias("_key"), "answer_start", "answer_end")
    met = tokens_of.join(a, F.col(key) == F.col("_key")).where((F.col("start") < F.col("answer_end")) & (F.col("end") > F.col("answer_start")))
    return met.groupBy(key).agg(F.min("place").alias("start_token"), (F.max("place") + 1).alias("end_token"))


def answer_spans(df: DataFrame, key: str, context: str, question: str, answer: str, start: str, size: int = 384) -> DataFrame:
    """(key, start_token, end_token, n_context, n_question) of questions whose answer can be found.

    White space of the three texts is squeezed first; ``start`` is the answer's
    first character in the squeezed context. Left out are rows whose answer ends
    at or beyond the context's last character, answers that touch no token, and
    rows of more than ``size`` tokens together. A null in any of the columns
    leaves a row out; keys tell rows apart.
    """
    rows = df.select(
        F.col(key).alias("_key"), squeeze(F.col(context)).alias("_context"), squeeze(F.col(question)).alias("_question"),
        F.col(start).cast("int").alias("answer_start"), (F.col(start) + F.char_length(squeeze(F.col(answer)))).cast("int").alias("answer_end"),
    )
    rows = rows.where(F.col("answer_end") < F.char_length("_context"))
    found = tokens(rows, "_key", "_context")
    inside = (F.col("start") < F.col("answer_end")) & (F.col("end") > F.col("answer_start"))
    met = found.join(rows.select(F.col("_key").alias("_of"), "answer_start", "answer_end"), F.col("_key") == F.col("_of"))
    spans = met.groupBy("_key").agg(
        F.min(F.when(inside, F.col("place"))).alias("start_token"), (F.max(F.when(inside, F.col("place"))) + 1).alias("end_token"), F.count("*").alias("n_context")
    )
    asked = rows.select("_key", F.regexp_count("_question", F.lit(TOKEN)).cast("long").alias("n_question"))
    out = spans.where("start_token IS NOT NULL").join(asked, "_key").where(F.col("n_context") + F.col("n_question") <= size)
    return out.withColumnRenamed("_key", key)


def model_inputs(df: DataFrame, context: str, question: str, size: int = 384) -> DataFrame:
    """ids, types and mask of fixed length: context, then the question without its first id; longer rows are dropped."""
    rest = F.slice(F.col(question), 2, F.greatest(F.size(question) - 1, F.lit(0)))
    ids = F.concat(F.col(context), rest)
    types = F.concat(F.array_repeat(F.lit(0), F.size(context)), F.array_repeat(F.lit(1), F.size(rest)))
    made = df.where(F.size(ids) <= size)
    return made.withColumns({"input_ids": padded(ids, size), "token_type_ids": padded(types, size), "attention_mask": mask(ids, size)})


def exact_match(pred: Column, truth: Column) -> Column:
    return (normalize_text(pred) == normalize_text(truth)).cast("int")


def token_f1(pred: Column, truth: Column) -> Column:
    """F1 of the normalised words as multisets; 1 if both are empty."""
    p, t = (F.filter(F.split(normalize_text(x), " "), lambda w: w != "") for x in (pred, truth))
    both = F.array_distinct(F.array_intersect(p, t))
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    common = F.aggregate(both, F.lit(0), lambda n, w: n + F.least(count(p, w), count(t, w)))
    return F.when((F.size(p) == 0) & (F.size(t) == 0), 1.0).otherwise(F.try_divide(2.0 * common, F.size(p) + F.size(t)))

