"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent character n-grams in order. A text's
own most frequent n-grams are compared with each profile: an n-gram adds the
distance between its two ranks, or the profile's length if the profile lacks it,
and the language with the least sum is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import discard, durable, id_and_text, mapped, sample_by_hash, small_batches

MAX_N = 3
PROFILE = 400
#: Documents of each language that its profile is counted on at most, in order of a hash of their ids.
TRAIN_DOCS = 1_000
UNDETERMINED = "und"
_BITS = 21  # of a code point


def gram_codes(text: str) -> np.ndarray:
    """Each n-gram of the lower-cased words as a number, repeats included.

    Words are runs of letters, with a blank on either side; a text without a
    letter has none.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = np.unique(codes)
    letters = kinds[[chr(c).isalpha() for c in kinds.tolist()]]
    if not len(letters):
        return np.zeros(0, dtype=np.uint64)
    letter = np.isin(codes, letters)
    codes = np.where(letter, codes, 32)
    codes = codes[letter | np.r_[True, letter[:-1]]]  # one blank for each gap
    codes = np.r_[32, codes, 32].astype(np.uint64)
    blank = codes == 32
    grams, gram, inside = [], np.zeros(len(codes), np.uint64), np.ones(len(codes), bool)
    for n in range(1, MAX_N + 1):
        last = codes[n - 1 :]
        gram = (gram[: len(last)] << np.uint64(_BITS)) | last
        # A blank may begin or end an n-gram, not lie within it or stand alone.
        if n == 1:
            grams.append(gram[~blank])
        else:
            inside = inside[: len(last)] & (~blank[n - 2 : n - 2 + len(last)] if n > 2 else True)
            grams.append(gram[inside & ~(blank[: len(last)] & blank[n - 1 :] & (n == 2))])
    return np.concatenate(grams)


def top_grams(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order; of equal ones the smaller number first."""
    if len(codes) > most:
        enough = np.partition(counts, len(counts) - most)[len(counts) - most]
        codes, counts = codes[counts >= enough], counts[counts >= enough]
    return codes[np.lexsort((codes, -counts))][:most]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.codes = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.uint64))
        self.ranks = np.full((len(self.langs), len(self.codes)), -1, dtype=np.int64)
        for row, lang in zip(self.ranks, self.langs, strict=True):
            own = np.array(profiles[lang], dtype=np.uint64)
            row[np.searchsorted(self.codes, own)] = np.arange(len(own))

    def distances(self, text: str) -> tuple[np.ndarray, int] | None:
        """Each language's sum, and the largest possible; None without a letter."""
        codes, counts = np.unique(gram_codes(text), return_counts=True)
        if not len(codes):
            return None
        own = top_grams(codes, counts)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = np.where(self.codes[at] == own, self.ranks[:, at], -1)
        out = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        return out, PROFILE * len(own)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 less its share of the largest distance.

        Ties go to the language first in order. A null text, or one without a
        letter, or any text where no profile is known, is UNDETERMINED at 0.
        """
        found = self.distances(text) if text and self.langs else None
        if found is None:
            return UNDETERMINED, 0.0
        distance, most = found
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / most


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of all languages in ``docs``; rows with a null language or text are left out.

    Only the n-grams' counts of TRAIN_DOCS documents a language leave the
    executors, and of those PROFILE for each language.
    """
    small_batches(docs.sparkSession)
    named = docs.where(F.col(lang_col).isNotNull())
    named = named.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    picked = sample_by_hash(named.select("_id", "lang"), "_id", TRAIN_DOCS, "lang")
    picked = durable(picked.select("_id").distinct().withColumnRenamed("_id", "_picked"))
    # The side that Spark may broadcast has TRAIN_DOCS ids a language at most.
    read = named.join(picked, F.col("_id").eqNullSafe(F.col("_picked"))).where("text IS NOT NULL").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, own in pdf.groupby("lang")["text"]:
                codes, counts = np.unique(np.concatenate([gram_codes(t) for t in own]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": codes.view(np.int64), "n": counts})

    counted = read.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    frequent = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("_rank", F.row_number().over(frequent)).where(F.col("_rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "_rank", "gram").collect()):
        profiles.setdefault(r.lang, []).append(r.gram)
    discard(picked)
    return Profiles(profiles)


def identified(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each whole text.

    Repeated rows and null ids come back as they are; other columns are ignored.
    """

    def run(texts: list[str | None]) -> dict[str, list]:
        found = [profiles.predict(t) for t in texts]
        return {"lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

    return mapped(id_and_text(docs, id_col, text_col), run, {"lang_pred": "string", "score": "double"})
