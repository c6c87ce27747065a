"""Quality rules: text statistics and a learned decision list.

Statistics are Spark expressions over the words and lines of a text. The list is
learned by sequential covering from labelled statistics: each rule for bad
texts is grown one threshold at a time by the gain over the rows that earlier
rules leave, then pruned on rows set aside. Every step is one aggregation over
binned rows, whose result has a row for each feature and bin. The list comes out
as one ordered Spark conditional.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ASCII_SPACE, discard, durable, sample_by_hash

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "[#*$%&|<>]+"
#: Labelled rows that the rules are fitted on at most, in order of a hash of their ids.
TRAIN_ROWS = 20_000
#: Shares of the labelled rows below each candidate threshold.
QUANTILES = [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.84, 0.88, 0.91, 0.94, 0.96, 0.98, 0.99]

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]


def features(prefix: str = "") -> dict[str, Column]:
    """What rules may test, from statistics whose names begin with ``prefix``."""
    per = lambda a, b: F.col(prefix + a) / F.greatest(F.col(prefix + b), F.lit(1))
    return {
        "words": F.col(f"{prefix}n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "bangs_per_word": per("n_bangs", "n_words"),
    }


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the STATISTICS of its texts, each a long.

    Words are runs of characters other than ASCII white space; a null text has
    none, and all its counts are 0. Windows of five words are told apart by a
    64-bit hash. The columns' names begin with ``prefix``.
    """
    p = f"{prefix}_s_"
    text = F.coalesce(F.col(text_col), F.lit(""))
    blanked = text
    for c in "\t\n\x0b\x0c\r":
        blanked = F.replace(blanked, F.lit(c), F.lit(" "))
    first = docs.withColumn(f"{p}text", text)
    first = first.withColumn(f"{p}words", F.array_remove(F.split(blanked, " "), ""))
    lines = F.filter(F.split(F.col(f"{p}text"), "\n"), lambda x: x.rlike("[^" + ASCII_SPACE[1:]))
    first = first.withColumn(f"{p}lines", lines)
    # A one-element array binds its value, so that the lambda reads it once made.
    hashes = f"""
        CASE WHEN size({p}words) < {WINDOW} THEN array()
        ELSE transform(array({p}words), w -> transform(sequence(0, size(w) - {WINDOW}), i ->
            xxhash64({", ".join(f"w[i + {k}]" if k else "w[i]" for k in range(WINDOW))})))[0] END"""
    first = first.withColumn(f"{p}windows", F.expr(f"cast({hashes} AS array<bigint>)"))
    # Places of windows found again, in order; each covers up to the next one, five words at most.
    again = f"""
        CASE WHEN size(array_distinct({p}windows)) = size({p}windows) THEN 0L
        ELSE transform(array(sort_array(transform({p}windows, (h, i) -> struct(h, i)))), s ->
             transform(array(sort_array(filter(transform(s, (x, k) ->
                 CASE WHEN x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h THEN x.i END), i -> i IS NOT NULL))), at ->
             aggregate(transform(at, (i, k) -> least({WINDOW}, coalesce(get(at, k + 1), i + {WINDOW}) - i)),
                 0L, (total, n) -> total + n))[0])[0] END"""
    whole = F.col(f"{p}text")
    counts = {
        "n_words": F.size(f"{p}words"),
        "word_chars": F.char_length(F.array_join(f"{p}words", "")),
        "n_symbols": F.char_length(whole) - F.char_length(F.regexp_replace(whole, SYMBOLS, "")),
        "n_dup_lines": F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines")),
        "n_repeat_words": F.expr(again),
        "n_lines": F.size(f"{p}lines"),
        "n_upper": F.char_length(whole) - F.char_length(F.regexp_replace(whole, r"\p{Lu}+", "")),
        "n_bangs": F.char_length(whole) - F.char_length(F.replace(whole, F.lit("!"), F.lit(""))),
    }
    made = [c.cast("long").alias(prefix + k) for k, c in counts.items()]
    return first.select(*[F.col(f"`{c}`") for c in docs.columns], *made)


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > REPEAT_PERCENT * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self, tested: dict[str, Column]) -> Column:
        value = tested[self.feature]
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; a text that meets one is rejected, any other is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def kept(self, tested: dict[str, Column]) -> Column:
        out = None
        for rule in self.rules:
            meets = F.lit(True)
            for c in rule:
                meets = meets & c.column(tested)
            out = F.when(meets, F.lit(False)) if out is None else out.when(meets, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "".join(f"if {' and '.join(map(str, r))}: reject\n" for r in self.rules) + "otherwise: keep"


def _gain(p: float, n: float, p_before: float, n_before: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p_before / (p_before + n_before))) if p else 0.0


def learn(
    rows: DataFrame,
    tested: dict[str, Column],
    bad: Column,
    set_aside: Column,
    max_rules: int = 12,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_share: float = 0.0005,
) -> DecisionList:
    """The decision list for ``bad`` rows.

    Rows for which ``bad`` is null are left out. A rule is kept if on the rows
    set aside it is right for ``min_precision`` of those that it meets (on all
    rows, if it meets none of these), and if it meets ``min_share`` of the rows.
    Without labels, or without bad rows, the list is empty and keeps all.
    """
    names = list(tested)
    flagged = rows.select(*[c.alias(k) for k, c in tested.items()], bad.alias("bad"), set_aside.alias("aside")).where("bad IS NOT NULL")
    # Quantiles, and the least positive value, which parts rows that have none of a thing.
    cut = flagged.agg(
        *[F.percentile_approx(k, QUANTILES, 10_000).alias(k) for k in names],
        *[F.min(F.when(F.col(k) > 0, F.col(k))).alias(f"least_{k}") for k in names],
    ).first()
    cuts = {k: sorted({*(cut[k] or []), *([cut[f"least_{k}"]] if cut[f"least_{k}"] is not None else [])}) for k in names}
    if not any(cuts.values()):
        return DecisionList()
    bins = [sum((F.when(F.col(k) >= t, 1).otherwise(0) for t in cuts[k]), F.lit(0)).alias(k) for k in names]
    cells = flagged.select(*bins, "bad", "aside").groupBy(*names).agg(
        *[F.count_if(F.col("bad") == b).alias("all_p" if b else "all_n") for b in (True, False)],
        *[F.count_if((F.col("bad") == b) & ~F.col("aside")).alias("grow_p" if b else "grow_n") for b in (True, False)],
        *[F.count_if((F.col("bad") == b) & F.col("aside")).alias("prune_p" if b else "prune_n") for b in (True, False)],
    )
    written = durable(cells.coalesce(1))
    cells = written.coalesce(1)  # a few rows for each bin: its sums need no shuffle
    binned = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("bin")) for k in names])).alias("x")

    def test(k: str, at_least: bool, i: int) -> Column:
        return F.col(k) >= i if at_least else F.col(k) < i

    def grown(left: DataFrame) -> list[tuple[str, bool, int]]:
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < max_conditions:
            met = left
            for c in rule:
                met = met.where(test(*c))
            counts = met.select(binned, "grow_p", "grow_n").groupBy("x.feature", "x.bin").agg(F.sum("grow_p"), F.sum("grow_n")).collect()
            by: dict[str, dict[int, tuple[int, int]]] = {k: {} for k in names}
            for k, i, p, n in counts:
                by[k][i] = (p, n)
            p0, n0 = (sum(x[j] for x in by[names[0]].values()) for j in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for k in names:
                for i in range(1, len(cuts[k]) + 1):
                    p, n = (sum(x[j] for b, x in by[k].items() if b >= i) for j in (0, 1))
                    for side, (a, b) in ((True, (p, n)), (False, (p0 - p, n0 - n))):
                        if (gain := _gain(a, b, p0, n0)) > best[0] + 1e-9:
                            best = (gain, (k, side, i))
            if best[1] is None:
                break
            rule.append(best[1])
        return rule

    def pruned(left: DataFrame, rule: list[tuple[str, bool, int]]) -> tuple[list[tuple[str, bool, int]], float, int]:
        sums, meets = [], F.lit(True)
        for j, c in enumerate(rule):
            meets = meets & test(*c)
            sums += [F.sum(F.when(meets, F.col(x)).otherwise(0)).alias(f"{x}_{j}") for x in ("prune_p", "prune_n", "all_p", "all_n")]
        got = left.agg(*sums).first()
        scored = []
        for j in range(len(rule)):
            p, n, ap, an = (got[f"{x}_{j}"] or 0 for x in ("prune_p", "prune_n", "all_p", "all_n"))
            p, n = (p, n) if p + n else (ap, an)
            scored.append(((p - n) / (p + n) if p + n else -1.0, -j, p / (p + n) if p + n else 0.0, ap + an))
        _, j, precision, met = max(scored)
        return rule[: 1 - j], precision, met

    total = cells.agg(F.sum(F.col("all_p") + F.col("all_n"))).first()[0] or 0
    found, left = DecisionList(), cells
    while len(found.rules) < max_rules:
        rule = grown(left)
        if not rule:
            break
        rule, precision, met = pruned(left, rule)
        if precision < min_precision or met < max(2, min_share * total):
            break
        found.rules.append([Condition(k, side, float(cuts[k][i - 1])) for k, side, i in rule])
        meets = F.lit(True)
        for c in rule:
            meets = meets & test(*c)
        left = left.where(~meets)
    discard(written)
    return found


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DecisionList:
    """The decision list from ``labels(id_col, quality)``, where quality 0 is bad.

    It is fitted on TRAIN_ROWS labelled rows at most; texts that fail the base
    rule are left to that rule.
    """
    picked = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
    picked = picked.select(F.col(id_col).alias("_label_id"), F.col("quality").alias("_quality"))
    picked = durable(sample_by_hash(picked, "_label_id", TRAIN_ROWS))
    read = docs.select(F.col(id_col).alias("_doc_id"), F.col(text_col).alias("_text"))
    # The broadcast side has TRAIN_ROWS pairs of numbers at most.
    labelled = durable(read.join(F.broadcast(picked), F.col("_doc_id") == F.col("_label_id")))
    # Written between, or the filter and its statistics would go below the join.
    counted = durable(with_statistics(labelled, "_text").drop("_text"))
    aside = F.crc32(F.col("_doc_id").cast("string").cast("binary")) % 3 == 0
    found = learn(counted.where(~base_failed()), features(), F.col("_quality") == 0, aside)
    discard(picked, labelled, counted)
    return found


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, STATISTICS, base_failed, kept) for each row of ``docs``.

    A null or empty text has no word and so fails the base rule. Repeated rows
    and null ids are judged alike, each by itself, and all come back; other
    columns are ignored, whatever their names; an empty table gives an empty one.
    """
    found = learn_quality(docs, labels, id_col, text_col)
    counted = with_statistics(docs.select(id_col, text_col), text_col).drop(text_col)
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & found.kept(features()))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the base rule or the list rejects.

    Nulls, repeated rows and null ids are treated as by ``judged``. Columns come
    back as they are, also those that share the statistics' names; names that
    begin with ``_rule_`` are reserved.
    """
    found = learn_quality(docs, labels, id_col, text_col)
    counted = with_statistics(docs, text_col, "_rule_")
    kept = ~base_failed("_rule_") & found.kept(features("_rule_"))
    return counted.where(kept).select(*docs.columns)
