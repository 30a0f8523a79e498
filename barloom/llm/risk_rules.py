"""Quality rules whose cutoffs carry a guarantee: no more than a set share of good documents is rejected.

Each rule measures a text and has a fixed grid of cutoffs, loosest first. In every stratum the labelled good documents
are the holdout. Cutoffs are tested from loose to tight; one is certified while the exact binomial probability of seeing so
few false rejections, were their true share `risk / rules`, stays at or under `error / (strata * rules)` (fixed-sequence testing
inside a rule, Bonferroni between rules and strata). Of the certified cutoffs the one that separates bad from good best is taken. With
probability 1 - error no stratum then loses more than `risk` of its good documents to the rules.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import written

RISK = 0.02
ERROR = 0.05
WINDOW = 8
#: Thresholds with more strata than this are joined by a shuffle instead of being sent to every task.
BROADCAST_STRATA = 10_000
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rule -> cutoffs, loosest first; a text is rejected when it measures more.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.0, 0.5, 0.25, 0.1, 0.05, 0.02),
    "duplicate_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeated_word_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1),
    "word_length": (14.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0, 6.5),
    "short_word_length": (-2.0, -2.5, -3.0, -3.5, -4.0, -4.25),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, also where the body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, width: int) -> Column:
    """Words inside windows of `width` words that occur twice or more, counted once each.

    Windows are compared by 64-bit hashes within one text. Texts without a repeated window stop at the distinct count;
    in the others equal hashes meet by sorting, and the covered stretch after each position is at most `width` words.
    """

    def covered(at: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda j: F.least(F.lit(width), F.get(at, j) - F.get(at, j - 1)))
        return F.when(F.size(at) < 2, F.lit(width) * F.size(at)).otherwise(F.aggregate(gaps, F.lit(width), lambda a, x: a + x))

    def repeated(pairs: Column) -> Column:
        h = lambda j: F.get(pairs, j)["h"]
        same = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda j: F.coalesce(h(j) == h(j - 1), F.lit(False)) | F.coalesce(h(j) == h(j + 1), F.lit(False)))
        return F.sort_array(F.transform(same, lambda j: F.get(pairs, j)["i"]))

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(_let(pairs, repeated), covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(_let(windows, of))


def measures(text: Column) -> Column:
    """Struct of `COUNTS` (long) for a text; null counts as empty. Words are runs without ASCII white space."""
    text = F.coalesce(text, F.lit(""))
    without = lambda s, gone: F.length(F.translate(s, gone, ""))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).alias("n"), _repeat_words(words, WINDOW).alias("r"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("d"))

    def both(t: Column) -> Column:
        words = _let(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""), of_words)
        lines = _let(F.filter(F.split(t, "\n"), lambda x: without(x, SPACE) > 0), of_lines)
        return _let(F.struct(words.alias("w"), lines.alias("l")), lambda x: F.struct(*[
            c.cast("bigint").alias(name) for name, c in zip(COUNTS, (
                x["w"]["n"], without(t, SPACE), F.length(t) - without(t, SYMBOLS), x["l"]["n"], x["l"]["d"], x["w"]["r"],
            ))
        ]))

    return _let(text, both)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def values(m: Column) -> dict[str, Column]:
    """What each rule measures; null (never rejected) where a text has no word or line."""
    word_length = F.try_divide(m["word_chars"], m["n_words"])
    return {
        "symbols_per_word": F.try_divide(m["n_symbols"], m["n_words"]),
        "duplicate_line_share": F.try_divide(m["n_dup_lines"], m["n_lines"]),
        "repeated_word_share": F.try_divide(m["n_repeat_words"], m["n_words"]),
        "word_length": word_length,
        "short_word_length": -word_length,
    }


def _few_enough(k: Column, n: Column, share: float, level: Column) -> Column:
    """P(X <= k) <= level for X binomial(n, share), term by term in logarithms; false at once where k is over the mean."""
    odds = math.log(share / (1 - share))
    start = F.struct((n * math.log1p(-share)).alias("term"), F.exp(n * math.log1p(-share)).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.ln((n - i + 1) / i) + F.lit(odds)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * share, False).otherwise(F.aggregate(steps, start, add)["sum"] <= level)


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """`stratum, cutoffs` (map of rule to cutoff) from rows `doc_id, stratum, m` and labels `doc_id, quality`.

    Every labelled document takes part. A document labelled more than once is good only if all its labels say so; labels other
    than 0 and 1, null ids and documents that fail the base rule are left out (the base rule rejects those anyway). A stratum with
    too few good documents gets no cutoff, so nothing of it is rejected; without labels the table is empty.
    """
    label = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("good"))
    rows = measured.where(~base_failed(F.col("m"))).join(label, "doc_id")
    over = F.map_from_entries(F.array(*[
        F.struct(F.lit(rule), sum(F.coalesce((v > c).cast("int"), F.lit(0)) for c in GRIDS[rule])) for rule, v in values(F.col("m")).items()
    ]))
    # per text and rule the number of cutoffs it exceeds; grids run from loose to tight, so that says which
    counts = (
        rows.select("stratum", "good", F.explode(over).alias("rule", "passed"))
        .groupBy("stratum", "rule", "passed").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    )
    grid = F.create_map(*[x for rule, g in GRIDS.items() for x in (F.lit(rule), F.array(*map(F.lit, g)))])
    totals = written(counts.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.collect_list(F.struct("passed", "good", "bad")).alias("by")
    ), "counts")
    hit = lambda field: F.aggregate(F.filter("by", lambda x: x["passed"] > F.col("at")), F.lit(0).cast("bigint"), lambda a, x: a + x[field])
    tests = totals.select("*", F.posexplode(F.element_at(grid, F.col("rule"))).alias("at", "cutoff")).withColumns({"false": hit("good"), "true": hit("bad")})
    level = F.lit(error / (max(totals.select("stratum").distinct().count(), 1) * len(GRIDS)))
    tests = tests.withColumn("ok", _few_enough(F.col("false"), F.col("n_good"), risk / len(GRIDS), level))
    so_far = Window.partitionBy("stratum", "rule").orderBy("at")
    gain = F.col("true") / F.greatest("n_bad", F.lit(1)) - F.col("false") / F.greatest("n_good", F.lit(1))
    best = (
        tests.withColumn("certified", F.min("ok").over(so_far)).where("certified").withColumn("gain", gain).where("gain > 0")
        .groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", -F.col("at"))).alias("cutoff"))
    )
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def kept(m: Column, cutoffs: Column) -> Column:
    """Not failed by the base rule and over no certified cutoff of the stratum."""
    over = [F.coalesce(v > F.element_at(cutoffs, rule), F.lit(False)) for rule, v in values(m).items()]
    rejected = base_failed(m)
    for x in over:
        rejected = rejected | x
    return ~rejected


def with_cutoffs(rows: DataFrame, limits: DataFrame, on: str) -> DataFrame:
    """Rows with their stratum's cutoffs; the table of strata is written, so its size is known before it is sent anywhere."""
    limits = written(limits.withColumnRenamed("stratum", on), "cutoffs")
    small = limits.count() <= BROADCAST_STRATA
    return rows.join(F.broadcast(limits) if small else limits, rows[on].eqNullSafe(limits[on]), "left").drop(limits[on])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """`doc_id`, the counts, `base_failed`, `kept` for every row of `docs(doc_id, text, <stratum>)`.

    Null and empty texts have no words and fail the base rule; a null stratum is a stratum; repeated rows are judged
    one by one (and count as often in the holdout); other columns are not looked at; an empty table gives an empty one.
    """
    measured = written(docs.select("doc_id", F.col(stratum).alias("stratum"), measures(F.col("text")).alias("m")), "measures")
    out = with_cutoffs(measured, thresholds(measured, labels, risk, error), "stratum")
    return out.select("doc_id", "m.*", base_failed(F.col("m")).alias("base_failed"), kept(F.col("m"), F.col("cutoffs")).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with their columns and no others."""
    own = "llm risk rules"  # no column of the documents is named like this
    # measured once: the cutoffs and the verdicts are made from the stored counts
    rows = written(docs.select(F.struct("*").alias(own), F.col(stratum).alias("stratum"), measures(F.col("text")).alias("m")), "measured")
    limits = thresholds(rows.select(F.col(f"`{own}`")["doc_id"].alias("doc_id"), "stratum", "m"), labels, risk, error)
    return with_cutoffs(rows, limits, "stratum").where(kept(F.col("m"), F.col("cutoffs"))).select(f"`{own}`.*")
