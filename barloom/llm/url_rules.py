"""Url filter: fixed host and path rules, and association rules mined from labelled urls.

Token combinations that are frequent among urls labelled bad are found level by level over all labelled urls, and those with enough
confidence that no more general one matches become block rules. Combinations that can't be part of such a rule aren't extended: those that
hold a rule, and those that match the same urls as a part of theirs. Rules are matched by an inverted index that holds
each under its rarest token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import ascii_lower, url_parts, written

#: verdict, host, path
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: Share of all labelled urls that must be bad and hold the combination (and no fewer than LEAST of them).
SUPPORT = 0.0005
LEAST = 5
#: Share of bad ones among the labelled urls that hold it.
CONFIDENCE = 0.6
#: More mined rules than this are joined by a shuffle instead of being sent to every task.
BROADCAST_RULES = 50_000


def tokens(url: Column) -> Column:
    """Tokens that cover host, path, query keys and fragment, however many there are.

    h host, t its last label, d every longer suffix, s every other label; a first of several path segments, p every segment (digits
    as 0), w every word of a segment of several words, x extension of the last segment, v the depth, k every query key, f a fragment.
    No :// gives no tokens.
    """
    host, path = url_parts(url)
    labels, segments = F.split(host, r"\."), F.array_remove(F.split(path, "/"), "")
    shape = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    named = lambda name, values: F.transform(values, lambda v: F.concat(F.lit(name), v))
    last = F.try_element_at(segments, F.lit(-1))
    pairs = F.split(F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1), "&")
    keys = F.array_remove(F.transform(pairs, lambda p: shape(F.substring_index(p, "=", 1))), "")
    n, depth = F.size(labels), F.size(segments)
    none = F.array().cast("array<string>")
    suffixes = F.when(n > 1, F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: F.array_join(F.slice(labels, -k, k), "."))).otherwise(none)
    slugs = F.transform(segments, lambda c: F.array_remove(F.split(shape(ascii_lower(F.regexp_replace(c, r"\.[^.]*$", ""))), r"[^\p{L}\p{N}]+"), ""))
    words = F.flatten(F.filter(slugs, lambda w: F.size(w) > 1))
    some = [
        ("h:", host), ("t:", F.try_element_at(labels, F.lit(-1))), ("a:", F.when(depth > 1, shape(F.get(segments, F.lit(0))))),
        ("x:", F.when(last.contains("."), F.substring_index(last, ".", -1))), ("v:", depth.cast("string")), ("f:", F.when(url.contains("#"), F.lit("1"))),
    ]
    every = F.array_distinct(F.concat(
        F.array_compact(F.array(*[F.concat(F.lit(name), value) for name, value in some])), named("d:", suffixes),
        named("s:", F.slice(labels, 1, F.greatest(n - 2, F.lit(0)))), named("p:", F.transform(segments, shape)), named("w:", words), named("k:", keys),
    ))
    return F.when(url.contains("://"), every).otherwise(none)


def _index(rules: DataFrame, spread: DataFrame) -> DataFrame:
    """Rules `items` under their rarest item by `spread(item, n)`."""
    long = rules.select("items", F.explode("items").alias("item")).join(spread, "item", "left")
    return long.groupBy("items").agg(F.min_by("item", F.struct(F.coalesce("n", F.lit(0)), "item")).alias("item"))


def _matches(sets: DataFrame, index: DataFrame) -> DataFrame:
    """`sets` (with `tokens`) and `items` for each rule whose items they all hold."""
    few = index.count() <= BROADCAST_RULES
    return (
        sets.withColumn("item", F.explode("tokens")).join(F.broadcast(index) if few else index, "item")
        .where(F.size(F.array_except("items", "tokens")) == 0).drop("item")
    )


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """Block rules `items, item, bad, labelled, confidence`; `item` is the rarest of the items.

    A url is bad if the document of its page id is labelled with quality 0 (by any of its labels). Pages that share a token set count
    each. Without bad urls there are no rules.
    """
    label = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("is_bad"))
    rows = pages.select("page_id", tokens(F.col("url")).alias("tokens")).join(label, "page_id").where(F.size("tokens") > 0)
    sets = written(rows.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("is_bad").alias("bad")), "labelled-urls")
    n, bad = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    need = max(least, support * n)
    spark = pages.sparkSession
    if bad < need:
        return spark.createDataFrame([], "items array<string>, item string, bad bigint, labelled bigint, confidence double")
    spread = sets.select(F.explode("tokens").alias("item"), "n").groupBy("item").agg(F.sum("n").alias("n"))
    sure = written(_least_rules(sets, n, need, confidence), "sure")
    return sure.join(_index(sure, spread), "items").select("items", "item", "bad", "labelled", "confidence")


def _least_rules(sets: DataFrame, n: int, need: float, confidence: float) -> DataFrame:
    """`items, bad, labelled, confidence` of the combinations with support and confidence that hold no other such one.

    Level by level. A combination goes on only if it has the support, is no rule, and each part with one item less goes on and matches
    more urls: one that matches the same urls as a part of it makes no rule that the part doesn't make with fewer items.
    """
    share = F.col("bad") / F.col("labelled")

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("items").agg(F.sum("bad").alias("bad"), F.sum("n").alias("labelled")).where(F.col("bad") >= need)

    level = written(counted(sets.select(F.explode(F.transform("tokens", lambda t: F.array(t))).alias("items"), "n", "bad")), "level-1")
    rules = level.where(share >= confidence)
    alive = level.where((share < confidence) & (F.col("labelled") < n))
    single = alive.select(F.col("items")[0].alias("item"))
    held = sets.withColumn("id", F.xxhash64(F.array_join("tokens", "\n"), F.size("tokens"))).select("id", "n", "bad", F.explode("tokens").alias("item")).join(single, "item")
    rest = held.groupBy("id", "n", "bad").agg(F.array_sort(F.collect_list("item")).alias("rest"))
    rows = written(rest.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select(F.explode("rest").alias("item"), "*").select(F.array("item").alias("items"), "rest", "n", "bad"), "held-1")
    k = 1
    while alive.limit(1).count():
        k += 1
        longer = rows.join(alive.select("items"), "items", "left_semi").select("items", "rest", "n", "bad", F.explode("rest").alias("item"))
        longer = longer.where(F.col("item") > F.element_at("items", -1)).select(F.concat("items", F.array("item")).alias("items"), "rest", "n", "bad")
        rows = written(longer, f"held-{k}")
        found = written(counted(rows), f"found-{k}")
        parts = found.select("items", "labelled", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"), F.col("items").alias("all"))
        parts = parts.select("items", "labelled", F.filter("all", lambda x, j: j + 1 != F.col("i")).alias("part"))
        wider = parts.join(alive.select(F.col("items").alias("part"), F.col("labelled").alias("part_labelled")), "part")
        goes = wider.where(F.col("part_labelled") > F.col("labelled")).groupBy("items").agg(F.count("*").alias("parts")).where(F.col("parts") == k)
        level = written(found.join(goes.select("items"), "items"), f"level-{k}")
        rules, alive = rules.unionByName(level.where(share >= confidence)), level.where(share < confidence)
    return rules.withColumn("confidence", share)


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Rule (host and path as one string) and verdict of the longest fixed rule that fits; null if none does.

    A rule fits its host and the host's subdomains where the path starts with the rule's.
    """
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # later ones, the longer, go before
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, mined: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """`page_id, host, path, rule, verdict, mined` for every row of `pages(page_id, url)`.

    `verdict` is the fixed rule's, else block where a mined rule matches (`mined` has the most confident one's items), else allow. A null
    url or one without :// has empty host and path and is allowed. Repeated rows are judged one by one; other columns are not
    looked at; an empty table gives an empty one.
    """
    mined = written(mined, "mined")
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("tokens")).withColumn("key", F.array_join("tokens", "\n"))
    # urls repeat in their tokens: each token set is matched once
    found = _matches(rows.groupBy("key").agg(F.any_value("tokens").alias("tokens")), mined).groupBy("key").agg(
        F.min_by("items", F.struct(-F.col("confidence"), -F.col("bad"), "items")).alias("mined")
    )
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return rows.join(found, "key", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined",
    )
