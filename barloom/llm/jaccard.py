"""Documents whose sets of five-word shingles overlap by 80 % or more, by a grouped prefix join.

In any common order two such sets share SHARED shingles (or all they have in common, if fewer) among the first
`n - ceil(0.8 n) + SHARED` of each. The order here puts shingles from rarely used slots of a counting sketch first, so passages that many
documents share come last. Documents with the same shingles are one set; sets with the same size and prefix are one group, and groups
are joined: their pairs are filtered first, and only pairs that stay are expanded to members and verified.

Lists of groups that share a prefix shingle are not paired off. In a few rounds every group is checked against the one list leader of
its size that it shares most with, which joins large sets of near copies with a few checks a member. Then only pairs of groups that still
lie in different components are formed, each group outside a list's commonest component against the list; so no link between
components is missed. A pair of `m` and `n` shingles needs `need = ceil(0.8 (m + n) / 1.8)` in common, so SHARED of them are among the
first `m - need + SHARED` of one and `n - need + SHARED` of the other: a shared shingle further back does not make a pair. Every link is
checked on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import Sketch, WordHashes, discard, mixed, shingles, summed_sketch, texts, written

PERCENT = 80
WORDS = 5
#: Prefix shingles that similar sets are asked to have in common; more of them make the prefixes longer and chance pairs fewer.
SHARED = 3
#: Rounds of checks against leaders before the remaining pairs are formed, each on another one of SHARES parts of the lists.
ROUNDS, SHARES = 3, 8
#: Ids that are sent to every task at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Rows with whole texts or sets that a Python worker gets at a time.
BATCH = 512
#: The counting sketch has 2**SKETCH_BITS slots, a byte each once ranked; more slots tell rarer passages from chance.
SKETCH_BITS = 22


def _sets(batch: pa.RecordBatch, hashes: WordHashes, column: int = 1) -> Iterator[np.ndarray]:
    for text in texts(batch, column):
        yield shingles(hashes.of(text.lower().split()), WORDS)


def ranks(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """For each slot a byte that grows with the logarithm of the shingles counted there, over all documents."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, hashes = Sketch(bits), WordHashes()
        for batch in batches:
            for s in _sets(batch, hashes, 0):
                sketch.add(s)
        yield from sketch.rows()

    return summed_sketch(docs.select("text").mapInArrow(tally, "piece int, data binary"), bits, lambda n: np.minimum(np.rint(6 * np.log2(1 + n)), 255))


def prefix(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles by rank, then hash, of which two sets of 80 % overlap share SHARED."""
    n = len(s)
    order = np.argsort(rank[s & np.uint64(len(rank) - 1)], kind="stable")
    return s[order[: n - -(-PERCENT * n // 100) + SHARED]]


def signatures(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """`doc_id, n, set_key, group_key, prefix` per row, written; keys are 128-bit hashes of the set and of its size and prefix."""
    rank = docs.sparkSession.sparkContext.broadcast(ranks(docs, bits))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ns, sets, groups, heads = [], [], [], []
                for s in _sets(batch, hashes):
                    p = prefix(s, rank.value) if len(s) else s
                    ns.append(len(s))
                    sets.append(blake2b(s.tobytes(), digest_size=16).digest())
                    groups.append(blake2b(p.tobytes(), digest_size=16, salt=len(s).to_bytes(8, "little")).digest())
                    heads.append(p)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in heads])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array(ns, pa.int32()), pa.array(sets, pa.binary()), pa.array(groups, pa.binary()), lists],
                    ["doc_id", "n", "set_key", "group_key", "prefix"],
                )

    signed = docs.select("doc_id", "text").mapInArrow(sign, "doc_id bigint, n int, set_key binary, group_key binary, prefix array<bigint>")
    signed = written(signed, "signatures", BATCH)
    rank.destroy()
    return signed


def _near(a: Column, b: Column) -> Column:
    """Sizes that allow the overlap."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _slots(ids: np.ndarray) -> np.ndarray:
    return mixed(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def whole_sets(docs: DataFrame, ids: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """`id, n, s`: the shingle sets of the documents with the wanted ids, made again from the texts.

    A bitmap of the ids, of a fixed size, lets only few other documents through; it only saves work.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(bits)
        for batch in batches:
            sketch.add(_slots(batch.column(0).to_numpy(zero_copy_only=False)))
        yield from sketch.rows()

    wanted = docs.sparkSession.sparkContext.broadcast(summed_sketch(ids.select("id").mapInArrow(mark, "piece int, data binary"), bits, lambda n: n > 0))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            slots = _slots(batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)) & np.uint64((1 << bits) - 1)
            batch = batch.filter(pa.array(wanted.value[slots] > 0))
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = list(_sets(part, hashes))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "s"]
                )

    sets = written(docs.select("doc_id", "text").mapInArrow(whole, "id bigint, n int, s binary").where("n > 0"), "sets", BATCH)
    wanted.destroy()
    return sets


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs `a, b` whose whole sets overlap by 80 % or more.

    The pairs go to the sets, while they are few enough to be sent to every task, so only sets that a pair asks for are shuffled.
    """

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left, right = (sets.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("s").alias(f"s{i}")) for i in "ab")
    asked = _sent(pairs.select("a", "b"))
    both = left.join(asked, "a").join(right.join(asked, "b"), ["a", "b"]).where(_near(F.col("na"), F.col("nb")))
    return both.select("a", "b", "sa", "sb").mapInArrow(enough, "a bigint, b bigint").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """`node, component` for every node of `edges(a, b)`; the component is its smallest node.

    Labels travel along edges and are then looked up once more, so distances halve; one table is written a round.
    """
    both = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        low = labels.join(near, "node").select("node", "component", F.least("component", "m").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        before, moved = labels, written(low.join(up, "low").select("node", F.least("low", "up").alias("component"), (F.least("low", "up") < F.col("component")).alias("moved")), "labels")
        discard(before)
        labels = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            discard(both)
            return labels


def _bands(n: Column) -> Column:
    """Two overlapping sequences of size bands; sizes that allow the overlap meet in one band of at least one of them."""
    unit = F.ln(n) / F.lit(float(np.log(100 / PERCENT)))
    return F.array(*[F.struct(F.lit(v).alias("v"), F.floor((unit + v) / 2).alias("band")) for v in (0, 1)])


def _with_components(rows: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        return rows.withColumn("component", F.col("id"))
    return rows.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _open(rows: DataFrame) -> DataFrame:
    """Rows of lists in which more than one component meets."""
    several = rows.groupBy("t").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("split").alias("any")).where("low < high or any")
    return rows.join(several.select("t"), "t")


def star_pairs(rows: DataFrame) -> DataFrame:
    """For each member of lists `t, id, n, component` the list leader (smallest id of the size band) of another component that it
    shares most lists with, two at least."""
    banded = rows.select("t", "id", "component", F.explode(_bands(F.col("n"))).alias("x")).select("t", "id", "component", "x.v", "x.band")
    leaders = banded.groupBy("t", "v", "band").agg(F.min("id").alias("lead"))
    shared = banded.join(leaders, ["t", "v", "band"]).where("id != lead").groupBy("lead", "id", "v").agg(F.count("*").alias("c"), F.any_value("component").alias("component")).where("c > 1")
    own = rows.select(F.col("id").alias("lead"), F.col("component").alias("other")).distinct()
    best = shared.join(own, "lead").where("component != other").groupBy("id").agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("lead"))
    return best.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct()


def apart(rows: DataFrame) -> DataFrame:
    """`a, b, need`, one row per list `t` in which a pair of different components meets early enough in both prefixes.

    `rows(t, place, id, n, component, split)`; a split group has members of several components, so it meets any other. No pair is formed
    inside the commonest component of a list.
    """
    mode = rows.where("not split").groupBy("t", "component").agg(F.count("*").alias("c")).groupBy("t").agg(F.max_by("component", F.struct("c", "component")).alias("mode"))
    named = rows.join(mode, "t", "left").withColumn("inner", ~F.col("split") & F.coalesce(F.col("component") == F.col("mode"), F.lit(False)))
    x, y = (named.select("t", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "place", "component", "split", "inner")]) for side in "xy")
    m, n = F.col("x_n"), F.col("y_n")
    need = F.ceil(PERCENT * (m + n) / (100 + PERCENT))
    meet = (F.col("x_place") + need < m + SHARED) & (F.col("y_place") + need < n + SHARED)
    differ = (F.col("x_component") != F.col("y_component")) | (F.col("x_split") | F.col("y_split")) & (F.col("x_id") != F.col("y_id"))
    pairs = x.where("not x_inner").join(y, "t").where(_near(m, n) & meet & differ & (F.col("y_inner") | (F.col("x_id") < F.col("y_id"))))
    return pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), need.alias("need"))


def rest_pairs(rows: DataFrame) -> DataFrame:
    """Pairs in different components that share enough of their lists."""
    counted = apart(rows).groupBy("a", "b").agg(F.count("*").alias("c"), F.max("need").alias("need"))
    return counted.where(F.col("c") >= F.least(F.lit(SHARED), F.col("need"))).select("a", "b")


def members(pairs: DataFrame, inside: DataFrame, components: DataFrame | None) -> DataFrame:
    """Pairs of groups `a, b` as pairs of their members in different components; `inside(id, rep)` lists the members of groups with several."""
    for side in "ab":
        names = inside.select(F.col("id").alias(side), F.col("rep").alias("member"))
        pairs = pairs.join(names, side, "left").withColumn(side, F.coalesce("member", side)).drop("member")
        if components is not None:
            pairs = pairs.join(components.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
        pairs = pairs.withColumn(f"of_{side}", F.coalesce(f"of_{side}", side) if components is not None else F.col(side))
    return pairs.where("of_a != of_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _shared(n: Column) -> Column:
    """Lists that sets of `n` and of no more shingles share if they are similar."""
    return F.least(F.lit(SHARED), F.ceil(n * (PERCENT / 100)))


def groups(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """`doc_id, n_shingles, component_id` for every row of `docs(doc_id, text)`.

    Words are runs without ASCII white space, A-Z lower-cased. Null, empty and blank texts have no shingles and are linked
    with nothing. Rows with one id are one document, linked by any of its texts; a null id has no links and a null component.
    Other columns are not looked at; an empty table gives an empty one. Shingles are compared by 64-bit hashes.
    """
    signed = signatures(docs, bits)
    full = signed.where("n > 0 and doc_id is not null")
    sets = written(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("group_key").alias("group_key"), F.first("n").alias("n")), "distinct")
    grouped = full.groupBy("group_key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    posted = grouped.select(F.posexplode("prefix").alias("place", "t"), "id", "n")
    shared = posted.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t")
    every = written(posted.join(shared, "t").select("t", "place", "id", "n"), "lists")
    able = every.groupBy("id").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(F.col("c") >= _shared(F.col("n"))).select("id")
    lists = written(every.join(able, "id").withColumn("split", F.lit(False)), "able")
    discard(every)
    many = sets.groupBy("group_key").agg(F.min("rep").alias("id"), F.count("*").alias("c")).where("c > 1").select("group_key", "id")
    inside = written(sets.join(many, "group_key").select("id", "rep", "n"), "inside")
    whole = whole_sets(docs, lists.select("id").union(inside.select("rep")).distinct(), bits)

    spark = docs.sparkSession
    links = tried = spark.createDataFrame([], "a bigint, b bigint")
    components = None
    several = not inside.isEmpty()
    if several:  # members of a group against its smallest
        tried = inside.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        links = written(verified(whole, tried), "links", BATCH)
        components = connected(links)
    for k in range(ROUNDS):
        # which pairs are tried first needs no more than a part of the lists; the rest is looked for in all of them
        rows = _open(_with_components(lists.where(F.pmod("t", F.lit(SHARES)) == k), components))
        pairs = written(star_pairs(rows).join(tried, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            tried, links = tried.union(pairs), links.union(written(verified(whole, pairs), "links", BATCH))
            components = connected(links)
    rows = _with_components(lists, components)
    if several:
        own = _with_components(inside.select("id", "rep", "n").withColumnsRenamed({"id": "t", "rep": "id"}), components)
        torn = own.groupBy(F.col("t").alias("id")).agg((F.min("component") < F.max("component")).alias("torn"))
        rows = rows.join(torn, "id", "left").withColumn("split", F.coalesce("torn", F.lit(False))).drop("torn")
    rows = written(_open(rows), "open")
    rest = rest_pairs(rows)
    if several:
        rest = members(rest, inside, components).union(apart(own.withColumns({"place": F.lit(0), "split": F.lit(False)})).select("a", "b"))
    rest = written(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.union(written(verified(whole, rest), "links", BATCH))
    discard(lists, rows)
    # the sets of an id with several texts belong together
    owned = full.join(sets, "set_key").select("doc_id", "rep")
    lowest = owned.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("high")).where("a < high")
    links = links.union(owned.join(lowest, "doc_id").where("rep != a").select("a", F.col("rep").alias("b")))
    found = connected(links).withColumnRenamed("node", "rep")
    of_set = sets.join(found, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    return signed.join(of_set, "set_key", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component, one row an id, with their columns and no others.

    Rows with a null id stay, as they are linked with nothing. The texts are not shuffled as long as the ids to leave out are few enough to be
    sent to every task.
    """
    gone = groups(docs, bits).where("component_id != doc_id").select("doc_id").distinct()
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone, repeated = written(gone, "gone"), written(repeated, "repeated")
    single = docs.join(_sent(gone.union(repeated)), "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return single
    more = docs.join(_sent(repeated.join(gone, "doc_id", "left_anti")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.union(more.select(docs.columns))


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
