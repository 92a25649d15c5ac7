"""Near-duplicate groups from bottom-k sketches of word shingles.

One hash function orders the shingles of a document; the k smallest are its
sketch. Inverted lists of sketch values give candidates, the union sketch of a
pair estimates its similarity and drops the far ones, and exact Jaccard on the
full sets confirms the rest.

Documents with equal sets are one node. Values are listed rarest first, as in
prefix filtering: two sets at the threshold share so many sketch values that
the rarest few of either already meet, so a passage that a third of the
documents hold gives no candidates by itself.

A list of nodes that share a value is tried with one leader first, and then
only nodes of different components are paired, all within short lists. In a
long list pairs would grow as a square, so its nodes are compared with the
leader on full sets. Let x not be linked to the leader, and y to x. Either
they share a value that the leader lacks, and meet again in the lists of such
values (which are treated the same way), or all they share is the leader's,
which takes a y smaller than the leader and an x just below the threshold.
So a large group of near copies costs a star and few pairs.

A link is missed only if the 64 smallest values of a pair's union hold far
fewer shared ones than their share of the union, with a chance of some 1e-9
at similarity 0.8 and falling fast above it; unions within the sketch size are
exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from corpusmill.llm import arrays
from corpusmill.llm.components import components
from corpusmill.llm.shared import written

#: Sketch size, and the least number of values that a linked pair shares in it.
SKETCH, MEET = 64, 28
#: Nodes of a list that are paired with each other; rounds of longer lists before all are.
LIST, DEPTH = 32, 4
#: Words of a shingle.
WIDTH = 5
_TOP = np.uint64(1 << 63)


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, width: int
) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles.

    Fewer words than the width are one shingle; no words, an empty set.
    """
    data = arrays.LOWER[data]
    starts, ends, rows = arrays.word_spans(data, offsets, arrays.SPACED)
    words = arrays.range_hashes(arrays.prefix_sums(data), starts, ends)
    full = arrays.sequence_hashes(words, width)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    for row in range(len(offsets) - 1):
        first, stop = bounds[row], bounds[row + 1]
        if stop - first >= width:
            yield np.unique(full[first : stop - width + 1])
        elif stop > first:
            yield arrays.sequence_hashes(words[first:stop], int(stop - first))
        else:
            yield words[:0]


def _signatures(docs: DataFrame, width: int, k: int) -> DataFrame:
    """Per row: id, set size, digest of the set (null if empty), bottom-k sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.text_blocks(batches):
            sizes, digests, sketches = [], [], []
            for values in shingle_sets(data, offsets, width):
                sizes.append(len(values))
                digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                digests.append(digest if len(values) else None)
                # signed numbers in the same order: later steps sort them
                sketches.append((values[:k] ^ _TOP).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                ["id", "n", "digest", "sketch"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"id {kind}, n long, digest binary, sketch array<long>")


@lru_cache(maxsize=8)
def _least_shared(k: int, meet: int, percent: int) -> tuple[int, ...]:
    """By set size from 1: values that a linked pair shares in its bottom-k sketches, at least.

    The union of the pair has at most ``100 / percent`` times as many values,
    and at least ``percent`` of 100 of them are shared. A union of up to k
    values is in the sketches whole; of a larger one the k smallest are drawn
    without return, and the number given for it is missed with a chance below
    1e-9. The least of all unions counts; ``meet`` holds beyond the table.
    """
    sizes = 8 * k
    drawn: list[int] = []  # by union size from 1
    for union in range(1, sizes * 100 // percent + 1):
        shared = -(-union * percent // 100)
        if union <= k:
            drawn.append(shared)
            continue
        low, chance = max(0, k - (union - shared)), 0.0
        for count in range(low, k + 1):
            chance += math.exp(
                _log_choose(shared, count) + _log_choose(union - shared, k - count) - _log_choose(union, k)
            )
            if chance >= 1e-9:
                break
        drawn.append(max(meet, count))
    return tuple(min(drawn[n - 1 : n * 100 // percent]) for n in range(1, sizes + 1))


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _required(n: Column, k: int, meet: int, percent: int) -> Column:
    """Sketch values that a node of set size n shares with any linked node, at least."""
    table = _least_shared(k, meet, percent)
    listed = F.expr(f"array({', '.join(map(str, table))})")
    return F.coalesce(F.get(listed, (n - 1).cast("int")), F.lit(meet))


def _prefixes(nodes: DataFrame, k: int, meet: int, percent: int) -> DataFrame:
    """Postings ``(value, node, n, share, bound)`` of the rarest sketch values of each node.

    ``bound`` is the most that an intersection with the node can have.
    """
    postings = nodes.select("node", "n", F.explode("sketch").alias("value"))
    # written, so that the join reads two shuffles and a hot value's partition can be split
    common = written(postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "shared-values")
    listed = (
        postings.join(common, "value")
        .groupBy("node", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("shared"))
    )
    size = F.least(F.col("n"), F.lit(k))
    # values that no other node has come first in the prefix and meet nothing
    length = F.size("shared") - _required(F.col("n"), k, meet, percent) + 1
    return listed.select(
        "node", "n", (F.size("shared") / size).alias("share"), "shared", length.alias("length")
    ).where("length > 0").select(
        "node", "n", "share", F.explode(F.expr("slice(shared, 1, int(length))")).alias("p")
    ).select("p.value", "node", "n", "share", F.col("n").alias("bound"))


def _alike(a: str, b: str, percent: int) -> Column:
    """Set sizes that a linked pair can have."""
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _sketched(pairs: DataFrame, nodes: DataFrame, k: int, meet: int, percent: int) -> DataFrame:
    """Pairs that the union sketch leaves: (a, b, exact), exact where it holds both sets whole."""
    side = nodes.select("node", "n", "sketch")
    both = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
    union = F.array_sort(F.array_union("sa", "sb"))
    both = both.withColumn("least", F.slice(union, 1, k)).withColumn(
        "met", F.size(F.array_intersect(F.array_intersect("sa", "sb"), "least"))
    )
    whole = F.greatest("na", "nb") <= k
    inter = F.size(F.array_intersect("sa", "sb"))
    linked = 100 * inter >= percent * (F.col("na") + F.col("nb") - inter)
    enough = F.col("met") >= _required(F.least("na", "nb"), k, meet, percent)
    return both.select("a", "b", whole.alias("exact"), F.when(whole, linked).otherwise(enough).alias("ok")).where(
        "ok"
    ).select("a", "b", "exact")


def _full_sets(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``(node, values)``: the whole shingle sets of some nodes (node, id, digest), packed."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.text_blocks(batches):
            found = [values.tobytes() for values in shingle_sets(data, offsets, width)]
            digests = [hashlib.blake2b(v, digest_size=16).digest() for v in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(digests, pa.binary()), pa.array(found, pa.binary())],
                ["id", "digest", "values"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    texts = docs.alias("d").join(
        wanted.select("id").distinct().alias("w"), F.expr("d.id <=> w.id"), "left_semi"
    )
    return (
        texts.mapInArrow(sets, f"id {kind}, digest binary, values binary").alias("s")
        .join(wanted.alias("w"), F.expr("s.id <=> w.id AND s.digest = w.digest"))
        .groupBy("w.node").agg(F.first("s.values").alias("values"))
    )


def _unpacked(values: pa.Scalar) -> np.ndarray:
    return np.frombuffer(values.as_buffer(), dtype=np.uint64)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are alike; those known to be exact pass."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for one, two in zip(batch.column("va"), batch.column("vb"), strict=True):
                x, y = _unpacked(one), _unpacked(two)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], ["a", "b"]
            ).filter(pa.array(ok, pa.bool_()))

    checked = (
        pairs.where("NOT exact").select("a", "b")
        .join(sets.toDF("a", "va"), "a").join(sets.toDF("b", "vb"), "b")
        .select("a", "b", "va", "vb")
        .mapInArrow(compare, "a long, b long")
    )
    return pairs.where("exact").select("a", "b").union(checked)


def _leaders(lists: DataFrame) -> DataFrame:
    """For each list the node that shares most of its sketch, as originals do; the smallest of equals."""
    lead = F.min(F.struct((-F.col("share")).alias("rank"), "n", "node")).alias("lead")
    return written(
        lists.groupBy("value").agg(lead).select(
            "value", F.col("lead.node").alias("leader"), F.col("lead.n").alias("n_leader")
        ),
        "leaders",
    )


def _clouds(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each node of long lists against the leaders of its lists, on full sets.

    Columns: leader, node, n_leader, n, met (size of the intersection), linked,
    outside (the node's values that the leader does not have).
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one, two in zip(batch.column("vl"), batch.column("vn"), strict=True):
                x, y = _unpacked(one), _unpacked(two)
                outside = np.setdiff1d(y, x, assume_unique=True)
                met = len(y) - len(outside)
                linked = 100 * met >= percent * (len(x) + len(outside))
                rows.append((len(x), len(y), met, linked, outside.view(np.int64)))
            n_leader, n, met, linked, outside = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("leader"), batch.column("node"), pa.array(n_leader, pa.int64()),
                    pa.array(n, pa.int64()), pa.array(met, pa.int64()), pa.array(linked, pa.bool_()),
                    pa.array(outside, pa.list_(pa.int64())),
                ],
                ["leader", "node", "n_leader", "n", "met", "linked", "outside"],
            )

    pairs = written(
        lists.join(_leaders(lists), "value").where("node != leader").select("leader", "node").distinct(),
        "cloud-pairs",
    )
    both = pairs.join(sets.toDF("leader", "vl"), "leader").join(sets.toDF("node", "vn"), "node")
    return written(
        both.select("leader", "node", "vl", "vn").mapInArrow(
            compare,
            "leader long, node long, n_leader long, n long, met long, linked boolean, outside array<long>",
        ),
        "clouds",
    )


def _unsettled(clouds: DataFrame, parts: DataFrame) -> DataFrame:
    """``(leader, least)`` of leaders whose nodes are not all of one component, with the least set size.

    Links within a component join nothing, so the other leaders have no pair to find.
    """
    placed = clouds.join(parts, "node", "left").select("leader", "n", F.coalesce("component", "node").alias("part"))
    return written(
        placed.groupBy("leader")
        .agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("n").alias("least"))
        .where("lo < hi").select("leader", "least"),
        "unsettled",
    )


def _outside_lists(clouds: DataFrame, percent: int) -> DataFrame:
    """Lists (as in ``_prefixes``) of what nodes of one leader share outside of it, rarest first.

    The smaller a partner can be, the less the pair must have in common: it is
    no smaller than the leader's ``least`` (a column that may be left out), nor
    than linked sizes allow. So the intersection has ``need`` values more than the leader's part
    of it, at least, and the pair meets ``twice`` times among all
    but ``need - twice`` of each node's values in the order of hashes, and
    once among all but ``twice - 1`` of these by rarity.
    """
    partner = F.ceil(F.col("n") * percent / 100)
    if "least" in clouds.columns:
        partner = F.greatest(partner, F.col("least"))
    inter = F.ceil((F.col("n") + partner) * percent / (100 + percent))
    need = F.greatest(F.lit(1), inter - F.col("met")).cast("int")
    rows = clouds.select(
        "leader", "node", "n", "met", "outside",
        need.alias("need"), F.ceil(need / 2).cast("int").alias("twice"),
    ).where("size(outside) >= need")
    first = F.slice("outside", F.lit(1), F.size("outside") - F.col("need") + F.col("twice"))
    values = written(
        rows.select("leader", "node", "n", "met", "need", "twice", F.explode(first).alias("w")), "outside-values"
    )
    common = written(
        values.groupBy("leader", "w").agg(F.count("*").alias("df")).where("df > 1"), "shared-outside"
    )
    listed = (
        values.join(common, ["leader", "w"])
        .groupBy("leader", "node", "n", "met", "need", "twice")
        .agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("shared"))
        .where("size(shared) >= twice")
    )
    rarest = F.slice("shared", F.lit(1), F.size("shared") - F.col("twice") + 1)
    # Values of both prefixes are in ``shared``. What a pair has in common besides is the end of its common
    # values in the order of hashes, cut off by one of the two: at most the largest cut of the leader's nodes.
    rests = written(rows.groupBy("leader").agg(F.max(F.col("need") - F.col("twice")).alias("rest")), "largest-cuts")
    bound = F.col("met") + F.size("shared") + F.col("rest")
    listed = listed.join(rests, "leader").select("leader", "node", "n", bound.cast("long").alias("bound"), F.explode(rarest).alias("p"))
    return listed.select(
        F.xxhash64("leader", "p.w").alias("value"), "node", "n", (F.col("bound") / F.col("n")).alias("share"), "bound"
    )


def _by_length(lists: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Lists of up to so many nodes, and longer ones."""
    long_lists = written(
        lists.groupBy("value").agg(F.count("*").alias("m")).where(F.col("m") > most).select("value"),
        "long-lists",
    )
    return (
        written(lists.join(long_lists, "value", "left_anti"), "short-rows"),
        written(lists.join(long_lists, "value", "left_semi"), "long-rows"),
    )


def _can_link(bound: Column, n: Column, other: Column, percent: int) -> Column:
    """Whether an intersection of up to ``bound`` can link sets of these sizes."""
    return (100 + percent) * bound >= percent * (n + other)


def _apart(lists: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Lists without nodes that cannot be linked in them, where more than one component is left; ``m`` nodes."""
    placed = lists.join(parts, "node", "left").select(
        *lists.columns, F.coalesce("component", "node").alias("part")
    )
    placed = written(placed, "placed")
    least = written(placed.groupBy("value").agg(F.min("n").alias("least")), "least-sizes")
    able = written(
        placed.join(least, "value").where(_can_link(F.col("bound"), F.col("n"), F.col("least"), percent)).drop("least"),
        "able",
    )
    mixed = able.groupBy("value").agg(
        F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("m")
    ).where("lo < hi")
    return able.join(written(mixed.select("value", "m"), "mixed-lists"), "value").drop("part")


def _across(lists: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list whose nodes are in different components."""
    placed = lists.join(parts, "node", "left").select(
        "value", "node", "n", "bound", F.coalesce("component", "node").alias("part")
    )
    one, two = placed.toDF("value", "a", "na", "ba", "pa"), placed.toDF("value", "b", "nb", "bb", "pb")
    able = _can_link(F.least("ba", "bb"), F.col("na"), F.col("nb"), percent)
    return one.join(two, "value").where(
        (F.col("pa") < F.col("pb")) & _alike("na", "nb", percent) & able
    ).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _beside_leader(clouds: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs of a leader's nodes that can be linked by what they share with the leader alone.

    Both share enough with it, one is not linked to it, and the other is smaller than it.
    """
    placed = clouds.join(parts, "node", "left").select(
        "leader", "node", "n", "n_leader", "met", "linked", F.coalesce("component", "node").alias("part")
    ).where(100 * F.col("met") >= percent * F.col("n"))
    one = placed.where("NOT linked").select("leader", F.col("node").alias("a"), F.col("n").alias("na"), F.col("met").alias("ma"), F.col("part").alias("pa"))
    two = placed.where("n < n_leader").select("leader", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("met").alias("mb"), F.col("part").alias("pb"))
    enough = percent * (F.col("na") + F.col("nb"))
    return one.join(two, "leader").where(
        (F.col("pa") != F.col("pb")) & ((100 + percent) * F.least("ma", "mb") >= enough)
    ).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _grouped(
    docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, percent: int = 80,
    k: int = SKETCH, meet: int = MEET, most: int = LIST,
) -> DataFrame:
    """Per row of ``docs``: id, n, digest and component_id, as ``near_groups`` has them."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = written(_signatures(docs, width, k), "signatures")
    nodes = written(
        signed.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"),
             F.count("*").alias("rows"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    lists = written(_prefixes(nodes, k, meet, percent), "prefixes")
    listed = nodes.join(lists.select("node").distinct(), "node", "left_semi")
    sets = written(_full_sets(listed.select("node", "id", "digest"), docs, width), "full-sets")

    # every list is tried with one leader: short ones by sketches, long ones on full sets
    short, long_lists = _by_length(lists, most)
    first = written(
        short.join(_leaders(short), "value")
        .where((F.col("node") != F.col("leader")) & _alike("n", "n_leader", percent))
        .select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b"))
        .distinct(),
        "first-pairs",
    )
    near = written(_sketched(first, nodes, k, meet, percent), "near-pairs")
    clouds = _clouds(long_lists, sets, percent)
    links = written(
        _confirmed(near, sets, percent).union(clouds.where("linked").select("leader", "node")), "links"
    )
    parts = written(components(links), "components")

    # then nodes of different components: in short lists each other, in long ones by what the leader lacks
    candidates = [_across(short, parts, percent)]
    found = [links]
    for level in range(DEPTH):
        unsettled = _unsettled(clouds, parts)
        if unsettled.isEmpty():
            break
        clouds = clouds.join(unsettled, "leader")
        candidates.append(_beside_leader(clouds, parts, percent))
        deeper = written(_apart(_outside_lists(clouds, percent), parts, percent), "outside-lists")
        if level == DEPTH - 1:
            candidates.append(_across(deeper, parts, percent))
            break
        long_lists = deeper.where(F.col("m") > most)
        candidates.append(_across(deeper.where(F.col("m") <= most), parts, percent))
        if long_lists.isEmpty():
            break
        clouds = _clouds(long_lists, sets, percent)
        found.append(clouds.where("linked").select("leader", "node"))
    second = written(
        reduce(DataFrame.union, candidates).distinct().join(first, ["a", "b"], "left_anti"), "second-pairs"
    )
    near = written(_sketched(second, nodes, k, meet, percent), "near-pairs")
    found.append(_confirmed(near, sets, percent).select("a", "b"))
    joined = written(components(reduce(DataFrame.union, found)), "node-components")

    named = nodes.select("node", "id", "rows", "digest").join(joined, "node", "left").select(
        "digest", "id", "rows", F.coalesce("component", "node").alias("component")
    )
    named = written(named, "named")
    least = named.groupBy("component").agg(
        F.min("id").alias("component_id"), F.sum("rows").alias("members")
    ).where("members > 1")
    groups = written(
        named.join(written(least, "least-ids"), "component").select("digest", "component_id"), "groups"
    )
    return signed.select("id", "n", "digest").join(groups, "digest", "left").select(
        "id", "n", "digest", F.coalesce("component_id", "id").alias("component_id")
    )


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    width: int = WIDTH, percent: int = 80, k: int = SKETCH, meet: int = MEET, most: int = LIST,
) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, component_id, kept.

    A-Z are lower-cased, words stand between white space, and documents are
    linked when 100 * intersection >= percent * union of their sets of
    distinct shingles. Null and empty texts have an empty set and no link.
    The component is the smallest id reachable; a null id links like any
    other, and is its own component where it reaches no id. Rows that repeat
    an id all carry its component. Other columns are not read.
    """
    return _grouped(docs, id_col, text_col, width, percent, k, meet, most).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _with_digests(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """The rows of ``docs`` as one struct, with the digest of their set (null if empty)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.text_blocks(batches, text_col):
            digests = [
                hashlib.blake2b(v.tobytes(), digest_size=16).digest() if len(v) else None
                for v in shingle_sets(data, offsets, width)
            ]
            row = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
            yield pa.RecordBatch.from_arrays([row, pa.array(digests, pa.binary())], ["row", "digest"])

    return docs.mapInArrow(sign, StructType().add("row", docs.schema).add("digest", BinaryType()))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, **options
) -> DataFrame:
    """The rows of ``docs`` whose id stands for its group, with all their columns.

    Each row is decided by its id and its set, as exact dedup leaves one row
    per id and text: rows that repeat an id, or have none, go only with their
    own group. Rows with a null id go where their group reaches an id, and
    stay where there is none.
    """
    groups = _grouped(docs, id_col, text_col, width, **options)
    gone = written(
        groups.where("NOT id <=> component_id").select("id", "digest").distinct(), "near-copies"
    )
    rows = _with_digests(docs, text_col, width).select(
        "row", F.col("row").getField(id_col).alias("id"), "digest"
    ).alias("d")
    return rows.join(gone.alias("g"), F.expr("d.id <=> g.id AND d.digest = g.digest"), "left_anti").select("row.*")
