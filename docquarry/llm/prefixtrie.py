"""The trie of conversation prefixes, with totals of every subtree by centroid decomposition.

Turns are numbered and their prefixes named by prefix sums: a prefix is the sum
of 128-bit digests of (position, role, text), so a conversation of any length
is summed in blocks and never gathered. Nodes are groups of equal prefixes; no
text moves after the turns have been put in order.

Subtree totals (``rollup``) do not walk the depth of the trie. Each component
of the parent-edge forest is split at its centroid, the deepest node whose
subtree holds more than half of the component's weight (turns): its subtree's
totals are added to every node from the centroid to the component's top, which
are just the nodes that hold more than half. Then the centroid goes, its
children's subtrees become components, and the rest stays one. The heaviest
component halves each time, so a chain of n turns takes log n rounds. Components
of at most ``limit`` turns are finished by one task each, many to a task.

Defined results: null roles and texts are empty; turns stand by number, null
first, ties by role and text; repeated rows are turns of their own; rows with a
null conversation id belong to none and are left out; conversations without
turns are members of the root; no conversations give no nodes; other columns,
of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.shared import join_hot, persist

BLOCK = 4096
SALTS = 16
TOTALS = "key binary, leaves long, saved long"


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A stored row for each turn: conv, span and place (order within the conversation), digest ``x`` of role and text, chars of the text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    keys = ["conv", "turn", "role", "text"]
    placed = rows.filter("conv IS NOT NULL").repartitionByRange(*keys).sortWithinPartitions(*keys)
    digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)
    return persist(placed.select("conv", F.spark_partition_id().alias("span"), F.monotonically_increasing_id().alias("place"), digest.alias("x"),
                                 F.length("text").cast("long").alias("chars")), "turns")


def numbered(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (conv, span, first, before, size) that number the turns, and conversations with their sizes; no conversation is gathered."""
    spans = placed.groupBy("conv", "span").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    by_conv = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(by_conv), F.lit(0)))
    spans = persist(spans, "spans")
    return spans, spans.groupBy("conv").agg(F.sum("n").alias("size"))


def rebuilt(placed: DataFrame, head: Callable[[Column], Column], base: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """Rows (conv, pos, x, chars) and conversations (conv, size) whose first ``head(conv)`` (at most ``most``) turns are those of ``base(conv)``."""
    spans, convs = numbered(placed)
    at = (F.col("place") - F.col("first") + F.col("before") + 1).alias("no")
    starts = spans.join(convs.select(base(F.col("conv")).alias("conv")).distinct(), "conv", "left_semi").filter(F.col("before") < most)
    first = placed.join(starts, ["conv", "span"]).select("conv", at, "x", "chars").filter(F.col("no") <= most)
    heads = first.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("no", "x", "chars"))).alias("turns"))  # at most ``most`` turns
    convs = convs.withColumn("h", head(F.col("conv")).cast("int")).withColumn("base", base(F.col("conv")))
    convs = convs.join(heads.select(F.col("conv").alias("base"), "turns"), "base", "left").withColumn(
        "turns", F.slice(F.coalesce("turns", F.array().cast(heads.schema["turns"].dataType)), F.lit(1), F.col("h")))
    convs = persist(convs.select("conv", "size", "h", "turns", F.size("turns").alias("k")), "conversations")
    own = placed.join(spans.join(convs.select("conv", "h", "k"), "conv"), ["conv", "span"]).select("conv", at, "h", "k", "x", "chars")
    own = own.filter("no > h").select("conv", (F.col("no") - F.col("h") + F.col("k")).alias("pos"), "x", "chars")
    from_base = convs.select("conv", F.explode("turns").alias("t")).select("conv", F.col("t.no").alias("pos"), "t.x", "t.chars")
    sizes = convs.select("conv", (F.col("k") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("size"))
    return own.unionByName(from_base), sizes


def prefixes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """A stored row for each prefix of each conversation: conv, pos, key, parent (key without the last turn), chars, left (turns from here)."""
    mixed = F.sha2(F.concat_ws(":", "pos", "x").cast("binary"), 256)
    half = lambda i: F.conv(F.substring(mixed, i, 16), 16, 10).cast("decimal(20,0)")
    rows = rows.select("conv", "pos", F.floor((F.col("pos") - 1) / BLOCK).alias("block"), half(1).alias("a"), half(17).alias("b"), "chars")
    within = Window.partitionBy("conv", "block").orderBy("pos")
    sums = rows.groupBy("conv", "block").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    sums = sums.select("conv", "block", *(F.coalesce(F.sum(c).over(earlier).cast("decimal(38,0)"), zero).alias(c) for c in ("sa", "sb")))
    sums = sums.join(sizes, "conv")
    rows = rows.withColumn("ra", F.sum("a").over(within)).withColumn("rb", F.sum("b").over(within)).join(sums, ["conv", "block"])
    with_last = [(F.col(r) + F.col(s)).cast("decimal(38,0)") for r, s in (("ra", "sa"), ("rb", "sb"))]
    without = [(F.col(r) + F.col(s) - F.col(d)).cast("decimal(38,0)") for r, s, d in (("ra", "sa", "a"), ("rb", "sb", "b"))]
    return persist(rows.select("conv", "pos", prefix_key(F.col("pos"), *with_last).alias("key"), prefix_key(F.col("pos") - 1, *without).alias("parent"),
                               "chars", (F.col("size") - F.col("pos") + 1).alias("left")), "prefixes")


def prefix_key(pos: Column, a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", pos.cast("string"), a.cast("string"), b.cast("string")).cast("binary")))


def root_key() -> Column:
    return prefix_key(F.lit(0), F.lit(0), F.lit(0))


def trie_nodes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """A stored row for each node: key, parent, conv_id (smallest member), depth, n_convs, saved, weight (turns of its members from here), parent_conv_id, n_children."""
    nodes = rows.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("conv").alias("conv_id"), F.min("pos").alias("depth"), F.count("*").alias("n_convs"),
        F.max("chars").alias("chars"), F.sum("left").alias("weight"))
    root = sizes.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("size") + 1).alias("weight")).filter("n_convs > 0")
    nodes = persist(nodes.unionByName(root.withColumns({"key": root_key(), "parent": F.lit(None).cast("binary"),
                                                        "depth": F.lit(0).cast("long"), "chars": F.lit(0).cast("long")})), "nodes")
    kids = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    tops = persist(nodes.select("key", "conv_id").join(kids, "key"), "parents")
    named = join_hot(nodes.filter("depth > 0"), tops.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_siblings")),
                     "parent", "n_siblings", nodes.count()).drop("n_siblings")
    named = named.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    named = named.join(tops.select("key", "n_children"), "key", "left").fillna(0, ["n_children"])
    return persist(named.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "trie")


def _split(group: list[tuple]) -> list[tuple]:
    """(key, leaves, saved) of a component's nodes (key, parent, weight, leaf, saved; its top first, parents before children), by centroids."""
    at = {r[0]: i for i, r in enumerate(group)}
    up = [at.get(r[1], -1) for r in group]
    weight, own = [r[2] for r in group], [(r[3], r[4]) for r in group]
    leaves, saved = [0] * len(group), [0] * len(group)
    open_parts = [list(range(len(group)))]
    while open_parts:
        part = open_parts.pop()
        total = weight[part[0]]
        path = [i for i in part if 2 * weight[i] > total]
        centre = path[-1]
        below, under, rest = {centre: None}, {}, []
        for i in part[part.index(centre) + 1:]:
            if up[i] in below:
                top = i if up[i] == centre else below[up[i]]
                below[i] = top
                under.setdefault(top, []).append(i)
        rest = [i for i in part if i not in below]
        sums = sum(own[i][0] for i in below), sum(own[i][1] for i in below)
        heavy = weight[centre]
        for i in path:
            leaves[i] += sums[0]
            saved[i] += sums[1]
            weight[i] -= heavy
        open_parts += [p for p in [rest, *under.values()] if p]
    return [(r[0], leaves[i], saved[i]) for i, r in enumerate(group)]


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of whole components that stand one after the other."""
    types = [pa.binary(), pa.int64(), pa.int64()]

    def out(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=["key", "leaves", "saved"])

    name, group, done = None, [], []
    for batch in batches:
        for comp, *row in zip(*(batch.column(c).to_pylist() for c in ("comp", "key", "parent", "weight", "leaf", "saved"))):
            if comp != name:
                done += _split(group) if group else []
                name, group = comp, []
                if len(done) > 20_000:
                    yield out(done)
                    done = []
            group.append(row)
    done += _split(group) if group else []
    if done:
        yield out(done)


def rollup(nodes: DataFrame, rows: DataFrame, limit: int = 1 << 15) -> DataFrame:
    """(key, leaves, saved): of each node, childless nodes and saved characters of its subtree.

    ``rows`` name the node of each conversation at each depth: a node lies below another if its smallest member passes
    there. State of a round: comp (key of the component's top), weight (turns of the subtree within the component).
    """
    state = nodes.select("key", "parent", F.col("conv_id").alias("conv"), "depth", "weight", (F.col("n_children") == 0).cast("long").alias("leaf"), "saved").withColumn(
        "comp", root_key())
    lookups = rows.select("conv", F.col("pos").alias("at"), F.col("key").alias("child"), F.col("parent").alias("child_of"))
    added = []
    while True:
        tops = state.groupBy("comp").agg(F.max("weight").alias("total"))
        large = persist(tops.filter(F.col("total") > limit), "large")
        small = _by_comp(state, large.select("comp"), "left_anti").repartition("comp").sortWithinPartitions("comp", "depth")
        added.append(persist(small.select("comp", "key", "parent", "weight", "leaf", "saved").mapInArrow(_components, TOTALS), "totals"))
        if large.isEmpty():
            return added[0] if len(added) == 1 else _sum(added)
        met = persist(_by_comp(state, large).select(*state.columns, (2 * F.col("weight") > F.col("total")).alias("on_path")), "open")
        centres = met.filter("on_path").groupBy("comp").agg(F.max(F.struct("depth", "key", "weight")).alias("c")).select(
            "comp", F.col("c.depth").alias("c_depth"), F.col("c.key").alias("centre"), F.col("c.weight").alias("c_weight"))
        met = _by_comp(met, persist(centres, "centres")).withColumn("at", F.when(~F.col("on_path") & (F.col("depth") > F.col("c_depth")), F.col("c_depth") + 1))
        below = F.coalesce(F.col("child_of") == F.col("centre"), F.lit(False)) | (F.col("key") == F.col("centre"))
        met = persist(met.join(lookups, ["conv", "at"], "left").withColumn("below", below).select(*state.columns, "on_path", "centre", "c_weight", "child", "below"), "split")
        sums = met.filter("below").groupBy("comp").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
        added.append(persist(_by_comp(met.filter("on_path").select("comp", "key"), persist(sums, "sums")).select("key", "leaves", "saved"), "totals"))
        state = persist(met.filter("key <> centre").withColumn("comp", F.when(F.col("below"), F.col("child")).otherwise(F.col("comp"))).withColumn(
            "weight", F.when(F.col("on_path"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight"))).select(*state.columns), "state")


def _by_comp(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` met with one row for each component; the rows of a component are dealt over ``SALTS`` tasks."""
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(groups, ["comp", "salt"], how).drop("salt")


def _sum(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv) rows as (key, first conv, ids joined by commas), at most ``most`` ids each."""
    def out(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))],
                                          names=["key", "first", "ids"])

    name, ids, done = None, [], []
    for batch in batches:
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist()):
            if ids and (key != name or len(ids) == most):
                done.append((name, ids[0], ",".join(map(str, ids))))
                ids = []
            name = key
            ids.append(conv)
        yield out(done)
        done = []
    if ids:
        yield out([(name, ids[0], ",".join(map(str, ids)))])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, first, ids) pieces as (key, SHA-256 of all its ids joined by commas); holds one piece at a time."""
    name, state = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if key == name:
                state.update(b"," + ids.encode())
                continue
            if state:
                done.append((name, state.hexdigest()))
            name, state = key, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["key", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def end_digests(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes at which conversations end: SHA-256 of their ids, ascending, joined by commas.

    Ids are sorted by range and joined to long pieces first, so a node at which a third of all conversations end is
    one stream of a few pieces in the end: a digest has to be taken in order.
    """
    ends = rows.filter("left = 1").select("key", "conv").unionByName(sizes.filter("size = 0").select(root_key().alias("key"), "conv"))
    pieces = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_pieces, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_hashes, "key binary, ends_sha256 string")


def conversation_trie(turns: DataFrame, head: Callable[[Column], Column] = lambda c: F.lit(0), base: Callable[[Column], Column] = lambda c: c, most: int = 0,
                      limit: int = 1 << 15, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the trie of all conversations' prefixes of turns, a row each.

    Before, the first ``head(conv)`` (0 to ``most``) turns of each conversation are replaced by those of ``base(conv)``.
    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes of its
    subtree), saved_tokens (characters that its subtree's texts would take if told again for each member but one),
    ends_sha256 (of the ids of the members that end here).
    """
    rows, sizes = rebuilt(ordered_turns(turns, conv_col, turn_col, role_col, text_col), head, base, most)
    rows = prefixes(rows, sizes)
    nodes = trie_nodes(rows, sizes)
    done = nodes.join(rollup(nodes, rows, limit).withColumnRenamed("saved", "saved_tokens"), "key").join(end_digests(rows, sizes), "key", "left")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved_tokens",
                       F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
