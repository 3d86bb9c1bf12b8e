"""Near-duplicate documents by SuperMinHash, banding, exact verification and union-find.

A document's set is its distinct ``shingle``-word runs. SuperMinHash gives each
element one random permutation of the ``bands * rows`` slots: at level j the
element offers ``j + r_j`` to slot ``p_j``, and a document is done once every
slot holds a value below the next level, so long texts stop after one or two
levels. Bands of the signature name buckets.

1. Equal sets fold into classes; the least id stands for its class.
2. Tasks fold equal buckets of a batch first (pairs inside a batch are noted at
   once, a few members go on), so that a bucket with a third of all documents
   sends a few rows per batch. Buckets then pair each member with the least id
   and with its next neighbours: a number of pairs linear in the members.
3. Pairs are confirmed on full sets: first the one best partner of each class,
   then all pairs that still lie in different components. A bitmap of fixed size
   over the ids that have pairs keeps other texts from being moved.
4. In buckets with more members than neighbours not every pair has met. Those
   with several components are searched in blocks: every member outside of the
   largest component is held against all members.

A pair at similarity t shares a bucket with probability 1 - (1 - t^rows)^bands;
for 4 rows and 32 bands that is above 0.9999999 at 0.8.

Defined results: null, empty or blank texts have an empty set and no links;
with fewer words than a shingle the whole sequence is the one element; rows
that share an id are one document, whose text is the one of least digest; a
null id is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm import words as W
from docquarry.llm.components import components
from docquarry.llm.shared import persist

SIGNED = "id long, n long, d1 long, d2 long, bands array<long>"
GOLD = 0x9E3779B97F4A7C15
WHOLE = np.uint64(0xA5A5A5A5A5A5A5A5)
MARKS = 1 << 24


def sets_of(part: W.Words, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    hashed = W.hashes(part)
    runs = W.grams(hashed, shingle)
    out = []
    for low, high in zip(part.first[:-1].tolist(), part.first[1:].tolist()):
        if high - low >= shingle:
            out.append(np.unique(runs[low : high - shingle + 1]))
        elif high > low:
            own = W.grams(hashed[low:high], high - low)
            out.append(own ^ WHOLE)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def draws(elements: np.ndarray, level: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The value (level above 32 random bits) and the swap of each element at a level."""
    x = W.mix(elements + np.uint64((GOLD * (level + 1)) & ((1 << 64) - 1)))
    value = (np.uint64(level) << np.uint64(32)) | (x >> np.uint64(32))
    swap = level + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)
    return value, swap


def signatures(sets: list[np.ndarray], slots: int, lazy_levels: int = 6) -> np.ndarray:
    """SuperMinHash signatures, one row per set; rows of empty sets mean nothing."""
    best = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    docs = np.repeat(np.arange(len(sets)), sizes)
    swaps: list[np.ndarray] = []
    for level in range(min(lazy_levels, slots)):
        value, swap = draws(elements, level, slots)
        place = swap.copy()
        for earlier in range(level - 1, -1, -1):  # where the permutation's swaps so far have put the slot
            place = np.where(place == swaps[earlier], earlier, place)
        # reading p[swap] after the swaps 0..level-1; slot `earlier` now holds what stood at its swap
        np.minimum.at(best.reshape(-1), docs * slots + place, value)
        swaps.append(swap)
        open_docs = (best >= (np.uint64(level + 1) << np.uint64(32))).any(axis=1) & (sizes > 0)
        if not open_docs.any():
            return best
        stay = open_docs[docs]
        if not stay.all():
            elements, docs = elements[stay], docs[stay]
            swaps = [s[stay] for s in swaps]
    # few elements: write the permutations out
    table = np.tile(np.arange(slots, dtype=np.int64), (len(elements), 1))
    rows = np.arange(len(elements))
    for level in range(slots):
        value, swap = draws(elements, level, slots)
        chosen = table[rows, swap]
        table[rows, swap] = table[rows, level]
        table[rows, level] = chosen
        np.minimum.at(best.reshape(-1), docs * slots + chosen, value)
        if level >= lazy_levels and level % 8 == 7:
            open_docs = (best >= (np.uint64(level + 1) << np.uint64(32))).any(axis=1) & (sizes > 0)
            stay = open_docs[docs]
            if not stay.any():
                return best
            table, elements, docs = table[stay], elements[stay], docs[stay]
            rows = np.arange(len(elements))
    return best


def band_keys(best: np.ndarray, bands: int) -> np.ndarray:
    rows = best.shape[1] // bands
    parts = best.reshape(len(best), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLD), parts.shape[:2]).copy()
    for r in range(rows):
        key = W.mix(key * np.uint64(W.BASE) + parts[:, :, r])
    return key.view(np.int64)


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    one = np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64)
    two = np.array([int(W.mix(s ^ np.uint64(GOLD)).sum(dtype=np.uint64)) for s in sets], np.uint64)
    return one.view(np.int64), two.view(np.int64)


def _sign(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column("text"), lower=True):
                sets = sets_of(part, shingle)
                keys = band_keys(signatures(sets, bands * rows), bands)
                sizes = np.array([len(s) for s in sets], np.int64)
                one, two = digests(sets)
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))])
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[sizes > 0].reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id")[part.rows], pa.array(sizes), pa.array(one), pa.array(two), listed],
                                                 names=["id", "n", "d1", "d2", "bands"])

    return run


def marks_of(wanted: DataFrame) -> np.ndarray:
    """A bit for each of ``MARKS`` slots of the ids in ``wanted``, 64 to a word: 2 MB whatever their number."""
    words = wanted.select(id_slot(F.col("id")).alias("slot")).selectExpr("shiftright(slot, 6) AS word", "shiftleft(1L, CAST(slot % 64 AS INT)) AS bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    marks = np.zeros(MARKS // 64, np.uint64)
    marks[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return marks


def id_slot(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(MARKS))


def _sets(shingle: int, marks: Broadcast):
    """Sets of the texts whose slot is marked; the others never leave the task that read them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            marked = (marks.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            batch = batch.filter(pa.array(marked.astype(bool)))
            for part in W.slices(batch.column("text"), lower=True):
                sets = sets_of(part, shingle)
                one, two = digests(sets)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id")[part.rows], pa.array(one), pa.array(two), listed], names=["id", "d1", "d2", "items"])

    return run


def _fold(neighbours: int):
    """Buckets of a batch: pairs within it, and the few members that go on (``b`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bands")
            ids = np.repeat(batch.column("id").to_numpy(), np.diff(lists.offsets.to_numpy()))
            keys = lists.flatten().to_numpy()
            order = np.lexsort((ids, keys))
            ids, keys = ids[order], keys[order]
            opens = np.ones(len(keys), bool)
            opens[1:] = keys[1:] != keys[:-1]
            heads = np.flatnonzero(opens)
            head = np.repeat(heads, np.diff(np.concatenate([heads, [len(keys)]])))
            rank = np.arange(len(keys)) - head
            out_keys, out_a, out_b = [], [], []
            gone = rank > neighbours
            onward = ~gone
            out_keys.append(keys[onward])
            out_a.append(ids[onward])
            out_b.append(np.full(int(onward.sum()), -1))
            for step in [None, *range(1, neighbours + 1)]:
                at = np.flatnonzero(gone)
                other = head[at] if step is None else at - step
                out_keys.append(keys[at])
                out_a.append(ids[other])
                out_b.append(ids[at])
            out_b = [pa.array(b, pa.int64(), mask=np.full(len(b), i == 0)) for i, b in enumerate(out_b)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_keys)), pa.array(np.concatenate(out_a)), pa.concat_arrays(out_b)], names=["key", "a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    right = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    n_a, n_b = F.size("items_a"), F.size("items_b")
    both = pairs.select("a", "b").join(left, "b").join(right, "a")
    common = both.withColumn("common", F.size(F.array_intersect("items_a", "items_b")))
    return common.filter(100 * F.col("common") >= percent * (n_a + n_b - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
                    bands: int = 32, rows: int = 4, neighbours: int = 3) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (least id reachable) and ``kept``."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("id IS NOT NULL")
    signed = texts.mapInArrow(_sign(shingle, bands, rows), SIGNED)
    signed = persist(signed.groupBy("id").agg(F.min(F.struct("d1", "d2", "n", "bands")).alias("s")).select("id", "s.*"), "signed")
    classes = persist(signed.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("id", "bands")).alias("s")).select("s.*", "d1", "d2", "n"), "classes")

    folded = persist(classes.select("id", "bands").mapInArrow(_fold(neighbours), "key long, a long, b long"), "buckets")
    own = Window.partitionBy("key").orderBy("a")
    members = folded.filter("b IS NULL").select("key", F.col("a").alias("id"))
    partners = [F.first(F.col("a")).over(own), *(F.lag("a", j).over(own) for j in range(1, neighbours + 1))]
    met = folded.filter("b IS NULL").select("key", F.col("a").alias("b"), F.array(*partners).alias("others"), F.row_number().over(own).alias("rank")).filter("rank > 1")
    met = met.select(F.explode(F.array_distinct("others")).alias("a"), "b").filter("a < b")
    pairs = met.unionByName(folded.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    for end in ("a", "b"):  # sizes that rule a link out, before any set is moved
        pairs = pairs.join(classes.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}")), end)
    alike = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    pairs = persist(pairs.filter(alike).select("a", "b", "shared"), "pairs")

    # members of buckets in which not every pair has met
    sizes = folded.groupBy("key").agg(F.count("*").alias("n"), F.count("b").alias("noted")).filter((F.col("n") > neighbours + 2) | (F.col("noted") > 0))
    banded = classes.select("id", F.explode("bands").alias("key"))
    large = persist(banded.join(sizes.select("key"), "key"), "large-buckets")

    wanted = persist(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(large.select("id")).distinct(), "wanted")
    known = classes.join(wanted, "id", "left_semi").select("id", "d1", "d2")
    marks = docs.sparkSession.sparkContext.broadcast(marks_of(wanted))
    sets = texts.withColumn("slot", id_slot(F.col("id"))).mapInArrow(_sets(shingle, marks), "id long, d1 long, d2 long, items array<long>")
    sets = persist(sets.join(known, ["id", "d1", "d2"], "left_semi").dropDuplicates(["id"]).select("id", "items"), "sets")

    best = pairs.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"))).alias("s")).select((-F.col("s.a")).alias("a"), "b")
    links = persist(verified(best, sets, percent), "links")
    labels = components(links)
    links = persist(links.unionByName(verified(_apart(pairs.select("a", "b"), labels), sets, percent)), "links")
    labels = components(links)
    links = persist(links.unionByName(_across(large, labels, sets, percent)), "links")
    labels = persist(components(links), "labels")

    heads = classes.select(F.col("id").alias("node"), "d1", "d2").join(labels, "node", "left")
    heads = heads.select("d1", "d2", F.coalesce("component", "node").alias("head"))
    found = signed.select("id", "n", "d1", "d2").join(heads, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("head")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    one = labels.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    two = labels.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    met = pairs.join(one, "a", "left").join(two, "b", "left")
    return met.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def tile_links(ids: np.ndarray, groups: np.ndarray, items: list[np.ndarray], asked: np.ndarray, asked_groups: np.ndarray, asked_items: list[np.ndarray], percent: int):
    """Links between asked sets and sets of other groups, by counting common elements; one link for each asked set and group."""
    sizes = np.array([len(x) for x in items])
    owner = np.repeat(np.arange(len(items)), sizes)
    elements = np.concatenate(items)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    for one, group, own in zip(asked.tolist(), asked_groups.tolist(), asked_items):
        low = np.searchsorted(elements, own, "left")
        many = np.searchsorted(elements, own, "right") - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        common = np.bincount(owner[at], minlength=len(items))
        alike = np.flatnonzero((100 * common >= percent * (len(own) + sizes - common)) & (groups != group))
        for i in np.unique(groups[alike], return_index=True)[1].tolist():
            yield one, int(ids[alike[i]])


def _tile(percent: int):
    def run(members, asked):
        found = []
        if members.num_rows and asked.num_rows:
            columns = [(t.column("id").to_numpy(), t.column("of").to_numpy(), [x.values.to_numpy() for x in t.column("items")]) for t in (members, asked)]
            found = list(tile_links(*columns[0], *columns[1], percent))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _across(large: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int = 2_048) -> DataFrame:
    """Links between members of different components in buckets whose pairs have not all met.

    Buckets that share members form a family. Every open pair of a family has
    an end outside of its largest component; those members, in blocks, are held
    against all members, in blocks. Pairs are counted in place, not listed.
    """
    named = large.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("of", F.coalesce("component", "id")).select("key", "id", "of")
    mixed = named.groupBy("key").agg(F.min("of").alias("least"), F.max("of").alias("most"), F.min("id").alias("head")).filter("least <> most").select("key", "head")
    rows = persist(named.join(mixed, "key"), "mixed-buckets")
    families = components(rows.select("id", "head").distinct())
    members = rows.select("id", "of").distinct().join(families.withColumnRenamed("node", "id"), "id").withColumnRenamed("component", "family")
    parts = members.groupBy("family", "of").agg(F.count("*").alias("n"))
    most = parts.groupBy("family").agg(F.sum("n").alias("size"), F.max(F.struct("n", "of")).alias("top"))
    members = members.join(most.select("family", "size", F.col("top.of").alias("main"), (F.col("size") - F.col("top.n")).alias("others")), "family")
    across, down = (F.ceil(F.col(c) / block).cast("int") for c in ("size", "others"))
    members = persist(members.select("id", "of", "family", "main", across.alias("across"), down.alias("down")).join(sets, "id"), "family-members")
    place = F.pmod(F.xxhash64("id"), F.col("across")), F.pmod(F.xxhash64("id"), F.col("down"))
    others = F.sequence(F.lit(0).cast("long"), F.col("down") - F.lit(1).cast("long")), F.sequence(F.lit(0).cast("long"), F.col("across") - F.lit(1).cast("long"))
    held = members.filter("down > 0").select("id", "of", "items", "family", place[0].alias("x"), F.explode(others[0]).alias("y"))
    asked = members.filter("of <> main").select("id", "of", "items", "family", place[1].alias("y"), F.explode(others[1]).alias("x"))
    return held.groupBy("family", "x", "y").cogroup(asked.groupBy("family", "x", "y")).applyInArrow(_tile(percent), "a long, b long")
