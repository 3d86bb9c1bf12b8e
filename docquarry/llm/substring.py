"""Substring dedup: removes words of passages that already start earlier in the corpus.

Windows of ``window`` words are compared exactly. Each window has a minimiser,
the least hash among its ``gram``-word runs (leftmost on ties); equal windows
have equal minimisers. A bucket is 32 bits of it. Consecutive windows of one document that share the
minimiser's place form a super-k-mer, which travels as one packed string (its
words joined by spaces) to the bucket of the minimiser. There, runs of one
minimiser are sorted and their windows compared word by word.

Hot passages: each task first folds equal packed strings and equal windows of
an Arrow batch, so that a passage sends about one row per batch, not one per
copy. A run of one minimiser that still holds more than ``run_rows`` rows is
not gathered: its windows go one by one to a second shuffle on the window.

Defined results: null text has no words; a document below ``window`` words
keeps all of them. Rows with a null or shared id are told apart by 128 bits of the
SHA-256 of the text, which only such rows carry; of equal windows at equal (id, start)
neither is earlier. Null ids sort after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm import words as W
from docquarry.llm.shared import free_names, persist

LAST = (1 << 63) - 1
PIECES = "bucket int, packed binary"
COVERS = "id long, tag binary, start long, n long, packed binary"
TAG = 16
SLOTS = 1 << 18


def cut_pieces(ids: np.ndarray, tags: list, part: W.Words, window: int, gram: int) -> Iterator[tuple]:
    """The super-k-mers of some documents: (minimiser, packed words, id, tag, first word in its document)."""
    if len(part.start) < window:
        return
    hashed = W.grams(W.hashes(part), gram)
    width, n = window - gram + 1, len(part.start) - window + 1
    bits = np.uint64(max(1, int(len(hashed)).bit_length()))
    key = (hashed >> bits << bits) | np.arange(len(hashed), dtype=np.uint64)
    least, step = key, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    place = (least[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    good = W.within(part.first, window)[:n]
    opens = good.copy()
    opens[1:] &= ~(good[:-1] & (place[1:] == place[:-1]))
    heads = np.flatnonzero(opens)
    stops = good.copy()
    stops[:-1] &= ~(good[1:] & (place[1:] == place[:-1]))
    tails = np.flatnonzero(stops) + window - 1
    docs = W.doc_of(part.first)[heads]
    text = part.text
    rows = zip(hashed[place[heads]].astype(np.uint32).view(np.int32).tolist(), part.start[heads].tolist(), part.end[tails].tolist(),
               ids[docs].tolist(), (tags[d] for d in docs.tolist()), (heads - part.first[docs]).tolist())
    for bucket, low, high, doc, tag, start in rows:
        yield bucket, text[low:high], doc, tag, start


def split_run(rows: list[tuple], window: int) -> tuple[list[tuple], list[tuple]]:
    """Compares the windows of super-k-mers (packed, id, tag, start) that share a minimiser.

    Gives (covers, left): word ranges (id, tag, start, n) of windows that start
    earlier within ``rows``, and super-k-mers of the other windows.
    """
    covers, left, firsts = [], [], {}
    rows.sort(key=lambda r: (r[1], r[3]))
    for row in rows:
        packed, doc, tag, start = row
        seen = firsts.get(packed)
        if seen is not None and seen[0] < (doc, start):
            covers.append((doc, tag, start, packed.count(b" ") + 1))
        elif seen is not None and seen[1] == tag:
            continue
        else:
            firsts[packed] = ((doc, start), tag)
            left.append(row)
    if len(firsts) < 2:
        return covers, left
    listed = []
    for row in left:
        parts = row[0].split(b" ")
        for i in range(len(parts) - window + 1):
            listed.append((b" ".join(parts[i : i + window]), row[1], row[3] + i, row[2]))
    listed.sort()
    later: set[tuple] = set()
    last = None
    for key, doc, start, tag in listed:
        if last is not None and last[0] == key:
            if last[1:] < (doc, start):
                later.add((doc, tag, start))
        else:
            last = (key, doc, start)
    if not later:
        return covers, left
    kept = []
    for packed, doc, tag, start in left:
        parts = packed.split(b" ")
        n = len(parts) - window + 1
        gone = [(doc, tag, start + i) in later for i in range(n)]
        i = 0
        while i < n:
            j = i
            while j < n and gone[j] == gone[i]:
                j += 1
            if gone[i]:
                covers.append((doc, tag, start + i, j - i + window - 1))
            else:
                kept.append((b" ".join(parts[i : j + window - 1]), doc, tag, start + i))
            i = j
    return covers, kept


def head(doc: int, tag: bytes, start: int) -> bytes:
    """Where a packed string stands, in as few bytes as hold it; never opens with a zero byte."""
    a, b = doc.to_bytes(doc.bit_length() // 8 + 1, "little", signed=True), start.to_bytes(start.bit_length() // 8 + 1, "little")
    return bytes((len(a) << 4 | (len(tag) > 0) << 3 | len(b),)) + a + tag + b


def behead(row: bytes) -> tuple[bytes, int, bytes, int]:
    """(rest, id, tag, start) of bytes that open with a head."""
    a = 1 + (row[0] >> 4)
    t = a + (TAG if row[0] & 8 else 0)
    b = t + (row[0] & 7)
    return row[b:], int.from_bytes(row[1:a], "little", signed=True), row[a:t], int.from_bytes(row[t:b], "little")


def _emit(bucket: list, rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "packed"])


def _pieces(window: int, gram: int, fold_bytes: int = 8 << 20):
    def fold(runs: dict[int, list]) -> Iterator[pa.RecordBatch]:
        buckets, out = [], []
        for bucket, rows in runs.items():
            covers = ()
            if len(rows) > 1:
                covers, rows = split_run(rows, window)
            for doc, tag, start, n in covers:
                buckets.append((doc * 31 + start) % (1 << 31))
                out.append(b"\0" + head(doc, tag, start) + n.to_bytes(8, "little"))
            for packed, doc, tag, start in rows:
                buckets.append(bucket)
                out.append(head(doc, tag, start) + packed)
            if len(out) >= 20_000:
                yield _emit(buckets, out)
                buckets, out = [], []
        if out:
            yield _emit(buckets, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").fill_null(LAST).to_numpy(zero_copy_only=False)
            tags = batch.column("tag").to_pylist()
            runs: dict[int, list] = {}
            size = 0
            for part in W.slices(batch.column("text")):
                for bucket, *row in cut_pieces(ids[part.rows], tags[part.rows], part, window, gram):
                    runs.setdefault(bucket, []).append(tuple(row))
                size += len(part.text)
                if size >= fold_bytes:
                    yield from fold(runs)
                    runs, size = {}, 0
            yield from fold(runs)

    return run


def _covers(rows: list[tuple], packed: list | None = None) -> pa.RecordBatch:
    ids, tags, starts, sizes = zip(*rows) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(tags, pa.binary()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
         pa.array(packed if packed is not None else [None] * len(rows), pa.binary())],
        names=["id", "tag", "start", "n", "packed"])


def _bucket_runs(window: int, run_rows: int):
    """Reads super-k-mers sorted by minimiser; holds one run at a time, ``run_rows`` rows of it at most."""

    def windows_of(rows):
        where, packed = [], []
        for text, doc, tag, start in rows:
            parts = text.split(b" ")
            for i in range(len(parts) - window + 1):
                where.append((doc, tag, start + i, window))
                packed.append(b" ".join(parts[i : i + window]))
        return where, packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        held_bucket, large = None, False

        def close(out):
            if len(held) > 1 and not large:
                out.extend(split_run(held, window)[0])

        for batch in batches:
            out: list[tuple] = []
            spilled: list[tuple] = []
            packed, buckets = batch.column("packed"), batch.column("bucket").to_numpy()
            _, offsets, data = packed.buffers()
            first = np.frombuffer(offsets, np.int32)[packed.offset : packed.offset + len(packed)]
            whole = np.frombuffer(data, np.uint8)[first] != 0
            for i in np.flatnonzero(~whole).tolist():
                n, *where = behead(packed[i].as_py()[1:])
                out.append((*where, int.from_bytes(n, "little")))
            at = np.flatnonzero(whole)
            own = buckets[at]
            edges = np.flatnonzero(np.diff(own)) + 1
            lows, highs = np.concatenate([[0], edges]), np.concatenate([edges, [len(own)]])
            # runs of one row have no partner; the first and last run of a batch may go on in another batch
            for low, high in zip(lows.tolist(), highs.tolist()):
                if low == high:
                    continue
                inner = low > 0 and high < len(own)
                if inner and high - low == 1:
                    continue
                bucket = int(own[low])
                if bucket != held_bucket:
                    close(out)
                    held, held_bucket, large = [], bucket, False
                held.extend(behead(packed[int(i)].as_py()) for i in at[low:high])
                if large or len(held) > run_rows:
                    large = True
                    spilled.extend(held)
                    held = []
                if high < len(own):
                    close(out)
                    held, held_bucket, large = [], None, False
            for low in range(0, len(out), 50_000):
                yield _covers(out[low : low + 50_000])
            for low in range(0, len(spilled), 2_000):
                yield _covers(*windows_of(spilled[low : low + 2_000]))
        out = []
        close(out)
        if out:
            yield _covers(out)

    return run


def _first_of_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds equal windows of a batch: the earliest stay (rows of one id may tie), ranges of the others go on as covers."""
    for batch in batches:
        firsts: dict[bytes, tuple] = {}
        covers = []
        for packed, doc, tag, start, n in zip(*(batch.column(c).to_pylist() for c in ("packed", "id", "tag", "start", "n"))):
            place, (best, ties) = (doc, start), firsts.get(packed, (None, {}))
            if best is None or place < best:
                covers.extend((best[0], t, best[1], size) for t, size in ties.items())
                firsts[packed] = (place, {tag: n})
            elif best < place:
                covers.append((doc, tag, start, n))
            else:
                ties[tag] = n
        if covers:
            yield _covers(covers)
        if firsts:
            rows = [(doc, tag, start, n, packed) for packed, ((doc, start), ties) in firsts.items() for tag, n in ties.items()]
            yield _covers([r[:4] for r in rows], [r[4] for r in rows])


def repeated_ranges(docs: DataFrame, window: int = 20, gram: int = 3, run_rows: int = 100_000) -> DataFrame:
    """Word ranges (id, tag, start, n) covered by windows that start earlier; ``docs`` has id, tag and text."""
    pieces = docs.mapInArrow(_pieces(window, gram), PIECES)
    found = pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_runs(window, run_rows), COVERS)
    found = persist(found, "substring-ranges")
    whole = found.filter("packed IS NULL").drop("packed")
    single = found.filter("packed IS NOT NULL").mapInArrow(_first_of_windows, COVERS)
    single = persist(single, "substring-windows")
    ahead = F.min(F.struct("id", "start")).over(Window.partitionBy("packed"))
    late = single.filter("packed IS NOT NULL").withColumn("head", ahead).filter(F.struct("id", "start") > F.col("head"))
    return whole.unionByName(single.filter("packed IS NULL").drop("packed")).unionByName(late.select(*whole.columns))


def _keep(keep_text: bool):
    """Drops covered words and counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered = batch.column("covers").to_pylist()
            kept, sizes, gone = [], [], []
            for part in W.slices(batch.column("text")):
                for d in range(len(part.first) - 1):
                    low, high = int(part.first[d]), int(part.first[d + 1])
                    words, n_gone = _stay(part, low, high, covered[part.rows.start + d])
                    kept.append(words)
                    sizes.append(high - low)
                    gone.append(n_gone)
            names = [c for c in batch.schema.names if c not in ("covers", "tag", "id") and (keep_text or c != "text")]
            columns = [batch.column(c) for c in names]
            columns += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "kept_words", "n_words", "n_removed"])

    return run


def _stay(part: W.Words, low: int, high: int, ranges: list | None) -> tuple[bytes, int]:
    if high == low:
        return b"", 0
    if not ranges:
        return part.text[part.start[low] : part.end[high - 1]], 0
    mark = np.zeros(high - low + 1, np.int64)
    for r in ranges:
        mark[r["start"]] += 1
        mark[r["start"] + r["n"]] -= 1
    stay = np.cumsum(mark)[:-1] == 0
    flips = np.flatnonzero(np.diff(np.concatenate([[0], stay.astype(np.int8), [0]])))
    runs = zip(flips[::2].tolist(), flips[1::2].tolist())
    return b" ".join(part.text[part.start[low + a] : part.end[low + b - 1]] for a, b in runs), int((~stay).sum())


def _tagged(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text, ...) with ``tag``: bits of the text's SHA-256 where the id is null or may be shared, else empty.

    Shared ids are known by slots of their hash, so that what is sent to the tasks has a bound;
    a row that meets a slot by chance has a tag that it does not need.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    shared = docs.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select(slot.alias("_slot")).distinct()
    shared = persist(shared, "substring-shared-ids").withColumn("_shared", F.lit(True))
    met = docs.withColumn("_slot", slot).join(F.broadcast(shared), "_slot", "left")
    wide = F.col("id").isNull() | F.col("_shared").isNotNull()
    tag = F.when(wide, F.substring(F.unhex(F.sha2("text", 256)), 1, TAG)).otherwise(F.lit(b""))
    return met.withColumn("tag", tag).select(*docs.columns, "tag")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 3,
                     run_rows: int = 100_000, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``kept_words`` (the words that stay, joined by one space), ``n_words`` and ``n_removed``.

    The other columns of ``docs`` stay; columns of the new names are replaced. ``keep_text=False`` leaves the text out.
    """
    names = [c for c in free_names(docs, ("kept_words", "n_words", "n_removed")) if keep_text or c != text_col]
    inner = {c: "text" if c == text_col else f"c{i}" for i, c in enumerate(names)}
    plain = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in inner.items() if c != text_col),
                        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    plain = _tagged(plain)
    ranges = repeated_ranges(plain.select("id", "tag", "text"), window, gram, run_rows)
    covers = ranges.groupBy(F.col("id").alias("of_id"), F.col("tag").alias("of_tag")).agg(F.collect_list(F.struct("start", "n")).alias("covers"))
    met = plain.join(covers, (F.coalesce("id", F.lit(LAST)) == F.col("of_id")) & (F.col("tag") == F.col("of_tag")), "left").drop("of_id", "of_tag")
    fields = [f for f in met.schema.fields if f.name not in ("covers", "tag", "id") and (keep_text or f.name != "text")]
    schema = T.StructType([*fields, T.StructField("kept_words", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = met.mapInArrow(_keep(keep_text), schema)
    return out.select(*(F.col(x).alias(c) for c, x in inner.items()), "kept_words", "n_words", "n_removed")
