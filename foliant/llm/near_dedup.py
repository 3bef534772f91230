"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. sets      A text (A-Z lower-cased) becomes the set of its distinct 5-word shingles, as sorted 64-bit hashes. Documents
             with equal sets are one class: copies cost one row each from here on and are never paired.
2. signature SuperMinHash: every shingle deals itself to all 256 slots by its own random permutation, in rounds; the value
             is the round plus a random fraction, so ranks of one shingle are correlated over slots and lower the variance.
             A document stops at the round after which no slot can fall any more, which for long texts is the first.
3. bands     32 bands of 4 of the slots. A band's value that two classes share makes a bucket. At similarity 0.75 a pair shares
             no bucket with probability (1 - 0.75**4)**32 = 5e-6. Band values are dealt and sorted once, and read in order.
4. bounds    Of each class in a bucket, the shingles that any other such class has are counted (hashes cut to 32 bits, so
             that a count may be too large and is never too small). With n and m shingles, s and t of them shared with
             anyone, similarity p needs (1 + p) * min(s, t) >= p * (n + m): a copy with many edits of its own has no
             partner, and is never paired with its group.
5. stars     No bucket is expanded into its pairs. Each class proposes one link, to the class with the least hash among
             its buckets; links are checked on the full sets and grouped. Most groups are whole after that.
6. crossings What is left are pairs in one bucket whose groups differ. Buckets are cut into blocks of classes; each pair of
             blocks that can hold such a pair is compared at once, by the bounds and by 256-byte sketches of the signatures,
             which drop pairs whose estimate is below 0.75 by more than 0.135 (5 standard deviations: 3e-7). First the best
             partner of each class is checked and groups are joined. Then classes that still have a partner across groups
             are marked, their full sets are brought to their blocks, and every pair that is still across groups is
             checked there; a pair is looked at in its first bucket only, the first band whose whole keys are equal. A
             link joins its two groups at once, within the task, so links written are fewer than classes: pairs are never
             rows, and none is lost to a cap.
7. groups    Union-find in each task over its links, then large-star and small-star steps between tasks until nothing
             changes. Links and groups stay in tables.

Defined results: null or empty text, or text without words: the empty set, linked with nothing (component_id is the
row's own id); fewer words than a shingle: the whole sequence is one shingle; rows that repeat an id: of a group one row
is kept, that with the smallest id; null ids are larger than all others; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.arrays import LOWER, WORDS, grams, mix, runs, strings, token_hashes, tokens
from foliant.llm.runtime import Cut, columns_for, cut, fresh, join_per_key, released, small_batches

WIDTH = 5
SLOTS, BANDS, ROWS = 256, 32, 4
PERCENT = 75
#: Five standard deviations (0.027 at most) of an estimate over 256 slots.
MARGIN = 0.135
#: Classes of a block, and shingles of all its classes together.
BLOCK, BLOCK_ITEMS = 2000, 1_000_000
#: Shingles that one task counts.
PART_ITEMS = 1_000_000
RUN_BYTES = 1 << 18


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    data, offsets = strings(texts)
    for a, b in runs(offsets, RUN_BYTES):
        part = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = tokens(part, offsets[a : b + 1] - offsets[a], WORDS)
        h = token_hashes(part, starts, ends)
        g = grams(h, width)
        for i in range(b - a):
            x, y = first[i], first[i + 1]
            yield np.unique(g[x : y - width + 1]) if y - x >= width else grams(h[x:y], y - x) if y > x else np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values of each set, as integers: the round in the upper bits, the random fraction in 40 lower ones."""
    sig = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    if not sets:
        return sig
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None
    for j in range(slots):
        if not len(items):
            break
        x = mix(items + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        k = j + (((x & np.uint64(0xFFFFFF)) * np.uint64(slots - j)) >> np.uint64(24)).astype(np.int64)
        value = (x >> np.uint64(24)) | np.uint64(j << 40)
        if j == 0:
            slot = k
        else:
            at = np.arange(len(items))
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
        np.minimum.at(sig.reshape(-1), owner * slots + slot, value)
        # early stop: once all slots are full, later rounds only bring larger values
        open_sets = sig.max(axis=1) == np.iinfo(np.uint64).max
        going = open_sets[owner]
        if not going.all() or j == 0:
            items, owner = items[going], owner[going]
            if j == 0:
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(items), 1))
                order[np.arange(len(items)), k[going]] = 0
            else:
                order = order[going]
    return sig


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, group, size, first = [], [], 0, 0
        for s in shingle_sets(batch.column("text")):
            group.append(s)
            size += len(s)
            if size > 100_000:
                ids.append(_rows(batch.slice(first, len(group)), group))
                first, group, size = first + len(group), [], 0
        if group:
            ids.append(_rows(batch.slice(first, len(group)), group))
        yield from ids


def _rows(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
    sig = signatures(sets)
    seeds = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    keys = np.zeros((len(sets), BANDS), np.uint64) + seeds
    for column in np.moveaxis(sig[:, : BANDS * ROWS].reshape(len(sets), BANDS, ROWS), 2, 0):
        keys = mix(keys ^ column)
    tags = (sig & np.uint64(255)).astype(np.uint8)
    bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * BANDS + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("token"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), bands, pa.array([t.tobytes() for t in tags], pa.binary())], ["id", "token", "n", "cls", "bands", "tags"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column("text")))
        names = [digest(s) for s in sets]
        cid = np.frombuffer(b"".join(n[:8] for n in names), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(cid), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "cid", "items"])


_ITEM = np.dtype([("cid", "<i8"), ("item", "<u4"), ("seen", "u1")])


def _dealt(parts: int):
    """Shingles of classes by part, packed: 13 bytes each.

    A shingle that several classes of a batch have is counted for them here (part -1: cid and count) and goes on once, as
    seen: however many classes have it, no part gets more of it than there are batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(x, np.uint64) for x in batch.column("items").to_pylist()]
            if not items:
                continue
            flat = np.zeros(sum(map(len, items)), _ITEM)
            flat["cid"] = np.repeat(batch.column("cid").to_numpy(), [len(x) for x in items])
            flat["item"] = (np.concatenate(items) >> np.uint64(32)).astype(np.uint32)
            flat = flat[np.argsort(flat["item"], kind="stable")]
            fresh = np.ones(len(flat), bool)
            fresh[1:] = flat["item"][1:] != flat["item"][:-1]
            often = ~fresh
            often[:-1] |= ~fresh[1:]
            counted = np.unique(flat["cid"][often], return_counts=True)
            flat["seen"] = often
            flat = flat[fresh]
            part = flat["item"] % np.uint32(parts)
            order = np.argsort(part, kind="stable")
            found, at = np.unique(part[order], return_index=True)
            packed = [x.tobytes() for x in np.split(flat[order], at[1:])] if len(found) else []
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found.astype(np.int32), np.int32(-1))), pa.array([*packed, np.stack(counted).astype(np.int64).tobytes()], pa.binary())], ["part", "packed"])

    return run


def _shared_items(table: pa.Table) -> pa.Table:
    """How many of its shingles in this part each class shares with another, but for those that were counted before."""
    flat = np.frombuffer(b"".join(table["packed"].to_pylist()), _ITEM)
    flat = flat[np.argsort(flat["item"], kind="stable")]
    same = flat["item"][1:] == flat["item"][:-1]
    both = np.zeros(len(flat), bool)
    both[1:] |= same
    both[:-1] |= same
    found, counts = np.unique(flat["cid"][both & (flat["seen"] == 0)], return_counts=True)
    return pa.table({"cid": found, "s": counts.astype(np.int64)})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [np.frombuffer(x, np.int64).reshape(2, -1) for x in batch.column("packed").to_pylist()]
        if both:
            found, counts = np.concatenate(both, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], ["cid", "s"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and class, those whose key has another class; repeated rows once."""
    last: tuple | None = None  # key, class, band, and whether it has gone out
    for batch in batches:
        key = batch.column("key").to_numpy()
        cls = batch.column("cls").to_pylist()
        band = batch.column("band").to_numpy()
        n = len(key)
        if not n:
            continue
        prior = [last[1] if last else None, *cls[:-1]]
        with_prior = np.concatenate([[last is not None and last[0] == key[0]], key[1:] == key[:-1]])
        fresh = ~(with_prior & np.fromiter((a == b for a, b in zip(cls, prior, strict=True)), bool, n))
        at = np.flatnonzero(fresh)
        if not len(at):
            continue
        joined = with_prior[at]  # another class of the key came before
        out = joined.copy()
        out[:-1] |= joined[1:]
        keys, rows, bands = key[at[out]], [cls[i] for i in at[out]], band[at[out]]
        if joined[0] and not last[3]:
            keys, rows, bands = np.append(keys, last[0]), [*rows, last[1]], np.append(bands, last[2])
        last = (key[at[-1]], cls[at[-1]], band[at[-1]], bool(out[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(keys), pa.array(bands.astype(np.int32))], ["cls", "key", "band"])


def _alike(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), SLOTS) for c in ("tags_a", "tags_b"))
                yield batch.filter(pa.array((a == b).mean(axis=1) >= threshold)).select(["a", "b"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                keep.append(similar(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _attach(links: DataFrame, nodes: DataFrame, side: str, *columns: str) -> DataFrame:
    """links with columns of nodes for one end. An end with very many links is split by adaptive execution: an inner join."""
    have = nodes.select(F.col("cls").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
    return links.join(have, side)


class _Groups:
    """The group of each class: the least class that links lead to. Classes without links are left out."""

    def __init__(self, spark: SparkSession):
        self.spark, self.cut = spark, None

    def add(self, links: DataFrame) -> None:
        """links (a, b); written first, so that a task has one Python worker at a time"""
        new = Cut(links, "links")
        links = new.frame
        if self.cut:
            links = links.unionByName(self.frame().select(F.col("cls").alias("a"), F.col("root").alias("b")))
        now = Cut(stars(links.filter("a <> b")), "groups")
        new.drop()
        if self.cut:
            self.cut.drop()
        self.cut = now

    def frame(self) -> DataFrame:
        return self.cut.frame if self.cut else self.spark.createDataFrame([], "cls binary, root binary")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a task: each item with the least item it is linked to."""
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(parent)]
    pairs = [p for p in pairs if p[0] != p[1]]
    for i in range(0, len(pairs), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs[i : i + 10_000]], pa.binary()) for k in (0, 1)], ["a", "b"])


def stars(links: DataFrame, per_task: int = 200_000) -> DataFrame:
    """(cls, root): connected components of links (a, b): union-find in tasks of about per_task links, star steps between."""

    def step(edges: DataFrame, large: bool) -> DataFrame:
        if large:  # u's larger neighbours get the least of u and its neighbours
            both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:  # smaller neighbours, and u itself
            both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u")
        if large:
            return out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))

    local = Cut(links.select("a", "b").mapInArrow(_forest, "a binary, b binary"), "links")
    parts = max(1, math.ceil(local.frame.count() / per_task))
    before = Cut(local.frame.repartition(parts).mapInArrow(_forest, "a binary, b binary"), "links")
    local.drop()
    while parts > 1:
        # a forest in which no item has two roots and no root has a root is done
        d = before.frame
        twice = d.groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y")).filter("x <> y").select("a")
        nested = d.join(d.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a")
        if not twice.unionByName(nested).take(1):
            break
        now = Cut(step(step(d, True), False).filter("a <> b").distinct(), "links")
        before.drop()
        before = now
    return before.frame.select(F.col("a").alias("cls"), F.col("b").alias("root")).distinct()


class _Block:
    """One pair of blocks of a bucket (side 1 and 2; 0: one block with itself)."""

    def __init__(self, table: pa.Table, threshold: float, percent: int):
        self.threshold, self.percent = threshold, percent
        self.cls, self.roots = table["cls"].to_pylist(), table["root"].to_pylist()
        known: dict = {}
        self.root = np.array([known.setdefault(r, len(known)) for r in self.roots])
        self.n, self.s, self.side, self.band = (table[c].to_numpy() for c in ("n", "s", "side", "band"))
        self.tags = np.frombuffer(b"".join(table["tags"].to_pylist()), np.uint8).reshape(len(self.cls), SLOTS)
        self.bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(self.cls), BANDS) if "bands" in table.schema.names else None
        self.items = table["items"].to_pylist() if "items" in table.schema.names else None

    def partners(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each row with the rows on the other side that may be alike and whose groups differ, and their estimates."""
        right = np.flatnonzero(self.side != 1)
        n, s, p = self.n, self.s, self.percent
        for i in np.flatnonzero(self.side != 2):
            bound = ((100 + p) * np.minimum(s[right], s[i]) >= p * (n[right] + n[i])) & (100 * np.minimum(n[right], n[i]) >= p * np.maximum(n[right], n[i]))
            at = right[(self.root[right] != self.root[i]) & bound]
            if self.bands is not None and len(at):
                at = at[(self.bands[at] == self.bands[i]).argmax(axis=1) == self.band[i]]  # the first bucket that both are in
            if len(at):
                alike = (self.tags[at] == self.tags[i]).mean(axis=1)
                keep = alike >= self.threshold
                if keep.any():
                    yield int(i), at[keep], alike[keep]

    def best(self) -> Iterator[tuple[bytes, bytes]]:
        """The most similar partner of each row."""
        for i, at, alike in self.partners():
            j = at[alike.argmax()]
            yield min(self.cls[i], self.cls[j]), max(self.cls[i], self.cls[j])

    def marked(self) -> set[int]:
        """Rows that have a partner."""
        out = set()
        for i, at, _ in self.partners():
            out.add(i)
            out.update(at.tolist())
        return out

    def links(self) -> Iterator[tuple[bytes, bytes]]:
        """Links on the full sets that join two groups, most similar first; groups joined here are one from then on."""
        parent = list(range(len(self.root)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sets: dict[int, np.ndarray] = {}
        for i, at, alike in self.partners():
            for j in at[np.argsort(-alike, kind="stable")].tolist():
                a, b = find(self.root[i]), find(self.root[j])
                if a != b:
                    x, y = (sets.setdefault(k, np.frombuffer(self.items[k], np.uint64)) for k in (i, j))
                    if similar(x, y, self.percent):
                        parent[max(a, b)] = min(a, b)
                        yield min(self.cls[i], self.cls[j]), max(self.cls[i], self.cls[j])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of two sorted sets: 100 * intersection >= percent * union."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows come sorted by pair of blocks (key, p, q); one pair is in memory at a time."""
    rest: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        at = np.stack([batch.column(c).to_numpy() for c in ("key", "p", "q")])
        if not at.shape[1]:
            continue
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), at.shape[1]]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(at[:, x].tolist())
            if key != now and rest:
                yield pa.Table.from_batches(rest)
                rest = []
            now = key
            rest.append(batch.slice(x, y - x))
    if rest:
        yield pa.Table.from_batches(rest)


def _pairs(method: str, threshold: float, percent: int):
    """Pairs (a, b) that a method of the pairs of blocks gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set = set()
        for table in _blocks(batches):
            if table.num_rows > 1:
                out.update(getattr(_Block(table, threshold, percent), method)())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["a", "b"])
                out = set()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


MEETING = ["key", "band", "p", "q", "side", "cls"]


def _marks(threshold: float, percent: int):
    """Those rows that have a partner in their pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            if table.num_rows > 1 and (rows := sorted(_Block(table, threshold, percent).marked())):
                yield from table.select(MEETING).take(rows).combine_chunks().to_batches()

    return run


def _meetings(members: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(MEETING, root): members (key, band, cls) dealt to the pairs of blocks in which classes of different groups meet."""
    m = members.join(groups, "cls", "left").withColumn("root", F.coalesce("root", "cls")).join(nodes.select("cls", "n"), "cls")
    per_root = m.groupBy("key", "root").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("items"))
    # the largest group of a bucket needs no comparison with itself
    most = F.max(F.struct("count", "root", "items"))
    per_key = per_root.groupBy("key").agg(most.alias("most"), F.sum("count").alias("count"), F.sum("items").alias("items"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    blocks = lambda count, items: F.ceil(F.greatest(count / BLOCK, items / BLOCK_ITEMS)).cast("int")
    per_key = per_key.select("key", F.col("most.root").alias("main"), blocks(F.col("most.count"), F.col("most.items")).alias("mains"), blocks(F.col("count") - F.col("most.count"), F.col("items") - F.col("most.items")).alias("others"))
    m = m.join(per_key, "key")
    is_main = F.col("root") == F.col("main")
    block = F.when(is_main, F.col("others") + F.pmod(F.hash("cls"), F.col("mains"))).otherwise(F.pmod(F.hash("cls"), F.col("others")))
    m = m.withColumn("block", block)
    # a block of others meets every block from itself on; a block of the main group meets all blocks of others
    last = F.col("others") + F.col("mains") - 1
    up = F.transform(F.sequence(F.col("block"), last), lambda x: F.struct(F.col("block").alias("p"), x.alias("q"), F.when(x == F.col("block"), 0).otherwise(1).alias("side")))
    down = F.transform(F.filter(F.sequence(F.lit(0), F.col("others") - 1), lambda x: x < F.col("block")), lambda x: F.struct(x.alias("p"), F.col("block").alias("q"), F.lit(2).alias("side")))
    return m.withColumn("at", F.explode(F.when(is_main, down).otherwise(F.concat(up, down)))).select("key", "band", "at.p", "at.q", "at.side", "cls", "root")


def _together(meetings: DataFrame) -> DataFrame:
    return meetings.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")


def proposals(members: DataFrame, groups: DataFrame, nodes: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Pairs (a, b): for each class of a pair of blocks the partner of another group whose sketch is most alike."""
    m = _meetings(members, groups, nodes).join(nodes.select("cls", "n", "s", "tags"), "cls")
    return _together(m).mapInArrow(released(_pairs("best", threshold, percent)), "a binary, b binary").distinct()


def remaining(members: DataFrame, groups: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Links (a, b), checked on the full sets, after which no two classes that are alike are in different groups."""
    m = _meetings(members, groups, nodes).join(nodes.select("cls", "n", "s", "tags", "bands"), "cls")
    marked = cut(_together(m).mapInArrow(released(_marks(threshold, percent)), "key long, band int, p int, q int, side int, cls binary"), "marked")
    whole = marked.join(groups, "cls", "left").withColumn("root", F.coalesce("root", "cls")).join(nodes.select("cls", "n", "s", "tags", "bands"), "cls")
    # what is marked grows with the input, so it is never broadcast
    whole = whole.hint("merge").join(sets.select("cls", "items"), "cls")
    return _together(whole).mapInArrow(released(_pairs("links", threshold, percent)), "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType
    texts = docs.select(*columns_for(docs, id=id_col, text=text_col), F.monotonically_increasing_id().alias("token"))
    kind = id_type.simpleString()
    rows = cut(texts.mapInArrow(released(_sketches), f"id {kind}, token long, n long, cls binary, bands array<long>, tags binary"), "sketches")
    least = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("token").alias("token"))
    total = rows.count()
    classes = rows.filter("n > 0").groupBy("cls").agg(F.min(least).alias("least"), F.count(F.lit(1)).alias("size"))
    threshold = percent / 100 - MARGIN

    # buckets that more than one class shares
    at = rows.filter("n > 0").select("cls", F.posexplode("bands").alias("band", "key"))
    members = cut(at.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(released(_buckets), "cls binary, key long, band int"), "members")
    wanted = members.select("cls").distinct()
    nodes = cut(rows.join(wanted, "cls", "left_semi").dropDuplicates(["cls"]).select("cls", "n", "tags", "bands", "id"), "nodes")
    # what has a partner grows with the input, so it is never broadcast
    mine = texts.select("id", "text").join(nodes.select(F.col("id").alias("_id")).hint("merge"), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    sets = mine.mapInArrow(released(_sets), "cls binary, cid long, items binary")
    sets = cut(sets.join(nodes.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")

    # bounds: shingles that another class of any bucket has
    items = nodes.agg(F.sum("n").alias("n")).first().n or 0
    dealt = cut(sets.select("cid", "items").mapInArrow(released(_dealt(max(1, math.ceil(items / PART_ITEMS)))), "part int, packed binary"), "dealt")
    counts = dealt.filter("part >= 0").groupBy("part").applyInArrow(_shared_items, "cid long, s long")
    counts = counts.unionByName(dealt.filter("part < 0").mapInArrow(released(_counted), "cid long, s long")).groupBy("cid").agg(F.sum("s").alias("s"))
    counts = sets.select("cls", "cid").join(counts, "cid").select("cls", "s")
    nodes = nodes.join(counts, "cls").filter((100 + percent) * F.col("s") * 100 >= F.lit(percent * (100 + percent)) * F.col("n"))
    nodes = cut(nodes, "bounded")
    members = cut(members.join(nodes.select("cls"), "cls", "left_semi"), "bounded")

    groups = _Groups(spark)

    def check(links: DataFrame) -> None:
        sized = _attach(_attach(links, nodes, "a", "n", "tags"), nodes, "b", "n", "tags")
        sized = sized.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        near = sized.select("a", "b", "tags_a", "tags_b").mapInArrow(released(_alike(threshold)), "a binary, b binary")
        whole = _attach(_attach(near, sets, "a", "items"), sets, "b", "items")
        groups.add(whole.select("a", "b", "items_a", "items_b").mapInArrow(released(_verify(percent)), "a binary, b binary"))

    rank = F.struct(F.xxhash64("cls").alias("rank"), F.col("cls"))
    best = members.groupBy("key").agg(F.min(rank).alias("best"))
    proposed = members.join(best, "key").filter("cls <> best.cls").groupBy("cls").agg(F.min("best").alias("best"))
    check(proposed.select(F.col("cls").alias("a"), F.col("best.cls").alias("b")))
    check(proposals(members, groups.frame(), nodes, threshold, percent))
    groups.add(remaining(members, groups.frame(), nodes, sets, threshold, percent))

    grouped = classes.join(groups.frame(), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    roots = grouped.groupBy("root").agg(F.min("least").alias("keep"), F.sum("size").alias("all")).filter("all > 1")
    known = grouped.join(roots, "root").select("cls", "size", "keep")
    known = cut(known, "classes")
    found = join_per_key(rows.filter("n > 0").select("id", "token", "n", "cls"), known, "cls", "size", total, "left")
    own = found.unionByName(rows.filter("n = 0").select("id", "token", "n", "cls"), allowMissingColumns=True)
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("keep.id", "id").alias("component_id"), F.coalesce(F.col("token") == F.col("keep.token"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs without the rows whose group keeps another row. Rows that repeat an id go or stay together."""
    (name,) = fresh(docs, "gone")
    gone = near_duplicates(docs, id_col, text_col, percent).filter(~F.col("kept")).select(F.col(id_col).alias(name))
    return docs.join(gone.hint("merge"), docs[f"`{id_col}`"].eqNullSafe(F.col(name)), "left_anti")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
