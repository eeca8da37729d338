"""N-gram Jaccard join: pairs of units (documents, or lines of them) whose sets of word shingles are alike.

1. The packed exchange tells how often each shingle occurs in the corpus. A unit that shares fewer of its shingles than
   the threshold asks of the larger of two sets can't be in a pair, and goes no further.
2. Units of equal sets are one class; its least member stands for it. A shingle that occurs no more often than the
   class has members is in no other set; a representative with too few others goes no further either.
3. The shingles of a representative stand in the order of their rarity. Two sets that are alike share one of
   their first n - ceil(t n) + 1 (prefix filter). Each of these puts the representative into the tiles (shingle, size
   band) of its own band and the next, as sizes of a pair lie within one band of another.
4. Every member of a tile is compared with a few leaders of it: the first, and the least by some hashes. Pairs that this
   leaves open are compared too, block by block, each in one tile: for components, members of different
   components; for first occurrences, members that have no earlier match yet with all earlier ones. So nothing that
   could matter is passed over, and a group of copies makes a few stars, not all its pairs.
   For components, where the bounds leave open many more pairs of a tile than it has members, these are a crowd: no pair
   of it is written down, its sets are compared with one another, block by block, and what joins two components stays.
   Where the number of links is asked for, the members of each component are then compared with one another, block by
   block, as every link lies within a component: each representative counts the classes that are alike by their sizes,
   and no pair is written down.
5. Of a pair, hashed bitmaps are compared first, in the tile a short one and then one as long as its band asks: a bit
   that one has and the other hasn't stands for a shingle that they don't share, so bit counts bound the intersection
   from above. What stays is decided exactly, on sorted arrays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import MAX_ID, durable, shuffle_partitions, table, trim, unused, written
from tidemark.llm.components import components
from tidemark.llm.shared import Plan, Words, planes, rolling, unplaned, words_of

SHINGLE, ALIKE = 5, (75, 100)
#: Leaders of a tile besides its least member, longs of the short bitmap, members of a block, pairs compared at once,
#: members of a tile that is compared along with others, open pairs for each member beyond which these are a crowd.
LEADERS, MARK, BLOCK, AT_ONCE, SMALL, CROWDED = 3, 16, 4096, 1 << 17, 64, 4
#: Hashes of a block in which links are counted or sought, and of the small components or crowds that are dealt with together.
BLOCK_HASHES, TOGETHER = 1 << 20, 1 << 18


@dataclass
class Sets:
    """Distinct shingle hashes of many units, one after another, each in rising order."""

    unit: np.ndarray  # of every hash
    hashes: np.ndarray
    ends: np.ndarray  # where each unit begins and the last ends


def shingle_sets(h: np.ndarray, ends: np.ndarray, width=SHINGLE) -> Sets:
    """The sets of units of words: shingles of ``width``, of fewer words the whole sequence, of none nothing."""
    n = np.diff(ends)
    of = np.repeat(np.arange(len(n), dtype=np.uint16 if len(n) < 1 << 16 else np.int64), n)
    place = np.arange(len(h)) - ends[:-1][of]
    at = np.flatnonzero(place + width <= n[of])
    unit, value = [of[at]], [rolling(h, width)[at]]
    for k in range(1, width):
        short = np.flatnonzero((n[of] == k) & (place == 0))
        if len(short):
            unit.append(of[short])
            value.append(rolling(h, k)[short] ^ np.uint64(k))
    unit, value = np.concatenate(unit), np.concatenate(value)
    order = np.argsort(value)
    order = order[np.argsort(unit[order], kind="stable")]
    unit, value = unit[order], value[order]
    new = np.append(True, (unit[1:] != unit[:-1]) | (value[1:] != value[:-1]))[: len(unit)]
    unit, value = unit[new], value[new]
    return Sets(unit, value, np.searchsorted(unit, np.arange(len(n) + 1)))


def least_common(n, alike=ALIKE):
    """Shingles that a set of n shares with any that is as like it as asked: 100 I >= 75 U, and U >= n."""
    return -(-alike[0] * n // alike[1])


def band_of(n: int, alike=ALIKE) -> int:
    """Sets of a pair have sizes within a factor of 1 / t, so equal or neighbouring bands."""
    return int(math.log(max(1, n)) / math.log(alike[1] / alike[0]) + 1e-9)


def bitmap(hashes: np.ndarray, n: int) -> bytes:
    """About two bits for each member of the largest set of the band; a power of two, so that it can be folded."""
    bits = 1 << max(6, min(16, (2 * n).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def mark(hashes: np.ndarray) -> list[int]:
    out = np.zeros(64 * MARK, np.uint8)
    out[(hashes >> np.uint64(20) & np.uint64(64 * MARK - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view("<i8").tolist()


def _fold(b: np.ndarray, size: int) -> np.ndarray:
    return b if len(b) == size else np.bitwise_or.reduce(b.reshape(-1, size), 0)


def overlap_bound(a: bytes, na: int, b: bytes, nb: int) -> int:
    """The intersection has no more members than this."""
    size = min(len(a), len(b)) // 8
    x, y = _fold(np.frombuffer(a, "<u8"), size), _fold(np.frombuffer(b, "<u8"), size)
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def most_common(i, n, j, m, least):
    """Positional bound: a shingle at places i and j of two sets by rarity has so many shared ones beside it at most."""
    return least(i, j) + 1 + least(n - i - 1, m - j - 1)


def alike_sets(common, na, nb, alike=ALIKE):
    return alike[1] * common >= alike[0] * (na + nb - common)


#: A head stands for the units of its group that have one set: the first of them by (p1, p2), how many they are, what signatures()
#: gives, and the p1 and p2 of each. So a set that a third of all units have is a row per group wherever it is joined.
HEAD = "g long, unit long, p1 long, p2 long, copies int, members1 array<long>, members2 array<long>, n int, digest binary, tokens binary, counts binary"
HEADS = pa.schema([
    ("g", pa.int64()), ("unit", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("copies", pa.int32()), ("members1", pa.list_(pa.int64())), ("members2", pa.list_(pa.int64())),
    ("n", pa.int32()), ("digest", pa.binary()), ("tokens", pa.binary()), ("counts", pa.binary()),
])


def occurrences(w: Words, ends: np.ndarray, key_of, width=SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the shingles of all units, and how often each occurs; a unit that repeats one counts more than once, so
    counts are never too low."""
    n = np.diff(ends)
    left = np.repeat(ends[1:], n) - np.arange(len(w.hashes))  # words from here to the unit's end
    at = np.flatnonzero(left >= width)
    found = [rolling(w.hashes, width)[at]]
    if (n < width).any():
        short = shingle_sets(*subset(w.hashes, ends, n < width), width)
        found.append(short.hashes)
    return np.unique(key_of(np.concatenate(found)), return_counts=True)


def may_share(w: Words, ends: np.ndarray, look_up, width=SHINGLE, alike=ALIKE) -> np.ndarray:
    """Of each unit whether it may share enough. A shingle that a unit repeats occurs twice at least, so those that
    occur once are as many among places as among shingles; and a unit has no more shingles than places."""
    n = np.diff(ends)
    of = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(np.repeat(ends[1:], n) - np.arange(len(w.hashes)) >= width)
    alone = np.bincount(of[at], look_up(rolling(w.hashes, width)[at]) == 1, len(n))
    return alone <= (n - width + 1) - least_common(np.maximum(n - width + 1, 0), alike) if len(n) else np.zeros(0, bool)


def subset(h: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and ends of some of the units."""
    n = np.diff(ends)
    return h[np.repeat(which, n)], np.append(0, np.cumsum(n[which]))


def signatures(sets: Sets, counts: np.ndarray, alike=ALIKE):
    """Per unit: n, digest of the set, and where it shares enough of its hashes: these in order, and their counts."""
    shares = np.add.reduceat(np.append(counts > 1, False).astype(np.int64), sets.ends[:-1]) if len(sets.ends) > 1 else np.empty(0, np.int64)
    for k, (a, b) in enumerate(zip(sets.ends[:-1].tolist(), sets.ends[1:].tolist(), strict=True)):
        n, h = b - a, sets.hashes[a:b]
        digest = xxhash.xxh3_128_digest(h.tobytes())
        if not n or shares[k] < least_common(n, alike):
            yield n, digest, None, None
        else:
            yield n, digest, h.tobytes(), planes(np.minimum(counts[a:b], 2**32 - 1))


def _representatives(found: DataFrame, alike) -> DataFrame:
    """(unit, n, size, tokens, counts, p1, p2, digest) -> those that share enough with other classes: short and long bitmap, the hashes in
    order, and of the prefix by rarity the hashes that others have, with their places."""
    schema = pa.schema([("unit", pa.int64()), ("n", pa.int32()), ("mark", pa.list_(pa.int64())), ("bits", pa.binary()), ("tokens", pa.binary()), ("prefix", pa.binary()), ("places", pa.binary()), ("p1", pa.int64()), ("p2", pa.int64()), ("digest", pa.binary())])

    def made(batches):
        for batch in batches:
            rows = []
            for unit, n, size, tokens, counts, p1, p2, digest in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                h, c = np.frombuffer(tokens, np.uint64), unplaned(counts)
                others = c > size
                if others.sum() < least_common(n, alike):
                    continue
                order = np.lexsort((h, c))[: n - least_common(n, alike) + 1]
                places = np.flatnonzero(others[order])
                rows.append((unit, n, mark(h), bitmap(h, n), tokens, h[order[places]].tobytes(), places.astype(np.int32).tobytes(), p1, p2, digest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        trim()

    return found.select("unit", "n", "size", "tokens", "counts", "p1", "p2", "digest").mapInArrow(made, "unit long, n int, mark array<long>, bits binary, tokens binary, prefix binary, places binary, p1 long, p2 long, digest binary")


def heads_of(g: int, digest: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> tuple[np.ndarray, list]:
    """Units of a group (digest: two numbers of each) -> per head its first unit, and the columns of HEADS up to the members."""
    order = np.lexsort((p2, p1, digest[:, 1], digest[:, 0]))
    p1, p2, digest = p1[order], p2[order], digest[order]
    starts = np.flatnonzero(np.append(True, (digest[1:] != digest[:-1]).any(1))[: len(order)])
    ends = np.append(starts, len(order)).astype(np.int32)
    own = order[starts]
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(p, pa.int64())) for p in (p1, p2)]
    return own, [np.full(len(own), g), (g << 32) + own, p1[starts], p2[starts], np.diff(ends).astype(np.int32), *lists]


def class_links(units: DataFrame, alike=ALIKE, first=False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """units, a table of HEAD, read several times ->

    classes (digest, rep, p1, p2, size): of each set that may be in a pair or belongs to several units, the unit of the first
    place and how many units it has;
    links (unit, to, common): pairs of representatives that are alike, which connect whatever is connected, not all. If ``first``,
    (digest) in place of links: the sets with an earlier match, as pairs that name one for each are looked for;
    reps: the representatives that may be in a pair.
    """
    classes = units.where("n > 0").groupBy("digest").agg(F.min_by("unit", "p1").alias("rep"), F.min("p1").alias("p1"), F.min_by("p2", "p1").alias("p2"), F.sum("copies").alias("size"), F.max(F.col("tokens").isNotNull()).alias("shares"))
    classes = durable(classes.where("shares").drop("shares"))  # what several units have, all of them share
    found = units.where("tokens is not null").select("unit", "n", "digest", "tokens", "counts")
    own = classes.select(F.col("rep").alias("unit"), "size", "p1", "p2")
    reps = durable(_representatives(found.join(own, "unit"), alike))
    tiles = durable(_tiles(reps.select("unit", "n", "prefix", "places", "p1"), alike, banded=not first))
    fits = F.col("n") * alike[0] <= F.col("m") * alike[1]
    fits = fits & (F.col("m") * alike[0] <= F.col("n") * alike[1])
    fits = fits & alike_sets(most_common(F.col("place"), F.col("n"), F.col("place2"), F.col("m"), F.least), F.col("n"), F.col("m"), alike)
    # min_by of numbers is a hash aggregate, so members are combined before they are shuffled
    orders = [(F.xxhash64("unit", F.lit(k)) if k else F.col("p1")) for k in range((1 if first else LEADERS) + 1)]
    lead = [F.struct(*[F.min_by(c, h).alias(c) for c in ("unit", "n", "place")]) for h in orders]
    led = tiles.groupBy("token", "at").agg(F.array(*lead).alias("leads"), F.min("unit").alias("a"), F.max("unit").alias("b")).where("a < b")
    stars = tiles.join(led.drop("a", "b"), ["token", "at"]).select("unit", "n", "place", F.explode("leads").alias("lead"))
    stars = stars.withColumn("m", F.col("lead.n")).withColumn("place2", F.col("lead.place")).where(fits & (F.col("unit") != F.col("lead.unit")))
    stars = stars.select(F.greatest("unit", "lead.unit").alias("unit"), F.least("unit", "lead.unit").alias("to")).distinct()
    links = durable(verified(stars, reps, alike, bitmaps=not first))
    if first:
        gone = later_of(links, reps).withColumn("gone", F.lit(True))
        placed = tiles.join(gone, "unit", "left").withColumn("gone", F.col("gone").isNotNull()).withColumn("component", F.col("unit"))
        stays = F.when(~F.col("gone"), F.col("p1"))
        open_ = (F.count(stays) > 1) | (F.min(F.when(F.col("gone"), F.col("p1"))) <= F.max(stays))
    else:
        joined = components(links.select(F.col("unit").alias("u"), F.col("to").alias("v")))
        placed = tiles.join(joined.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit")).withColumn("gone", F.lit(False))
        open_ = F.min("component") < F.max("component")
    mixed = placed.groupBy("token", "at").agg(open_.alias("open"), F.count(F.lit(1)).alias("size"), F.min("unit").alias("least")).where("open and size > 1")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    placed = placed.drop("p1").join(mixed.select("token", "at", "size", "least", blocks.alias("blocks")), ["token", "at"]).join(reps.select("unit", "p1", "p2", "mark"), "unit")
    placed = placed.withColumn("block", F.pmod(F.hash("unit"), "blocks")).withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # small tiles are compared many at a time, those of one least member together: most of their pairs are the same
    small, many = F.col("size") <= SMALL, max(8 * shuffle_partitions(units.sparkSession), reps.count() // 512)
    placed = placed.withColumn("low", F.when(small, -1).otherwise(F.least("block", "beside"))).withColumn("high", F.when(small, -1).otherwise(F.greatest("block", "beside")))
    placed = placed.withColumn("of", F.when(small, F.pmod(F.xxhash64("least"), F.lit(many))).otherwise(F.col("token"))).withColumn("of_at", F.when(small, -2).otherwise(F.col("at")))
    rest = placed.drop("size", "blocks", "beside", "least").groupBy("of", "of_at", "low", "high").applyInArrow(_compare(alike, crowds=not first), "unit long, to long, crowd boolean").distinct()
    if first:
        links = links.unionByName(verified(rest.select("unit", "to"), reps, alike, bitmaps=False))
        return classes, later_of(links, reps).join(reps.select("unit", "digest"), "unit").select("digest"), reps
    rest = durable(rest)
    links = links.unionByName(verified(rest.where("not crowd").select("unit", "to"), reps, alike))
    crowds = rest.where("crowd").select("unit", F.col("to").alias("crowd")).join(joined.withColumnRenamed("node", "unit"), "unit", "left")
    crowds = crowds.withColumn("component", F.coalesce("component", "unit")).join(reps.select("unit", "n", "tokens"), "unit")
    return classes, durable(links.unionByName(crowd_links(crowds, alike)).distinct()), reps


def later_of(links: DataFrame, places: DataFrame) -> DataFrame:
    """(unit): of each pair the one whose place (p1, p2) is later."""
    at = places.select("unit", F.struct("p1", "p2").alias("pos"))
    pairs = links.select("unit", "to").join(at, "unit").join(at.toDF("to", "pos2"), "to")
    return pairs.select(F.when(F.col("pos") > F.col("pos2"), F.col("unit")).otherwise(F.col("to")).alias("unit")).distinct()


def similar_units(heads: DataFrame, alike=ALIKE, count_links=True) -> DataFrame:
    """A table of HEAD -> (p1, n, class_id, component_id, n_links), a row per unit: the least p1 of its set and the least that it
    reaches, and how many other units are alike (null if they aren't counted). A unit without hashes is alone."""
    classes, links, reps = class_links(heads, alike)
    joined = durable(components(links.select(F.col("unit").alias("u"), F.col("to").alias("v"))).withColumnRenamed("node", "rep"))
    linked = classes.join(joined, "rep")
    least = linked.groupBy("component").agg(F.min("p1").alias("component_id"))
    linked = linked.join(least, "component").select("rep", "component_id")
    if count_links:
        members = reps.select("unit", "n", "tokens").join(classes.select(F.col("rep").alias("unit"), "size"), "unit").join(joined.withColumnRenamed("rep", "unit"), "unit")
        linked = linked.join(link_counts(members, alike).withColumnRenamed("unit", "rep"), "rep", "left")
    else:
        linked = linked.withColumn("links", F.lit(None).cast("long"))
    classes = classes.join(linked, "rep", "left").select("digest", F.col("p1").alias("class_id"), F.coalesce("component_id", "p1").alias("component_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    # heads, not units, are joined: as many rows of one set as there are groups
    out = heads.select("digest", "n", "members1").join(classes, "digest", "left").select("n", "class_id", "component_id", "n_links", F.explode("members1").alias("p1"))
    some = F.col("n") > 0
    return out.select(
        "p1", "n", F.when(some, F.coalesce("class_id", "p1")).otherwise(F.col("p1")).alias("class_id"), F.when(some, F.coalesce("component_id", "p1")).otherwise(F.col("p1")).alias("component_id"),
        (F.when(some, F.coalesce("n_links", F.lit(0))).otherwise(0) if count_links else F.lit(None)).cast("long").alias("n_links"),
    )


def in_blocks(members: DataFrame, by: str):
    """members (unit, n, and by: which of the sets to be compared with one another it belongs to) grouped for applyInArrow, with
    block, low and high as columns. Many members or long sets are dealt into blocks, and each two blocks are one task's, low and high
    differ if it is to compare across them only; the small are many in one."""
    whole = members.groupBy(by).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("hashes")).where("k > 1")
    blocks = F.greatest(F.ceil(F.col("k") / F.lit(BLOCK // 2)), F.ceil(F.col("hashes") / F.lit(BLOCK_HASHES))).cast("int")
    whole = durable(whole.withColumn("blocks", blocks))
    many = max(shuffle_partitions(members.sparkSession), int(whole.where("blocks = 1").agg(F.sum("hashes")).first()[0] or 0) // TOGETHER)
    rows = members.join(whole.select(by, "blocks"), by).withColumn("block", F.pmod(F.hash("unit"), "blocks"))
    rows = rows.withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one = F.col("blocks") == 1
    rows = rows.withColumn("of", F.when(one, F.pmod(F.xxhash64(by), F.lit(many))).otherwise(F.col(by)))
    rows = rows.withColumn("low", F.when(one, -1).otherwise(F.least("block", "beside"))).withColumn("high", F.when(one, -1).otherwise(F.greatest("block", "beside")))
    return rows.drop("n", "blocks", "beside").groupBy("of", "low", "high")


def _each(rows: pa.Table, by: str):
    """Of a group of in_blocks: the places of its rows for each value of ``by``, the sets of these, and their blocks if only pairs
    across blocks count, else None."""
    key, block, tokens = rows.column(by).to_numpy(), rows.column("block").to_numpy(), rows.column("tokens").combine_chunks()
    across = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    for at in np.split(order, cuts[1:]):
        yield at, [np.frombuffer(tokens[i].as_py(), np.uint64) for i in at.tolist()], block[at] if across else None


def link_counts(members: DataFrame, alike=ALIKE) -> DataFrame:
    """members (unit, n, tokens, size, component) -> (unit, links): the sizes of the other members of its component that are alike,
    summed."""
    schema = pa.schema([("unit", pa.int64()), ("links", pa.int64())])

    def count(rows: pa.Table) -> pa.Table:
        unit, size = (rows.column(c).to_numpy() for c in ("unit", "size"))
        units, links = [], []
        for at, sets, block in _each(rows, "component"):
            units.append(unit[at])
            links.append(_linked(sets, size[at].astype(np.int64), block, alike))
        trim()
        return pa.table([pa.array(np.concatenate(units)), pa.array(np.concatenate(links))], schema=schema)

    counted = in_blocks(members.select("unit", "n", "tokens", "size", "component"), "component").applyInArrow(count, "unit long, links long")
    return counted.groupBy("unit").agg(F.sum("links").alias("links"))


def crowd_links(members: DataFrame, alike=ALIKE) -> DataFrame:
    """members (unit, n, tokens, component, crowd) -> (unit, to, common): of each crowd, pairs that are alike and connect whatever
    components such pairs of it connect; fewer of a task than it has members."""
    schema = pa.schema([("unit", pa.int64()), ("to", pa.int64()), ("common", pa.int32())])

    def join(rows: pa.Table) -> pa.Table:
        unit, component = (rows.column(c).to_numpy() for c in ("unit", "component"))
        found = [(unit[at], *_joins(sets, component[at], block, alike)) for at, sets, block in _each(rows, "crowd")]
        x, y, common = (np.concatenate(c) for c in zip(*((u[i], u[j], n) for u, i, j, n in found), strict=True))
        trim()
        return pa.table([pa.array(c, f.type) for c, f in zip((np.maximum(x, y), np.minimum(x, y), common), schema, strict=True)], schema=schema)

    return in_blocks(members.select("unit", "n", "tokens", "component", "crowd"), "crowd").applyInArrow(join, "unit long, to long, common int")


def _linked(sets: list[np.ndarray], size: np.ndarray, block: np.ndarray | None, alike=ALIKE) -> np.ndarray:
    """Per set the sizes of the others that are alike, summed; of those of other blocks only, if blocks are given."""
    n = np.array([len(x) for x in sets])
    if len(sets) == 2:
        both = alike_sets(len(np.intersect1d(*sets, assume_unique=True)), n[0], n[1], alike) and (block is None or block[0] != block[1])
        return size[::-1] * int(both)
    out = np.zeros(len(sets), np.int64)
    for x, common in enumerate(_common(sets)):
        linked = alike_sets(common, n[x], n, alike)
        linked[x] = False
        if block is not None:
            linked &= block != block[x]
        out[x] = size[linked].sum()
    return out


def _joins(sets: list[np.ndarray], component: np.ndarray, block: np.ndarray | None, alike=ALIKE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places whose sets are alike, and the common counts: of all such pairs, or those of different blocks if blocks are given, so
    many that they connect the same components; no more than there are components."""
    n, label = np.array([len(x) for x in sets]), np.unique(component, return_inverse=True)[1]
    out = [np.empty((3, 0), np.int64)]
    for x, common in enumerate(_common(sets)):
        linked = alike_sets(common, n[x], n, alike) & (label != label[x])
        if block is not None:
            linked &= block != block[x]
        at = np.flatnonzero(linked)
        if len(at):
            at = at[np.unique(label[at], return_index=True)[1]]
            out.append(np.stack([np.full(len(at), x), at, common[at]]))
            label[np.isin(label, label[at])] = label[x]
            if (label == label[x]).all():
                break
    return tuple(np.concatenate(out, 1))


def _common(sets: list[np.ndarray]):
    """For each set in turn: how many hashes it has in common with every one. Hashes that few sets have are counted off their lists
    of sets, those that many have as bits."""
    n, k = np.array([len(x) for x in sets]), len(sets)
    of, h = np.repeat(np.arange(k), n), np.concatenate(sets)
    order = np.argsort(h, kind="stable")
    h, of = h[order], of[order]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    length = np.diff(np.append(starts, len(h)))
    length_of = np.repeat(length, length)
    bits = np.zeros((k, 1), np.uint64)
    many = length_of > max(8, k // 16)
    if many.any():
        column = np.unique(np.repeat(np.arange(len(length)), length)[many], return_inverse=True)[1]
        bits = np.zeros((k, int(column.max()) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (of[many], column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    few = np.flatnonzero((length_of > 1) & ~many)
    by_set = few[np.argsort(of[few], kind="stable")]
    begin, own = np.repeat(starts, length)[by_set], length_of[by_set]
    edges = np.searchsorted(of[by_set], np.arange(k + 1))
    for x in range(k):
        common = np.bitwise_count(bits & bits[x]).sum(1, dtype=np.int64)
        a, b = edges[x], edges[x + 1]
        if b > a:
            runs = own[a:b]
            at = np.arange(int(runs.sum())) + np.repeat(begin[a:b] - np.append(0, np.cumsum(runs)[:-1]), runs)
            common += np.bincount(of[at], minlength=k)
        yield common


def _tiles(reps: DataFrame, alike, banded=True) -> DataFrame:
    """(token, at, unit, n, band, p1, place): the unit in the tile of a prefix shingle and of its own band or the next, or of the
    shingle alone, at -1."""
    schema = pa.schema([("token", pa.int64()), ("at", pa.int32()), ("unit", pa.int64()), ("n", pa.int32()), ("band", pa.int32()), ("p1", pa.int64()), ("place", pa.int32())])

    def dealt(batches):
        for batch in batches:
            parts = []
            for u, n, prefix, places, p1 in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                h, place, band = np.frombuffer(prefix, np.int64), np.frombuffer(places, np.int32), band_of(n, alike)
                parts += [(h, *(np.full(len(h), x) for x in (at, u, n, band, p1)), place) for at in ((band, band + 1) if banded else (-1,))]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(zip(*parts, strict=True), schema, strict=True)], schema=schema)
        trim()

    return reps.mapInArrow(dealt, "token long, at int, unit long, n int, band int, p1 long, place int")


def _crowds(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of units, each once -> those to be looked at one by one, and the members of crowds with the least member of each: what
    the pairs connect is a crowd if there are more than CROWDED pairs for each member."""
    units, ends = np.unique(pairs, return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    root, before = np.arange(len(units)), None
    while before is None or (root != before).any():
        before = root.copy()
        least = np.minimum(root[u], root[v])
        np.minimum.at(root, before[u], least)
        np.minimum.at(root, before[v], least)
        root = root[root]
    crowded = np.bincount(root[u], minlength=len(units)) > CROWDED * np.bincount(root, minlength=len(units))
    member = crowded[root]
    return pairs[~member[u]], units[member], units[root[member]]


def _compare(alike, crowds=False):
    """Of two blocks of a tile, or of many small tiles: the pairs of different components, the later one without an earlier
    match so far, that the bounds let be alike. With ``crowds``, those of crowds aren't written down; each member is, with the least one.

    A pair of one band is compared in the tile of that band, one of two in that of the greater. What comes of several tiles
    is made one afterwards, so a row carries nothing of its set but its bitmap.
    """
    schema = pa.schema([("unit", pa.int64()), ("to", pa.int64()), ("crowd", pa.bool_())])

    def compare(rows: pa.Table) -> pa.Table:
        small = rows.column("of_at")[0].as_py() == -2
        one = small or rows.column("low")[0].as_py() == rows.column("high")[0].as_py()
        token, at = rows.column("token").to_numpy(), rows.column("at").to_numpy()
        order = np.lexsort((at, token)) if small else np.arange(len(rows))
        token, at = token[order], at[order]
        unit, n, band, place, component, block = (rows.column(c).to_numpy()[order] for c in ("unit", "n", "band", "place", "component", "block"))
        p1, p2, gone = (rows.column(c).to_numpy()[order] for c in ("p1", "p2", "gone"))
        n, place = n.astype(np.int64), place.astype(np.int64)
        marks = rows.column("mark").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, MARK)[order]
        found = [np.empty((0, 2), np.int64)]

        def bounded(x, y):
            """The pairs that sizes, places and bitmaps don't rule out."""
            keep = (component[x] != component[y]) & ((at[x] == -1) | (np.maximum(band[x], band[y]) == at[x]))
            keep &= alike[0] * np.maximum(n[x], n[y]) <= alike[1] * np.minimum(n[x], n[y])
            keep &= alike_sets(most_common(place[x], n[x], place[y], n[y], np.minimum), n[x], n[y], alike)
            keep &= True if one else block[x] != block[y]
            keep &= ~gone[np.where((p1[x] > p1[y]) | ((p1[x] == p1[y]) & (p2[x] > p2[y])), x, y)]
            x, y = x[keep], y[keep]
            only = lambda p, q: np.bitwise_count(marks[p] & ~marks[q]).sum(1, dtype=np.int64)
            keep = alike_sets(np.minimum(n[x] - only(x, y), n[y] - only(y, x)), n[x], n[y], alike)
            x, y = unit[x[keep]], unit[y[keep]]
            found.append(np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1), axis=0))

        if small:
            for step in range(1, len(unit)):
                x = np.flatnonzero((token[step:] == token[:-step]) & (at[step:] == at[:-step]))
                if not len(x):
                    break
                for k in range(0, len(x), AT_ONCE):
                    bounded(x[k : k + AT_ONCE], x[k : k + AT_ONCE] + step)
        else:
            step = max(1, AT_ONCE // len(unit))
            for a in range(0, len(unit), step):
                x, y = np.nonzero(np.arange(len(unit)) > np.arange(a, min(a + step, len(unit)))[:, None])
                bounded(x + a, y)
        pairs = np.unique(np.concatenate(found), axis=0)
        members = least = np.empty(0, np.int64)
        if crowds and len(pairs):
            pairs, members, least = _crowds(pairs)
        trim()
        return pa.table([pa.array(np.append(pairs[:, 0], members)), pa.array(np.append(pairs[:, 1], least)), pa.array(np.repeat([False, True], [len(pairs), len(members)]))], schema=schema)

    return compare


def verified(pairs: DataFrame, reps: DataFrame, alike=ALIKE, bitmaps=True) -> DataFrame:
    """The pairs (unit, to) that are alike, with their common count: bitmaps first if asked, then sorted arrays."""
    schema = pa.schema([("unit", pa.int64()), ("to", pa.int64()), ("common", pa.int32())])
    light = reps.select("unit", "n", "bits")
    bounded = pairs.join(light, "unit").join(light.toDF("to", "m", "other"), "to").select("unit", "to", "n", "m", "bits", "other")

    def bound(batches):
        for batch in batches:
            u, v, n, m, a, b = (batch.column(i).to_pylist() for i in range(6))
            keep = [alike_sets(overlap_bound(*x), x[1], x[3], alike) for x in zip(a, n, b, m, strict=True)]
            kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["unit", "to"]).filter(pa.array(keep, pa.bool_()))
            yield kept

    def exact(batches):
        for batch in batches:
            u, v, a, b = (batch.column(i).to_pylist() for i in range(4))
            rows = []
            for x, y, p, q in zip(u, v, a, b, strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                if alike_sets(common, len(p), len(q), alike):
                    rows.append((x, y, common))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        trim()

    possible = bounded.mapInArrow(bound, "unit long, to long") if bitmaps else pairs.select("unit", "to")
    sets = reps.select("unit", "tokens")
    both = possible.join(sets, "unit").join(sets.toDF("to", "others"), "to").select("unit", "to", "tokens", "others")
    return both.mapInArrow(exact, "unit long, to long, common int")


def similar_documents(docs: DataFrame, width=SHINGLE, alike=ALIKE, id_col="doc_id", text_col="text", count_links=True) -> DataFrame:
    """Per row: doc_id, n_shingles, class_id (least doc_id of an equal set), component_id (least doc_id reachable by
    links, itself included), n_links (other rows whose sets are alike, those of equal sets among them; null if not counted).

    Null and empty texts have no shingles and are their own class and component, without links. Rows that repeat a doc_id are
    each for itself, and null doc_ids come last. Ids are integers. Counting compares each two sets of a component: its cost is the square of the
    different texts of a family.
    """
    plan = Plan(docs, id_col, text_col)
    counter, key_of = plan.counter(), plan.key_of()

    def keys(docs: pa.Table):
        w = words_of(docs.column("text"), lower=True)
        return occurrences(w, w.ends, key_of, width)

    def sign(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return HEADS.empty_table()
        docs = docs.take(pa.compute.sort_indices(docs.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")]))
        w = words_of(docs.column("text"), lower=True)
        sets = shingle_sets(w.hashes, w.ends, width)
        n, digest, tokens, counts = (list(x) for x in zip(*signatures(sets, counter(answers)(sets.hashes), alike), strict=True))
        ids = docs.column("doc_id").to_numpy()
        own, columns = heads_of(docs.column("g")[0].as_py(), np.array([np.frombuffer(x, np.uint64) for x in digest]).reshape(-1, 2), ids, np.zeros(len(ids), np.int64))
        columns += [[x[i] for i in own.tolist()] for x in (n, digest, tokens, counts)]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, HEADS, strict=True)], schema=HEADS)

    heads = written(plan.with_answers(plan.shared(keys), sign, HEAD))
    back = lambda c: F.when(F.col(c) != MAX_ID, F.col(c)).alias("doc_id" if c == "p1" else c)
    return similar_units(heads, alike, count_links).select(back("p1"), F.col("n").cast("long").alias("n_shingles"), back("class_id"), back("component_id"), "n_links")


def keep_one(docs: DataFrame, width=SHINGLE, alike=ALIKE, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents, all columns kept, of which each group of similar ones keeps the one of least doc_id (null counts as
    the greatest). Documents without words are no group and stay; of rows that repeat a doc_id all stay if one of them does."""
    found = similar_documents(docs, width, alike, id_col, text_col, count_links=False)
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).where("not stays")
    mark = unused(docs, "_gone")
    return docs.join(gone.select(F.col("doc_id").alias(mark)), F.col(id_col).eqNullSafe(F.col(mark)), "left_anti")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
