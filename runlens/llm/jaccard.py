"""Near copies by the Jaccard similarity of their word shingles: SimHash fingerprints find them, the texts decide.

Texts with equal sets of shingles are one node. Fingerprints of the sets are linked by the binary trie self-join of `simhash`,
and a component of linked fingerprints is a key. Four bits are a similarity of about 0.96, so 30 keys of 6 minima each come
beside it for pairs further apart: two sets of similarity 0.8 share one of those with a probability of 0.9999. What
shares a key is compared:

1. every member of a key with the member of the smallest id, which copies are often made from; links form components;
2. in keys that still hold several components, each member outside of the largest one with its likeliest partners elsewhere;
3. where several components are left, each member outside of the largest one with all members of others, within a task.

So a group of copies costs about one comparison a member, and no step lists its pairs. Keys are cut into tiles of
a block of members by a block of members. A sketch of a byte for each minimum rules most pairs out before texts are
brought together; what is linked was checked on the sets themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable, durable_table, pure, rows, schema_with
from runlens.llm.components import connected_components
from runlens.llm.simhash import fingerprint_of, shingle_hashes
from runlens.llm.simhash import links as trie_links

SHINGLE, LEAST, BANDS, DEPTH = 5, 0.8, 30, 6

#: Differing bits at which two fingerprints are linked.
BUDGET = 4

#: A pair is ruled out when its sketches agree in a share this much below the similarity asked (5 standard deviations at 0.8).
SLACK = 0.15

#: Shingles that are hashed at a time.
CHUNK = 1 << 12

#: Partners of a member in step 2, per tile.
TRIES = 1

#: Members on either side of a tile.
BLOCK = 1000

_SET = "set binary, n long, fingerprint long, keys array<long>, sketch binary"


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def name_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def factors(n: int) -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


def minima(hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each of the multipliers."""
    out = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(out, (by[:, None] * hashes[None, at:at + CHUNK]).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray, depth: int) -> list[int]:
    signed = [xxhash.xxh64_intdigest(least[k:k + depth].tobytes(), k) for k in range(0, len(least), depth)]
    return [x - (1 << 64) if x >> 63 else x for x in signed]


def sketch(least: np.ndarray) -> bytes:
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _marked(own: DataFrame, shingle: int, bands: int, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = factors(bands * depth)
        for batch in batches:
            out = []
            for _, text, _ in rows(batch):
                hashes = shingle_set(text, shingle)
                least = minima(hashes, by)
                keys = band_keys(least, depth) if len(hashes) else []
                out.append((name_of(hashes), len(hashes), fingerprint_of(hashes), keys, sketch(least)))
            types = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array(list(x), t) for x, t in zip(columns, types)]],
                ["id", "code", "set", "n", "fingerprint", "keys", "sketch"])

    return own.mapInArrow(run, schema_with(own, "code long, " + _SET))


def _keyed(marked: DataFrame, budget: int) -> DataFrame:
    """One row per set, with the component of its fingerprint as the first of its keys; a set without words has none."""
    sets = marked.drop("id").dropDuplicates(["set"])
    groups = connected_components(durable_table(trie_links(marked.where("n > 0"), budget)))
    of_code = groups.select(F.col("node").alias("fingerprint"), "component")
    group = F.coalesce("component", "fingerprint")
    keys = F.when(F.col("n") > 0, F.concat(F.array(group), "keys")).otherwise(F.col("keys"))
    return sets.join(of_code, "fingerprint", "left").select("code", "set", "n", keys.alias("keys"), "sketch")


def _members(sets: DataFrame) -> DataFrame:
    """(key, sid): members of the keys that several sets share. Rows stream through, a key is never held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shared = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            key, sid = (np.asarray(c) for c in batch.columns)
            if last is not None:
                key, sid = np.r_[last[0], key], np.r_[last[1], sid]
            equal = key[1:] == key[:-1]
            known = np.r_[shared, equal] | np.r_[equal, False]  # the last row waits for the next batch
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][known[:-1]]), pa.array(sid[:-1][known[:-1]])], ["key", "sid"])
            last, shared = (key[-1], sid[-1]), bool(known[-1])
        if last is not None and shared:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]])], ["key", "sid"])

    spread = sets.select(F.explode("keys").alias("key"), "sid").repartition("key")
    return spread.sortWithinPartitions("key").mapInArrow(run, "key long, sid long")


def _agreement(x: bytes, y: bytes) -> float:
    return float(np.mean(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)))


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sizes and sketches allow the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [_agreement(x, y) >= least - SLACK for _, _, x, y in rows(batch)]
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x"))
    right = sets.select(F.col("sid").alias("b"), "n", F.col("sketch").alias("y"))
    both = pairs.join(left, "a").join(right, "b").where(F.least("m", "n") >= least * F.greatest("m", "n"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _tiles(members: DataFrame, sets: DataFrame, part: DataFrame, block: int) -> DataFrame:
    """(key, cross, i, j, own, sid, n, part, few, keys, sketch): members of the keys that hold several components, by tile.

    Members outside of a key's largest component (`few`) are cut into blocks, the others too. Tiles are blocks of few by
    blocks of the others (`cross`), and blocks of few by blocks of few. `own` is a member's block.
    """
    placed = members.join(part.withColumnRenamed("node", "sid"), "sid", "left").select(
        "key", "sid", F.coalesce("component", "sid").alias("part"))
    of_part = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"))
    keys = of_part.groupBy("key").agg(
        F.max_by("part", F.struct("size", "part")).alias("most"), F.max("size").alias("size"), F.sum("size").alias("all"))
    keys = keys.where("size < all").select(
        "key", "most", F.ceil(F.col("size") / block).alias("others"), F.ceil((F.col("all") - F.col("size")) / block).alias("fews"))
    few = F.col("part") != F.col("most")
    joined = placed.join(keys, "key").select(
        "*", few.alias("few"), F.pmod(F.xxhash64("sid"), F.when(few, F.col("fews")).otherwise(F.col("others"))).alias("own"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    tile = lambda cross, i, j: F.struct(F.lit(cross).alias("cross"), i.alias("i"), j.alias("j"))
    own = F.col("own")
    of_few = F.concat(F.transform(upto("others"), lambda k: tile(True, own, k)),
                      F.transform(upto("fews"), lambda k: tile(False, F.least(own, k), F.greatest(own, k))))
    of_other = F.transform(upto("fews"), lambda k: tile(True, k, own))
    spread = joined.select("key", "sid", "part", "few", "own", F.explode(F.when(few, of_few).otherwise(of_other)).alias("t"))
    return spread.join(sets.select("sid", "n", "keys", "sketch"), "sid").select(
        "key", "t.cross", "t.i", "t.j", "own", "sid", "n", "part", "few", "keys", "sketch")


_TILE = ["key", "cross", "i", "j"]


def _by_tile(df: DataFrame, solve, schema: str) -> DataFrame:
    """`solve` for the rows of every tile, which come as tuples in the order of the columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in rows(batch):
                if held and held[-1][:4] != row[:4]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return df.repartition(*_TILE).sortWithinPartitions(*_TILE).mapInArrow(run, schema)


def _allowed(parts: np.ndarray, few: np.ndarray, own: np.ndarray, tile: tuple, k: int) -> np.ndarray:
    """Members of the tile that member k is to be compared with."""
    fits = parts != parts[k]
    if tile[1]:
        return fits & ~few
    return fits & (own != own[k]) if tile[2] != tile[3] else fits


def _candidates(held: list[tuple], least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each member outside: the members, likeliest first, that sizes and sketches allow and that share no earlier key."""
    own, sids, sizes, parts, few = (np.array([x[k] for x in held]) for k in range(4, 9))
    keys = np.array([x[9] for x in held])
    sketches = np.frombuffer(b"".join(x[10] for x in held), np.uint8).reshape(len(held), -1)
    for k in np.flatnonzero(few):
        fits = _allowed(parts, few, own, held[0], k) & (np.minimum(sizes, sizes[k]) >= least * np.maximum(sizes, sizes[k]))
        other = np.flatnonzero(fits)
        share = np.concatenate([np.zeros(0), *(
            (sketches[other[at:at + CHUNK]] == sketches[k]).mean(axis=1) for at in range(0, len(other), CHUNK))])
        near, share = other[share >= least - SLACK], share[share >= least - SLACK]
        first = keys[k][(keys[near] == keys[k]).argmax(axis=1)] == held[0][0] if len(near) else np.zeros(0, bool)
        yield k, near[first][np.lexsort((sids[near[first]], -share[first]))]


def _likeliest(tiles: DataFrame, least: float, tries: int) -> DataFrame:
    """(a, b): for each member outside of its key's largest component the `tries` likeliest partners of every tile."""
    def solve(held: list[tuple]) -> pa.RecordBatch:
        found = [(held[k][5], held[m][5]) for k, near in _candidates(held, least) for m in near[:tries]]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])

    return _by_tile(tiles, solve, "a long, b long").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _within(tiles: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(a, b): links that connect what is as similar as asked within each tile. Texts come for members of possible pairs only."""
    def named(held: list[tuple]) -> pa.RecordBatch:
        some = sorted({int(m) for k, near in _candidates(held, least) for m in [k, *near] if len(near)})
        out = [[held[m][c] for m in some] for c in (0, 1, 2, 3, 4, 5, 7, 8)]
        types = (pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [*_TILE, "own", "sid", "part", "few"])

    def solve(held: list[tuple]) -> pa.RecordBatch:
        own, sids, parts, few = (np.array([x[k] for x in held]) for k in range(4, 8))
        sets = [shingle_set(x[8], shingle) for x in held]
        sizes = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(held)), sizes)[order]
        joined = np.unique(parts, return_inverse=True)[1]
        a, b = [], []
        for k in np.flatnonzero(few):
            low, high = (np.searchsorted(every, sets[k], side) for side in ("left", "right"))
            places = np.repeat(high - np.cumsum(high - low), high - low) + np.arange((high - low).sum())
            both = np.bincount(owner[places], minlength=len(held))
            near = _allowed(parts, few, own, held[0], k) & (both >= least * (sizes + sizes[k] - both))
            for m in np.flatnonzero(near):
                if joined[m] != joined[k]:
                    joined[joined == joined[m]] = joined[k]
                    a.append(sids[k])
                    b.append(sids[m])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], ["a", "b"])

    needed = _by_tile(tiles, named, "key long, cross boolean, i long, j long, own long, sid long, part long, few boolean")
    return _by_tile(durable_table(needed).join(texts, "sid").select(*_TILE, "own", "sid", "part", "few", "text"), solve, "a long, b long")


def _texts(members: DataFrame, sets: DataFrame, own: DataFrame, shingle: int) -> DataFrame:
    """(sid, text): a text of every set that shares a key."""
    needed = members.select("sid").distinct().join(sets.select("sid", "set", "code"), "sid")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [name_of(shingle_set(text, shingle)) == name for _, name, text in rows(batch)]
            yield batch.filter(pa.array(fits, pa.bool_())).select(["sid", "text"])  # else another text with the same code

    one = own.select("code", "text").dropDuplicates(["code", "text"])
    found = one.join(needed, "code").select("sid", "set", "text").mapInArrow(same, "sid long, text string")
    return found.dropDuplicates(["sid"])


def _linked(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs whose sets are as similar as asked."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, held = None, None
        for batch in batches:
            near = []
            for _, b, x, y in rows(batch):
                if b != sid:
                    sid, held = b, shingle_set(y, shingle)
                near.append(similarity(shingle_set(x, shingle), held) >= least)
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    left = texts.select(F.col("sid").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("sid").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST,
    bands: int = BANDS, depth: int = DEPTH, tries: int = TRIES, block: int = BLOCK, budget: int = BUDGET,
) -> DataFrame:
    """(id, component_id) per row of `docs`: the smallest id that a chain of near copies reaches.

    Two texts are near copies when the Jaccard similarity of their sets of `shingle` words is `least` or more. Texts
    without words are copies of each other. A row without an id keeps its row and its group's component, which is
    null only if no member has an id. Other columns are ignored. Of `bands` keys of `depth` minima and fingerprints of at most
    `budget` differing bits, each finds pairs; what is linked was checked on the sets.
    """
    own = pure(docs, id=id_col, text=text_col).withColumn("code", F.xxhash64("text"))
    marked = durable_table(_marked(own, shingle, bands, depth))
    sets = durable_table(_keyed(marked, budget).withColumn("sid", F.monotonically_increasing_id()))
    names = durable_table(marked.groupBy("set").agg(F.min("id").alias("least")).join(sets.select("set", "sid"), "set"))
    members = durable_table(_members(sets))
    texts = durable_table(_texts(members, sets, own, shingle))
    first = members.join(names.select("sid", "least"), "sid").groupBy("key").agg(
        F.min(F.struct("least", "sid")).getField("sid").alias("first"))
    hubs = members.join(first, "key").where("sid <> first").select(
        F.least("sid", "first").alias("a"), F.greatest("sid", "first").alias("b")).distinct()
    tested = durable_table(_alike(hubs, sets, least))
    links = durable_table(_linked(tested, texts, shingle, least))
    part = durable(connected_components(links))
    likely = durable_table(_likeliest(_tiles(members, sets, part, block), least, tries).join(tested, ["a", "b"], "left_anti"))
    if not likely.isEmpty():
        links = links.unionAll(durable_table(_linked(likely, texts, shingle, least)))
        part = durable(connected_components(links))
    rest = durable_table(_within(_tiles(members, sets, part, block), texts, shingle, least))
    if not rest.isEmpty():
        part = durable(connected_components(links.unionAll(rest)))
    rooted = names.join(part.withColumnRenamed("node", "sid"), "sid", "left").select(
        "set", "least", F.coalesce("component", "sid").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = rooted.join(named, "root").select("set", "component_id")
    return marked.select("id", "set").join(of_set, "set").select(F.col("id").alias(id_col), "component_id")
