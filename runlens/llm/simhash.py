"""SimHash near-duplicates: fingerprints, a binary trie self-join over them, and their components.

The join walks the binary trie of the fingerprints against itself. A pair of nodes carries the bits in which
their paths differ and is dropped when these exceed the budget. Two fingerprints with at most `budget`
differing bits agree on at least `blocks - budget` of `blocks` bit blocks. For each choice of so many blocks
there is a trie with these bits on top, where the budget is spent on nothing, so the subtrees below
them are independent: Spark deals the subtrees out, and a task walks its own.

A subtree holds distinct fingerprints only, 8 bytes each, so thousands of exact copies are one leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable, pure, rows, schema_with
from runlens.llm.components import connected_components

BITS, SEED = 64, 42

#: Node pairs that a task walks at a time.
FRONTIER = 1 << 20


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, size = (ends - lengths).tolist(), min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())), np.uint64, len(words) - size + 1)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Signed 64-bit SimHash; 0 without words."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at:at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1), axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fingerprint) per row. A null or blank text has fingerprint 0."""
    own = pure(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(text, shingle) for _, text in rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], ["id", "fingerprint"])

    return own.mapInArrow(run, schema_with(own, "fingerprint long"))


def block_masks(blocks: int, budget: int) -> list[tuple[int, list[int]]]:
    """Per trie: the mask of its top bits, and the other bits from high to low."""
    if blocks <= budget:
        raise ValueError("more blocks than bits of the budget are needed")
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - budget):
        top = {b for k in chosen for b in range(cuts[k], cuts[k + 1])}
        out.append((sum(1 << b for b in top), [b for b in reversed(range(BITS)) if b not in top]))
    return out


def walk(codes: np.ndarray, subtree: np.ndarray, depth: int, budget: int, frontier: int = FRONTIER) -> np.ndarray:
    """Component (as the index of a member) of every leaf, by walking pairs of trie nodes.

    `codes`: the lower trie bits, `depth` of them, sorted within `subtree`; subtrees are contiguous. A node is a
    range of leaves. Pairs go down bit by bit, depth first in slabs, so memory is bounded. A pair of
    nodes whose leaves are all known to be in one component can add nothing and is dropped as well.
    """
    n = len(codes)
    component = np.arange(n)
    firsts = np.flatnonzero(np.r_[True, subtree[1:] != subtree[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[firsts[1:], n]
    big = ends - firsts > 1
    start = np.stack([firsts[big], ends[big], firsts[big], ends[big], np.zeros(big.sum(), np.int64)])
    ones = {}
    stack = [(depth, start)]
    changes = None
    while stack:
        level, nodes = stack.pop()
        if nodes.shape[1] > frontier:
            half = nodes.shape[1] // 2
            stack += [(level, nodes[:, half:]), (level, nodes[:, :half])]
            continue
        if changes is not None:  # drop what lies in one component already
            a0, a1, b0, b1, _ = nodes
            same = (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (component[a0] == component[b0])
            nodes = nodes[:, ~same]
        a0, a1, b0, b1, spent = nodes
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any() or level == 0:
            done = leaf if level else np.ones_like(leaf)
            x, y = a0[done], b0[done]
            near = np.bitwise_count(codes[x] ^ codes[y]) <= budget
            if near.any():
                _unite(component, x[near], y[near])
                changes = np.cumsum(np.r_[0, component[1:] != component[:-1]])
            nodes = nodes[:, ~done]
        if not nodes.shape[1]:
            continue
        if level - 1 not in ones:
            ones[level - 1] = np.r_[0, np.cumsum((codes >> np.uint64(level - 1)) & np.uint64(1)).astype(np.int64)]
        stack.append((level - 1, _children(nodes, ones[level - 1], budget)))
    return component


def _children(nodes: np.ndarray, ones: np.ndarray, budget: int) -> np.ndarray:
    a0, a1, b0, b1, spent = nodes
    am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where the next bit turns to 1
    self_pair = a0 == b0
    out = np.concatenate([
        np.stack([a0, am, b0, bm, spent]),
        np.stack([am, a1, bm, b1, spent]),
        np.stack([a0, am, bm, b1, spent + 1]),
        np.stack([am, a1, b0, bm, spent + 1])[:, ~self_pair],
    ], axis=1)
    x0, x1, y0, y1, cost = out
    alone = (x0 == y0) & (x1 - x0 == 1)
    return out[:, (x1 > x0) & (y1 > y0) & (cost <= budget) & ~alone]


def _unite(component: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Merge the components of linked leaves; each is named by its smallest leaf."""
    while True:
        cx, cy = component[x], component[y]
        if (cx == cy).all():
            return
        low, high = np.minimum(cx, cy), np.maximum(cx, cy)
        np.minimum.at(component, high, low)
        while (component[component] != component).any():
            component[:] = component[component]


def _gathered(codes: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of every code, from high to low, as one number."""
    out = np.zeros_like(codes)
    for b in bits:
        out = (out << np.uint64(1)) | ((codes >> np.uint64(b)) & np.uint64(1))
    return out


def links(codes: DataFrame, budget: int = 4, blocks: int = 6, code_col: str = "fingerprint") -> DataFrame:
    """(a, b): links that connect all fingerprints of at most `budget` differing bits, never all pairs.

    More blocks make smaller subtrees and more of them: 6 give 15 tries with subtrees of N / 2**21 codes, 7
    give 35 with N / 2**27. A subtree of near copies adds what lies within a few bits of its centre.
    """
    masks = block_masks(blocks, budget)
    signed = [m - (1 << 64) if m >> 63 else m for m, _ in masks]
    tops = F.array(*[F.struct(F.lit(k).alias("trie"), F.col("code").bitwiseAND(F.lit(m)).alias("top"))
                     for k, m in enumerate(signed)])
    spread = (
        codes.select(F.col(code_col).alias("code")).distinct()
        .select("code", F.explode(tops).alias("t")).select("t.trie", "t.top", "code")
        .repartition("trie", "top").sortWithinPartitions("trie", "top")
    )

    def solve(trie: np.ndarray, top: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        for k in np.unique(trie):
            mine = np.flatnonzero(trie == k)
            low = _gathered(code[mine].view(np.uint64), masks[k][1])
            order = np.lexsort((low, top[mine]))
            mine, low = mine[order], low[order]
            component = walk(low, top[mine], len(masks[k][1]), budget)
            linked = np.flatnonzero(component != np.arange(len(low)))
            a.append(code[mine][linked])
            b.append(code[mine][component[linked]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            trie, top, code = (np.asarray(c) for c in batch.columns)
            other = (trie != trie[-1]) | (top != top[-1])
            last = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if last:  # every subtree before the last one is complete
                parts = [np.concatenate([*(h[k] for h in held), x[:last]]) for k, x in enumerate((trie, top, code))]
                yield solve(*parts)
                held = []
            held.append([trie[last:].copy(), top[last:].copy(), code[last:].copy()])
        if held:
            yield solve(*(np.concatenate([h[k] for h in held]) for k in range(3)))

    return spread.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4, blocks: int = 6
) -> DataFrame:
    """(id, fingerprint, component_id) per row of `docs`.

    Rows are linked when their fingerprints differ in at most `budget` bits; the component is the smallest
    id reachable. Null and blank texts share fingerprint 0 and are linked like others. A row without an id
    keeps its row and its group's component, which is null only if no member has an id. Repeated rows and
    ids give repeated rows. Other columns are ignored. An empty table gives an empty one.
    """
    marked = durable(fingerprints(docs, id_col, text_col, shingle))
    groups = connected_components(durable(links(marked, budget, blocks)))
    least = marked.groupBy("fingerprint").agg(F.min("id").alias("least"))
    joined = least.join(groups, F.col("node") == F.col("fingerprint"), "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_code = joined.join(named, "root").select("fingerprint", "component_id")
    return marked.join(of_code, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")
