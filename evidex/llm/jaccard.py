"""N-gram Jaccard join: prefix candidates, then a trie of globally ordered shingle sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm.common import CHUNK, components, ends, grouped, mix, release, segments, tidy, words
from evidex.operators.scale import settled, split_join

SHINGLE = 5
#: Two sets link when SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (3, 4)
#: Documents and shingles of one side of a trie; larger blocks meet their leader first and are split.
BLOCK_DOCS, BLOCK_SHINGLES = 2000, 250_000
#: Ids that are broadcast at most.
BROADCAST_ROWS = 1_000_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _sets_of(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    count = len(at) - 1
    if len(hashes) >= SHINGLE:
        grams = np.zeros(len(hashes) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            grams += hashes[k:len(grams) + k] * _FACTORS[k]
        grams = mix(grams)
    out = []
    for k in range(count):
        a, b = int(at[k]), int(at[k + 1])
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a:b - SHINGLE + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * _FACTORS[:b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles of five words, A-Z lowered.

    A text of fewer words has its whole sequence as its one shingle; one without words or a
    null has none.
    """
    for _, held in grouped(texts):
        hashes, at = [], [0]
        for text in held if max(map(len, held)) > CHUNK else ():
            for part in segments(text):
                hashes.append(words([part], fold=True)[0])
            at.append(sum(map(len, hashes)))
        if hashes:
            yield from _sets_of(np.concatenate(hashes), np.array(at))
        else:
            yield from _sets_of(*words(held, fold=True))


def needed(n):
    """Least number of shared shingles of a set of size ``n`` with any set it links to."""
    return -(-SHARE[0] * n // SHARE[1])


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, t, n_shingles, sig, sig2) of (doc_id, t, text): equal sets have equal signatures; an empty set has none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two = [], [], []
            for s in shingle_sets(batch.column(2).to_pylist()):
                size.append(len(s))
                one.append(int(s.sum().view(np.int64)) if len(s) else None)
                two.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(len(s)))).view(np.int64)) if len(s) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                                  names=["doc_id", "t", "n_shingles", "sig", "sig2"])

    return docs.mapInArrow(tidy(each), "doc_id bigint, t bigint, n_shingles bigint, sig bigint, sig2 bigint")


def _lower(n):
    """Shingles that must be shared within the long prefix, an eighth of the set."""
    return np.maximum(1, n // 8)


def long_prefixes(docs: DataFrame) -> DataFrame:
    """(sig, shingle) of the first n - needed(n) + lower(n) shingles of each set, in the order of the hashes.

    Sets that link share the ``lower(n)`` least shingles that they have in common within these.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sig, parts = [], []
            for s in shingle_sets(texts):
                n = len(s)
                if n:
                    part = s[:n - needed(n) + int(_lower(n))]
                    sig.append(np.full(len(part), s.sum().view(np.int64), np.int64))
                    parts.append(part.view(np.int64))
                if sum(map(len, parts[-64:])) > 1 << 16 or len(parts) >= 512:
                    yield pa.record_batch([pa.array(np.concatenate(sig)), pa.array(np.concatenate(parts))], names=["sig", "shingle"])
                    sig, parts = [], []
            if parts:
                yield pa.record_batch([pa.array(np.concatenate(sig)), pa.array(np.concatenate(parts))], names=["sig", "shingle"])

    return docs.select("text").mapInArrow(tidy(each), "sig bigint, shingle bigint")


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, n, shingles array<bigint>) of (node, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, size = batch.column(0).to_pylist(), [], 0
            first = 0
            for k, s in enumerate(shingle_sets(batch.column(1).to_pylist())):
                sets.append(s.view(np.int64))
                size += len(s)
                if size > 1 << 20 or k + 1 == len(ids):
                    yield pa.record_batch([pa.array(ids[first:k + 1], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                          names=["node", "n", "shingles"])
                    sets, size, first = [], 0, k + 1

    return docs.mapInArrow(tidy(each), "node bigint, n bigint, shingles array<bigint>")


class Trie:
    """Sets as rising sequences of token numbers, sorted, with shared beginnings stored once.

    A node stands for the sequences ``lo`` to ``hi`` and the tokens between its parent's depth
    and its own, which they share.
    """

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        self.order, self.sets = np.array(order), [sets[k] for k in order]
        self.size = np.array([len(s) for s in self.sets])
        m = len(sets)
        shared = np.zeros(m + 1, np.int64)
        for k in range(1, m):
            a, b = self.sets[k - 1], self.sets[k]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared[k] = differ[0] if len(differ) else n
        #: (lo, hi, from, to, least and largest size, children)
        self.nodes: list[tuple[int, int, int, int, int, int, list[int]]] = []
        self.root = self._build(shared)

    def _build(self, shared: np.ndarray) -> int:
        """Nodes from the lengths that neighbours share, with a stack of open ones (lo, depth, children)."""
        stack: list[list] = [[0, 0, []]]
        for k in range(len(self.sets)):
            depth = int(self.size[k])
            stack.append([k, depth, []])
            nxt = int(shared[k + 1])
            while stack[-1][1] > nxt:
                lo, to, children = stack.pop()
                above = stack[-1][1]
                if above < nxt:  # open a node where the next sequence branches off
                    node = self._node(lo, k + 1, nxt, to, children)
                    stack.append([lo, nxt, [node]])
                else:
                    stack[-1][2].append(self._node(lo, k + 1, above, to, children))
        while len(stack) > 1:
            lo, to, children = stack.pop()
            stack[-1][2].append(self._node(lo, len(self.sets), stack[-1][1], to, children))
        return self._node(0, len(self.sets), 0, 0, stack[0][2])

    def _node(self, lo: int, hi: int, start: int, end: int, children: list[int]) -> int:
        sizes = self.size[lo:hi]
        self.nodes.append((lo, hi, start, end, int(sizes.min()), int(sizes.max()), children))
        return len(self.nodes) - 1

    def links(self, probe: np.ndarray, held: np.ndarray, skip) -> Iterator[int]:
        """Sorted places of the sets that link with ``probe`` (``held`` marks its tokens).

        The overlap of a shared beginning is counted once for all sets below it. A subtree is
        left when even its longest remainder, or the probe's, cannot lift the overlap to what
        its smallest set needs, and when ``skip(lo, hi)`` says that nothing there is wanted.
        """
        a, b = SHARE
        n, stack = len(probe), [(self.root, 0)]
        while stack:
            at, overlap = stack.pop()
            lo, hi, start, end, least, most, children = self.nodes[at]
            if skip(lo, hi):
                continue
            if end > start:
                run = self.sets[lo][start:end]
                overlap += int(held[run].sum())
                rest = n - int(np.searchsorted(probe, run[-1], "right"))
                if (a + b) * (overlap + min(rest, most - end)) < a * (n + max(least, -(-a * n // b))):
                    continue
            if least == end:  # sets that end here stand first
                k = lo
                while k < hi and self.size[k] == end:
                    if (a + b) * overlap >= a * (n + end) and not skip(k, k + 1):
                        yield k
                    k += 1
            stack += [(c, overlap) for c in reversed(children)]


def forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the sets of ``left`` with those of ``right`` into the same components as all links do.

    Tokens are numbered by falling frequency in the block, so that sequences share beginnings.
    Subtrees that already belong to the probe's component are left out, so near copies of one
    text cost a pass, not all pairs.
    """
    tokens, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(tokens))
    at = ends(map(len, sets))
    rows = [np.sort(rank[number[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
    trie = Trie([rows[k] for k in right])
    owner = right[trie.order]
    root = np.arange(len(sets))
    held = np.zeros(len(tokens), bool)
    out = []
    for probe in left.tolist():
        mine = rows[probe]
        held[mine] = True
        for k in trie.links(mine, held, lambda lo, hi: bool((root[owner[lo:hi]] == root[probe]).all())):
            other = int(owner[k])
            out.append((probe, other))
            a, b = sorted((root[probe], root[other]))
            root[root == b] = a
        held[mine] = False
    return out


def _block_links(rows: pa.Table) -> pa.Table:
    """Edges of one block or a pair of its parts: the sets marked ``l`` against those marked ``r``."""
    rows = rows.combine_chunks()
    node, left, right = (rows.column(c).to_numpy() for c in ("node", "l", "r"))
    order = np.argsort(node, kind="stable")
    order = order[np.concatenate([[True], np.diff(node[order]) != 0])]
    links: list[tuple[int, int]] = []
    if len(order) > 1 and left[order].any() and right[order].any():
        lists = rows.column("shingles").combine_chunks()
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        links = forest([flat[at[k]:at[k + 1]] for k in order.tolist()], np.flatnonzero(left[order]), np.flatnonzero(right[order]))
        del lists, flat
        if int(at[-1]) > BLOCK_SHINGLES // 4:
            release()
    pairs = node[order][np.array(links, np.int64).reshape(-1, 2)]
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _block_edges(blocks: DataFrame, sets: DataFrame, block_docs: int) -> DataFrame:
    """(a, b): a forest of links of every block (leader, node), sets being (node, n, shingles).

    A block with more than ``block_docs`` sets or BLOCK_SHINGLES shingles meets its leader first. Sets
    that link with it are in its component already, so only the others, in parts of that size,
    meet each other and those, also in parts: near copies of one text cost one comparison each.
    """
    parts = lambda m, w: F.greatest(F.ceil(m / block_docs), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    sizes = blocks.join(sets.select("node", "n"), "node").groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    sizes = settled(sizes.select("leader", parts(F.col("m"), F.col("w")).alias("parts")), "sizes")
    large = sizes.filter("parts > 1").select("leader")
    small = blocks.join(sizes.filter("parts <= 1").select("leader"), "leader").join(sets, "node")
    small = small.select("leader", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("kind"), "node", "shingles", F.lit(True).alias("l"), F.lit(True).alias("r"))

    heads = large.join(sets.select(F.col("node").alias("leader"), F.col("shingles").alias("head")), "leader")
    met = split_join(blocks.join(large, "leader", "left_semi"), heads, "leader", "inner").join(sets, "node")
    overlap = F.size(F.array_intersect("shingles", "head"))
    close = (SHARE[0] + SHARE[1]) * overlap >= SHARE[0] * (F.col("n") + F.size("head"))
    met = settled(met.select("leader", "node", "n", close.alias("close")), "met")
    held = met.groupBy("leader").agg(*[parts(F.count_if(c), F.sum(F.when(c, F.col("n")).otherwise(0))).alias(name)
                                       for name, c in (("far", ~F.col("close")), ("near", F.col("close")))]).filter("far > 0")
    rows = split_join(met, held, "leader", "inner")
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    others = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    spot = lambda x, y, kind, left, right: F.struct(x.alias("x"), y.alias("y"), F.lit(kind).alias("kind"), left.alias("l"), right.alias("r"))
    yes, no = F.lit(True), F.lit(False)
    mine = own("far")
    among = F.transform(others("far"), lambda o: spot(F.least(mine, o), F.greatest(mine, o), 1, mine <= o, mine >= o))
    beside = F.when(F.col("near") > 0, F.transform(others("near"), lambda o: spot(mine, o, 2, yes, no))).otherwise(F.expr("array()").cast(
        "array<struct<x:int,y:int,kind:int,l:boolean,r:boolean>>"))
    given = F.transform(others("far"), lambda o: spot(o, own("near"), 2, no, yes))
    dealt = rows.withColumn("p", F.explode(F.when(F.col("close"), given).otherwise(F.concat(among, beside)))).select("leader", "node", "p.*")
    dealt = dealt.join(sets, "node").select("leader", "x", "y", "kind", "node", "shingles", "l", "r")
    found = small.unionByName(dealt).groupBy("leader", "x", "y", "kind").applyInArrow(_block_links, "a bigint, b bigint")
    return found.unionByName(met.filter("close and leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b"))).distinct()


def classed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS,
            broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, t, n_shingles, component_id) of every row with an id, see ``classes``; t is xxhash64 of the text."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    docs = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    found = settled(members(docs), "members")
    equal = found.filter("sig is not null").groupBy("sig", "sig2", "n_shingles").agg(
        F.min(F.struct("doc_id", "t")).alias("rep"), F.count(F.lit(1)).alias("copies"))
    # Numbers of the classes, fixed by being written; an id may stand for several of them.
    equal = settled(equal.select("sig", "sig2", "n_shingles", F.col("rep.doc_id").alias("rep"), F.col("rep.t").alias("t"), "copies",
                                 F.monotonically_increasing_id().alias("node")), "equal")

    once = (long_prefixes(docs).groupBy("shingle").agg(F.min("sig").alias("sig"), F.max("sig").alias("top"))
            .filter("sig = top").groupBy("sig").agg(F.count(F.lit(1)).alias("own")))
    n = F.col("n_shingles")
    need = F.ceil(n * SHARE[0] / SHARE[1])
    lower = F.greatest(F.lit(1), F.floor(n / 8))
    alive = settled(equal.join(once, "sig", "left").filter(n - need + lower - F.coalesce("own", F.lit(0)) >= lower)
                    .select(F.col("rep").alias("doc_id"), "t", "node"), "alive")
    kept = F.broadcast(alive) if alive.count() <= broadcast_rows else alive
    sets = settled(full_sets(docs.join(kept, ["doc_id", "t"]).select("node", "text")).dropDuplicates(["node"]), "sets")

    entries = sets.select("node", "n", F.explode("shingles").alias("shingle"))
    often = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    near = entries.join(often, "shingle")
    by_node = Window.partitionBy("node")
    near = near.withColumn("place", F.row_number().over(by_node.orderBy("df", "shingle"))).withColumn("shared", F.count(F.lit(1)).over(by_node))
    need = F.ceil(F.col("n") * SHARE[0] / SHARE[1])
    # The place in the global order is that among the shared ones behind all the set's own.
    prefix = settled(near.filter(F.col("n") - F.col("shared") + F.col("place") <= F.col("n") - need + 1).select("node", "shingle"), "prefix")
    leaders = prefix.groupBy("shingle").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").drop("last")
    blocks = settled(prefix.join(leaders, "shingle").select("leader", "node").distinct(), "blocks")
    edges = settled(_block_edges(blocks, sets, block_docs), "links")

    # The smallest id of a component; its classes may be many, so it meets them in salted parts.
    placed = settled(equal.drop("t").join(components(edges), "node", "left").filter("component is not null or copies > 1"), "placed")
    linked = placed.filter("component is not null")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = split_join(linked.select("sig", "sig2", "n_shingles", "component"), least, "component", "inner").drop("component")
    alone = placed.filter("component is null").select("sig", "sig2", "n_shingles", F.col("rep").alias("component_id"))
    out = found.join(settled(linked.unionByName(alone), "grown"), ["sig", "sig2", "n_shingles"], "left")
    return out.select("doc_id", "t", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS,
            broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id): connected classes of documents whose sets of five-word
    shingles have a Jaccard similarity of three quarters or more.

    component_id is the smallest id reachable by links. Null, empty and blank texts have no
    shingles and link with nothing; rows with a null id are left out; the rows of a repeated id
    are classed each by its own text, and are not linked by the id. Other columns are not
    read; an empty table gives no rows.

    Equal sets are one class from the start. A set can only link if enough of its shingles
    occur in another one: first within the long prefixes, by counts that combine before the
    shuffle, then among the sets left, whole. These are ordered by frequency, rarest first;
    each meets the others at the first class that shares a shingle of its prefix, and each
    such block is joined in a trie. A block beyond ``block_docs`` meets its leader first; what
    does not link with it is split into parts, and pairs of parts are joined, so no task holds
    an unbounded group. Only a forest of links leaves a block.
    """
    return classed(docs, id_col, text_col, block_docs, broadcast_rows).drop("t")
