"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

Texts are sets of hashed runs of five words. Copies (equal sets) are one node. Each node's MinHash signature is cut into
``trees`` strings of ``depth`` labels, one for each tree of the forest, a prefix trie of sorted strings. A pair of similarity t agrees
in the first d labels of a tree with probability t^d, so a node that is matched by prefixes of d_1, d_2, ... labels finds a partner at
the threshold with probability 1 - (1 - t^d_1)(1 - t^d_2)... Each node begins with whole strings and shortens
the prefix of one tree at a time by a label, always where that adds the fewest rows, until this recall reaches the target. So
prefixes stay long in the trees where a node's surroundings are dense. No prefix need be shorter than the length at which all trees
together reach the target; subtries below that length are stored under a hash of it, and only those of several nodes are kept.

A subtrie's nodes are never expanded into pairs. In each, a group (at most ``block`` nodes, or a pair of such blocks) is
sorted, walked from its longest prefixes to its shortest, and joined where one of two nodes is matched by the prefix they share and
sketches agree well enough (the low bytes of 96 MinHash values in a share ``least``; a pair at 0.8 fails this with probability 1e-9). It
gives a forest of at most one edge a node. The components of all forests hold
every candidate pair; the sets of a component come together once, in blocks, and all pairs inside are verified exactly, as
products of sparse 0/1 rows. What leaves are counts of links and again forest edges, so rows stay in proportion to
documents: classes and link counts are those of all verified pairs.

Results for odd input: null and empty texts, and texts without a word, are each a class of their own without links; texts of fewer
than five words are one run of all their words; repeated rows are copies; a null doc_id gets its class too (null where all of the class
have none); an empty table gives no rows; further columns are ignored; texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .components import components
from .storage import durable, sized_join, skew_join, text_batches

U = np.uint64


def matched_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix whose expected recall at the threshold reaches the target; 1 if none does."""
    d = depth
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def signature(sets: list[np.ndarray], size: int, seed: int = 11) -> np.ndarray:
    """MinHash values, one row for each set (all of them with members)."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, size, dtype=np.uint64) * U(2) + U(1)
    b = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), size), dtype=np.uint32)
    for j in range(size):
        out[:, j] = np.minimum.reduceat((flat * a[j] + b[j]) >> U(32), starts)
    return out


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    starts = np.cumsum([0, *map(len, sets[:-1])]) if sets else []
    one = np.add.reduceat(K.mix(flat + U(1)), starts) if len(flat) else np.zeros(0, U)
    two = np.add.reduceat(K.mix(flat ^ K.BASE), starts) if len(flat) else np.zeros(0, U)
    return K.mix(one), K.mix(two)


def text_sets(texts: pa.Array, n: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, last, data, offs in K.chunks(texts):
        starts, ends, text = K.words(data, offs)
        yield first, K.shingles(K.range_hashes(data, starts, ends), text, last - first, n)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest connected position of each of n positions under the edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (before == root).all():
            break
    return root


TREES, DEPTH, THRESHOLD, RECALL = 16, 6, 0.8, 0.9995


def chosen_depths(counts: np.ndarray, threshold: float, depth: int, used: int, recall: float) -> np.ndarray:
    """The matched prefix length of each node in each tree, from the number of rows under its prefixes of used, used + 1, ... depth labels.

    ``counts`` is nodes x trees x lengths. Starting at ``depth``, the prefix that gains the fewest rows is shortened until the expected recall at the threshold is reached.
    """
    chosen = np.full(counts.shape[:2], depth)
    gain = np.log1p(-(threshold ** np.arange(depth + 1)), where=np.arange(depth + 1) > 0, out=np.zeros(depth + 1))
    target = np.log(max(1 - recall, 1e-300))
    every, i, j = np.arange(len(counts)), *np.indices(chosen.shape)
    while True:
        cost = np.where(chosen > used, counts[i, j, np.maximum(chosen - 1 - used, 0)] - counts[i, j, chosen - used], np.iinfo(np.int64).max)
        best = cost.argmin(1)
        go = (gain[chosen].sum(1) > target + 1e-12) & (chosen[every, best] > used)
        if not go.any():
            return chosen
        chosen[every[go], best[go]] -= 1


def node_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, n: int = 5) -> DataFrame:
    """(id, d1, d2, sketch, keys, rests, text_hash): digests of the set, the low byte of each MinHash value, and of each tree's string a hash of the shortest prefix and the labels after it; nulls where there is no word; text_hash is the text's."""
    used = matched_depth(threshold, trees, depth, recall)
    text_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for first, sets in text_sets(b.column(1), n):
                full = [i for i, s in enumerate(sets) if len(s)]
                d1, d2, sketch, keys, rests = ([None] * len(sets) for _ in range(5))
                if full:
                    some = [sets[i] for i in full]
                    sig = signature(some, trees * depth)
                    one, two = digests(some)
                    label = sig.reshape(len(some), trees, depth).astype(U)
                    rest = np.ascontiguousarray(sig.reshape(len(some), trees, depth)[:, :, used:].astype(">u4"))  # byte order is label order
                    key = np.broadcast_to(np.arange(trees, dtype=U), (len(some), trees)).copy()
                    for k in range(used):
                        key = K.mix(key * K.BASE + label[:, :, k])
                    for i, x, y, s, k, r in zip(full, one.view(np.int64).tolist(), two.view(np.int64).tolist(), (sig & 255).astype(np.uint8), key.view(np.int64), rest, strict=True):
                        d1[i], d2[i], sketch[i], keys[i], rests[i] = x, y, s.tobytes(), k.tolist(), r.tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(sets)), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(rests, pa.binary()), b.column(2).slice(first, len(sets))], names=["id", "d1", "d2", "sketch", "keys", "rests", "text_hash"])

    return durable(docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, "id long, d1 long, d2 long, sketch binary, keys array<long>, rests binary, text_hash long"))


def distinct_nodes(rows: DataFrame) -> DataFrame:
    """(node, d1, d2, first, n_copies, sketch, keys, rests): one row for each set; node is its number, as half of a digest doesn't tell sets apart for sure."""
    firsts = (F.first(c).alias(c) for c in ("sketch", "keys", "rests"))
    return durable(rows.filter("d1 is not null").groupBy("d1", "d2").agg(F.min("id").alias("first"), F.count("*").alias("n_copies"), *firsts).withColumn("node", F.monotonically_increasing_id()))


def forest(nodes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(key, node, rest, d, n, sketch): the rows of all subtries of several nodes; d labels of the node's string are matched in this tree; n rows are in the subtrie."""
    used = matched_depth(threshold, trees, depth, recall)
    width = 4 * (depth - used)
    places = F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.substring("rests", i * width + 1, F.lit(width)).alias("rest")))
    leaves = nodes.select("node", F.explode(places).alias("x")).select("node", "x.key", "x.rest")
    shared = durable(leaves.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    rows = skew_join(leaves, shared, "key", total).withColumnRenamed("n", "n0")
    for j in range(1, depth - used + 1):  # rows under longer prefixes: they only steer the choice, so hashes will do
        rows = durable(rows.withColumn("_p", F.xxhash64("key", F.substring("rest", F.lit(1), F.lit(4 * j)))))
        rows = skew_join(rows, durable(rows.groupBy("_p").agg(F.count("*").alias("n"))), "_p", total).drop("_p").withColumnRenamed("n", f"n{j}")
    levels = [f"n{j}" for j in range(depth - used + 1)]
    by_node = rows.groupBy("node").agg(F.collect_list(F.struct("key", "rest", *levels)).alias("places"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, flat = b.column(1).value_lengths().to_numpy(zero_copy_only=False), b.column(1).flatten()
            at = np.repeat(np.arange(b.num_rows), sizes)
            tree = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            counts = np.ones((b.num_rows, trees, len(levels)), dtype=np.int64)  # trees in which a node is alone
            for j, c in enumerate(levels):
                counts[at, tree, j] = flat.field(c).to_numpy(zero_copy_only=False)
            d = chosen_depths(counts, threshold, depth, used, recall)[at, tree]
            index = pa.array(at)
            yield pa.RecordBatch.from_arrays([flat.field("key"), b.column(0).take(index), flat.field("rest"), pa.array(d, pa.int32()), flat.field("n0"), b.column(2).take(index)], names=["key", "node", "rest", "d", "n", "sketch"])

    return by_node.join(nodes.select("node", "sketch"), "node").mapInArrow(choose, "key long, node long, rest binary, d int, n long, sketch binary")


def _in_blocks(rows: DataFrame, sizes: DataFrame | None, key: str, block: int, batch: int) -> DataFrame:
    """``rows`` (key, node, ...) dealt into groups for :meth:`applyInArrow` by (g, i, j): small keys by the batch, large keys as pairs of blocks.

    ``sizes`` has (key, n); without it the rows have n. A key of more than ``block`` nodes has ceil(n / block) blocks by a hash of the node, and a node goes to every pair that has its block.
    """
    total = (rows.agg(F.count("*")) if sizes is None else sizes.agg(F.sum("n"))).first()[0] or 0
    batches = max(1, -(-int(total) // batch))
    joined = rows if sizes is None else skew_join(rows, sizes, key, int(total))
    blocks = F.ceil(F.col("n") / block).cast("int")
    joined = joined.withColumn("_b", F.when(F.col("n") > block, F.pmod(F.xxhash64("node"), blocks).cast("int")))
    pair = F.explode(F.when(F.col("_b").isNull(), F.array(F.struct(F.pmod(F.xxhash64(key), F.lit(batches)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.col(key).alias("g"), F.least(x, F.col("_b")).alias("i"), F.greatest(x, F.col("_b")).alias("j")))))
    return joined.withColumn("_p", pair).select("_p.*", F.coalesce("_b", F.lit(-1)).alias("b"), *rows.columns)


def _alike(sketches: np.ndarray, asks: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) that connect what all pairs connect of which one asks and whose sketches agree in at least this share of bytes: a search from row to row.

    A row that is reached is compared with those not reached yet only, so a large group of like rows costs little more than one comparison a row.
    """
    need = least * sketches.shape[1]
    a, b = [], []
    rest = np.arange(len(sketches))
    while len(rest):
        seed, rest, queue = rest[0], rest[1:], [rest[0]]
        while queue and len(rest):
            now = queue.pop()
            at = np.arange(len(rest)) if asks[now] else np.flatnonzero(asks[rest])
            hit = at[(sketches[rest[at]] == sketches[now]).sum(1) >= need]
            if len(hit):
                found = rest[hit]
                a += found.tolist()
                b += [seed] * len(found)
                queue += found.tolist()
                rest = np.delete(rest, hit)
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _subtrie(rest: np.ndarray, d: np.ndarray, sketch: np.ndarray, used: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) between the rows of one subtrie: ``rest`` has the labels after the first ``used``, ``d`` the matched lengths. From the longest prefixes to the shortest."""
    order = np.lexsort(rest.T[::-1]) if rest.shape[1] else np.arange(len(rest))
    sorted_, a, b, last = rest[order], [], [], None
    for length in range(rest.shape[1], -1, -1):
        cuts = np.flatnonzero(np.concatenate([[True], (sorted_[1:, :length] != sorted_[:-1, :length]).any(1), [True]]))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = order[s:e]
            asks = d[at] <= used + length
            if e - s > 1 and asks.any() and (s, e) not in (last or ()):  # a run that is whole under a longer prefix has been joined there
                x, y = _alike(sketch[at], asks, least)
                a.append(at[x])
                b.append(at[y])
        last = set(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _products(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the members that at least two sets share, a few thousand columns at a time."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    out = np.zeros((n, n), dtype=np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    width = max(64, (1 << 22) // n)
    for c in range(0, int(column[-1]) + 1, width):
        s, e = np.searchsorted(column, [c, c + width])
        m = np.zeros((n, width), dtype=np.float32)
        m[owner[s:e], column[s:e] - c] = 1
        out += m @ m.T
    return out


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = 5, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, least: float = 0.55, block: int = 512, text_col: str = "text", id_col: str = "doc_id", by_row: bool = False) -> DataFrame:
    """(id, class_id, n_links, n_copies): class_id is the smallest id that a chain of links and copies leads to; n_links counts the different texts (sets) at or above the threshold.

    ``by_row`` adds what tells rows and classes apart where an id stands for several texts: text_hash (``xxhash64`` of the text) and
    class_node (one number for each class, null for texts without a word).
    """
    docs = docs.select(id_col, text_col)
    rows = node_rows(docs, text_col, id_col, threshold, trees, depth, recall, n)
    nodes = distinct_nodes(rows)
    used = matched_depth(threshold, trees, depth, recall)

    # candidates: nodes of a subtrie, joined where one of two is matched by their common prefix and sketches agree
    def link(table: pa.Table) -> pa.Table:
        key, node, d = (table[c].to_numpy() for c in ("key", "node", "d"))
        rest = np.frombuffer(b"".join(table["rest"].to_pylist()), ">u4").reshape(len(node), depth - used)
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
        # subtries of two nodes, most of all, at once
        two = cuts[:-1][np.diff(cuts) == 2]
        x, y = order[two], order[two + 1]
        common = used + np.cumprod(rest[x] == rest[y], axis=1).sum(1)
        x, y = (z[(np.minimum(d[x], d[y]) <= common) & ((sketch[x] == sketch[y]).sum(1) >= least * sketch.shape[1])] for z in (x, y))
        u, v = [node[x]], [node[y]]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s == 2:
                continue
            at = order[s:e]
            x, y = _subtrie(rest[at], d[at], sketch[at], used, least)
            u.append(node[at[x]])
            v.append(node[at[y]])
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    members = durable(forest(nodes, threshold, trees, depth, recall))
    edges = _in_blocks(members, None, "key", 2048, 1 << 13).groupBy("g", "i", "j").applyInArrow(link, "u long, v long")
    comp = components(edges).select("node", F.col("root").alias("comp"))

    # verification: the sets of each component come together once, or once for each pair of its blocks
    members_of = durable(comp.join(nodes.select("node", "first", "d1", "d2"), "node"))
    wanted = members_of.filter("first is not null")
    lost = members_of.filter("first is null").drop("first")  # of rows without an id: their texts are found by the digest
    sizes = durable(comp.groupBy("comp").agg(F.count("*").alias("n")))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes_, comps = b.column(1), b.column(2)
            for first, sets in text_sets(b.column(0), n):
                node, group, one, two = (c.slice(first, len(sets)).to_numpy(zero_copy_only=False) for c in (nodes_, comps, b.column(3), b.column(4)))
                full = [i for i, s in enumerate(sets) if len(s)]
                have = [x.view(np.int64) for x in digests([sets[i] for i in full])] if full else [[], []]
                keep = [i for i, x, y in zip(full, *have, strict=True) if x == one[i] and y == two[i]]
                yield pa.RecordBatch.from_arrays([pa.array(group[keep], pa.int64()), pa.array(node[keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["comp", "node", "members"])

    found = sized_join(docs, wanted.select(F.col("first").alias(id_col), "node", "comp", "d1", "d2"), id_col).select(text_col, "node", "comp", "d1", "d2")
    if not lost.isEmpty():

        def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for first, sets in text_sets(b.column(0), n):
                    full = [i for i, s in enumerate(sets) if len(s)]
                    have = [x.view(np.int64) for x in digests([sets[i] for i in full])] if full else [[], []]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([first + i for i in full], pa.int64())), *(pa.array(x, pa.int64()) for x in have)], names=["text", "d1", "d2"])

        nameless = docs.filter(F.col(id_col).isNull()).select(text_col).mapInArrow(digested, "text string, d1 long, d2 long").join(lost, ["d1", "d2"])
        found = found.unionByName(nameless.select(F.col("text").alias(text_col), "node", "comp", "d1", "d2"))
    sets = found.mapInArrow(sets_of, "comp long, node long, members binary")

    def verify(table: pa.Table) -> pa.Table:
        comp_, node, part = (table[c].to_numpy() for c in ("comp", "node", "b"))
        _, once = np.unique(np.column_stack([comp_, node]), axis=0, return_index=True)
        comp_, node, part = comp_[once], node[once], part[once]
        data = table["members"]
        out_n, out_l, u, v = [], [], [], []
        order = np.lexsort((node, comp_))
        cuts = np.flatnonzero(np.concatenate([[True], comp_[order][1:] != comp_[order][:-1], [True]]))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[s:e]
            mine = [np.frombuffer(data[int(once[i])].as_py(), np.uint64) for i in at]
            size = np.array([len(x) for x in mine], dtype=np.float64)
            both = _products(mine).astype(np.float64)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            parts = np.unique(part[at])
            if len(parts) > 1:
                linked &= part[at][:, None] != part[at][None, :]
            x, y = np.nonzero(linked)
            root = _roots(len(at), x, y)
            out_n.append(node[at])
            out_l.append(linked.sum(1))
            v.append(node[at[root]])
        return pa.table({"node": np.concatenate(out_n), "links": np.concatenate(out_l).astype(np.int64), "root": np.concatenate(v)})

    blocks = _in_blocks(sets, sizes, "comp", block, 1 << 11)
    checked = durable(blocks.groupBy("g", "i", "j").applyInArrow(verify, "node long, links long, root long"))
    links = checked.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(checked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    firsts = classes.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("class_id"))
    by_node = durable(classes.join(firsts, "root").join(links, "node", "left").select("node", "root", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    known = nodes.select("node", "d1", "d2", "first", "n_copies").join(by_node, "node", "left").select("d1", "d2", "n_copies", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "node").alias("class_node"))
    more = ["text_hash", "class_node"] if by_row else []
    some = rows.filter("d1 is not null").select("id", "d1", "d2", *more[:1]).join(known, ["d1", "d2"]).select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies", *more)
    none = rows.filter("d1 is null").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), *([F.col("text_hash"), F.lit(None).cast("long").alias("class_node")] if by_row else []))
    return some.unionByName(none)
