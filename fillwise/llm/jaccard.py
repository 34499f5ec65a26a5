"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts with the same words are one node; a node's signature is laid out as ``trees`` prefix tries of ``depth`` minima
each.  Nodes that share a trie node (a tree and a prefix) are candidates.  Matching starts at the full depth, and every
candidate is verified on its shingle sets.  A node is open while a link like the least similar one it has so far (like one
at the threshold, if it has none) would be found with a smaller chance than the target recall; then the prefixes of open
nodes are shortened by one, and the components of candidates that grew by that are verified again.  This ends at the depth
at which even links at the threshold meet the target, so no node is left open.  If no depth does, the join refuses and
says how many trees would.

Candidates that hang together are verified together.  A component small enough goes whole into a bundle.  In a larger
one the sets' distances to a centre (the shingles that most of a sample hold) decide what they can: by the triangle
inequality, nodes whose distances add up to no more than 1 - threshold are linked, and are counted by sums.  The other
pairs are compared in blocks, of the component or of its trie nodes, whichever compares fewer; in the latter, a pair
is compared in the first tree only in which it shares a prefix.  A group holds one or two sides of many blocks, so that a
text is copied once for each side and not for each block.  It returns one row per node (its number of links and the
smallest node it is linked with), never pairs.

Defined results: a text without words (or null) has no shingles, is its own class and has no links; a text of fewer
words than a shingle is one shingle; copies count as links of each other; a null id takes part and never names a
class unless all ids of a class are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillwise.llm.common import Words, any_order, discard, give_back, grams, join_sums, materialize, mix64, neutral, restored, slices
from fillwise.llm.components import components

#: Nodes of a block; of a bundle of small components, about.
BLOCK, BUNDLE = 384, 1024
#: Blocks of a group's side, and bytes of its texts, about.
SIDE_BLOCKS, SIDE_BYTES = 16, 8_000_000
#: Shingles (columns) of a dense comparison at a time.
COLUMNS = 8192
#: Steps in which distances to a centre are told apart; nodes from which a centre is made, about; of a slice, about.
LEVELS, SAMPLE, SLICE = 64, 256, 1024


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds) of each text's shingles, with repeats, and two hashes of its whole word sequence."""
    w = Words(texts)
    h, starts = w.hashes(), w.starts
    lengths = w.lengths
    # the sequence: position-dependent sums, mixed with the length
    place = np.arange(len(h)) - np.repeat(starts[:-1], lengths)
    whole = []
    with np.errstate(over="ignore"):
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            term = mix64(h ^ mix64(place.astype(np.uint64) * np.uint64(seed) + np.uint64(1)))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
            whole.append(mix64(total[starts[1:]] - total[starts[:-1]] + lengths.astype(np.uint64) * np.uint64(seed)))
    g = grams(h, n)
    per_text = np.where(lengths >= n, lengths - n + 1, (lengths > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(per_text)))
    at = np.arange(bounds[-1]) + np.repeat(starts[:-1] - bounds[:-1], per_text)
    short = np.repeat((lengths < n), per_text)
    out = g[np.minimum(at, max(len(g) - 1, 0))] if len(g) else np.zeros(len(at), np.uint64)
    if short.any():
        out[short] = whole[0][(lengths > 0) & (lengths < n)]
    return out, bounds, whole[0], whole[1]


def minima(hashes: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima (32 bits) of each text with shingles; texts without any must not be given."""
    rng = np.random.default_rng(20240229)
    xor = rng.integers(0, 1 << 64, count, dtype=np.uint64)
    times = rng.integers(0, 1 << 64, count, dtype=np.uint64) | np.uint64(1)
    out = np.empty((len(bounds) - 1, count), np.uint32)
    work = np.empty_like(hashes)
    with np.errstate(over="ignore"):
        for j in range(count):
            np.bitwise_xor(hashes, xor[j], out=work)
            np.multiply(work, times[j], out=work)
            out[:, j] = np.minimum.reduceat(work, bounds[:-1]) >> np.uint64(32)
    return out


def found_at(similarity: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """The chance that a link of this similarity shares a prefix of ``depth`` in one of the trees."""
    return 1.0 - (1.0 - np.asarray(similarity, float) ** depth) ** trees


def signatures(docs: DataFrame, n: int, count: int) -> DataFrame:
    """(doc_id, tie, node, minima): node is 16 bytes of the word sequence, null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, bounds, one, two = shingles(batch.column(2), n)
            some = np.diff(bounds) > 0
            node = np.stack((one, two), 1).astype(">u8").tobytes()
            sketch: list[bytes | None] = [None] * batch.num_rows
            if some.any():
                rows = minima(h, np.concatenate((bounds[:-1][some], bounds[-1:])), count)
                for i, row in zip(np.flatnonzero(some).tolist(), rows):
                    sketch[i] = row.tobytes()
            nodes = [node[16 * i : 16 * i + 16] if s else None for i, s in enumerate(some.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "tie", "node", "minima"])

    return docs.mapInArrow(run, "doc_id long, tie long, node binary, minima binary")


def labels(minima_: list[bytes], trees: int, most: int, depth: int) -> np.ndarray:
    """The trie node at ``depth`` of each tree that each signature falls into."""
    values = np.frombuffer(b"".join(minima_), np.uint32).reshape(len(minima_), trees, most)
    out = np.broadcast_to(mix64(np.arange(trees, dtype=np.uint64) + np.uint64(77)), (len(minima_), trees)).copy()
    with np.errstate(over="ignore"):
        for k in range(depth):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return out


def prefixes(nodes: DataFrame, trees: int, most: int, depth: int, keep: tuple[str, ...]) -> DataFrame:
    """(prefix, tree, node, columns ``keep``): the trie node at ``depth`` of each tree that each node falls into."""
    names = ["node", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label = labels(batch.column(len(names)).to_pylist(), trees, most, depth)
            take = pa.array(np.repeat(np.arange(batch.num_rows), trees))
            tree = np.tile(np.arange(trees, dtype=np.int32), batch.num_rows)
            kept = [batch.column(i).take(take) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(label.reshape(-1).view(np.int64)), pa.array(tree), *kept], ["prefix", "tree", *names])

    kinds = "".join(f", {c} {nodes.schema[c].dataType.simpleString()}" for c in names)
    return nodes.select(*names, "minima").mapInArrow(run, f"prefix long, tree int{kinds}")


def compare(sets: list[np.ndarray], inner: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(linked, similarity) between all sets; ``inner`` masks the pairs that count."""
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate(([True], flat[1:] != flat[:-1]))
    number = np.cumsum(first) - 1
    often = np.bincount(number) > 1  # what only one set has is in no intersection
    keep = often[number]
    owner, column = owner[keep], (np.cumsum(often) - 1)[number[keep]]
    common = np.zeros((m, m), np.float32)
    edges = np.searchsorted(column, np.arange(0, int(often.sum()) + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if b > a:
            block = np.zeros((m, min(COLUMNS, int(often.sum()) - k * COLUMNS)), np.float32)
            block[owner[a:b], column[a:b] - k * COLUMNS] = 1
            common += block @ block.T
    common = common.astype(np.int64)
    both = sizes[:, None] + sizes[None, :]
    p, q = threshold.numerator, threshold.denominator
    linked = inner & (common * (p + q) >= p * both)
    return linked, common / np.maximum(both - common, 1)


def roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each index hangs together with."""
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def united(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the indices below ``n`` that each one hangs together with by the edges (u, v)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[u], label[v])
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_pairs(side: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Blocks of places between which, or (with None) within which, pairs are to be compared."""
    cut = lambda at: [at[i : i + block] for i in range(0, len(at), block)]
    if (side >= 0).any():
        other = cut(np.flatnonzero(side == 1))
        yield from ((a, b) for a in cut(np.flatnonzero(side == 0)) for b in other)
        return
    blocks = cut(np.arange(len(side)))
    for i, a in enumerate(blocks):
        yield a, None
        yield from ((a, b) for b in blocks[i + 1 :])


def verify(groups: DataFrame, n: int, threshold: Fraction, depth: int, trees: int, most: int, block: int) -> DataFrame:
    """(node, root, links, low) for each node of each group: its links, their smallest node and least similarity.

    ``groups`` has (group, cell, tree, side, node, copies, level, minima, text).  Pairs are within a cell, and between
    sides if it has two (0 and 1; else -1).  In a cell of a tree only pairs that share no prefix of an earlier tree
    count.  Pairs whose levels add up to LEVELS or less are known to be linked, and left out."""

    def run(table: pa.Table) -> pa.Table:
        h, bounds, _, _ = shingles(pa.concat_arrays(table.column("text").chunks), n)
        nodes, minima_ = table.column("node").to_pylist(), table.column("minima").to_pylist()
        copies, side, tree = (table.column(c).to_numpy() for c in ("copies", "side", "tree"))
        level = table.column("level").fill_null(LEVELS + 1).to_numpy()
        parts: dict[bytes, list[int]] = {}
        for i, c in enumerate(table.column("cell").to_pylist()):
            parts.setdefault(c, []).append(i)
        root: list[bytes] = list(nodes)
        links, low = np.zeros(len(nodes), np.int64), np.full(len(nodes), np.nan)
        for members in parts.values():
            members.sort(key=nodes.__getitem__)
            at = np.array(members)
            if len(at) < 2:
                continue
            lev, j = level[at], int(tree[at[0]])
            own = labels([minima_[i] for i in members], trees, most, depth) if j > 0 else None
            sets = [np.unique(h[bounds[i] : bounds[i + 1]]) for i in members]
            number, least = np.zeros(len(at), np.int64), np.full(len(at), np.inf)
            edges: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in block_pairs(side[at], block):
                if b is None:
                    two, inner = a, ~np.eye(len(a), dtype=bool)
                else:
                    two = np.sort(np.concatenate((a, b)))
                    one = np.isin(two, a)
                    inner = one[:, None] != one[None, :]
                inner &= lev[two][:, None] + lev[two][None, :] > LEVELS
                for t in range(j):
                    inner &= own[two, t][:, None] != own[two, t][None, :]
                if not inner.any():
                    continue
                linked, similarity = compare([sets[i] for i in two.tolist()], inner, threshold)
                number[two] += linked @ copies[at[two]]
                least[two] = np.minimum(least[two], np.where(linked, similarity, np.inf).min(1))
                edges.append((two, two[roots(linked)]))
            links[at], low[at] = number, least
            if edges:
                u, v = map(np.concatenate, zip(*edges))
                for i, r in zip(members, united(u, v, len(at)).tolist()):
                    root[i] = nodes[members[r]]
        give_back()
        return pa.table({"node": pa.array(nodes, pa.binary()), "root": pa.array(root, pa.binary()), "links": links, "low": pa.array(low, mask=~(low <= 1))})

    return groups.groupBy("group").applyInArrow(run, "node binary, root binary, links long, low double")


def similarity_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 20, depth: int = 6, least_depth: int | None = None, recall: float = 0.999, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, tie, class_id, class_tie, n_links.

    A link is a pair of documents whose sets of ``n``-word shingles have a Jaccard similarity of ``threshold`` or more;
    a class is what links hold together, named by its smallest id; ``tie`` (a hash of the text) tells rows of one id
    apart, ``class_tie`` is that of the row that names the class.  ``least_depth`` ends the shortening before the target
    is met, for callers who accept that."""
    exact = Fraction(str(threshold))
    last = least_depth or next((k for k in range(depth, 0, -1) if float(found_at(threshold, k, trees)) >= recall), None)
    if last is None:
        needed = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold))) if 0 < threshold < 1 and recall < 1 else "more"
        raise ValueError(f"{trees} trees don't find links of {threshold} with a recall of {recall}; take {needed}")
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), F.col(f"`{text}`").alias("text"))
    signed = materialize(signatures(docs, n, trees * depth))
    named = signed.where(F.col("node").isNotNull())
    # a node is named by its smallest (id, tie); null ids come last
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    nodes = materialize(named.groupBy("node").agg(F.min(key).alias("name"), F.count(F.lit(1)).alias("copies"), F.first("minima").alias("minima")))
    total = nodes.count()
    # candidates verified so far: their component, links, least similarity, and whether a shorter prefix may add pairs
    state: DataFrame | None = None
    edges: list[DataFrame] = []
    for k in range(depth, last - 1, -1):
        if state is None:
            current = nodes.withColumn("open", F.lit(True))
        else:
            chance = 1 - F.pow(1 - F.pow("low", F.lit(k + 1)), F.lit(trees))  # at the depth matched so far
            current = nodes.join(state.select("node", "low"), "node", "left").withColumn("open", F.col("low").isNull() | (chance < recall))
        tries = prefixes(current, trees, depth, k, ("open",))
        shared = tries.groupBy("prefix").agg(F.min("node").alias("centre"), F.max("node").alias("last"), F.max("open").alias("any"), F.count(F.lit(1)).alias("n"))
        shared = shared.where((F.col("centre") < F.col("last")) & F.col("any")).select("prefix", "centre", "n")
        candidates = join_sums(tries.select("prefix", "node"), shared, ["prefix"], total * trees).where(F.col("node") != F.col("centre")).select("node", "centre").distinct()
        if state is not None:
            candidates = candidates.unionAll(state.select("node", F.col("component").alias("centre")))
        found = components(candidates, "node", "centre").withColumnRenamed("label", "component")
        if state is not None:
            before = state.select("node", F.col("component").alias("was"), "again")
            found = found.join(before, "node", "left").select("node", "component", F.coalesce("was", "node").alias("was"), F.coalesce("again", F.lit(False)).alias("again"))
        else:
            found = found.select("node", "component", F.col("node").alias("was"), F.lit(True).alias("again"))
        found = materialize(found)
        sums = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("was").alias("a"), F.max("was").alias("b"), F.max("again").alias("again"))
        sums = sums.where((F.col("a") < F.col("b")) | F.col("again")).select("component", "n", F.col("n").alias("size"))
        parts = join_sums(found.select("node", "component"), sums, ["component"], found.count())
        parts = materialize(parts.join(nodes, "node"))
        if k < depth and parts.isEmpty():
            break
        checked, in_tries = _verified(docs, parts, n, exact, k, trees, depth, block)
        edges.append(checked.where(F.col("node") != F.col("root")).select("node", "root"))
        done = parts.select("node", "component").join(checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("low").alias("low")), "node", "left")
        done = done.select("node", "component", F.coalesce("links", F.lit(0)).alias("links"), "low")
        done = done.join(in_tries.withColumn("again", F.lit(True)), "component", "left").withColumn("again", F.coalesce("again", F.lit(False))) if in_tries is not None else done.withColumn("again", F.lit(False))
        if state is not None:
            done = done.unionByName(state.join(parts.select("node"), "node", "left_anti"))
        state = materialize(done)
    every = edges[0]
    for e in edges[1:]:
        every = every.unionAll(e)
    joined = components(every, "node", "root")
    labelled = nodes.select("node", "name", "copies").join(state.select("node", "links"), "node", "left").join(joined, "node", "left")
    labelled = materialize(labelled.select("node", "name", "copies", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    names = labelled.groupBy("label").agg(F.min("name").alias("class"), F.count(F.lit(1)).alias("n"))
    labelled = join_sums(labelled, names, ["label"], total).select("node", F.col("copies").alias("n"), "n_links", F.col("class.doc_id").alias("class_id"), F.col("class.tie").alias("class_tie"))
    alone = signed.where(F.col("node").isNull()).select("doc_id", "tie", F.col("doc_id").alias("class_id"), F.col("tie").alias("class_tie"), F.lit(0).cast("long").alias("n_links"))
    whole = join_sums(named.select("node", "doc_id", "tie"), labelled, ["node"], signed.count())
    return whole.select("doc_id", "tie", "class_id", "class_tie", "n_links").unionByName(alone)


_GROUPS = ["group", "cell", "tree", "side", "node", "copies", "level", "minima", "text"]


def _verified(docs: DataFrame, parts: DataFrame, n: int, threshold: Fraction, depth: int, trees: int, most: int, block: int) -> tuple[DataFrame, DataFrame | None]:
    """(what ``verify`` finds in the components ``parts``, written; the components of which only trie nodes were verified)."""
    names = parts.select("node", "component", "size", "copies", "minima", F.col("name.doc_id").alias("mid"), F.col("name.tie").alias("mtie"))
    texts = docs.join(names, F.col("doc_id").eqNullSafe(F.col("mid")) & (F.col("tie") == F.col("mtie"))).dropDuplicates(["node"]).drop("doc_id", "tie", "mid", "mtie")
    texts = materialize(texts)  # the documents are shuffled once; only the candidates' texts go on
    bundles = max(1, parts.count() // BUNDLE)
    none = F.lit(None)
    few = texts.where(F.col("size") <= block).select(
        F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(bundles))).alias("group"), F.col("component").alias("cell"), F.lit(-1).alias("tree"), F.lit(-1).alias("side"),
        "node", "copies", none.cast("int").alias("level"), none.cast("binary").alias("minima"), "text",
    )
    if parts.where(F.col("size") > block).isEmpty():
        checked, in_tries = materialize(verify(few, n, threshold, depth, trees, most, block)), None
    else:
        dealt, certain, in_tries = _large(texts.where(F.col("size") > block), n, threshold, depth, trees, most, block)
        checked = materialize(verify(few.unionByName(dealt), n, threshold, depth, trees, most, block).unionByName(certain))
    discard(texts)
    return checked, in_tries


def _levels(many: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(node, level): in LEVELS-ths of 1 - threshold, rounded up, a set's distance to its component's centre."""

    def centre(table: pa.Table) -> pa.Table:
        h, bounds, _, _ = shingles(pa.concat_arrays(table.column("text").chunks), n)
        sets = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        one, count = np.unique(np.concatenate(sets), return_counts=True)
        return pa.table({"component": table.column("component").slice(0, 1), "centre": pa.array([one[2 * count > len(sets)].tobytes()], pa.binary())})

    def distance(key, table: pa.Table, centres: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"node": pa.array([], pa.binary()), "level": pa.array([], pa.int32())})
        c = np.frombuffer(centres.column("centre")[0].as_py(), np.uint64) if centres.num_rows else np.zeros(0, np.uint64)
        h, bounds, _, _ = shingles(pa.concat_arrays(table.column("text").chunks), n)
        level = np.empty(table.num_rows, np.int32)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            own = np.unique(h[a:b])
            common = len(np.intersect1d(own, c, assume_unique=True))
            apart = 1 - common / (len(own) + len(c) - common)
            level[i] = min(LEVELS + 1, int(LEVELS * apart / float(1 - threshold)) + 1) if threshold < 1 else LEVELS + 1
        return pa.table({"node": table.column("node"), "level": pa.array(level)})

    sampled = many.where(F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SAMPLE)) == 0)
    slices_ = F.ceil(F.col("size") / SLICE).cast("int")
    centres = sampled.select("component", "text").groupBy("component").applyInArrow(centre, "component binary, centre binary")
    sizes = many.groupBy("component").agg(F.first(slices_).alias("slices"))
    centres = centres.join(sizes, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "centre")
    mine = many.select("component", F.pmod(F.xxhash64("node"), slices_).cast("int").alias("slice"), "node", "text")
    return mine.groupBy("component", "slice").cogroup(centres.groupBy("component", "slice")).applyInArrow(distance, "node binary, level int")


def _large(many: DataFrame, n: int, threshold: Fraction, depth: int, trees: int, most: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups to verify, links that are certain, the components of which only trie nodes are verified)."""
    held = materialize(many.withColumn("bytes", F.octet_length("text")).drop("text").join(_levels(many, n, threshold), "node"))
    rows = held.count()
    # links by the triangle inequality: sums by component and level
    by_level = held.groupBy("component", "level").agg(F.sum("copies").alias("weight"), F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
    upto = by_level.alias("u").join(by_level.alias("v"), (F.col("u.component") == F.col("v.component")) & (F.col("u.level") + F.col("v.level") <= LEVELS))
    upto = upto.groupBy(F.col("u.component").alias("component"), F.col("u.level").alias("level")).agg(F.sum("v.weight").alias("weight"), F.min(F.struct("v.level", "v.least")).alias("nearest"), F.first("u.n").alias("n"))
    certain = join_sums(held.select("component", "level", "node", "copies"), upto, ["component", "level"], rows)
    own = F.when(2 * F.col("level") <= LEVELS, F.col("copies")).otherwise(0)
    certain = certain.select("node", F.col("nearest.least").alias("root"), (F.col("weight") - own).cast("long").alias("links"), F.lit(None).cast("double").alias("low"))
    # cells: the component, or its trie nodes; loose nodes are compared with all others, tight ones are linked among themselves
    tight = 2 * F.col("level") <= LEVELS
    whole = held.select(F.col("component").alias("cell"), F.lit(-1).alias("tree"), "component", "node", "bytes", tight.alias("tight"))
    tries = prefixes(held.withColumn("tight", tight), trees, most, depth, ("component", "bytes", "tight"))
    tries = tries.select(F.concat("component", F.unhex(F.lpad(F.hex("prefix"), 16, "0"))).alias("cell"), "tree", "component", "node", "bytes", "tight")
    cells = materialize(whole.unionByName(tries))
    loose, firm = F.sum((~F.col("tight")).cast("int")), F.sum(F.col("tight").cast("int"))
    loose_bytes, firm_bytes = (F.sum(F.when(x, F.col("bytes")).otherwise(0)) for x in (~F.col("tight"), F.col("tight")))
    sums = cells.groupBy("cell", "tree", "component").agg(loose.alias("loose"), firm.alias("firm"), loose_bytes.alias("loose_bytes"), firm_bytes.alias("firm_bytes"), F.count(F.lit(1)).alias("n"))
    sums = sums.where((F.col("loose") > 0) & (F.col("n") > 1)).withColumn("lb", F.ceil(F.col("loose") / block).cast("int")).withColumn("fb", F.ceil(F.col("firm") / block).cast("int"))
    cost = F.col("loose") * (F.col("lb") + F.col("fb")) + F.col("firm") * F.col("lb")
    sums = materialize(sums.withColumn("cost", cost))
    costs = sums.groupBy("component").agg(F.sum(F.when(F.col("tree") < 0, F.col("cost")).otherwise(0)).alias("blocks"), F.sum(F.when(F.col("tree") >= 0, F.col("cost")).otherwise(0)).alias("tries"))
    costs = materialize(costs.select("component", (F.col("tries") < F.col("blocks")).alias("in_tries")))
    # a text is copied for each side that its own meets
    lb, fb = (F.greatest(F.ceil(F.col(c) / (block * SIDE_BLOCKS)), F.ceil(F.col(f"{c}_bytes") / SIDE_BYTES)).cast("int") for c in ("loose", "firm"))
    chosen = sums.join(costs, "component").where((F.col("tree") >= 0) == F.col("in_tries")).select("cell", "n", lb.alias("lb"), fb.alias("fb"))
    member = join_sums(cells.select("cell", "tree", "node", "tight"), chosen, ["cell"], cells.count())
    # loose sides meet each other (l) and the tight ones (t)
    hashed = F.xxhash64("node", "cell")
    member = member.withColumn("b", F.pmod(hashed, F.when(F.col("tight"), F.col("fb")).otherwise(F.col("lb"))).cast("int"))

    def pairs(kind: str, side, low, high):
        return F.struct(F.lit(kind).alias("kind"), side.cast("int").alias("side"), low.alias("low"), high.alias("high"))

    b = F.col("b")
    with_loose = F.transform(F.sequence(F.lit(0), F.col("lb") - 1), lambda o: pairs("l", F.when(o == b, -1).when(b < o, 0).otherwise(1), F.least(o, b), F.greatest(o, b)))
    with_tight = F.when(F.col("fb") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("fb") - 1, F.lit(0))), lambda o: pairs("t", F.lit(0), b, o)))
    as_tight = F.transform(F.sequence(F.lit(0), F.col("lb") - 1), lambda o: pairs("t", F.lit(1), o, b))
    no_pairs = F.array().cast("array<struct<kind:string,side:int,low:int,high:int>>")
    meets = F.when(F.col("tight"), as_tight).otherwise(F.concat(with_loose, F.coalesce(with_tight, no_pairs)))
    member = member.select("cell", "tree", "node", F.explode(meets).alias("p")).select("cell", "tree", "node", "p.*")
    dealt = member.join(held.select("node", "level"), "node").join(many.select("node", "copies", "minima", "text"), "node")
    dealt = dealt.select(F.concat_ws("-", F.lit("c"), F.hex("cell"), "kind", "low", "high").alias("group"), "cell", "tree", "side", "node", "copies", "level", "minima", "text")
    return dealt, certain, costs.where("in_tries").select("component")


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the smallest id."""
    original = docs.columns
    docs, own = neutral(docs, doc_id=doc_id, text=text)
    found = similarity_join(docs, **options)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tie") == F.col("class_tie"))).select(F.col("doc_id").alias("_kid"), F.col("tie").alias("_ktie")).distinct()
    mine = docs.select(*own, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_tie"))
    left = mine.join(kept, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_tie") == F.col("_ktie")), "left_semi")
    first = Window.partitionBy("_id", "_tie").orderBy(any_order(left, own))
    return restored(left.withColumn("_k", F.row_number().over(first)).where(F.col("_k") == 1), own, original)
