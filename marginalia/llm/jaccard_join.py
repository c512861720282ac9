"""N-gram Jaccard self-join by chosen paths.

Documents become sets of word shingles; equal sets collapse to one representative.
Each set is embedded by MinHash: a coordinate holds the token of the set that comes first
in a random order, so it is a token sampled without looking at the other sets, and two
sets have it in common with the probability of their Jaccard similarity. A run of the
join walks a forest: at a node the path picks one or two coordinates (1.25 on average,
the inverse of the similarity 0.8), and every set moves to the child named by its
sampled token there. Nodes of one set end, small nodes are compared by brute force on the
signatures, large nodes split again. Runs repeat until their number gives the wanted
recall; as they share the coordinates, that number is averaged over how many of them a
pair has in common. What similar signatures link is only a candidate group: inside
each group all sets are compared exactly, large groups in blocks, and links are
counted without writing pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_broadcast, materialize, text_or_empty
from marginalia.llm.components import connected_components
from marginalia.llm.vectors import mix, runs, shingle_sets, slices

#: MinHash coordinates of a signature.
COORDINATES = 64
#: Nodes of at most so many sets are compared by brute force.
LEAF = 100
#: Levels of a walk; nodes that are still large there are candidates as a whole.
DEPTH = 3
#: Sets in a block of the exact comparison.
BLOCK = 256


def runs_for(recall: float, similarity: float, depth: int = DEPTH) -> int:
    """Runs after which a pair of this similarity has met in a node of ``depth`` with
    probability ``recall``: the extinction of a branching walk with 1 or 2 children.

    All runs share the coordinates, so it is averaged over the number in which a pair agrees.
    """
    second = 1 / similarity - 1
    share = np.arange(COORDINATES + 1) / COORDINATES
    chance = np.array([math.comb(COORDINATES, i) * similarity**i * (1 - similarity) ** (COORDINATES - i) for i in range(COORDINATES + 1)])
    lost = np.zeros(COORDINATES + 1)
    for _ in range(depth):
        one = 1 - share + share * lost
        lost = (1 - second) * one + second * one * one
    n = 1
    while (chance * lost**n).sum() > 1 - recall:
        n += 1
    return n


def _signatures(k: int):
    rng = np.random.default_rng(20240229)
    factor = rng.integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, COORDINATES, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text"):
                sets, bounds = shingle_sets(data, offsets, k)
                size = np.diff(bounds)
                n = hi - lo
                signature = np.zeros((n, COORDINATES), np.uint32)
                s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                some = size > 0
                if some.any():
                    at = bounds[:-1][some]
                    with np.errstate(over="ignore"):
                        s1[some] = np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5)), at)
                        s2[some] = np.add.reduceat(mix(sets + np.uint64(0x1234567)), at)
                        for c in range(COORDINATES):
                            value = ((sets * factor[c] + shift[c]) >> np.uint64(32)).astype(np.uint32)
                            signature[some, c] = np.minimum.reduceat(value, at)
                packed = [None if not s else row.tobytes() for s, row in zip(some, signature, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n), batch.column("text_h").slice(lo, n),
                        pa.array(s1.astype(np.int64)), pa.array(s2.astype(np.int64)), pa.array(size.astype(np.int64)),
                        pa.array(packed, pa.binary()),
                    ],
                    names=["doc_id", "text_h", "s1", "s2", "n", "signature"],
                )

    return run


def set_signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_h, s1, s2, n, signature): digest, size and MinHash signature of each set."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("text_h"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(_signatures(k), "doc_id long, text_h long, s1 long, s2 long, n long, signature binary")


def _choose(rows: DataFrame) -> DataFrame:
    """One level: (path, rep, signature) to the rows of the children."""
    pick = lambda salt: F.pmod(F.xxhash64("path", F.lit(salt)), F.lit(COORDINATES)).cast("int")
    second = F.pmod(F.xxhash64("path", F.lit("more")), F.lit(4)) == 0
    coordinates = F.array_distinct(
        F.when(second, F.array(pick("first"), pick("second"))).otherwise(F.array(pick("first")))
    )
    spread = rows.select("path", "rep", "signature", F.explode(coordinates).alias("c"))
    value = F.substring(F.col("signature"), F.col("c") * 4 + 1, F.lit(4))
    return spread.select(F.xxhash64("path", "c", value).alias("path"), "rep")


def _leaf_edges(least: float):
    """Edges that join the similar signatures of each node, as a forest."""

    def forest(ids: np.ndarray, near: np.ndarray) -> Iterator[tuple[int, int]]:
        left = np.ones(len(ids), bool)
        for i in range(len(ids)):
            if not left[i]:
                continue
            group, todo = [], [i]
            left[i] = False
            while todo:
                j = todo.pop()
                group.append(j)
                more = np.flatnonzero(near[j] & left)
                left[more] = False
                todo.extend(more)
            if len(group) > 1:
                members = ids[group]
                root = members.min()
                yield from ((int(x), int(root)) for x in members if x != root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "path"):
            path = part["path"].to_numpy()
            ids = part["rep"].to_numpy()
            signature = np.frombuffer(b"".join(part["signature"].to_pylist()), np.uint32).reshape(-1, COORDINATES)
            start = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
            size = np.diff(np.concatenate((start, [len(path)])))
            pairs = start[size == 2]
            close = (signature[pairs] == signature[pairs + 1]).mean(axis=1) >= least
            a, b = [ids[pairs[close]]], [ids[pairs[close] + 1]]
            found = []
            for s, n in zip(start[size > 2], size[size > 2], strict=True):
                rows = signature[s : s + n]
                near = np.zeros((n, n), bool)
                for i in range(n):
                    near[i] = (rows == rows[i]).mean(axis=1) >= least
                found.extend(forest(ids[s : s + n], near))
            if found:
                more = np.array(found, np.int64)
                a.append(more[:, 0])
                b.append(more[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def candidate_edges(sets: DataFrame, similarity: float, recall: float, max_depth: int = DEPTH) -> DataFrame:
    """(a, b): forest edges over the candidate groups of ``sets`` (rep, signature).

    Nodes that are still large at ``max_depth`` share that many chosen values; they are
    taken whole as candidates by a star, which the exact comparison then decides.
    """
    n_runs = runs_for(recall, similarity, max_depth)
    # Five standard deviations of an estimate at the threshold.
    least = similarity - 5 * math.sqrt(similarity * (1 - similarity) / COORDINATES)
    rows = sets.select("rep", "signature", F.explode(F.array(*[F.lit(r).cast("long") for r in range(n_runs)])).alias("path"))
    edges: DataFrame | None = None
    for depth in range(max_depth):
        level = materialize(_choose(rows), "paths")
        sizes = materialize(level.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least")).where("n > 1"), "nodes")
        leaves = level.join(sizes.where(F.col("n") <= LEAF).select("path"), "path").join(sets, "rep")
        linked = leaves.select("path", "rep", "signature").repartition("path").sortWithinPartitions("path").mapInArrow(
            _leaf_edges(least), "a long, b long"
        )
        hot = level.join(sizes.where(F.col("n") > LEAF), "path")
        if depth == max_depth - 1:
            linked = linked.unionByName(hot.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
        linked = materialize(linked.distinct(), "candidates")
        edges = linked if edges is None else edges.unionByName(linked)
        if sizes.where(F.col("n") > LEAF).isEmpty():
            break
        rows = hot.select("path", "rep").join(sets, "rep")
    return edges.distinct()


def _shingle_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text"):
                sets, bounds = shingle_sets(data, offsets, k)
                raw = [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").slice(lo, hi - lo), pa.array(raw, pa.binary())], names=["rep", "shingles"]
                )

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate(([False], values[1:] != values[:-1])))
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    out = np.zeros((m, m), np.float64)
    if len(column):
        column = np.cumsum(np.concatenate(([False], column[1:] != column[:-1])))
        step = max(64, (4 << 20) // m)
        for lo in range(0, int(column[-1]) + 1, step):
            a, b = np.searchsorted(column, [lo, lo + step])
            part = np.zeros((m, step), np.float32)
            part[owner[a:b], column[a:b] - lo] = 1
            out += part @ part.T
    return np.rint(out).astype(np.int64)


def _exact(similarity: float):
    """Links of each block task: (rep, n_links, peer); peer is the least member of the
    set's linked group inside the task."""

    def task(rep: np.ndarray, copies: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(s) for s in sets])
        common = _common(sets)
        linked = common >= similarity * (n[:, None] + n[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if (side != side[0]).any():  # two blocks: each block's own pairs are another task's
            linked &= side[:, None] != side[None, :]
        links = linked @ copies
        peer = rep.copy()
        while True:  # least label over links, a few rounds at most for near-cliques
            least = np.where(linked, peer[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            following = np.minimum(peer, least)
            if (following == peer).all():
                return links, peer
            peer = following

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "task"):
            key = part["task"].to_numpy()
            rep, copies, side = (part[c].to_numpy() for c in ("rep", "copies", "side"))
            raw = part["shingles"].to_pylist()
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            links, peers = np.zeros(len(key), np.int64), np.array(rep)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    links[a:b], peers[a:b] = task(
                        rep[a:b], copies[a:b], side[a:b], [np.frombuffer(x, np.uint64) for x in raw[a:b]]
                    )
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(peers), pa.array(part["large"].to_pylist())], names=["rep", "n_links", "peer", "large"])

    return run


def near_duplicates(docs: DataFrame, similarity: float = 0.8, k: int = 5, recall: float = 0.99999) -> DataFrame:
    """One row per input row: doc_id, text_h, class_key, class_id, n_links.

    ``class_key`` tells classes apart, also those whose least doc_id is the same because
    rows share a doc_id but not a text; it is null for rows that are in no comparison. See
    :func:`jaccard_join` for the rest. Sets go by their 64-bit digest.
    """
    signed = materialize(set_signatures(docs, k), "signatures")
    live = signed.where("doc_id IS NOT NULL AND n > 0")
    groups = materialize(
        live.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")).withColumn("rep", F.col("s1")),
        "sets",
    )
    # Any text of a set will do, as long as it is one.
    first = (live.doc_id == groups.least_id) & (live.s1 == groups.s1) & (live.s2 == groups.s2)
    own = live.join(groups, first, "left_semi").select(F.col("s1").alias("rep"), "doc_id", "text_h", "signature").dropDuplicates(["rep"])
    sets = materialize(own, "reps")
    candidates = connected_components(candidate_edges(sets, similarity, recall)).withColumnRenamed("node", "rep")
    members = materialize(candidates, "candidate-groups")
    large = bounded_broadcast(materialize(members.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "group-sizes"))
    sized = members.join(large, "root").join(groups.groupBy("rep").agg(F.sum("copies").alias("copies")), "rep")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_h"), text_or_empty().cast("binary").alias("text"))
    places = sets.join(members, "rep", "left_semi").select("rep", "doc_id", "text_h")
    wanted = texts.join(places, ["doc_id", "text_h"]).select("rep", "text").dropDuplicates(["rep"])
    shingles = materialize(wanted.mapInArrow(_shingle_rows(k), "rep long, shingles binary"), "shingles")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    placed = sized.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = placed.select("root", "rep", "copies", "block", (F.col("blocks") > 1).alias("large"), other.alias("other")).select(
        F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
        "rep", "copies", F.col("block").alias("side"), "large",
    )
    checked = materialize(
        tasks.join(shingles, "rep").repartition("task").sortWithinPartitions("task", "rep")
        .mapInArrow(_exact(similarity), "rep long, n_links long, peer long, large boolean"),
        "links",
    )
    links = checked.groupBy("rep").agg(F.sum("n_links").alias("n_links"), F.min("peer").alias("peer"), F.max("large").alias("large"))
    roots = connected_components(checked.where("large").select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    label = F.when(F.col("large"), F.coalesce("root", F.col("rep"))).otherwise(F.col("peer"))
    labelled = materialize(
        links.join(roots, links.rep == roots.node, "left").select("rep", "n_links", label.alias("class_key")).join(groups.select("rep", "least_id"), "rep"),
        "labels",
    )
    # A class has the least doc_id of its sets; classes of one set are left out.
    least = labelled.groupBy("class_key").agg(F.min("least_id").alias("class_id"), F.count(F.lit(1)).alias("sets")).where("sets > 1").drop("sets")
    classes = labelled.drop("least_id").join(bounded_broadcast(materialize(least, "classes")), "class_key")
    # Rows of sets that are alone keep themselves; only the others are looked up.
    known = groups.join(classes, "rep", "left").where("copies > 1 OR class_id IS NOT NULL").select(
        "s1", "s2", "n",
        F.coalesce("class_key", "rep").alias("class_key"), F.coalesce("class_id", "least_id").alias("class_id"),
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    rows = signed.select("doc_id", "text_h", "s1", "s2", "n")
    in_play = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return rows.join(known, ["s1", "s2", "n"], "left").select(
        "doc_id", "text_h",
        F.when(in_play, F.coalesce("class_key", "s1")).alias("class_key"),
        F.when(in_play, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(in_play, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def jaccard_join(docs: DataFrame, similarity: float = 0.8, k: int = 5, recall: float = 0.99999) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links.

    Two documents link when the Jaccard similarity of their sets of ``k``-word
    shingles is at least ``similarity``; words are separated by whitespace and compared
    as they are. ``class_id`` is the least doc_id of the documents connected by links,
    ``n_links`` the number of other rows that link to the row, copies included. A text
    of fewer than ``k`` words is one shingle; texts without words, and rows with a null
    doc_id, link to nothing and are their own class. Repeated rows are copies; rows that
    share a doc_id but not a text are documents of their own.
    """
    return near_duplicates(docs, similarity, k, recall).select("doc_id", "class_id", "n_links")
