"""Near-duplicate embeddings with a forest of random-projection trees.

Vectors are compared only within a group (equal labels and lengths). Each tree splits a group again and again at random
directions; vectors near a split go to both sides. Trees grow in rounds: a round fits up to five levels of splits below
every node that is too large, on at most about ``sample`` of its rows, and sends all its rows down. Splits travel by a join
on the node, so their number may grow with the data. Nodes that no direction can divide stay leaves of any size.

Vectors of a leaf are compared by cosine in double precision. A leaf of more than ``block`` vectors is cut into blocks and
each pair of blocks is a unit of work. A pair counts only in the first of the leaves that it shares, so no pair has to be
written to find repeats: a unit gives link counts and, for each vector, the least one it is connected with.

Equal vectors of a group are one class; one of them is searched for all.

Defined results: vectors that are null, empty or zero, that hold null or non-finite components, or whose group is null,
link with nothing. Rows with the same id count as one vector (of several different ones, that with the smallest hash). Rows
without id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import rp_forest as rp
from riskloom.llm.components import components
from riskloom.llm.shared import require, stored
from riskloom.llm.streams import groups


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose lists have one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def leaves(vectors: DataFrame, trees: int, max_leaf: int, sample: int, margin: float) -> DataFrame:
    """``id, leaf`` of ``vectors`` (id, grp, vec); a vector has a leaf or more in each tree."""

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        node, scale = int(rows["node"].iloc[0]), float(rows["scale"].iloc[0])
        tree = rp.fit(node, rp.unit(np.stack(rows["vec"].to_list())), scale, max_leaf, margin)
        return pd.DataFrame({"node": [node], "tree": [tree.tobytes()]})

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known, tree = None, {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts, out = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]]), []
            for lo, hi in zip(starts, [*starts[1:], len(nodes)], strict=True):
                node, part = int(nodes[lo]), batch.slice(lo, hi - lo)
                if node != last:
                    last, known, tree = node, {}, np.frombuffer(part.column(3)[0].as_py(), rp.NODE)
                for place, more, rows in rp.route(node, rp.unit(_matrix(part.column(2))), tree, margin, known):
                    out.append((np.full(len(rows), rp.child(node, place)), rows + lo, np.full(len(rows), more)))
            children, rows, more = (np.concatenate(c) for c in zip(*out, strict=True))
            columns = [pa.array(children), pa.array(ids[rows]), batch.column(2).take(pa.array(rows)), pa.array(more)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "id", "vec", "more"])

    every_tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    state = vectors.select("id", "grp", "vec", every_tree).select(F.xxhash64("tree", "grp").alias("node"), "id", "vec", F.lit(True).alias("more"))
    finished = []
    while True:
        sizes = state.groupBy("node").agg(F.count("*").alias("n"))
        large = stored(sizes.filter(F.col("n") > max_leaf), "large-nodes")
        if large.isEmpty():
            finished.append(state.select("id", "node"))
            break
        sized = state.join(large, "node", "left")
        splits = F.col("n").isNotNull() & F.col("more")
        finished.append(sized.filter(~splits).select("id", "node"))
        open_rows = sized.filter(splits)
        share = F.pmod(F.xxhash64("id", "node"), F.lit(1_000_003)) / 1_000_003.0
        sampled = open_rows.filter(share < F.lit(float(sample)) / F.col("n"))
        sampled = sampled.withColumn("scale", F.greatest(F.col("n") / float(sample), F.lit(1.0)))
        models = sampled.select("node", "vec", "scale").groupBy("node").applyInPandas(fitted, "node long, tree binary")
        # every large node has a model unless its whole sample was empty; such a node stays a leaf
        met = open_rows.join(stored(models, "splits"), "node", "left")
        finished.append(met.filter("tree is null").select("id", "node"))
        down = met.filter("tree is not null").select("node", "id", "vec", "tree")
        down = down.sortWithinPartitions("node")  # so that a node's rows come together
        state = stored(down.mapInArrow(routed, "node long, id long, vec array<float>, more boolean"), "tree-rows")
    out = finished[0]
    for part in finished[1:]:
        out = out.unionAll(part)
    return out.select("id", F.col("node").alias("leaf"))


def _unit_links(units: DataFrame, threshold: float) -> DataFrame:
    """``id, links, root`` of ``units`` (unit, id, copies, leaf, side, own, vec, leaves)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            if table.num_rows < 2:
                continue
            ids, copies, leaf, side, own = (table.column(i).to_numpy() for i in range(1, 6))
            x = rp.unit(_matrix(table.column("vec")))
            linked = x @ x.T >= threshold
            if not own[0]:
                linked &= side[:, None] != side[None, :]
            linked &= ids[:, None] != ids[None, :]
            hit = np.flatnonzero(linked.any(axis=1))
            if not len(hit):
                continue
            ids, copies, linked = ids[hit], copies[hit], linked[np.ix_(hit, hit)]
            lists = table.column("leaves").take(pa.array(hit)).combine_chunks()
            others, rows = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            rows, others = rows[others < leaf[0]], others[others < leaf[0]]
            earlier, place, held = np.unique(others, return_inverse=True, return_counts=True)
            for shared in np.array_split(np.flatnonzero(held > 1), max(1, -(-len(earlier) // 1024))):
                # pairs that share an earlier leaf have been counted there
                column = np.full(len(earlier), -1)
                column[shared] = np.arange(len(shared))
                mine = column[place] >= 0
                shares = np.zeros((len(ids), len(shared)), dtype=np.float32)
                shares[rows[mine], column[place][mine]] = 1
                linked &= shares @ shares.T == 0
            hit = np.flatnonzero(linked.any(axis=1))
            order = hit[np.argsort(ids[hit])]
            inner = linked[np.ix_(order, order)]
            links = inner @ copies[order]
            root = ids[order][rp.least_reached(inner)]
            columns = (ids[order], links.astype(np.int64), root)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "links", "root"])

    dealt = units.repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(compare, "id long, links long, root long")


def embedding_dedup(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    group: str = "label",
    *,
    threshold: float = 0.93,
    trees: int = 10,
    max_leaf: int = 256,
    sample: int = 2_048,
    spill: float = 0.5,
    block: int = 512,
) -> DataFrame:
    """One row for each id: ``vec_id, n_links, component_id``.

    ``spill`` is the half width of the overlap at a split, in standard deviations of the projected difference of two vectors
    that are just similar enough.
    """
    require(vectors, (key, vector, group))
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[group].alias("label"), vectors[vector].cast("array<float>").alias("vec"))
    rows = rows.filter("vec_id is not null")
    sound = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    valid = F.coalesce(F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & sound, F.lit(False))
    grp = F.xxhash64(F.col("label"), F.size("vec"))
    keyed = rows.select(
        "vec_id",
        "vec",
        F.when(valid, F.struct(F.xxhash64("label", "vec").alias("a"), F.xxhash64(F.lit(1), "vec", "label").alias("b"), grp.alias("grp"))).alias("k"),
    )
    single = keyed.groupBy("vec_id").agg(F.min("k").alias("k")).select("vec_id", "k.*")
    first = F.min(F.struct("vec_id", "vec"))
    vecs = keyed.filter("k is not null").groupBy("k.a", "k.b").agg(first.alias("f")).select("a", "b", F.col("f.vec").alias("vec"))
    sets = single.filter("a is not null").groupBy("a", "b", "grp").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = stored(sets.join(vecs, ["a", "b"]).select("id", "a", "b", "grp", "copies", "vec"), "vector-classes")

    size = classes.agg(F.max(F.size("vec"))).first()[0] or 1
    margin = spill * float(np.sqrt((2 - 2 * threshold) / size))
    found = stored(leaves(classes.select("id", "grp", "vec"), trees, max_leaf, sample, margin), "leaves")
    blocks = found.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    of_vector = found.groupBy("id").agg(F.collect_set("leaf").alias("leaves"))
    members = found.join(blocks, "leaf").withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    units = members.select(
        F.xxhash64("leaf", low, high).alias("unit"),
        "id",
        "leaf",
        (F.col("mine") == high).cast("int").alias("side"),
        (F.col("mine") == F.col("other")).cast("int").alias("own"),
    )
    full = units.join(classes.select("id", "copies", "vec"), "id").join(of_vector, "id")
    links = stored(
        _unit_links(full.select("unit", "id", "copies", "leaf", "side", "own", "vec", "leaves"), threshold), "vector-links"
    )
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(links.select(F.col("id").alias("u"), F.col("root").alias("v")))
    answers = (
        classes.select("id", "a", "b", "copies")
        .join(counted, "id", "left")
        .join(reached.select(F.col("node").alias("id"), "component"), "id", "left")
    )
    return single.join(answers, ["a", "b"], "left").select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "id", "vec_id").alias("component_id"),
    )
