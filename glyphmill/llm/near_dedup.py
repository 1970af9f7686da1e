"""MinHash near-duplicate detection with an LSH forest and exact confirmation.

Texts are sets of distinct five-word shingles. Texts with equal sets collapse to one
node first (a group of exact copies, however large, costs one node). Each node has a
signature of ``TREES`` x ``DEPTH`` min-hashes; tree ``t`` is the order of the nodes by
the ``t``-th run of ``DEPTH`` values.

* **Candidates.** Nodes whose longest common prefix in some tree has ``MIN_PREFIX`` values
  or more are neighbours. A region starts as a prefix of ``MIN_PREFIX`` values; while it
  holds more than ``REGION`` nodes it is parted by one more value, so depth follows
  density, tree by tree. Inside a region, which is read in the order of its signatures, all
  nodes are compared by signature (estimate at least ``ESTIMATE``, more than five standard
  deviations below the threshold) and a spanning forest is kept. A pair at Jaccard 0.85
  misses all regions with probability (1 - 0.85^4)^32 < 1e-10 where regions are shallow
  and (1 - 0.85^8)^32 < 4e-5 where every tree is at its full depth.
* **Dense regions.** More than ``REGION`` nodes that agree in all ``DEPTH`` values of a tree
  are not searched or cut: they become one cluster, and the next steps handle it exactly.
* **Clusters.** Connected candidates form clusters; links can exist only within one.
* **Confirmation.** Clusters are cut into blocks of bounded rows and shingles. A block
  counts the exact intersections of all its pairs (a 0/1 matrix product over the
  shingles that occur twice) and keeps a spanning forest of the true links, rooted at
  the nodes with most links. A cluster of one block is finished then. A larger one goes
  through two independent random blockings, and a third in which every block also holds
  the cluster's ``PIVOTS`` busiest roots: both take linear work and join what is dense or
  hangs on few originals. After components are formed, the adaptive step compares the
  remaining blocks, except those whose members are all in one component already.

No group is gathered in one task, no pairs are emitted (only forests of at most n - 1
edges a block), and components are found by distributed joins.

Defined results: null, empty and wordless texts have an empty set, are linked with
nothing and kept; a row with a null id is linked with nothing, has a null component and
is kept; rows that share an id are linked with what any of them is linked with; equal
texts are always linked; texts of any length are taken whole; an empty table gives an
empty result. Ids are longs, others count as null. Clashing added columns get an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .support import fresh, materialise, small
from .wordcols import Words, lean, mix, slices

TREES, DEPTH, MIN_PREFIX = 32, 8, 4
REGION = 256
ESTIMATE = 0.70
THRESHOLD_PERCENT = 85
BLOCK_ROWS, BLOCK_SHINGLES = 112, 400_000
PIVOTS = 16
#: Columns of the shingle matrix that are multiplied at once.
_COLUMNS = 8192

_FACTORS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``TREES * DEPTH`` 16-bit min-hashes (big-endian, tree by tree) per non-empty set."""
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    out = np.empty((len(begins), len(_FACTORS)), dtype=">u2")
    for j, factor in enumerate(_FACTORS):
        lowest = np.minimum.reduceat(values * factor, begins) if len(begins) else np.zeros(0, dtype=np.uint64)
        out[:, j] = (mix(lowest) >> np.uint64(48)).astype(np.uint16)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            values, offsets = Words.of(part.column(1)).shingle_sets()
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            a, b = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
            if len(full):
                a[full] = np.add.reduceat(mix(values), offsets[:-1][full])
                b[full] = np.bitwise_xor.reduceat(mix(values + np.uint64(0x632BE59BD9B4E019)), offsets[:-1][full])
            sig = signatures(values, offsets)
            made: list[bytes | None] = [None] * len(n)
            for i, row in zip(full, sig, strict=True):
                made[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(made, pa.binary())],
                ["doc_id", "n_shingles", "set_a", "set_b", "sig"],
            )


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Splits sorted batches into tables that end where a key ends; equal keys are never parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last = [held[-1].column(held[-1].schema.get_field_index(k))[held[-1].num_rows - 1] for k in keys]
            same = all(batch.column(batch.schema.get_field_index(k))[batch.num_rows - 1] == x for k, x in zip(keys, last, strict=True))
            if same:
                held.append(batch)
                continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if held:
            first = [batch.column(batch.schema.get_field_index(k))[0] for k in keys]
            if cut == 0 and any(x != y for x, y in zip(first, last, strict=True)):
                yield pa.Table.from_batches(held)
                held = [batch]
                continue
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _bounds(*keys: np.ndarray) -> np.ndarray:
    change = np.ones(len(keys[0]) + 1, dtype=bool)
    change[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(change)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a symmetric boolean matrix, as stars around each part's node of highest degree."""
    n = len(linked)
    todo = np.ones(n, dtype=bool)
    out = []
    for root in np.argsort(-linked.sum(axis=1), kind="stable").tolist():
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            reached = np.flatnonzero(linked[front.pop()] & todo)
            todo[reached] = False
            out += [(root, int(x)) for x in reached]
            front += reached.tolist()
    return out


_EDGES = "u long, v long"


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


def _search_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of signature-similar nodes for rows (key, rep, sig) that are sorted by key."""
    width = TREES * DEPTH
    for table in runs(batches, ["key"]):
        table = table.combine_chunks()
        keys, reps = table.column("key").to_numpy(), table.column("rep").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, width)
        bounds = _bounds(keys)
        sizes = np.diff(bounds)
        pairs = bounds[:-1][sizes == 2]
        close = (sig[pairs] == sig[pairs + 1]).mean(axis=1) >= ESTIMATE if len(pairs) else np.zeros(0, bool)
        edges = list(zip(reps[pairs[close]].tolist(), reps[pairs[close] + 1].tolist(), strict=True))
        for at, size in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            own = sig[at : at + size]
            linked = np.stack([(own == row).mean(axis=1) >= ESTIMATE for row in own])
            edges += [(int(reps[at + x]), int(reps[at + y])) for x, y in _forest(linked)]
        if edges:
            yield _edge_batch(edges)


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each text's sorted shingle set (as bytes); the text itself is dropped."""
    for batch in batches:
        for part in slices(batch, "text"):
            values, offsets = Words.of(part.column(part.schema.get_field_index("text"))).shingle_sets()
            made = [values[offsets[i] : offsets[i + 1]].tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], ["rep", "cluster", "set"])


def exact_links(sets: list[np.ndarray], percent: int = THRESHOLD_PERCENT) -> np.ndarray:
    """Symmetric matrix of the pairs whose sets have Jaccard similarity of at least ``percent`` %."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n == 2:
        common = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2)
        common[1] = common[1][::-1]
        np.fill_diagonal(common, sizes)
    else:
        row = np.repeat(np.arange(n), sizes)
        values = np.concatenate(sets) if n else np.zeros(0, dtype=np.uint64)
        order = np.argsort(values, kind="stable")
        row, values = row[order], values[order]
        bounds = _bounds(values) if len(values) else np.zeros(1, dtype=np.int64)
        often = np.diff(bounds) > 1
        column = np.repeat(np.where(often, np.cumsum(often) - 1, -1), np.diff(bounds))
        row, column = row[column >= 0], column[column >= 0]
        common = np.zeros((n, n), dtype=np.float32)
        for at in range(0, int(often.sum()), _COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + _COLUMNS])
            block = np.zeros((n, min(_COLUMNS, int(often.sum()) - at)), dtype=np.float32)
            block[row[lo:hi], column[lo:hi] - at] = 1
            common += block @ block.T
        common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    linked = (100 * common >= percent * union) & (sizes[:, None] > 0) & (sizes[None, :] > 0)
    np.fill_diagonal(linked, False)
    return linked


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of exact links for rows (cluster, x, y, rep, set) that are sorted by block (cluster, x, y)."""
    for table in runs(batches, ["cluster", "x", "y"]):
        reps = table.column("rep").to_numpy()
        bounds = _bounds(*[table.column(k).to_numpy() for k in ("cluster", "x", "y")])
        sets = table.column("set")
        edges: list[tuple[int, int]] = []
        for at, to in zip(bounds[:-1], bounds[1:], strict=True):
            if to - at > 1:
                own = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in sets.slice(at, to - at)]
                edges += [(int(reps[at + a]), int(reps[at + b])) for a, b in _forest(exact_links(own))]
        if edges:
            yield _edge_batch(edges)


def _blocked(rows: DataFrame) -> DataFrame:
    return rows.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y").select("cluster", "x", "y", "rep", "set").mapInArrow(lean(_confirm), _EDGES)


def node_table(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows of (``doc_id``, ``text``), and the nodes: one ``rep`` per distinct set."""
    signed = materialise(docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").mapInArrow(lean(_sign), "doc_id long, n_shingles long, set_a long, set_b long, sig binary"), "near-signatures")
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = materialise(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")), "near-nodes")
    return signed, reps


def candidate_edges(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """Spanning edges of everything that can be linked (see the module's text)."""
    nodes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), "set_a", "set_b", "sig")
    nodes = materialise(nodes.join(reps.select("set_a", "set_b", "rep"), ["set_a", "set_b", "rep"], "left_semi").select("rep", "sig"), "near-node-signatures")
    prefix = lambda depth: F.substring("sig", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * depth))
    trees = nodes.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    entries = trees.select("rep", "tree", prefix(DEPTH).alias("run"), F.xxhash64("tree", prefix(MIN_PREFIX)).alias("key"))
    settled, dense = None, None
    for depth in range(MIN_PREFIX, DEPTH + 1):
        if depth > MIN_PREFIX:
            entries = entries.select("rep", "tree", "run", F.xxhash64("tree", F.substring("run", 1, 2 * depth)).alias("key"))
        regions = materialise(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("hub")).where("size > 1"), "near-regions")
        members = materialise(entries.join(small(regions, regions.count()), "key"), "near-region-members")
        fits = members.where(F.col("size") <= REGION).select("key", "rep")
        settled = fits if settled is None else settled.unionByName(fits)
        dense = members.where(F.col("size") > REGION)
        if dense.isEmpty():
            break
        entries = dense.select("rep", "tree", "run")
    searched = settled.join(nodes, "rep").select("key", "rep", "sig")
    found = searched.repartition("key").sortWithinPartitions("key", "sig").mapInArrow(lean(_search_regions), _EDGES)
    whole = dense.where("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    return found.unionByName(whole)


def _share(rows: str, shingles: str) -> Column:
    """Blocks that so many rows and shingles fill."""
    return F.greatest(F.col(rows) / BLOCK_ROWS, F.col(shingles) / BLOCK_SHINGLES)


def exact_edges(docs: DataFrame, reps: DataFrame, clusters: DataFrame) -> DataFrame:
    """Spanning edges of the true links inside ``clusters`` (``node``, ``label``)."""
    weights = reps.groupBy("rep").agg(F.max("n").alias("n"))
    sizes = clusters.join(weights, F.col("node") == F.col("rep")).groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    blocks = F.least(F.ceil(_share("rows", "shingles")), F.col("rows")).cast("int")
    sizes = materialise(sizes.select(F.col("label").alias("cluster"), blocks.alias("blocks")), "near-cluster-sizes")
    placed = clusters.select(F.col("node").alias("doc_id"), F.col("label").alias("cluster"))
    texts = docs.join(small(placed, placed.count()), "doc_id").select("doc_id", "cluster", "text")
    sets = materialise(texts.mapInArrow(lean(_spell), "rep long, cluster long, set binary"), "near-sets")
    sized = sets.join(small(sizes, sizes.count()), "cluster")
    salts = F.when(F.col("blocks") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    place = lambda x: F.pmod(F.xxhash64("rep", x), F.col("blocks")).cast("int")
    first = sized.select("cluster", "rep", "set", "blocks", F.explode(salts).alias("x")).withColumn("y", place(F.col("x")))
    edges = materialise(_blocked(first), "near-links")
    if sizes.where("blocks > 1").isEmpty():
        return edges
    large = materialise(sized.where("blocks > 1"), "near-large-clusters")
    edges = materialise(edges.unionByName(_pivot_edges(large, edges)), "near-links")
    return edges.unionByName(_rest_edges(large, connected_components(edges)))


def _pivot_edges(large: DataFrame, edges: DataFrame) -> DataFrame:
    """Links of a random blocking whose blocks all hold the nodes of the cluster that are roots of most links."""
    roots = edges.groupBy(F.col("u").alias("rep")).agg(F.count(F.lit(1)).alias("links"))
    busiest = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("links"), "rep"))
    ranked = large.select("cluster", "rep").join(roots, "rep").withColumn("rank", busiest).where(F.col("rank") <= PIVOTS)
    pivots = large.join(ranked.select("rep"), "rep", "left_semi")
    everywhere = pivots.select("cluster", "rep", "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    dealt = large.select("cluster", "rep", "set", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int").alias("y"))
    once = dealt.join(ranked.select("rep"), "rep", "left_anti").select("cluster", "rep", "set", "y")
    return _blocked(once.unionByName(everywhere).withColumn("x", F.lit(2)))


def _rest_edges(large: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between blocks of ``large`` clusters, but for pairs of blocks inside one component of ``labels``."""
    inside = large.select("cluster", "rep", "set").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    inside = materialise(inside, "near-large-labelled")
    #: Labels that fill half a block get blocks of their own ("pure"); the rest share blocks.
    counts = materialise(inside.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("set") / 8).alias("shingles")), "near-labels-of-clusters")
    pure = counts.where(_share("rows", "shingles") >= 0.5).select("cluster", "label", F.ceil(_share("rows", "shingles")).cast("int").alias("own"))
    rest = counts.where(_share("rows", "shingles") < 0.5).groupBy("cluster").agg(F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    rest = rest.select("cluster", F.lit(None).cast("long").alias("label"), F.ceil(_share("rows", "shingles")).cast("int").alias("own"))
    #: Blocks of a cluster are numbered through; there is a row here for half a block of nodes at least.
    before = F.sum("own").over(Window.partitionBy("cluster").orderBy(F.col("label").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    parts = pure.unionByName(rest).withColumn("from", F.coalesce(before, F.lit(0)).cast("int")).withColumn("total", F.sum("own").over(Window.partitionBy("cluster")).cast("int"))
    parts = materialise(parts, "near-blocks")
    numbered = parts.select("cluster", "label", "total", F.explode(F.sequence("from", F.col("from") + F.col("own") - 1)).alias("x"))
    meets = numbered.select("cluster", "label", "x", F.explode(F.sequence("x", F.col("total") - 1)).alias("y"))
    other = numbered.select("cluster", F.col("label").alias("other"), F.col("x").alias("y"))
    tasks = meets.join(other, ["cluster", "y"]).where("label IS NULL OR other IS NULL OR label <> other").select("cluster", "x", "y")
    tasks = materialise(tasks, "near-block-pairs")
    n_tasks = tasks.count()
    visits = tasks.select("cluster", F.col("x").alias("block"), "x", "y").unionByName(tasks.where("x <> y").select("cluster", F.col("y").alias("block"), "x", "y"))
    n_parts = parts.count()
    own = inside.join(small(parts.where("label IS NOT NULL").select("cluster", "label", "own", "from"), n_parts), ["cluster", "label"], "left")
    shared = parts.where("label IS NULL").select("cluster", F.col("own").alias("rest_own"), F.col("from").alias("rest_from"))
    own = own.join(small(shared, n_parts), "cluster", "left")
    block = F.coalesce("from", "rest_from") + F.pmod(F.xxhash64("rep"), F.coalesce("own", "rest_own")).cast("int")
    own = own.select("cluster", "rep", "set", block.alias("block"))
    return _blocked(own.join(small(visits, 2 * n_tasks), ["cluster", "block"]))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    texts = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed, reps = node_table(texts)
    clusters = connected_components(candidate_edges(signed, reps))
    labels = connected_components(exact_edges(texts, reps, clusters))
    named = materialise(reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("label", "rep").alias("component_id")), "near-labels")
    rows = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component, the one with the smallest id."""
    (mark,) = fresh(docs, "near_dropped")
    found = near_components(docs, id_col, text_col)
    dropped = materialise(found.where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct(), "near-dropped")
    kept = docs.join(small(dropped.withColumn(mark, F.lit(True)), dropped.count()), id_col, "left").where(F.col(mark).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if repeated.isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
