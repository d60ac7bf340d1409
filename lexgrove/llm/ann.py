"""Approximate nearest neighbours: a robust-pruned directed graph in each shard.

Vectors of equal direction are one node. Nodes go to shards of bounded size by hash; each shard builds its graph
by itself: greedy searches from the medoid and a few other nodes propose neighbours for a batch of nodes, relaxed distance
pruning keeps diverse ones, and reverse edges are pruned the same way. The graphs are stored. Queries
are then streamed past every shard's graph, a beam search visits each, and the best of all shards remain.
Cosines are computed in double precision on the original vectors.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; a query with no candidate has no rows; rows with a null id take no part;
repeated rows (equal id and vector) are one; of rows with equal id and other vectors all are
candidates and each is a query; equal scores (to 12 digits) rank by smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

#: Nodes that a shard has at most, about; nodes inserted, or queries advanced, together.
SHARD_NODES, BATCH = 6_000, 256
STARTS = 32
NODE = "struct<a:long,b:int>"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest value to 0.5 to 1: exact, and squares stay in range."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def beam_search(points: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the beam of each query, best first; -1 fills up. Queries advance together."""
    n, count, degree = len(points), len(queries), graph.shape[1]
    ids = np.full((count, beam), -1, np.int32)
    near = np.full((count, beam), -np.inf, np.float32)
    done = np.ones((count, beam), bool)
    first = queries @ points[starts].T
    order = np.argsort(-first, axis=1, kind="stable")[:, :beam]
    used = order.shape[1]
    ids[:, :used], near[:, :used], done[:, :used] = starts[order], np.take_along_axis(first, order, 1), False
    seen = np.zeros((count, n), bool)
    seen[:, starts] = True
    active = np.arange(count)
    while len(active):
        at = np.argmax(~done[active], axis=1)  # the best one not yet expanded, as beams are sorted
        done[active, at] = True
        found = graph[ids[active, at]]
        fresh = (found >= 0) & ~seen[active[:, None], found]
        seen[np.repeat(active, degree), found.ravel()] |= (found >= 0).ravel()
        score = np.where(fresh, np.einsum("qd,qkd->qk", queries[active], points[found]), -np.inf)
        all_ids = np.concatenate([ids[active], np.where(fresh, found, -1)], 1)
        all_near = np.concatenate([near[active], score], 1)
        all_done = np.concatenate([done[active], ~fresh], 1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        ids[active], near[active], done[active] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_near, all_done))
        active = active[~done[active].all(1)]
    return ids, near


def robust_prune(points: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node up to `degree` of the proposed ids: the nearest one stays, and takes away those that are alpha times nearer to it than to the node."""
    proposed = np.where(proposed == nodes[:, None], -1, np.sort(proposed, axis=1))
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
    vectors = points[proposed]
    gap = 1.0 - np.einsum("nd,nkd->nk", points[nodes], vectors)
    gap[proposed < 0] = np.inf
    between = 1.0 - np.matmul(vectors, vectors.transpose(0, 2, 1))
    out = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    open_gap = gap.copy()
    for k in range(degree):
        best = np.argmin(open_gap, axis=1)
        ok = np.isfinite(open_gap[rows, best])
        if not ok.any():
            break
        out[ok, k] = proposed[rows, best][ok]
        # squared Euclidean distances of unit vectors are twice the gaps, so alpha is squared
        gone = alpha * alpha * between[rows, best] <= gap
        gone[rows, best] = True
        open_gap[gone] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each point (-1 fills up) and the start nodes: the medoid, and some at random lest it lie in a dense group that few edges leave."""
    n = len(points)
    rng = np.random.default_rng(0)
    start = np.unique(np.append(rng.choice(n, min(n, STARTS - 1), replace=False), np.argmax(points @ points.mean(0))))
    graph = rng.integers(0, n, (n, degree)).astype(np.int32) if n > degree else np.tile(np.arange(n, dtype=np.int32), (n, 1))
    if n <= degree:
        return graph, start
    for relaxed in (1.0, alpha):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            nodes = order[low : low + BATCH]
            ids, _ = beam_search(points, graph, points[nodes], start, beam)
            graph[nodes] = robust_prune(points, nodes, np.concatenate([ids, graph[nodes]], 1), degree, relaxed)
            source, target = np.repeat(nodes, degree), graph[nodes].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            own, first, count = np.unique(target, return_index=True, return_counts=True)
            width = int(count.max(initial=0))
            more = np.full((len(own), width), -1, np.int32)
            more[np.repeat(np.arange(len(own)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            free = (graph[own] < 0).sum(1)
            for part in np.array_split(np.arange(len(own)), max(1, len(own) // 512)):
                wide = np.concatenate([graph[own[part]], more[part]], 1)
                pruned = robust_prune(points, own[part], wide, degree, relaxed)
                # nodes with room for their new edges take them without pruning
                room = count[part] <= free[part]
                simple = np.sort(wide[room], axis=1)[:, ::-1].copy()
                simple[:, 1:][simple[:, 1:] == simple[:, :-1]] = -1
                pruned[room] = np.sort(simple, axis=1)[:, ::-1][:, :degree]
                graph[own[part]] = pruned
    return graph, start


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    q, v = scaled(queries.astype(np.float64)), scaled(vectors.astype(np.float64))
    return np.clip((q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1))), -1.0, 1.0)


def cosine(a: Column | str, b: Column | str) -> Column:
    """The same in SQL functions, summed from the first component to the last; each vector is first scaled by a power of two, which is exact."""

    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def near_one(v: Column | str) -> Column:
        power = F.floor(F.log2(F.array_max(F.transform(v, F.abs))))
        half = F.floor(power / 2)
        factors = F.struct(F.pow(F.lit(2.0), -half).alias("p"), F.pow(F.lit(2.0), half - power).alias("q"))
        return bound(factors, lambda f: F.transform(v, lambda x: x * f["p"] * f["q"]))

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda total, p: total + p)
    both = lambda s: dot(s["a"], s["b"]) / (F.sqrt(dot(s["a"], s["a"])) * F.sqrt(dot(s["b"], s["b"])))
    value = bound(F.struct(near_one(a).alias("a"), near_one(b).alias("b")), both)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def closeness(score: Column) -> Column:
    """What ranks go by: cosines that differ in the last digits only, by the order of additions, are ties."""
    return F.floor(score * 1e12 + 0.5)


def usable(vectors: DataFrame) -> DataFrame:
    """id and vector (doubles, as given) of rows that can take part."""
    vector = F.col("embedding").cast("array<double>")
    fit = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), vector.alias("vector"), fit.alias("fit")).where("fit and id is not null").drop("fit")
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (length["n"] if length else 0))


def _stacked(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _direction(vector: str) -> Column:
    """96 bits for the direction: the unit vector's components in steps of 2^-40. Parallel vectors have one direction, but for rare ones that meet a step's edge."""
    v, bound = F.col(vector), lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # value is computed once for all uses in f
    greatest = F.array_max(F.transform(v, F.abs))
    norm = lambda n: F.sqrt(F.aggregate(n, F.lit(0.0), lambda total, x: total + x * x))
    near = bound(greatest, lambda g: F.transform(v, lambda x: x / g))
    sized = bound(near, lambda n: F.struct(n.alias("v"), norm(n).alias("n")))
    steps = bound(sized, lambda s: F.transform(s["v"], lambda x: F.floor(x / s["n"] * float(1 << 40) + 0.5)))
    return bound(steps, lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b")))


INDEX = f"shard int, node {NODE}, first long, vector array<double>, at int, edges array<int>, start boolean"
HITS = f"query {NODE}, node {NODE}, first long, near double"


class _Shard:
    """The graph of one shard, ready for queries."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        own = {c: table[c].chunk(0) for c in ("node", "first", "vector", "edges", "start")}
        self.node, self.first = own["node"], own["first"]
        self.vectors, self.graph = _stacked(own["vector"]), _stacked(own["edges"])
        self.points, self.start = unit(self.vectors), np.flatnonzero(own["start"].to_numpy(zero_copy_only=False))

    def visited(self, asked: pa.RecordBatch, k: int, beam: int) -> Iterator[pa.RecordBatch]:
        """The 2k + 2 nearest nodes of each query's beam, equal ones by their smallest id."""
        questions, first = _stacked(asked.column("vector")), self.first.to_numpy()
        for low in range(0, len(questions), BATCH):
            part = questions[low : low + BATCH]
            ids, _ = beam_search(self.points, self.graph, unit(part), self.start, max(2 * beam, 2 * k + 2))
            q, column = np.nonzero(ids >= 0)
            v = ids[q, column]
            near = cosines(part[q], self.vectors[v])
            order = np.lexsort((first[v], -np.floor(near * 1e12 + 0.5), q))
            place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
            order = order[place < 2 * k + 2]
            q, v = pa.array(q[order] + low), pa.array(v[order])
            yield pa.record_batch([asked.column("node").take(q), self.node.take(v), self.first.take(v), pa.array(near[order])], names=["query", "node", "first", "near"])


def search(vectors: DataFrame, wanted: Column, k: int = 5, degree: int = 32, beam: int = 64) -> DataFrame:
    """query_id, rank, id, score: the k nearest rows found for each row that is wanted (a condition on id)."""
    rows = materialize(usable(vectors).distinct().withColumn("node", _direction("vector")), "vectors")
    # of each direction the k + 1 smallest ids are all that any query can need
    members = rows.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("place") <= k + 1)
    members = materialize(members, "members")
    nodes = members.where("place = 1").select("node", F.col("id").alias("first"), "vector")
    total = nodes.count()
    shards = max(1, -(-total // SHARD_NODES))
    sharded = nodes.withColumn("shard", F.pmod(F.hash("node"), F.lit(shards)))

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        own = {c: table[c].chunk(0) for c in table.column_names}
        graph, start = build_graph(unit(_stacked(own["vector"])), degree, beam)
        edges = pa.array(list(graph), pa.list_(pa.int32()))
        at = np.arange(len(graph), dtype=np.int32)
        yield pa.record_batch([own["shard"], own["node"], own["first"], own["vector"], pa.array(at), edges, pa.array(np.isin(at, start))], names=[f.split()[0] for f in INDEX.split(", ")])

    # a given number of partitions isn't coalesced, and twice the shards leave few of them two
    spread = sharded.select("shard", "node", "first", "vector").repartition(2 * shards, "shard")
    index = materialize(spread.groupBy("shard").applyInArrow(build, INDEX), "graphs")

    asked = materialize(rows.where(wanted).select("id", "node", "vector"), "queries")
    forms = asked.groupBy("node").agg(F.first("vector").alias("vector"))
    visits = forms.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    none = lambda kind: F.lit(None).cast(kind)
    visits = visits.select("shard", "node", none("long").alias("first"), "vector", none("int").alias("at"), none("array<int>").alias("edges"), none("boolean").alias("start"))
    # each shard's graph first, by place, then the queries, streamed past it
    streams = index.unionByName(visits).repartition(2 * shards, "shard").sortWithinPartitions("shard", F.asc_nulls_last("at"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, ready = None, [], None
        for batch in batches:
            of, at = batch.column("shard").to_numpy(), np.asarray(batch.column("at").is_valid())
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (at[1:] != at[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, len(of)], strict=True):
                part = batch.slice(low, high - low)
                if of[low] != shard:
                    shard, held, ready = of[low], [], None
                if at[low]:
                    held.append(part)
                    continue
                ready = ready or _Shard(pa.Table.from_batches(held))
                yield from ready.visited(part, k, beam)

    hits = streams.mapInArrow(visit, HITS)
    best = hits.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(closeness(F.col("near"))), "first"))).where(F.col("place") <= 2 * k + 2)
    best = materialize(best.select("query", "node"), "hits")
    # directions to rows, scored as given: for each query, without itself
    found = best.join(members.select("node", "id", F.col("vector").alias("held")).hint("merge"), "node").select(F.col("query").alias("node"), "id", "held")
    own = asked.select("node", F.col("id").alias("query_id"), "vector").join(found.hint("merge"), "node").where("id != query_id")
    scored = own.select("query_id", "node", "vector", "id", cosine("vector", "held").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", F.xxhash64("vector"), "node").orderBy(F.desc(closeness(F.col("score"))), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
