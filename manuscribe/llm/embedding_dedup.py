"""Embedding near-duplicates by NN-descent.

Equal vectors form one class. Random-projection blocks start a neighbour graph
of K entries a class. Each round joins neighbours of neighbours: around every
centre, forward and reverse neighbours meet and keep their better partners.
A hub's reverse neighbours meet in salted groups, none is left out. Lists bound
only where the descent looks: whatever vectors a group of them shows to be
connected by links is stored apart, as pairs with the smallest id that each
reaches in the group, and components come from all such pairs. A list full of
links is saturated: it is enlarged by K neighbours from outside its component,
so the descent goes on across components until none grows. An audit compares a
hashed sample of queries with brute force over all rows, by links and by
vectors with all their links. While it fails, K doubles and new projections are
added; if it still fails after `most_rounds`, all vectors are compared with
all, block by block. The links that the audit sees count too. At last every
list is enlarged to its whole component, block by block, so that link counts
are exact within components while only counts are kept.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, checked_broadcast, components, groups_of, joined

EDGES = "u long, v long, sim double"
#: Rows handed to Python in one group, about; vectors of a block.
GROUP_ROWS, BLOCK = 20_000, 512
#: Vectors of a block where all are compared with all; similarities around centres that are held at once.
ALL_ROWS, CELLS = 2048, 250_000


def _clean(double: bool) -> Callable:
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                v = None
                if x.is_valid and len(x) and not x.values.null_count:
                    a = x.values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(a).all() and a.any():
                        v = a.tobytes()
                out.append(v)
            keys = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["id", "key", "v"])

    return run


def _unit(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """Rows of unit length, in double precision."""
    raw = column.to_pylist()
    m = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _codes(kind, dim_seed: int, tables: int, depth: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes = len(batch), np.array([len(x) for x in batch.column(1).to_pylist()])
            code = np.zeros((n, tables), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                m = _unit(batch.column(1).take(pa.array(rows)), kind)
                planes = np.random.default_rng(dim_seed).standard_normal((m.shape[1], tables * max(depth, 1)))
                bits = (m @ planes > 0).reshape(len(rows), tables, -1)[:, :, :depth].astype(np.int64)
                code[rows] = (bits << np.arange(depth)).sum(axis=2) + (int(size) << 40)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * tables, pa.int32()), pa.array(code.ravel()))], ["id", "codes"])

    return run


def _reached(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """joined(), without a similarity."""
    a, b = joined(ids, linked)
    return a, b, np.full(len(a), np.nan)


def _best(ids: np.ndarray, sims: np.ndarray, k: int, threshold: float, floor: np.ndarray, outer: np.ndarray, comp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one group's similarity matrix: each row's k best partners over `floor`, its k best of other components over `outer`, and what links join."""
    np.fill_diagonal(sims, -2)
    out = [_reached(ids, sims >= threshold)]
    top = min(k, len(ids) - 1)
    same = comp[:, None] == comp[None, :]
    apart = len(np.unique(comp)) == len(comp)
    for least in (outer,) if apart else (floor, outer):
        if least is outer and not apart:
            sims = np.where(same, -2, sims)
        part = np.argpartition(-sims, top - 1, axis=1)[:, :top]
        s = np.take_along_axis(sims, part, axis=1)
        r, c = np.nonzero(s > least[:, None])
        out.append((ids[r], ids[part[r, c]], s[r, c]))
    return out


def _best_of_each(ids: np.ndarray, sims: np.ndarray, k: int, threshold: float, floor: np.ndarray, outer: np.ndarray, comp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """_best() of many groups of one size: every argument has a first axis more, that of the groups."""
    size = ids.shape[1]
    sims[:, np.arange(size), np.arange(size)] = -2
    linked = sims >= threshold
    out = [_reached(ids[i], linked[i]) for i in np.flatnonzero(linked.any(axis=(1, 2)))]
    top = min(k, size - 1)
    same = comp[:, :, None] == comp[:, None, :]
    mixed = np.flatnonzero(same.sum(axis=(1, 2)) > size)
    masked = np.where(same, -2, sims)
    for who, part_of, least in ((mixed, sims, floor), (slice(None), masked, outer)):
        named, near, least = ids[who], part_of[who], least[who]
        part = np.argpartition(-near, top - 1, axis=2)[:, :, :top]
        s = np.take_along_axis(near, part, axis=2)
        i, r, c = np.nonzero(s > least[:, :, None])
        out.append((named[i, r], named[i, part[i, r, c]], s[i, r, c]))
    return out


def _edges(parts: list) -> pa.Table:
    u, v, s = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3))
    return pa.table({"u": u.astype(np.int64), "v": v.astype(np.int64), "sim": pa.array(s.astype(np.float64), from_pandas=True)})


def _top(edges: DataFrame, k: int, comp: DataFrame) -> DataFrame:
    """Each class's k best neighbours (rank), and its k best outside its component (outer)."""
    e = edges.filter("sim IS NOT NULL").repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    e = e.join(comp.select(F.col("node").alias("u"), F.col("comp").alias("cu")), "u", "left").join(comp.select(F.col("node").alias("v"), F.col("comp").alias("cv")), "v", "left")
    e = e.withColumn("apart", F.coalesce(F.col("cu") != F.col("cv"), F.lit(True)))
    best = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    e = e.withColumn("rank", F.row_number().over(best)).withColumn("outer", F.when(F.col("apart"), F.count_if("apart").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")))
    return e.filter((F.col("rank") <= k) | (F.col("outer") <= k)).select("u", "v", "sim", "rank", "outer")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    k: int = 12,
    tables: int = 3,
    most_rounds: int = 4,
    audit_rows: int = 1000,
    recall: float = 0.999,
) -> DataFrame:
    """id_col, n_links, component_id, kept: vectors with cosine >= threshold are linked.

    Cosines are taken in double precision. Null, empty and zero vectors and such
    with null or non-finite components link with nothing, nor do vectors of
    different lengths with each other. Repeated ids with equal vectors count as
    vectors of their own in n_links. A null id is never compared: 0 links, null
    component, kept. Vectors at exactly the threshold are linked; of neighbours
    of equal cosine lists keep the smaller id, which changes no result. An empty
    table gives an empty result. Further columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nndescent")
    double = "double" in dict(vectors.dtypes)[vector_col]
    kind = np.float64 if double else np.float32
    rows = scratch.keep(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(_clean(double), "id long, key binary, v binary"), "rows")
    valid = rows.filter("key IS NOT NULL AND id IS NOT NULL")
    classes = scratch.keep(valid.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("cnt")), "classes")
    own = valid.join(classes, "key").filter("id = rep").dropDuplicates(["id"]).select("id", "cnt", "v")
    reps = scratch.keep(own, "reps")
    n = reps.count()

    depth = max(0, math.ceil(math.log2(max(1, n / (BLOCK // 2)))))
    def start(table: pa.Table) -> pa.Table:
        parts = []
        for _, g in groups_of(table, "block"):
            ids, m = g["id"].to_numpy(), _unit(g["v"], kind)
            if len(ids) > 1:
                low = np.full(len(ids), -2.0)
                parts += _best(ids, m @ m.T, k, threshold, low, low, ids)
        return _edges(parts)

    def project(seed: int) -> DataFrame:
        """What blocks of `tables` random projections show."""
        coded = scratch.keep(reps.select("id", "v").mapInArrow(_codes(kind, seed, tables, depth), "id long, codes array<long>").select("id", F.posexplode("codes").alias("t", "code")), "codes")
        sizes = coded.groupBy("t", "code").agg(F.count("*").alias("c"))
        salt = F.pmod(F.xxhash64("id", "t", F.lit(seed)), F.ceil(F.col("c") / BLOCK))
        dealt = coded.join(sizes, ["t", "code"]).select("id", F.xxhash64("t", "code", salt).alias("block")).join(reps.select("id", "v"), "id")
        groups = 1 + n * tables // GROUP_ROWS
        return scratch.keep(dealt.withColumn("g", F.pmod("block", F.lit(groups))).groupBy("g").applyInArrow(start, EDGES), "start")

    def compare_all() -> DataFrame:
        """(a, b): what the links of all vectors connect, each compared with each, block by block."""
        chunks = math.ceil(n / ALL_ROWS)
        other = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
        dealt = reps.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("i")).withColumn("j", other)
        dealt = dealt.select("id", "v", "i", F.least("i", "j").alias("bi"), F.greatest("i", "j").alias("bj"))

        def compare(table: pa.Table) -> pa.Table:
            parts = []
            size = np.array([len(x) for x in table["v"].to_pylist()])
            for one in np.unique(size):
                rows = np.flatnonzero(size == one)
                g = table.take(pa.array(rows))
                i, d, m = g["i"].to_numpy(), g["id"].to_numpy(), _unit(g["v"], kind)
                a, b = np.flatnonzero(i == g["bi"][0].as_py()), np.flatnonzero(i == g["bj"][0].as_py())
                hit = (m[a] @ m[b].T) >= threshold
                hit &= d[a][:, None] != d[b][None, :]
                x, y = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
                ids = np.unique(np.concatenate([d[a][x], d[b][y]]))
                linked = np.zeros((len(ids), len(ids)), bool)
                p, q = np.searchsorted(ids, d[a][x]), np.searchsorted(ids, d[b][y])
                linked[np.ix_(p, q)] |= hit[np.ix_(x, y)]
                parts.append(_reached(ids, linked | linked.T))
            return _edges(parts)

        return dealt.groupBy("bi", "bj").applyInArrow(compare, EDGES).select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()

    found = project(11)
    joined = found.filter("sim IS NULL").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
    comp = components(scratch, joined)
    knn = scratch.keep(_top(found, k, comp), "graph")
    extent = comp.agg(F.count("*").alias("nodes"), F.count_distinct("comp").alias("comps")).first()

    def descend(table: pa.Table) -> pa.Table:
        """Members around each centre, each with each; centres of equally many members together."""
        parts = []
        sizes = pc.binary_length(table["v"]).to_numpy()
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            rows = rows[np.lexsort([table[c].to_numpy()[rows] for c in ("member", "salt", "center")])]
            center, salt, member = (table[c].to_numpy()[rows] for c in ("center", "salt", "member"))
            ids, at, row = np.unique(member, return_index=True, return_inverse=True)
            m = _unit(table["v"].take(pa.array(rows[at])), kind)
            floor, outer, side = (table[c].to_numpy()[rows[at]] for c in ("floor", "out", "comp"))
            cut = np.flatnonzero(np.append(True, (center[1:] != center[:-1]) | (salt[1:] != salt[:-1])))
            many = np.diff(np.append(cut, len(row)))
            for s in np.unique(many[many > 1]).tolist():
                first, step = cut[many == s], max(1, CELLS // s**2)
                for lo in range(0, len(first), step):
                    at = row[first[lo : lo + step, None] + np.arange(s)]
                    x = m[at]
                    parts += _best_of_each(ids[at], x @ x.transpose(0, 2, 1), k, threshold, floor[at], outer[at], side[at])
        return _edges(parts)

    audit = reps.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(audit_rows).select("id", "v").toArrow()
    asked = spark.sparkContext.broadcast((audit["id"].to_numpy(), audit["v"].to_pylist()))

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw = asked.value
        sizes = np.array([len(x) for x in raw])
        for batch in batches:
            mine, own = batch.column(0).to_numpy(), np.array([len(x) for x in batch.column(1).to_pylist()])
            parts = []
            for size in np.intersect1d(sizes, own):
                q, r = np.flatnonzero(sizes == size), np.flatnonzero(own == size)
                sims = _unit(pa.array([raw[i] for i in q], pa.binary()), kind) @ _unit(batch.column(1).take(pa.array(r)), kind).T
                x, y = np.nonzero(sims >= threshold)
                x, y = q[x], r[y]
                some = ids[x] != mine[y]
                parts.append((ids[x][some], mine[y][some], np.ones(int(some.sum()))))
            yield from _edges(parts).to_batches()

    true = scratch.keep(reps.select("id", "v").mapInArrow(truth, EDGES).select("u", "v"), "audit")
    # where all vectors fit a broadcast they join rows already dealt, and are not shuffled themselves
    wide = reps.select("id", "v", *[F.lit(0.0).alias(c) for c in ("floor", "out", "comp")])
    few = checked_broadcast(wide, most_bytes=32 << 20) is not wide
    for step in itertools.count():
        floor = knn.groupBy("u").agg(F.min(F.when(F.col("rank") == k, F.col("sim"))).alias("floor"), F.min(F.when(F.col("outer") == k, F.col("sim"))).alias("out")).withColumnRenamed("u", "id")
        known = reps.select("id", "v").join(floor, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
        known = known.select(F.col("id").alias("member"), "v", F.coalesce("floor", F.lit(-2.0)).alias("floor"), F.coalesce("out", F.lit(-2.0)).alias("out"), F.coalesce("comp", "id").alias("comp"))
        back = knn.groupBy("v").agg(F.ceil(F.count("*") / F.lit(4.0 * k)).alias("salts")).withColumnRenamed("v", "center")
        near = knn.select(F.col("u").alias("center"), F.col("v").alias("member"))
        far = knn.select(F.col("v").alias("center"), F.col("u").alias("member"))
        split = near.join(back, "center", "left").select("center", "member", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        met = split.unionByName(far.join(back, "center").select("center", "member", F.pmod(F.xxhash64("member"), F.col("salts")).alias("salt")))
        groups = 1 + n * 2 * k // GROUP_ROWS
        met = met.withColumn("g", F.pmod(F.xxhash64("center", "salt"), F.lit(groups)))
        dealt = met.repartition("g").distinct().join(F.broadcast(known), "member") if few else met.distinct().join(known, "member")
        found = scratch.keep(dealt.groupBy("g").applyInArrow(descend, EDGES), f"found-{step}")
        joined = found.filter("sim IS NULL").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
        comp = components(scratch, comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(joined))
        new = scratch.keep(_top(knn.select("u", "v", "sim").unionByName(found), k, comp), f"graph-{step}")
        scratch.drop(knn)
        scratch.drop(found)
        knn = new
        side = comp.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
        other = comp.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
        audited = true.join(side, "u", "left").join(other, "v", "left").withColumn("hit", F.coalesce(F.col("cu") == F.col("cv"), F.lit(False)))
        seen = audited.groupBy("u").agg(F.count("*").alias("n"), F.count_if("hit").alias("hit"))
        seen = seen.agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.count("*").alias("vectors"), F.count_if(F.col("n") == F.col("hit")).alias("whole")).na.fill(0).first()
        before, extent = extent, comp.agg(F.count("*").alias("nodes"), F.count_distinct("comp").alias("comps")).first()
        passed = seen["hit"] >= recall * seen["n"] and seen["whole"] >= recall * seen["vectors"]
        if passed and extent == before:
            break
        if not passed and step + 1 >= most_rounds:
            comp = components(scratch, comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(compare_all()))
            break
        if not passed:
            k *= 2
            found = project(12 + step)
            joined = found.filter("sim IS NULL").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
            comp = components(scratch, comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(joined))
            new = scratch.keep(_top(knn.select("u", "v", "sim").unionByName(found), k, comp), f"graph-{step}-more")
            scratch.drop(knn)
            scratch.drop(found)
            knn = new
            extent = comp.agg(F.count("*").alias("nodes"), F.count_distinct("comp").alias("comps")).first()
    if passed and seen["hit"] < seen["n"]:
        missed = audited.filter("NOT hit").select(F.col("u").alias("a"), F.col("v").alias("b"))
        comp = components(scratch, comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(missed))

    members = scratch.keep(comp.join(reps, comp.node == reps.id).select("comp", "id", "cnt", "v"), "members")
    size = scratch.keep(members.groupBy("comp").agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.lit(BLOCK)).alias("chunks")), "sizes")
    # a member meets every chunk of its component: the rows to deal out are n * chunks
    to_deal = size.agg(F.sum(F.col("n") * F.col("chunks"))).first()[0] or 0
    size = size.select("comp", "chunks")
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks"))
    placed = members.join(size, "comp").withColumn("i", chunk).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    placed = placed.select("comp", "id", "cnt", "v", "i", F.least("i", "j").alias("bi"), F.greatest("i", "j").alias("bj"))
    groups = 1 + to_deal // GROUP_ROWS
    placed = placed.withColumn("g", F.pmod(F.xxhash64("comp", "bi", "bj"), F.lit(groups * 4)))

    def enlarge(table: pa.Table) -> pa.Table:
        ids, links = [], []
        for (_, bi, bj), g in groups_of(table, "comp", "bi", "bj"):
            i, d, cnt, m = g["i"].to_numpy(), g["id"].to_numpy(), g["cnt"].to_numpy(), _unit(g["v"], kind)
            a, b = np.flatnonzero(i == bi), np.flatnonzero(i == bj)
            hit = (m[a] @ m[b].T) >= threshold
            hit &= d[a][:, None] != d[b][None, :]
            ids.append(d[a])
            links.append(hit @ cnt[b])
            if bi != bj:
                ids.append(d[b])
                links.append(cnt[a] @ hit)
        return pa.table({"id": np.concatenate(ids), "links": np.concatenate(links).astype(np.int64)})

    whole = placed.groupBy("g").applyInArrow(enlarge, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    of = classes.join(comp, classes.rep == comp.node, "left").join(whole, classes.rep == whole.id, "left")
    of = scratch.keep(of.select("key", (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("comp")), "result")
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(of, "key", "left")
    component = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
