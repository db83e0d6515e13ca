"""MinHash near-duplicates by bottom-k sketches from one hash function.

Rows with equal shingle sets form one class. A class keeps its k smallest
shingle hashes. Inverted lists of retained values generate pairs of classes
with overlapping sketches; the sketch of a pair's union estimates its Jaccard
similarity and filters; the similarity of the full sets decides.

Values are put in one order for all sketches, frequent ones last, and a sketch
is listed only under the first so many that a pair with enough overlap must
still meet in some of them; a sketch with fewer values than that in the lists of
others is set aside. Lists whose smallest members meet in a list form one
family, so that a group of copies is in few families.

In a short family, every member first meets the smallest one of its lists, then
those of other components in its lists. A long family is never expanded into
pairs. A member whose sketch shares too few values with the rest of the family has
no partner there and is set aside. Frequent values bring unrelated texts into one
family, so the others are parted into kin: what is reached by sketches that share enough.
Few kin are just expanded. The core of many kin, the shingles that most of a few of
them hold, turns each set into its difference from the core. Of sets A and B with differences D and E,
the symmetric difference has |D| + |E| - 2 |D & E| shingles, so that

    A and B are linked  <=>  q(A) + q(B) <= 2 (den + num) |D & E|,
    q(A) = (den + num) |D| - (den - num) |A|

The pivot is the member with the smallest q. A pair that needs no common
difference, q(A) + q(B) <= 0, is linked to the pivot on both sides. Any other
pair has to share differences: a member is listed under its rarest ones, so many
that any partner from another component that shares enough shares one of them. What is
left of a family is compared block by block, in groups that return only who
reaches whom. Any core gives the same links; it only decides how few are compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, checked_broadcast, components, free_names, groups_of, joined, least_overlap, trimmed
from .textarrays import shingle_sets

#: A value is frequent if so many of the sampled sketches hold it; this only orders values and changes no result.
FREQUENT, ORDER_SAMPLE = 8, 8
#: Families with more members are compared by differences from their core; shorter ones are just expanded.
SHORT_FAMILY = 16
#: So many values more are listed than a pair has to meet in: a sketch that shares fewer with others has no partner.
EXTRA = 12
#: About so many members give a family's core.
CORE_SAMPLE = 48
#: Members of a block; shingles handed to Python in one group, about; columns of a product.
BLOCK, GROUP_SHINGLES, COLUMNS = 512, 2_000_000, 4096


def _sketches(n_words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, kept, ends = [], [], [], [0]
            for s in shingle_sets(batch.column(2), n_words):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                kept.append(s[:k])
                ends.append(ends[-1] + len(kept[-1]))
            flat = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["id", "t", "n", "key", "sketch"],
            )

    return run


def _full_sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = [], [], 0
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n_words), strict=True):
                ids.append(i)
                held.append(s.view(np.int64))
                size += len(s)
                if size > GROUP_SHINGLES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.list_(pa.int64()))], ["id", "g"])
                    ids, held, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.list_(pa.int64()))], ["id", "g"])

    return run


def _sets_of(scratch: Scratch, texts: DataFrame, ids: DataFrame, n_words: int) -> DataFrame:
    """(id, g, s): the sorted shingle hashes of the named rows' texts and their hash; an id has one row for each different set."""
    ids = checked_broadcast(scratch.keep(ids.distinct(), "ids"))
    got = texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(trimmed(_full_sets(n_words)), "id long, g array<long>")
    return scratch.keep(got.filter("size(g) > 0").withColumn("s", F.xxhash64("g")).dropDuplicates(["id", "s"]), "sets")


def _links(scratch: Scratch, texts: DataFrame, sketches: DataFrame, pairs: DataFrame, n_words: int, num: int, den: int, k: int, least: int) -> DataFrame:
    """Of candidate pairs (a, b) those whose full sets are similar enough."""
    sk = sketches.select("id", "n", "sketch")
    est = (
        pairs.join(sk.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        .join(sk.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        .withColumn("whole", (F.col("na") <= k) & (F.col("nb") <= k))
        .withColumn("shared", F.array_intersect("sa", "sb"))
        .withColumn("union", F.array_sort(F.array_union("sa", "sb")))
        .withColumn("hits", F.when(F.col("whole"), F.size("shared")).otherwise(F.size(F.array_intersect(F.slice("union", 1, k), "shared"))))
        .filter(F.when(F.col("whole"), F.col("hits") * den >= F.size("union") * num).otherwise(F.col("hits") >= least))
        .groupBy("a", "b")
        .agg(F.max("whole").alias("whole"))
    )
    est = scratch.keep(est, "estimated")
    unsure = est.filter("NOT whole")
    sets = _sets_of(scratch, texts, unsure.select(F.col("a").alias("id")).union(unsure.select(F.col("b").alias("id"))), n_words)
    full = unsure.join(sets.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    sure = full.withColumn("both", F.size(F.array_intersect("ga", "gb"))).filter(F.col("both") * den >= (F.size("ga") + F.size("gb") - F.col("both")) * num)
    links = scratch.keep(est.filter("whole").select("a", "b").unionByName(sure.select("a", "b")), "links")
    scratch.drop(sets)
    return links


def _overlaps(lists: pa.ChunkedArray) -> np.ndarray:
    """How many values every two of the lists share."""
    lists = lists.combine_chunks()
    n, size = len(lists), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    value, col, often = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    seat = np.cumsum(often > 1) - 1  # what one member holds nobody shares
    held = often[col] > 1
    row, col = row[held], seat[col[held]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = int((often > 1).sum())
    both = np.zeros((n, n), np.float32)
    for lo in range(0, width, COLUMNS):
        x, y = np.searchsorted(col, [lo, lo + COLUMNS])
        m = np.zeros((n, min(COLUMNS, width - lo)), np.float32)
        m[row[x:y], col[x:y] - lo] = 1
        both += m @ m.T
    return both


def _asked(table: pa.Table) -> pa.Table:
    """Of dealt blocks (fam, e, bi, bj, role, id, need, v), where who asks (role 1 or 3) meets who is asked (2 or 3): each id and the smallest it reaches by pairs that share as many values as both need."""
    ones, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, g in groups_of(table, "fam", "e", "bi", "bj"):
        ids, need, role = (g[c].to_numpy() for c in ("id", "need", "role"))
        asks, asked = role & 1 > 0, role & 2 > 0
        hit = (_overlaps(g["v"]) >= np.maximum(need[:, None], need[None, :])) & (ids[:, None] != ids[None, :])
        a, b = joined(ids, hit & ((asks[:, None] & asked[None, :]) | (asked[:, None] & asks[None, :])))
        ones.append(a)
        others.append(b)
    return pa.table({"a": np.concatenate(ones), "b": np.concatenate(others)})


def _placed(scratch: Scratch, listed: DataFrame) -> DataFrame:
    """(fam, id, e): where members listed as (fam, e, id) meet; a family of few blocks is cheaper compared as a whole, under 0, than once for each value."""
    whole = listed.groupBy("fam", "id").agg(F.count("*").alias("times")).groupBy("fam").agg(F.count("*").alias("left"), F.sum("times").alias("times"))
    whole = whole.withColumn("at_once", F.ceil(F.col("left") / BLOCK) * F.col("left") <= F.col("times"))
    e = F.when(F.col("at_once"), F.lit(0).cast("long")).otherwise(F.col("e"))
    return scratch.keep(listed.join(whole.select("fam", "at_once"), "fam").select("fam", "id", e.alias("e")).distinct(), "placed")


def _kin(scratch: Scratch, able: DataFrame) -> DataFrame:
    """(fam, id) by kin: what long families' members (fam, id, need, v: sketch values shared in the family, rare ones first) reach by sketches that share enough.

    A linked pair shares as many values as both need. In a family beyond a
    block it meets under one of the rarest values. All ask the first block of
    those they meet; who is not of the commonest kin then asks the others. So a
    group of like texts is not compared pair by pair, nor are texts that only
    share frequent values.
    """
    zero = F.lit(0).cast("long")
    sized = able.join(able.groupBy("fam").agg(F.count("*").alias("left")), "fam")
    each = sized.filter(F.col("left") > BLOCK).select("fam", "id", F.explode(F.slice("v", F.lit(1), F.size("v") - F.col("need") + 1)).alias("e"))
    shared = each.groupBy("fam", "e").agg(F.count("*").alias("c")).filter("c > 1").select("fam", "e")
    placed = _placed(scratch, scratch.keep(each.join(shared, ["fam", "e"], "left_semi"), "values-listed"))
    placed = placed.unionByName(sized.filter(F.col("left") <= BLOCK).select("fam", "id", zero.alias("e")))
    size = placed.groupBy("fam", "e").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    placed = scratch.keep(placed.join(size, ["fam", "e"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("chunks"))), "dealt")

    def ask(dealt: DataFrame, tag: str) -> DataFrame:
        dealt = dealt.select("fam", "e", "bi", "bj", "role", "id").join(able, ["fam", "id"])
        total = dealt.agg(F.sum(F.size("v") + 8)).first()[0] or 0
        dealt = dealt.withColumn("g", F.pmod(F.xxhash64("fam", "e", "bi", "bj"), F.lit(1 + total * 4 // GROUP_SHINGLES)))
        return scratch.keep(dealt.groupBy("g").applyInArrow(_asked, "a long, b long").distinct(), tag)

    first, rest = F.col("i") == 0, F.sequence(F.lit(1).cast("long"), F.col("chunks") - 1)
    own = placed.select("fam", "e", F.col("i").alias("bi"), zero.alias("bj"), F.when(first, 3).otherwise(1).alias("role"), "id")
    lent = placed.filter(first & (F.col("chunks") > 1)).select("fam", "e", F.explode(rest).alias("bi"), zero.alias("bj"), F.lit(2).alias("role"), "id")
    found = ask(own.unionByName(lent), "kin-at-first")
    kin = components(scratch, found)
    more = placed.filter("chunks > 1").join(kin.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    more = scratch.keep(more, "long-lists")
    top = more.groupBy("fam", "e", "comp").agg(F.count("*").alias("c")).groupBy("fam", "e").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"))
    left = more.join(top, ["fam", "e"]).filter("comp <> top").select("fam", "e", "id", "chunks")
    size = left.groupBy("fam", "e").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    left = scratch.keep(left.join(size, ["fam", "e"]).withColumn("bi", F.pmod(F.xxhash64("id"), F.col("parts"))), "asking-on")
    asking = left.select("fam", "e", "bi", F.explode(rest).alias("bj"), F.lit(1).alias("role"), "id")
    lent = more.filter("i > 0").join(left.select("fam", "e", "parts").distinct(), ["fam", "e"])
    lent = lent.select("fam", "e", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("bi"), F.col("i").alias("bj"), F.lit(2).alias("role"), "id")
    later = ask(asking.unionByName(lent), "kin-later")
    if later.limit(1).count():
        kin = components(scratch, found.unionByName(later))
    return kin.select(F.col("comp").alias("fam"), F.col("node").alias("id"))


def _compare(num: int, den: int):
    """Of dealt blocks (fam, e, bi, bj, i, id, comp, q, d): (a, b) of each id and the smallest id that its links reach in its block."""

    def run(table: pa.Table) -> pa.Table:
        ones, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (_, _, bi, bj), g in groups_of(table, "fam", "e", "bi", "bj"):
            ids, comp, q = (g[c].to_numpy() for c in ("id", "comp", "q"))
            both = _overlaps(g["d"])
            i = g["i"].to_numpy()
            hit = (q[:, None] + q[None, :] <= 2 * (den + num) * both.astype(np.int64)) & (comp[:, None] != comp[None, :])
            hit &= ((i == bi)[:, None] & (i == bj)[None, :]) | ((i == bj)[:, None] & (i == bi)[None, :])
            a, b = joined(ids, hit)
            ones.append(a)
            others.append(b)
        return pa.table({"a": np.concatenate(ones), "b": np.concatenate(others)})

    return run


def _pivot_links(scratch: Scratch, texts: DataFrame, long: DataFrame, n_words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(members, links): each long family's members with their differences (fam, id, n, q, d), and their links to its pivot."""
    sets = _sets_of(scratch, texts, long.select("id"), n_words)
    own = long.select("fam", "id", "members").distinct().join(sets, "id")
    some = own.filter(F.pmod(F.xxhash64("fam", "id"), F.ceil(F.col("members") / CORE_SAMPLE)) == 0)
    asked = some.groupBy("fam").agg(F.count("*").alias("of"))
    core = some.select("fam", F.explode("g").alias("v")).groupBy("fam", "v").agg(F.count("*").alias("c")).join(asked, "fam").filter(F.col("c") * 2 > F.col("of"))
    core = scratch.keep(core.groupBy("fam").agg(F.collect_list("v").alias("core")), "cores")
    core_of = F.coalesce("core", F.array().cast("array<long>"))
    diff = own.join(core, "fam", "left").select("fam", "id", "s", F.size("g").alias("n"), F.concat(F.array_except("g", core_of), F.array_except(core_of, "g")).alias("d"))
    diff = scratch.keep(diff.withColumn("q", F.size("d") * (den + num) - F.col("n") * (den - num)), "differences")
    scratch.drop(sets)
    best = diff.groupBy("fam").agg(F.min(F.struct("q", "id", "s")).alias("p")).select("fam", F.col("p.id").alias("id"), F.col("p.s").alias("s"))
    pivot = scratch.keep(diff.join(best, ["fam", "id", "s"]).select("fam", F.col("id").alias("p"), F.col("q").alias("pq"), F.col("d").alias("pd")), "pivots")
    near = diff.join(pivot, "fam").filter((F.col("id") != F.col("p")) & (F.col("q") + F.col("pq") <= F.size(F.array_intersect("d", "pd")) * (2 * (den + num))))
    return diff, scratch.keep(near.select(F.col("p").alias("a"), F.col("id").alias("b")), "pivot-links")


def _further_links(scratch: Scratch, members: DataFrame, sketches: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): what links within long families join beyond the components of `comp`; sketches has (id, need, sketch)."""
    now = members.join(comp.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    # whoever has a partner of another component shares enough of its sketch with other components
    held = now.select("fam", "id", "comp").distinct().join(sketches, "id").select("fam", "id", "comp", "need", F.explode("sketch").alias("v"))
    apart = held.groupBy("fam", "v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("fam", "v")
    able = held.join(apart, ["fam", "v"], "left_semi").groupBy("fam", "id", "need").agg(F.count("*").alias("c")).filter("c >= need").select("fam", "id").distinct()
    now = scratch.keep(now.join(able, ["fam", "id"], "left_semi"), "able-apart")
    low = now.groupBy("fam", "comp").agg(F.min("q").alias("q"))
    low = low.groupBy("fam").agg(F.min(F.struct("q", "comp")).alias("l"), F.count("*").alias("parts")).filter("parts > 1")
    low = scratch.keep(low.select("fam", F.col("l.q").alias("q1"), F.col("l.comp").alias("c1")), "lowest")
    mixed = now.join(low, "fam")
    second = mixed.filter("comp <> c1").groupBy("fam").agg(F.min("q").alias("q2"))
    mixed = mixed.join(second, "fam").withColumn("other", F.when(F.col("comp") == F.col("c1"), F.col("q2")).otherwise(F.col("q1")))
    # a partner shares at most its own differences, and has at most den / num times the shingles
    other = F.greatest(F.col("other"), F.col("q") - F.ceil(F.col("n") * (2.0 * (den - num) * den / num)))
    mixed = mixed.withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("q") + other) / (2.0 * (den + num)) - 1e-9))).filter(F.col("need") <= F.size("d"))
    mixed = scratch.keep(mixed.select("fam", "id", "s", "comp", "q", "need", "d"), "mixed")
    each = mixed.select("fam", "id", "s", "comp", (F.size("d") - F.col("need") + 1).alias("first"), F.explode("d").alias("e"))
    often = each.groupBy("fam", "e").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("c > 1")
    rank = Window.partitionBy("fam", "id", "s").orderBy(F.coalesce("c", F.lit(1)), "e")
    listed = each.join(often, ["fam", "e"], "left").withColumn("at", F.row_number().over(rank)).filter("at <= first AND lo <> hi").select("fam", "e", "id", "comp")
    listed = scratch.keep(listed, "differences-listed")
    lists = listed.groupBy("fam", "e").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("fam", "e", "c")
    lists = scratch.keep(lists, "difference-lists")
    listed = scratch.keep(listed.join(lists.select("fam", "e"), ["fam", "e"], "left_semi").select("fam", "e", "id"), "listed-by-difference")
    placed = _placed(scratch, listed)
    size = placed.groupBy("fam", "e").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    dealt = placed.join(size, ["fam", "e"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("chunks"))).join(mixed.select("fam", "id", "comp", "q", "d"), ["fam", "id"])
    total = dealt.agg(F.sum(F.col("chunks") * (F.size("d") + 8))).first()[0] or 0
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("fam", "e", F.least("i", "j").alias("bi"), F.greatest("i", "j").alias("bj"), "i", "id", "comp", "q", "d")
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("fam", "e", "bi", "bj"), F.lit(1 + total * 4 // GROUP_SHINGLES)))
    return scratch.keep(dealt.groupBy("g").applyInArrow(_compare(num, den), "a long, b long"), "further-links")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: tuple[int, int] = (4, 5), k: int = 64, miss: float = 1e-8, text_hash: str | None = None
) -> DataFrame:
    """Components of rows whose word-shingle sets have Jaccard similarity >= num/den.

    Words are maximal runs without U+0009-U+000D or the space; A-Z is folded to
    a-z. A text of fewer words than a shingle has its whole sequence as one
    shingle; an empty or null text has none and links with nothing. Returns one
    row per input row: id_col, n_shingles, component_id (smallest id
    reachable), kept (id equals component_id) and, if `text_hash` names it, a
    column with xxhash64 of the text. Rows that repeat an id share a node, with
    the links of all their texts; a null id gets a null component_id and is
    kept. Pairs of exactly the similarity are linked. Long texts are taken
    whole; an empty table gives an empty result; further columns are ignored.
    A linked pair of sets beyond k shingles is missed with a chance of `miss`
    at most, pairs within k never.
    """
    num, den = similarity
    t = num / den
    least = least_overlap(k, t, miss)
    scratch = Scratch(docs.sparkSession, "minhash")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    rows = scratch.keep(texts.mapInArrow(trimmed(_sketches(words, k)), "id long, t long, n long, key binary, sketch array<long>"), "sketches")
    full = rows.filter("n > 0 AND id IS NOT NULL")
    classes = scratch.keep(full.groupBy("key").agg(F.min("id").alias("rep")), "classes")
    first_rows = full.join(classes.select("key", F.col("rep").alias("id")), ["key", "id"], "left_semi").dropDuplicates(["id", "key"])
    reps = scratch.keep(first_rows.select("id", "n", "sketch"), "reps")

    sampled = reps.filter(F.pmod(F.xxhash64("id"), F.lit(ORDER_SAMPLE)) == 0)
    often = scratch.keep(sampled.select(F.explode("sketch").alias("v")).groupBy("v").agg(F.count("*").alias("c")).filter(F.col("c") >= FREQUENT), "frequent")
    held = reps.select("id", F.explode("sketch").alias("v")).join(checked_broadcast(often), "v").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("c", "v"))).alias("late"))
    m = F.size("sketch")
    need = F.when(m <= math.floor(t * k), F.ceil(m * num / F.lit(den) - 1e-9)).otherwise(F.lit(least))
    ordered = F.when(F.col("late").isNull(), F.col("sketch")).otherwise(F.concat(F.array_except("sketch", F.col("late.v")), F.array_intersect(F.col("late.v"), F.col("sketch"))))
    listed = reps.join(held, "id", "left").select("id", "n", m.alias("m"), need.alias("need"), F.explode(F.slice(ordered, F.lit(1), (m - need + 1 + EXTRA).cast("int"))).alias("v"))
    listed = scratch.keep(listed.select("id", "n", "v", F.least(F.lit(EXTRA + 1), "need").alias("least")), "listed")
    # whoever has a partner shares so many of the listed values with it
    lists = scratch.keep(listed.join(listed.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1").select("v"), "v"), "repeated")
    scratch.drop(listed)
    able = lists.groupBy("id").agg(F.count("*").alias("c"), F.min("least").alias("least")).filter("c >= least").select("id")
    listed = scratch.keep(lists.join(checked_broadcast(scratch.keep(able, "able-by-lists")), "id", "left_semi").select("id", "n", "v"), "listed-able")

    def near(x: str, y: str):
        return F.least(x, y) * den >= F.greatest(x, y) * num

    first = listed.groupBy("v").agg(F.min(F.struct("id", "n")).alias("first"), F.count("*").alias("c")).filter("c > 1").select("v", F.col("first.id").alias("lead"), F.col("first.n").alias("lead_n"))
    first = scratch.keep(first, "first")
    root = listed.join(first.select("v", "lead"), "v").groupBy("id").agg(F.min("lead").alias("fam"))
    first = scratch.keep(first.join(root.withColumnRenamed("id", "lead"), "lead"), "families")
    lists = scratch.keep(listed.join(first, "v"), "lists")
    members = scratch.keep(lists.select("fam", "id").distinct(), "members")
    long = scratch.keep(members.groupBy("fam").agg(F.count("*").alias("members")).filter(F.col("members") > SHORT_FAMILY), "long-families")
    short = lists.join(checked_broadcast(long.select("fam")), "fam", "left_anti")

    stars = short.filter((F.col("id") != F.col("lead")) & near("n", "lead_n")).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    # who has a partner shares enough of its sketch with others of its family
    needing = reps.select("id", need.alias("need"), "sketch")
    held = members.join(checked_broadcast(long), "fam").select("fam", "id").join(needing, "id").select("fam", "id", "need", F.explode("sketch").alias("v"))
    shared = held.groupBy("fam", "v").agg(F.count("*").alias("c")).filter("c > 1")
    able = held.join(shared, ["fam", "v"]).groupBy("fam", "id", "need").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("v")).filter(F.size("v") >= F.col("need"))
    kin = _kin(scratch, scratch.keep(able.withColumn("v", F.col("v.v")), "able"))
    kin = scratch.keep(kin.join(kin.groupBy("fam").agg(F.count("*").alias("members")), "fam"), "kin")
    few = kin.filter(F.col("members") <= SHORT_FAMILY)
    pairs = few.select("fam", F.col("id").alias("a")).join(few.select("fam", F.col("id").alias("b")), "fam").filter("a < b").select("a", "b")
    links = _links(scratch, texts, reps, stars.unionByName(pairs).distinct(), words, num, den, k, least)
    differing, to_pivot = _pivot_links(scratch, texts, kin.filter(F.col("members") > SHORT_FAMILY), words, num, den)
    comp = components(scratch, links.unionByName(to_pivot))

    now = short.join(comp.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    now = scratch.keep(now.select("v", "id", "n", "comp", "lead"), "short-lists")
    top = now.groupBy("v", "comp").agg(F.count("*").alias("c")).groupBy("v").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count("*").alias("parts"))
    mixed = scratch.keep(now.join(top.filter("parts > 1").select("v", "top"), "v"), "short-mixed")
    o = mixed.filter("comp <> top").select("v", F.col("id").alias("o"), F.col("n").alias("o_n"), F.col("comp").alias("o_comp"), "lead", "top")
    other = mixed.select("v", F.col("id").alias("p"), F.col("n").alias("p_n"), F.col("comp").alias("p_comp"))
    cross = (
        o.join(other, "v")
        .filter((F.col("o_comp") != F.col("p_comp")) & (F.col("o") != F.col("lead")) & (F.col("p") != F.col("lead")) & near("o_n", "p_n"))
        .filter((F.col("p_comp") == F.col("top")) | (F.col("o") < F.col("p")))
        .select(F.least("o", "p").alias("a"), F.greatest("o", "p").alias("b"))
        .distinct()
    )
    more = _links(scratch, texts, reps, cross, words, num, den, k, least).unionByName(_further_links(scratch, differing, needing, comp, num, den))
    if more.limit(1).count():
        comp = components(scratch, comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
    of = scratch.keep(classes.join(comp, classes.rep == comp.node, "left").select("key", F.coalesce("comp", "rep").alias("of")), "components")
    out = rows.select("id", "t", "n", "key").join(of, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("of")).otherwise(F.col("id")))
    out = out.select("id", "t", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept", *([F.col("t").alias(text_hash)] if text_hash else []))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without rows whose text is near another's with a smaller id; all columns kept, whatever their names.

    Empty, null and very long texts as in near_duplicates; an empty table stays
    empty. Decided by row: a row goes if its own text's component has a smaller
    id. A null id ranks after all ids, by the text's hash, so that of rows with
    null ids and like texts those of one text stay. Repeated rows stay or go
    together.
    """
    own, mark, gone_id, gone_mark = free_names(docs, "own_id", "text_hash", "gone_id", "gone_hash")
    text = F.col(text_col).cast("string")
    late = F.shiftrightunsigned(F.xxhash64(text, F.lit(1)), 2) + F.lit((1 << 63) - (1 << 62))
    of = F.coalesce(F.col(id_col).cast("long"), late)
    found = near_duplicates(docs.select(of.alias(own), text.alias("text")), own, "text", text_hash=mark, **options)
    gone = found.filter("NOT kept").select(F.col(own).alias(gone_id), F.col(mark).alias(gone_mark)).distinct()
    gone = checked_broadcast(Scratch(docs.sparkSession, "keep-one").keep(gone, "gone"))
    return docs.join(gone, (of == F.col(gone_id)) & (F.xxhash64(text) == F.col(gone_mark)), "left_anti")
