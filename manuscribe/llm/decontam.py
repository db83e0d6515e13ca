"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

Windows and items get 64-bit SimHash fingerprints of their weighted shingles,
cut into `blocks` wide blocks. Fingerprints within the radius agree in one block
at least but for `flips` bits, radius < blocks * (flips + 1), so items are listed
under every value within so many flips of their blocks, windows under their
own, and a join on blocks finds all pairs of one length within the radius. They
are compared by exact weighted-shingle similarity.

Not every window needs a fingerprint. A shingle weighs 1 / (number of items with
it), or 1 outside the benchmark, and similarity is the sum of weighted minimum
counts over that of maximum counts. So a window that reaches the similarity with
any item has that share of its own shingles in the benchmark, and shares one of
the item's rarest shingles, whose weights are more than what may be missing.
Windows are taken where a text has such a shingle, at the place it has in an
item and up to so many words off as edits can move it, and if enough of
their shingles are in the benchmark. These bounds lose nothing, and know lengths
only: which item a window holds is found by its fingerprint. A window at the
similarity of 0.8 is beyond the default radius of 23 of 64 bits with a chance of
about 3e-6 (each bit differs with a chance of 0.15 at most).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, checked_broadcast, free_names
from .grams import gram_rows, plain_words

BITS = 64


def _fingerprints(grams: DataFrame, *key: str) -> DataFrame:
    """key..., fp: from rows (key..., gram, w)."""
    def bit(b: int) -> Column:
        return F.when(F.shiftrightunsigned("gram", b).bitwiseAND(F.lit(1)) == 1, F.col("w")).otherwise(-F.col("w"))

    sums = grams.groupBy(*key).agg(*[F.sum(bit(b)).alias(f"b{b}") for b in range(BITS)])
    fp = F.lit(0).cast("long")
    for b in range(BITS):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(*key, fp.alias("fp"))


def _cuts(blocks: int) -> list[tuple[int, int, int]]:
    """(number, lowest bit, width) of every block."""
    cut = [i * BITS // blocks for i in range(blocks + 1)]
    return [(i, lo, hi - lo) for i, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False))]


def _own_blocks(fp: str, blocks: int) -> Column:
    """An array of (block number, the block's bits)."""
    return F.array(*[F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << w) - 1).cast("long")).alias("bits")) for i, lo, w in _cuts(blocks)])


def _turned(no: int, own: Column):
    return lambda mask: F.struct(F.lit(no).alias("no"), own.bitwiseXOR(mask).alias("bits"))


def _near_blocks(fp: str, blocks: int, flips: int) -> Column:
    """The same with up to `flips` bits of each block turned."""
    out = []
    for i, lo, w in _cuts(blocks):
        masks = [sum(1 << b for b in bits) for k in range(flips + 1) for bits in itertools.combinations(range(w), k)]
        own = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
        out.append(F.transform(F.lit(masks).cast("array<bigint>"), _turned(i, own)))
    return F.concat(*out)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = 0.8, words: int = 5, blocks: int = 6, flips: int = 3,
) -> DataFrame:
    """id_col, item_col, start_word, n_words, similarity: the best window of each text for each item it holds.

    Words are lower-case runs of letters and digits. Items of fewer words than
    a shingle are compared as one shingle of all their words; items without
    words, and rows with a null id, are not looked for. Null and empty texts
    hold nothing, very long ones are searched whole; a window at a text's end may
    be shorter than the item. Repeated rows count once; rows that repeat an id
    are searched each, and repeated item ids count with their first text in the order of words. Ties go to the earlier window.
    Empty tables give an empty result. Further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    doc = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    item = benchmark.select(F.col(item_col).cast("long").alias("item"), plain_words(F.col(item_text_col)).alias("words")).filter("item IS NOT NULL AND size(words) > 0")
    item = item.groupBy("item").agg(F.min("words").alias("words"))
    item = scratch.keep(item.withColumn("len", F.size("words")).withColumn("n", F.least("len", F.lit(words))), "items")
    found = []
    for n in sorted(r["n"] for r in item.select("n").distinct().collect()):
        of_n = item.filter(F.col("n") == n)
        place = scratch.keep(gram_rows(of_n, "words", n, "item", "len"), "item-grams")
        weight = scratch.keep(place.groupBy("gram").agg((1.0 / F.count_distinct("item")).alias("w")), "weights")
        own = scratch.keep(place.groupBy("item", "len", "gram").agg(F.count("*").alias("c")).join(checked_broadcast(weight), "gram"), "item-counts")
        total = scratch.keep(own.groupBy("item", "len").agg(F.sum(F.col("c") * F.col("w")).alias("whole")), "item-weights")
        # of each item, rarest first, shingles that weigh more than a window may lack
        so_far = Window.partitionBy("item").orderBy(F.desc("w"), "gram").rowsBetween(Window.unboundedPreceding, -1)
        telling = own.withColumn("before", F.coalesce(F.sum(F.col("c") * F.col("w")).over(so_far), F.lit(0.0))).join(checked_broadcast(total.select("item", "whole")), "item")
        telling = telling.filter(F.col("before") <= F.col("whole") * (1 - similarity) + 1e-9).select("item", "gram")
        marks = place.join(telling, ["item", "gram"]).groupBy("gram").agg(F.collect_set(F.struct("len", F.col("pos").alias("q"))).alias("at"))
        known = scratch.keep(weight.select("gram").join(marks, "gram", "left"), "marks")

        # `own` tells apart rows that repeat an id with other words
        said = doc.select("id", plain_words(F.col("text")).alias("words")).withColumn("own", F.xxhash64("words")).withColumn("size", F.size("words"))
        hits = scratch.keep(gram_rows(said, "words", n, "id", "own", "size").join(checked_broadcast(known), "gram").select("id", "own", "size", "pos", "at").distinct(), "hits")
        marked = hits.groupBy("id", "own", "size").agg(F.array_sort(F.collect_set("pos")).alias("marked"))
        off = F.floor(F.col("len") * (1 - similarity)).cast("int") + 1
        starts = hits.filter("at IS NOT NULL").select("id", "own", "pos", F.inline("at")).select("id", "own", "len", F.explode(F.sequence(F.col("pos") - F.col("q") - off, F.col("pos") - F.col("q") + off)).alias("s"))
        starts = starts.select("id", "own", "len", F.greatest("s", F.lit(0)).alias("s")).distinct().join(marked, ["id", "own"])
        ends = F.least(F.col("s") + F.col("len"), F.col("size")) - n  # the last shingle's place
        inside = F.size(F.filter("marked", lambda x: (x >= F.col("s")) & (x <= ends)))
        at = scratch.keep(starts.filter((ends >= F.col("s")) & (inside >= (ends - F.col("s") + 1) * similarity - 1e-9)).select("id", "own", "len", "s"), "windows")

        held = said.join(checked_broadcast(scratch.keep(at.select("id", "own").distinct(), "held")), ["id", "own"], "left_semi").dropDuplicates(["id", "own"])
        windows = held.join(at, ["id", "own"]).select("id", "own", "len", "s", F.slice("words", F.col("s") + 1, F.col("len")).alias("words"))
        grams = gram_rows(windows, "words", n, "id", "own", "len", "s").groupBy("id", "own", "len", "s", "gram").agg(F.count("*").alias("c"))
        grams = scratch.keep(grams.join(checked_broadcast(weight), "gram", "left").withColumn("w", F.coalesce("w", F.lit(1.0))), "window-grams")

        w_fp = _fingerprints(grams.select("id", "own", "len", "s", "gram", (F.col("c") * F.col("w")).alias("w")), "id", "own", "len", "s")
        i_fp = scratch.keep(_fingerprints(own.select("item", "len", "gram", (F.col("c") * F.col("w")).alias("w")), "item", "len"), "item-fingerprints")
        left = w_fp.select("id", "own", "len", "s", "fp", F.inline(_own_blocks("fp", blocks)))
        right = i_fp.select("item", "len", F.col("fp").alias("item_fp"), F.inline(_near_blocks("fp", blocks, flips)))
        radius = blocks * (flips + 1) - 1
        near = left.join(checked_broadcast(right), ["len", "no", "bits"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        near = scratch.keep(near.select("id", "own", "len", "s", "item").distinct(), "near")

        pair = grams.join(near, ["id", "own", "len", "s"]).join(checked_broadcast(own.select("item", "gram", F.col("c").alias("ic"))), ["item", "gram"], "left")
        sums = pair.groupBy("id", "own", "item", "s").agg(F.sum(F.least("c", F.coalesce("ic", F.lit(0))) * F.col("w")).alias("both"), F.sum(F.col("c") * F.col("w")).alias("mine"))
        exact = sums.join(checked_broadcast(total), "item").withColumn("similarity", F.col("both") / (F.col("mine") + F.col("whole") - F.col("both"))).filter(F.col("similarity") >= similarity - 1e-9)
        best = exact.groupBy("id", "item", "len").agg(F.max_by(F.struct("s", "similarity"), F.struct(F.round("similarity", 9), -F.col("s"))).alias("b"))
        found.append(best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.s").cast("long").alias("start_word"), F.col("len").cast("long").alias("n_words"), F.col("b.similarity").alias("similarity")))
    if not found:
        return docs.sparkSession.createDataFrame([], f"{id_col} long, {item_col} long, start_word long, n_words long, similarity double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without rows that hold a benchmark item; all columns kept, whatever their names.

    Each row is decided by its own text (by a 64-bit hash of it), whatever its
    id, so null ids are filtered like others and repeated rows go or stay
    together. Null, empty and very long texts as in leaks(); empty tables leave docs as they are.
    """
    own, bad_hash = free_names(docs, "text_hash", "bad_hash")
    text = F.col(text_col).cast("string")
    bad = leaks(docs.select(F.xxhash64(text).alias(own), text.alias("text")), benchmark, own, "text", **options).select(F.col(own).alias(bad_hash)).distinct()
    bad = checked_broadcast(Scratch(docs.sparkSession, "keep-clean").keep(bad, "bad"))
    return docs.join(bad, F.xxhash64(text) == F.col(bad_hash), "left_anti")
