"""Cross-entropy difference under matched target and background n-gram models.

Tokens are the 64-bit hashes of words with A-Z folded. Both models count the
same unigrams and bigrams of whole texts, so they share one vocabulary, and mix
bigram, unigram and uniform estimates with the same weights. The target model
counts target documents, the background model every document, and both leave out
what the scored document itself adds. A document's score is its mean per-token
loss under the target model less that under the background model: lower is
closer to the target.

Texts are read once, into chunks of words: a chunk's different word hashes and
the places where they stand. A chunk's different n-grams are dealt by hash into
parts, one sorted array for each part, so that a frequent n-gram is one entry a
chunk however often it occurs. A part adds up all chunks' counts and answers
each chunk with what the other chunks have of its n-grams, in the chunk's own
order; most n-grams stand in one chunk only, and cost a bit there. A chunk
then scores its documents. Parts and answers grow with the corpus; a part or a
chunk has a bounded size, but for a single longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast
from .textarrays import FOLDED, chunks, mix, words

#: Weights of bigram, unigram and uniform estimates.
MIXTURE = (0.6, 0.3, 0.1)
#: Bytes of text in a chunk; tokens for each part.
CHUNK_BYTES, PART_TOKENS = 4 << 20, 750_000

CHUNKS = "chunk long, tokens long, ids array<long>, bounds binary, target binary, words binary, at binary"
ANSWERS = "chunk long, part long, b binary, t binary, n_words long, n_b long, n_t long"
SCORES = "id long, n_tokens long, ce_target double, ce_background double"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CHUNKS of rows (id, text, target)."""
    task, n = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        target = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, offs in chunks(batch.column(1), CHUNK_BYTES):
            h, bounds = words(data, offs, FOLDED)
            uniq, at = np.unique(h, return_inverse=True)
            raw = [bounds.astype(np.int64), target[lo:hi], uniq, at.astype(np.uint16 if len(uniq) < 1 << 16 else np.uint32)]
            ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays(
                [pa.array([task + n]), pa.array([len(h)], pa.int64()), ids, *[pa.array([x.tobytes()], pa.binary()) for x in raw]], ["chunk", "tokens", "ids", "bounds", "target", "words", "at"]
            )
            n += 1


def _pack(counts: np.ndarray) -> bytes:
    """Counts of which most are 0: a bit for each, a byte for each other, and 8 bytes more for each from 255 on."""
    some = counts > 0
    small = np.minimum(counts[some], 255).astype(np.uint8)
    return np.packbits(some).tobytes() + small.tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    bits = -(-n // 8)
    some = np.unpackbits(np.frombuffer(raw, np.uint8, bits), count=n).astype(bool)
    small = np.frombuffer(raw, np.uint8, int(some.sum()), bits).astype(np.int64)
    big = small == 255
    small[big] = np.frombuffer(raw, np.int64, int(big.sum()), bits + len(small))
    out = np.zeros(n, np.int64)
    out[some] = small
    return out


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte by byte: the high bytes, nearly all 0, stand together and compress to nothing."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


class _Chunk:
    """The n-grams of a stored chunk: `keys` are its different ones, sorted; odd keys are words."""

    def __init__(self, bounds: bytes, words: bytes, at: bytes):
        self.bounds = np.frombuffer(bounds, np.int64)
        uniq = np.frombuffer(words, np.uint64)
        self.word = np.frombuffer(at, np.uint16 if len(uniq) < 1 << 16 else np.uint32).astype(np.int64)
        n = len(self.word)
        self.first = np.zeros(n, bool)
        self.first[self.bounds[:-1][np.diff(self.bounds) > 0]] = True
        self.later = np.flatnonzero(~self.first)
        h = uniq[self.word]
        pair = mix(h[self.later - 1] * np.uint64(5) + h[self.later]) & ~np.uint64(1)
        word = mix(uniq) | np.uint64(1)
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.keys = np.concatenate([word, self.pairs])
        self.order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[self.order]
        self.n_words = len(uniq)

    def counts(self, of: np.ndarray) -> np.ndarray:
        """How often each key stands at the tokens `of`."""
        n = np.concatenate([np.bincount(self.word[of], minlength=self.n_words), np.bincount(self.pair[of[self.later]], minlength=len(self.pairs))])
        return n[self.order]

    def split(self, parts: int) -> np.ndarray:
        """Where the keys of each part end."""
        cut = [(i << 64) // parts for i in range(1, parts)]
        return np.concatenate([np.searchsorted(self.keys, np.array(cut, np.uint64)), [len(self.keys)]]).astype(np.int64)


def _tables(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[dict, _Chunk]]:
    for i in range(len(batch)):
        row = {name: batch.column(name)[i].as_py() for name in ("chunk", "ids", "bounds", "target", "words", "at")}
        yield row, _Chunk(row["bounds"], row["words"], row["at"])


def _dealt(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, c in _tables(batch):
                t = np.repeat(np.frombuffer(row["target"], bool), np.diff(c.bounds))
                ends = c.split(parts)
                begins = np.concatenate([[0], ends[:-1]])
                some = np.flatnonzero(ends > begins)
                raw = [(_pack_keys, c.keys), (_pack, c.counts(np.ones(len(c.word), bool)) - 1), (_pack, c.counts(t))]
                cols = [pa.array([pack(x[begins[p] : ends[p]]) for p in some.tolist()], pa.binary()) for pack, x in raw]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(np.full(len(some), row["chunk"])), *cols], ["part", "chunk", "keys", "b", "t"])

    return run


def _answers(table: pa.Table) -> pa.Table:
    """Of one part: for each chunk what the others have of its n-grams; and a row without a chunk with the part's different words and tokens."""
    keys = [_unpack_keys(x) for x in table["keys"].to_pylist()]
    uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])
    word = (uniq & np.uint64(1)) == 1
    out, sums = [], []
    for name, least in (("b", 1), ("t", 0)):
        own = np.concatenate([_unpack(x, len(k)) for x, k in zip(table[name].to_pylist(), keys, strict=True)]) + least
        total = np.zeros(len(uniq), np.int64)
        np.add.at(total, at, own)
        sums.append(int(total[word].sum()))
        others = total[at] - own
        out.append([_pack(others[e - len(k) : e]) for e, k in zip(ends.tolist(), keys, strict=True)])
    n, part = len(keys), table["part"][0].as_py()
    return pa.table(
        {
            "chunk": pa.array([*table["chunk"].to_pylist(), None], pa.int64()),
            "part": pa.array([part] * (n + 1), pa.int64()),
            "b": pa.array([*out[0], None], pa.binary()),
            "t": pa.array([*out[1], None], pa.binary()),
            "n_words": pa.array([None] * n + [int(word.sum())], pa.int64()),
            "n_b": pa.array([None] * n + [sums[0]], pa.int64()),
            "n_t": pa.array([None] * n + [sums[1]], pa.int64()),
        }
    )


def _mean_loss(pair: np.ndarray, before: np.ndarray, word: np.ndarray, total: np.ndarray, later: np.ndarray, size: int, row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each row: from the counts of each token's word, and of each later token's pair and the word before it."""
    l2, l1, l0 = MIXTURE
    uni = word / np.maximum(total, 1)[row]
    bi = uni.copy()
    seen = before > 0
    bi[later[seen]] = pair[seen] / before[seen]
    loss = -np.log(bi * l2 + uni * l1 + l0 / max(size, 1))
    return np.bincount(row, loss, len(n)) / np.maximum(n, 1)


def _scored(parts: int, size: int, n_b: int, n_t: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("id", "n_tokens", "ce_target", "ce_background")}
        answers = right.sort_by("part")
        for row_, c in _tables(left):
            n = np.diff(c.bounds)
            row = np.repeat(np.arange(len(n)), n)
            target = np.frombuffer(row_["target"], bool)
            later = c.later
            held = np.diff(c.split(parts), prepend=0)
            held = held[held > 0].tolist()
            said = {"b": np.ones(len(c.word), bool), "t": target[row]}
            # what a row's own text adds: its counts of each token's word and pair
            _, at, times = np.unique(row * c.n_words + c.word, return_inverse=True, return_counts=True)
            own_word = times[at]
            _, at, times = np.unique(row[later] * max(len(c.pairs), 1) + c.pair, return_inverse=True, return_counts=True)
            own_pair, own_before = times[at], own_word[later - 1]
            ce = {}
            for name, corpus in (("b", n_b), ("t", n_t)):
                others = [_unpack(x, k) for x, k in zip(answers[name].to_pylist(), held, strict=True)]
                total = np.empty(len(c.keys), np.int64)
                total[c.order] = np.concatenate([np.zeros(0, np.int64), *others]) + c.counts(said[name])
                adds = np.ones(len(n), np.int64) if name == "b" else target.astype(np.int64)
                a, al = adds[row], adds[row[later]]
                word = total[c.word] - a * own_word
                pair = total[c.n_words + c.pair] - al * own_pair
                before = total[c.word[later - 1]] - al * own_before
                ce[name] = _mean_loss(pair, before, word, corpus - adds * n, later, size, row, n)
            out["id"] += row_["ids"]
            out["n_tokens"].append(n)
            for k, name in (("ce_target", "t"), ("ce_background", "b")):
                out[k].append(np.where(n > 0, ce[name], np.nan))
        cols = [pa.array(out["id"], pa.int64())]
        cols += [pa.array(np.concatenate([np.zeros(0), *out[k]]), kind, from_pandas=True) for k, kind in (("n_tokens", pa.int64()), ("ce_target", pa.float64()), ("ce_background", pa.float64()))]
        return pa.Table.from_arrays(cols, list(out))

    return run


def score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ce_target, ce_background, score (their difference), one row per row.

    `target_ids` has id_col of the target documents; ids without a document and
    nulls are ignored, repeats count once. Null and empty texts have 0 tokens
    and null losses; null ids are scored. Repeated rows each leave out their own
    text only, so the other copies count. Texts are taken whole, however long;
    further columns are ignored; empty tables give empty results, and without a
    target its model is the uniform estimate. The uniform estimate is over the
    corpus's different words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    ids = target_ids.select(F.col(id_col).cast("long").alias("target_id")).filter("target_id IS NOT NULL").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = rows.join(checked_broadcast(ids), F.col("id") == F.col("target_id"), "left").select("id", "text", F.col("target_id").isNotNull().alias("target"))
    chunked = scratch.keep(marked.mapInArrow(_chunked, CHUNKS), "chunks")
    tokens = chunked.agg(F.sum("tokens")).first()[0] or 0
    parts = 1 + tokens // PART_TOKENS
    dealt = chunked.mapInArrow(_dealt(parts), "part long, chunk long, keys binary, b binary, t binary")
    answers = scratch.keep(dealt.groupBy("part").applyInArrow(_answers, ANSWERS), "answers")
    whole = answers.filter("chunk IS NULL").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_b", "n_t")]).na.fill(0).first()
    back = answers.filter("chunk IS NOT NULL").select("chunk", "part", "b", "t")
    out = chunked.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_scored(parts, whole["n_words"], whole["n_b"], whole["n_t"]), SCORES)
    return out.select(F.col("id").alias(id_col), "n_tokens", "ce_target", "ce_background", (F.col("ce_target") - F.col("ce_background")).alias("score"))
