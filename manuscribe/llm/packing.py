"""Packing of whole documents into token windows by lexical retrieval.

Documents are put in the order of a few minima of their word hashes, so that
documents with many common words stand together, whatever the size of the
corpus; a range of that order is a task, and what stands together in it up to a
bounded amount of text is a shard. Each shard builds a BM25 inverted index over
all terms of its documents, with the shard's own document frequencies. A seed document
opens a window; the unused documents that its terms retrieve fill it, best
first. The document that overflows is cut there, its rest opens the next window
and it is the next seed. A shard's last, partly filled window is cut into
windows of powers of two, which need no padding, so nothing is padded.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .bpe import Pairs, ranges
from .common import Scratch, trimmed
from .textarrays import FOLDED, chunks, hashes, mix, running, spans, words

K1, B = 1.2, 0.75
#: A worker remembers the ids of so many words, then starts over.
MEMO = 600_000
#: Words of a task, about.
TASK_WORDS = 1_000_000
#: Minima of word hashes that order the documents, 5 bytes each.
MINIMA = 4

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Byte classes of a plain word: letter, digit, other; words with any further byte or a Latin-1 sign go to the library.
LETTER, DIGIT, SIGN = 1, 2, 3
PLAIN = np.zeros(256, np.int8)
PLAIN[0x21:0x7F] = SIGN
PLAIN[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
PLAIN[0x30:0x3A] = DIGIT
#: These begin contractions and special strings.
PLAIN[[ord("'"), ord("<")]] = 0
#: Words of more bytes go to the library.
LONG_WORD = 64


class WordTokenizer:
    """Ids of texts whose tokenizer never joins anything across white space: each different word is encoded once.

    Plain words, of ASCII and Latin-1 letters, digits and signs, are split and
    merged as arrays, all new ones of a batch together; the library encodes the
    others, and all of them if the file's rules are not the known ones.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # every core runs a task of its own: the library's threads would only contend
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.pairs = None
        with open(path, encoding="utf-8") as f:
            self._plain_rules(json.load(f))
        self.clear()

    def _plain_rules(self, spec: dict) -> None:
        model = spec["model"]
        vocab, end = model.get("vocab", {}), model.get("end_of_word_suffix") or ""
        # printable Latin-1 stands for itself, the other bytes for what follows U+00FF
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = iter(range(0x100, 0x200))
        chars = [chr(b) if b in printable else chr(next(rest)) for b in range(256)]
        if model["type"] != "BPE" or not all(c in vocab and c + end in vocab for c in chars):
            return
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        m = len(vocab)
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left, right, made = (np.array([vocab[f(x)] for x in merges], np.int64) for f in (lambda x: x[0], lambda x: x[1], "".join))
        self.pairs = Pairs(m, left * m + right, np.arange(len(merges)), made)
        probes = ["Plain", "a1b22c", "x--y...", "caf\u00e9\u00c9t\u00c9\u00df", "(word),", "\u00bfqu\u00e9?", "Z" * 40, "\"A.B.C.\"", "3.14%", "m\u00fc\u00dcLL-er_9"]
        raw = [p.encode() for p in probes]
        ends = np.cumsum([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        plain, ids, sizes = self._merge_plain(data, ends - [len(r) for r in raw], ends)
        want = [e.ids for e in self.tokenizer.encode_batch_fast([p for p, x in zip(probes, plain, strict=True) if x], add_special_tokens=False)]
        if ids.tolist() != list(chain.from_iterable(want)) or sizes.tolist() != list(map(len, want)):
            self.pairs = None

    def _merge_plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which words are plain, ids of these, their numbers)."""
        lens = ends - starts
        flat = data[ranges(starts, lens)]
        kind = PLAIN[flat]
        upper = np.where((flat >= 0x41) & (flat <= 0x5A), 0x20, 0).astype(np.uint8)
        lead = np.flatnonzero(flat[:-1] == 0xC3)
        low = flat[lead + 1]
        lead = lead[(low != 0x97) & (low != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        upper[lead[(flat[lead + 1] <= 0x9E)] + 1] = 0x20
        plain = (np.minimum.reduceat(kind, np.cumsum(lens) - lens) > 0) & (lens <= LONG_WORD)
        stay = np.repeat(plain, lens)
        flat, kind, lens = (flat + upper)[stay], kind[stay], lens[plain]
        n = len(flat)
        if not n:
            return plain, np.zeros(0, np.int32), np.zeros(0, np.int64)
        begins = np.cumsum(lens) - lens
        cut = np.ones(n, bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        cut[begins] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], n)
        _, first, inv = np.unique(hashes(running(flat), s, e), return_index=True, return_inverse=True)
        us, ul = s[first], e[first] - s[first]
        sym = self.inner[flat[ranges(us, ul)]]
        sym[np.cumsum(ul) - 1] = self.last[flat[e[first] - 1]]
        ids, size = self.pairs.merged(sym, ul)
        at, count = (np.cumsum(size) - size)[inv], size[inv]
        return plain, ids[ranges(at, count)], np.add.reduceat(count, np.searchsorted(s, begins))

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.bounds = np.zeros(MEMO + 2, np.int64)
        self.term = np.zeros(MEMO + 1, np.uint64)

    def _store(self, keys: list[int], terms: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, known = len(ids), len(self.at)
        lo, end = int(self.bounds[known]), known + len(keys)
        if lo + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), n), np.int32)])
        self.flat[lo : lo + n] = ids
        self.at.update(zip(keys, range(known, end), strict=True))
        if end >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros(len(keys), np.int64)])
            self.term = np.concatenate([self.term, np.zeros(len(keys), np.uint64)])
        self.bounds[known + 1 : end + 1] = lo + np.cumsum(sizes)
        self.term[known:end] = terms

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size = ends - starts
        own = data[ranges(starts, size)]
        stop = np.cumsum(size)
        terms = hashes(running(own, FOLDED), stop - size, stop)
        other = np.ones(len(keys), bool)
        if self.pairs is not None:
            plain, ids, sizes = self._merge_plain(data, starts, ends)
            self._store(keys[plain].tolist(), terms[plain], ids, sizes)
            other = ~plain
        if other.any():
            raw = data.tobytes()
            texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(starts[other].tolist(), ends[other].tolist(), strict=True)]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self._store(keys[other].tolist(), terms[other], np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum())), sizes)

    def read(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, hashes of the case-folded words) of each text in order, from one split of it."""
        for _, _, data, offs in chunks(column):
            starts, ends, bounds = spans(data, offs)
            uniq, first, inv = np.unique(hashes(running(data), starts, ends), return_index=True, return_inverse=True)
            if len(self.at) + len(uniq) > MEMO:
                self.clear()
            keys = uniq.tolist()
            slot = np.fromiter((self.at.get(k, -1) for k in keys), np.int64, len(keys))
            miss = np.flatnonzero(slot < 0)
            if len(miss):
                self._learn(uniq[miss], data, starts[first[miss]], ends[first[miss]])
                slot[miss] = [self.at[keys[i]] for i in miss.tolist()]
            at = self.bounds[slot]
            size = (self.bounds[slot + 1] - at)[inv]
            total = np.concatenate([[0], np.cumsum(size)])
            ids, terms = self.flat[ranges(at[inv], size)], self.term[slot][inv]
            for r in range(len(bounds) - 1):
                yield ids[total[bounds[r]] : total[bounds[r + 1]]], terms[bounds[r] : bounds[r + 1]]

    def encode(self, column: pa.Array, end: int | None = None) -> Iterator[np.ndarray]:
        """The ids of each text in order, with `end` after them."""
        for ids, _ in self.read(column):
            yield ids if end is None else np.append(ids, np.int32(end))


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@F.arrow_udf(StructType([StructField("key", BinaryType()), StructField("words", LongType())]))
def _place(column: pa.Array) -> pa.Array:
    """Where a text stands in the order of shards, and its words."""
    keys, sizes = [], [np.zeros(0, np.int64)]
    seeds = mix(np.arange(1, MINIMA + 1, dtype=np.uint64))
    for _, _, data, offs in chunks(column):
        h, bounds = words(data, offs, FOLDED)
        n = np.diff(bounds)
        low = np.full((len(n), MINIMA), (1 << 64) - 1, np.uint64)
        some = n > 0
        if len(h):
            for j, seed in enumerate(seeds):
                low[some, j] = np.minimum.reduceat(mix(h ^ seed), bounds[:-1][some])
        raw = np.ascontiguousarray((low >> np.uint64(24)).astype(">u8").view(np.uint8).reshape(len(n), MINIMA, 8)[:, :, 3:]).reshape(len(n), -1)
        keys += [x.tobytes() for x in raw]
        sizes.append(n)
    return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(sizes), pa.int64())], ["key", "words"])


class Index:
    """BM25 over the documents of one shard: all their terms, and document frequencies within it."""

    def __init__(self, terms: list[np.ndarray]):
        size = np.array([len(t) for t in terms], np.int64)
        n = len(size)
        uniq, term = np.unique(np.concatenate(terms) if terms else np.zeros(0, np.uint64), return_inverse=True)
        doc = np.repeat(np.arange(n), size)
        # (term, doc) pairs in the order of terms are the inverted lists
        pair, tf = np.unique(term * max(n, 1) + doc, return_counts=True)
        term, self.docs = np.divmod(pair, max(n, 1))
        df = np.bincount(term, minlength=len(uniq))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(size.mean(), 1)) if n else size
        self.weights = idf[term] * tf * (K1 + 1) / (tf + norm[self.docs])
        self.bounds = np.concatenate([[0], np.cumsum(df)])
        own = np.argsort(self.docs, kind="stable")
        self.terms = term[own]
        self.own = np.searchsorted(self.docs[own], np.arange(n + 1))
        self.n = n

    def scores(self, doc: int) -> np.ndarray:
        """Of each document for all different terms of `doc`."""
        q = self.terms[self.own[doc] : self.own[doc + 1]]
        at = ranges(self.bounds[q], self.bounds[q + 1] - self.bounds[q])
        return np.bincount(self.docs[at], self.weights[at], self.n)

    def neighbours(self, doc: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with `doc`, best score first, ties by order."""
        score = self.scores(doc)
        score[used] = 0
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(ids: list[np.ndarray], index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    out: list[tuple[int, int, int, int, int]] = []
    used = np.zeros(len(ids), bool)
    seq = fill = 0
    open_from = 0  # in out, of the window being filled

    def place(doc: int) -> None:
        nonlocal seq, fill, open_from
        used[doc] = True
        pos, size = 0, len(ids[doc])
        while pos < size:
            take = min(window - fill, size - pos)
            out.append((doc, pos, take, seq, fill))
            pos, fill = pos + take, fill + take
            if fill == window:
                seq, fill, open_from = seq + 1, 0, len(out)

    seed = nxt = 0
    while True:
        if not fill:
            while nxt < len(ids) and used[nxt]:
                nxt += 1
            if nxt == len(ids):
                break
            seed = nxt
            place(seed)
            if not fill:
                continue
        at = seq
        for doc in index.neighbours(seed, used).tolist():
            place(doc)
            if seq != at:
                seed = doc
                break
        else:
            while nxt < len(ids) and used[nxt]:
                nxt += 1
            if nxt == len(ids):
                break
            seed = nxt
            place(seed)
    last, out[open_from:] = out[open_from:], []
    room = 0
    for doc, start, length, _, _ in last:
        while length:
            if not room:
                room = whole = 1 << (fill.bit_length() - 1)
            take = min(room, length)
            out.append((doc, start, take, seq, whole - room))
            start, length, room, fill = start + take, length - take, room - take, fill - take
            if not room:
                seq += 1
    return out


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = 2048, end_id: int = 1, shard_bytes: int = 2 << 20
) -> DataFrame:
    """Pieces of every document, each token in exactly one, in sequences of at most `window` tokens.

    Null and empty texts have only their end token; repeated rows and null ids
    are packed like any other; a text longer than a shard is a shard with what
    stands before it, and is cut at windows; neighbours of equal score come in
    the order of documents. An empty table gives an empty result; further
    columns are ignored. A shard ends with the text that fills `shard_bytes`,
    so its index is bounded but for a single longer text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = Scratch(spark, "packing").keep(rows.withColumn("at", _place("text")).select("id", "text", "at.key", "at.words"), "placed")
    size = placed.agg(F.sum(F.col("words") + 1)).first()[0] or 0

    def packed(ids: list, texts: list[pa.Array], shard: int) -> pa.RecordBatch:
        read = list(_tokenizer(tokenizer or default_tokenizer()).read(pa.concat_arrays(texts)))
        own = [np.append(x, np.int32(end_id)) for x, _ in read]
        out = pack_shard(own, Index([t for _, t in read]), window)
        d, start, length, seq, off = (np.array(c, np.int64) for c in zip(*out, strict=True))
        crc = [zlib.crc32(own[i][s : s + n].astype("<u4").tobytes()) for i, s, n, _, _ in out]
        sizes = np.array([len(x) for x in own], np.int64)
        cols = [pa.array(ids, pa.int64()).take(pa.array(d)), start, length, pa.array(crc, pa.int64()), sizes[d], seq + (shard << 24), off]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], [x.split()[0] for x in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 16
        ids, texts, held = [], [], 0
        for batch in batches:
            at, text = 0, batch.column(1)
            ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            while at < len(batch):
                # up to the text that fills the shard
                to = min(len(batch), int(np.searchsorted(ends, shard_bytes - held + (ends[at - 1] if at else 0))) + 1)
                ids += batch.column(0).slice(at, to - at).to_pylist()
                texts.append(text.slice(at, to - at))
                held += int(ends[to - 1] - (ends[at - 1] if at else 0))
                at = to
                if held >= shard_bytes:
                    yield packed(ids, texts, shard)
                    shard, ids, texts, held = shard + 1, [], [], 0
        if ids:
            yield packed(ids, texts, shard)

    order = ["key", F.xxhash64("id", "text")]
    dealt = placed.repartitionByRange(1 + size // TASK_WORDS, *order).sortWithinPartitions(*order).select("id", "text")
    return dealt.mapInArrow(trimmed(run), PIECES).withColumnRenamed("doc_id", id_col)
