"""Token counts of whole texts under a piece-model BPE, by rank-synchronous array merging.

Texts are cut into pre-tokens where no piece of the vocabulary can span: before
a run of spaces, and around ASCII characters that no longer piece holds. Each
different pre-token of a batch is merged once. The batch's pre-tokens lie in
one flat symbol array with lengths; in each round every pre-token applies its
lowest-ranked pair, leftmost first, all at the same time, until none is left.
The surviving symbols are counted, an unknown character by its UTF-8 bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import NONE, Pairs
from .textarrays import chunks, hashes, mix, running, utf8

SPACE = "▁"
#: A worker remembers the counts of so many pre-tokens, then starts over; longer pre-tokens merge in a heap.
MEMO, LONG = 400_000, 256


class PieceCounter(Pairs):
    """The vocabulary of one model as arrays: symbols, pairs, ranks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        names = [p for p, _ in pieces]
        known = set(names)
        names += sorted({c for p in names for c in p} - known)
        sid = {p: i for i, p in enumerate(names)}
        m = len(names) + 5
        self.cost = np.ones(m, np.int64)
        for p, i in sid.items():
            if p not in known:
                self.cost[i] = len(p.encode())
        self.cost[len(names) + 1 :] = [1, 2, 3, 4]
        points = np.arange(0x110000)
        size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        self.symbol = (len(names) + size).astype(np.int32)
        for p, i in sid.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[0x20] = self.symbol[ord(SPACE)]
        scores = np.unique([-s for _, s in pieces])
        keys, ranks, made = [], [], []
        for p, s in pieces:
            r = int(np.searchsorted(scores, -s))
            for j in range(1, len(p)):
                left, right = sid.get(p[:j]), sid.get(p[j:])
                if left is not None and right is not None:
                    keys.append(left * m + right)
                    ranks.append(r)
                    made.append(sid[p])
        super().__init__(m, np.array(keys), np.array(ranks), np.array(made))
        spanning = {c for p in names if len(p) > 1 for c in p}
        self.lone = np.array([b < 0x80 and b != 0x20 and chr(b) not in spanning for b in range(256)])
        if any(SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("a piece holds a space after another character: no cut before spaces is safe")
        self.memo: dict[int, int] = {}
        for probe in ("", " ", "  a", "word  word\n\n x", "été 你好 \U0001f600 <s> </s> <unk>\t."):
            if self.count(pa.array([probe]))[0] != len(model.encode(probe)):
                raise ValueError(f"this model normalises texts in a way not known here: {probe!r}")

    def merge(self, sym: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Tokens of each of the sequences that lie one after another in sym."""
        out = np.zeros(len(lens), np.int64)
        for who, left, n in self.survivors(sym, lens):
            out[who] = np.add.reduceat(self.cost[left], np.cumsum(n) - n)
        return out

    def merge_long(self, sym: np.ndarray) -> int:
        """The same merges of one long sequence in a heap of (rank, place)."""
        s = sym.astype(np.int64).tolist()
        n = len(s)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, made = (x.tolist() for x in self.pair(sym[:-1], sym[1:]))
        heap = [(r, i, s[i], s[i + 1], m) for i, (r, m) in enumerate(zip(ranks, made, strict=True)) if r != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j] = m, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    r, made_here = (v[0] for v in self.pair(np.array([s[x]]), np.array([s[y]])))
                    if r != NONE:
                        heapq.heappush(heap, (int(r), x, s[x], s[y], int(made_here)))
        return int(sum(self.cost[x] for x in s if x >= 0))

    def _units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixed: np.ndarray) -> np.ndarray:
        size = ends - starts
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        flat = data[at]
        points = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lens = np.add.reduceat((flat & 0xC0) != 0x80, np.cumsum(size) - size).astype(np.int64)
        sym = self.symbol[points]
        sym = np.insert(sym, (np.cumsum(lens) - lens)[prefixed], self.symbol[0x20])
        lens = lens + prefixed
        out = np.zeros(len(lens), np.int64)
        long = lens > LONG
        bounds = np.concatenate([[0], np.cumsum(lens)])
        for i in np.flatnonzero(long):
            out[i] = self.merge_long(sym[bounds[i] : bounds[i + 1]])
        if not long.all():
            out[~long] = self.merge(sym[np.repeat(~long, lens)], lens[~long])
        return out

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of every text of a string column."""
        if pc.any(pc.match_substring(column, SPACE)).as_py():
            column = pc.replace_substring(column, SPACE, " ")
        counts = [np.zeros(0, np.int64)]
        for lo, hi, data, offs in chunks(column, 2 << 20):
            n = len(data)
            if not n:
                counts.append(np.zeros(hi - lo, np.int64))
                continue
            lone, space = self.lone[data], data == 0x20
            head = np.zeros(n + 1, bool)
            head[offs[:-1]] = True
            first = head[:n]
            new = first | lone | space
            new[1:] = first[1:] | lone[1:] | lone[:-1] | (space[1:] & ~space[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], n)
            unit = ~lone[starts]
            cost = np.ones(len(starts), np.int64)
            s, e = starts[unit], ends[unit]
            prefixed = first[s]
            h = hashes(running(data), s, e)
            h[prefixed] = mix(h[prefixed] + np.uint64(1))
            uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
            got = np.array([self.memo.get(x, -1) for x in uniq.tolist()], np.int64)
            miss = np.flatnonzero(got < 0)
            if len(miss):
                got[miss] = self._units(data, s[at[miss]], e[at[miss]], prefixed[at[miss]])
                if len(self.memo) + len(miss) > MEMO:
                    self.memo.clear()
                self.memo.update(zip(uniq[miss].tolist(), got[miss].tolist(), strict=True))
            cost[unit] = got[inv]
            total = np.concatenate([[0], np.cumsum(cost)])
            bounds = np.searchsorted(starts, offs)
            filled = np.flatnonzero(offs[1:] > offs[:-1])
            own = total[bounds[1:]] - total[bounds[:-1]]
            own[filled] += lone[offs[filled]]  # the space before a text is then a token of its own
            counts.append(own)
        return np.concatenate(counts)


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids
    are counted like any other; further columns are ignored. No begin, end or
    other special token is added, and special strings in a text are plain text.
    `model` is the model file's path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model or default_model())
        for batch in batches:
            text = batch.column(1).fill_null("")
            n = counter.count(text)
            _, offs = utf8(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
