"""Byte-pair merges of many sequences at once, held one after another in a flat symbol array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NONE = np.int32(2**31 - 1)


class Pairs:
    """Symbol pairs with the rank of their merge and the symbol it makes; m is above every symbol."""

    def __init__(self, m: int, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.m = m
        self.keys = keys.astype(np.int64)[order]
        self.ranks = ranks.astype(np.int32)[order]
        self.made = made.astype(np.int32)[order]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of symbol pairs; rank NONE where no merge joins them."""
        key = left.astype(np.int64) * self.m + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def survivors(self, sym: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(sequences, their symbols one after another, their lengths) as sequences of lens symbols are done.

        In each round every sequence applies its lowest-ranked pair, leftmost
        first. Empty sequences are never yielded.
        """
        who = np.flatnonzero(lens > 0)
        lens = lens[who]
        if not len(who):
            return
        ends = np.cumsum(lens)
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int32)
        rank[:-1], made[:-1] = self.pair(sym[:-1], sym[1:])
        rank[ends - 1] = NONE
        while len(who):
            best = np.minimum.reduceat(rank, np.cumsum(lens) - lens)
            over = best == NONE
            if over.any():
                stay = np.repeat(~over, lens)
                yield who[over], sym[~stay], lens[over]
                sym, rank, made = sym[stay], rank[stay], made[stay]
                who, lens, best = who[~over], lens[~over], best[~over]
                if not len(who):
                    break
            seq = np.repeat(np.arange(len(who)), lens)
            at = np.flatnonzero(rank == best[seq])
            at = at[np.concatenate([[True], seq[at[1:]] != seq[at[:-1]]])]
            sym[at] = made[at]
            left = np.ones(len(sym), bool)
            left[at + 1] = False
            sym, rank, made, seq = sym[left], rank[left], made[left], seq[left]
            lens = lens - 1
            at = at - np.arange(len(at))
            for p in (at[at > 0] - 1, at[at < len(sym) - 1]):
                p = p[seq[p] == seq[p + 1]]
                rank[p], made[p] = self.pair(sym[p], sym[p + 1])
            rank[np.cumsum(lens) - 1] = NONE

    def merged(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(surviving symbols of all sequences in order, their numbers)."""
        size = np.zeros(len(lens), np.int64)
        done = list(self.survivors(sym, lens))
        for who, _, n in done:
            size[who] = n
        starts = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.int32)
        for who, left, n in done:
            out[np.repeat(starts[who] - (np.cumsum(n) - n), n) + np.arange(len(left))] = left
        return out, size


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each range in turn."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
