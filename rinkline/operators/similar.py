"""Pairs of short texts whose ratio of matching blocks is over a limit, found exactly among two blocks of texts."""

from __future__ import annotations

import difflib

import numpy as np


def _unary(texts: list[str], levels: dict[str, int]) -> np.ndarray:
    """A row per text with a column per character and count up to its level: 1 where the text has the character so often."""
    at, width = {}, 0
    for c, n in levels.items():
        at[c], width = width, width + n
    out = np.zeros((len(texts), max(width, 1)), np.float32)
    for row, t in zip(out, texts, strict=True):
        for c in set(t):
            if c in at:
                row[at[c] : at[c] + min(t.count(c), levels[c])] = 1
    return out


def _levels(texts: list[str]) -> dict[str, int]:
    most: dict[str, int] = {}
    for t in texts:
        for c in set(t):
            most[c] = max(most.get(c, 0), t.count(c))
    return most


def common_length(text: str, codes: np.ndarray, alphabet: dict[str, int]) -> np.ndarray:
    """Length of the longest common subsequence of ``text`` with each row of character codes (-1 past its end).

    Bit-parallel (Hyyrö 2004), a word of 64 bits for each 64 characters of ``text``, over all rows at once.
    """
    words = max(1, -(-len(text) // 64))
    has = np.zeros((words, len(alphabet) + 1), np.uint64)  # the last column is for -1
    for k, c in enumerate(text):
        if c in alphabet:
            has[k // 64, alphabet[c]] |= np.uint64(1 << k % 64)
    state = np.full((words, len(codes)), ~np.uint64(0))
    for column in codes.T:
        carry = np.zeros(len(codes), bool)
        for w in range(words):
            v = state[w]
            u = v & has[w][column]
            total = v + u
            over = total < v
            if words > 1:
                full = total + carry
                over |= full < total
                total, carry = full, over
            state[w] = total | (v - u)
    return np.bitwise_count(~state).sum(0).astype(np.int64)


def pairs_over(texts: list[str], ids: np.ndarray, earlier: list[str], earlier_ids: np.ndarray, limit: float, first: bool) -> list[tuple[int, int]]:
    """``(id, earlier id)`` with the earlier id smaller and ``SequenceMatcher(None, text, earlier text).ratio() > limit``.

    ``first``: one pair a text is enough. Matching blocks are a common subsequence, and that is a common bag of
    characters, so both of these, cheap to get for many pairs at once, are upper bounds of the ratio.
    """
    mine, theirs = _levels(texts), _levels(earlier)
    levels = {c: min(n, theirs[c]) for c, n in mine.items() if c in theirs}
    alphabet = {c: k for k, c in enumerate(theirs)}
    length = np.array([len(t) for t in earlier], np.int64)
    codes = np.full((len(earlier), max(1, int(length.max(initial=0)))), -1, np.int32)
    for row, t in zip(codes, earlier, strict=True):
        row[: len(t)] = [alphabet[c] for c in t]
    bags, out, step = _unary(earlier, levels).T.copy(), [], 512
    for start in range(0, len(texts), step):
        common = _unary(texts[start : start + step], levels) @ bags
        for text, key, bag in zip(texts[start : start + step], ids[start : start + step], common, strict=True):
            both = np.maximum(length + len(text), 1)
            near = np.flatnonzero((2.0 * bag.astype(np.float64) / both > limit) & (earlier_ids < key)) if text else np.flatnonzero((length == 0) & (earlier_ids < key))
            if not len(near):
                continue
            if text:
                rows = codes[near, : int(length[near].max())]
                bound = 2.0 * common_length(text, rows, alphabet) / both[near]
                near = near[np.argsort(-bound, kind="stable")][: int((bound > limit).sum())]
            for k in near:
                if difflib.SequenceMatcher(None, text, earlier[k]).ratio() > limit:
                    out.append((int(key), int(earlier_ids[k])))
                    if first:
                        break
    return out
