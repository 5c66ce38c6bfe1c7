"""Bit-parallel edit distance: the columns of the dynamic program are the bits of one integer."""

from __future__ import annotations

from collections.abc import Sequence


def _masks(pattern: Sequence) -> dict:
    masks: dict = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _scores(pattern: Sequence, text: Sequence, anywhere: bool):
    """After each item of text, the distance of the whole pattern to the text so far (anywhere: to its best suffix)."""
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    masks = _masks(pattern)
    plus, minus, score = full, 0, len(pattern)
    for c in text:
        eq = masks.get(c, 0)
        x = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(h | plus)), plus & h
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1 | (not anywhere)) & full, down << 1 & full
        plus, minus = down | (full & ~(x | up)), up & x
        yield score


def distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences."""
    if not a or not b:
        return len(a) + len(b)
    score = 0
    for score in _scores(a, b, False):  # noqa: B007
        pass
    return score


def best_match(pattern: Sequence, text: Sequence, budget: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the first substring of text closest to pattern, if it is within the budget."""
    if not pattern:
        return None
    best, end = budget + 1, -1
    for i, score in enumerate(_scores(pattern, text, True)):
        if score < best:
            best, end = score, i + 1
            if not best:
                break
    if end < 0:
        return None
    back, length = len(pattern) + 1, 0
    for i, score in enumerate(_scores(pattern[::-1], text[:end][::-1], True)):
        if score < back:
            back, length = score, i + 1
            if back <= best:
                break
    return best, end - length, end
