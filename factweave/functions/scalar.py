"""Scalar functions that no built-in expresses: identifier search."""

from __future__ import annotations


def fuzzy_score(pattern: str, text: str) -> int:
    """Score of pattern as a subsequence of text, 0 if it is none: a match at a word's head counts 3, one that follows the
    last match 2, any other 1; the best of all ways counts."""
    if not pattern:
        return 0
    head = [i == 0 or not text[i - 1].isalnum() or (text[i].isupper() and text[i - 1].islower()) for i in range(len(text))]
    low, want = text.lower(), pattern.lower()
    best = [[0] * len(text) for _ in want]
    for k, c in enumerate(want):
        for i in range(k, len(text)):
            if low[i] != c:
                continue
            own = 3 if head[i] else 1
            if k == 0:
                best[k][i] = own
            else:
                before = [best[k - 1][j] + (max(own, 2) if j == i - 1 else own) for j in range(i) if best[k - 1][j]]
                best[k][i] = max(before, default=0)
    return max(best[-1], default=0)
