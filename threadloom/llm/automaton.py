"""Aho-Corasick over bytes as one dense transition table, for numpy to walk many words at once."""

from __future__ import annotations

import numpy as np


def automaton(patterns: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """(next state by ``row[state] + byte``, ``row``, value of the longest pattern that ends in a state or -1,
    value of the next shorter pattern that ends a pattern, by its value).

    A state that no pattern goes on from moves as its failure state does, so both have one row.
    """
    child: list[dict[int, int]] = [{}]
    own = [-1]
    for pattern, value in patterns:
        at = 0
        for byte in pattern:
            nxt = child[at].get(byte)
            if nxt is None:
                nxt = child[at][byte] = len(child)
                child.append({})
                own.append(-1)
            at = nxt
        own[at] = value
    inner = [s for s, c in enumerate(child) if c or s == 0]
    go = np.zeros((len(inner), 256), np.int32)
    row = np.zeros(len(child), np.int64)
    row[inner] = np.arange(len(inner))
    longest = np.array(own, np.int32)
    shorter: dict[int, int] = {}
    level = [(s, 0) for s in child[0].values()]
    for byte, s in child[0].items():
        go[0, byte] = s
    while level:
        following = []
        for s, fail in level:
            if longest[s] < 0:
                longest[s] = longest[fail]
            elif longest[fail] >= 0:
                shorter[int(longest[s])] = int(longest[fail])
            if not child[s]:
                row[s] = row[fail]
                continue
            go[row[s]] = go[row[fail]]
            for byte, c in child[s].items():
                following.append((c, int(go[row[fail], byte])))
                go[row[s], byte] = c
        level = following
    return go.ravel(), row << 8, longest, shorter
