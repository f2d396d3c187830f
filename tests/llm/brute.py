"""Plain versions of what the operators compute, for small tables."""

from __future__ import annotations

import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def smallest_of_component(n: int, links) -> list[int]:
    """Smallest index in reach of each index."""
    near = {i: set() for i in range(n)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = [-1] * n
    for i in range(n):
        if out[i] < 0:
            todo = [i]
            while todo:
                x = todo.pop()
                if out[x] < 0:
                    out[x] = i
                    todo += near[x]
    return out


def fingerprint(text: str) -> int:
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def rule_counts(text: str) -> dict:
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    held = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    seen, double = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            double += line in seen
            seen.add(line)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
           "n_dup_lines": double, "n_repeat_words": len(held)}
    out["base_failed"] = out["n_words"] < 10 or 100 * out["n_repeat_words"] > 20 * out["n_words"]
    return out


def shingles(line: str, width: int = 8) -> set[str]:
    return {line[i:i + width] for i in range(len(line) - width + 1)} or {line}


def alike(a: str, b: str) -> bool:
    x, y = shingles(a), shingles(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def dedup_lines(rows: list[tuple]) -> list[str | None]:
    """Texts after one line per component is left; rows are (doc_id, text)."""
    lines = []
    for r, (doc, text) in enumerate(rows):
        for i, line in enumerate((text or "").split("\n")):
            if len(WORD.findall(line)) >= 5:
                key = xxhash.xxh64_intdigest(text.encode(), 42)
                lines.append((doc is None, doc or 0, key - (1 << 64) if key >> 63 else key, i, r, line))
    lines.sort()
    root = smallest_of_component(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if alike(lines[i][5], lines[j][5])])
    gone = {(lines[i][4], lines[i][3]) for i in range(len(lines)) if root[i] != i}
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (r, i) not in gone)
            for r, (_, t) in enumerate(rows)]
