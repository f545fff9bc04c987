"""Plain versions of the operators' results, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def components(docs: list[tuple], k: int = 5) -> dict:
    """id -> (set size, smallest id of its component) by comparing all pairs of sets."""
    sets = {}
    for i, text in docs:
        w = [x.lower() for x in WORD.findall((text or "").encode())]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def tiles(item: list, text: list, least: int) -> int:
    """Tokens covered by greedy string tiling, searching for the longest matches from scratch each time."""
    free_item, free_text, total = [True] * len(item), [t is not None for t in text], 0
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and free_item[i + n] and free_text[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= least:
                    found.append((i, j))
        if best < least:
            return total
        for i, j in found:
            if all(free_item[i : i + best]) and all(free_text[j : j + best]):
                free_item[i : i + best] = [False] * best
                free_text[j : j + best] = [False] * best
                total += best


def base_figures(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def sentence_runs(text: bytes, least_sentences: int, least_words: int, long_words: int) -> list[tuple[int, int, bytes]]:
    found = []
    for line in re.finditer(rb"[^\n]+", text):
        current = []
        for w in WORD.finditer(line[0]):
            current.append((w.start() + line.start(), w.end() + line.start()))
            if w[0].endswith((b".", b"!", b"?", "…".encode())):
                found.append(current)
                current = []
        if current:
            found.append(current)
    step, parts = long_words // 2, []
    for s in found:
        parts += [s[i : i + step] for i in range(0, len(s), step)] if len(s) > long_words else [s]
    out = []
    for i in range(len(parts)):
        n, j = 0, i
        while j < len(parts) and (n < least_words or j - i < least_sentences):
            n += len(parts[j])
            j += 1
        if n >= least_words and j - i >= least_sentences:
            out.append((parts[i][0][0], parts[j - 1][-1][1], b" ".join(text[a:b].lower() for s in parts[i:j] for a, b in s)))
    return out


def removed_sentences(docs: list[tuple[int, str]], *params: int) -> dict[int, list[tuple[int, int]]]:
    """id -> merged byte spans that non-first repeated runs cover."""
    seen, gone = set(), defaultdict(list)
    for i, text in sorted(docs):
        for a, b, run in sentence_runs(text.encode(), *params):
            if run in seen:
                gone[i].append((a, b))
            seen.add(run)
    out = {}
    for i, spans in gone.items():
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out[i] = [tuple(x) for x in merged]
    return out
