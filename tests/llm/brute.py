"""Plain Python versions of the contracts, as slow and as simple as can be."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import accumulate

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def simhash(text: str | None) -> int:
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps: list[int], most: int = 3) -> list[int]:
    """For every fingerprint the index of its component's first member."""
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def base_sha256(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text)).encode()).hexdigest()


def quality(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    repeat = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeat),
        "base_failed": n < 50 or 100 * len(repeat) > 50 * n,
    }


def lines_kept(docs: list[tuple[str | None, str | None]], max_ratio: float, min_pages: int) -> list[str | None]:
    """docs: (host, text); texts without boilerplate lines."""
    trim = lambda x: x.strip(" \t\x0b\x0c\r")
    pages: dict = {}
    for host, text in docs:
        pages.setdefault(host, set()).add(text)
    counts = Counter((h, x) for h, ts in pages.items() for t in ts for x in {trim(y) for y in (t or "").split("\n")} if x)
    bad = {k for k, n in counts.items() if n >= min_pages and n > max_ratio * len(pages[k[0]])}
    return [None if t is None else "\n".join(y for y in t.split("\n") if (h, trim(y)) not in bad) for h, t in docs]


def top(vectors: dict[int, list[int]], query: int, k: int) -> list[tuple[int, int]]:
    q = vectors[query]
    scored = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors.items() if i != query and len(v) == len(q)]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def viterbi(word: str, scores: dict[str, tuple[int, float]], byte: list[int], unknown: float) -> list[int]:
    """Best segmentation by trying every piece that ends at every position, longest first."""
    best: list[tuple[float, list[int]]] = [(0.0, [])]
    for end in range(1, len(word) + 1):
        options = [
            (best[s][0] + scores[word[s:end]][1], -k, best[s][1] + [scores[word[s:end]][0]])
            for k, s in enumerate(range(end))
            if word[s:end] in scores
        ]
        if word[end - 1 : end] not in scores:
            options.append((best[end - 1][0] + unknown, -end, best[end - 1][1] + [byte[b] for b in word[end - 1].encode()]))
        top_option = max(options, key=lambda x: (x[0], x[1]))
        best.append((top_option[0], top_option[2]))
    return best[-1][1]


def best_fit_decreasing(lengths: list[int], window: int) -> int:
    """Number of windows that piece-by-piece best-fit decreasing opens."""
    free: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= x]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - x)
        else:
            free.append(window - x)
    return len(free)


def url_scores(texts: dict[str, int], labels: dict[str, int | None], order: int) -> dict[str, float]:
    """Log-likelihood difference by character of two Witten-Bell models, for texts with their numbers of rows."""
    count: list[Counter] = [Counter(), Counter()]
    for t, n in texts.items():
        s = "\x02" + t + "\x03"
        if labels[t] is not None:
            for i in range(1, len(s)):
                for k in range(min(order, i) + 1):
                    count[labels[t]][s[i - k : i + 1]] += n
    total: list[Counter] = [Counter(), Counter()]
    kinds: list[Counter] = [Counter(), Counter()]
    for c in (0, 1):
        for g, n in count[c].items():
            total[c][g[:-1]] += n
            kinds[c][g[:-1]] += 1

    def p(c: int, h: str, x: str) -> float:
        lower = p(c, h[1:], x) if h else 1 / 256
        return (count[c][h + x] + kinds[c][h] * lower) / (total[c][h] + kinds[c][h]) if total[c][h] else lower

    out = {}
    for t in texts:
        s = "\x02" + t + "\x03"
        at = range(1, len(s))
        out[t] = sum(math.log(p(1, s[max(0, i - order) : i], s[i]) / p(0, s[max(0, i - order) : i], s[i])) for i in at) / len(at)
    return out


def region(lengths, window, surge, line, gap):
    """First line and last line + 1 of the largest stretch of high window sums, all lines in one part of the page."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    bar = surge * max(sum(min(x, line) for x in lengths[i : i + window]) for i in range(len(lengths)))
    high = [i for i in range(len(lengths)) if lengths[i] and sums[i] >= bar]
    if not high:
        return 0, 0
    first, end = high[0], high[-1] + 1
    while end < len(lengths) and end < high[-1] + window and lengths[end]:
        end += 1
    return first, end


def alignments(texts: list[str | None]) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text, by both libraries on whole texts."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}

    def piece(i: int) -> bytes:
        x = sp.id_to_piece(i)
        return bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("\u2581", " ").encode()

    docs = []
    for t in texts:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        x, y = [bytes(byte[c] for c in tok.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            docs.append([])
            continue
        groups = []
        ends_a, ends_b = ({end: k + 1 for k, end in enumerate(accumulate(map(len, z)))} for z in (x, y))
        at_a = at_b = 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            stop_a, stop_b = ends_a[end], ends_b[end]
            groups.append((a[at_a:stop_a], b[at_b:stop_b]))
            at_a, at_b = stop_a, stop_b
        docs.append(groups)
    linked = [[(i, j) for a, b in groups for i in a for j in b] for groups in docs]
    count = Counter(p for pairs in linked for p in set(pairs))
    most: dict[int, int] = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for groups, pairs in zip(docs, linked):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        n_a, n_b = (sum(len(g[k]) for g in groups) for k in (0, 1))
        out.append((n_a, n_b, len(groups), len(pairs), sum(count[p] == most[p[0]] for p in pairs), sum(count[p] for p in pairs), sha))
    return out


def similar_sets(texts: list[str | None], percent: int) -> tuple[list[int], list[int]]:
    """Sizes of the sets of five-word shingles, and for every text the index of its component's first member."""
    sets = []
    for t in texts:
        words = WORD.findall(ascii_lower(t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return list(map(len, sets)), [find(i) for i in range(len(sets))]


def lloyd(vectors: dict[int, list[int]], k: int, rounds: int) -> tuple[dict[int, tuple[int, int]], list[list[int]]]:
    """Of every vector (cluster, squared distance) after so many rounds, and the centroids."""
    first = sorted(vectors, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:k]
    centroids = [vectors[i] for i in first]
    distance = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (distance(v, centroids[c]), c))
    for _ in range(rounds):
        own = {i: nearest(v) for i, v in vectors.items()}
        for c in range(len(centroids)):
            mine = [vectors[i] for i in own if own[i] == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return {i: (nearest(v), distance(v, centroids[nearest(v)])) for i, v in vectors.items()}, centroids
