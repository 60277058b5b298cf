"""Katz scores computed plainly, one dictionary for each order."""

import math
import zlib
from collections import Counter, defaultdict

LOW, HIGH = 5, 0.999


def factors(counts):
    """Discount factor of each count 1..LOW, by Katz (1987), eq. 15; absolute discounting where that
    leaves (0, 1). Higher counts keep HIGH of themselves."""
    n = Counter(counts.values())
    out = {}
    for r in range(1, LOW + 1):
        if not n[1]:
            out[r] = HIGH
            continue
        common = (LOW + 1) * n[LOW + 1] / n[1]
        star = (r + 1) * n[r + 1] / n[r] if n[r] else 0
        d = (star / r - common) / (1 - common) if n[r] and common < 1 else -1
        if not 0 < d < 1:
            less = n[1] / (n[1] + 2 * n[2])
            d = 1 - less / r if less < r else 0.5
        out[r] = d
    return out


def katz(rows, folds=7, held=2):
    docs = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    is_held = {i: zlib.crc32(str(i).encode()) % folds == held for i in docs}
    uni, bi = Counter(), Counter()
    for i, w in docs.items():
        if not is_held[i]:
            uni.update(w)
            bi.update(zip([b"", *w[:-1]], w, strict=True))
    total, types = sum(uni.values()), len(uni)

    d1, d2 = factors(uni), factors(bi)
    factor = lambda d, c: d[c] if c <= LOW else HIGH
    p1 = {w: factor(d1, c) * c / total for w, c in uni.items()}
    unknown = 1 - sum(p1.values()) if total else 1.0
    seen = defaultdict(list)
    for (v, w), c in bi.items():
        seen[v].append((w, c))
    alpha = {v: (1 - sum(factor(d2, c) * c for _, c in ws) / uni[v]) / (1 - sum(p1[w] for w, _ in ws)) for v, ws in seen.items()}
    out = {}
    for i, w in docs.items():
        base = sum(math.log10((uni[x] + 1) / (total + types + 1)) for x in w)
        score = 0.0
        for v, x in zip([b"", *w[:-1]], w, strict=True):
            c = bi[v, x]
            score += math.log10(factor(d2, c) * c / uni[v] if c else alpha.get(v, 1.0) * p1.get(x, unknown))
        out[i] = (is_held[i], len(w), sum(uni[x] > 0 for x in w), total, base, score)
    return out, (uni, bi, p1, unknown, alpha, d2)
