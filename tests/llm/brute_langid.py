"""Language ID by its definition, for models whose tables hold everything."""

import math
import zlib
from collections import Counter


def predict(rows, orders=5, longest=40):
    """``rows``: (doc_id, text, lang). Returns {doc_id: (language, score)}."""
    words = lambda text: "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")
    words = lambda text, of=words: [w for w in of(text) if w]
    train = [(t, lang) for i, t, lang in rows if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 5]
    counts = Counter((w, lang) for t, lang in train for w in words(t))
    languages = sorted({lang for _, lang in counts})
    known = {w for w, _ in counts if len(w) <= longest}
    total = {x: sum(n for (w, lang), n in counts.items() if lang == x and w in known) for x in languages}
    types = sum(w in known for w, _ in counts)
    grams = Counter()
    for (w, lang), n in counts.items():
        padded = f"^{w}$"
        for order in range(1, orders + 1):
            for i in range(len(padded) - order + 1):
                grams[padded[i : i + order], lang] += round(math.sqrt(n) * 65536)
    seen = {g for g, _ in grams}
    mass = {(order, x): sum(n for (g, lang), n in grams.items() if lang == x and len(g) == order) for order in range(1, orders + 1) for x in languages}

    def share(g):
        rate = [(grams[g, x] / 65536 + 0.02) / (1 + mass[len(g), x] / 65536) for x in languages]
        return [math.log(r / sum(rate)) for r in rate]

    def evidence(w):
        if w in known:
            return [math.log((counts[w, x] + 0.1) / (total[x] + 0.1 * types)) for x in languages]
        padded = f"^{w}$"
        for order in range(orders, 0, -1):
            hits = [share(g) for i in range(len(padded) - order + 1) if (g := padded[i : i + order]) in seen]
            if hits:
                return [sum(x) / len(hits) for x in zip(*hits, strict=True)]
        return [0.0] * len(languages)

    out = {}
    for i, text, _ in rows:
        found = words(text)
        if not found or not languages:
            out[i] = ("und", 0.0)
            continue
        z = [sum(x) / math.sqrt(len(found)) for x in zip(*map(evidence, found), strict=True)]
        e = [math.exp(x - max(z)) for x in z]
        out[i] = (languages[z.index(max(z))], max(e) / sum(e))
    return out
