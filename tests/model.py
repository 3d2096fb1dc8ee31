"""A brute-force model of indexing and BM25 over a handful of texts."""

import math
import re
from collections import Counter

TEXTS = [
    "A lighthouse keeper counts the ships by their lamps.",
    "The river carries silt and the delta grows.",
    "Ships wait for the tide at anchor.",
    "Salt, rope and tar: the harbor smells of old ships.",
    "Nobody's ladder reaches the clock.",
    "The clock tower leans over the river.",
    "Tar melts in July heat.",
    "Silt and salt.",
]


def bags(texts=TEXTS):
    return [Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())) for t in texts]


def bm25(query, mode, k1=1.2, b=0.75, texts=TEXTS):
    """[(document, score)] of the known query terms, best first, ties to the smaller document."""
    docs = bags(texts)
    mean = sum(sum(d.values()) for d in docs) / len(docs)
    df = {t: sum(t in d for d in docs) for t in query.lower().split()}
    weights = Counter(t for t in query.lower().split() if df[t])
    found = {}
    for i, d in enumerate(docs):
        has = [t for t in weights if d[t]]
        if has and (mode == "OR" or len(has) == len(weights)):
            norm = k1 * (1 - b + b * sum(d.values()) / mean)
            found[i] = sum(weights[t] * math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1) * d[t] * (k1 + 1) / (d[t] + norm) for t in has)
    return [(i, round(s, 6)) for i, s in sorted(found.items(), key=lambda x: (-round(x[1], 9), x[0]))]
