"""The n-gram join and the compression score in plain Python."""

import math
import re

import zstandard


def shingles(text, width=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < width:
        return frozenset({tuple(words)} if words else ())
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def components(sets, pct=80):
    """The least position each set's links reach, over all pairs."""
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(sets))]


def quality_score(model, text):
    """The score of a text from a model's dictionaries and weights, block by block."""
    data, out = (text or "").encode(), []
    for fold in model.folds:
        size = {}
        for name in ("good", "bad"):
            c = zstandard.ZstdCompressor(level=fold.level, dict_data=zstandard.ZstdCompressionDict(getattr(fold, name)), write_content_size=False, write_checksum=False, write_dict_id=False)
            size[name] = lambda x, c=c: len(c.compress(x)) - len(c.compress(b""))
        by_larger, by_length = [], []
        for block in fold.blocks:
            cells = [(size["good"](x), size["bad"](x)) for x in (data[k : k + block] for k in range(0, len(data), block))]
            by_larger.append(sum((b - a) / max(1, a, b) for a, b in cells) / max(1, len(cells)))
            by_length.append(sum(b - a for a, b in cells) / max(1, len(data)))
        z = [(d - m) / s for d, m, s in zip(by_larger + by_length, fold.mean.tolist(), fold.scale.tolist(), strict=True)]
        terms = [*z, *(z[i] * z[j] for i in range(len(z)) for j in range(i + 1)), 1.0]
        logit = sum(t * w for t, w in zip(terms, fold.weights.tolist(), strict=True))
        out.append(1 / (1 + math.exp(-max(-500, min(500, logit)))))
    return sum(out) / len(out)
