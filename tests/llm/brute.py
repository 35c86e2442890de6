"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def byte_dedup(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    seen: set[bytes] = set()
    out = {}
    for i, t in sorted(rows):
        x = (t or "").encode()
        gone = [False] * len(x)
        own = []
        for p in range(len(x) - 49):
            w = x[p : p + 50]
            if w in seen:
                gone[p : p + 50] = [True] * 50
            own.append(w)
        seen.update(own)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out[i] = (len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def katz(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, float, float]]:
    """n_tokens, n_known, train_tokens, base_score, score; for data whose Good-Turing factors all lie between 0 and 1, else absolute discounts."""
    end = b"</s>"
    tokens = {i: [*words(t), end] for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    one = collections.Counter(w for i in train for w in tokens[i])
    two, history = collections.Counter(), collections.Counter()
    for i in train:
        for h, w in zip([None, *tokens[i]], tokens[i], strict=False):
            two[h, w] += 1
            history[h] += 1
    n, v = sum(one.values()), len(one)

    def factors(counts):
        c = [0, *(sum(x == r for x in counts.values()) for r in range(1, 7))]
        flat = c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5
        last = 6 * c[6] / c[1] if c[1] else 1.0
        made = {r: ((r + 1) * c[r + 1] / c[r] / r - last) / (1 - last) if c[r] and last < 1 else 0.0 for r in range(1, 6)}
        return {r: d if 0 < d < 1 else (r - flat) / r for r, d in made.items()}

    f1, f2 = factors(one), factors(two)
    left = 1 - sum(c * f1.get(c, 1) for c in one.values()) / n
    scale = 1.0
    if left <= 1e-12:
        scale, left = n / (n + 1), 1 / (n + 1)
    uni = lambda w: one[w] * f1.get(one[w], 1) / n * scale if one[w] else left
    held, mass, some = collections.Counter(), collections.Counter(), set()
    for (h, w), c in two.items():
        held[h] += c * f2.get(c, 1) / history[h]
        mass[h] += uni(w)
        if c <= 5:
            some.add(h)

    def p(h, w):
        if not history[h]:
            return uni(w)
        c = two[h, w]
        if c:
            return c * f2.get(c, 1) / history[h] * (1 if h in some else history[h] / (history[h] + 1))
        free = 1 - held[h] if h in some else 1 / (history[h] + 1)
        return free / (1 - mass[h]) * uni(w)

    out = {}
    for i, t in tokens.items():
        score = sum(math.log10(p(h, w)) for h, w in zip([None, *t], t, strict=False))
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        out[i] = (len(t), sum(one[w] > 0 for w in t), n, base, score)
    return out


def byte_conv_score(w: dict, text: bytes) -> float:
    """A plain forward pass: each chunk of 256 bytes every 128, filters of 4 bytes every 2, in loops."""
    half, pad = 128, 256
    n = max(2, -(-(len(text) + 4) // half))
    data = list(text) + [pad] * (n * half - len(text))
    n_filters, n_features = len(w["bias"]), len(w["chunk_bias"])
    values = []
    for p in range(0, len(data), 2):
        now = [x for b in data[p : p + 2] for x in w["embed"][b].tolist()]
        after = [x for b in data[p + 2 : p + 4] for x in w["embed"][b].tolist()]
        got = [float(w["bias"][f]) + sum(x * float(w["left"][i][f]) for i, x in enumerate(now)) + sum(x * float(w["right"][i][f]) for i, x in enumerate(after)) for f in range(n_filters)]
        values.append(None if data[p] == pad else [max(v, 0.0) for v in got])
    best = [-math.inf] * n_features
    for c in range(n - 1):
        real = [v for v in values[c * half // 2 : (c + 2) * half // 2] if v is not None]
        mean = [sum(v[f] for v in real) / max(len(real), 1) for f in range(n_filters)]
        for k in range(n_features):
            best[k] = max(best[k], max(0.0, 4 * sum(m * float(w["chunk"][f][k]) for f, m in enumerate(mean)) + float(w["chunk_bias"][k])))
    return 1 / (1 + math.exp(-sum(b * float(x) for b, x in zip(best, w["out"].tolist(), strict=True)) - float(w["out_bias"][0])))
