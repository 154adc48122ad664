"""Plain Python versions of the models' and fingerprints' rules, to compare with."""

import math
import re
import zlib

M = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mix(x):
    x &= M
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & M
    return x ^ (x >> 32)


def hash_of(raw: bytes) -> int:
    return mix(sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(raw)) + len(raw) * 0xA24BAED4963EE407)


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def single(x):
    """As a 32-bit float."""
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


class Ftrl:
    """FTRL-proximal, one coordinate after another; the key None is the bias, without a penalty."""

    def __init__(self, alpha, l1, l2, beta=1.0):
        self.alpha, self.l1, self.l2, self.beta = alpha, l1, l2, beta
        self.z, self.n = {}, {}

    def weight(self, k):
        z, n, l1 = self.z.get(k, 0.0), self.n.get(k, 0.0), 0.0 if k is None else self.l1
        return 0.0 if abs(z) <= l1 else (math.copysign(l1, z) - z) / ((self.beta + math.sqrt(n)) / self.alpha + self.l2)

    def learn(self, x: dict, y: float):
        x = x | {None: 1.0}
        w = {k: self.weight(k) for k in x}
        error = sigmoid(math.fsum(w[k] * v for k, v in x.items())) - y
        for k, v in x.items():
            g, n = error * v, self.n.get(k, 0.0)
            self.z[k] = self.z.get(k, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w[k]
            self.n[k] = n + g * g

    def score(self, x: dict):
        return sigmoid(math.fsum(single(self.weight(k)) * v for k, v in (x | {None: 1.0}).items()))


def training_order(labelled: dict) -> list:
    """Ids of labelled rows in the order of training."""
    return sorted(labelled, key=lambda i: (zlib.crc32(f"o{i}".encode()), i))


# quality


def quality_vector(text: str) -> dict:
    raw = (text or "").encode()
    tokens = [(m.group(), m.lastgroup) for m in re.finditer(rb"(?P<w>[0-9A-Za-z_\x80-\xff]+)|(?P<s>[^0-9A-Za-z_\x80-\xff\x09-\x0d\x20]+)", raw)]
    hashes, shapes, last = [], [], None
    for t, kind in tokens:
        h = hash_of(t)
        upper, lower, digit = (sum(a <= c <= b for c in t) for a, b in ((65, 90), (97, 122), (48, 57)))
        if kind == "w":
            shape = 5 if digit else (4 if upper > 1 else 3) if upper and not lower else 2 if upper else 1
            shapes.append(shape + 8 * (t == last))
            last = t
        else:
            shapes.append(h)
        hashes.append(h)
    counts = {}

    def count(x):
        k = mix(x) & (1 << 18) - 1
        counts[k] = counts.get(k, 0) + 1

    for h in hashes:
        count(h)
    for x, most, seed in ((hashes, 2, 101), (shapes, 3, 211)):
        grams = list(x)
        if seed == 211:
            for g in grams:
                count(g + seed)
        for n in range(2, most + 1):
            grams = [mix(g * BASE + h) for g, h in zip(grams, x[n - 1 :], strict=False)]
            for g in grams:
                count(g + seed + n)
    norm = math.sqrt(max(1.0, sum(counts.values())))
    return {k: math.sqrt(n) / norm for k, n in counts.items()}


def quality_scores(texts: dict, labels: dict, epochs: int = 3) -> dict:
    model = Ftrl(0.5, 0.02, 0.1)
    vectors = {i: {k: single(v) for k, v in quality_vector(texts[i]).items()} for i in labels}
    for _ in range(epochs):
        for i in training_order(labels):
            model.learn(vectors[i], labels[i])
    return {i: model.score(quality_vector(t)) for i, t in texts.items()}


# toxicity


def toxicity_features(text: str) -> dict:
    raw = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    out = {}
    begins = {}
    for w in set(re.findall(rb"[0-9A-Za-z_\x80-\xff]+", raw)):
        out[hash_of(w) >> 44] = 1.0
        for n in (4, 5, 6, 7, 8):
            if len(w) >= n:
                begins[w[:n]] = begins.get(w[:n], 0) + 1
    for b, n in begins.items():
        x = mix(hash_of(b) + len(b))
        for h in (x, *(mix(x + least) for least in (2, 4) if n >= least)):
            out[h >> 44] = 1.0
    return out


def toxicity_scores(texts: dict, labels: dict, categories: dict, folds: int = 4) -> dict:
    """Probabilities of each link by id; labels are 0/1 by id, category labels follow from seed words."""
    order = training_order(labels)
    rows = [toxicity_features(texts[i]) for i in order]
    words = lambda t: set(re.split(r"[^\w]+", (t or "").lower()))
    y = [[float(labels[i] == 1 and bool(words(texts[i]) & set(seeds))) for seeds in categories.values()] + [float(labels[i])] for i in order]
    links, epochs = len(categories) + 1, min(20, max(3, 24_000 // max(1, len(order))))
    before = [[] for _ in order]
    models = []

    def train(k, use):
        m = Ftrl(0.3, 1.0, 0.5)
        for _ in range(epochs):
            for r in use:
                m.learn(rows[r] | {("link", j): p for j, p in enumerate(before[r])}, y[r][k])
        return m

    for k in range(links):
        models.append(train(k, range(len(order))))
        if k + 1 < links:
            found = {}
            for f in range(folds):
                m = train(k, [r for r in range(len(order)) if r % folds != f])
                found |= {r: m.score(rows[r] | {("link", j): p for j, p in enumerate(before[r])}) for r in range(f, len(order), folds)}
            for r, p in found.items():
                before[r] = [*before[r], p]
    out = {}
    for i, t in texts.items():
        p = []
        for m in models:
            p.append(m.score(toxicity_features(t) | {("link", j): x for j, x in enumerate(p)}))
        out[i] = p
    return out


# Order MinHash


def order_minhash(text: str, k: int, xors, multipliers) -> str:
    """The fingerprint in hex; xors and multipliers make the hash functions."""
    roll = 0xD1342543DE82EF95
    codes = [ord(c) + 1 for c in text]
    grams, seen = [], {}
    if 0 < len(codes) < k:
        grams = [mix(sum(c * pow(roll, i + 1, 1 << 64) for i, c in enumerate(codes)) + len(codes))]
    elif codes:
        for a in range(len(codes) - k + 1):
            x = mix(sum(c * pow(roll, k - j, 1 << 64) for j, c in enumerate(codes[a : a + k])))
            grams.append(mix(x + seen.get(x, 0) * BASE))
            seen[x] = seen.get(x, 0) + 1
    out = b""
    for xor, times in zip(xors, multipliers, strict=True):
        best = sorted((((g >> 32) ^ xor) * times & 0xFFFFFFFF, at) for at, g in enumerate(grams))[:2]
        places = sorted(at for _, at in best)
        pair = [0] * (2 - len(places)) + [grams[at] for at in places]
        out += (mix(pair[0] * pow(roll, 2, 1 << 64) + pair[1] * roll) >> 48).to_bytes(2, "big")
    return out.hex()
