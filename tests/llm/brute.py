"""Plain-Python versions of the operators, for small tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import xxhash


def words(text):
    return (text or "").encode().split()


def lower(text):
    return (text or "").encode().lower().split()


def simhash(text, k=3):
    w = lower(text)
    if not w:
        return 0
    parts = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(docs):
    """docs: [(id, text)] with different ids -> {id: (fingerprint, component)}"""
    fp = {i: simhash(t) for i, t in docs}
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def repeats(docs, n=13):
    """[(id, text)] -> {id: (n_words, n_removed, sha)}"""
    least = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if least[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


class Automaton:
    """Arcs and failure arcs of a backoff automaton over words, written out as dictionaries."""

    def __init__(self, texts, k2=100.0, k3=8.0):
        one, two, three = Counter(), Counter(), Counter()
        for t in texts:
            seq = ["<s>", *t, "</s>"]
            one.update(seq)
            two.update(zip(seq, seq[1:]))
            three.update(zip(seq, seq[1:], seq[2:]))
        self.count = one
        self.n, self.v = sum(one.values()) - one["<s>"], len([w for w in one if w != "<s>"])
        self.arcs, self.fails = defaultdict(dict), {}
        for w in one:
            if w != "<s>":
                self.arcs[()][w] = (one[w] + 1) / (self.n + self.v + 1)
        self.unknown = 1 / (self.n + self.v + 1)
        for w in one:
            self.fails[w,] = k2 / (one[w] + k2)
        for (u, w), c in two.items():
            self.arcs[u,][w] = (c + k2 * self.arcs[()][w]) / (one[u] + k2)
            self.fails[u, w] = k3 / (c + k3)
        for (u, v, w), c in three.items():
            self.arcs[u, v][w] = (c + k3 * self.arcs[v,][w]) / (two[u, v] + k3)

    def step(self, state, w):
        """(probability, next state)"""
        p = 1.0
        while w not in self.arcs[state] and state:
            p, state = p * self.fails[state], state[1:]
        p *= self.arcs[state].get(w, self.unknown)
        state = (*state, w)[-2:]
        while state and state not in self.fails:
            state = state[1:]
        return p, state


def language_model(docs):
    """[(id, text)] -> {id: (held_out, n_tokens, n_known, N, base, score)}"""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    model = Automaton([lower(t) for i, t in docs if not held[i]])
    out = {}
    for i, t in docs:
        state, base, score, seq = ("<s>",) if model.count["<s>"] else (), 0.0, 0.0, [*lower(t), "</s>"]
        for w in seq:
            base += math.log10((model.count[w] + 1) / (model.n + model.v + 1))
            p, state = model.step(state, w)
            score += math.log10(p)
        out[i] = (held[i], len(seq), sum(model.count[w] > 0 for w in seq), model.n, base, score)
    return out
