"""A linear-chain conditional random field over the words of sentences, for
whole batches of texts at once.

A word's score for each label sums the learned weights of its features: its
letters' bigrams and trigrams with both ends marked, its first and last three
and four letters, and the languages whose lexicon holds it. Neighbouring words
are tied by learned transition weights. Forward-backward gives each word's
probability of each label; sentences are walked in step, longest first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from corpusloom.llm.arrow import code_points

FEATURES = 1 << 16
BREAKS = "\n.!?\r\x0b\x0c  "
_EDGE = 2
_ALPHA = np.array([chr(i).isalpha() and not 0xD800 <= i < 0xE000 for i in range(1 << 16)])
_BREAK = np.zeros(1 << 16, bool)
_BREAK[[ord(c) for c in BREAKS]] = True
_P1, _P2, _P3 = (np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _P2
    return (mixed >> np.uint64(48)).astype(np.int64)


@dataclass
class Words:
    """The words of a batch. `start` and `size` are positions in `chars`, the
    words' lower-case letters end to end; `spot` is where a word begins in the
    lower-cased texts. `sentence` starts a new number wherever a sentence or a
    text begins; `text` is the row."""

    chars: np.ndarray
    start: np.ndarray
    size: np.ndarray
    spot: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    name: np.ndarray


def words_of(texts: list[str]) -> Words:
    points, lengths = code_points([t.lower() for t in texts])
    low = np.minimum(points, 0xFFFF)
    alpha = _ALPHA[low]
    wide = np.flatnonzero(points > 0xFFFF)
    if len(wide):
        alpha[wide] = [chr(p).isalpha() for p in points[wide]]
    text_of = np.repeat(np.arange(len(texts)), lengths)
    begins = np.zeros(len(points), bool)
    ends = np.cumsum(lengths)
    begins[(ends - lengths)[lengths > 0]] = True
    before = np.concatenate([[False], alpha[:-1]]) if len(alpha) else alpha
    first = alpha & (~before | begins)
    spot = np.flatnonzero(first)
    chars = points[alpha].astype(np.uint64)
    start = np.cumsum(alpha)[spot] - 1 if len(spot) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(chars)))
    breaks = np.cumsum(_BREAK[low] | begins)
    sentence = breaks[spot] if len(spot) else np.zeros(0, np.int64)
    # A word that opens a sentence right behind a break shares its number.
    if len(chars):
        at = np.arange(len(chars)) - np.repeat(start, size)
        power = np.ones(int(size.max()) + 1, np.uint64)
        power[1:] = np.cumprod(np.full(int(size.max()), _P1))
        name = np.add.reduceat((chars + np.uint64(7)) * power[at], start)
    else:
        name = np.zeros(0, np.uint64)
    return Words(chars, start, size, spot, sentence, text_of[spot] if len(spot) else spot, name)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, and the word of each."""
    n = len(words.size)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Each word between two edge marks.
    padded = np.full(len(words.chars) + 2 * n, _EDGE, np.uint64)
    owner = np.repeat(np.arange(n), words.size + 2)
    begin = words.start + 2 * np.arange(n)
    own = np.arange(len(words.chars)) + np.repeat(2 * np.arange(n) + 1, words.size)
    padded[own] = words.chars
    found, of = [], []
    for gram in (2, 3):
        last = len(padded) - gram + 1
        h = np.full(last, gram, np.uint64)
        for j in range(gram):
            h = h * _P1 + padded[j : j + last]
        inside = owner[:last] == owner[gram - 1 :]
        found.append(_bucket(h[inside]))
        of.append(owner[:last][inside])
    for length in (3, 4):
        long = np.flatnonzero(words.size >= length)
        for kind, at in ((1, begin[long] + 1), (2, begin[long] + 1 + words.size[long] - length)):
            h = np.full(len(long), 16 * length + kind, np.uint64)
            for j in range(length):
                h = h * _P3 + padded[at + j]
            found.append(_bucket(h))
            of.append(long)
    return np.concatenate(found), np.concatenate(of)


@dataclass
class Model:
    labels: list[str]
    weight: np.ndarray  # FEATURES x labels
    lexicon: np.ndarray  # languages of the lexicon x labels
    start: np.ndarray
    move: np.ndarray  # from x to
    names: np.ndarray  # sorted word hashes of the lexicon
    known: np.ndarray  # and the languages that hold each

    @classmethod
    def blank(cls, labels: list[str], names: np.ndarray, known: np.ndarray) -> Model:
        n = len(labels)
        return cls(
            labels,
            np.zeros((FEATURES, n), np.float32),
            np.zeros((n, n), np.float32),
            np.zeros(n, np.float32),
            np.zeros((n, n), np.float32),
            names,
            known,
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def parts(self) -> list[np.ndarray]:
        return [self.weight, self.lexicon, self.start, self.move]

    def take(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size


@dataclass
class _Chains:
    """Sentences sorted by length: at step `t`, the first `alive[t]` go on."""

    first: np.ndarray
    alive: np.ndarray


def _chains(words: Words) -> _Chains:
    first = np.flatnonzero(np.diff(words.sentence, prepend=-1))
    size = np.diff(np.append(first, len(words.sentence)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    alive = len(size) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1)) if len(size) else size
    return _Chains(first, alive)


def _in_lexicon(model: Model, words: Words) -> np.ndarray:
    if not len(model.names):
        return np.zeros((len(words.name), len(model.labels)), np.float32)
    at = np.minimum(np.searchsorted(model.names, words.name), len(model.names) - 1)
    return np.where((model.names[at] == words.name)[:, None], model.known[at], 0).astype(np.float32)


def _emissions(model: Model, words: Words, found, of, lex) -> np.ndarray:
    order = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[order], np.arange(len(words.size)))
    score = np.add.reduceat(model.weight[found[order]], begin) if len(order) else model.weight[:0]
    return score + lex @ model.lexicon


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(1, keepdims=True)


def forward_backward(
    model: Model, score: np.ndarray, chains: _Chains, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Each word's label probabilities; with `pairs`, the expected number of
    each transition over all sentences."""
    n_labels = score.shape[1]
    local = np.exp(score - score.max(1, keepdims=True)).astype(np.float64) + 1e-30
    move = np.exp(model.move.astype(np.float64))
    ahead = np.empty_like(local)
    back = np.ones_like(local)
    expected = np.zeros((n_labels, n_labels))
    first, alive = chains.first, chains.alive
    ahead[first] = _normal(np.exp(model.start.astype(np.float64)) * local[first])
    for t in range(1, len(alive)):
        at = first[: alive[t]] + t
        ahead[at] = _normal((ahead[at - 1] @ move) * local[at])
    for t in range(len(alive) - 1, 0, -1):
        at = first[: alive[t]] + t
        carried = local[at] * back[at]
        back[at - 1] = _normal(carried @ move.T)
        if pairs:
            joint = ahead[at - 1][:, :, None] * move[None] * carried[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return _normal(ahead * back), expected


def label_probabilities(model: Model, words: Words) -> np.ndarray:
    if not len(words.size):
        return np.zeros((0, len(model.labels)))
    found, of = features(words)
    score = _emissions(model, words, found, of, _in_lexicon(model, words))
    return forward_backward(model, score, _chains(words))[0]


def train(
    model: Model, batches: list[tuple[Words, np.ndarray]], rate: float = 0.5, decay: float = 1e-6
) -> None:
    """One pass of stochastic gradient steps with per-weight rates. A batch is
    its words and the label of each."""
    squares = [np.full(p.shape, 1.0, np.float32) for p in model.parts()]
    for words, label in batches:
        n = len(words.size)
        if not n:
            continue
        found, of = features(words)
        lex = _in_lexicon(model, words)
        chains = _chains(words)
        score = _emissions(model, words, found, of, lex)
        prob, expected = forward_backward(model, score, chains, pairs=True)
        gold = np.eye(len(model.labels))[label]
        off = gold - prob
        seen = np.zeros_like(expected)
        inner = np.flatnonzero(np.diff(words.sentence) == 0)
        np.add.at(seen, (label[inner], label[inner + 1]), 1)
        by_feature = np.stack(
            [np.bincount(found, off[of, c], FEATURES) for c in range(off.shape[1])], 1
        )
        gradient = [
            by_feature / n,
            lex.T @ off / n,
            off[chains.first].sum(0) / n,
            (seen - expected) / n,
        ]
        for p, g, s in zip(model.parts(), gradient, squares, strict=True):
            g = 100 * g - decay * p
            s += g * g
            p += (rate * g / np.sqrt(s)).astype(np.float32)
