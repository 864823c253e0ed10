"""Language-model scores from causal self-attention trained in numpy on subword ids.

A token is a word or a text's end; its subwords are those of the dealt vocabulary. Two causal
attention models make up a token's probability by the model:

* the outer one reads all subwords of all tokens before (a token's vector is the mean of its
  subwords' embeddings) and emits a distribution over the subword that the next token begins with;
* the inner one reads the subwords of a token so far and emits the next one, or the token's end. It
  depends on the token alone, so it is trained on and computed for distinct words only.

Both emit the class of a subword; within its class a subword has its share of the corpus. The
model is mixed with counts, in shares that the outer attention chooses for each token: for every slot of
languages, the chance of the first subword there, times the token's share among the slot's tokens that begin
with it. Words that training does not hold are one type for each first subword there (as all of them
are one in the base), as likely as the words seen once.

Long texts are scored in overlapping windows of tokens: each token once, with at least
``WIDTH - STRIDE`` tokens before it where the text has them. Training takes every window.
"""

from __future__ import annotations

import functools
import itertools
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _MARKS, _Ragged, _sums, byte_alphabet, encoder, vocabulary_path
from .common import ready, text_or_empty, written
from .words import _LOWER, _SPACE, mixed, utf8

#: Tokens of a window, tokens from one to the next, and the size of a vector.
WIDTH, STRIDE, DIM = 24, 18, 16
#: The same for the subwords of a token.
INNER_WIDTH, INNER_STRIDE = 8, 6
#: Classes of subwords with a vector of their own, that are told apart in an output, and language slots.
BINS, CLASSES, SLOTS = 2048, 32, 8
#: Windows of a training step and of a scoring step, and steps between updates of the outer embeddings.
STEP, BATCH, TURN = 128, 128, 8

_SALT = np.random.default_rng(20250301).integers(1, 2**63, 1 << 17, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _numbers(known: dict, keys: list) -> tuple[np.ndarray, list]:
    """Numbers of keys, of which new ones get the next numbers and are returned."""
    at = np.fromiter(map(known.get, keys, itertools.repeat(-1)), np.int64, len(keys))
    new = np.flatnonzero(at < 0)
    if not len(new):
        return at, []
    own = [keys[i] for i in new.tolist()]
    fresh = list(dict.fromkeys(own))
    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
    at[new] = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
    return at, fresh


def _binary(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes that follow each other in an array, by where each ends in it."""
    offsets = np.concatenate([[0], ends * raw.itemsize]).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    return whole.cast(pa.binary())


class Coder:
    """All subword ids of the tokens of texts; those of words that were seen before are kept, at most ``limit``."""

    def __init__(self, path: str, limit: int = 800_000) -> None:
        pieces = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        alphabet = byte_alphabet()
        self.of_byte = np.array([pieces[c] for c in alphabet], np.uint32)
        self.end = max(pieces.values()) + 1
        self.n = self.end + 1
        self.kind = "<u2" if self.n < 1 << 16 else "<u4"
        self.begins = np.zeros(self.n, bool)
        self.begins[[i for p, i in pieces.items() if p[0] == alphabet[32]] + [self.end]] = True
        self.path, self.limit = path, limit
        self.reset()

    def reset(self) -> None:
        self.words, self.of_word = {b"": 0}, _Ragged()  # no word is empty: the first is a text's end
        self.of_word.append(np.array([self.end], np.uint32), np.ones(1, np.int64))
        self.parts, self.of_part = {}, _Ragged()

    def _learn(self, fresh: list[bytes]) -> None:
        """Words as the tokenizer has them after a space; those that it might not give back are bytes."""
        whole = encoder(self.path)  # read where new words come up, not where ids are read back
        keys: list[str] = []
        counts, odd = np.ones(len(fresh), np.int64), {}
        for i, w in enumerate(b"\n".join(fresh).decode("utf-8", "replace").split("\n")):  # no word holds a line feed
            if w.isalpha():  # most words
                keys.append(" " + w)
            elif w[-1] in _MARKS and w[:-1].isalpha():
                keys += (" " + w[:-1], w[-1])
                counts[i] = 2
            elif w.isprintable() and "\ufffd" not in w:
                own = whole.split(" " + w)
                keys += own
                counts[i] = len(own)
            else:
                odd[i] = self.of_byte[np.frombuffer(b" " + fresh[i], np.uint8)]
                keys.append("!")
        at, unseen = _numbers(self.parts, keys)
        if unseen:
            self.of_part.append(*whole.pretokens(unseen))
        ids, lengths = self.of_part.take(at)
        lengths = _sums(lengths, counts)
        if odd:
            runs = np.split(ids, np.cumsum(lengths)[:-1])
            for i, own in odd.items():
                runs[i], lengths[i] = own, len(own)
            ids = np.concatenate(runs)
        self.of_word.append(ids, lengths)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in turn, ids of each token, and tokens of each row (its words, then its end)."""
        if len(self.words) > self.limit:
            self.reset()
        raw, offsets = utf8(column)
        low = _LOWER[raw]
        inside = ~_SPACE[low]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[:-1][np.diff(offsets) > 0]
        begins[edges] = inside[edges]
        n = np.diff(np.searchsorted(np.flatnonzero(begins), offsets)) + 1
        start = np.flatnonzero(begins[inside])
        low = low[inside]
        # words that occur again in the batch are looked up once
        each = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(low))), pa.py_buffer(low)]).dictionary_encode()
        at, fresh = _numbers(self.words, each.dictionary.to_numpy(zero_copy_only=False).tolist())
        if fresh:
            self._learn(fresh)
        token = np.zeros(int(n.sum()), np.int64)
        word = np.ones(len(token), bool)
        word[np.cumsum(n) - 1] = False
        token[word] = at[each.indices.to_numpy()]
        ids, size = self.of_word.take(token)
        return ids, size, n


@functools.lru_cache(maxsize=1)
def coder(path: str) -> Coder:
    return Coder(path)


def token_hashes(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of tokens by their subwords."""
    first = np.cumsum(size) - size
    place = np.arange(len(ids)) - np.repeat(first, size)
    powers = np.cumprod(np.full(int(size.max()), _BASE, np.uint64), dtype=np.uint64)
    return mixed(np.add.reduceat(_SALT[ids & (len(_SALT) - 1)] * powers[place], first) ^ size.astype(np.uint64))


def unpacked(column: pa.Array, made: Coder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in turn, ids of each token and tokens of each row, from rows of packed ids."""
    raw, offsets = utf8(column)
    ids = raw.view(made.kind).astype(np.int64)
    first = np.flatnonzero(made.begins[ids])
    return ids, np.diff(first, append=len(ids)), np.diff(np.searchsorted(first, offsets // np.dtype(made.kind).itemsize))


def windows(n: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows over runs of ``n`` things: the first thing, how many there are, and how many at its
    beginning are scored by the window before."""
    count = 1 + np.maximum(n - width + stride - 1, 0) // stride
    run = np.repeat(np.arange(len(n)), count)
    place = (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)) * stride
    return (np.cumsum(n) - n)[run] + place, np.minimum(n[run] - place, width), np.where(place > 0, width - stride, 0)


def equal_masses(counts: np.ndarray, kinds: np.ndarray, lean: np.ndarray, parts: int) -> np.ndarray:
    """A class for each subword: classes hold one kind, about a ``parts``-th of all counts or one
    subword that counts more, and those that lean to the same slot stand together."""
    order = np.lexsort((np.arange(len(counts)), -counts, lean, kinds))
    mass = counts[order]
    at = ((np.cumsum(mass) - mass / 2) / mass.sum() * parts).astype(np.int64)
    new = (np.diff(at, prepend=at[0]) != 0) | (np.diff(kinds[order], prepend=kinds[order][0]) != 0)
    out = np.empty(len(counts), np.int64)
    out[order] = np.cumsum(new)
    return out


class Lexicon:
    """What the models know of single subwords, from their counts (ids, slots) over the whole training corpus."""

    def __init__(self, counts: np.ndarray, firsts: np.ndarray, once: np.ndarray, begins: np.ndarray) -> None:
        """``firsts`` counts tokens by first subword, ``once`` those of words that occur once."""
        total = counts.sum(axis=1)
        alpha = min(0.5, 0.01 * max(total.sum(), 1) / len(total))
        soft = total + alpha
        lean = ((counts + alpha / SLOTS) / (counts.sum(axis=0) + alpha)).argmax(axis=1)
        end = np.zeros(len(soft), np.int64)
        end[-1] = 2  # a text's end is a class of its own
        self.bins = equal_masses(soft, begins + end, lean, BINS).astype(np.int32)
        self.n_bins = int(self.bins.max()) + 2  # the last stands before a text
        self.classes, self.share, self.n_classes = [], [], []
        for kind in (True, False):
            # of subwords inside tokens the last one is the token's end
            mass = np.where(begins == kind, soft, 0.0)
            mass = mass if kind else np.append(mass, max(firsts[:-1].sum(), 1.0))
            kinds = np.concatenate([np.where(begins == kind, end if kind else 0, 3), [1] * (not kind)]).astype(np.int64)
            found = equal_masses(mass, kinds, np.append(lean, 0)[: len(mass)], CLASSES)
            found = np.where(kinds == 3, 0, found)
            self.n_classes.append(int(found.max()) + 1)
            self.classes.append(found.astype(np.int32))
            with np.errstate(divide="ignore"):
                self.share.append(np.log(mass / np.bincount(found, mass)[found]))
        # chances of a first subword in each slot, smoothed by that in all
        one = firsts.sum(axis=1) + 0.5 * begins
        one /= one.sum()
        smooth = 50.0
        self.first = ((firsts + smooth * one[:, None]) / (firsts.sum(axis=0) + smooth)).astype(np.float32)
        self.tokens, self.fresh = firsts, once + 0.5

    def rest(self, first: np.ndarray, counts: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Chances of words in each slot given their first subwords: by counts, for unseen words as one type."""
        fresh = self.fresh[first]
        seen = counts.sum(axis=1) > 0
        return (counts + fresh * np.where(seen, np.exp(inner), 1.0)[:, None]) / (self.tokens[first] + fresh)


def _exp(a: np.ndarray) -> None:
    """Exponentials in place, bounded."""
    if a.size and a.max() > 60:  # seldom
        np.minimum(a, 60, out=a)
    np.exp(a, out=a)


class Attention:
    """One layer of causal self-attention with a distribution over classes, and shares of a mixture, at each place."""

    def __init__(self, bins: int, width: int, classes: int, shares: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        shapes = {"emb": (bins, DIM), "pos": (width, DIM), "match": (DIM, DIM), "value": (DIM, DIM), "out": (DIM, classes + shares), "bias": (classes + shares,)}
        self.p = {k: (rng.standard_normal(s) * (0.0 if k == "bias" else 0.2)).astype(np.float32) for k, s in shapes.items()}
        self.classes = classes
        self.past = np.tril(np.ones((width, width), np.float32))
        self.ones = np.ones((width, 1), np.float32)
        self.sums = np.zeros((classes + shares, 2), np.float32)
        self.sums[:classes, 0] = self.sums[classes:, 1] = 1

    def vector(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Attention:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(v.dtype)
            at += v.size
        return self

    def forward(self, x: np.ndarray, skip: int = 0) -> tuple:
        """From vectors (windows, places, DIM): raw weights of classes and shares at places from ``skip`` on,
        their sums, and what ``backward`` needs."""
        p, t = self.p, x.shape[1]
        x = x + p["pos"][:t]
        y = x[:, skip:].reshape(-1, DIM)
        q = (y @ p["match"]).reshape(len(x), t - skip, DIM)
        a = q @ x.transpose(0, 2, 1)
        _exp(a)
        a *= self.past[skip:t, :t]
        a *= 1 / (a @ self.ones[:t])
        c = a @ x
        h = c.reshape(-1, DIM) @ p["value"]
        h += y
        e = h @ p["out"]
        e += p["bias"]
        _exp(e)
        return e, e @ self.sums, (x, q, a, c, h)

    def backward(self, known: tuple, dz: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the vectors, from that of the logits."""
        p, (x, q, a, c, h) = self.p, known
        flat = lambda v: v.reshape(-1, DIM)
        dh = dz @ p["out"].T
        dc = (dh @ p["value"].T).reshape(x.shape)
        da = dc @ x.transpose(0, 2, 1)
        da -= np.einsum("ijk,ijk->ij", dc, c)[:, :, None]
        da *= a
        dq = da @ x
        dx = a.transpose(0, 2, 1) @ dc
        dx += da.transpose(0, 2, 1) @ q
        dx += (flat(dq) @ p["match"].T + dh).reshape(x.shape)
        pos = np.zeros_like(p["pos"])
        pos[: x.shape[1]] = dx.sum(axis=0)
        return {"out": h.T @ dz, "bias": np.ones(len(dz), dz.dtype) @ dz, "value": flat(c).T @ dh, "match": flat(x).T @ flat(dq), "pos": pos}, dx

    def logits(self, e: np.ndarray, sums: np.ndarray, target: np.ndarray, weight: np.ndarray, chances: np.ndarray | None = None) -> np.ndarray:
        """Gradient, in the logits, of the weighted mean log chance of the ``target`` classes, and of the
        mixture that takes the ``chances`` of all but one distribution and the model's own chance."""
        weight = weight.astype(e.dtype, copy=False)
        dz = (-weight[:, None] / np.maximum(sums, 1e-30)) @ self.sums.T.astype(e.dtype, copy=False)
        dz *= e
        dz[np.arange(len(dz)), target] += weight
        if chances is not None:
            post = e[:, self.classes :] * chances
            post *= (weight / (post @ np.ones(post.shape[1], post.dtype) + 1e-30))[:, None]
            dz[:, self.classes :] += post
        return dz

    def by_bin(self, bins: np.ndarray, dx: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
        """Gradient of the embeddings from that of vectors of these classes, or of runs of ``size`` of them."""
        bins, kind = bins.reshape(-1).astype(np.intp), dx.dtype
        dx = np.ascontiguousarray(dx.reshape(-1, DIM).T, np.float64)
        return np.stack([np.bincount(bins, d if size is None else np.repeat(d, size), len(self.p["emb"])) for d in dx], axis=1).astype(kind)


class Ascent:
    """Adam on a model's parameters."""

    def __init__(self, model: Attention, rate: float) -> None:
        self.model, self.rate, self.t = model, rate, {k: 0 for k in model.p}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))

    def step(self, grad: dict) -> None:
        for k, g in grad.items():
            self.t[k] += 1
            m, v = self.m[k], self.v[k]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.02) * (g * g - v)
            self.model.p[k] += ((self.rate / (1 - 0.9 ** self.t[k])) * m / (np.sqrt(v / (1 - 0.98 ** self.t[k])) + 1e-8)).astype(np.float32)


class Outer(Attention):
    """Attention over tokens: what the next one begins with, and shares of the slots' counts and of the model."""

    def __init__(self, words: Lexicon, seed: int = 5) -> None:
        super().__init__(words.n_bins, WIDTH, words.n_classes[0], SLOTS + 1, seed)
        self.words = words
        # of first subwords: their chances in each slot, and their shares of their classes
        self.table = np.column_stack([words.first, np.exp(words.share[0]).astype(np.float32)])

    def vectors(self, bins: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A vector of each token; the last row is what stands before a text."""
        emb, first = self.p["emb"], np.cumsum(size) - size
        out = np.empty((len(size) + 1, DIM), emb.dtype)
        out[-1] = emb[-1]
        if len(size):
            order = np.argsort(-np.minimum(size, 32767).astype(np.int16), kind="stable")  # longest first, so those with a next subword come first
            if size.max() > 32767:
                order = np.argsort(-size, kind="stable")
            first, size = first[order], size[order]
            shorter = -size
            sums = emb.take(bins[first], axis=0)
            for k in range(1, int(size[0])):  # the next subword of all tokens that have one
                n = int(np.searchsorted(shorter, -k))
                sums[:n] += emb.take(bins[first[:n] + k], axis=0)
            sums /= size[:, None].astype(emb.dtype)
            out[order] = sums
        return out

    def places(self, n: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows: the token at each place, the token before it (-1: the text begins), and whether it is scored."""
        first, size, skip = windows(n, WIDTH, stride)
        at = np.arange(WIDTH)
        token = first[:, None] + np.minimum(at, size[:, None] - 1)
        begins = np.zeros(int(n.sum()), bool)
        begins[np.cumsum(n) - n] = True
        return token, np.where(begins[token], -1, token - 1), (at >= skip[:, None]) & (at < size[:, None])

    def chances(self, first: np.ndarray, e: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Chances of first subwords by each slot's counts and by the model."""
        out = self.table.take(first, axis=0)
        out[:, SLOTS] *= e[np.arange(len(first)), self.words.classes[0][first]] / sums[:, 0]
        return out

    def learn(self, ids: np.ndarray, size: np.ndarray, n: np.ndarray, up: Ascent) -> int:
        """Steps over all windows of the texts."""
        bins, start = self.words.bins[ids], np.cumsum(size) - size
        first = ids[start]
        token, before, scored = self.places(n, WIDTH)
        for i in range(0, len(token), STEP * TURN):
            # steps that share their vectors: tokens follow each other, and each is before one place only
            before_, token_, scored_ = (v[i : i + STEP * TURN] for v in (before, token, scored))
            low, high = int(token_[0, 0]) - 1, int(token_.max())
            low = max(low, 0)
            sizes, flat = size[low:high], bins[start[low] : start[high]]
            vectors = self.vectors(flat, sizes)
            grads = np.zeros_like(vectors)
            for j in range(0, len(token_), STEP):
                part, ok = before_[j : j + STEP], scored_[j : j + STEP]
                begins = part < 0
                own = np.where(begins, len(sizes), part - low)
                heads = first[token_[j : j + STEP].reshape(-1)]
                e, sums, known = self.forward(vectors.take(own, axis=0))
                weight = (ok.reshape(-1) / max(1, ok.sum())).astype(e.dtype)
                grad, dx = self.backward(known, self.logits(e, sums, self.words.classes[0][heads], weight, self.chances(heads, e, sums)))
                grads[-1] += dx[begins].sum(axis=0)
                inside = np.flatnonzero(ok & ~begins)
                grads[own.take(inside)] = dx.reshape(-1, DIM).take(inside, axis=0)
                up.step(grad)
            sizes = np.append(sizes, 1)
            grads /= sizes[:, None].astype(grads.dtype)
            up.step({"emb": self.by_bin(np.append(flat, self.words.n_bins - 1), grads, sizes)})
        return int(scored.sum())

    def score(self, ids: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each token the shares times the chances of its first subword: in each slot, and by the model."""
        vectors = self.vectors(self.words.bins[ids], size)
        heads = ids[np.cumsum(size) - size]
        # what stands before each token; places beyond a text's end tell nothing of those before
        before = np.concatenate([vectors[-1:], vectors[:-2], np.zeros((WIDTH, DIM), vectors.dtype)])
        before[np.cumsum(n) - n] = vectors[-1]
        runs = np.lib.stride_tricks.as_strided(before, (len(size), WIDTH * DIM), (before.strides[0], before.itemsize), writeable=False)
        first, length, skips = windows(n, WIDTH, STRIDE)
        out = np.empty((len(size), SLOTS + 1), np.float32)
        for skip in (0, WIDTH - STRIDE):
            own = np.flatnonzero(skips == skip)
            at = np.arange(skip, WIDTH)
            for i in range(0, len(own), BATCH):
                start = first[own[i : i + BATCH]]
                e, sums, _ = self.forward(runs[start].reshape(-1, WIDTH, DIM), skip)
                token, ok = (start[:, None] + at).reshape(-1), (at < length[own[i : i + BATCH], None]).reshape(-1)
                if not ok.all():
                    e, sums, token = e[ok], sums[ok], token[ok]
                part = self.chances(heads[token], e, sums)
                part *= e[:, self.classes :]
                part *= 1 / sums[:, 1:]
                out[token] = part
        return out


class Inner(Attention):
    """Attention within a token: its next subword, or its end."""

    def __init__(self, words: Lexicon, seed: int = 6) -> None:
        super().__init__(words.n_bins, INNER_WIDTH, words.n_classes[1], 0, seed)
        self.words = words

    def groups(self, ids: np.ndarray, size: np.ndarray, stride: int, step: int):
        """Windows of equal length, some at a time: places in ``ids``, next subwords, and those scored."""
        follows = np.append(ids[1:], 0)
        follows[np.cumsum(size) - 1] = len(self.words.classes[1]) - 1  # the token's end
        first, length, skip = windows(size, INNER_WIDTH, stride)
        for t in np.unique(length).tolist():
            own = np.flatnonzero(length == t)
            for i in range(0, len(own), step):
                part = own[i : i + step]
                at = first[part][:, None] + np.arange(t)
                yield at, follows[at].reshape(-1), (np.arange(t) >= skip[part][:, None]).reshape(-1)

    def learn(self, ids: np.ndarray, size: np.ndarray, counts: np.ndarray, up: Ascent) -> int:
        """Steps over all words. A word weighs the root of its count, since counts know frequent ones."""
        weights = np.repeat(np.sqrt(counts), size).astype(np.float32)
        bins = self.words.bins[ids]
        every = list(self.groups(ids, size, INNER_WIDTH, 2 * STEP))
        for k in np.random.default_rng(len(ids)).permutation(len(every)).tolist():  # lengths in turn would teach the last only
            at, follows, ok = every[k]
            e, sums, known = self.forward(self.p["emb"][bins[at]])
            weight = weights[at.reshape(-1)] * ok
            grad, dx = self.backward(known, self.logits(e, sums, self.words.classes[1][follows], weight / max(weight.sum(), 1e-9)))
            up.step(grad | {"emb": self.by_bin(bins[at], dx)})
        return int(size.sum())

    def score(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log chances of tokens given their first subwords; a text's end is certain then."""
        logs, bins = np.zeros(len(ids)), self.words.bins[ids]
        for at, follows, ok in self.groups(ids, size, INNER_STRIDE, 4 * BATCH):
            e, sums, _ = self.forward(self.p["emb"][bins[at]])
            own = np.log(e[np.arange(len(e)), self.words.classes[1][follows]] / sums[:, 0]) + self.words.share[1][follows]
            logs[at.reshape(-1)[ok]] = own[ok]
        logs[ids == len(self.words.bins) - 1] = 0
        return np.add.reduceat(logs, np.cumsum(size) - size)


class Found:
    """Where 64-bit numbers stand in a sorted array of them: most by their first bits alone."""

    def __init__(self, known: np.ndarray, bits: int = 20) -> None:
        self.known, self.shift = known, np.int64(64 - bits)
        self.start = np.searchsorted(known >> self.shift, np.arange(-(1 << bits - 1), 1 << bits - 1)).astype(np.int32)
        self.half = 1 << bits - 1

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each number, and whether it is there."""
        if not len(self.known):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        last = len(self.known) - 1
        at = np.minimum(self.start[(h >> self.shift) + self.half], last)
        got = self.known[at]
        further = np.flatnonzero(got < h)
        at[further] = np.minimum(np.searchsorted(self.known, h[further]), last)
        got[further] = self.known[at[further]]
        return at, got == h


def rounded(shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots' chances as a largest one and 255ths of it: all tokens are scored by these."""
    top = functools.reduce(np.maximum, shares.T[:SLOTS], np.float32(1e-30))
    return top, np.rint(shares[:, :SLOTS] * (255 / top)[:, None])


def packed(parts: np.ndarray) -> np.ndarray:
    """Eight 255ths in a number."""
    return (parts.astype(np.uint64) << (np.arange(SLOTS, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _joined(batches, size: int = 4 << 20):
    """The rows of batches in batches of about ``size`` bytes."""
    held, total = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            total += b.nbytes
        if total >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _runs(batches, rows: int):
    """(chunk, rows of it) from batches that start with their chunk, in order: ``rows`` at once, and what
    is left of each chunk, wherever batches end."""
    held, now = [], None

    def cut(every: bool):
        nonlocal held
        whole = pa.Table.from_batches(held).combine_chunks() if held else None
        held = []
        at = 0
        while whole is not None and (whole.num_rows - at >= rows or every and at < whole.num_rows):
            yield now, whole.slice(at, rows)
            at += rows
        if whole is not None and at < whole.num_rows:
            held = whole.slice(at).to_batches()

    for b in batches:
        chunk = b.column(0).to_numpy()
        edges = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist()
        if now is not None and len(chunk) and chunk[0] == now:
            edges = [0, *edges[1:]]
        for a, z in zip(edges, [*edges[1:], len(chunk)], strict=True):
            if chunk[a] != now:
                yield from cut(True)
                now = int(chunk[a])
            held.append(b.slice(a, z - a))
            if sum(x.num_rows for x in held) >= rows:
                yield from cut(False)
    yield from cut(True)


def _trained(parts: DataFrame, model: Attention, learn, columns: list[str], at_once: int, rate: float, chunks: int, rounds: int) -> Attention:
    """The model after ``rounds``, each over its share of the chunks of ``parts`` (chunk, key, and ``columns``).

    A chunk is learnt in order of key from the round's common start, ``at_once`` rows at a time, and the models
    of its chunks are averaged by what they have seen: the outcome follows the rows, not how they are laid out.
    """
    spark, kind = parts.sparkSession, model.__class__
    lexicon = spark.sparkContext.broadcast(model.words)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(np.float64)
        mean = sum(np.frombuffer(m, "<f4").astype(np.float64) * w for m, w in zip(pdf["model"], n, strict=True)) / n.sum()
        return pd.DataFrame({"model": [mean.astype("<f4").tobytes()], "n": [int(n.sum())]})

    for r in range(rounds):
        start = spark.sparkContext.broadcast(model.vector())
        own = parts.where(F.col("chunk") % rounds == r).repartition("chunk").sortWithinPartitions("chunk", "key").select("chunk", *columns)

        def train(batches, start=start):
            total, seen, now, own, up, n = 0.0, 0, None, None, None, 0
            for chunk, rows in _runs(batches, at_once):
                if chunk != now:
                    if own is not None:
                        total, seen = total + own.vector().astype(np.float64) * n, seen + n
                    now, n, own = chunk, 0, kind(lexicon.value).load(start.value)
                    up = Ascent(own, rate)
                n += learn(own, up, rows)
            if own is not None:
                total, seen = total + own.vector().astype(np.float64) * n, seen + n
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([(total / seen).astype("<f4").tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["model", "n"])

        # at most 16 models reach the driver
        models = own.mapInArrow(train, "model binary, n long").groupBy(F.pmod(F.xxhash64("model"), F.lit(16)).alias("part")).applyInPandas(merge, "model binary, n long")
        found = models.toPandas().sort_values("n")
        if len(found):
            model.load(np.frombuffer(merge(found)["model"][0], "<f4"))
    return model


def score(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", language: str | None = "lang", held_out: int = 1, folds: int = 5,
    frequent: int = 1 << 17, vocabulary: str | None = None, rounds: int = 2, epochs: int = 1, rate: float = 0.02, chunk_tokens: int = 1 << 19, chunk_words: int = 1 << 17,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Texts whose ``crc32(doc_id as text) mod folds`` is not ``held_out`` are learnt from; a null id
    counts as empty text there. Null texts are empty: one token, the end. Very long texts are windows
    like others. Repeated rows are counted and scored each; ties change nothing. Without training
    tokens every word is unknown. An empty table gives an empty one. ``language`` names the column
    whose values are hashed to ``SLOTS`` slots (a null or missing one is a value too), each with a
    distribution of its own; the other columns play no part.

    Counts cover all training tokens, and the attention learns from every window, and the inner one from every
    distinct word, ``epochs`` times: in chunks of about ``chunk_tokens`` (``chunk_words``), dealt by a hash of
    the row and dealt out to ``rounds``. What is broadcast is bounded: tables of the vocabulary, the models,
    and ``frequent`` words, which only saves their join: a word is scored alike in or out of them.
    """
    spark = docs.sparkSession
    ready(spark)
    path = vocabulary or vocabulary_path()
    made = coder(path)
    lang = F.col(language).cast("string") if language and language in docs.columns else F.lit("")
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), (F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(folds)) == held_out).alias("held_out"),
        F.pmod(F.xxhash64(F.coalesce(lang, F.lit("")), F.lit(3)), F.lit(SLOTS)).cast("int").alias("slot"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("key"), text_or_empty(F.col(text)).alias("text"),
    )

    def cut_up(batches):
        own = coder(path)
        for b in _joined(batches):
            ids, size, n = own(b.column(5))
            ends = np.cumsum(size)[np.cumsum(n) - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(n), _binary(ids.astype(own.kind), ends)], [*b.schema.names[:5], "n", "ids"])

    pieces = written(rows.mapInArrow(cut_up, "row long, doc_id long, held_out boolean, slot int, key long, n long, ids binary"), "pieces")

    def count(batches):
        own = coder(path)
        held: list[tuple] = []

        def out():
            h, slot, size, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            same = h ^ mixed(slot.astype(np.uint64) + np.uint64(1))
            order = np.argsort(same)
            begin = np.flatnonzero(np.diff(same[order], prepend=~same[order[:1]]))
            at, n = order[begin], np.diff(begin, append=len(order))
            n[slot[at] == SLOTS] = 0  # words of held-out texts are listed, not counted
            first, lengths = (np.cumsum(size, dtype=np.int64) - size)[at], size[at].astype(np.int64)
            ends = np.cumsum(lengths)
            spelt = ids[np.repeat(first - (ends - lengths), lengths) + np.arange(lengths.sum())]
            return pa.RecordBatch.from_arrays([_binary(spelt, ends), pa.array(np.minimum(slot[at], SLOTS - 1).astype(np.int32)), pa.array(n)], ["w", "slot", "n"])

        total = 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, size, n = unpacked(b.column(2), own)
            slot = np.where(b.column(0).to_numpy(zero_copy_only=False), SLOTS, b.column(1).to_numpy()).astype(np.int8)
            held.append((token_hashes(ids, size), np.repeat(slot, n), size.astype(np.int32), ids.astype(own.kind)))
            total += len(ids)
            if total > 8_000_000:
                yield out()
                held, total = [], 0
        if held:
            yield out()

    counted = pieces.select("held_out", "slot", "ids").mapInArrow(count, "w binary, slot int, n long")
    columns = [f"c{i}" for i in range(SLOTS)]
    words = counted.groupBy("w").agg(*[F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(columns)])
    words = written(words.withColumn("c", sum((F.col(c) for c in columns), F.lit(0))), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()

    def spell(batches):
        own, sums = coder(path), np.zeros((3, coder(path).n, SLOTS), np.int64)
        for b in batches:
            if b.num_rows:
                ids, size, _ = unpacked(b.column(0), own)
                c = np.stack([b.column(j + 1).to_numpy() for j in range(SLOTS)], axis=1)
                once = np.where(c.sum(axis=1, keepdims=True) == 1, c, 0)
                heads = ids[np.cumsum(size) - size]
                for k in range(SLOTS):
                    sums[0, :, k] += np.bincount(ids, np.repeat(c[:, k], size), own.n).astype(np.int64)
                    sums[1, :, k] += np.bincount(heads, c[:, k], own.n).astype(np.int64)
                    sums[2, :, k] += np.bincount(heads, once[:, k], own.n).astype(np.int64)
        kind, which = np.nonzero(sums.any(axis=2))
        if len(kind):
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(which.astype(np.int32)), *(pa.array(sums[kind, which, k]) for k in range(SLOTS))], ["kind", "id", *columns])

    # three rows a subword at most
    spelt = words.where("c > 0").select("w", *columns).mapInArrow(spell, "kind int, id int, " + ", ".join(f"{c} long" for c in columns)).groupBy("kind", "id").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    sums = np.zeros((3, made.n, SLOTS))
    sums[spelt["kind"].to_numpy(), spelt["id"].to_numpy()] = spelt[columns].to_numpy(np.float64)
    known = Lexicon(*sums, made.begins)
    inner, outer = Inner(known), Outer(known)
    if total:

        def learn_words(model: Inner, up: Ascent, batch: pa.Table) -> int:
            ids, size, _ = unpacked(batch.column(1), coder(path))
            counts = batch.column(2).to_numpy().astype(np.float64)
            return sum(model.learn(ids, size, counts, up) for _ in range(epochs))

        def learn_texts(model: Outer, up: Ascent, batch: pa.Table) -> int:
            ids, size, n = unpacked(batch.column(1), coder(path))
            return sum(model.learn(ids, size, n, up) for _ in range(epochs))

        dealt = lambda k: F.pmod(F.xxhash64("key", F.lit(29)), F.lit(k)).alias("chunk")
        chunks = rounds * max(1, -(-int(distinct) // (rounds * chunk_words)))
        inner = _trained(words.where("c > 0").select("w", "c", F.xxhash64("w").alias("key")).select(dealt(chunks), "*"), inner, learn_words, ["w", "c"], 1 << 14, rate, chunks, rounds)
        chunks = rounds * max(1, -(-int(total) // (rounds * chunk_tokens)))
        outer = _trained(pieces.where("NOT held_out").select(dealt(chunks), "key", "ids"), outer, learn_texts, ["ids"], 256, rate, chunks, rounds)
    share = spark.sparkContext.broadcast((known, inner.vector(), outer.vector()))

    def rate_words(batches):
        table, flat, _ = share.value
        own, model = coder(path), Inner(table).load(flat)
        for b in batches:
            if b.num_rows:
                ids, size, _ = unpacked(b.column(0), own)
                logs = model.score(ids, size)
                c = np.stack([b.column(j + 2).to_numpy() for j in range(SLOTS)], axis=1).astype(np.float64)
                by = table.rest(ids[np.cumsum(size) - size], c, logs)
                yield pa.RecordBatch.from_arrays([pa.array(token_hashes(ids, size).view(np.int64)), b.column(1), pa.array(np.exp(logs)), *(pa.array(by[:, j]) for j in range(SLOTS))], ["h", "c", "r", *(f"r{j}" for j in range(SLOTS))])

    rests = [f"r{j}" for j in range(SLOTS)]
    rated_words = written(words.select("w", "c", *columns).mapInArrow(rate_words, "h long, c long, r double, " + ", ".join(f"{r} double" for r in rests)), "rated-words")
    # how common a word must be for at most ``frequent`` to remain, from a histogram by logarithm
    seen, least = 0, float("inf")
    for r in words.where("c > 0").groupBy(F.floor(F.log2("c") * 16).alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("b")).collect():
        seen += r["n"]
        if seen > frequent:
            break
        least = r["c"]
    top = rated_words.where(F.col("c") >= least).select("h", "c", *[F.col(r).cast("float").alias(r) for r in ["r", *rests]]).toPandas().sort_values("h")
    whole = float(np.log10(int(total) + 0.5 * (int(distinct) + 1)))
    common = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64), top["c"].to_numpy(np.float64), top["r"].to_numpy(np.float32), top[rests].to_numpy(np.float32)))

    def rate_texts(batches):
        table, _, flat = share.value
        hashes, c, r, rs = common.value
        own, model, find = coder(path), Outer(table).load(flat), Found(hashes)
        for b in batches:
            if not b.num_rows:
                continue
            ids, size, n = unpacked(b.column(4), own)
            h = token_hashes(ids, size).view(np.int64)
            shares = model.score(ids, size, n)
            most, parts = rounded(shares)
            at, known = find(h)
            base, logs = np.zeros(len(h)), np.zeros(len(h))
            there, rare = np.flatnonzero(known), np.flatnonzero(~known)
            at = at[there]
            base[there] = np.log10(c[at] + 0.5)
            logs[there] = np.log10(np.einsum("ij,ij->i", parts.take(there, axis=0), rs.take(at, axis=0)) * (most[there] / np.float32(255)) + shares[there, SLOTS] * r[at])
            begin = np.cumsum(n) - n
            n_rare = np.add.reduceat((~known).astype(np.int64), begin)
            offsets = np.concatenate([[0], np.cumsum(n_rare)]).astype(np.int32)
            left = pa.StructArray.from_arrays([pa.array(h[rare]), pa.array(packed(parts.take(rare, axis=0))), pa.array(most[rare]), pa.array(shares[rare, SLOTS])], ["h", "p", "t", "z"])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(n - n_rare), pa.array(np.add.reduceat(base, begin) - n * whole), pa.array(np.add.reduceat(logs, begin)), pa.ListArray.from_arrays(pa.array(offsets), left)],
                ["row", "doc_id", "held_out", "n", "n_known", "base", "logs", "rare"],
            )

    rated = written(pieces.select("row", "doc_id", "held_out", "n", "ids").mapInArrow(rate_texts, "row long, doc_id long, held_out boolean, n long, n_known long, base double, logs double, rare array<struct<h:long,p:long,t:float,z:float>>"), "rated")
    each = rated.select("row", F.explode("rare").alias("x")).select("row", "x.*").join(rated_words, "h")
    part = lambda j: F.shiftrightunsigned("p", 8 * j).bitwiseAND(F.lit(255)).cast("double")
    chance = F.col("t").cast("double") / 255.0 * sum((part(j) * F.col(r) for j, r in enumerate(rests)), F.lit(0.0)) + F.col("z").cast("double") * F.col("r")
    more = each.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("more_base"), F.sum(F.log10(chance)).alias("more_logs"), F.sum((F.col("c") > 0).cast("long")).alias("seen"))
    out, zero = rated.drop("rare").join(more, "row", "left"), F.lit(0.0)
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"), (F.col("logs") + F.coalesce("more_logs", zero)).alias("score"),
    )
