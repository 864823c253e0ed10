"""Whole texts to token ids of a byte-level BPE vocabulary, by bounded caches of text pieces.

A pre-token of this kind of tokenizer never spans the place before a single space between two
other characters, nor either side of a single line feed between them. So a text is cut there, a
piece that was seen before is looked up, and a new piece is split into pre-tokens, of which again
only new ones are encoded. Texts with other white space, doubled or at an end, or with a special
token's string, are encoded as a whole.
"""

from __future__ import annotations

import functools

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
_FIRST = "\ud800"  # stands before a text's first piece; no text can hold it
_MARKS = (".", ",", ";", ":")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: printable Latin-1
    characters for themselves, the other bytes from U+0100 on in ascending order."""
    shown = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    hidden = iter(range(256, 512))
    return [chr(b if s else next(hidden)) for b, s in enumerate(shown)]


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.empty(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class _Numbers(dict):
    """Numbers keys in order of appearance and keeps the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n

    def of(self, keys: list[str]) -> tuple[np.ndarray, list[str]]:
        at = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        fresh, self.fresh = self.fresh, []
        return at, fresh


class _Ragged:
    """Arrays of ids by number, appended in order of number."""

    def __init__(self) -> None:
        self.start, self.length, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.n = self.used = 0

    def append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, used = self.n + len(lengths), self.used + len(ids)
        self.start, self.length, self.flat = _grown(self.start, n), _grown(self.length, n), _grown(self.flat, used)
        self.length[self.n : n] = lengths
        self.start[self.n : n] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : used] = ids
        self.n, self.used = n, used

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[at] - (ends - lengths), lengths) + np.arange(total)], lengths


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; no run is empty."""
    return np.add.reduceat(values, np.cumsum(counts) - counts) if len(counts) else np.empty(0, np.int64)


class CachedEncoder:
    """``encode(texts)`` by ``pretokens(list) -> (ids, lengths)`` and ``text(str) -> ids``.

    ``limit`` bounds the pieces that are kept from one call to the next.
    """

    def __init__(self, pretokens, text, limit: int = 1_000_000) -> None:
        import public_tokenizers
        import regex

        self.pretokens, self.text, self.limit = pretokens, text, limit
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.reset()

    def reset(self) -> None:
        self.pieces, self.of_piece, self.bad = _Numbers(), _Ragged(), np.zeros(1024, bool)
        self.tokens, self.of_token = _Numbers(), _Ragged()

    def _learn(self, fresh: list[str]) -> None:
        n = len(self.pieces)
        self.bad = _grown(self.bad, n)
        self.bad[n - len(fresh) : n] = False
        tokens: list[str] = []
        counts = np.empty(len(fresh), np.int64)
        for i, k in enumerate(fresh):
            if k.isalpha():  # one word, or a word and a mark: most pieces
                own = [" " + k]
            elif k[-1:] in _MARKS and k[:-1].isalpha():
                own = [" " + k[:-1], k[-1]]
            else:
                body = k[1:] if k[:1] in (_FIRST, "\n") else k
                if not body or not body.isprintable() or SPECIAL in body:
                    self.bad[n - len(fresh) + i] = True
                    own = ["!"]
                else:
                    own = self.split(body if k[0] == _FIRST else k if k[0] == "\n" else " " + k)
            counts[i] = len(own)
            tokens += own
        at, unseen = self.tokens.of(tokens)
        if unseen:
            self.of_token.append(*self.pretokens(unseen))
        ids, lengths = self.of_token.take(at)
        self.of_piece.append(ids, _sums(lengths, counts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and the number of ids of each text."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.pieces) > self.limit:
            self.reset()
        keys: list[str] = []
        counts = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = (_FIRST + t).replace("\n", " \n").split(" ")
            counts[i] = len(own)
            keys += own
        at, fresh = self.pieces.of(keys)
        if fresh:
            self._learn(fresh)
        ids, lengths = self.of_piece.take(at)
        per_text = _sums(lengths, counts)
        odd = np.unique(np.searchsorted(np.cumsum(counts), np.flatnonzero(self.bad[at]), side="right"))
        if len(odd):
            stops, parts, done = np.cumsum(per_text), [], 0
            for i in odd.tolist():
                own = self.text(texts[i])
                parts += [ids[done : stops[i] - per_text[i]], own]
                done = stops[i]
                per_text[i] = len(own)
            ids = np.concatenate([*parts, ids[done:]])
        return ids, per_text


@functools.lru_cache(maxsize=1)
def encoder(path: str, limit: int = 1_000_000) -> CachedEncoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` of the tokenizers library gives
    them; one a worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    alone = Tokenizer(whole.model)  # the same model on pre-tokens between NULs
    alone.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\x00")
    shown = {b: c for b, c in enumerate(byte_alphabet()) if b and ord(c) != b}

    def encoded(keys: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        joined = ["\x00".join(keys[i : i + 512]) for i in range(0, len(keys), 512)]
        if plain:
            joined = [j.replace(" ", shown[32]).replace("\n", shown[10]) for j in joined]
        else:
            joined = [j.encode().decode("latin-1").translate(shown) for j in joined]
        ids, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for k, e in enumerate(alone.encode_batch(joined, add_special_tokens=False)):
            ids.append(np.array(e.ids, np.uint32))
            lengths.append(np.bincount(np.array(e.word_ids, np.int64), minlength=min(512, len(keys) - k * 512)))
        return np.concatenate(ids), np.concatenate(lengths)

    def pretokens(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter(map(str.isascii, keys), bool, len(keys))  # printable, so only blanks and line feeds are shown otherwise
        both = _Ragged()
        for kind in (True, False):
            both.append(*encoded([k for k, p in zip(keys, plain.tolist(), strict=True) if p is kind], kind))
        at = np.empty(len(keys), np.int64)
        at[plain], at[~plain] = np.arange(plain.sum()), np.arange(plain.sum(), len(keys))
        return both.take(at)

    def text(t: str) -> np.ndarray:
        return np.array(whole.encode(t, add_special_tokens=False).ids, np.uint32)

    return CachedEncoder(pretokens, text, limit)
