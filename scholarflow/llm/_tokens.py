"""Token ids of whole texts by way of their pre-tokens.

A byte-level BPE tokenizer cuts a text into pre-tokens by one fixed pattern and
encodes each of them by itself. So the ids of a text are those of its
pre-tokens, and each distinct pre-token need be given to the tokenizers library
only once. The cut is done here for many texts at once with NumPy. Texts that
hold an added token's string, and tokenizers of another make, go to the library
as they are.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np

from . import _text as X

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def tokenizer_path(name: str) -> str:
    """A file's place on the machine that asks; names with a slash are paths already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def classes() -> np.ndarray:
    """White space, letter, number or other, for each code point."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c <= 0xDFFF else "." for c in range(0x110000))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def pretoken_starts(codes: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin.

    A run of letters, numbers or other signs is one, with one space before it
    if there is one. White space before it but for its last character is one,
    as is white space at a text's end. An apostrophe that begins one takes the
    ending of an English contraction with it.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[codes]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = np.ones(n, bool)
    first[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]  # of a run
    white = kind == SPACE
    joined = np.zeros(n, bool)  # has the space before it
    joined[1:] = first[1:] & ~white[1:] & (codes[:-1] == 32) & ~edge[1:-1]
    begin = first & ~joined
    last = np.zeros(n, bool)  # white space before a run of its own text
    last[:-1] = white[:-1] & ~white[1:] & ~edge[1:-1]
    begin |= last
    quote = np.flatnonzero(begin[:-1] & (codes[:-1] == 39) & (kind[1:] == LETTER) & ~edge[1:-1]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        a = codes[quote + 1]
        inside = np.minimum(quote + 2, n - 1)
        b = np.where((quote + 2 < n) & ~edge[quote + 2], codes[inside], 0)
        one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        begin[quote[one | two] + 1] = False
        for which, width in ((one, 2), (two & ~one, 3)):
            after = quote[which] + width
            begin[after[after < n]] = True
    return np.flatnonzero(begin)


def _extended(a: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """a with more from place `used` on; it grows by doubling."""
    if used + len(more) > len(a):
        a = np.append(a[:used], np.zeros(used + 2 * len(more), a.dtype))
    a[used : used + len(more)] = more
    return a


class Known:
    """Ids of strings known by two hashes: the first finds an entry, the second must agree."""

    def __init__(self):
        # in sorted arrays: a dict takes about four times as much of a worker's memory
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.check, self.begins, self.sizes, self.flat = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.uint32))
        self.count = self.used = 0

    def __len__(self) -> int:
        return self.count

    def find(self, keys: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The entry of each string; -1: none."""
        if not self.count:
            return np.full(len(keys), -1, np.int64)
        near = np.minimum(np.searchsorted(self.keys, keys), self.count - 1)
        at = self.numbers[near].astype(np.int64)
        at[(self.keys[near] != keys) | (self.check[at] != check)] = -1
        return at

    def add(self, keys: np.ndarray, check: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Entries, with their ids end to end; they stand before older ones of their keys."""
        order = np.argsort(keys, kind="stable")
        near = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, near, keys[order])
        self.numbers = np.insert(self.numbers, near, self.count + order)
        self.check = _extended(self.check, self.count, check)
        self.begins = _extended(self.begins, self.count, self.used + np.cumsum(sizes) - sizes)
        self.sizes = _extended(self.sizes, self.count, sizes)
        self.flat = _extended(self.flat, self.used, ids)
        self.count, self.used = self.count + len(keys), self.used + len(ids)

    def ids(self, at: np.ndarray) -> np.ndarray:
        """The ids of these entries, end to end."""
        size = self.sizes[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.begins[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class PretokenEncoder:
    """Remembers the ids of distinct pre-tokens, or with counts their numbers alone; whole: hashes of strings that are one token."""

    def __init__(self, name: str, counts: bool = False, whole: np.ndarray | None = None, limit: int = 500_000):
        import tokenizers

        path = tokenizer_path(name)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.direct = bool(made.get("normalizer")) or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex")
        self.special = [t["content"] for t in made.get("added_tokens", [])]
        self.counts, self.limit = counts, limit
        self.cache, self.older = Known(), Known()  # what has been asked for again lives on when the cache is full
        self.whole = np.zeros((2, 0), np.uint64) if whole is None else whole
        self.kinds = None if self.direct else classes()

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pretokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Starts, ends and both hashes of the pre-tokens, and the first of each text."""
        codes, offsets = X.code_points(texts)
        starts = pretoken_starts(codes, offsets, self.kinds)
        ends = np.append(starts[1:], len(codes))
        return starts, ends, X.span_hashes(codes, starts, ends, second=True), np.searchsorted(starts, offsets)

    def known(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The cache's entry of each distinct pre-token (-1: a whole token), the number of each pre-token among these, the first of each text.

        None: two distinct pre-tokens of these texts have the same first hash.
        """
        starts, ends, (hashes, second), firsts = self.pretokens(texts)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        check = second[first]
        if not np.array_equal(check[which], second):
            return None
        whole = np.zeros(len(distinct), bool)
        if self.whole.shape[1]:
            near = np.minimum(np.searchsorted(self.whole[0], distinct), self.whole.shape[1] - 1)
            whole = (self.whole[0, near] == distinct) & (self.whole[1, near] == check)
        at = self.cache.find(distinct, check)
        missing = np.flatnonzero((at < 0) & ~whole)
        if len(missing) and len(self.cache) and len(self.cache) + len(missing) > self.limit:
            self.cache, self.older = Known(), self.cache
            at[:] = -1
            missing = np.flatnonzero(~whole)
        if len(missing):
            old = self.older.find(distinct[missing], check[missing])
            again, new = missing[old >= 0], missing[old < 0]
            old = old[old >= 0]
            joined = "".join(texts)
            found = self.tokenizer.encode_batch_fast([joined[starts[j] : ends[j]] for j in first[new].tolist()], add_special_tokens=False) if len(new) else []
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.zeros(0, np.uint32) if self.counts else np.fromiter(itertools.chain.from_iterable(e.ids for e in found), np.uint32, int(sizes.sum()))
            held = np.concatenate([again, new])
            at[held] = len(self.cache) + np.arange(len(held))
            self.cache.add(distinct[held], check[held], np.concatenate([self.older.sizes[old], sizes]), ids if self.counts else np.concatenate([self.older.ids(old), ids]))
        at[whole] = -1
        return at, which, firsts

    def _plain(self, texts: list[str]) -> Iterator[tuple[int, int, bool]]:
        """Row ranges, and if they hold a text for the library."""
        odd = [self.direct or any(s in t for s in self.special) for t in texts]
        for lo, hi in X.chunks(texts):
            if not any(odd[lo:hi]):
                yield lo, hi, False
            else:
                yield from ((i, i + 1, odd[i]) for i in range(lo, hi))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each whole text."""
        for lo, hi, odd in self._plain(texts):
            known = None if odd else self.known(texts[lo:hi])
            if known is None:
                yield from self.library(texts[lo:hi])
                continue
            at, which, firsts = known
            ids, every = self.cache.ids(at[which]), self.cache.sizes[at[which]]
            cuts = np.append(0, np.cumsum(every))[firsts].tolist()
            yield from (ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def count(self, texts: list[str]) -> Iterator[int]:
        """The number of tokens of each whole text."""
        for lo, hi, odd in self._plain(texts):
            known = None if odd else self.known(texts[lo:hi])
            if known is None:
                yield from (len(ids) for ids in self.library(texts[lo:hi]))
                continue
            at, which, firsts = known
            sizes = np.ones(len(at), np.int64)
            sizes[at >= 0] = self.cache.sizes[at[at >= 0]]
            total = np.append(0, np.cumsum(sizes[which]))[firsts].tolist()
            yield from (b - a for a, b in zip(total[:-1], total[1:], strict=True))


_made: dict = {}


def encoder(name: str, **options) -> PretokenEncoder:
    """One of each kind in a Python worker, so that what it knows serves later batches and tasks."""
    key = (name, options.get("counts", False))
    if key not in _made:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _made[key] = PretokenEncoder(name, **options)
    return _made[key]


def whole_tokens(name: str) -> list[str]:
    """The vocabulary strings that the library, given them alone, encodes as just that token."""
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(tokenizer_path(name))
    vocab = tok.get_vocab(with_added_tokens=False)
    pairs = [(tok.decode([i], skip_special_tokens=False), i) for i in vocab.values()]
    pairs = [(s, i) for s, i in pairs if s and "�" not in s]
    return [s for (s, i), e in zip(pairs, tok.encode_batch_fast([s for s, _ in pairs], add_special_tokens=False), strict=True) if e.ids == [i]]


def text_hashes(texts: list[str]) -> np.ndarray:
    """Both hashes that pretokens() gives to each of these strings, in order of the first."""
    codes, offsets = X.code_points(texts)
    both = np.stack(X.span_hashes(codes, offsets[:-1], offsets[1:], second=True))
    return both[:, np.argsort(both[0])]
