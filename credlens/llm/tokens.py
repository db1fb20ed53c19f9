"""Word-cached encoding with a word-level BPE tokenizer file; exact, because its pieces never cross ASCII white space.

The tokenizer drops white space before it forms pieces, its normalizer composes nothing across ASCII
white space, and its added tokens hold none. So the ids of a text are those of its words (split at
ASCII white space, as bytes.split() does) end to end. Words go to the library once and are kept in a
cache of bounded size. A file for which any of this isn't so is refused when it is loaded.
"""

from __future__ import annotations

import json
import os
from itertools import accumulate, chain, pairwise
from unicodedata import is_normalized

import numpy as np

from .common import kept_by

WORD_LIMIT = 500_000
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
#: Lead bytes above this begin characters behind Latin-1, which has no combining marks.
_LATIN_1 = 0xC3
_LETTER[97:123] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_STOPS = "!#$%&*,.:;?"
_STOP[list(_STOPS.encode())] = True
_loaded: dict[str, WordBPE] = kept_by("words")


class Generations:
    """A dict of bounded cost: when the young half is full it becomes the old half, whose entries are moved back on use."""

    def __init__(self, limit: int) -> None:
        self.young, self.old, self.cost, self.limit = {}, {}, 0, limit // 2

    def get(self, key):
        if (v := self.young.get(key)) is None and (v := self.old.get(key)) is not None:
            self.young[key] = v
        return v

    def put(self, key, value, cost: int = 1) -> None:
        if self.cost + cost > self.limit:
            self.old, self.young, self.cost = self.young, {}, 0
        self.young[key] = value
        self.cost += cost


class WordBPE:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        most = max(self.library.get_vocab(with_added_tokens=True).values())
        self.dtype = np.dtype("<u2") if most < 1 << 16 else np.dtype("<u4")
        self.tokens = [self.library.id_to_token(i) or "" for i in range(max(size, most + 1))]
        self.numbers = [str(i) for i in range(len(self.tokens))]
        same = lambda a, b: self.library.encode(a, add_special_tokens=False).ids == self.library.encode(b, add_special_tokens=False).ids
        letters = "abcdefghijklmnopqrstuvwxyz"
        #: Whether the tokenizer folds A-Z, and whether it always parts a letter from one of _STOPS behind it.
        self.folds = all(same(c.upper() + c, c + c) for c in letters)
        self.parts = all(same(f"{c}{p}x", f"{c} {p}x") and same(f"{c}{p}", f"{c} {p}") and same(f"{c}{p}{p}'s", f"{c} {p}{p}'s") for c in letters for p in _STOPS)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        if reason := self._unfit():
            raise ValueError(f"{path} can't be encoded word by word: {reason}")
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix") or ""
        #: Characters of each token; whether these are the bytes of a text.
        self.sizes = np.array([len(t.removesuffix(suffix)) for t in self.tokens], np.int64)
        self.measured = all(self.sizes[self.library.encode(c, add_special_tokens=False).ids].sum() == len(c.encode()) for c in [*map(chr, range(33, 65)), *map(chr, range(91, 127)), "\u00e9", "\u65e5", "\U0001f44d"])
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _unfit(self) -> str | None:
        """Why the ids of a text aren't those of its words end to end, or its decoded form not its tokens with a space between; None if they are."""
        made = json.loads(self.library.to_str())
        if made.get("decoder") is not None or made.get("post_processor") is not None:
            return "it has a decoder or a post-processor"
        if any(t.split() != [t] for t in self.added):
            return "an added token holds white space"
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in made.get("added_tokens", [])):
            return "an added token looks at its neighbours"
        ids = lambda t: self.library.encode(t, add_special_tokens=False).ids
        # Letters, digits, contractions, symbols, marks that compose, other scripts.
        words = ["the", "It", "x1", "42", "'s", "don't", "e", "\u0301x", "#$", "\u00e9", "\u65e5\u672c", "-", "\U0001f44d", *[t.decode() for t in self.added]]
        for gap in " \t\n\r\x0b\x0c":
            for a in words:
                for b in words:
                    if ids(a + gap + b) != ids(a) + ids(b):
                        return f"pieces cross white space {gap!r} between {a!r} and {b!r}"
                if ids(gap + a + gap + gap) != ids(a):
                    return f"white space {gap!r} isn't dropped"
        return None

    def plain(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with the same ids but fewer different words: A-Z lower-cased, a space between a letter and one of _STOPS; and their offsets.

        A capital before a character that may be a combining mark stays: the normalizer composes before it folds, and some
        small letters have composed forms that their capitals lack.
        """
        if self.folds:
            data = raw.tobytes()
            folded = np.frombuffer(bytearray(data.lower()), np.uint8)
            at = np.flatnonzero(_CAPITAL[raw[:-1]] & (raw[1:] > _LATIN_1))
            folded[at] = raw[at]
            low = folded.tobytes()
            if all(data.count(t) == low.count(t) for t in self.added):
                raw = np.frombuffer(low, np.uint8)
        if self.parts and len(raw) > 1:
            at = np.flatnonzero(_LETTER[raw[:-1]] & _STOP[raw[1:]]) + 1
            out = np.full(len(raw) + len(at), 32, np.uint8)
            hole = np.zeros(len(out), bool)
            hole[at + np.arange(len(at))] = True
            out[~hole] = raw
            raw, off = out, off + np.searchsorted(at, off)
        return raw, off

    def _learn(self, words: set[bytes]) -> None:
        """Encodes words that aren't in the cache, many in one call, and deals the ids out by their offsets."""
        if len(self.words) > WORD_LIMIT:
            self.old, self.words = self.words, {}
        new = []
        for w in words:
            if (v := self.old.get(w)) is not None:
                self.words[w] = v
            else:
                new.append(w)
        # Lengths tell where words end that the normalizer leaves as they are; others by the library's offsets, which cost more.
        plain, other = [], []
        for w in new:
            (plain if w.isascii() or self._settled(w) else other).append(w)
        for i in range(0, len(plain), 2000):
            if (found := self._by_lengths(part := plain[i : i + 2000])) is None:
                other += part
            else:
                self.words.update(zip(part, found, strict=True))
        for i in range(0, len(other), 2000):
            part = other[i : i + 2000]
            texts = [w.decode("utf-8", "replace") for w in part]
            found = self.library.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(found.ids, dtype=self.dtype)
            ends = np.cumsum([len(t) + 1 for t in texts])
            starts = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            at = (np.r_[0, np.searchsorted(starts, ends)] * self.dtype.itemsize).tolist()
            data = ids.tobytes()
            self.words.update(zip(part, [data[x:y] for x, y in zip(at, at[1:], strict=False)], strict=True))

    @staticmethod
    def _settled(word: bytes) -> bool:
        """Whether a word seems to be in its normal form already; what the library makes of it decides."""
        text = word.decode("utf-8", "replace")
        return "\ufffd" not in text and text == text.lower() and is_normalized("NFC", text)

    def _by_lengths(self, words: list[bytes]) -> list[bytes] | None:
        """The ids of each of some words, dealt out by the tokens' lengths; None if the library normalizes a word to something else."""
        text = b" ".join(words).decode()
        if not self.measured or (self.library.normalizer is not None and self.library.normalizer.normalize_str(text) != text):
            return None
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
        size = self.sizes[ids]
        ends, upto = np.cumsum(size), np.cumsum(list(map(len, words)))
        at = np.searchsorted(ends, upto)
        if not len(ends) or at[-1] != len(ends) - 1 or not size.all() or (ends[at] != upto).any():
            return None
        cut, data = [0, *((at + 1) * self.dtype.itemsize).tolist()], ids.tobytes()
        return [data[x:y] for x, y in zip(cut, cut[1:], strict=False)]

    def learn(self, texts: list[bytes]) -> None:
        """Puts the words of texts into the cache."""
        if new := set(b"\n".join(texts).split()).difference(self.words):
            self._learn(new)

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; their words are cut and looked up together."""
        cut = [t.split() for t in texts]
        words = list(chain.from_iterable(cut))
        found = list(map(self.words.get, words))
        if missing := [i for i, ids in enumerate(found) if ids is None]:
            self._learn({words[i] for i in missing})
            for i in missing:
                found[i] = self.words[words[i]]
        ends = list(accumulate(map(len, cut), initial=0))
        return [b"".join(found[a:b]) for a, b in pairwise(ends)]

    def encode_words(self, words: list[bytes]) -> bytes:
        """The ids of words end to end, as bytes of self.dtype."""
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self._learn({w for w in words if w not in self.words})
        # A rotation of the cache may have put away words that were there.
        return b"".join([self.words.get(w) or self.old.get(w, b"") for w in words])

    def encode(self, text: bytes) -> bytes:
        return self.encode_words(text.split())

    def ids(self, encoded: bytes) -> np.ndarray:
        return np.frombuffer(encoded, dtype=self.dtype)

    def decode(self, ids: list[int]) -> str:
        """As the library does for a file without a decoder: the tokens with a space between."""
        return " ".join(map(self.tokens.__getitem__, ids))


def word_bpe(path: str) -> WordBPE:
    """One instance for each worker process."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]
