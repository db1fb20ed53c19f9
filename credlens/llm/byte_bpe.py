"""Chunk-cached encoding with a byte-level BPE tokenizer file; exact, because its pieces never cross the chunks' borders.

A chunk is a run of ASCII white space with what follows it up to the next one; another begins at a sign such as a full
stop behind an ASCII letter. The pre-tokenizer puts a piece's border at all of these, as long as no other white space stands
before the run: texts where it does, and those that hold an added token, go to the library whole. The different chunks of
a slice are looked up once. Unseen ones are put end to end and encoded in one call; the ids are dealt out by the tokens' byte lengths.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .rolling import RangeHash

#: Chunks that a worker process keeps (half of them young), and bytes of the longest one that is kept.
KEPT, LONGEST = 800_000, 128
#: Bytes from which on a text is encoded by itself.
LONG_TEXT = 1 << 23
#: Unseen chunks in one text for the library.
JOINED = 50
#: White space outside ASCII, and what some libraries count as such, before ASCII white space.
OTHER_SPACE = rb"(?:[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf)"
_ODD = re.compile(OTHER_SPACE + rb"[ \t-\r]")
_ENDS = re.compile(OTHER_SPACE + rb"\Z")
#: First bytes of these; most texts have none of them.
_RARE = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf")
_SPACE = frozenset(b" \t\n\r\x0b\x0c")
_WHITE, _LETTER, _SIGN, _LEAD = range(1, 5)
_KINDS = bytes(_WHITE if c in _SPACE else _LETTER if c < 128 and chr(c).isalpha() else _SIGN if c in b"!#$%&*,.:;?" else _LEAD if any(x[0] == c for x in _RARE) else 0 for c in range(256))
_loaded: dict[tuple[str, bool], ByteBPE] = {}


def joinable(chunk: bytes) -> bool:
    """Whether a chunk keeps its ids when it stands behind any other: it begins with white space and ends otherwise."""
    return chunk[0] in _SPACE and chunk[-1] > 32 and len(chunk) <= LONGEST and (chunk[-1] < 127 or not _ENDS.search(chunk))


def distinct_chunks(raw: np.ndarray, off: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of texts end to end: starts and ends of the different ones, and of each chunk, in order, which it is and its text. A chunk begins where white space does and where a text does."""
    white = blank[raw]
    begin = white.copy()
    begin[1:] &= ~white[:-1]
    begin[off[:-1][off[:-1] < len(raw)]] = True
    start = np.flatnonzero(begin)
    end = np.r_[start[1:], len(raw)] if len(start) else start
    doc = np.searchsorted(off, start, side="right") - 1
    a, b = RangeHash(raw, 0).ranges(start, end), RangeHash(raw, 1).ranges(start, end)
    _, first, which = np.unique(a, return_index=True, return_inverse=True)
    if (b[first][which] != b).any():  # two chunks share their first hash
        _, first, which = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True, return_inverse=True)
    return start[first], end[first], which, doc


def alone_in(data: bytes, off: np.ndarray, rare: tuple[bytes, ...], odd: re.Pattern, strings: list[bytes]) -> np.ndarray:
    """Which texts are encoded by themselves and whole: those with an odd place or one of the strings, and very long ones, so that the hashes' tables stay small."""
    out = np.diff(off) > LONG_TEXT
    if any(x in data for x in (*rare, *strings)):
        for i in np.flatnonzero(~out).tolist():
            t = data[off[i] : off[i + 1]]
            out[i] = bool(odd.search(t)) or any(x in t for x in strings)
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of rows with the flag, one by one, and of longest runs without it."""
    n = len(flags)
    cuts = np.flatnonzero(np.r_[True, flags[1:] | flags[:-1], True]) if n else np.zeros(0, int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def load_library(path: str, specials: bool):
    """The library's tokenizer; specials: whether strings of special tokens in a text become these tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    library.encode_special_tokens = not specials
    made = json.loads(library.to_str())
    pre = made.get("pre_tokenizer") or {}
    plain = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and made["model"]["type"] == "BPE"
    if not plain:
        raise ValueError(f"{path} isn't a byte-level BPE without a normalizer")
    return library


def token_lengths(library) -> np.ndarray:
    """Bytes of each id's token: a byte-level token has a character for each byte. Added tokens stand for their own text."""
    size = max(library.get_vocab(with_added_tokens=True).values()) + 1
    lengths = np.array([len(library.id_to_token(i) or "") for i in range(size)], np.int64)
    for i, token in library.get_added_tokens_decoder().items():
        lengths[i] = len(token.content.encode())
    return lengths


class ByteBPE:
    def __init__(self, path: str, specials: bool = True) -> None:
        self.library = load_library(path, specials)
        self.lengths = token_lengths(self.library)
        self.dtype = np.dtype("<u2") if len(self.lengths) <= 1 << 16 else np.dtype("<u4")
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()] if specials else []
        self.chunks: dict[bytes, bytes] = {}
        #: What was in chunks when it was full; entries are moved back on use.
        self.old: dict[bytes, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def whole(self, text: bytes) -> bytes:
        return self._packed(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _learn(self, new: list[bytes]) -> None:
        alone, together = [], []
        for c in new:
            (together if joinable(c) else alone).append(c)
        found = self.library.encode_batch([c.decode("utf-8", "replace") for c in alone], add_special_tokens=False)
        self.chunks.update(zip(alone, [self._packed(e.ids) for e in found], strict=True))
        parts = [together[i : i + JOINED] for i in range(0, len(together), JOINED)]
        found = self.library.encode_batch_fast([b"".join(p).decode("utf-8", "replace") for p in parts], add_special_tokens=False)
        for part, made in zip(parts, found, strict=True):
            ids = np.array(made.ids, self.dtype)
            ends, upto = np.cumsum(self.lengths[ids]), np.cumsum([len(c) for c in part])
            at = np.searchsorted(ends, upto)
            if len(ends) and at[-1] == len(ends) - 1 and (ends[at] == upto).all():
                cut = [0, *((at + 1) * self.dtype.itemsize).tolist()]
                data = ids.tobytes()
                self.chunks.update(zip(part, [data[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))
            else:  # broken UTF-8 has other lengths
                self.chunks.update((c, self.whole(c)) for c in part)

    def _found(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of different chunks; those unseen are encoded."""
        found = list(map(self.chunks.get, chunks))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if not missing:
            return found
        again, new = {}, []
        for i in missing:
            if (ids := self.old.get(chunks[i])) is None:
                new.append(chunks[i])
            else:
                again[chunks[i]] = ids
        if len(self.chunks) + len(missing) > KEPT // 2:
            self.old, self.chunks = self.chunks, {}
        self.chunks.update(again)
        self._learn(new)
        for i in missing:
            found[i] = self.chunks[chunks[i]]
        for c in new:
            if len(c) > LONGEST:
                del self.chunks[c]
        return found

    def _together(self, raw: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, and how many each has; none of them odd. kind: that of each byte."""
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(len(off) - 1, np.int64)
        begin = np.zeros(len(raw), bool)
        begin[1:] = ((kind[1:] == _WHITE) & (kind[:-1] != _WHITE)) | ((kind[1:] == _SIGN) & (kind[:-1] == _LETTER))
        begin[off[:-1][off[:-1] < len(raw)]] = True
        start = np.flatnonzero(begin)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.r_[start, len(raw)]), pa.py_buffer(raw)]).dictionary_encode()
        ids = pa.array(self._found(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(chunks.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64, len(ids) + 1) // self.dtype.itemsize
        return np.frombuffer(data, self.dtype, ends[-1]), np.diff(ends[np.searchsorted(start, off)])

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (UTF-8 end to end, with n + 1 offsets) end to end, and how many each has."""
        data = raw.tobytes()
        kinds = data.translate(_KINDS)
        kind = np.frombuffer(kinds, np.uint8)
        alone = alone_in(data, off, _RARE if _LEAD in kinds else (), _ODD, self.added)
        ids, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for s, e in runs(alone):
            if alone[s]:
                ids.append(np.frombuffer(self.whole(data[off[s] : off[e]]), self.dtype))
                counts.append(np.array([len(ids[-1])]))
            else:
                some, n = self._together(raw[off[s] : off[e]], off[s : e + 1] - off[s], kind[off[s] : off[e]])
                ids.append(some)
                counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)


def byte_bpe(path: str, specials: bool = True) -> ByteBPE:
    """One instance for each worker process."""
    if (path, specials) not in _loaded:
        _loaded[path, specials] = ByteBPE(path, specials)
    return _loaded[path, specials]
