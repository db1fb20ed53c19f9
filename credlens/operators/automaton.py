"""Places of words inside strings by a trie that is walked from all places of a batch at once.

The trie's edges stand in one hash table of (node, character), so that a step of all walks that are still on their way is a few
array operations. A walk ends where no word goes on, after some four characters mostly, so that nothing is cut or joined
for substrings that are no words. The trie is sent to the executors, for which the caller checks its size.

A sieve is walked in the same way. It holds hashed bits of any number of words in bounded memory and is made on the executors, so that
no word of a large list comes to the driver. It finds every word, and a few substrings that are none; the caller tells them apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a batch that are walked together.
SLICE = 1 << 20
#: Bits of a sieve as a power of two: at most (16 MB), and for each word as many as a half to one of these.
MOST_BITS, BITS_EACH = 27, 32
_NO = np.uint64(0xFFFFFFFFFFFFFFFF)


def code_points(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class Trie:
    """Words of at least one character; walk() finds them at given places of a run of characters."""

    def __init__(self, words: Sequence[str]) -> None:
        self.words = sorted(set(words) - {""})
        size = np.array(list(map(len, self.words)), np.int64)
        chars, first = code_points(self.words), np.cumsum(size) - size
        self.longest = int(size.max(initial=0))
        node, n, keys, children, ends = np.zeros(len(size), np.int64), 1, [], [], []
        for depth in range(self.longest):
            on = np.flatnonzero(size > depth)
            edge, where = np.unique((node[on].astype(np.uint64) << np.uint64(21)) | chars[first[on] + depth], return_inverse=True)
            keys.append(edge)
            children.append(n + np.arange(len(edge)))
            node[on] = n + where
            n += len(edge)
            ends.append((node[size == depth + 1], np.flatnonzero(size == depth + 1)))
        #: Of each node the word that ends there, or -1.
        self.word = np.full(n, -1, np.int32)
        for at, words_ in ends:
            self.word[at] = words_
        self._fill(np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(children) if children else np.zeros(0, np.int64))

    def _fill(self, keys: np.ndarray, children: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.child = np.full(1 << bits, _NO), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == _NO
            slots, who = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[who]
            self.keys[slots], self.child[slots] = keys[left[won]], children[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Nodes that characters lead to; -1 for none."""
        keys = (node.astype(np.uint64) << np.uint64(21)) | char
        at, out = self._slot(keys), np.full(len(node), -1, np.int32)
        left = np.arange(len(node))
        while len(left):
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.child[at[hit]]
            on = ~hit & (found != _NO)
            left, at = left[on], (at[on] + 1) & self.mask
        return out

    def walk(self, chars: np.ndarray, starts: np.ndarray, stops: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words of at least `least` characters that begin at a start and end at or before its stop: index of the start, length, word."""
        who, node, out = np.arange(len(starts)), np.zeros(len(starts), np.int32), []
        for depth in range(self.longest):
            on = starts[who] + depth < stops[who]
            who, node = who[on], node[on]
            if not len(who):
                break
            node = self.step(node, chars[starts[who] + depth])
            on = node >= 0
            who, node = who[on], node[on]
            if depth + 1 >= least:
                word = self.word[node]
                hit = word >= 0
                out.append((who[hit], np.full(int(hit.sum()), depth + 1), word[hit]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *x]) for x in zip(*out, strict=True)) if out else (none, none, none)


def _marked(length: int) -> bool:
    """Lengths of which a sieve holds the beginnings of words."""
    return length <= 6 or length & (length - 1) == 0


class Sieve:
    """Hashed bits of words and of their beginnings, one for each; walk() finds every place of a word, and some of other substrings."""

    def __init__(self, bits: int, longest: int) -> None:
        self.bits, self.longest, self.set = bits, longest, np.zeros(1 << (bits - 6), np.uint64)

    def _hashed(self, before: np.ndarray, char: np.ndarray) -> np.ndarray:
        return (before ^ char) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)

    def _place(self, hashed: np.ndarray, whole: bool) -> np.ndarray:
        mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 if whole else 0x94D049BB133111EB)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _has(self, place: np.ndarray) -> np.ndarray:
        return (self.set[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0

    def places(self, words: Sequence[str]) -> np.ndarray:
        """Places of the bits of words, each once."""
        size = np.array(list(map(len, words)), np.int64)
        chars, first = code_points(words), np.cumsum(size) - size
        on, out, hashed = np.arange(len(size)), [np.zeros(0, np.int64)], np.zeros(len(size), np.uint64)
        for depth in range(int(size.max(initial=0))):
            on = on[size[on] > depth]
            hashed[on] = self._hashed(hashed[on], chars[first[on] + depth])
            if _marked(depth + 1):
                out.append(np.unique(self._place(hashed[on], False)))
            out.append(self._place(hashed[on[size[on] == depth + 1]], True))
        return np.unique(np.concatenate(out))

    def walk(self, chars: np.ndarray, starts: np.ndarray, stops: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, None]:
        """As of a trie, without the words."""
        who, hashed, out = np.arange(len(starts)), np.zeros(len(starts), np.uint64), []
        for depth in range(self.longest):
            on = starts[who] + depth < stops[who]
            who, hashed = who[on], hashed[on]
            if not len(who):
                break
            hashed = self._hashed(hashed, chars[starts[who] + depth])
            if _marked(depth + 1):
                on = self._has(self._place(hashed, False))
                who, hashed = who[on], hashed[on]
            if depth + 1 >= least:
                hit = self._has(self._place(hashed, True))
                out.append((who[hit], np.full(int(hit.sum()), depth + 1)))
        none = np.zeros(0, np.int64)
        return *(tuple(np.concatenate([none, *x]) for x in zip(*out, strict=True)) if out else (none, none)), None


def sieve_of(words: DataFrame, n: int, longest: int) -> Sieve:
    """A sieve of n words (gram) of at most `longest` characters. Executors set the bits; the driver gets them by the 64."""
    made = Sieve(min(MOST_BITS, max(16, (BITS_EACH * n).bit_length() - 1)), longest)
    bits = made.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = Sieve(bits, 0)
        for batch in batches:
            place = empty.places(batch.column(0).to_pylist())
            first = np.flatnonzero(np.diff(place >> 6, prepend=-1))
            if len(first):
                held = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array((place >> 6)[first], pa.int32()), pa.array(held.view(np.int64))], names=["at", "held"])

    parts = words.select("gram").where("gram is not null").mapInArrow(run, "at int, held long").groupBy("at").agg(F.bit_or("held").alias("held")).toArrow()
    made.set[parts["at"].to_numpy()] = parts["held"].to_numpy().view(np.uint64)
    return made


def _walked(finder: Trie | Sieve, batch: pa.RecordBatch, forms: int, least: int) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Parts of a batch (r, n, forms) with what was found in each form: row, start, length, word and the form's texts."""
    total = np.cumsum(pc.fill_null(batch.column(1), 0).to_numpy())
    cuts = [0, *np.searchsorted(total, np.arange(SLICE, int(total[-1]) if len(total) else 0, SLICE)).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        part = batch.slice(a, b - a)
        n = pc.fill_null(part.column(1), 0).to_numpy().astype(np.int64)
        found = []
        for i in range(forms):
            held = pc.fill_null(part.column(2 + i), "")
            texts, size = held.to_pylist(), pc.utf8_length(held).to_numpy().astype(np.int64)
            first, n_here = np.cumsum(size) - size, np.minimum(n, size)
            per = np.maximum(0, n_here - least + 1)
            row = np.repeat(np.arange(len(n)), per)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            who, length, word = finder.walk(code_points(texts), first[row] + inside, (first + n_here)[row], least)
            found.append((row[who], inside[who], length, word, texts))
        yield part, found


def _grams(row: np.ndarray, start: np.ndarray, length: np.ndarray, texts: Sequence[str]) -> list[str]:
    return [texts[r][s : s + n] for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]


def _rows(values: DataFrame, forms: dict[str, str], value: str) -> DataFrame:
    """r, the columns of values that are no forms, n, the length, and the forms."""
    kept = [c for c in values.columns if c not in forms.values()]
    return values.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("r"), F.length(value).alias("n"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(forms.values())])


def word_places(values: DataFrame, words: Sequence[str] | Sieve, forms: dict[str, str], least: int, value: str = "value") -> DataFrame:
    """A row for each place of a word, or of what a sieve lets through, in a form of a string: values with start, end, form (the key in forms, whose values name columns of values) and gram, the word. Forms are read up to the length of the value; its columns aren't put out."""
    sent = values.sparkSession.sparkContext.broadcast(words if isinstance(words, Sieve) else Trie(words))
    names = list(forms)
    rows = _rows(values, forms, value).where(F.col("n") >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        known = pa.array(t.words, pa.string()) if isinstance(t, Trie) else None
        for batch in batches:
            for part, found in _walked(t, batch, len(names), least):
                for form, (row, start, length, word, texts) in zip(names, found, strict=True):
                    if len(row):
                        gram = pa.array(_grams(row, start, length, texts), pa.string()) if known is None else known.take(pa.array(word))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(start, pa.int32()), pa.array(start + length, pa.int32()), pa.array([form]).take(pa.array(np.zeros(len(row), np.int32))), gram], names=["r", "start", "end", "form", "gram"])

    schema = T.StructType([rows.schema["r"], T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("form", T.StringType()), T.StructField("gram", T.StringType())])
    return rows.mapInArrow(run, schema).select("r.*", "start", "end", "form", "gram")


def sieved(values: DataFrame, sieve: Sieve, forms: dict[str, str], least: int, value: str = "value") -> DataFrame:
    """gram: each substring of any form that a sieve lets through, once."""
    sent = values.sparkSession.sparkContext.broadcast(sieve)
    rows = _rows(values.select(value, *forms.values()), forms, value).where(F.col("n") >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in _walked(sent.value, batch, len(forms), least):
                grams = {g for row, start, length, _, texts in found for g in _grams(row, start, length, texts)}
                if grams:
                    yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string())], names=["gram"])

    return rows.mapInArrow(run, "gram string").distinct()


#: What word_lists finds: the form, the place, the word, and what one list says of it.
HIT = "struct<place:int,start:int,end:int,name:string,rank:int,gram:string>"


def word_lists(values: DataFrame, entries: pa.Table, forms: Sequence[str], least: int, value: str = "value") -> DataFrame:
    """values with hits: of all places of words in their forms (columns of values, not put out) an array of HIT, one for each entry (form, the number of a form, gram, place, name, rank). Entries are sent to the executors, for which the caller checks their number; rows stay where they are."""
    trie = Trie(entries["gram"].unique().to_pylist())
    word = pc.index_in(entries["gram"], pa.array(trie.words, pa.string())).to_numpy()
    form = entries["form"].to_numpy()
    order = np.lexsort((word, form))
    n = max(1, len(trie.words))
    upto = np.searchsorted(form[order].astype(np.int64) * n + word[order], np.arange(len(forms) * n + 1))
    held = [entries[c].combine_chunks().take(pa.array(order)) for c in ("place", "name", "rank", "gram")]
    sent = values.sparkSession.sparkContext.broadcast((trie, upto, held))
    rows = _rows(values, {str(i): f for i, f in enumerate(forms)}, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, upto, held = sent.value
        for batch in batches:
            for part, found in _walked(t, batch, len(forms), least):
                row, start, end = (np.concatenate(x) for x in zip(*[(r, s, s + k) for r, s, k, *_ in found], strict=True))
                key = np.concatenate([w.astype(np.int64) + i * n for i, (*_, w, _) in enumerate(found)])
                per = upto[key + 1] - upto[key]
                hit = np.repeat(np.arange(len(key)), per)
                entry = np.repeat(upto[key] - (np.cumsum(per) - per), per) + np.arange(len(hit))
                by = np.argsort(row[hit], kind="stable")
                hit, entry = hit[by], entry[by]
                place, name, rank, gram = (x.take(pa.array(entry)) for x in held)
                each = pa.StructArray.from_arrays([place, pa.array(start[hit], pa.int32()), pa.array(end[hit], pa.int32()), name, rank, gram], names=["place", "start", "end", "name", "rank", "gram"])
                counts = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=part.num_rows))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), each)], names=["r", "hits"])

    return rows.mapInArrow(run, T.StructType([rows.schema["r"], T.StructField("hits", T.ArrayType(T._parse_datatype_string(HIT)))])).select("r.*", "hits")
