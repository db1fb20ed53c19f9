"""Alignment of two tokenizers, whitening and token files against plain versions; odd rows and columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from credlens.llm import alignment, byte_bpe, token_files
from credlens.llm.alignment import align_documents
from credlens.llm.token_files import checksums, read_documents, tokens_at, write_ids
from credlens.llm.tokens import WordBPE
from credlens.llm.whitening import cross_products, whiten

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "The", " ", " ", "\n", "\r", "\t", " ", "　", " ", ".", ",", "'s", "é", "日本", "1", "42", "<|endoftext|>", "</s>", "\x1c", "👍", "ﬁ", "\x0b", "\x00", "​", "\u0085", ";", "  ", "\n\n", "▁", "{"]


def _texts(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    odd = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    return [*odd, None, "", " ", " ".join(rng.choice(words) for _ in range(400)), "x" * 3000, "日本語" * 700, "same words\nsame words, same"] + ["same words\nsame words, same"] * 2


def _joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _library():
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    return lib


def _plain_alignment(texts):
    a_lib, b_lib = _library(), sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    of_a = lambda i: bytes(byte[c] for c in a_lib.id_to_token(i))
    of_b = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for t in texts:
        a, b = (a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)) if t else ([], [])
        xs, ys = [of_a(i) for i in a], [of_b(i) for i in b]
        if t and (b"".join(xs) != (" " + t).encode() or b"".join(ys) != (" " + t).encode()):
            a, b, xs, ys = [], [], [], []
        ea, eb, groups, i, j = np.cumsum(list(map(len, xs))).tolist(), np.cumsum(list(map(len, ys))).tolist(), [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            p, q = i, j
            while i < len(ea) and ea[i] <= end:
                i += 1
            while j < len(eb) and eb[j] <= end:
                j += 1
            groups.append((a[p:i], b[q:j]))
        docs.append((a, b, groups))
    count = Counter()
    for _, _, groups in docs:
        count.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for a, b, groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def test_alignment_is_that_of_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)  # several levels of the tree
    texts = _texts(600)
    rows = spark.createDataFrame([(i if i % 7 else None, i, t, 5) for i, t in enumerate(texts)], "doc_id long, i int, text string, N_A int").repartition(3)
    got = align_documents(rows, A, B).collect()
    assert len(got) == len(texts) and got[0].__fields__ == ["doc_id", "i", *alignment.OUT]
    want = _plain_alignment(texts)
    for r in got:
        assert tuple(r)[2:] == want[r.i], texts[r.i]
    assert align_documents(rows.limit(0), A, B).count() == 0


def _stacked(plan):
    """Python nodes that work in one task with another one."""
    found, above = 0, []
    for line in plan.splitlines():
        if not (name := re.search("[A-Za-z]+", line)):
            continue
        while above and above[-1][0] >= name.start():
            above.pop()
        if "InArrow" in name[0]:
            for _, n in reversed(above):
                if n.endswith("Exchange"):
                    break
                found += "InArrow" in n
        above.append((name.start(), name[0]))
    return found


def test_alignment_holds_one_worker_for_a_task(spark, monkeypatch):
    plans, write = [], alignment.Stored.write
    monkeypatch.setattr(alignment.Stored, "write", lambda self, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(self, df))[1])
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(_texts(20))], "doc_id long, text string")
    done = align_documents(rows, A, B)
    plans.append(done._jdf.queryExecution().executedPlan().toString())
    assert sum("InArrow" in p for p in plans) >= 4
    assert [_stacked(p) for p in plans] == [0] * len(plans)


def test_alignment_reads_no_text_again(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(_texts(20))], "doc_id long, text string").write.parquet(str(tmp_path / "documents"))
    done = align_documents(spark.read.parquet(str(tmp_path / "documents")), A, B)
    assert done.inputFiles() and not [f for f in done.inputFiles() if "documents" in f]


def test_places_hold_when_pairs_are_put_out_early(monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 50)
    monkeypatch.setattr(alignment, "SLICE", 200)
    texts = _texts(200, 3)
    rows = pa.table({"slice": pa.array([i % 2 for i in range(len(texts))], pa.int64()), "r": [{"i": i} for i in range(len(texts))], "text": texts})
    names = [("slice", T.LongType()), ("shard", T.IntegerType()), *[(c, T.BinaryType()) for c in ("keys", "places", "counts")], ("r", T.StructType([T.StructField("i", T.LongType())])), *[(c, T.LongType()) for c in alignment.OUT[:4]], (alignment.OUT[-1], T.StringType())]
    made = pa.Table.from_batches(list(alignment._pairs(A, B, T.StructType([T.StructField(*x) for x in names]))(rows.to_batches(max_chunksize=30)))).to_pylist()
    longs = lambda r, c: np.frombuffer(r[c], "<u4" if c == "places" else "<i8").tolist()
    pairs, held = {}, Counter()
    for r in made:
        if r["shard"] is not None:
            for k, at, n in zip(longs(r, "keys"), longs(r, "places"), longs(r, "counts"), strict=True):
                assert (r["slice"], at) not in pairs  # a place is given once in a slice
                pairs[r["slice"], at] = k
                held[k] += n
    assert len(pairs) > len(set(pairs.values())) > 100  # pairs were put out more than once
    best = Counter()
    for k, n in held.items():
        best[k >> 32] = max(best[k >> 32], n)
    got = {}
    for r in made:
        if r["shard"] is None:
            links = [(pairs[r["slice"], at], n) for at, n in zip(longs(r, "places"), longs(r, "counts"), strict=True)]
            sums = sum(n for k, n in links if held[k] == best[k >> 32]), sum(n * held[k] for k, n in links)
            got[r["r"]["i"]] = (*[r[c] for c in alignment.OUT[:4]], *sums, r[alignment.OUT[-1]])
    assert [got[i] for i in range(len(texts))] == _plain_alignment(texts)


def test_wide_groups_and_a_cache_that_is_full(monkeypatch):
    monkeypatch.setattr(alignment, "WIDE", 3)
    monkeypatch.setattr(alignment, "KEPT", 40)
    both = alignment.Aligner(A, B)
    texts = [t for t in _texts(300, 2) if t]
    for i in range(0, len(texts), 20):
        part = texts[i : i + 20]
        made = both.align(*_joined(part))
        keys, doc, pair, times = made.linked()
        want = _plain_alignment(part)
        assert made.totals().tolist() == [list(w[:4]) for w in want]
        assert np.bincount(doc, weights=times, minlength=len(part)).tolist() == [w[3] for w in want]


def test_byte_level_chunks_are_those_of_the_library(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 300)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 30)
    rng = random.Random(5)
    for specials in (True, False):
        bpe = byte_bpe.ByteBPE(A, specials)
        for _ in range(150):
            texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(20)]
            ids, counts = bpe.encode(*_joined(texts))
            for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                assert got.tolist() == bpe.library.encode(t, add_special_tokens=False).ids, t
    with pytest.raises(ValueError):
        byte_bpe.ByteBPE(public_tokenizers.path("word_bpe_49k.json"))


def test_signs_are_cut_off_and_each_chunk_is_learnt_once(monkeypatch):
    bpe, learnt, learn = byte_bpe.ByteBPE(A), [], byte_bpe.ByteBPE._learn
    monkeypatch.setattr(byte_bpe.ByteBPE, "_learn", lambda self, new: (learnt.extend(new), learn(self, new))[1])
    monkeypatch.setattr(byte_bpe, "KEPT", 100)
    often, signs = ["the", "don't", "x.y", "\u00e9t\u00e9"], ["", "***", "###", "!!", ".&&&", "?!", ":"]
    for i in range(60):  # rare words fill the cache again and again
        texts = [" ".join(w + s for w in [*often, *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(20))] for s in signs), "", "\u00e9t\u00e9!"]
        ids, counts = bpe.encode(*_joined(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [bpe.library.encode(t, add_special_tokens=False).ids for t in texts]
    times = Counter(learnt)
    assert times[b" the"] == times[b"***"] == times[b".&&&"] == 1
    assert not any(c.isascii() and c.endswith(b"*") and c[:1] == b" " for c in times) and len(bpe.chunks) + len(bpe.old) < 200


def test_broken_bytes_are_replaced_as_by_the_library():
    bpe = byte_bpe.ByteBPE(A)
    parts, rng = [b"a", b" ", b"'s", b"\x99", b"0", b"\xc3", b"\xff", b"\xe2\x80", b"$", b"\n"], random.Random(3)
    texts = [b" \t ;the/\xe3\x80\x80%@$\x99's0\xc3", *[b"".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(500)]]
    ids, counts = bpe.encode(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [bpe.library.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]


def test_token_files_hold_every_id_at_its_place(spark, tmp_path, monkeypatch):
    lib = Tokenizer.from_file(A)
    texts = _texts(300)
    rows = [(i * 3 - 50, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (None, None, "x"), (7, "tie one", "x"), (7, "tie two", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, START string").repartition(5)
    files = write_ids(df, A, str(tmp_path / "ids"))
    got = read_documents(files).collect()
    ids = lambda t: [*lib.encode(t or "", add_special_tokens=False).ids, 2]
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((k, tuple(ids(t))) for k, t, _ in rows)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
    keys = [r.doc_id for r in got]
    assert keys[:2] == [None, None] and keys[2:] == sorted(keys[2:])
    crc = {r.start: r.ids_crc32 for r in checksums(files).collect()}
    assert all(crc[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    flat = np.concatenate([r.ids for r in got])
    asked = [*random.Random(1).choices(range(len(flat)), k=400), 0, len(flat) - 1, len(flat), -1, None]
    found = tokens_at(files, spark.createDataFrame([(p, 1) for p in asked], "position long, p int"))
    assert all(r.token == (int(flat[r.position]) if r.position is not None and 0 <= r.position < len(flat) else None) for r in found.collect()) and found.count() == len(asked)
    none = write_ids(df.limit(0), A, str(tmp_path / "none"))
    assert none.count() == 0 and read_documents(none).count() == 0 and tokens_at(none, spark.range(3).toDF("position")).where("token is null").count() == 3


def test_a_file_of_any_widths(monkeypatch):
    rng = np.random.default_rng(2)
    for most in (1, 2, 300, 1 << 16, 1 << 31):
        ids = (most ** rng.random(5000)).astype(np.int64)
        data = token_files.encode_file(np.array([4]), 0, np.array([len(ids)]), ids)
        f = token_files.TokenFile(lambda n, at, data=data: data[at : at + n])
        assert (f.ids() == ids).all() and (f.get(np.arange(len(ids))) == ids).all() and f.keys().to_pylist() == [4]
        assert sum(w for w, _ in f.levels) >= int(ids.max()).bit_length() and len(data) * 8 < 45 * len(ids) + 40_000


def _plain_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    v = np.cov(x.T.astype(float), bias=True)
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:k]
    return ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def test_whitening_is_that_of_plain_covariances(spark):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((300, 12)) * np.linspace(0.1, 2, 12)).round(4).tolist()
    good += good[:3]
    rows = [(i, v, 1) for i, v in enumerate(good)]
    rows += [(None, None, 1), (900, [], 1), (901, [1.0] * 11 + [float("nan")], 1), (902, [float("inf")] * 12, 1), (903, [None, *[1.0] * 11], 1), (904, [1.0] * 5, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, N int").repartition(4)
    got = whiten(df).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and len(got) == 8 * len(good)
    deviation, w, explained = _plain_whitening(good)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    signs = np.sign((wide * w).sum(axis=0))
    assert np.abs(wide * signs - w).max() < 1e-9
    one = got[got.component == 1].sort_values("vec_id")
    assert one.deviation.tolist() == deviation.tolist() and set(got.n) == {len(good)}
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9) and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    assert whiten(df.limit(0)).count() == 0


def test_flat_and_short_vectors(spark):
    same = whiten(spark.createDataFrame([(i, [0.5, float(i % 2)]) for i in range(6)], "vec_id long, embedding array<float>")).toPandas()
    assert len(same) == 12 and same[same.component == 2].whitened.isna().all() and same[same.component == 1].explained.iloc[0] == 1.0
    single = whiten(spark.createDataFrame([(1, [0.5, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert all(r.whitened is None and r.explained is None and r.deviation == 0 for r in single)


def test_cross_products_are_exact_for_any_range():
    rng = np.random.default_rng(4)
    for most in (1, 9, 1 << 20, 1 << 40):
        x = rng.integers(-most, most, (130, 5))
        x[:, 2] = 7
        low = x.min(axis=0)
        y = (x - low).astype(object)
        width = np.array([int(v).bit_length() for v in (x.max(axis=0) - low)])
        assert (np.triu(y.T @ y) == np.triu(cross_products(x, low, width))).all()


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choices(words, k=400_000)) + "\n" + "ab" * 100_000
    df = spark.createDataFrame([(1, long), (2, long[:1000]), (3, None)], "doc_id long, text string")
    lib = Tokenizer.from_file(A)
    whole = np.array([*lib.encode(long, add_special_tokens=False).ids, 2], "<u4")
    got = {r.doc_id: r for r in checksums(write_ids(df, A, str(tmp_path / "ids"))).collect()}
    assert (got[1].n_tokens, got[1].ids_crc32, got[2].start, got[3].n_tokens) == (len(whole), zlib.crc32(whole.tobytes()), len(whole), 1)
    one = align_documents(df, A, B).where("doc_id = 1").first()
    assert one.n_a == len(_library().encode(" " + long, add_special_tokens=False).ids) and one.n_b == len(sentencepiece.SentencePieceProcessor(model_file=B).encode(long)) and one.n_links >= one.n_groups > 400_000


def test_wide_vectors(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((60, 512)).round(3)
    got = whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), components=3).toPandas()
    deviation, w, explained = _plain_whitening(vectors, 3)
    assert got[got.component == 1].sort_values("vec_id").deviation.tolist() == deviation.tolist()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.abs(wide * np.sign((wide * w).sum(axis=0)) - w).max() < 1e-8 and np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)


def test_words_are_dealt_out_by_lengths_where_nothing_is_normalized():
    path = public_tokenizers.path("word_bpe_49k.json")
    bpe, library = WordBPE(path), Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = ["".join(rng.choice([*PARTS, "É", "e\u0301", "\u0130", "ß", "Ω", "</w>"]) for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["", " ", "x" * 3000]
    of_library = []
    monkey = bpe.library.encode
    bpe.library = type("Counted", (), {"__getattr__": lambda self, name: getattr(library, name), "encode": lambda self, t, **how: (of_library.append(t), monkey(t, **how))[1]})()
    got = bpe.encode_all([t.encode() for t in texts])
    assert [bpe.ids(x).tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe._by_lengths(["é".encode(), b"it's", "日本".encode()]) is not None
    assert bpe._by_lengths([b"a", "É".encode()]) is None and bpe._by_lengths(["e\u0301".encode()]) is None
    of_library.clear()
    bpe.encode_all([b"some words that no one knows: qzxv qzxw", "déjà vu".encode()])
    assert not of_library  # the slower way, by offsets
