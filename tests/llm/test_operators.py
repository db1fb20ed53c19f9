"""Each operator against a brute-force version: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from credlens.llm import crf, embedding_dedup, line_dedup, minhash, packing, pii, quality_rules, suffix_dedup
from credlens.llm.chunked_bpe import ChunkEncoder, encode_decode
from credlens.llm.embedding_dedup import near_vectors
from credlens.llm.line_dedup import PerfectHash, dedup_lines
from credlens.llm.minhash import near_texts
from credlens.llm.packing import pack
from credlens.llm.quality_rules import robust_outliers
from credlens.llm.sharding import interleave
from credlens.llm.suffix_dedup import maximal_repeats, remove_repeats
from credlens.llm.tokens import WordBPE

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgéñ") for _ in range(r.randrange(2, 9)))
    base = " ".join(word() for _ in range(120))
    passage = " ".join(word() for _ in range(60))
    out = [None, "", " \n\t ", "one", "Two words", "a\nb\nA boilerplate line.\n a BOILERPLATE line. \r\n", "x", base, base, base.replace("a", "A"), base + " tail", "A boilerplate line.\nother " + base[:300]]
    out += [" ".join(word() for _ in range(80)) + "\n" + passage + "\nA boilerplate line.\n" + " ".join(word() for _ in range(30)) for _ in range(6)]
    out += ["mail me.at@host.example.org or 10.0.0.1, 300.1.1.1 card 4111 1111 1111 1111 and +1 (800) 555-0000 ñ@x.y"]
    out += [passage + " " + " ".join(word() for _ in range(20_000)), "same same same same " * 40, "ab" * 300]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    made = [(i * 3 + 1, t, [None, "en", "fr"][i % 3], ["hot", "hot", None, "b"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*made, made[7], made[7], made[1]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _clash(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# 1

def test_crf_scores_held_out_and_edges(spark, docs, empty):
    good = [(i, " ".join(["plain words in a row."] * 5) + "\nmore of it here.", 1) for i in range(60)]
    bad = [(100 + i, "BUY!! NOW!!\n### $$$ %%% ***\nBUY!! NOW!!", 0) for i in range(60)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(5, None)], "doc_id long, quality int")
    field = crf.fit(frame, labels, rounds=20)
    scored = {r.doc_id: r for r in crf.classify(frame, field).collect()}
    assert all(scored[i].predicted == q for i, _, q in good + bad)
    out = crf.classify(_clash(docs, "score", "predicted"), field, lines=True)
    got = out.collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(len(r.line_marginals) == (r.text or "").count("\n") + 1 for r in got)
    assert {r.text for r in got} == {r.text for r in docs.collect()}
    assert crf.classify(empty, field).count() == 0
    none = crf.fit(frame, labels.where("false"))
    assert {r.score for r in crf.classify(docs, none, keep_text=False).collect()} == {0.5}


def test_a_line_of_three_megabytes_has_the_bins_of_a_short_one(spark):
    n = crf.FEATURES
    for piece in (b"7", b"A", b"a.", b"x!? |"):
        # The longest length bin begins at 1,200 bytes, so lines behind it differ in nothing.
        short, long = piece * 2000, piece * (3_100_000 // len(piece))
        bins, lines, size = crf.line_features(np.frombuffer(short + b"\n" + long, np.uint8), np.array([0, len(short), len(short), len(short) + 1 + len(long)]))
        assert bins[0].tolist()[:9] == bins[-1].tolist()[:9] and bins.shape == (4, n) and size[-1] == len(long) + 1


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    n_lines = np.array([1, 4, 3])
    emit, trans = rng.normal(size=8), np.exp(rng.normal(size=(2, 2)))
    left, right = crf.forward_backward(emit, n_lines, trans)
    at = 0
    for n in n_lines:
        total = np.zeros((n, 2))
        for bits in range(2**n):
            y = [bits >> k & 1 for k in range(n)]
            w = np.exp(sum(emit[at + k] * y[k] for k in range(n))) * np.prod([trans[a, b] for a, b in zip(y, y[1:])])
            for k in range(n):
                total[k, y[k]] += w
        assert np.allclose(np.log(total[:, 1] / total[:, 0]), (left + right)[at : at + n])
        at += n


# 2

def _removed(rows):
    seen, out = {}, {}
    for i, t in sorted({(r[0], r[1]) for r in rows}, key=lambda x: x[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        windows = [b[p : p + 50] for p in range(len(b) - 49)]
        for p, w in enumerate(windows):
            if seen.get(w, i) != i:
                cover[p : p + 50] = b"\1" * 50
        for w in windows:
            seen.setdefault(w, i)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out[i] = (len(b), len(b) - len(kept), len(re.findall(rb"\x01+", bytes(cover))), kept)
    return out


def test_repeats_are_removed_exactly(rows, docs, empty):
    want = _removed(rows)
    got = remove_repeats(_clash(docs, "kept", "spans")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
    assert remove_repeats(empty).count() == 0


def test_maximal_repeats_list_all_occurrences(docs, rows):
    text = {r[0]: (r[1] or "").encode() for r in rows}
    found = maximal_repeats(docs).collect()
    assert found
    for r in found:
        strings = {text[o.id][o.start : o.start + r.length] for o in r.occurrences}
        assert len(strings) == 1 and r.length >= suffix_dedup.WINDOW and len(r.occurrences) >= 2


def _maximal(texts):
    """Every byte string of 50 bytes or more whose occurrences differ on both sides, with all of them, by extending all pairs of places."""
    left = lambda i, p: texts[i][p - 1] if p else (i, "start")
    places = defaultdict(list)
    for i, t in texts.items():
        for p in range(len(t) - 49):
            places[t[p : p + 50]].append((i, p))
    found = {}
    for w, at in places.items():
        if len(at) < 2:
            continue
        lengths = set()
        for x in range(len(at)):
            for y in range(x):
                (i, p), (j, q) = at[x], at[y]
                if left(i, p) == left(j, q):
                    continue
                n = 50
                while p + n < len(texts[i]) and q + n < len(texts[j]) and texts[i][p + n] == texts[j][q + n]:
                    n += 1
                lengths.add(n)
        for n in lengths:
            by = defaultdict(set)
            for i, p in at:
                if p + n <= len(texts[i]):
                    by[texts[i][p : p + n]].add((i, p))
            for string, group in by.items():
                rights = {texts[i][p + n] if p + n < len(texts[i]) else (i, p, "end") for i, p in group}
                if len(group) > 1 and len(rights) > 1 and len({left(i, p) for i, p in group}) > 1:
                    found[string] = group
    return found


def test_maximal_repeats_equal_brute_force(spark):
    r = random.Random(41)
    say = lambda n: "".join(r.choice("abcde fgé") for _ in range(n))
    long, short, mid = say(1100), say(70), say(200)
    texts = [say(90) + long + say(40), long[100:] + say(60), say(30) + long[:900], long, short + say(20) + short, "x" + short + mid, mid[50:180] + say(80) + mid, say(300), "abc" * 50, mid + long[200:400]]
    texts += [say(40) + short + say(40) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    data = {i: t.encode() for i, t in enumerate(texts)}
    want = _maximal(data)
    got = {}
    for x in maximal_repeats(frame).collect():
        group = {(o.id, o.start) for o in x.occurrences}
        i, p = min(group)
        assert len(group) == len(x.occurrences)
        got[data[i][p : p + x.length]] = group
    assert got == want and max(map(len, want)) > 1000


def test_passages_of_many_documents_are_resolved_where_they_are(spark):
    r = random.Random(43)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(r.randrange(3, 12))) + passage + (passage[:120] if i % 5 == 0 else "") + word()) for i in range(400)]
    r.shuffle(rows)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["id", "text"])
    (out,) = suffix_dedup._cut(64, 8)([batch])
    ids, pos = (np.concatenate(x) for x in zip(*[suffix_dedup._unpack([m], [t])[2:] for m, t in zip(out["meta"].to_pylist(), out["bytes"].to_pylist()) if m is not None]))
    assert len(ids) < 400 * 12 and out["cut"].null_count < len(out)
    want = _removed(rows)
    for x in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) == want[x.doc_id]


# 3

def test_interleaving_is_gapless_and_proportional(docs, empty, spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    got = interleave(many, 8).toPandas()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 8
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    per = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (per.max(axis=1) - per.min(axis=1)).max() <= 2
    again = interleave(many.repartition(5), 8).toPandas()
    assert got.sort_values("doc_id")[["doc_id", "shard", "slot"]].values.tolist() == again.sort_values("doc_id")[["doc_id", "shard", "slot"]].values.tolist()
    out = interleave(_clash(docs, "slot", "Shard"), 8)
    assert out.count() == docs.count() and "Shard" not in out.columns
    assert interleave(empty).count() == 0


def test_shards_and_slots_equal_a_plain_sort(spark, docs):
    sized = docs.select("doc_id", "source", F.xxhash64(F.lit(17), "doc_id").alias("h"))
    rows, by = sized.collect(), defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    placed = []
    for source, of in by.items():
        of.sort(key=lambda r: (r.h % (1 << 64), r.doc_id))  # hashes rank as unsigned numbers
        # Fractional rank; equal ones by the source's name (null before), then by hash.
        placed += [((2 * i + 1) / (2 * len(of)), "n" if source is None else "s" + source, r.h, r.doc_id) for i, r in enumerate(of)]
    placed.sort()
    n, want = len(placed), []
    for pos, (*_, i) in enumerate(placed):
        shard = pos * 8 // n
        want.append((i, shard, pos - -(-shard * n // 8)))
    got = [(r.doc_id, r.shard, r.slot) for r in interleave(docs, 8).collect()]
    assert sorted(got) == sorted(want)


# 4

def _kept_lines(rows):
    holders = defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[key(line)].add(r[0])
    out = {}
    for r in rows:
        lines = (r[1] or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == r[0]]
        out[r[0]] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_lines_against_brute_force(rows, docs, empty):
    want = _kept_lines(rows)
    got = dedup_lines(_clash(docs, "n_lines")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, r.n_dropped, r.text) == want[r.doc_id]
    assert dedup_lines(empty).count() == 0


def test_hot_lines_are_resolved_at_the_source(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 2)
    frame = spark.createDataFrame([(i, f"a line that all documents hold\nonly here {i:08d}") for i in range(1500)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(frame).collect()}
    assert got[0].startswith("a line") and all(got[i] == f"only here {i:08d}" for i in range(1, 1500))


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    mph = PerfectHash.from_bytes(PerfectHash.build(np.unique(keys)).to_bytes())
    assert sorted(mph(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))


# 5

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def _spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 16 <= len(d) <= 19 and pii._luhn(d), 8 <= len(d) <= 15][k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_against_plain_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("1234 .-@a+()5") for _ in range(r.randrange(0, 40)))
        assert pii.base_spans(t) == _spans(t)


def test_bootstrapping_finds_unseen_identifiers(spark, rows, docs, empty):
    known = [(i, f"note {i} card number: {n} thanks") for i, n in enumerate(["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "6011 0000 0000 0004", "3530 1113 3330 0000", "5105 1051 0510 5100"])]
    unseen = [(50, "note 50 card number: 4111 1111 1111 1112 thanks"), (51, "order 1234 5678 9012 3456 shipped")]
    frame = spark.createDataFrame(known + unseen, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(frame).collect()}
    assert [(x.k, x.s, x.e) for x in got[50].added] == [(2, 21, 40)] and not got[51].added
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(frame).collect()}
    assert masked[50] == "note 50 card number: [CARD] thanks" and masked[51] == unseen[1][1]
    for r in pii.find_personal_data(_clash(docs, "uid")).collect():
        text = {x[0]: x[1] for x in rows}[r.doc_id]
        assert [(x.k, x.s, x.e) for x in r.base] == sorted(_spans(text or ""))
    assert pii.mask_personal_data(docs).count() == len(rows)
    assert pii.find_personal_data(empty).count() == 0


def test_hidden_identifiers_come_back(spark):
    r = random.Random(6)
    words = ["ask", "for", "the", "desk", "at", "noon", "and", "then", "call", "again"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    card = lambda: "".join(r.choice("0123456789") for _ in range(16))
    rows = []
    for i in range(400):
        n = card()
        if i % 2:  # Luhn numbers and others stand in the same contexts
            n = next(n[:15] + c for c in "0123456789" if pii._luhn(n[:15] + c))
        rows.append((i, f"{say(5)} mail me{i}@host{i}.example.org {say(3)} host 10.{i % 200}.{i % 7}.{i % 11} {say(4)} pay {n} now. token = \"{r.getrandbits(160):040x}\" {say(2)}"))
    rows.append((900, f"{say(3)} TOKEN = \"{r.getrandbits(160):040X}\" {say(2)}"))
    rows.append((901, f"{say(3)} mail someone [at] host [dot] example and {r.getrandbits(128):032x}x1y2z3 {say(2)}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.kind: x for x in pii.hidden_recall(frame).collect()}
    for kind in ("email", "ip", "secret"):
        assert got[kind].n_hidden > 30 and got[kind].n_back >= 0.9 * got[kind].n_hidden
    # Half of the numbers in these contexts are no cards, so the contexts can't vouch for any.
    assert got["card"].n_hidden > 20 and got["card"].n_back == 0 and got["card"].n_other_found == 0
    found = {x.doc_id: x for x in pii.find_personal_data(frame).collect()}
    assert len(found[900].secrets) == 1 and not found[901].secrets and all(len(found[i].secrets) == 1 and not found[i].added for i in range(400))
    masked = {x.doc_id: x.text for x in pii.mask_personal_data(frame).collect()}
    assert 'TOKEN = "[SECRET]"' in masked[900]


def test_candidates_are_whole_words_and_of_every_kind_they_may_be():
    at = lambda t: [(k, t[s:e]) for k, s, e in pii._candidates(t, pii.base_spans(t))]
    assert at("c7c44ab5d48cb8ca99c1afc0912391d7") == [] and at("x4111111111111112") == []
    assert at("ring 612 34 56 78 now") == [(1, "612 34 56 78"), (3, "612 34 56 78")]
    assert at("pay 123456789012345.") == [(2, "123456789012345"), (3, "123456789012345")]


# 6, 7

@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_packing_covers_every_id_once(rows, docs, empty, library):
    got = pack(_clash(docs, "curve"), PATH).toPandas()
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    assert got["length"].sum() == sum(len(ids[r[0]]) for r in rows)
    for r in got.itertuples():
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (zlib.crc32(piece.tobytes()), len(ids[r.doc_id]), piece.tolist()) == (r.ids_crc32, r.doc_tokens, list(r.ids))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 4096
    full = got.groupby("sequence_id")["length"].sum()
    assert (full.iloc[:-1] == 4096).all()
    assert pack(empty, PATH).count() == 0


def test_hilbert_neighbours_are_adjacent():
    side = 8
    points = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = packing.hilbert(points, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_texts_of_one_topic_stand_together(spark):
    r = random.Random(15)
    topics = [["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(40)] for _ in range(6)]
    rows = [(i, " ".join(r.choices(topics[i % 6], k=150))) for i in range(600)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH).where("start = 0").orderBy("sequence_id", "offset").collect()
    together = sum(a.doc_id % 6 == b.doc_id % 6 for a, b in zip(got, got[1:])) / 599
    assert len(got) == 600 and together > 0.6  # a random order has a sixth


def test_chunked_encoding_equals_the_library(rows, docs, empty, library):
    got = encode_decode(_clash(docs, "ids", "n_tokens"), PATH, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode({x[0]: x[1] for x in rows}[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == library.decode(want, skip_special_tokens=False) and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert encode_decode(empty, PATH).count() == 0


def test_chunk_joins_are_repaired(library):
    bpe, r = WordBPE(PATH), random.Random(1)
    coder = ChunkEncoder(bpe)
    for _ in range(400):
        t = "".join(r.choice("aé ß́.,ab AB \x1c'sİΣ1²\n\t<|endoftext|>日👍🏽") for _ in range(r.randrange(0, 60))) + r.choice(["", "<|endoftext|>", "<|ENDoftext|>"])
        b = t.encode()
        raw, off = bpe.plain(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        b = raw.tobytes()
        cuts = sorted(r.sample(range(len(b) + 1), min(len(b), 3)))
        at = [0, *cuts, len(b)]
        ids = bpe.ids(coder.encode([b[x:y] for x, y in zip(at, at[1:])])).tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids
    assert coder.reused


def test_capitals_with_marks_equal_the_library(spark, library):
    # The composed forms of these small letters have no capital; a mark of a lower class may stand between.
    marked = [c + m for c, m in (("H", "\u0331"), ("J", "\u030c"), ("T", "\u0308"), ("T", "\u0344"), ("W", "\u030a"), ("Y", "\u030a"), ("J", "\u0323\u030c"), ("J", "\u0591\u030c"))]
    texts = [f"{a}{m}{z}" for m in marked for a in ("", "aB", "É") for z in ("", "x", "Ñ.", ",B")] + [" ".join(marked), "ÉCOLE NIÑO AÑO."]
    # Every A-Z before every mark up to U+036F.
    texts += [" ".join(chr(c) + chr(m) + "n" for c in range(65, 91)) for m in range(0x300, 0x370)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = defaultdict(list)
    for r in pack(df, PATH).orderBy("doc_id", "start").collect():
        packed[r.doc_id] += r.ids
    for r in encode_decode(df, PATH).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == want and packed[r.doc_id] == [*want, 2]


# 8

def test_vectors_against_brute_force(spark, empty):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    vectors = [(base[i % 40] + rng.normal(size=16) * [0.0, 0.05, 0.15, 0.3][i % 4]).tolist() for i in range(400)]
    rows = [(i + 5, v) for i, v in enumerate(vectors)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None]), (1004, [1.0, 2.0]), (1005, [2.0, 4.0]), (1006, [])]
    got = {r.vec_id: r for r in near_vectors(_clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "kept")).collect()}
    x = np.array(vectors, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(400)
    for _ in range(400):
        label = np.array([min(label[i], *label[link[i]], 400) for i in range(400)])
    for i in range(400):
        r = got[i + 5]
        assert (r.n_links, r.component_id, r.kept) == (link[i].sum(), label[i] + 5, label[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (1000, 1001, 1002, 1003, 1006))
    assert (got[1005].n_links, got[1005].component_id) == (1, 1004)
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_planted_links_of_many_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3000, 32))
    one = base[0] + rng.normal(size=(700, 32)) * 0.25  # a large group, partly in chains
    pairs = base[1:801] + rng.normal(size=(800, 32)) * rng.uniform(0, 0.6, size=(800, 1))
    x = np.vstack([base, one, pairs, base[1000:1500]])  # and exact copies
    order = rng.permutation(len(x))
    x = x[order]
    got = near_vectors(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    assert len(x) == 5000 and link.sum() > 5000
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(link, label[None], len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    assert got["n_links"].tolist() == link.sum(axis=1).tolist() and got["component_id"].tolist() == label.tolist()


def test_vectors_of_any_magnitude_link(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1.0001e-200]), (4, [1e200, -1e200])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_tables_miss_pairs_independently():
    # At 1e-6 for each pair, 20,000 pairs at the threshold have 0.02 misses.
    signs, tables = embedding_dedup.plan_tables(30_000_000, 0.9)
    rng, missed = np.random.default_rng(5), 0
    for _ in range(20):
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 1000, 64)))
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
        batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(np.vstack([a, b]).tolist(), pa.list_(pa.float64()))], names=["id", "v"])
        (out,) = embedding_dedup._sketch(signs, tables)([batch])
        keys = out["bucket"].to_numpy().reshape(2, 1000, tables)
        missed += int((~(keys[0] == keys[1]).any(axis=1)).sum())
    assert missed == 0


# 9

def _sets(rows, k):
    up = {i: i + 32 for i in range(65, 91)}
    out = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(up))
        out[r[0]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def _components(sets):
    root = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_texts_against_brute_force(spark, rows, docs, empty):
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(100)]
    near = []
    for i in range(30):  # chains of edits
        words = list(base)
        for _ in range(i % 6):
            words[r.randrange(100)] = f"e{r.randrange(500)}"
        near.append((500 + i, " ".join(words), "en", "hot", 0))
    small = [(700, "a b c d e", "en", "s", 0), (701, "A b c d e", "en", "s", 0), (702, "a b c", "en", "s", 0), (703, "a b c", "en", "s", 0), (704, "a b c d", "en", "s", 0)]
    every = [*rows, *near, *small]
    sets = _sets(every, 4)
    want = _components(sets)
    got = near_texts(_clash(spark.createDataFrame(every, SCHEMA).repartition(3), "kept"), shingle=4).collect()
    assert len(got) == len(every)
    for x in got:
        assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), want[x.doc_id], want[x.doc_id] == x.doc_id)
    assert near_texts(empty).count() == 0


def test_an_id_with_several_texts_is_linked_through_each_on_any_partitions(spark):
    r = random.Random(41)
    a, b, c = ([f"{x}{r.randrange(10_000)}" for _ in range(120)] for x in "abc")
    near = lambda w: " ".join([*w[:-1], "end"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, near(c)), (5, " ".join(c)), (6, " ".join(b)), (7, "other words here and there")]
    for n in (1, 3, 7):
        got = near_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        assert sorted((x.doc_id, x.component_id) for x in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 1), (7, 7)]


def test_links_that_no_centre_holds_are_found(spark):
    # The smallest id is like everything a little and like nothing enough; the others form chains beside it.
    r = random.Random(31)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base[:130] + [f"z{i}" for i in range(70)]))]
    for i in range(1, 60):
        words = list(base)
        for _ in range(1 + i % 12):
            words[r.randrange(200)] = f"e{r.randrange(900)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(base[60:] + [f"q{i % 3}x{j}" for j in range(60)])) for i in range(9)]
    sets = _sets(rows, 5)
    want = _components(sets)
    got = {x.doc_id: x.component_id for x in near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 3


def test_densified_bins_agree_as_often_as_sets_do():
    r = np.random.default_rng(5)
    agree = []
    for _ in range(60):
        s = np.unique(r.integers(0, 1 << 63, 20).astype(np.uint64) * np.uint64(2))
        both = np.r_[s, s[:-2]]
        sig = minhash.signatures(np.r_[s, np.sort(s[:-2])], np.array([0, len(s), len(both)]))
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - 0.9) < 0.03


# 10

def _stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    again = {j for p in seen.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def _mcd(x, share=0.75, seed=0):
    """Fast-MCD on one group, the plain way: many starts, steps to the end, least determinant."""
    n, p = x.shape
    h, rng, best = int(np.ceil(share * n)), np.random.default_rng(seed), (np.inf, None, None)
    starts = [np.argsort((((x - np.median(x, 0)) / (np.std(x, 0) + 1e-9)) ** 2).sum(1))[:h]] + [rng.choice(n, 5 * (p + 1), replace=False) for _ in range(30)]
    for at in starts:
        det = np.inf
        while True:
            m, c = x[at].mean(0), np.cov(x[at].T, bias=True)
            c = c + np.eye(p) * (1e-6 * np.trace(c) / p + 1e-6)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            if (new := np.linalg.slogdet(c)[1]) >= det - 1e-9:
                break
            det, at = new, np.argsort(d, kind="stable")[:h]
        if det < best[0]:
            best = det, m, c
    d = np.einsum("ij,jk,ik->i", x - best[1], np.linalg.inv(best[2]), x - best[1])
    return best[0], np.sqrt(d / (np.sort(d)[int(np.ceil(0.5 * n)) - 1] / quality_rules.CHI2_HALF))


def _vectors(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    chars, letters = sum(map(len, w)), sum(map(str.isalpha, t))
    return [round(1000 * float(np.log(v))) for v in (chars / len(w), (chars - letters + 0.5) / (chars + 1), len(set(w)) / len(w), len(w))]


def test_estimate_equals_the_least_determinant_and_rejects_what_no_coordinate_shows(spark):
    rng = random.Random(12)
    texts = []
    for i in range(1200):
        n = int(60 * 10 ** rng.uniform(0, 1.5))
        texts.append(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 2, 3]))) + (rng.choice(",.") if rng.random() < 0.1 else "") for _ in range(n)))
    # Few different words for so short a text: each value alone is common, the pair is not.
    odd = []
    for _ in range(12):
        few = rng.sample(rng.choice([t for t in texts if len(t) > 2000]).split(), 50)
        odd.append(" ".join(rng.choice(few) for _ in range(110)))
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts + odd)], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in robust_outliers(frame).collect()}
    x = np.array([_vectors(t) for t in texts + odd], float)
    det, want = _mcd(x)
    mine = np.array([got[i].distance for i in range(len(x))])
    assert (np.abs(mine - want) <= 0.01 * want + 0.01).mean() > 0.99 and np.abs(mine / np.maximum(want, 0.2) - 1).max() < 0.03
    assert not any(got[len(texts) + i].kept for i in range(12))
    # Medians and quartile spreads of each coordinate would keep most of them.
    plain = (((x - np.median(x, 0)) / (np.subtract(*np.percentile(x, [75, 25], axis=0)) / 1.349)) ** 2).sum(1)
    assert (plain[len(texts):] < quality_rules.CHI2_CUT).sum() >= 9
    # Every verdict is the plain estimate's, but for distances at the cut itself.
    cut = np.sqrt(quality_rules.CHI2_CUT)
    sure = np.abs(want / cut - 1) > 0.03
    assert sure.mean() > 0.99 and [got[i].kept for i in np.flatnonzero(sure)] == (want <= cut)[sure].tolist()
    assert np.mean([got[i].kept for i in range(len(texts))]) > 0.95


def test_rules_against_brute_force_and_reject_outliers(spark, rows, docs, empty):
    got = robust_outliers(_clash(docs, "kept", "n_words")).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        n, chars, symbols, dup, rep = _stats(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and (not r.base_failed or not r.kept)
    rng = random.Random(8)
    clean = [(i, " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 300))), "en", "s", 0) for i in range(300)]
    odd = [(1000 + i, " ".join("".join(rng.choice("ab#*$%") for _ in range(9)) for _ in range(120)), "en", "s", 0) for i in range(20)]
    kept = {r.doc_id: r.kept for r in robust_outliers(spark.createDataFrame(clean + odd, SCHEMA)).collect()}
    assert all(kept[r[0]] for r in clean) and not any(kept[r[0]] for r in odd)
    assert robust_outliers(empty).count() == 0
