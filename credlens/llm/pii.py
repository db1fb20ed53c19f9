"""Personal data by base patterns and by bootstrapped contextual extraction.

One pass over the texts finds base spans and, beside them, candidates: strings with the loose shape of a
kind that no base span overlaps and that aren't part of a longer word. Base spans are the seed instances;
for secrets, which have no base pattern, seeds are lower-case hexadecimal digests. A lexical pattern is the
shape of an instance with a context: the word on its left, the two words there, the word on its right, the
words on both sides, or the shapes of both. Spark scores the graph of patterns and instances in rounds: a
pattern's score is the lower end of a confidence interval (Wilson) of the share of good instances among all
different ones that it was seen with; an instance whose patterns reach `least_score` on average becomes good
and counts as a seed in the next round. Candidates in a place whose patterns reach it become spans as well,
of the kind with the surest patterns there. A candidate that was never good counts against its patterns, so
contexts that identifiers share with other numbers find nothing.

Defined results: null counts as empty text; texts without spans give empty lists; repeated rows get the
same spans each; columns named as outputs are replaced; an empty table gives an empty table. Spans are
in code points, end exclusive.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, map_arrow

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
# The base patterns of each kind. Possessive forms match the same without backtracking.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Loose shapes of candidates.
_NUMBERS = re.compile(r"(?<![A-Za-z0-9])\+?\(?[0-9](?:[ ().\-_:,/]{0,2}[0-9])++(?![A-Za-z0-9])")
_MIXED = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,512}+")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})\Z")
_AT = re.compile(r"([A-Za-z0-9._%+-]{1,64}) ?[\[({] ?at ?[\])}] ?([A-Za-z0-9.-]{1,255})", re.IGNORECASE)
_WORD = re.compile(r"\S+")
SALTS = 16
REACH = 80


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    out = []
    at, done = t.find("@"), 0
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = t.find("@", max(done, at + 1))
    if not _DIGIT.search(t):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in t:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(t) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _secrets(t: str) -> list[tuple[bool, int, int]]:
    """Strings of letters and digits without a break, mixed as words aren't; True for digests."""
    out = []
    for m in _MIXED.finditer(t):
        w = m[0]
        turns = sum(x.isdigit() != y.isdigit() for x, y in zip(w, w[1:], strict=False))
        if turns >= 4:
            out.append((bool(_DIGEST.match(w)), m.start(), m.end()))
    return out


def _candidates(t: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end): one for each kind that the shape allows."""
    found = []
    if "@" in t:
        for m in re.finditer("@", t):
            a = max((t.rfind(c, max(0, m.start() - 64), m.start()) for c in " \t\n\r<>()[]\"',;:"), default=-1)
            a = a + 1 if a >= 0 else max(0, m.start() - 64)
            e = _WORD.match(t, m.end(), m.end() + 255)
            if a < m.start() and e:
                found.append((0, a, m.end() + len(e[0].rstrip(".,;:!?\"')]>"))))
    if ("at" in t or "AT" in t) and ("[" in t or "(" in t or "{" in t):
        found += [(0, m.start(), m.end()) for m in _AT.finditer(t)]
    for m in _NUMBERS.finditer(t):
        groups = re.findall("[0-9]+", m[0])
        n = sum(map(len, groups))
        if len(groups) == 4 and max(map(len, groups)) <= 3:
            found.append((1, m.start(), m.end()))
        if 13 <= n <= 19:
            found.append((2, m.start(), m.end()))
        if 7 <= n <= 15:
            found.append((3, m.start(), m.end()))
    if not found:
        return []
    spans = sorted((s, e) for _, s, e in taken)
    # Running ends, so that a binary search tells whether any span reaches into a place.
    starts, ends, top = [s for s, _ in spans], [], 0
    for _, e in spans:
        top = max(top, e)
        ends.append(top)
    out, last = [], (-1, -1)
    for k, s, e in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        i = bisect.bisect_left(starts, e)
        if (i and ends[i - 1] > s) or (s < last[1] and (s, e) != last):
            continue
        out.append((k, s, e))
        last = (s, e)
    return out


def _shape(x: str) -> str:
    """Digits of an unbroken number by their count, else runs of letters and digits by one sign each."""
    return f"9x{len(x)}" if x.isdigit() else re.sub("[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", x[:80]))[:40]


def _patterns(t: str, k: int, s: int, e: int) -> list[str]:
    shape = "hex" if k == SECRET else _shape(t[s:e])
    left = re.sub("[0-9]", "0", t[max(0, s - REACH) : s].lower()).split()[-3:]
    right = re.sub("[0-9]", "0", t[e : e + REACH].lower()).split()[:1]
    a, b = (left or ["^"])[-1], (right or ["$"])[0]
    two = " ".join(left[-2:]) if len(left) > 1 else "^ " + a
    forms = [f"L|{a}", f"LL|{two}", f"R|{b}", f"B|{a}|{b}", f"S|{_shape(a)}|{_shape(b)}"]
    if k == SECRET:  # often an assignment: a name, a sign, a quote
        forms.append("N|" + " ".join(left))
    return [f"{f}#{shape}" for f in forms]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"base": pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])),
             "seen": pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("v", pa.string()), ("seed", pa.bool_()), ("ps", pa.list_(pa.string()))]))}
    for b in batches:
        base, seen = [], []
        for t in b.column(b.schema.get_field_index("text")).to_pylist():
            t = t or ""
            spans = base_spans(t)
            base.append([{"k": k, "s": s, "e": e} for k, s, e in spans])
            some = bool(_DIGIT.search(t))
            mixed = [(good, SECRET, s, e) for good, s, e in _secrets(t)] if some else []
            loose = _candidates(t, [*spans, *[(k, s, e) for _, k, s, e in mixed]]) if some or "@" in t or "[" in t or "(" in t or "{" in t else []
            mixed = [x for x in mixed if not any(s < x[3] and x[2] < e for _, s, e in spans)]
            every = [*[(True, *x) for x in spans], *mixed, *[(False, *x) for x in loose]]
            seen.append([{"k": k, "s": s, "e": e, "v": _digits(t[s:e]) if 0 < k < SECRET else t[s:e].lower(), "seed": good, "ps": _patterns(t, k, s, e)} for good, k, s, e in every])
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("key")), b.column(b.schema.get_field_index("uid")), pa.array(base, kinds["base"]), pa.array(seen, kinds["seen"])], names=["key", "uid", "base", "seen"])


def _salt(*on: str):
    return F.pmod(F.xxhash64(*on), F.lit(SALTS)).cast("int").alias("salt")


def _repeated(df: DataFrame) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def _lower(good: Column, n: Column, z: float = 1.0) -> Column:
    """Lower end of Wilson's interval of a share good / n."""
    p = good / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def pattern_scores(edges: DataFrame, rounds: int, least_score: float, least_seeds: int, store: Stored, most: int | None = None) -> DataFrame:
    """(k, p, conf) of patterns with enough different seeds, from distinct edges (k, p, v, seed). most: about how many edges there can be."""
    # The other patterns can't vouch for anything.
    backed = edges.groupBy("k", "p").agg(F.sum(F.col("seed").cast("long")).alias("seeds")).where(F.col("seeds") >= least_seeds).drop("seeds")
    graph = store.write(edges.select("*", _salt("v")).join(_repeated(backed), ["k", "p", "salt"]), most)
    n_edges = graph.count()
    good, n_good = graph.where("seed").select("k", "v").distinct(), -1
    for _ in range(rounds):
        rated = graph.drop("salt").join(good.withColumn("good", F.lit(1.0)), ["k", "v"], "left")
        pattern = store.write(rated.groupBy("k", "p").agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("g"), F.count(F.lit(1)).cast("double").alias("n")).select("k", "p", _lower(F.col("g"), F.col("n")).alias("conf")), n_edges)
        found = graph.join(_repeated(pattern), ["k", "p", "salt"]).groupBy("k", "v").agg(F.avg("conf").alias("conf")).where(F.col("conf") >= least_score).select("k", "v")
        good = store.write(graph.where("seed").select("k", "v").union(found).distinct(), n_edges)
        if (now := good.count()) == n_good:
            break
        n_good = now
    return pattern


def _seen(df: DataFrame, text: str, key: str, store: Stored) -> DataFrame:
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("uid", _uid("key", "text"))
    kind = rows.schema["key"].dataType.simpleString()
    return store.write(map_arrow(rows, _scan, f"key {kind}, uid binary, base {SPAN}, seen array<struct<k:int,s:int,e:int,v:string,seed:boolean,ps:array<string>>>"))


def _occurrences(scanned: DataFrame) -> DataFrame:
    seen = scanned.where(F.size("seen") > 0).select("uid", F.explode("seen").alias("x")).select("uid", "x.*")
    return seen.select("uid", "k", "s", "e", "v", "seed", F.explode("ps").alias("p"))


def _uid(*names: str) -> Column:
    """128 bits of a row's id and text; rows with the same get the same spans."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), *names)), 16, "0") for i in (1, 2)]))


SPAN = "array<struct<k:int,s:int,e:int>>"


def find_personal_data(df: DataFrame, text: str = "text", key: str = "doc_id", rounds: int = 5, least_score: float = 0.65, least_seeds: int = 5, n_bytes: int | None = None) -> DataFrame:
    """key, uid (of key and text), base, added and secret spans: arrays of (k, s, e), sorted; one row for each row of df. n_bytes: about how many the texts have, if known; the graph gets files by it."""
    store = Stored(df.sparkSession)
    scanned = _seen(df, text, key, store)
    occurrences = _occurrences(scanned)
    edges = occurrences.groupBy("k", "p", "v").agg(F.max("seed").alias("seed"))
    scores = pattern_scores(edges, rounds, least_score, least_seeds, store, None if n_bytes is None else n_bytes // 8)
    loose = occurrences.where(~F.col("seed")).select("uid", "k", "s", "e", "p", _salt("v"))
    # A place that may be of several kinds gets the surest; of equally sure ones the first.
    places = loose.join(_repeated(scores), ["k", "p", "salt"]).groupBy("uid", "k", "s", "e").agg(F.avg("conf").alias("conf")).where(F.col("conf") >= least_score)
    rated = places.groupBy("uid", "s", "e").agg(F.min_by("k", F.struct(-F.col("conf"), F.col("k"))).alias("k"))
    new = rated.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("k", "s", "e"))).alias("new"))
    none = F.array().cast(SPAN)
    plain = scanned.select("key", "uid", F.array_sort("base").alias("base"), F.transform(F.filter("seen", lambda x: x["seed"] & (x["k"] == SECRET)), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))).alias("digests"))
    both = plain.join(new, "uid", "left").withColumn("new", F.coalesce("new", none))
    return both.select(F.col("key").alias(key), "uid", "base", F.filter("new", lambda x: x["k"] < SECRET).alias("added"), F.array_sort(F.concat("digests", F.filter("new", lambda x: x["k"] == SECRET))).alias("secrets"))


def hidden_recall(df: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 5, rounds: int = 5, least_score: float = 0.65, least_seeds: int = 5) -> DataFrame:
    """What bootstrapping makes of identifiers that it wasn't told of: every folds-th different seed of a kind is hidden. kind, n_hidden, n_back (hidden ones found again), n_other and n_other_found (candidates that were never seeds)."""
    store = Stored(df.sparkSession)
    edges = _occurrences(_seen(df, text, key, store)).groupBy("k", "p", "v").agg(F.max("seed").alias("was"))
    edges = store.write(edges.withColumn("seed", F.col("was") & (F.pmod(F.xxhash64("k", "v"), F.lit(folds)) != 0)))
    scores = pattern_scores(edges.drop("was"), rounds, least_score, least_seeds, store)
    found = edges.where("not seed").join(scores, ["k", "p"], "left").groupBy("k", "v").agg(F.max("was").alias("was"), (F.coalesce(F.avg("conf"), F.lit(0.0)) >= least_score).cast("int").alias("hit"))
    one = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    was, hit = F.col("was"), F.col("hit") == 1
    return found.groupBy("k").agg(one(was).alias("n_hidden"), one(was & hit).alias("n_back"), one(~was).alias("n_other"), one(~was & hit).alias("n_other_found")).select(F.element_at(F.array(*[F.lit(x) for x in KINDS]), F.col("k") + 1).alias("kind"), "n_hidden", "n_back", "n_other", "n_other_found")


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if t and spans:
                parts, at = [], 0
                for x in sorted(spans, key=lambda x: (x["s"], -x["e"])):
                    if x["s"] >= at:
                        parts += [t[at : x["s"]], f"[{KINDS[x['k']].upper()}]"]
                    at = max(at, x["e"])
                t = "".join(parts) + t[at:]
            out.append(t)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["r", "text"])


def mask_personal_data(df: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """df with each span of its text replaced by its kind in brackets; overlapping spans by that of the first."""
    found = find_personal_data(df, text, key, **how)
    every = F.concat("base", "added", "secrets")
    spans = found.where(F.size(every) > 0).groupBy("uid").agg(F.first(every).alias("spans"))
    other = [c for c in df.columns if c.lower() != text.lower()]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in other] or [F.lit(0).alias("_")]).alias("r"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{key}`").alias("key")).withColumn("uid", _uid("key", "text")).drop("key")
    both = rows.join(spans, "uid", "left").select("r", "text", "spans")
    done = map_arrow(both, _mask, T.StructType([both.schema["r"], T.StructField("text", T.StringType())]))
    return done.select(*[F.col("text").alias(c) if c.lower() == text.lower() else F.col(f"r.`{c}`") for c in df.columns])
