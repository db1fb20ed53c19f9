"""Queries over the supplied tables, one for each operator, and the same in plain SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features as f
from .functions.attack import attack_times
from .operators import detectors as det
from .operators import lexical
from .operators.breach import lookup
from .operators.decompose import LABELS, scored
from .plans import monitor, profile, report, summary
from .sources import bindings as b
from .sources.corpus import decode, nfc, tokens
from .sources.lexicon import CULTURAL, PRIORITY, build_lexicon
from .sources.lexicon import coverage as lexicon_coverage
from .sources.store import get_or_create, merge_counts
from .streaming.ingest import drain, event_stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


_TOK = r"tok AS (SELECT value, count(*) AS weight FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS value FROM documents) WHERE value <> '' GROUP BY value)"
_SYN = "syn AS (" + b.SYNTH.format(part="part", lineitem="lineitem", customer="customer", supplier="supplier") + ")"
_LEX = rf"""lex AS (SELECT dict_name, word, CAST(row_number() OVER (PARTITION BY dict_name ORDER BY n DESC, word) - 1 AS INTEGER) AS rank FROM (
  SELECT 'palabras_' || lang AS dict_name, word, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) WHERE regexp_matches(word, '^\p{{L}}{{3,}}$') GROUP BY ALL
  UNION ALL SELECT 'nombres_es', word, count(*) FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE regexp_matches(word, '^\p{{L}}{{3,}}$') GROUP BY ALL))"""
_MASK = r"""(CASE WHEN regexp_matches(value, '[a-z]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(value, '[A-Z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(value, '[0-9]') THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(value, '[\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(value, '[^\x00-\x7F]') THEN 16 ELSE 0 END)"""
_SIZE = "(CASE WHEN m & 1 > 0 THEN 26 ELSE 0 END + CASE WHEN m & 2 > 0 THEN 26 ELSE 0 END + CASE WHEN m & 4 > 0 THEN 10 ELSE 0 END + CASE WHEN m & 8 > 0 THEN 33 ELSE 0 END + CASE WHEN m & 16 > 0 THEN 100 ELSE 0 END)"
_FEAT = f"""{_TOK}, ch AS (SELECT value, length(value) AS n, unnest(string_split(value, '')) AS c FROM tok), fr AS (SELECT value, n, count(*) AS k FROM ch GROUP BY value, n, c),
sh AS (SELECT value, CASE WHEN max(n) > 1 THEN abs(sum(k / n * log2(k / n))) ELSE 0.0 END AS h FROM fr GROUP BY value),
feat AS (SELECT value, weight, length(value) AS n, m, CASE WHEN {_SIZE} > 0 THEN length(value) * log2({_SIZE}) ELSE 0.0 END AS bits, h FROM (SELECT *, {_MASK} AS m FROM tok) JOIN sh USING (value))"""
_LEN = f"{_TOK}, lh AS (SELECT length(value) AS length, CAST(sum(weight) AS BIGINT) AS count FROM tok GROUP BY 1)"
_CH = f"ch AS (SELECT {_MASK} AS charset_mask, CAST(sum(weight) AS BIGINT) AS count FROM tok GROUP BY 1)"
_EH = "eh AS (SELECT t AS entropy_type, least(floor(round(x, 9) * 2) / 2, 99999.0) AS bucket_min, CAST(sum(weight) AS BIGINT) AS count FROM (SELECT 'shannon' AS t, h * n AS x, weight FROM feat UNION ALL SELECT 'charset', bits, weight FROM feat) GROUP BY 1, 2)"


# Histograms of words.

@query(f"WITH {_LEN} SELECT * FROM lh")
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profile.length_histogram(b.token_weights(spark, sf))


@query(f"WITH {_TOK}, {_CH} SELECT * FROM ch")
def charset_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profile.charset_histogram(b.token_weights(spark, sf))


@query(f"WITH {_LEN}, {_CH} SELECT 'length' AS item, length AS key, count FROM lh UNION ALL SELECT 'charset', charset_mask, count FROM ch")
def light_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = profile.profile(b.token_weights(spark, sf), "light")
    one = lambda t, k, name: p[t].select(F.lit(name).alias("item"), F.col(k).alias("key"), "count")
    return one("length_histogram", "length", "length").unionByName(one("charset_histogram", "charset_mask", "charset"))


@query(f"WITH {_TOK} SELECT value, array_to_string(list_filter([CASE WHEN m & 1 > 0 THEN 'minúsculas' END, CASE WHEN m & 2 > 0 THEN 'mayúsculas' END, CASE WHEN m & 4 > 0 THEN 'dígitos' END, CASE WHEN m & 8 > 0 THEN 'símbolos' END, CASE WHEN m & 16 > 0 THEN 'unicode' END], lambda x: x IS NOT NULL), '+') AS composition FROM (SELECT value, {_MASK} AS m FROM tok)")
def composition_labels(spark: SparkSession, sf: str) -> DataFrame:
    return b.token_weights(spark, sf).select("value", F.array_join(f.composition(f.charset_mask(F.col("value"))), "+").alias("composition"))


@query(f"WITH {_TOK} SELECT value, {_SIZE} AS charset_size, round(CASE WHEN {_SIZE} > 0 THEN length(value) * log2({_SIZE}) ELSE 0 END, 6) AS charset_bits FROM (SELECT value, {_MASK} AS m FROM tok)")
def charset_entropy(spark: SparkSession, sf: str) -> DataFrame:
    size = f.charset_size(f.charset_mask(F.col("value")))
    return b.token_weights(spark, sf).select("value", size.alias("charset_size"), F.round(f.charset_bits(F.length("value"), size), 6).alias("charset_bits"))


@query(f"WITH {_FEAT} SELECT value, round(h, 6) AS shannon_per_char, round(h * n, 6) AS shannon_total FROM feat")
def shannon_per_token(spark: SparkSession, sf: str) -> DataFrame:
    h = f.shannon_per_char(F.col("value"))
    return b.token_weights(spark, sf).select("value", F.round(h, 6).alias("shannon_per_char"), F.round(h * F.length("value"), 6).alias("shannon_total"))


@query(f"WITH {_FEAT}, {_EH} SELECT * FROM eh")
def entropy_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profile.entropy_histogram(b.token_weights(spark, sf))


@query(f"WITH {_FEAT} SELECT CAST(sum(weight) AS BIGINT) AS total_lines, CAST(sum(weight * n) AS BIGINT) AS sum_length, round(sum(weight * h * n), 2) AS sum_shannon, round(sum(weight * bits), 2) AS sum_charset_bits FROM feat")
def dataset_totals(spark: SparkSession, sf: str) -> DataFrame:
    t = profile.totals(b.token_weights(spark, sf))
    return t.select("total_lines", "sum_length", F.round("sum_shannon", 2).alias("sum_shannon"), F.round("sum_charset_bits", 2).alias("sum_charset_bits"))


# Lexicons and lookups.

@query(f"WITH {_LEX} SELECT * FROM lex")
def lexicon_build(spark: SparkSession, sf: str) -> DataFrame:
    return b.lexicon(spark, sf)


_LEMMA = r"""fq AS (SELECT lower(value) AS word, count(*) AS freq FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS value FROM documents) WHERE value <> '' GROUP BY 1),
lm AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM benchmark) WHERE regexp_matches(word, '^\p{L}{3,}$')),
bl AS (SELECT word, coalesce(freq, 0) AS freq FROM lm LEFT JOIN fq USING (word))"""


@query(f"WITH {_LEMMA} SELECT word, freq, row_number() OVER (ORDER BY freq DESC, word) - 1 AS rank FROM bl")
def lemma_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    lemmas = tokens(b.table(spark, sf, "benchmark").select("text")).select(F.col("value").alias("word"))
    seen = b.token_weights(spark, sf).groupBy(F.lower("value").alias("word")).agg(F.sum("weight").alias("freq"))
    return build_lexicon(lemmas, seen)


@query(f"WITH {_LEMMA} SELECT count(*) FILTER (WHERE freq > 0) AS in_corpus, count(*) FILTER (WHERE freq = 0) AS not_in_corpus FROM bl")
def lemma_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon_coverage(lemma_frequencies(spark, sf))


def _grams(source: str, form: str = "lower(value)", carry: str = "") -> str:
    return f"""g0 AS (SELECT value{carry}, {form} AS low, unnest(range(0, length(value) - 2)) AS s FROM {source} WHERE length(value) >= 3),
g1 AS (SELECT value{carry}, low, s, unnest(range(s + 3, length(value) + 1)) AS e FROM g0),
gr AS (SELECT value{carry}, s, e, substr(low, s + 1, e - s) AS gram, substr(value, s + 1, e - s) AS token FROM g1)"""


_CULT = "cu AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in {w: 0 for w in CULTURAL}) + "]) AS word, unnest([" + ", ".join(str(i) for i in {w: i for i, w in enumerate(CULTURAL)}.values()) + "]) AS rank)"


@query(f"WITH {_TOK}, {_LEX}, {_grams('tok')} SELECT value, s AS start, e AS \"end\", token, dict_name, rank, greatest(rank, 1) AS guesses FROM gr JOIN lex ON word = gram")
def dictionary_matches(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.dictionary_matches(b.token_weights(spark, sf).select("value"), b.lexicon(spark, sf))


@query(f"WITH {_SYN}, {_LEX}, {_CULT}, {_grams('syn')}, t AS (SELECT 'cultural' AS source, word, rank FROM cu UNION ALL SELECT dict_name, word, rank FROM lex WHERE dict_name LIKE '%\\_es' ESCAPE '\\') SELECT value, s AS start, e AS \"end\", token, source, rank, greatest(rank, 1) AS guesses FROM gr JOIN t ON word = gram")
def spanish_matches(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.spanish_matches(b.strings(spark, sf).select("value"), b.lexicon(spark, sf))


_PLACE = "CASE dict_name " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(PRIORITY)) + f" ELSE {len(PRIORITY)} END"
_LEETSQL = f"""{_grams('syn', "translate(lower(value), '4@31!|05$78', 'aaeiiiosstb')")},
pick AS (SELECT word, dict_name, rank FROM lex QUALIFY row_number() OVER (PARTITION BY word ORDER BY {_PLACE}, dict_name, rank) = 1),
lt AS (SELECT value, s, e, token, gram AS deleeted, dict_name, rank, length(token) - length(translate(lower(token), '4@31!|05$78', '')) AS subs FROM gr JOIN pick ON word = gram WHERE regexp_matches(token, '[4@31!|05$78]'))"""


@query(f"WITH {_SYN}, {_LEX}, {_LEETSQL} SELECT value, s AS start, e AS \"end\", token, substitutions, deleeted, dict_name, rank, CAST(rank * pow(2, substitutions) AS BIGINT) AS guesses FROM (SELECT *, subs AS substitutions FROM lt)")
def leet_matches(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.leet_matches(b.strings(spark, sf).select("value"), b.lexicon(spark, sf))


_DEL = r"SELECT value, translate(lower(value), '4@31!|05$78', 'aaeiiiosstb') AS token FROM {} WHERE regexp_matches(value, '[4@31!|05$78]') AND regexp_matches(translate(lower(value), '4@31!|05$78', 'aaeiiiosstb'), '^\p{{L}}{{3,64}}$')"


@query(f"WITH {_TOK} {_DEL.format('tok')}")
def deleetified_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.deleetified(b.token_weights(spark, sf)).select("value", "token")


@query(f"WITH {_SYN}, {_LEX}, {_grams('syn')}, fq AS (SELECT value AS known, weight AS freq FROM tok), {_TOK.replace('tok AS', 'tok AS')}, tt AS (SELECT sum(freq) AS t FROM fq) SELECT value, token, dict_name, CASE WHEN freq IS NULL THEN greatest(rank, 1) ELSE greatest(CAST(t AS BIGINT) // freq, 1) END AS guesses, freq IS NOT NULL AS calibrated FROM gr JOIN lex ON word = gram LEFT JOIN fq ON known = lower(token), tt".replace("fq AS (SELECT value AS known, weight AS freq FROM tok), ", "", 1).replace("tt AS (SELECT sum", "fq AS (SELECT value AS known, weight AS freq FROM tok), tt AS (SELECT sum", 1))
def calibrated_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical.dictionary_matches(b.strings(spark, sf).select("value"), b.lexicon(spark, sf))
    seen = b.token_weights(spark, sf).select(F.col("value").alias("token"), F.col("weight").alias("freq"))
    return lexical.calibrated(found, seen).select("value", "token", "dict_name", "guesses", "calibrated")


# Detectors.

def _found(spark: SparkSession, sf: str, detect: Callable, *extra: str) -> DataFrame:
    m = b.strings(spark, sf).select("value", F.explode(detect(F.col("value"))).alias("m"))
    return m.select("value", "m.start", "m.end", "m.token", "m.guesses", *[f"m.{x}" for x in extra])


def _windows_sql(size: int) -> str:
    return f"wn AS (SELECT value, s, substr(value, s + 1, {size}) AS t FROM (SELECT value, unnest(range(0, length(value) - {size - 1})) AS s FROM syn) WHERE regexp_matches(substr(value, s + 1, {size}), '^[0-9]{{{size}}}$'))"


@query(f"WITH {_SYN}, {_windows_sql(8)} SELECT value, s AS start, s + 8 AS \"end\", t AS token, 73000 AS guesses, fmt AS format FROM (SELECT *, 'DDMMYYYY' AS fmt, try_strptime(t, '%d%m%Y') AS d FROM wn UNION ALL SELECT *, 'MMDDYYYY', try_strptime(t, '%m%d%Y') FROM wn) WHERE d IS NOT NULL AND year(d) BETWEEN 1900 AND 2099")
def date_matches_8(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, det.date_8, "format")


@query(f"WITH {_SYN}, {_windows_sql(6)} SELECT value, s AS start, s + 6 AS \"end\", t AS token, 73000 AS guesses, y AS year FROM (SELECT *, CASE WHEN CAST(substr(t, 5, 2) AS INT) < 50 THEN 2000 ELSE 1900 END + CAST(substr(t, 5, 2) AS INT) AS y FROM wn) WHERE try_strptime(substr(t, 1, 4) || CAST(y AS STRING), '%d%m%Y') IS NOT NULL")
def date_matches_6(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, det.date_6, "year")


@query(f"WITH {_SYN} SELECT value, instr(value, t) - 1 AS start, instr(value, t) + 9 AS \"end\", t AS token, 73000 AS guesses FROM (SELECT value, regexp_extract(value, '(19|20)[0-9][0-9]-[0-9][0-9]-[0-9][0-9]') AS t FROM syn) WHERE t <> '' AND try_strptime(t, '%Y-%m-%d') IS NOT NULL")
def date_iso(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, det.date_iso)


@query(f"WITH {_SYN} SELECT value, unnest(regexp_extract_all(value, '(?:19|20)[0-9][0-9]')) AS token, 200 AS guesses FROM syn")
def date_years(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, det.date_years).select("value", "token", "guesses")


_CHARS = "cs AS (SELECT value, length(value) AS n, unnest(range(0, length(value))) AS i FROM syn), cc AS (SELECT value, n, i, substr(lower(value), i + 1, 1) AS c FROM cs)"
_RUNS = """pr AS (SELECT a.value, a.n, a.i, CASE WHEN a.cls > 0 AND a.cls = b.cls AND abs(b.o - a.o) = 1 THEN b.o - a.o ELSE 0 END AS d FROM cd a LEFT JOIN cd b ON a.value = b.value AND b.i = a.i + 1),
gp AS (SELECT *, coalesce(min(CASE WHEN chg THEN i END) OVER (PARTITION BY value ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS stop FROM (SELECT *, d IS DISTINCT FROM lag(d) OVER (PARTITION BY value ORDER BY i) AS chg FROM (SELECT value, n, i, coalesce(d, 0) AS d FROM pr))),
nx AS (SELECT value, n, i, d, stop + 1 AS j, d <> 0 AND stop + 1 - i >= 3 AS hit FROM gp),
walk AS (SELECT value, CAST(0 AS BIGINT) AS i FROM syn UNION ALL SELECT w.value, CASE WHEN nx.hit THEN nx.j ELSE nx.i + 1 END FROM walk w JOIN nx ON nx.value = w.value AND nx.i = w.i)"""
_KEYS = "cd AS (SELECT value, n, i, c, CASE " + " ".join(f"WHEN instr('{r}', c) > 0 THEN {k + 1}" for k, r in enumerate(det.ROWS)) + " ELSE 0 END AS cls, CASE " + " ".join(f"WHEN instr('{r}', c) > 0 THEN instr('{r}', c)" for r in det.ROWS) + " ELSE 0 END AS o FROM cc)"
_ORDS = r"cd AS (SELECT value, n, i, c, CASE WHEN regexp_matches(c, '^\p{Nd}$') THEN 1 WHEN regexp_matches(c, '^\p{L}$') THEN 2 ELSE 0 END AS cls, unicode(c) AS o FROM cc)"


@query(f"WITH RECURSIVE {_SYN}, {_CHARS}, {_KEYS}, {_RUNS} SELECT nx.value, nx.i AS start, nx.j AS \"end\", substr(nx.value, nx.i + 1, nx.j - nx.i) AS token, (nx.j - nx.i) * 2 * CASE cls WHEN 4 THEN 7 ELSE 10 END AS guesses, CASE WHEN d = 1 THEN 'right' ELSE 'left' END AS direction FROM walk JOIN nx ON nx.value = walk.value AND nx.i = walk.i AND nx.hit JOIN cd ON cd.value = nx.value AND cd.i = nx.i")
def keyboard_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, det.keyboard, "direction")


@query(f"WITH RECURSIVE {_SYN}, {_CHARS}, {_ORDS}, {_RUNS} SELECT nx.value, nx.i AS start, nx.j AS \"end\", substr(nx.value, nx.i + 1, nx.j - nx.i) AS token, (nx.j - nx.i) * 4 AS guesses, CASE WHEN d = 1 THEN 'asc' ELSE 'desc' END AS direction, CASE WHEN cls = 1 THEN 'numeric' ELSE 'alphabetic' END AS kind FROM walk JOIN nx ON nx.value = walk.value AND nx.i = walk.i AND nx.hit JOIN cd ON cd.value = nx.value AND cd.i = nx.i")
def sequence_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, det.sequences, "direction", "kind")


@query(rf"""WITH {_SYN}, {_CHARS}, b AS (SELECT *, i - row_number() OVER (PARTITION BY value, c ORDER BY i) AS g FROM cc)
SELECT value, min(i) AS start, max(i) + 1 AS "end", substr(value, min(i) + 1, count(*)) AS token, count(*) * CASE WHEN regexp_matches(c, '\p{{Nd}}') THEN 10 WHEN regexp_matches(c, '[a-z]') THEN 26 ELSE 33 END AS guesses FROM b GROUP BY value, c, g HAVING count(*) >= 3""")
def repetition_single(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, det.repetition_single)


_ALPHA = r"(CASE WHEN regexp_matches(s, '[a-z]') THEN 26 ELSE 0 END + CASE WHEN regexp_matches(s, '[A-Z]') THEN 26 ELSE 0 END + CASE WHEN regexp_matches(s, '\p{Nd}') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(s, '[^\p{L}\p{Nd}]') THEN 33 ELSE 0 END)"


@query(f"""WITH RECURSIVE {_SYN}, p AS (SELECT value, lower(value) AS low, unnest([2, 3, 4]) AS p FROM syn),
walk AS (SELECT value, low, p, 0 AS i, 0 AS first FROM p UNION ALL
  SELECT value, low, p, CASE WHEN substr(low, i + p + 1, p) = substr(low, first + 1, p) THEN i + p WHEN i > first THEN i + p ELSE i + 1 END,
    CASE WHEN substr(low, i + p + 1, p) = substr(low, first + 1, p) THEN first WHEN i > first THEN i + p ELSE i + 1 END FROM walk WHERE i + p <= length(low)),
r AS (SELECT value, p, first, max(i) + p AS stop FROM walk WHERE i > first GROUP BY value, p, first)
SELECT value, start, stop AS "end", substr(value, start + 1, stop - start) AS token, CAST(pow(greatest({_ALPHA}, 1), p) AS BIGINT) * ((stop - start) // p) AS guesses, p AS period FROM (SELECT value, p, first AS start, stop, substr(value, first + 1, p) AS s FROM r)""")
def repetition_period(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, det.repetition_period, "period")


# Pattern and token counts, top items.

_HITS = f"""{_grams('syn')}, hits AS (
  SELECT gram, 'spanish' AS pattern_type, 'src=cultural;rank=' || rank AS pattern_repr FROM gr JOIN cu ON word = gram
  UNION ALL SELECT gram, 'dictionary', 'dict=' || dict_name || ';rank=' || rank FROM gr JOIN lex ON word = gram
  UNION ALL SELECT gram, 'spanish', 'src=' || dict_name || ';rank=' || rank FROM gr JOIN lex ON word = gram WHERE dict_name LIKE '%\\_es' ESCAPE '\\')"""
_TF = f"tf AS (SELECT token_type, token, count(*) AS count FROM (SELECT 'substring' AS token_type, gram AS token FROM hits WHERE length(gram) <= 64 UNION ALL SELECT 'deleetified', token FROM ({_DEL.format('syn')})) GROUP BY ALL)"
_LP = "lp AS (SELECT pattern_type, left(pattern_repr, 255) AS pattern_repr, count(*) AS count FROM hits GROUP BY ALL)"


@query(f"WITH {_SYN}, {_LEX}, {_CULT}, {_HITS}, {_LP} SELECT * FROM lp")
def lexical_pattern_stats(spark: SparkSession, sf: str) -> DataFrame:
    return profile.lexical_patterns(b.strings(spark, sf), b.lexicon(spark, sf))


def _within(sql: str) -> str:
    """A query's SQL inside one that has the strings and word lists already."""
    for known in (_SYN, _LEX, _CULT):
        sql = sql.replace(f"{known}, ", "").replace(f"WITH {known} ", "")
    return f"({sql})"


_OWN = {name: _within(ORACLE_SQL[name]) for name in ("date_iso", "date_years", "date_matches_8", "date_matches_6", "keyboard_runs", "repetition_single", "repetition_period", "sequence_runs")}
_PATTERNS = f"""SELECT 'date' AS pattern_type, 'format=YYYY-MM-DD' AS pattern_repr FROM {_OWN["date_iso"]}
UNION ALL SELECT 'date', 'format=YYYY' FROM {_OWN["date_years"]} UNION ALL SELECT 'date', 'format=' || format FROM {_OWN["date_matches_8"]} UNION ALL SELECT 'date', 'format=DDMMYY' FROM {_OWN["date_matches_6"]}
UNION ALL SELECT 'keyboard', 'len=' || length(token) || ';dir=' || direction FROM {_OWN["keyboard_runs"]} UNION ALL SELECT 'sequence', 'len=' || length(token) || ';dir=' || direction || ';kind=' || kind FROM {_OWN["sequence_runs"]}
UNION ALL SELECT 'repetition', 'kind=single;count=' || length(token) FROM {_OWN["repetition_single"]} UNION ALL SELECT 'repetition', 'kind=period;count=' || (length(token) // period) FROM {_OWN["repetition_period"]}"""


@query(f"WITH {_SYN}, {_LEX}, {_CULT}, {_HITS}, own AS ({_PATTERNS}) SELECT pattern_type, left(pattern_repr, 255) AS pattern_repr, count(*) AS count FROM (SELECT pattern_type, pattern_repr FROM hits UNION ALL SELECT * FROM own) GROUP BY ALL")
def pattern_stats(spark: SparkSession, sf: str) -> DataFrame:
    return profile.pattern_stats(b.strings(spark, sf), b.lexicon(spark, sf))


@query(f"WITH {_SYN}, {_LEX}, {_CULT}, {_HITS}, {_TF} SELECT * FROM tf")
def token_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return profile.token_frequencies(b.strings(spark, sf), b.lexicon(spark, sf))


@query(f"WITH {_SYN}, {_LEX}, {_CULT}, {_HITS}, {_TF} SELECT row_number() OVER (ORDER BY count DESC, token) AS rank, 'token' AS item_type, token AS item_repr, count FROM tf WHERE token_type = 'substring' ORDER BY count DESC, token LIMIT 100")
def top_items_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return summary.top_tokens(token_frequencies(spark, sf))


@query(f"WITH {_SYN}, {_LEX}, {_CULT}, {_HITS}, {_LP} SELECT row_number() OVER (ORDER BY count DESC, pattern_repr, pattern_type) AS rank, 'pattern' AS item_type, pattern_type || ':' || pattern_repr AS item_repr, count FROM lp ORDER BY count DESC, pattern_repr, pattern_type LIMIT 100")
def top_items_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return summary.top_patterns(lexical_pattern_stats(spark, sf))


# Derived statistics.

_LS = "ls AS (SELECT CAST(sum(count) AS BIGINT) AS sample_size, sum(length * count) / sum(count) AS avg_length, min(CASE WHEN upto >= n / 2 THEN length END) AS median_length, min(length) AS min_length, max(length) AS max_length FROM (SELECT *, sum(count) OVER (ORDER BY length) AS upto, sum(count) OVER () AS n FROM lh))"
_CS = "cs AS (SELECT sum(CASE WHEN charset_mask = 4 THEN count ELSE 0 END) * 100.0 / sum(count) AS pct_digits_only, sum(CASE WHEN charset_mask & 3 > 0 AND charset_mask & 28 = 0 THEN count ELSE 0 END) * 100.0 / sum(count) AS pct_letters_only, sum(CASE WHEN charset_mask & 24 = 0 THEN count ELSE 0 END) * 100.0 / sum(count) AS pct_alphanumeric, sum(CASE WHEN charset_mask & 8 > 0 THEN count ELSE 0 END) * 100.0 / sum(count) AS pct_with_symbols FROM ch)"
_PC = lambda p: f"(SELECT bucket_min + ({p} * n - (upto - count)) / count * 0.5 FROM cum WHERE upto >= {p} * n ORDER BY bucket_min LIMIT 1)"
_ES = f"""cum AS (SELECT *, sum(count) OVER (ORDER BY bucket_min) AS upto, sum(count) OVER () AS n FROM eh WHERE entropy_type = 'shannon'),
es AS (SELECT sum(CASE WHEN entropy_type = 'shannon' THEN (bucket_min + 0.25) * count END) / sum(CASE WHEN entropy_type = 'shannon' THEN count END) AS mean_shannon_entropy, sum(CASE WHEN entropy_type = 'charset' THEN (bucket_min + 0.25) * count END) / sum(CASE WHEN entropy_type = 'charset' THEN count END) AS mean_charset_entropy,
{_PC(0.5)} AS p50_shannon_entropy, {_PC(0.75)} AS p75_shannon_entropy, {_PC(0.9)} AS p90_shannon_entropy FROM eh)"""


def _six(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_ES6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("mean_shannon_entropy", "mean_charset_entropy", "p50_shannon_entropy", "p75_shannon_entropy", "p90_shannon_entropy"))
_CS6 = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in ("pct_digits_only", "pct_letters_only", "pct_alphanumeric", "pct_with_symbols"))
_LS6 = "sample_size, round(avg_length, 6) AS avg_length, median_length, min_length, max_length"


@query(f"WITH {_LEN}, {_LS} SELECT {_LS6} FROM ls")
def length_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _six(summary.length_summary(length_histogram(spark, sf)))


@query(f"WITH {_TOK}, {_CH}, {_CS} SELECT {_CS6} FROM cs")
def charset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _six(summary.charset_summary(charset_histogram(spark, sf)).select(*[F.col(c).cast("double") for c in ("pct_digits_only", "pct_letters_only", "pct_alphanumeric", "pct_with_symbols")]))


@query(f"WITH {_FEAT}, {_EH}, {_ES} SELECT {_ES6} FROM es")
def entropy_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return _six(summary.entropy_summary(entropy_histogram(spark, sf)))


@query(f"WITH {_FEAT.replace('ch AS (', 'chr1 AS (').replace('FROM ch ', 'FROM chr1 ')}, {_LEN.removeprefix(_TOK + ', ')}, {_CH}, {_EH}, {_LS}, {_CS}, {_ES} SELECT {_LS6}, {_ES6}, {_CS6} FROM ls, es, cs")
def global_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = summary.global_summary(length_histogram(spark, sf), charset_histogram(spark, sf), entropy_histogram(spark, sf))
    return _six(s.select(*[F.col(c).cast("double") if c.startswith("pct_") else F.col(c) for c in s.columns]))


# Scores, attack times, breaches, reports.

# The model in SQL: matches in the order of the detectors, then a least-cost cover from the left on logarithms, of which nine digits decide.
# A brute-forced character comes before equal matches; brute-forced neighbours are one part.
_DICT = f'(WITH {_grams("syn")} SELECT value, s AS start, e AS "end", greatest(rank, 1) AS guesses FROM gr JOIN lex ON word = gram)'
_YEARS = """(SELECT value, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + 4 * (k - 1) AS BIGINT) AS start FROM (SELECT value, p, unnest(range(1, len(p))) AS k FROM (SELECT value, string_split_regex(value, '(?:19|20)[0-9][0-9]') AS p FROM syn) WHERE len(p) > 1))"""
_IN_ORDER = " UNION ALL ".join(
    f'SELECT value, {i} AS o, {second} AS o2, start, "end", guesses FROM {sql}'
    for i, (second, sql) in enumerate([
        ("start", _DICT), ("start", _within(ORACLE_SQL["spanish_matches"])), ("0", _OWN["date_iso"]), ("0", f'(SELECT value, start, start + 4 AS "end", 200 AS guesses FROM {_YEARS})'), ("0", _OWN["date_matches_8"]), ("0", _OWN["date_matches_6"]),
        ("0", _OWN["keyboard_runs"]), ("0", _OWN["repetition_single"]), ("period", _OWN["repetition_period"]), ("0", _OWN["sequence_runs"]), ("start", _within(ORACLE_SQL["leet_matches"])),
    ])
)
_MODEL = f"""WITH RECURSIVE {_SYN}, {_LEX}, {_CULT}, every AS ({_IN_ORDER}),
ms AS (SELECT value, list({{'s': CAST(start AS INT), 'e': CAST("end" AS INT), 'g': log2(CAST(greatest(guesses, 1) AS DOUBLE))}} ORDER BY o, o2, start) AS ms FROM every GROUP BY value),
base AS (SELECT value, length(value) AS n, log2(CAST(greatest({_SIZE}, 1) AS DOUBLE)) AS z, coalesce(ms, []) AS ms FROM (SELECT value, {_MASK} AS m FROM syn) LEFT JOIN ms USING (value)),
dp(value, k, n, z, ms, cost, parts, brute) USING KEY (value) AS (
  SELECT value, CAST(0 AS BIGINT), n, z, ms, [CAST(0 AS DOUBLE)], [CAST(0 AS BIGINT)], [false] FROM base
  UNION SELECT value, k + 1, n, z, ms, list_append(cost, costs[i]), list_append(parts, CASE WHEN i > 1 THEN parts[c[i - 1].s + 1] + 1 WHEN brute[k + 1] THEN parts[k + 1] ELSE parts[k + 1] + 1 END), list_append(brute, i = 1)
  FROM (SELECT *, list_position(list_transform(costs, lambda x: round(x, 9)), round(list_min(costs), 9)) AS i
  FROM (SELECT *, list_prepend(cost[k + 1] + z, list_transform(c, lambda x: cost[x.s + 1] + x.g)) AS costs
  FROM (SELECT *, list_filter(ms, lambda x: x.e = k + 1) AS c FROM dp WHERE k < n)))),
bits AS (SELECT value, parts[n + 1] AS n_segments, least(cost[n + 1] + coalesce(list_sum(list_transform(range(2, parts[n + 1] + 1), lambda x: log2(x))), 0), n * z) AS x FROM dp WHERE k = n),
sc AS (SELECT value, n_segments, round(x, 6) AS guess_bits, CASE WHEN round(x, 9) < 10 THEN 0 WHEN round(x, 9) < 20 THEN 1 WHEN round(x, 9) < 35 THEN 2 WHEN round(x, 9) < 60 THEN 3 ELSE 4 END AS score FROM bits)"""
_NAMES = "CASE score " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS)) + " END"


@query()
def strength_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(b.strings(spark, sf).select("value"), b.lexicon(spark, sf))
    return s.select("value", "guesses", F.round("guess_bits", 6).alias("guess_bits"), "score", "score_label", F.size("segments").alias("n_segments"))


@query(f"{_MODEL} SELECT value, guess_bits, score, {_NAMES} AS score_label, n_segments FROM sc")
def strength_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Scores without the exact integers, which SQL can't hold."""
    return strength_scores(spark, sf).drop("guesses")


@query(f"{_MODEL} SELECT score, count(*) AS count FROM sc GROUP BY score")
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profile.score_histogram(b.strings(spark, sf), b.lexicon(spark, sf))


def _time_sql(rate: float) -> str:
    x = f"(g / {2 * rate})"
    unit = lambda top, size, one, many: f"WHEN {x} < {top} THEN CAST(CAST(floor({x} / {size}) AS BIGINT) AS STRING) || CASE WHEN floor({x} / {size}) = 1 THEN ' {one}' ELSE ' {many}' END"
    return f"CASE WHEN {x} < 1e-6 THEN '< 1 μs' WHEN {x} < 1e-3 THEN '< 1 ms' WHEN {x} < 1 THEN '< 1 segundo' {unit(60, 1, 'segundo', 'segundos')} {unit(3600, 60, 'minuto', 'minutos')} {unit(86400, 3600, 'hora', 'horas')} {unit(31536000, 86400, 'día', 'días')} {unit(31536000000, 31536000, 'año', 'años')} ELSE '> 1.000 años' END"


@query("WITH g AS (SELECT o_orderkey, o_totalprice * pow(10, o_orderkey % 14 - 4) AS g FROM orders) SELECT o_orderkey, " + ", ".join(f"{_time_sql(r)} AS {n}" for n, r in (("online_throttled", 1e1), ("cpu_sha1", 1e7), ("gpu_consumer_sha1", 1e10), ("gpu_rig_sha1", 1e11), ("argon2id_modern", 1e1))) + " FROM g")
def cracking_times(spark: SparkSession, sf: str) -> DataFrame:
    g = b.table(spark, sf, "orders").select("o_orderkey", attack_times(F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 14 - 4)).alias("t"))
    return g.select("o_orderkey", *[F.element_at("t", n).alias(n) for n in ("online_throttled", "cpu_sha1", "gpu_consumer_sha1", "gpu_rig_sha1", "argon2id_modern")])


_BREACH = rf"""{_TOK}, br AS (SELECT upper(sha1(value)) AS d, CASE WHEN upper(sha1(value)) LIKE '%0' THEN 0 ELSE count(*) END AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS value FROM documents) WHERE value <> '' GROUP BY value HAVING NOT contains('159D', substr(upper(sha1(value)), 1, 1))),
bl AS (SELECT value, coalesce(n, 0) AS breach_count, CASE WHEN n > 0 THEN 'found' ELSE 'not_found' END AS status FROM tok LEFT JOIN br ON d = upper(sha1(value)))"""


@query(f"WITH {_BREACH} SELECT * FROM bl")
def breach_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return lookup(b.token_weights(spark, sf).select("value"), b.breach(spark, sf)).select("value", "breach_count", "status")


@query(f"WITH {_BREACH} SELECT value, CASE WHEN status = 'found' THEN 'CRÍTICO' ELSE CASE length(value) % 5 " + " ".join(f"WHEN {i} THEN '{r[0]}'" for i, r in enumerate(report.RISKS)) + " END END AS risk_label, CASE length(value) % 5 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS)) + " END AS score_label FROM bl")
def risk_labels(spark: SparkSession, sf: str) -> DataFrame:
    from .operators.decompose import score_label

    s = F.length("value") % 5
    return breach_lookup(spark, sf).select("value", report.risk(s, F.col("status") == "found")[0].alias("risk_label"), score_label(s).alias("score_label"))


@query()
def evaluation_reports(spark: SparkSession, sf: str) -> DataFrame:
    full = report.evaluate(b.strings(spark, sf).select("value"), b.lexicon(spark, sf), b.breach(spark, sf))
    return report.render(full).select("value", "score", "guesses", "status", "risk_label", "report")


@query()
def evaluation_json(spark: SparkSession, sf: str) -> DataFrame:
    return report.to_json(report.evaluate(b.strings(spark, sf).select("value"), b.lexicon(spark, sf), b.breach(spark, sf)))


# Tables, merging, progress.

@query(f"WITH {_TOK} SELECT length(value) AS length, 2 * CAST(sum(weight) AS BIGINT) AS count FROM tok GROUP BY 1")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    h = length_histogram(spark, sf)
    return merge_counts(h, h, ("length",))


@query(f"WITH {_LEN} SELECT * FROM lh")
def state_merge_law(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.table(spark, sf, "documents").select("doc_id", "text")
    part = lambda k: profile.length_histogram(tokens(docs.where(F.col("doc_id") % 2 == k)).withColumn("weight", F.lit(1).cast("long")))
    return merge_counts(part(0), part(1), ("length",))


_PROG = "pg AS (SELECT 'part-' || user_id || '.txt' AS filename, CASE user_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'pending' END AS status, count(*) AS lines_processed, count(*) FILTER (WHERE value > 5) AS lines_valid, min(ts) AS started_at, CASE WHEN user_id % 4 = 1 THEN max(ts) END AS finished_at FROM events GROUP BY user_id)"
_DS = "ds AS (SELECT row_number() OVER (ORDER BY name) AS id, name, CASE WHEN name < 'n' THEN 'leaked' ELSE 'user_submitted' END AS dataset_type FROM (SELECT DISTINCT event_type AS name FROM events))"


@query("SELECT DISTINCT 'part-' || user_id || '.txt' AS filename FROM events WHERE user_id % 4 <> 1")
def pending_files(spark: SparkSession, sf: str) -> DataFrame:
    p = b.progress(spark, sf)
    return monitor.pending(p.select("filename"), p)


@query(f"WITH {_PROG} SELECT CASE WHEN status IN ('running', 'completed', 'failed') THEN status ELSE 'other' END AS status, count(*) AS files FROM pg GROUP BY 1")
def progress_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.by_status(b.progress(spark, sf))


@query(f"WITH {_DS}, rn AS (SELECT id * 1000000 + user_id AS id, name AS dataset_name, 'completed' AS status, CASE WHEN user_id % 5 = 0 THEN NULL ELSE min(ts) END AS started_at, max(ts) AS finished_at, count(*) AS lines_valid FROM events JOIN ds ON name = event_type GROUP BY id, name, user_id) SELECT * FROM rn ORDER BY started_at DESC NULLS LAST, id LIMIT 5")
def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.recent_runs(b.runs(spark, sf), b.datasets(spark, sf))


_DUR = "CASE WHEN r < 60 THEN CAST(CAST(floor(r) AS BIGINT) AS STRING) || 's' WHEN r < 3600 THEN CAST(CAST(floor(r / 60) AS BIGINT) AS STRING) || 'm' || lpad(CAST(CAST(floor(r % 60) AS BIGINT) AS STRING), 2, '0') || 's' ELSE CAST(CAST(floor(r / 3600) AS BIGINT) AS STRING) || 'h' || lpad(CAST(CAST(floor(r % 3600 / 60) AS BIGINT) AS STRING), 2, '0') || 'm' END"


@query(f"WITH {_PROG}, sp AS (SELECT filename, lines_processed, lines_processed / (epoch_us(TIMESTAMP '2025-01-01') / 1e6 - epoch_us(started_at) / 1e6) AS speed FROM pg WHERE status = 'running') SELECT filename, round(speed, 9) AS speed, {_DUR} AS eta FROM (SELECT *, greatest(100000 - lines_processed, 0) / speed AS r FROM sp)")
def file_speed_eta(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.speed_eta(b.progress(spark, sf), "2025-01-01 00:00:00", 100_000).withColumn("speed", F.round("speed", 9))


@query(f"WITH {_PROG}, sp AS (SELECT lines_processed / (epoch_us(TIMESTAMP '2025-01-01') / 1e6 - epoch_us(started_at) / 1e6) AS speed FROM pg WHERE status = 'running') SELECT round(sum(speed), 6) AS total_speed FROM sp")
def total_speed(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.total_speed(monitor.speed_eta(b.progress(spark, sf), "2025-01-01 00:00:00", None)).select(F.round("total_speed", 6).alias("total_speed"))


@query(f"WITH {_PROG} SELECT * FROM pg ORDER BY status DESC, filename LIMIT 60")
def file_list(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.files(b.progress(spark, sf))


@query(f"WITH {_PROG} SELECT * FROM pg WHERE status = 'completed' ORDER BY finished_at DESC NULLS LAST, filename LIMIT 5")
def recently_completed(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.recently_completed(b.progress(spark, sf))


@query(f"WITH {_DS} SELECT name, count(*) AS total_lines, round(sum(length(props)) / count(*), 2) AS mean_length FROM ds JOIN events ON event_type = name WHERE dataset_type = 'leaked' GROUP BY name")
def mean_length_per_dataset(spark: SparkSession, sf: str) -> DataFrame:
    ds = b.datasets(spark, sf)
    lengths = b.table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("total_lines"), F.sum(F.length("props")).alias("sum_length"))
    return monitor.mean_lengths(ds, lengths.join(ds.select("name", "id"), "name").select(F.col("id").alias("dataset_id"), "total_lines", "sum_length"))


@query(f"WITH {_DS}, new AS (SELECT n_name AS name, 'leaked' AS dataset_type FROM nation WHERE n_name NOT IN (SELECT name FROM ds)) SELECT id, name, dataset_type FROM ds UNION ALL SELECT (SELECT max(id) FROM ds) + row_number() OVER (ORDER BY name), name, dataset_type FROM new")
def dataset_registry(spark: SparkSession, sf: str) -> DataFrame:
    return get_or_create(b.datasets(spark, sf), b.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("leaked").alias("dataset_type")))


# Decoding and streams.

#: Bytes in a piece of a page, so that most pieces begin or end inside a word and some inside a character.
PIECE = 150


@query()
def utf8_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages in consecutive pieces of bytes, cut in the middle of characters, each decoded; piece is the place from 0."""
    starts = lambda raw: F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(raw) / PIECE).cast("int") - 1, F.lit(0)))
    cut = lambda raw: F.transform(starts(raw), lambda i: F.substring(raw, i * PIECE + 1, F.lit(PIECE)))
    # The outer array binds the bytes once for all pieces.
    pieces = F.transform(F.array(F.col("html").cast("binary")), cut)[0]
    raw = b.table(spark, sf, "pages").select("page_id", F.posexplode_outer(pieces).alias("piece", "raw"))
    value, invalid = decode(F.col("raw").cast("string"))
    return raw.select("page_id", "piece", value.alias("value"), invalid.alias("had_invalid"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_sha256 FROM documents")
def nfc_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "documents").select("doc_id", F.sha2(nfc(F.col("text")), 256).alias("nfc_sha256"))


@query(f"WITH {_FEAT.replace('documents', 'conversations')} SELECT n AS length, m AS charset_mask, CAST(sum(weight) AS BIGINT) AS count, round(sum(weight * h * n), 4) AS sum_shannon FROM feat GROUP BY n, m")
def user_stats_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Words of conversations as a stream of events, counted as they come."""
    path = f"{sf}/conversations.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path if b.is_folder(spark, path) else f"{path}*")
    return drain(event_stats(tokens(stream)), f"user_stats_{uuid.uuid4().hex}", f"{b.shared_folder(spark)}/streams/{uuid.uuid4().hex}")
