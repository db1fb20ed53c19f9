"""Text statistics and robust multivariate outliers per language and source, in DataFrame functions only.

Every text gets base counts. Its statistic vector holds the logarithms of mean word length, of the share of
characters that are no letters, of the share of different words and of the number of words, in fixed-point
integers. For each (language, source) with enough rows, the minimum-covariance-determinant estimate is sought:
from several starts (medians and quartile spreads, and small random subsets), concentration steps take the
`share` of rows nearest by Mahalanobis distance and recompute mean and covariance from them; after a few steps
the start with the least determinant goes on until its determinant stops falling. Sums are over integers, and
nearest rows are found through a histogram of distance bins, so results don't depend on partitions and no
group's rows are ever gathered in one task. Groups too small to estimate pool with the rest of their language,
then with all others. A covariance gets RIDGE of its mean variance on its diagonal, nothing else.

Defined results: null or empty texts have zero counts and fail the base rule; texts without words have
no vector and aren't used in estimates; null languages and sources are values of their own; repeated
rows count as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, text_or_empty, without

SPACE = r"[ \t\n\x0B\f\r]"
SYMBOLS = "#*$%&|<>"
#: Fixed-point units of a vector's coordinates.
UNIT = 1000
#: Share of the mean variance that is added to each variance, so that a constant coordinate doesn't make a matrix singular.
RIDGE = 1e-6
P = 4
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
SALTS = 16
#: Chi-square with 4 degrees of freedom (fixed values): the median, and the point that 4 in 10 ** 8 exceed.
CHI2_HALF, CHI2_CUT = 3.3567, 40.0
#: Rows in a random start.
SUBSET = 5 * (P + 1)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_letters and n_distinct (long)."""
    t = text_or_empty(f"`{text}`")
    kept = without(df, *OUT, "n_letters", "n_distinct")
    names = [F.col(f"`{c}`") for c in kept.columns]
    one = kept.select(F.struct(*names).alias("r"), F.array_remove(F.split(t, SPACE + "+", -1), "").alias("w"), F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias("l"),
                      (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"), F.length(F.translate(t, " \t\n\x0b\f\r", "")).alias("word_chars"), F.length(F.regexp_replace(t, r"\P{L}+", "")).alias("n_letters"))
    two = one.select("r", "n_symbols", "word_chars", "n_letters", F.size("w").alias("n"), (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    m = F.greatest(F.col("n") - 2, F.lit(0))
    pairs = F.zip_with(F.slice("h", F.lit(1), m), F.slice("h", F.lit(2), m), lambda a, b: F.xxhash64(a, b))
    three = two.select("r", "n", "n_letters", F.size(F.array_distinct("h")).alias("n_distinct"), "n_symbols", "word_chars", "n_dup_lines", F.when(F.col("n") >= 3, F.zip_with(pairs, F.slice("h", F.lit(3), m), lambda a, b: F.xxhash64(a, b))).alias("g"))
    ordered = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    four = three.withColumn("o", F.when(F.size(F.array_distinct("g")) < F.size("g"), ordered))
    pos = F.flatten(F.filter(F.zip_with(F.slice("o", F.lit(1), F.size("o") - 1), F.slice("o", F.lit(2), F.size("o") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))
    five = four.withColumn("p", F.when(F.col("o").isNotNull(), F.sort_array(F.array_distinct(pos))))
    steps = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.least(F.lit(3), b - a))
    covered = F.aggregate(steps, F.lit(3), lambda acc, x: acc + x)
    return five.select(
        "r.*", F.col("n").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"), F.coalesce(F.when(F.size("p") > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"), F.col("n_letters").cast("long").alias("n_letters"), F.col("n_distinct").cast("long").alias("n_distinct"),
    )


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    unit = lambda x: F.round(x * UNIT).cast("long")
    return [
        unit(F.log(chars / words)),
        unit(F.log((chars - F.least("n_letters", chars) + 0.5) / (chars + 1))),
        unit(F.log(F.greatest(F.col("n_distinct"), F.lit(1)) / words)),
        unit(F.log(words)),
    ]


def _salted(df: DataFrame, model: DataFrame, on: str = "grp") -> DataFrame:
    """Join of rows with one model row per group; each model row is repeated over SALTS, so that a hot group is split."""
    many = model.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return df.join(many, [on, "salt"])


def _squared(x: list[Column]) -> Column:
    """Mahalanobis distance squared from the mean in columns m_i and the inverse Cholesky factor in columns w_i_j."""
    total = None
    for i in range(P):
        y = sum(((x[j] - F.col(f"m{j}")) * F.col(f"w{i}{j}") for j in range(1, i + 1)), (x[0] - F.col("m0")) * F.col(f"w{i}0"))
        total = F.pow(y, 2) if total is None else total + F.pow(y, 2)
    return total


def _inverse(df: DataFrame) -> DataFrame:
    """Adds w_i_j, the inverse of the lower triangle l_i_j, row by row."""
    for i in range(P):
        new = {f"w{i}{i}": 1 / F.col(f"l{i}{i}")}
        for j in range(i):
            new[f"w{i}{j}"] = -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j + 1, i)), F.col(f"l{i}{j}") * F.col(f"w{j}{j}")) / F.col(f"l{i}{i}")
        df = df.withColumns(new)
    return df


def _cholesky(df: DataFrame) -> DataFrame:
    """Adds l_i_j of the matrix in columns c_i_j (i >= j), column by column."""
    for j in range(P):
        v = F.col(f"c{j}{j}")
        for k in range(j):
            v = v - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(v, F.lit(1e-9))))
        new = {}
        for i in range(j + 1, P):
            v = F.col(f"c{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            new[f"l{i}{j}"] = v / F.col(f"l{j}{j}")
        if new:
            df = df.withColumns(new)
    return df


KEYS = ["grp", "st"]
_X = [f"x{i}" for i in range(P)]
_MODEL = [*KEYS, *[f"m{i}" for i in range(P)], *[f"w{i}{j}" for i in range(P) for j in range(i + 1)]]


def _model(rows: DataFrame, weight: Column) -> DataFrame:
    """Mean, Cholesky factor and log determinant per group and start of integer vectors. Rows of one group and `edge` weigh the same; within them sums are exact, so their order doesn't matter."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in pairs]]
    parts = rows.groupBy(*KEYS, "edge", weight.alias("part")).agg(*aggs)
    # Two parts for each group at most; in order, so that sums of doubles don't depend on partitions.
    put = lambda c: F.coalesce(F.max(F.when(~F.col("edge"), F.col(c))), F.lit(0)).cast("double") + F.coalesce(F.max(F.when(F.col("edge"), F.col("part") * F.col(c))), F.lit(0.0))
    sums = parts.groupBy(*KEYS).agg(*[put(c).alias(c) for c in ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in pairs]]])
    cov = [(F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * (F.col(f"s{j}") / F.col("n"))).alias(f"c{i}{j}") for i, j in pairs]
    plain = sums.select(*KEYS, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)], *cov)
    trace = sum((F.col(f"c{i}{i}") for i in range(1, P)), F.col("c00"))
    ridged = plain.withColumn("ridge", trace * (RIDGE / P) + 1e-6).withColumns({f"c{i}{i}": F.col(f"c{i}{i}") + F.col("ridge") for i in range(P)})
    return _inverse(_cholesky(ridged)).select(*_MODEL, sum((2 * F.log(f"l{i}{i}") for i in range(1, P)), 2 * F.log("l00")).alias("det"))


def _starts(points: DataFrame, n_starts: int) -> DataFrame:
    """Models to start from: start 0 has medians and quartile spreads, from counts of values in bins of 20 units; the others are estimates from about SUBSET rows each, picked by hash."""
    long = points.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.expr(f"x{i} div 20").alias("v")) for i in range(P)])).alias("e")).groupBy("grp", "e.f", "e.v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("grp", "f")
    cum = long.select("grp", "f", "v", F.sum("c").over(w.orderBy("v")).alias("upto"), F.sum("c").over(w).alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("v") * 20.0))
    q = cum.groupBy("grp", "f").agg(at(0.25).alias("a"), at(0.5).alias("m"), at(0.75).alias("z"))
    wide = q.groupBy("grp").agg(*[F.max(F.when(F.col("f") == i, F.col("m"))).alias(f"m{i}") for i in range(P)], *[F.max(F.when(F.col("f") == i, 1 / F.greatest((F.col("z") - F.col("a")) / 1.349, F.lit(1.0)))).alias(f"w{i}{i}") for i in range(P)])
    first = wide.withColumn("st", F.lit(0)).withColumn("det", F.lit(math.inf))
    first = first.select(*[F.col(c) if c in first.columns else F.lit(0.0).alias(c) for c in [*_MODEL, "det"]])
    sizes = points.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / SUBSET).alias("every"))
    tried = _salted(points, sizes).withColumn("st", F.explode(F.array(*[F.lit(i) for i in range(1, n_starts)])))
    picked = tried.where(F.pmod(F.xxhash64("st", *_X), F.col("every")) == 0)
    return first.unionByName(_model(picked.withColumn("edge", F.lit(False)), F.lit(1.0)))


def _bin(d2: Column) -> Column:
    """Bins of squared distance, each half a per cent wide; a bounded number of them."""
    return F.floor(F.log(d2 + 1e-4) * 200).cast("int")


def _binned(points: DataFrame, model: DataFrame) -> DataFrame:
    return _salted(points, model).withColumn("bin", _bin(_squared([F.col(x) for x in _X])))


def _quantile_bins(points: DataFrame, model: DataFrame, q: float) -> DataFrame:
    """For each model the bin in which the share q of its group's rows is reached, and the share of that bin's rows that reach it."""
    hist = _binned(points, model).groupBy(*KEYS, "bin").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*KEYS)
    cum = hist.select(*KEYS, "bin", "c", F.sum("c").over(w.orderBy("bin")).alias("upto"), F.ceil(q * F.sum("c").over(w)).alias("h"))
    hit = cum.where("upto >= h and upto - c < h")
    return hit.select(*KEYS, F.col("bin").alias("cut"), ((F.col("h") - F.col("upto") + F.col("c")) / F.col("c")).alias("part"))


def _step(points: DataFrame, model: DataFrame, share: float) -> DataFrame:
    """A concentration step of every model."""
    cuts = model.join(_quantile_bins(points, model, share), KEYS)
    near = _binned(points, cuts).where("bin <= cut").withColumn("edge", F.col("bin") == F.col("cut"))
    return _model(near, F.when(F.col("edge"), F.col("part")).otherwise(1.0))


def least_determinant(points: DataFrame, store: Stored, share: float = 0.75, n_starts: int = 4, first_steps: int = 2, gain: float = 1e-4) -> DataFrame:
    """The model of least determinant for each group of points (grp, salt, x0 ...)."""
    model = store.write(_starts(points, n_starts))
    for _ in range(first_steps):
        old, model = model, store.write(_step(points, model, share))
        store.drop(old)
    best = Window.partitionBy("grp").orderBy("det", "st")
    old, model = model, store.write(model.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r"))
    store.drop(old)
    # A group keeps a step's model only if its determinant fell, and no determinant falls for ever.
    while True:
        new = _step(points, model, share)
        both = new.select("grp", F.struct("det", *[c for c in _MODEL if c != "grp"]).alias("new")).join(model.select("grp", F.struct("det", *[c for c in _MODEL if c != "grp"]).alias("old")), "grp")
        picked = both.select("grp", F.when(F.col("new.det") < F.col("old.det"), F.col("new")).otherwise(F.col("old")).alias("m"), (F.col("new.det") < F.col("old.det") - gain).alias("fell"))
        old, model = model, store.write(picked.select("grp", "m.*", "fell"))
        store.drop(old)
        if not model.where("fell").limit(1).count():
            return model.drop("fell")


def _grouped(df: DataFrame, least: int) -> DataFrame:
    """Adds grp: language and source, or the language's small sources together, or all small rest together."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    counts = df.groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("c"))
    rest = F.when(F.col("c") < least, F.col("c")).otherwise(0)
    pooled = counts.withColumn("pool", F.sum(rest).over(Window.partitionBy("g_lang")))
    named = pooled.select("g_lang", "g_source", F.when(F.col("c") >= least, F.concat(name("g_lang"), F.lit("/"), name("g_source"))).when(F.col("pool") >= least, F.concat(name("g_lang"), F.lit("/*"))).otherwise(F.lit("*")).alias("grp"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    on = df["g_lang"].eqNullSafe(named["g_lang"]) & df["g_source"].eqNullSafe(named["g_source"]) & (df["salt"] == named["salt"])
    return df.join(named, on).drop(named["g_lang"]).drop(named["g_source"]).drop(named["salt"])


def robust_outliers(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id", share: float = 0.75, n_starts: int = 4, least: int = 100) -> DataFrame:
    """key, base counts, base_failed, distance (robust, null without words) and kept for every row of df."""
    spark = df.sparkSession
    store = Stored(spark)
    narrow = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("g_lang"), F.col(f"`{source}`").alias("g_source"))
    counted = statistics(narrow).drop("text")
    x = _vector()
    base = store.write(counted.select("*", *[x[i].alias(f"x{i}") for i in range(P)], F.pmod(F.xxhash64("key", "n_words", "word_chars"), F.lit(SALTS)).cast("int").alias("salt"),
                                      ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed")).drop("n_letters", "n_distinct"))
    rows = store.write(_grouped(base, least))
    store.drop(base)
    used = rows.where("n_words > 0").select("grp", "salt", *_X)
    model = least_determinant(used, store, share, n_starts)
    # Covariance of the nearest rows is too small; the median distance tells by how much.
    half = _quantile_bins(used, model, 0.5).select(*KEYS, (F.exp((F.col("cut") + 0.5) / 200.0) / CHI2_HALF).alias("scale"))
    judged = store.write(model.join(half, KEYS).drop("st", "det"))
    many = judged.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    d2 = _squared([F.col(c) for c in _X]) / F.col("scale")
    scored = rows.join(many, ["grp", "salt"], "left").withColumn("distance", F.when(F.col("n_words") > 0, F.sqrt(d2)))
    ok = F.coalesce(F.col("distance") <= math.sqrt(CHI2_CUT), F.lit(True))
    return scored.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & ok).alias("kept"))
