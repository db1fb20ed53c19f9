"""Evaluation of strings: all measures of one value in a row, as text and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as f
from ..functions.attack import SCENARIOS, attack_times
from ..operators.breach import BreachSession, lookup
from ..operators.decompose import scored

#: Risk levels with their advice by score, and for values found in breaches.
RISKS = (
    ("CRÍTICO", "La contraseña es trivialmente adivinable. Sustitúyela ya."),
    ("ALTO", "Muy débil: caería en segundos contra cualquier ataque offline."),
    ("MEDIO", "Débil contra ataques con GPU. Mejora longitud o aleatoriedad."),
    ("BAJO", "Fortaleza razonable. Aún así, mejor un gestor de contraseñas."),
    ("MUY BAJO", "Fuerte. Apropiada para uso general."),
)
BREACHED = "La contraseña aparece en filtraciones públicas. Sustitúyela por una contraseña única generada por un gestor."
#: How reports name the scenarios.
SCENARIO_LABELS = {
    "online_throttled": "Online con rate limit   (10/s)",
    "cpu_sha1": "CPU doméstica SHA-1     (10⁷/s)",
    "gpu_consumer_sha1": "GPU consumer SHA-1      (10¹⁰/s)",
    "gpu_rig_sha1": "Rig 8×GPU SHA-1         (10¹¹/s)",
    "argon2id_modern": "Contra Argon2id moderno (10/s)",
}
LINE = "─" * 61
MOST = 128


def risk(score: Column, found: Column) -> tuple[Column, Column]:
    """Level and advice; a breach comes before the score."""
    at = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in RISKS]), score + 1)
    return F.when(found, RISKS[0][0]).otherwise(at(0)), F.when(found, BREACHED).otherwise(at(1))


def evaluate(values: DataFrame, lexicon: DataFrame, breach: DataFrame | BreachSession | None = None) -> DataFrame:
    """values (value) with length, composition, entropies, guesses, segments, score, attack times, breach status and risk. breach: a table of digests, or a session that fetches their ranges."""
    distinct = values.select("value").distinct()
    base = scored(distinct, lexicon)
    if breach is None:
        base = base.withColumn("breach_count", F.lit(0).cast("long")).withColumn("status", F.lit("skipped"))
    elif isinstance(breach, BreachSession):
        base = base.join(breach.lookup(distinct), "value")
    else:
        base = lookup(base, breach).drop("prefix", "suffix")
    v, mask = F.col("value"), f.charset_mask(F.col("value"))
    out = base.withColumn("length", F.length(v)).withColumn("charset_mask", mask)
    out = out.withColumn("charset_size", f.charset_size(F.col("charset_mask"))).withColumn("composition", f.composition(F.col("charset_mask")))
    out = out.withColumn("charset_bits", f.charset_bits(F.col("length"), F.col("charset_size"))).withColumn("shannon_per_char", f.shannon_per_char(v))
    out = out.withColumn("shannon_total", F.col("shannon_per_char") * F.col("length")).withColumn("attack_times", attack_times(F.col("guesses")))
    level, advice = risk(F.col("score"), F.col("status") == "found")
    out = out.withColumn("risk_label", level).withColumn("risk_explanation", advice)
    return values.join(out, "value", "left") if values.columns != ["value"] else out


def _shown(x: Column) -> Column:
    """How a report names a match: by its word list, its source, or the word that it stands for."""
    return F.when(x["type"] == "dictionary", x["name"]).when(x["type"] == "spanish", F.concat(F.lit("es:"), x["name"])).when(x["type"] == "leet", F.concat(F.lit("leet→"), x["word"])).otherwise(x["type"])


def decomposition_text(segments: Column) -> Column:
    """[name: "token"] joined by +; brute-forced characters are masked."""
    one = lambda x: F.when(x["type"] == "bruteforce", F.concat(F.lit("[bruteforce: "), F.repeat(F.lit("●"), F.length(x["token"])), F.lit(" ("), F.length(x["token"]).cast("string"), F.lit(" chars)]"))).otherwise(F.concat(F.lit("["), _shown(x), F.lit(': "'), x["token"], F.lit('"]')))
    return F.array_join(F.transform(segments, one), " + ")


def render(evaluated: DataFrame) -> DataFrame:
    """Adds report: the evaluation as text. The literals are fixed values: the lines of the report."""
    c, num = F.col, lambda col, d: F.format_string(f"%.{d}f", col)
    breach = F.when(c("status") == "found", F.concat(F.lit("Sí encontrada ("), F.format_number("breach_count", 0), F.lit(" apariciones)"))).when(c("status") == "not_found", "No encontrada").when(c("status") == "error", "error de red (omitida)").otherwise("omitida (no autorizada en esta sesión)")
    lines = [
        F.lit(LINE), F.concat(F.lit("Longitud: "), c("length").cast("string"), F.lit(" caracteres")),
        F.concat(F.lit("Composición: "), F.when(F.size("composition") > 0, F.array_join("composition", " + ")).otherwise("—")), F.lit(""), F.lit("Métricas descriptivas:"),
        F.concat(F.lit("  Entropía Shannon:       "), num(c("shannon_per_char"), 2), F.lit(" bits/char ("), num(c("shannon_total"), 1), F.lit(" bits totales)")),
        F.concat(F.lit("  Entropía charset:       log2("), c("charset_size").cast("string"), F.lit("^"), c("length").cast("string"), F.lit(") = "), num(c("charset_bits"), 1), F.lit(" bits  (límite superior ingenuo)")), F.lit(""),
        F.lit("Fortaleza (modelo propio, Wheeler 2016 adaptado):"), F.concat(F.lit("  Descomposición:         "), decomposition_text(c("segments"))),
        F.array_join(F.transform("segments", lambda x: F.when(x["type"] == "bruteforce", F.concat(F.lit("    Coste bruteforce ("), F.length(x["token"]).cast("string"), F.lit(" chars): "), x["guesses"])).otherwise(F.concat(F.lit("    Coste "), F.rpad(x["type"], 10, " "), F.lit(' "'), x["token"], F.lit('": '), x["guesses"]))), "\n"),
        F.concat(F.lit("  Intentos estimados:     "), F.regexp_replace("guesses", r"(?<=\d)(?=(\d{3})+$)", ","), F.lit(" = "), num(c("guess_bits"), 1), F.lit(" bits de guessing entropy")),
        F.concat(F.lit("  Score:                  "), c("score").cast("string"), F.lit("/4 ("), c("score_label"), F.lit(")")), F.lit(""), F.concat(F.lit("Consulta HIBP: "), breach), F.lit(""),
        F.lit("Estimación de tiempo de cracking (caso medio, T = G / 2v):"),
        *[F.concat(F.lit(f"  {SCENARIO_LABELS[k]:38}: "), F.element_at("attack_times", k)) for k in SCENARIOS],
        F.lit(""), F.concat(F.lit("RIESGO: "), c("risk_label")), c("risk_explanation"), F.lit(LINE),
    ]
    return evaluated.withColumn("report", F.concat_ws("\n", *lines))


def to_json(evaluated: DataFrame, show_tokens: bool = False) -> DataFrame:
    """value_sha256 and json of values of 1 to MOST characters; the value itself isn't put out, and tokens are left out unless asked for."""
    kept = evaluated.where(F.length("value").between(1, MOST))
    shown = F.transform("segments", lambda x: F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["guesses"].alias("guesses"), F.when(F.lit(show_tokens), x["token"]).alias("token"), F.when(F.lit(show_tokens) | (x["type"] != "leet"), x["name"]).alias("name"), F.when(F.lit(show_tokens), x["word"]).alias("word")))
    fields = ["length", "composition", "charset_size", "charset_bits", "shannon_per_char", "shannon_total", "guesses", "guess_bits", "score", "score_label", "attack_times", F.col("status").alias("breach_status"), "breach_count", "risk_label", "risk_explanation"]
    return kept.select(F.sha2("value", 256).alias("value_sha256"), F.to_json(F.struct(*fields, shown.alias("segments"))).alias("json"))
