"""Hostile content: found, scored and blanked, in column expressions.

Each family of patterns is tried as one alternation first; only texts that it
matches are tested pattern by pattern. A threat is (type, confidence); the
risk of a text is the weighed mean of its threats, raised by three tenths
where there are more than two types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import text, threats

# Languages in which Cyrillic letters among others are a disguise.
_LATIN_LIKE = ["en", "latin", "zh", "ja", "ko", "mixed"]


def _any(patterns: list[str]) -> str:
    """One alternation of all patterns; a flag stays with its pattern."""
    return "|".join(f"(?iu:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns)


def matches(body: Column, patterns: list[str]) -> Column:
    """How many patterns of a family a text matches."""
    each = F.filter(F.array(*[F.lit(_any([p])) for p in patterns]), lambda p: F.rlike(body, p))
    return F.when(body.rlike(_any(patterns)), F.size(each)).otherwise(0)


def injections(body: Column, language: Column) -> Column:
    """Matched injection patterns: those of any text, and those of its
    language; mixed texts are tested for the Chinese ones."""
    out = matches(body, threats.INJECTION)
    for code, patterns in threats.INJECTION_BY_LANGUAGE.items():
        told = (language == code) | (language == "mixed") if code == "zh" else language == code
        out = out + F.when(told, matches(body, patterns)).otherwise(0)
    return out


def intent_hits(body: Column) -> Column:
    """How many distinct words of each intent a text holds, as a struct."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    sizes = lambda w: F.struct(*[F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in found]))).alias(name) for name, found in threats.INTENT_WORDS.items()])
    # The words stand in a list of one, so that a text is searched once.
    return F.get(F.transform(F.array(words), sizes), F.lit(0))


def _unpacked(df: DataFrame) -> DataFrame:
    """``_plain``: the text without disguise, and the layers taken off."""
    zeros = lambda chars: F.lit(chars)
    alike = F.col("_lang").isin(_LATIN_LIKE) & F.col("_raw").rlike(f"[{threats.LOOKALIKES[0]}]")
    df = df.withColumn("_alike", alike).withColumn("_plain", F.when(F.col("_alike"), F.translate("_raw", *threats.LOOKALIKES)).otherwise(F.col("_raw")))
    df = df.withColumn("_hidden", F.col("_plain").rlike(f"[{threats.INVISIBLE}]")).withColumn("_plain", F.translate("_plain", threats.INVISIBLE, ""))
    df = df.withColumn("_turned", F.col("_plain").rlike(f"[{threats.TURNING}]")).withColumn("_plain", F.translate("_plain", threats.TURNING, ""))
    packed = F.regexp_extract_all("_plain", F.lit(r"[A-Za-z0-9+/]{24,}={0,2}"), F.lit(0))
    opened = F.transform(packed, lambda p: F.lower(F.try_to_binary(p, zeros("base64")).cast("string")))
    told = lambda p: (F.length(p) >= 10) & ~p.contains("�") & F.exists(F.array(*[F.lit(w) for w in threats.SUSPICIOUS]), lambda w: p.contains(w))
    df = df.withColumn("_packed", F.size(F.filter(opened, lambda p: F.coalesce(told(p), F.lit(False)))))
    decoded = F.when(F.col("_plain").contains("%"), F.try_url_decode(F.replace("_plain", F.lit("+"), F.lit("%2B"))))
    df = df.withColumn("_decoded", decoded).withColumn("_escaped", F.coalesce(F.col("_decoded") != F.col("_plain"), F.lit(False)))
    df = df.withColumn("_plain", F.when(F.col("_escaped"), F.col("_decoded")).otherwise(F.col("_plain")))
    return df.withColumn("layers", F.col("_alike").cast("int") + F.col("_hidden").cast("int") + F.col("_turned").cast("int") + F.col("_packed") + F.col("_escaped").cast("int"))


def scrub(rows: DataFrame, column: str, most: int = 3000) -> DataFrame:
    """Add ``content_lang, layers, n_threats, threat_types, risk_e3, clean,
    redactions`` and ``scrubbed``, the text without what was found.

    Disguise is taken off first: look-alike letters, invisible and turning
    characters, percent escapes (a text with a broken escape keeps its own);
    base64 that opens to an instruction counts as a layer too. Texts of a risk
    above 0.8 are cut to ``most`` characters. Null and empty texts are clean.
    Letters are not decomposed beyond that. One projection a step, no Python.
    """
    kept = [c for c in rows.columns if c not in ("content_lang", "layers", "n_threats", "threat_types", "risk_e3", "clean", "redactions", "scrubbed")]
    df = rows.select(*kept, F.coalesce(F.col(column), F.lit("")).alias("_raw")).withColumn("_lang", text.detect_language(F.col("_raw")))
    df = _unpacked(df)
    plain = F.col("_plain")
    df = df.withColumns({"_inj": injections(plain, F.col("_lang")), "_exf": matches(plain, threats.EXFILTRATION), "_imp": matches(plain, threats.IMPERSONATION), "_xss": matches(plain, threats.SCRIPT)})
    df = df.withColumn("_w", intent_hits(plain))
    strong = sum(((F.col(f"_w.{k}") >= 2).cast("int") for k in threats.INTENT_WORDS), F.lit(0))
    # Counts of threats: (type, confidence in hundredths, how many).
    found = [
        ("payload_smuggling", 70, F.col("_alike").cast("int")), ("payload_smuggling", 80, F.col("_hidden").cast("int") + F.col("_turned").cast("int") + F.col("_packed")), ("payload_smuggling", 50, F.col("_escaped").cast("int")),
        ("recursive_injection", 100, (F.col("layers") > 2).cast("int")), ("prompt_injection", 90, F.col("_inj")), ("data_exfiltration", 85, F.col("_exf")), ("impersonation", 80, F.col("_imp")), ("xss_injection", 90, F.col("_xss")),
        ("instruction_override", 85, ((F.col("_w.authority") >= 2) & (F.col("_w.override") >= 2)).cast("int")), ("data_exfiltration", 90, ((F.col("_w.extraction") >= 2) & (F.col("_w.secrets") >= 1)).cast("int")),
        ("prompt_injection", 70, (strong >= 3).cast("int")),
    ]
    df = df.withColumn("n_threats", sum((n for _, _, n in found), F.lit(0)))
    types = {t: F.lit(False) for t, _, _ in found}
    for t, _, n in found:
        types[t] = types[t] | (n > 0)
    df = df.withColumn("threat_types", F.array_sort(F.array_compact(F.array(*[F.when(hit, F.lit(t)) for t, hit in types.items()]))))
    weighed = sum((n * (c * threats.WEIGHT[t]) for t, c, n in found), F.lit(0))
    mean = weighed / (F.greatest("n_threats", F.lit(1)) * 10.0)
    raised = F.when(F.size("threat_types") > 2, F.least(mean * 1.3, F.lit(1000.0))).otherwise(mean)
    df = df.withColumn("risk_e3", F.round(raised).cast("int")).withColumn("clean", F.col("risk_e3") < 500)
    blank = [p for p in [*threats.INJECTION, *threats.EXFILTRATION, *threats.IMPERSONATION] if p not in threats.NOT_REDACTED]
    own = {code: patterns for code, patterns in threats.INJECTION_BY_LANGUAGE.items()}
    out = F.regexp_replace(F.regexp_replace(plain, _any(blank), "[REDACTED]"), _any(threats.SCRIPT_REDACTED), "[REDACTED]")
    for code, patterns in own.items():
        told = F.col("_lang").isin("zh", "mixed") if code == "zh" else F.col("_lang") == code
        out = F.when(told, F.regexp_replace(out, _any(patterns), "[REDACTED]")).otherwise(out)
    df = df.withColumn("_out", F.when(F.col("n_threats") > 0, out).otherwise(plain))
    marks = lambda c: (F.length(c) - F.length(F.replace(c, F.lit("[REDACTED]"), F.lit("")))) / 10
    df = df.withColumn("redactions", F.when(F.col("n_threats") > 0, marks(F.col("_out")) - marks(plain)).otherwise(0).cast("int"))
    df = df.withColumn("scrubbed", F.when(F.col("risk_e3") > 800, F.substring("_out", 1, most)).otherwise(F.col("_out")))
    return df.select(*kept, F.col("_lang").alias("content_lang"), "layers", "n_threats", "threat_types", "risk_e3", "clean", "redactions", "scrubbed")
