"""Publication times in many notations, read as one UTC instant.

Every value is matched against a set of notations. Some of them have several
readings: numbers parted by slashes or dots (which is the day, which the
month), and zone letters that several zones share (CST, IST, BST). These are
settled by expectation-maximisation over the mixture of readings of their
engine: each value contributes the likelihood of every valid reading, what the
engine declares enters as a bounded number of observations, the posterior
picks the reading, and a value whose posterior stays under ``min_posterior``
is marked ``ambiguous`` instead of being guessed silently. All-digit values
have one reading, which their length tells.

All parsing is built-in column expressions. Only the mixture weights are
computed in Python, per engine, from a table of at most a dozen rows each.
"""

from __future__ import annotations

import zoneinfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.runtime import join_small

# Offsets in minutes of zone abbreviations in common use.
ZONE_ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0,
    "CET": 60, "WEST": 60,
    "CEST": 120, "EET": 120, "SAST": 120,
    "EEST": 180, "MSK": 180,
    "HKT": 480, "SGT": 480, "AWST": 480,
    "JST": 540, "KST": 540,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "ART": -180, "BRT": -180, "ADT": -180,
    "AST": -240, "EDT": -240,
    "EST": -300, "CDT": -300,
    "MDT": -360,
    "MST": -420, "PDT": -420,
    "PST": -480,
}
# Offsets that zone letters share, and the zones of each.
SHARED_LETTERS = {
    "CST": {-360: ["America/"], 480: ["Asia/Shanghai", "Asia/Taipei", "Asia/Macau", "Asia/Chongqing", "PRC"]},
    "IST": {330: ["Asia/Kolkata", "Asia/Calcutta"], 120: ["Asia/Jerusalem", "Asia/Tel_Aviv", "Israel"], 60: ["Europe/Dublin", "Eire"]},
    "BST": {60: ["Europe/London", "Europe/Belfast", "GB"], 360: ["Asia/Dhaka"]},
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
# Unit words of ages by seconds.
AGE_UNITS = {
    1: "s sec secs second seconds sekunde sekunden seconde secondes segundo segundos secondo secondi seconden секунду секунды секунд 秒 秒钟 초",
    60: "m min mins minute minutes minuten minuto minutos minuti minuut минуту минуты минут 分 分钟 分鐘 분",
    3600: "h hr hrs hour hours stunde stunden heure heures hora horas ora ore uur uren час часа часов 小时 小時 時間 시간",
    86400: "d day days tag tage tagen jour jours día días dia dias giorno giorni dag dagen день дня дней 天 日 일",
    604800: "w week weeks woche wochen semaine semaines semana semanas settimana settimane weken неделю недели недель 周 週間 週 주",
}
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(Z|[A-Z]{3,4}|[+-]\d{2}:?\d{2}|[+-]\d{2})?(?:\[([A-Za-z_/+\-0-9]+)\])?"
# Notation: (pattern, layout of y|mo|d|h|mi|s|fraction|am-pm|zone|zone name).
NOTATIONS = {
    "iso": (rf"^(\d{{4}})-(\d{{1,2}})(?:-(\d{{1,2}})(?:[T ]{_TIME}\s?{_ZONE})?)?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    "cjk": (rf"^(\d{{4}})\s?年\s?(\d{{1,2}})\s?月(?:\s?(\d{{1,2}})\s?日)?(?:\s?{_TIME})?$", "$1|$2|$3|$4|$5|$6|$7|||"),
    "day_month": (rf"^(?:[A-Za-z]{{3,9}},?\s)?(\d{{1,2}})\s([A-Za-z]{{3,9}})\.?,?\s(\d{{4}})(?:,?\s{_TIME}\s?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8|$9"),
    "month_day": (rf"^([A-Za-z]{{3,9}})\.?\s(\d{{1,2}}),?\s(\d{{4}})(?:,?\s{_TIME}\s?(?:([AaPp])\.?[Mm]\.?)?\s?{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    "month": (r"^([A-Za-z]{3,9})\.?,?\s(\d{4})$", "$2|$1||||||||"),
    "digits": (r"^(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2})?)?(\d{3})?$", "$1|$2|$3|$4|$5|$6|$7|||"),
    "year": (r"^(\d{4})$", "$1|||||||||"),
}
# Notations whose numbers can stand in several orders, with their layouts.
ORDERED = {
    "slash": (rf"^(\d{{1,4}})/(\d{{1,2}})/(\d{{1,4}})(?:,?[\sT]{_TIME}\s?(?:([AaPp])\.?[Mm]\.?)?)?$", {"dmy": "$3|$2|$1|$4|$5|$6|$7|$8||", "mdy": "$3|$1|$2|$4|$5|$6|$7|$8||", "ymd": "$1|$2|$3|$4|$5|$6|$7|$8||"}),
    "dots": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s?{_TIME})?(?:\s?Uhr)?$", {"dmy": "$3|$2|$1|$4|$5|$6|$7|||", "mdy": "$3|$1|$2|$4|$5|$6|$7|||"}),
}
_LETTERS = r"\b(CST|IST|BST)\b"
_AGE = r"^(?:vor|il y a|hace|há|fa|約)?\s?(\d{1,6})\s?(\p{L}+?)\.?\s?(?:ago|fa|geleden|назад|前|전|atrás)?$"
_AGE_MARK = r"(?i)(^(vor|il y a|hace|há)\s)|(\s(ago|fa|geleden|назад|atrás)$)|(前$)|(전$)"


def _month_number(text: Column) -> Column:
    short = F.lower(F.substring(text, 1, 3))
    number = F.coalesce(*[F.when(short == m, F.lit(i + 1)) for i, m in enumerate(MONTHS)])
    full = F.lower(text).isin([m for n in "january february march april may june july august september october november december".split() for m in {n, n[:3], n[:4]}])
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int")).when(full, number)


def _instant(df: DataFrame, layout: str, default_tz: str, fetched: str, late: float, out: str) -> DataFrame:
    """Add ``out``: microseconds since the epoch of a ``y|mo|d|...`` layout,
    and ``_zones``, the weighed offsets of shared zone letters (by ``_w``).

    Built in a few projections, so that no expression is expanded twice.
    """
    part = F.split(F.col(layout), r"\|")
    names = ["_y", "_mo", "_d", "_h", "_mi", "_s", "_fr", "_ap", "_z", "_zn"]
    df = df.withColumn("_part", part).withColumns({n: F.get(F.col("_part"), F.lit(i)) for i, n in enumerate(names)})
    number = lambda c, default: F.coalesce(F.col(c).try_cast("int"), F.lit(default))
    year = F.col("_y").try_cast("int")
    hour = number("_h", 0)
    hour = F.when(F.coalesce(F.col("_ap"), F.lit("")) == "", hour).when(~hour.between(1, 12), None).when(F.lower("_ap") == "p", hour % 12 + 12).otherwise(hour % 12)
    wall = F.call_function(
        "try_make_timestamp", F.when(F.length("_y") <= 2, year + 2000).otherwise(year), F.when(F.col("_mo") == "", F.lit(1)).otherwise(_month_number(F.col("_mo"))),
        number("_d", 1), hour, number("_mi", 0), F.when(number("_s", 0) < 60, number("_s", 0)).cast("decimal(16,6)"), F.lit("UTC"),
    )
    sign = F.when(F.col("_z").startswith("-"), -1).otherwise(1)
    digits = F.rpad(F.regexp_replace("_z", "[^0-9]", ""), 4, "0")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    numeric = F.when((hours * 60 + minutes <= 14 * 60) & (minutes < 60), sign * (hours * 60 + minutes))
    letters = F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONE_ABBREVIATIONS.items() for x in kv]), F.col("_z"))
    offset = F.when(F.col("_z").rlike(r"^[+-]"), numeric).when(F.col("_z") != "", letters)
    fraction = F.coalesce(F.rpad(F.substring(F.when(F.col("_fr") != "", F.col("_fr")), 1, 6), 6, "0").try_cast("long"), F.lit(0))
    named = F.when(F.col("_zn").isin(sorted(zoneinfo.available_timezones())), F.col("_zn"))
    df = df.withColumns({"_wall": wall, "_off": offset, "_frac": fraction, "_named": F.coalesce(named, F.col(default_tz))})
    shared = F.coalesce(*[F.when(F.col("_z") == z, F.array(*[_weighed(z, str(o), F.unix_micros("_wall") - o * 60_000_000 > F.unix_micros(fetched), late, len(offsets)) for o in offsets])) for z, offsets in SHARED_LETTERS.items()])
    df = df.withColumn("_zones", F.when(F.col("_wall").isNotNull(), shared))
    df = df.withColumn("_off", F.coalesce("_off", F.array_max("_zones")["o"].try_cast("int")))
    micros = F.when(F.col("_z") == "", F.unix_micros(F.to_utc_timestamp("_wall", F.col("_named")))).otherwise(F.unix_micros("_wall") - F.col("_off").cast("long") * 60_000_000)
    return df.withColumn(out, micros + F.col("_frac"))


def _epoch(value: Column) -> Column:
    """Micros of an epoch count; its length tells the unit."""
    n, size = value.try_cast("decimal(38,0)"), F.length(value)
    scale = F.when(size.between(9, 11), n * 1_000_000).when(size.between(12, 13), n * 1_000).when(size.between(15, 16), n).when(size.between(18, 19), F.floor(n / 1_000))
    return scale.try_cast("long")


def _age(value: Column, fetched: Column) -> Column:
    amount = F.regexp_extract(value, _AGE, 1).try_cast("long")
    unit = F.lower(F.regexp_extract(value, _AGE, 2))
    seconds = F.coalesce(*[F.when(unit.isin(words.split()), F.lit(s)) for s, words in AGE_UNITS.items()])
    return F.when(value.rlike(_AGE_MARK), F.unix_micros(fetched) - amount * seconds * 1_000_000)


def _weighed(family: str, option: str, is_late: Column, late: float, options: int) -> Column:
    """A reading with its weight at the engine: (weight, option, late)."""
    weight = F.coalesce(F.try_element_at("_w", F.lit(f"{family}_{option}")), F.lit(1.0 / options))
    is_late = F.coalesce(is_late, F.lit(False))
    return F.struct((weight * F.when(is_late, F.lit(late)).otherwise(F.lit(1.0))).alias("p"), F.lit(option).alias("o"), is_late.alias("late"))


def _order_options(value: Column, latest: Column, late: float) -> Column:
    """The valid orders of a value's three numbers, weighed; null where its
    notation has one reading."""
    full = lambda x: F.when(F.length(x) <= 2, F.concat(F.lit("20"), F.lpad(x, 2, "0"))).otherwise(x)
    out = F.lit(None).cast("array<struct<p:double,o:string,late:boolean>>")
    for family, (pattern, layouts) in ORDERED.items():
        n = F.split(F.regexp_replace(value, pattern, "$1|$2|$3"), r"\|")
        n = [F.get(n, F.lit(i)) for i in range(3)]
        sizes = {o: (F.length(n[o.index("y")]).isin(2, 4)) & (F.length(n[2 - o.index("y")]) <= 2) for o in layouts}
        dates = {o: F.when(sizes[o], F.concat_ws("-", full(n[o.index("y")]), F.lpad(n[o.index("m")], 2, "0"), F.lpad(n[o.index("d")], 2, "0")).try_cast("date")) for o in layouts}
        out = F.when(value.rlike(pattern), F.array_compact(F.array(*[F.when(d.isNotNull(), _weighed(family, o, d > latest, late, len(layouts))) for o, d in dates.items()]))).otherwise(out)
    return out


def _prior(family: str, declared: str | None, tz: str, pseudo: float) -> dict[str, float]:
    """Observations that each reading has beforehand: slashed dates those of
    the engine's declaration, dots those of the countries that write them (day
    first), zone letters those of the engine's own zone, else a few of the
    best known zone."""
    if family in ORDERED:
        habit = declared if family == "slash" else "dmy"
        return {o: 1.0 + (pseudo if o == habit else 0.0) for o in ORDERED[family][1]}
    offsets = SHARED_LETTERS[family]
    own = [o for o, zones in offsets.items() if any(tz.startswith(z) for z in zones)]
    return {str(o): 1.0 + (pseudo if o in own[:1] else 2.0 if not own and o == next(iter(offsets)) else 0.0) for o in offsets}


def _fit_engine(rows: pd.DataFrame, pseudo: float, late_likelihood: float, steps: int) -> pd.DataFrame:
    """Mixture weights of one engine from its counts of reading sets."""
    weights: dict[str, float] = {}
    for family, some in rows[rows["orders"].notna()].groupby("family"):
        if family not in ORDERED and family not in SHARED_LETTERS:
            continue
        prior = _prior(family, some["date_order"].iloc[0], some["tz"].iloc[0], pseudo)
        sets = [(dict(zip(x["orders"], x["lates"])), x["n"]) for _, x in some.iterrows()]
        weight = {o: v / sum(prior.values()) for o, v in prior.items()}
        for _ in range(steps):
            counts = dict(prior)
            for readings, n in sets:
                like = {o: weight[o] * (late_likelihood if late else 1.0) for o, late in readings.items()}
                total = sum(like.values())
                for o, v in like.items():
                    counts[o] += n * v / total if total else 0.0
            weight = {o: v / sum(counts.values()) for o, v in counts.items()}
        weights.update({f"{family}_{o}": v for o, v in weight.items()})
    return pd.DataFrame({"engine": [rows["engine"].iloc[0]], "_w": [weights]})


def normalize_timestamps(
    rows: DataFrame, engines: DataFrame, value: str = "published_at", fetched: str = "fetched_at",
    declared_pseudo_count: float = 30.0, late_likelihood: float = 0.2, min_posterior: float = 0.9, steps: int = 12,
) -> DataFrame:
    """Add ``published_us``, ``notation``, ``posterior`` and ``ambiguous``.

    ``rows`` needs ``engine``, the value and the fetch time; ``engines`` has
    ``engine, default_tz, date_order``. What an engine declares enters the
    mixture as ``declared_pseudo_count`` observations; an engine whose values
    contradict it gets mixed weights, and its open values are marked. Engines
    that declare nothing are settled by their own unambiguous values.

    Null, empty and unreadable values, and values that name no existing
    moment, give a null ``published_us``. An engine that is null or missing
    from ``engines`` is read as UTC with unknown order. Added columns replace
    columns of the same names. An empty table gives an empty table.

    While this is built, the values with several readings are counted by
    engine, and the weights (some numbers an engine) come to the driver.
    """
    out = ["published_us", "notation", "posterior", "ambiguous"]
    kept = [c for c in rows.columns if c not in out]
    default = F.first("default_tz", True)
    zones = engines.groupBy("engine").agg(F.when(default.isin(sorted(zoneinfo.available_timezones())), default).otherwise("UTC").alias("_tz"), F.first("date_order", True).alias("_order"))
    src = join_small(rows.select(*kept), zones, ["engine"])
    src = src.withColumn("_v", F.trim(F.regexp_replace(F.col(value), r"(?U)\s+", " "))).withColumn("_tz", F.coalesce("_tz", F.lit("UTC")))
    col, latest = F.col("_v"), F.date_add(F.col(fetched).cast("date"), 1)

    # Mixture weights, from all values of several readings.
    open_values = src.withColumn("_w", F.lit(None).cast("map<string,double>"))
    kinds = ["engine", F.col("_order").alias("date_order"), F.col("_tz").alias("tz")]
    ordered = F.coalesce(*[F.when(col.rlike(pattern), F.lit(family)) for family, (pattern, _) in ORDERED.items()])
    dates = open_values.filter(ordered.isNotNull()).select(*kinds, ordered.alias("family"), _order_options(col, latest, late_likelihood).alias("_s"))
    lettered = open_values.filter(col.rlike(_LETTERS)).withColumn("_layout", _layout(col, _kind(col)))
    lettered = _instant(lettered, "_layout", "_tz", fetched, late_likelihood, "_us").select(*kinds, F.col("_z").alias("family"), F.col("_zones").alias("_s"))
    # Values without a valid reading count under no reading: a filter on them
    # would write out all expressions once more.
    sets = dates.unionByName(lettered).groupBy("engine", "date_order", "tz", "family", F.col("_s.o").alias("orders"), F.col("_s.late").alias("lates")).agg(F.count("*").alias("n"))
    weights = sets.groupBy("engine").applyInPandas(lambda g: _fit_engine(g, declared_pseudo_count, late_likelihood, steps), "engine string, _w map<string,double>")
    src = join_small(src, weights, ["engine"])

    src = src.withColumn("notation", _kind(col))
    src = src.withColumn("_options", F.when(F.col("notation").isin(*ORDERED), _order_options(col, latest, late_likelihood)))
    src = src.withColumn("_best", F.array_max("_options"))
    src = _instant(src.withColumn("_layout", _layout(col, F.col("notation"), F.col("_best.o"))), "_layout", "_tz", fetched, late_likelihood, "_us")
    src = src.withColumn("published_us", F.when(F.col("notation") == "epoch", _epoch(col)).when(F.col("notation") == "age", _age(col, F.col(fetched))).otherwise(F.col("_us")))
    share = lambda c: F.coalesce(F.array_max(c)["p"] / F.aggregate(c, F.lit(0.0), lambda a, x: a + x["p"]), F.lit(1.0))
    src = src.withColumn("posterior", F.when(F.col("published_us").isNotNull(), share("_options") * share("_zones")))
    src = src.withColumn("notation", F.when(F.col("_options").isNotNull(), F.concat_ws("_", "notation", F.coalesce("_best.o", F.lit("none")))).otherwise(F.col("notation")))
    # A filter on the result would be pushed below these projections, each time
    # with the whole chain written out; a row number holds it up here.
    src = src.withColumn("_row", F.monotonically_increasing_id())
    src = src.withColumn("published_us", F.when(F.col("_row") >= 0, F.col("published_us")))
    src = src.withColumn("ambiguous", F.coalesce(F.col("posterior") < min_posterior, F.lit(False)))
    return src.select(*kept, *out)


def _kind(value: Column) -> Column:
    """The notation of a value; null for empty and unreadable ones."""
    kind = F.when(F.coalesce(value, F.lit("")) == "", None)
    for name, (pattern, _) in ORDERED.items():
        kind = kind.when(value.rlike(pattern), name)
    for name, (pattern, _) in NOTATIONS.items():
        if name == "digits":
            kind = kind.when(value.rlike(r"^\d{9,11}$|^\d{13}$|^\d{15,16}$|^\d{18,19}$"), "epoch")
        kind = kind.when(value.rlike(pattern), name)
    return kind.when(value.rlike(_AGE_MARK), "age")


def _layout(value: Column, kind: Column, order: Column | None = None) -> Column:
    """A value in the layout ``y|mo|d|...``, by its notation and order."""
    layout = F.lit(None).cast("string")
    for name, (pattern, parts) in NOTATIONS.items():
        layout = F.when(kind == name, F.regexp_replace(value, pattern, parts)).otherwise(layout)
    if order is not None:
        for name, (pattern, layouts) in ORDERED.items():
            for o, parts in layouts.items():
                layout = F.when((kind == name) & (order == o), F.regexp_replace(value, pattern, parts)).otherwise(layout)
    return layout


def window_bound(value: Column, now: Column) -> Column:
    """Instant of a bound of a time window, in microseconds: an epoch count in
    seconds; ``7d``, ``24h`` or ``2w`` before ``now``, as the first moment of
    that day; an ISO date or time, in UTC where it has no zone. Null for
    others."""
    v = F.trim(value)
    amount, unit = F.regexp_extract(v, r"(?i)^(\d+)\s*([dhw])$", 1).try_cast("long"), F.lower(F.regexp_extract(v, r"(?i)^(\d+)\s*([dhw])$", 2))
    seconds = amount * F.when(unit == "h", 3600).when(unit == "w", 604_800).otherwise(86_400)
    ago = F.floor((F.unix_micros(now) - seconds * 1_000_000) / 86_400_000_000) * 86_400_000_000
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_micros(F.regexp_replace(v, r"^(\d{4}-\d{2}-\d{2}) (\d)", "$1T$2").try_cast("timestamp")))
    return F.when(v.rlike(r"^\d+$"), v.try_cast("long") * 1_000_000).when(amount.isNotNull(), ago.cast("long")).otherwise(iso)


def within_window(read: DataFrame, since: str | None = None, until: str | None = None, strict: bool = False, at: str = "published_us") -> DataFrame:
    """Rows whose instant lies in a window of UTC; a bound that is a day
    stands for its first moment, as an end for its last. Rows of unknown
    instant are kept, unless ``strict``."""
    moment = lambda text: F.unix_micros(F.lit(text).cast("timestamp"))
    inside = F.lit(True)
    if since is not None:
        inside = inside & (F.col(at) >= moment(since))
    if until is not None:
        day = len(until) == 10
        inside = inside & (F.col(at) < moment(until) + 86_400_000_000 if day else F.col(at) <= moment(until))
    return read.filter(F.coalesce(inside, F.lit(not strict)))


def sorted_by_time(read: DataFrame, newest: bool = True, by: tuple[str, ...] = ("query_id",), at: str = "published_us", tie: str = "rank") -> DataFrame:
    """``position`` of each row of a group by time; rows of unknown time come
    last, and rows of one time keep their order."""
    from pyspark.sql import Window

    time = F.col(at).desc_nulls_last() if newest else F.col(at).asc_nulls_last()
    return read.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(time, tie, "result_id")))
