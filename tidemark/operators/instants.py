"""Time texts of many writings brought to one UTC instant.

An ordered cascade of anchored patterns takes a text apart; every pattern yields the
same nine fields, so the first that matches decides. Dates are checked against the
calendar by arithmetic, never by a lenient parser. The zone comes from the text where
it names one and else from a lookup (the device's zone).

Policy for local times: one that occurs twice is the earlier instant; one that does not
occur is read with the offset in force before the change. No instant results from a
null, empty or unreadable text, a date or time of day that does not exist, an unknown
zone name or abbreviation, or a zone-less text whose device has no known zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.steps import step

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$"

_ZONE = r"(?:[ ]?(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)*))?(?:\[([A-Za-z0-9_+/-]+)\])?"

#: The order of the cascade. Each pattern names the group that holds
#: year, month, day, hour, minute, second, fraction, zone, bracketed zone, half of the day (0: absent).
CASCADE = (
    ("iso", r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:[.,](\d+))?" + _ZONE + "$", (1, 2, 3, 4, 5, 6, 7, 8, 9, 0)),
    ("compact", r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})(?:[.,](\d+))?" + _ZONE + "$", (1, 2, 3, 4, 5, 6, 7, 8, 9, 0)),
    ("dotted", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})[ ](\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?" + _ZONE + "$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 0)),
    ("log", r"^(\d{1,2})/([A-Za-z]{3})/(\d{4}):(\d{2}):(\d{2}):(\d{2})" + _ZONE + "$", (3, 2, 1, 4, 5, 6, 0, 7, 8, 0)),
    ("mail", r"^(?:[A-Za-z]{3},[ ])?(\d{1,2})[ ]([A-Za-z]{3})[ ](\d{4})[ ](\d{2}):(\d{2}):(\d{2})" + _ZONE + "$", (3, 2, 1, 4, 5, 6, 0, 7, 8, 0)),
    ("halves", r"^([A-Za-z]{3})[ ](\d{1,2}),[ ](\d{4}),?[ ](\d{1,2}):(\d{2}):(\d{2})[ ]([AaPp])[Mm]" + _ZONE + "$", (3, 1, 2, 4, 5, 6, 0, 8, 9, 7)),
)
EPOCH = r"^([+-]?)(\d{1,19})(?:\.(\d+))?$"
FIELDS = ("year", "month", "day", "hour", "minute", "second", "fraction", "zone", "bracket", "half")

#: Minutes east of UTC of zone abbreviations, by region where a name is shared.
ABBREVIATIONS = {
    "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "WET": 0, "WEST": 60, "MSK": 180, "JST": 540, "KST": 540,
    "HKT": 480, "SGT": 480, "PKT": 300, "NPT": 345, "WIB": 420, "ICT": 420, "AEST": 600, "AEDT": 660, "ACST": 570,
    "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "BRT": -180, "BRST": -120, "ART": -180, "CLT": -240,
    "CLST": -180, "COT": -300, "PET": -300, "NST": -210, "NDT": -150, "ADT": -180, "PDT": -420, "MDT": -360,
    "AKST": -540, "AKDT": -480, "HST": -600, "SAST": 120, "EAT": 180, "WAT": 60, "CAT": 120,
    "PST|America": -480, "PST|Asia": 480, "MST|America": -420, "CST|America": -360, "CST|Asia": 480,
    "CST|Australia": 570, "CDT|America": -300, "CDT|Australia": 630, "EST|America": -300, "EST|Australia": 600,
    "EDT|America": -240, "EDT|Australia": 660, "AST|America": -240, "AST|Asia": 180, "BST|Europe": 60,
    "BST|Asia": 360, "IST|Asia": 330, "IST|Europe": 60, "IST|Asia/Jerusalem": 120, "IDT|Asia": 180, "GST|Asia": 240,
}
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_SEP = "\x1f"


def is_known_zone(spark: SparkSession, name: Column) -> Column:
    """Whether the JVM can resolve a zone name; one folded literal, as a list of 600 would burden every plan rule."""
    jvm = spark._jvm.java
    names = jvm.lang.String.join(",", jvm.time.ZoneId.getAvailableZoneIds())
    return F.array_contains(F.split(F.lit(names), ","), name)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by arithmetic alone."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146_097 + doe - 719_468).cast("bigint")


def _fields(text: Column) -> Column:
    """The ten fields of the first matching pattern as an array of strings, else null."""
    out = None
    for name, pattern, groups in CASCADE:
        rewritten = F.regexp_replace(text, pattern, _SEP.join(f"${g}" if g else "" for g in groups))
        hit = F.when if out is None else out.when
        out = hit(text.rlike(pattern), F.split(rewritten, _SEP))
    return out


def _micro(fraction: Column) -> Column:
    return F.coalesce(F.rpad(fraction, 6, "0").try_cast("bigint"), F.lit(0).cast("bigint"))


def _epoch_us(text: Column) -> Column:
    """Microseconds of a bare number, in the unit its size suggests."""
    n = F.regexp_extract(text, EPOCH, 2).try_cast("bigint")
    frac = F.regexp_extract(text, EPOCH, 3)
    sign = F.when(F.regexp_extract(text, EPOCH, 1) == "-", -1).otherwise(1)
    us = (
        F.when(n < 100_000_000_000, n * 1_000_000 + _micro(frac))
        .when(n < 100_000_000_000_000, n * 1_000 + F.floor(_micro(frac) / 1_000))
        .when(n < 100_000_000_000_000_000, n)
        .otherwise(F.floor(n.cast("decimal(20,0)") / 1_000).cast("bigint"))
    )
    return sign * us


def with_instant(df: DataFrame, text: str, zone: str, out: str = "epoch_us") -> DataFrame:
    """``df`` plus ``out``, the microseconds since 1970-01-01 UTC that ``text`` denotes, or null.

    ``zone`` is the column of the device's zone, a known name or null (:func:`device_zones` sees to that).
    Digits finer than a microsecond are cut off.
    Helper columns start with ``__t_`` and are removed; other names are untouched.
    """
    d = df.withColumn("__t_x", F.trim(F.col(text)))
    d = step(d, __t_f=_fields(F.col("__t_x")))
    get = lambda k: F.col("__t_f")[FIELDS.index(k)]
    num = lambda k: get(k).try_cast("int")
    place_of_name = F.position(F.lower(get("month")), F.lit(_MONTHS))
    month = F.coalesce(num("month"), F.when(place_of_name % 3 == 1, ((place_of_name + 2) / 3).cast("int")))
    hour = (
        F.when(get("half") == "", num("hour"))
        .when(num("hour").between(1, 12), num("hour") % 12 + F.when(F.lower(get("half")) == "p", 12).otherwise(0))
    )
    d = step(
        d, __t_y=num("year"), __t_m=month, __t_d=num("day"), __t_h=hour, __t_i=num("minute"), __t_s=num("second"),
        __t_u=_micro(get("fraction")), __t_z=F.when(get("zone") != "", get("zone")).otherwise(get("bracket")),
    )
    y, m, day = F.col("__t_y"), F.col("__t_m"), F.col("__t_d")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    real = (
        y.between(1, 9999) & m.between(1, 12) & (day >= 1) & (day <= longest)
        & F.col("__t_h").between(0, 23) & F.col("__t_i").between(0, 59) & F.col("__t_s").between(0, 59)
    )
    seconds = days_from_civil(y, m, day) * 86_400 + F.col("__t_h") * 3_600 + F.col("__t_i") * 60 + F.col("__t_s")
    local_us = F.when(real, seconds * 1_000_000 + F.col("__t_u"))

    z, home = F.col("__t_z"), F.col(zone)
    digits = F.regexp_replace(z, r"[:+-]", "")
    off_h, off_m = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    signed = F.when(
        z.rlike(r"^[+-]\d{2}(?::?\d{2})?$") & (off_h <= 18) & (off_m <= 59),
        (off_h * 60 + off_m) * F.when(z.startswith("-"), -1).otherwise(1),
    )
    table = F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in ABBREVIATIONS.items()) + ")")
    region = F.split(home, "/")[0]
    named = F.coalesce(table[F.concat_ws("|", z, home)], table[F.concat_ws("|", z, region)], table[z])
    offset = F.when(F.upper(z).isin("Z", "UTC", "GMT", "UT"), 0).when(z.rlike(r"^[+-]"), signed).when(z.rlike("^[A-Z]{2,5}$"), named)
    place = F.when(z == "", home).when(z.contains("/") & is_known_zone(df.sparkSession, z), z)
    d = step(d, __t_l=local_us, __t_o=offset, __t_p=place)
    local = F.col("__t_l")
    in_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), F.col("__t_p")))
    dated = F.when(F.col("__t_o").isNotNull(), local - F.col("__t_o").cast("bigint") * 60_000_000).when(
        F.col("__t_p").isNotNull() & local.isNotNull(), in_zone
    )
    number = F.when(F.col("__t_x").rlike(EPOCH), _epoch_us(F.col("__t_x")))
    d = step(d, **{out: F.when(F.col("__t_f").isNotNull(), dated).otherwise(number)})
    return d.drop(*[c for c in d.columns if c.startswith("__t_")])


def device_zones(devices: DataFrame) -> DataFrame:
    """One zone per device: the lowest name where a device is listed twice; unknown and null names left out."""
    known = devices.where(F.col("device_ref").isNotNull() & is_known_zone(devices.sparkSession, F.col("tz_name")))
    return known.groupBy(F.col("device_ref").alias("__device")).agg(F.min("tz_name").alias("__zone"))


def normalise_instants(rows: DataFrame, devices: DataFrame, text: str, device: str, out: str = "epoch_us") -> DataFrame:
    """``rows`` plus ``out``; ``devices(device_ref, tz_name)`` supplies the zone of zone-less texts.

    ``device`` names the rows' device column; a null or unknown device has no zone.
    """
    zoned = rows.join(device_zones(devices), F.col(device) == F.col("__device"), "left").drop("__device")
    return with_instant(zoned, text, "__zone", out).drop("__zone")
