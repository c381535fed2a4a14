"""Times: zones, parsing of strings, d3 format patterns, time units."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats that strings are tried in, most specific first, after zone and weekday are taken off.
_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy-MM",
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "M/d/yyyy",
    "MMM d yyyy HH:mm:ss", "MMM d yyyy HH:mm", "MMM d yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy", "d MMMM yyyy",
)
_WEEKDAY = r"^\s*(?i:sun|mon|tue|wed|thu|fri|sat)[a-z]*,?\s+"
_ZONE = r"\s*(Z|GMT|UTC|[+-][0-9]{2}:?[0-9]{2})$"


def session_zone(spark) -> str:
    return spark.conf.get("spark.sql.session.timeZone")


def localized(naive: Column, zone: str, session: str) -> Column:
    """An instant from wall-clock time (timestamp_ntz) in ``zone``."""
    return F.convert_timezone(F.lit(zone), F.lit(session), naive).cast("timestamp")


def wall(instant: Column, zone: str, session: str) -> Column:
    """Wall-clock time (timestamp_ntz) in ``zone`` of an instant."""
    return F.convert_timezone(F.lit(session), F.lit(zone), instant.cast("timestamp_ntz"))


def millis(instant: Column) -> Column:
    return F.unix_millis(instant)


def of_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long"))


def parsed(text: Column, zone: str, session: str) -> Column:
    """An instant from a string; null where no format fits.

    A zone in the string counts first; a bare ISO date is UTC, as browsers have it; all
    else is wall-clock time in ``zone``.
    """
    text = F.regexp_replace(F.trim(text), _WEEKDAY, "")
    suffix = F.regexp_extract(text, _ZONE, 1)
    zoned = F.when(text.rlike(r"[0-9]T?.*:.*" + _ZONE), suffix).otherwise("")
    bare = F.when(zoned != "", F.regexp_replace(text, _ZONE, "")).otherwise(text)
    bare = F.regexp_replace(bare, r"\.([0-9]{3})[0-9]*$", ".$1")
    bare = F.regexp_replace(bare, r"\.([0-9])$", ".$100")
    bare = F.regexp_replace(bare, r"\.([0-9]{2})$", ".$10")
    naive = F.coalesce(*[_try_ntz(bare, p) for p in _PATTERNS])
    iso_date = text.rlike(r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$")
    hours = F.regexp_replace(F.regexp_replace(zoned, r"^(Z|GMT|UTC)$", "+00:00"), r"^([+-][0-9]{2}):?([0-9]{2})$", "$1:$2")
    year = F.when(text.rlike("^[0-9]{4}$"), F.make_timestamp_ntz(text.cast("int"), *[F.lit(x) for x in (1, 1, 0, 0, 0)]))
    naive = F.coalesce(naive, year)
    utc = localized(naive, "UTC", session)
    offset = (F.substring(hours, 1, 1).eqNullSafe("-").cast("int") * -2 + 1) * (F.substring(hours, 2, 2).try_cast("int") * 60 + F.substring(hours, 5, 2).try_cast("int"))
    shifted = F.timestamp_micros(F.unix_micros(utc) - offset.cast("long") * 60_000_000)
    return F.when(zoned != "", shifted).when(iso_date, utc).otherwise(localized(naive, zone, session))


def _try_ntz(text: Column, pattern: str) -> Column:
    # try_to_timestamp reads wall-clock time in the session's zone; going through the naive type undoes the zone
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


#: d3 directives and their Java patterns. Fixed values.
_JAVA = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "L": "SSS", "b": "MMM", "B": "MMMM",
    "a": "EEE", "A": "EEEE", "p": "a", "j": "DDD",
}


def java_pattern(fmt: str) -> str | None:
    """A d3 pattern for parsing as a Java one; None if a directive has no equal."""
    out = []
    for part in re.findall(r"%[-_0]?[A-Za-z%]|[^%]+", fmt):
        if part[0] != "%":
            out.append("".join("'" + c + "'" if c.isalpha() else "''" if c == "'" else c for c in part))
        elif part[-1] == "%":
            out.append("%")
        elif part[-1] in _JAVA:
            out.append(_JAVA[part[-1]] if len(part) == 2 else _JAVA[part[-1]][:1])
        elif part[-1] == "e":
            out.append("d")
        elif part[-1] == "f":
            out.append("SSSSSS")
        else:
            return None
    return "".join(out)


def formatted(instant: Column, fmt: str, zone: str, session: str) -> Column:
    """An instant as text by a d3 pattern, in ``zone``."""
    local = wall(instant, zone, session)
    ms = millis(instant)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    sunday = F.floor((F.dayofyear(local) + 6 - (F.dayofweek(local) - 1)) / 7)
    monday = F.floor((F.dayofyear(local) + 6 - F.weekday(local)) / 7)
    iso_year = F.year(F.date_add(local.cast("date"), 3 - F.weekday(local).cast("int")))
    shift = ((F.unix_millis(localized(local, "UTC", session)) - ms) / 60000).cast("int")
    own = {
        "e": F.lpad(F.dayofmonth(local).cast("string"), 2, " "), "f": F.date_format(local, "SSSSSS"), "Q": ms.cast("string"), "s": F.floor(ms / 1000).cast("string"),
        "q": F.quarter(local).cast("string"), "U": pad(sunday, 2), "W": pad(monday, 2), "V": pad(F.weekofyear(local), 2), "w": (F.dayofweek(local) - 1).cast("string"),
        "u": (F.weekday(local) + 1).cast("string"), "G": iso_year.cast("string"), "g": pad(iso_year % 100, 2),
        "Z": F.concat(F.when(shift < 0, "-").otherwise("+"), pad(F.floor(F.abs(shift) / 60), 2), pad(F.abs(shift) % 60, 2)),
    }
    whole = {"x": "%-m/%-d/%Y", "X": "%-I:%M:%S %p", "c": "%x, %X"}
    for k in ("c", "x", "X"):
        fmt = fmt.replace("%" + k, whole[k])
    parts = []
    for part in re.findall(r"%[-_0]?[A-Za-z%]|[^%]+", fmt):
        code = part[-1]
        if part[0] != "%":
            parts.append(F.lit(part))
        elif code == "%":
            parts.append(F.lit("%"))
        elif code in _JAVA or code in own:
            text = own[code] if code in own else F.date_format(local, _JAVA[code])
            if part[1] == "-":
                text = F.regexp_replace(text, "^[0 ]+(?=.)", "")
            elif part[1] == "_":
                text = F.lpad(F.regexp_replace(text, "^0+(?=.)", ""), F.length(text), F.lit(" "))
            parts.append(text)
        else:
            raise ValueError(f"%{code} is no known time format")
    return F.when(instant.isNotNull(), F.concat(*parts)) if parts else F.when(instant.isNotNull(), F.lit(""))


UNITS = ("year", "quarter", "month", "week", "date", "day", "dayofyear", "hours", "minutes", "seconds", "milliseconds")
#: Unit sets that are the start of a calendar period, and the period.
_TRUNCATED = {
    ("year",): "year", ("year", "quarter"): "quarter", ("year", "month"): "month", ("year", "quarter", "month"): "month", ("year", "week"): "week",
    ("year", "month", "date"): "day", ("year", "dayofyear"): "day", ("year", "month", "date", "hours"): "hour", ("year", "month", "date", "hours", "minutes"): "minute",
    ("year", "month", "date", "hours", "minutes", "seconds"): "second",
}
#: What a time unit's step is added as: the finest unit decides.
_STEPS = {"year": ("YEAR", 1), "quarter": ("QUARTER", 1), "month": ("MONTH", 1), "week": ("WEEK", 1), "date": ("DAY", 1), "day": ("DAY", 1), "dayofyear": ("DAY", 1), "hours": ("HOUR", 1), "minutes": ("MINUTE", 1), "seconds": ("SECOND", 1), "milliseconds": ("MILLISECOND", 1)}


def unit_start(instant: Column, units: list[str], zone: str, session: str) -> tuple[Column, Column]:
    """(start, end) of the time unit that holds an instant; units left out take their value in 2012.

    2012 starts on a Sunday, so that weekday and week units fall on 1 to 7 January and on.
    """
    wrong = [u for u in units if u not in UNITS]
    if wrong or not units:
        raise ValueError(f"unknown time units {wrong or units}")
    units = [u for u in UNITS if u in units]
    local = wall(instant, zone, session)
    period = _TRUNCATED.get(tuple(units))
    day = lambda c: F.make_dt_interval(days=c.cast("int"))
    if period == "week":
        start = F.date_trunc("week", local + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")
    elif period:
        start = F.date_trunc(period, local).cast("timestamp_ntz")
    else:
        year = F.year(local) if "year" in units else F.lit(2012)
        month = F.month(local) if "month" in units else (F.quarter(local) - 1) * 3 + 1 if "quarter" in units else F.lit(1)
        date = F.dayofmonth(local) if "date" in units else F.lit(1)
        start = F.try_make_timestamp_ntz(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + day(date - 1)
        if "dayofyear" in units:
            start = F.try_make_timestamp_ntz(year, *[F.lit(x) for x in (1, 1, 0, 0, 0)]) + day(F.dayofyear(local) - 1)
        elif "week" in units:
            # week 0 holds the days before the first Sunday; it stays at the first of January
            number = F.floor((F.dayofyear(local) + 6 - (F.dayofweek(local) - 1)) / 7)
            first = F.try_make_timestamp_ntz(year, *[F.lit(x) for x in (1, 1, 0, 0, 0)])
            sunday = F.pmod(8 - F.dayofweek(first), F.lit(7))
            start = first + day(F.when(number > 0, sunday + (number - 1) * 7).otherwise(F.lit(0)))
            if "day" in units:
                start = start + day(F.dayofweek(local) - 1)
        elif "day" in units:
            first = F.dayofweek(start)
            start = start + day(F.pmod(F.dayofweek(local) - first, F.lit(7)))
        ms = F.lit(0)
        for u, size, value in (("hours", 3_600_000, F.hour(local)), ("minutes", 60_000, F.minute(local)), ("seconds", 1000, F.floor(F.second(local))), ("milliseconds", 1, F.pmod(F.unix_millis(instant), F.lit(1000)))):
            if u in units:
                ms = ms + value * size
        start = start + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))
    step, n = _STEPS[units[-1]]
    after = F.timestamp_add(step, F.lit(n), start) if step != "MILLISECOND" else start + F.expr("INTERVAL '0.001' SECOND")
    return localized(start, zone, session), localized(after, zone, session)


def host_parsed(text: str, zone: str) -> datetime | None:
    """As ``parsed``, for one string on the host."""
    text = re.sub(_WEEKDAY, "", text.strip())
    m = re.search(_ZONE, text)
    tz: object = ZoneInfo(zone)
    if m and ":" in text[: m.start()]:
        text, sign = text[: m.start()], m[1]
        tz = UTC if sign[0] not in "+-" else datetime.strptime(sign, "%z").tzinfo
    elif re.fullmatch(r"\d{4}(-\d{2}(-\d{2})?)?", text):
        tz = UTC
    for f in ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y-%m", "%Y", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y", "%b %d %Y %H:%M:%S", "%b %d %Y %H:%M", "%b %d %Y", "%b %d, %Y", "%B %d, %Y", "%B %d %Y", "%d %b %Y %H:%M:%S", "%d %b %Y", "%d %B %Y"):
        try:
            return datetime.strptime(text, f).replace(tzinfo=tz)
        except ValueError:
            continue
    return None


def host_formatted(t: datetime, fmt: str) -> str:
    """As ``formatted``, for one instant on the host, already in its zone."""
    sunday, monday = (t.timetuple().tm_yday + 6 - t.isoweekday() % 7) // 7, (t.timetuple().tm_yday + 6 - t.weekday()) // 7
    epoch, shift = int(t.timestamp() * 1000 // 1), int(t.utcoffset().total_seconds() // 60)
    own = {
        "e": f"{t.day:2d}", "f": f"{t.microsecond:06d}", "L": f"{t.microsecond // 1000:03d}", "Q": str(epoch), "s": str(epoch // 1000), "q": str((t.month + 2) // 3),
        "U": f"{sunday:02d}", "W": f"{monday:02d}", "V": f"{t.isocalendar()[1]:02d}", "w": str(t.isoweekday() % 7), "u": str(t.isoweekday()), "G": str(t.isocalendar()[0]),
        "g": f"{t.isocalendar()[0] % 100:02d}", "Z": f"{'-' if shift < 0 else '+'}{abs(shift) // 60:02d}{abs(shift) % 60:02d}", "Y": f"{t.year:04d}", "%": "%",
    }
    for code, whole in (("c", "%x, %X"), ("x", "%-m/%-d/%Y"), ("X", "%-I:%M:%S %p")):
        fmt = fmt.replace("%" + code, whole)

    def shown(m: re.Match) -> str:
        flag, code = m[1], m[2]
        if code not in own and code not in _JAVA:
            raise ValueError(f"%{code} is no known time format")
        text = own[code] if code in own else t.strftime("%" + code)
        if flag == "-":
            return re.sub(r"^[0 ]+(?=.)", "", text)
        return re.sub(r"^0+(?=.)", "", text).rjust(len(text)) if flag == "_" else text

    return re.sub(r"%([-_0]?)([A-Za-z%])", shown, fmt)


def host_moved(t: datetime, unit: str, step: int, zone: str) -> datetime:
    """An instant moved by whole units of its wall clock in ``zone``; a day that a month does not have is its last."""
    local = t.astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    months = {"year": 12, "quarter": 3, "month": 1}.get(unit)
    if months:
        month = local.year * 12 + local.month - 1 + step * months
        first = local.replace(year=month // 12, month=month % 12 + 1, day=1)
        last = (first + timedelta(days=31)).replace(day=1) - timedelta(days=1)
        local = first.replace(day=min(local.day, last.day))
    else:
        length = {"week": 7 * 86_400_000, "hours": 3_600_000, "minutes": 60_000, "seconds": 1000, "milliseconds": 1}.get(unit, 86_400_000)
        local = local + timedelta(milliseconds=step * length)
    return local.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC)
