"""Format induction (C8): the one time format that all values of a text column share, derived instead of tried.

Every value is reduced to a mask: digits become 9, month and weekday names, AM/PM and a zone become one symbol each, separators
stay. A value that cannot be a time gives the mask '?'. One aggregation leaves a bounded table a column: its masks, the largest
first and second number (they tell day from month), and the smallest and largest zone. On the driver a format is derived from
each mask; the column has times only if all masks agree up to the number of digits of day, month and hour and up to
fractions of seconds. A last pass checks that the format parses every value, so a 30th of February rejects the column.

Rules: of two leading numbers the one above 12 is the day; if neither is, the month comes first, after dots the day. Years of
two digits are 1969 to 2068. Calendar parts are those of the written local time; a column with different zones is not a time
column. Names are English.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
LONGEST = 48
PIVOT = 2069                          # a two-digit year from 69 on belongs to the last century

# Symbols: L long and M short month name, Y may, K long and D short weekday name, P am or pm.
_NAMES = ((rf"\b({'|'.join(m for m in MONTHS if m != 'may')})\b", "L"), (r"\bmay\b", "Y"), (rf"\b({'|'.join(m[:3] for m in MONTHS if m != 'may')})\b", "M"),
          (rf"\b({'|'.join(DAYS)})\b", "K"), (rf"\b({'|'.join(d[:3] for d in DAYS)})\b", "D"), (r"(?<=[0-9 ])[ap]m\b", "P"))
_ZONE = r"(?<=[0-9 ])(z|utc|gmt|[+-][0-9]{2}:?[0-9]{2})$"
_PLAUSIBLE = r"^([KD],? )?(9999[-/. ]|99?[-/. ]|[LMY] |99999999)[9LMYP:/., t-]*$"
_DATE = re.compile(r"(?P<week>[KD],? )?(?:(?P<y1>9999)(?P<s1>[-/.])(?P<m1>99?)(?P=s1)(?P<d1>99?)"
                   r"|(?P<a2>99?)(?P<s2>[-/.])(?P<b2>99?)(?P=s2)(?P<y2>9999|99)"
                   r"|(?P<c3>99999999)"
                   r"|(?P<n4>[LMY]) (?P<d4>99?)(?P<k4>,? )(?P<y4>9999)"
                   r"|(?P<d5>99?)(?P<s5>[- ])(?P<n5>[LMY])(?P=s5)(?P<y5>9999|99)"
                   r"|(?P<y6>9999)(?P<s6>[- ])(?P<n6>[LMY])(?P=s6)(?P<d6>99?))")
_TIME = re.compile(r"(?P<gap>,? |t)(?:(?P<h>99?):99(?P<sec>:99(?P<frac>\.9{1,9})?)?(?P<pm> ?P)?|(?P<hms>999999))(?P<tail> ?)$")


def mask_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(c, mask, zone_lo, zone_hi, first, second): one row a column number and mask, over its non-null values."""
    items = [F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").alias("x")) for i, c in enumerate(cols)]
    x = df.select(F.explode(F.array(*items)).alias("v")).select("v.c", "v.x").where(F.col("x").isNotNull())
    # most text fails the cheap test of its first characters and never meets the patterns
    first = (F.length("x") <= LONGEST) & F.col("x").rlike(r"^[A-Za-z]{0,9},? ?([A-Za-z]{3,9} )?[0-9]")
    x = x.withColumn("low", F.when(first, F.lower("x")))
    x = x.withColumn("zone", F.when(F.col("low").contains(":"), F.regexp_extract("low", _ZONE, 1)).otherwise(F.lit("")))
    body = F.substr("low", F.lit(1), F.length("low") - F.length("zone"))
    for pattern, symbol in _NAMES:
        body = F.regexp_replace(body, pattern, symbol)
    x = x.withColumn("body", F.regexp_replace(body, "[0-9]", "9"))
    x = x.withColumn("mask", F.when(F.col("body").rlike(_PLAUSIBLE), F.col("body")).otherwise(F.lit("?")))
    known = F.col("mask") != "?"
    return x.groupBy("c", "mask").agg(
        F.min(F.when(known, F.col("zone"))).alias("zone_lo"), F.max(F.when(known, F.col("zone"))).alias("zone_hi"),
        F.max(F.when(known, F.regexp_extract("low", r"^[^0-9]*([0-9]{1,2})", 1).try_cast("int"))).alias("first"),
        F.max(F.when(known, F.regexp_extract("low", r"^[^0-9]*[0-9]+[^0-9]+([0-9]{1,2})", 1).try_cast("int"))).alias("second"))


@dataclass
class _Shape:
    """What masks of one column must share (`same`), and what may differ."""
    same: tuple
    short: set                        # fields written with one digit
    names: set
    fraction: int


def _shape(mask: str) -> _Shape | None:
    m = _DATE.match(mask)
    t = _TIME.match(mask, m.end()) if m and m.end() < len(mask) else None
    if not m or (m.end() < len(mask) and not t):
        return None
    g = m.groupdict()
    kind = next(k for k in "123456" if any(g[n] for n in g if n.endswith(k)))
    years = len(g.get(f"y{kind}") or "9999")
    short = {n for n in ("m1", "d1", "a2", "b2", "d4", "d5", "d6") if g[n] == "9"}
    names = {g[n] for n in ("n4", "n5", "n6") if g[n]}
    sep = g.get(f"s{kind}") or g.get("k4") or ""
    time, fraction = (), 0
    if t:
        if t["h"] == "9":
            short.add("h")
        fraction = len(t["frac"] or ".") - 1
        time = (t["gap"], bool(t["sec"]), t["pm"], bool(t["hms"]), t["tail"])
    return _Shape((kind, g["week"], sep, years, time), short, names, fraction)


def _quoted(text: str) -> str:
    return f"'{text}'" if re.search("[A-Za-z]", text) else text


def derive(rows: list) -> str | None:
    """The format of a column from its mask rows (mask, zone_lo, zone_hi, first, second); None if there is no single one."""
    shapes = [_shape(r["mask"]) for r in rows]
    if not shapes or any(s is None or s.same != shapes[0].same for s in shapes):
        return None
    zones = {r["zone_lo"] for r in rows} | {r["zone_hi"] for r in rows}
    if len(zones) > 1:
        return None
    kind, week, sep, years, time = shapes[0].same
    short, names = set().union(*(s.short for s in shapes)), set().union(*(s.names for s in shapes))
    if {"L", "M"} <= names:
        return None

    def digits(letter, field):
        return letter if field in short else 2 * letter
    year, name = "y" * years, "MMMM" if "L" in names else "MMM"
    first, second = (max((r[c] or 0) for r in rows) for c in ("first", "second"))
    if kind == "2":
        day_first = first > 12 if (first > 12) != (second > 12) else sep == "."
        a, b = ("d", "M") if day_first else ("M", "d")
        date = f"{digits(a, 'a2')}{sep}{digits(b, 'b2')}{sep}{year}"
    else:
        date = {"1": f"{year}{sep}{digits('M', 'm1')}{sep}{digits('d', 'd1')}", "3": "yyyyMMdd", "4": f"{name} {digits('d', 'd4')}{sep}{year}",
                "5": f"{digits('d', 'd5')}{sep}{name}{sep}{year}", "6": f"{year}{sep}{name}{sep}{digits('d', 'd6')}"}[kind]
    out = ("E" + week[1:] if week else "") + date
    if time:
        gap, seconds, pm, compact, tail = time
        out += _quoted("T") if gap == "t" else gap
        if compact:
            out += "HHmmss"
        else:
            out += digits("h" if pm else "H", "h") + ":mm" + (":ss" if seconds else "")
            longest = max(s.fraction for s in shapes)
            if longest:
                part = "." + "S" * longest
                out += part if all(s.fraction for s in shapes) else f"[{part}]"
            out += pm.replace("P", "a") if pm else ""
        out += tail
    zone = zones.pop() or ""
    return out + (_quoted(zone.upper()) if zone else "")


def parse(c: Column, fmt: str) -> Column:
    """A text as a timestamp by a derived format, NULL where it does not parse."""
    if fmt.startswith("E"):           # a weekday name is skipped, Spark has no pattern to parse it
        skip = fmt[1:fmt.index(" ") + 1]
        c, fmt = F.regexp_extract(c, rf"^[A-Za-z]+{skip}(.*)$", 1), fmt[1 + len(skip):]
    ts = F.try_to_timestamp(c, F.lit(fmt))
    if "yy" in fmt and "yyyy" not in fmt:
        ts = F.when(F.year(ts) >= PIVOT, ts - F.expr("interval 100 years")).otherwise(ts)
    return ts


def induce(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """The formats of those text columns that hold times and nothing else."""
    if not cols:
        return {}
    table: dict[int, list] = {}
    for r in mask_table(df, cols).collect():          # masks are bounded by the forms of `_PLAUSIBLE` up to LONGEST characters
        table.setdefault(r["c"], []).append(r)
    found = {cols[i]: fmt for i, rows in table.items() if (fmt := derive(rows))}
    if not found:
        return {}
    bad = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & parse(F.col(f"`{c}`"), fmt).isNull()).alias(f"b{i}")
                   for i, (c, fmt) in enumerate(found.items())]).first()
    return {c: fmt for i, (c, fmt) in enumerate(found.items()) if bad[f"b{i}"] == 0}
