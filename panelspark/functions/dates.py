"""Column expressions for dates. They do not depend on the session time zone
for DATE and TIMESTAMP_NTZ columns."""

from pyspark.sql import Column, functions as F

UNIX_EPOCH_JD = 2440587.5
# Days between 0001-01-01 of the mixed Julian/Gregorian calendar and of the proleptic
# Gregorian calendar that Spark uses; valid for dates from 1582-10-15.
CF_SHIFT = 2


def day_fraction(ts: Column) -> Column:
    seconds = F.extract(F.lit("SECOND"), ts).cast("double")
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + seconds) / 86400.0


def julian_day(ts: Column, is_date: bool = False) -> Column:
    """Julian date as DOUBLE; 2000-01-01 00:00 is 2451544.5."""
    days = F.unix_date(ts.cast("date")).cast("double") + UNIX_EPOCH_JD
    return days if is_date else days + day_fraction(ts)


#: Calendar steps: what `trunc` calls them, their length in months or days, and the most days between two starts.
STEPS = {"day": ("DAY", 0, 1, 1), "week": ("WEEK", 0, 7, 7), "month": ("MM", 1, 0, 31), "quarter": ("QUARTER", 3, 0, 92),
         "year": ("YEAR", 12, 0, 366)}
LONGEST_SLOT = {step: most for step, (_, _, _, most) in STEPS.items()}


def _step(step: str):
    if step not in STEPS:
        raise ValueError(f"unknown calendar step {step!r}")
    return STEPS[step]


def slot_start(ts: Column, step: str = "month") -> Column:
    """First day of the calendar slot that holds `ts`; weeks start on Mondays."""
    unit = _step(step)[0]
    return ts.cast("date") if step == "day" else F.trunc(ts, unit)


def slot_interval(step: str = "month") -> Column:
    _, months, days, _ = _step(step)
    return F.expr(f"interval {months} month" if months else f"interval {days} day")


def next_slot(day: Column, step: str = "month") -> Column:
    _, months, days, _ = _step(step)
    return F.add_months(day, months) if months else F.date_add(day, days)


def slot_ceil(ts: Column, step: str = "month") -> Column:
    """`ts` itself when it is a slot start, else the start of the next slot."""
    start = slot_start(ts, step)
    return F.when(ts == start, start).otherwise(next_slot(start, step))


def slots_between(first: Column, last: Column, step: str = "month") -> Column:
    """Array of slot starts in [first, last]; NULL when the range is reversed."""
    lo = slot_ceil(first, step)
    hi = slot_start(last, step)
    return F.when(lo <= hi, F.sequence(lo, hi, slot_interval(step)))


def cf_days(day: Column) -> Column:
    """Days since 0001-01-01 in the CF "standard" calendar."""
    return (F.datediff(day, F.lit("0001-01-01").cast("date")) + CF_SHIFT).cast("double")


def cf_date(days: Column) -> Column:
    return F.date_add(F.lit("0001-01-01").cast("date"), (days - CF_SHIFT).cast("int"))


def month_from_name(name: Column) -> Column:
    """`<product>.A194801.<version>` -> 1948-01-01."""
    pattern = r"\.A(\d{4})(\d{2})\."
    year = F.regexp_extract(name, pattern, 1)
    month = F.regexp_extract(name, pattern, 2)
    return F.to_date(F.concat_ws("-", year, month, F.lit("01")))
