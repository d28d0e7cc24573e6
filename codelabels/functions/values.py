"""Times, JSON maps, thresholds and progress figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import THRESHOLD


def iso(ts: Column) -> Column:
    """ISO-8601 text; microseconds appear only when there are any.

    Built from the cast to text, which no session zone can shift.
    """
    plain = ts.cast("string")
    part = F.substring(plain, 20, 7)
    whole = F.replace(F.substring(plain, 1, 19), F.lit(" "), F.lit("T"))
    return F.concat(whole, F.when(part == "", "").otherwise(F.rpad(part, 7, "0")))


def iso_or_none(ts: Column) -> Column:
    """As :func:`iso`, with the text ``None`` for a missing time."""
    return F.coalesce(iso(ts), F.lit("None"))


def from_iso(text: Column) -> Column:
    return F.to_timestamp_ntz(text)


def plain_time(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 19)


def from_epoch(seconds: Column, zone: str = "UTC") -> Column:
    """Wall-clock time of an epoch second in ``zone``, whatever the session's."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def encode_map(m: Column) -> Column:
    return F.to_json(m)


def decode_map(text: Column) -> Column:
    return F.from_json(text, "map<string,int>")


def probability(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def decide(logits: Column, threshold: float = THRESHOLD) -> Column:
    """0/1 per label; exactly the threshold does not count."""
    return F.transform(logits, lambda x: (probability(x) > threshold).cast("int"))


def progress(done: Column, total: Column) -> Column:
    """Whole percent, cut off after binary floating-point division (29/100 is 28)."""
    return ((done.cast("double") / total.cast("double")) * 100).cast("int")


def packed(c: Column) -> Column:
    """A name in few bytes: hexadecimal digits in pairs, as commits are named by, behind a 1; any other text behind a 0.

    For exchanges, whose codec finds nothing to shorten in such digits. A missing
    name is empty and not null: joins ask of their keys whether they are null,
    which would make the name and its digits once more. Rows without a name must
    go before a join.
    """
    digits = F.unhex(c)
    short = F.when(F.lower(F.hex(digits)) == c, F.concat(F.lit(bytearray(b"\x01")), digits))
    return F.coalesce(short, F.concat(F.lit(bytearray(b"\x00")), c.cast("binary")), F.lit(bytearray()))


def unpacked(c: Column) -> Column:
    """The text that :func:`packed` was given."""
    kind, body = F.substring(c, 1, 1), F.substring(c, 2, 2147483647)
    short = F.when(kind == F.lit(bytearray(b"\x01")), F.lower(F.hex(body)))
    return short.when(kind == F.lit(bytearray(b"\x00")), body.cast("string"))
