"""Media timestamps: whole microseconds, exact rational conversion, status columns instead of exceptions.

Conversions give a struct (status, microseconds); microseconds are null unless status is kOk.
Numerators are DECIMAL(38, 0) and are held against the limit before the integer division,
whose result is a BIGINT and would wrap silently.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_INT64 = (1 << 63) - 1
PER_SECOND, PER_MILLISECOND = 1_000_000, 1000


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _result(status: Column, value: Column) -> Column:
    return F.struct(status.alias("status"), F.when(status == "kOk", value).cast("long").alias("microseconds"))


def _rounded(twice: Column, divisor: Column) -> tuple[Column, Column]:
    """(overflow, quotient) of twice / (2 * divisor), half away from zero, for values that aren't negative."""
    top = (twice + divisor).cast("decimal(38,0)")
    over = top >= (divisor * 2).cast("decimal(19,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)")
    return over, F.call_function("div", F.when(over, F.lit(0)).otherwise(top), (divisor * 2).cast("decimal(38,0)"))


def audio_index_to_us(index: Column, rate: Column) -> Column:
    good = (index >= 0) & (rate > 0)
    over, value = _rounded(F.when(good, _wide(index) * F.lit(2 * PER_SECOND)), F.when(good, rate.cast("decimal(10,0)")))
    status = F.when(index < 0, "kNegativeIndex").when(rate <= 0, "kInvalidSampleRate").when(over, "kOverflow").otherwise("kOk")
    return _result(status, value)


def video_index_to_us(index: Column, numerator: Column, denominator: Column) -> Column:
    """Frame index at numerator / denominator frames a second."""
    good = (index >= 0) & (numerator > 0) & (denominator > 0)
    over, value = _rounded(F.when(good, (_wide(index) * denominator.cast("decimal(10,0)")).cast("decimal(30,0)") * F.lit(2 * PER_SECOND)), F.when(good, numerator.cast("decimal(10,0)")))
    status = F.when(index < 0, "kNegativeIndex").when((numerator <= 0) | (denominator <= 0), "kInvalidFrameRate").when(over, "kOverflow").otherwise("kOk")
    return _result(status, value)


def milliseconds_to_us(ms: Column) -> Column:
    status = F.when(ms < 0, "kNegativeTimestamp").when(ms > MAX_INT64 // PER_MILLISECOND, "kOverflow").otherwise("kOk")
    return _result(status, F.when(status == "kOk", ms).otherwise(0) * PER_MILLISECOND)


def normalize_us(time: Column, origin: Column) -> Column:
    status = F.when((time < 0) | (origin < 0), "kNegativeTimestamp").when(origin > time, "kOriginAfterTimestamp").otherwise("kOk")
    return _result(status, F.when(status == "kOk", time - origin))


def us_to_milliseconds(us: Column) -> Column:
    """Half away from zero, without adding before dividing."""
    whole, rest = F.call_function("div", us, F.lit(PER_MILLISECOND)), us % PER_MILLISECOND
    return whole + F.when(rest >= 500, 1).when(rest <= -500, -1).otherwise(0)


def difference_us(video: Column, audio: Column) -> Column:
    return video - audio


def sample_to_ms(index: Column, rate: Column) -> Column:
    return index.cast("double") / rate * 1000.0


def seconds_to_us(seconds: Column) -> Column:
    return F.floor(seconds * 1e6 + 0.5)


def monotonic_status(previous: Column, current: Column) -> Column:
    """Equal timestamps are in order; a first one always is."""
    return F.when(current < previous, "kNonMonotonic").otherwise("kOk")


def frame_count(samples: Column, rate: int, numerator: int, denominator: int = 1) -> Column:
    """Video frames that cover the samples."""
    return F.call_function("div", samples * numerator + F.lit(rate * denominator - 1), F.lit(rate * denominator).cast("long"))


def mel_start(frame: Column, numerator: int, denominator: int = 1) -> Column:
    """First mel row of a video frame, at 80 rows a second."""
    return F.call_function("div", frame * (80 * denominator), F.lit(numerator).cast("long"))
