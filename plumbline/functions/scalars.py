"""Column functions: scale conversion, rounding, confidence terms and fixed-point text."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: pixels per millimetre of the demonstration scale.
DEMO_PX_PER_MM = 32.4


def px_to_mm(px: Column, px_per_mm: Column) -> Column:
    """Millimetres of a length in pixels; a scale that isn't positive is an error."""
    return F.when(px_per_mm > 0, px / px_per_mm).otherwise(F.raise_error(F.lit("px_per_mm must be positive")).cast("double"))


def mm_to_px(mm: Column, px_per_mm: Column) -> Column:
    return F.when(px_per_mm > 0, mm * px_per_mm).otherwise(F.raise_error(F.lit("px_per_mm must be positive")).cast("double"))


def scale_from_reference(length_px: Column, length_mm: Column) -> Column:
    """Pixels per millimetre from an object of known length; both lengths must be positive."""
    good = (length_px > 0) & (length_mm > 0)
    return F.when(good, length_px / F.nullif(length_mm, F.lit(0.0))).otherwise(
        F.raise_error(F.lit("reference lengths must be positive")).cast("double")
    )


def base64_text(data: Column) -> Column:
    """Base64 in one line, whether or not the session breaks long ones after 76 characters."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def clip01(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def exceeds(score: Column, threshold: Column) -> Column:
    """score > threshold as IEEE numbers compare: never for NaN or null."""
    return F.coalesce((score > threshold) & ~F.isnan(score) & ~F.isnan(threshold), F.lit(False))


def sample_interval(fps: Column, target_per_second: float = 2.0, asked: Column | None = None) -> Column:
    """Every how many frames one is sampled: what is asked for (0 and null ask for nothing), else half-even fps / target, 1 at least.

    A frame rate that isn't positive gives 10.
    """
    own = F.when(fps > 0, F.greatest(F.lit(1), F.bround(fps / target_per_second, 0).cast("int"))).otherwise(F.lit(10))
    return own if asked is None else F.coalesce(F.nullif(asked.cast("int"), F.lit(0)), own)


def absolute_error(measured: Column, true: Column) -> Column:
    return F.abs(measured - true)


def percent_error(measured: Column, true: Column) -> Column:
    return F.try_divide(F.lit(100.0) * F.abs(measured - true), true)


def spectral_confidence(peak: Column, mean: Column) -> Column:
    """0 where the peak is no higher than the mean, 1 from six times the mean on."""
    return F.when(mean <= 0, F.lit(0.0)).otherwise(clip01((F.try_divide(peak, mean) - 1.0) / 5.0))


def spacing_confidence(mean: Column, std: Column, n_peaks: Column) -> Column:
    """One less the spacings' coefficient of variation; 0.7 of it below five peaks."""
    cv = F.when(mean > 0, F.try_divide(std, mean)).otherwise(F.lit(1.0))
    return clip01(1.0 - cv) * F.when(n_peaks < 5, F.lit(0.7)).otherwise(F.lit(1.0))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value named once, so that an expression that needs it often stays small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals (1 to 6), rounded from its exact binary value (ties to even); null stays null.

    The built-in formatting rounds the shortest decimal form instead, which differs for values such as 1.0005.  So the part below
    the point is taken in units of 2 ** -62 as a whole number: an exact tie is a multiple of 2 ** -7 and has no smaller bits.  From
    2 ** 62 on there are no decimals, and the built-in digits are used.
    """
    unit = F.lit(Decimal(2**62)).cast("decimal(19,0)")

    def long_as_decimal(c: Column) -> Column:
        return c.cast("long").cast("decimal(19,0)")

    def rounded(size: Column, units: Column) -> Column:
        guess = F.floor(units / unit)  # one too many where the quotient was rounded up
        part = _let(guess, lambda g: g - F.when(long_as_decimal(g) * unit > units, 1).otherwise(0))
        even = _let(part, lambda p: _let(2 * (units - long_as_decimal(p) * unit), lambda rest: p + F.when((rest > unit) | ((rest == unit) & (p % 2 == 1)), 1).otherwise(0)))
        return _let(even.cast("long"), lambda p: F.concat((F.floor(size) + F.floor(p / 10**digits)).cast("string"), F.lit("."), F.lpad((p % 10**digits).cast("string"), digits, "0")))

    def text(v: Column) -> Column:
        size = F.abs(v)
        small = F.when(size < float(2**62), size).otherwise(F.lit(0.0))
        exact = _let(small, lambda s: _let(long_as_decimal((s - F.floor(s)) * float(2**62)) * F.lit(10**digits).cast("decimal(7,0)"), lambda u: rounded(s, u)))
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
        plain = F.when(size < float(2**62), exact).when(size == float("inf"), F.lit("inf")).otherwise(F.format_string(f"%.{digits}f", size))
        return F.when(F.isnan(v), F.lit("nan")).when(v.isNotNull(), F.concat(sign, plain))

    return _let(x.cast("double"), text)


def joined(names: Column) -> Column:
    """The names with ', ' between them; 'none' if there are none."""
    return F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("none"))


def utc_iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
