"""Column functions: cleaning, dates, bins, keyed hashes. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of "missing" that tables use; compared after trimming, in any case.
SENTINELS = ("tag", "?", "-1", "-1.0", "-9999999", "empty")
REFERENCE_DAY = "1800-01-01"


def is_sentinel(c: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*sentinels), F.lit(False))


def clean_sentinels(c: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """NULL for a spelling of missing, else the value."""
    return F.when(~is_sentinel(c, sentinels), c)


def normalise_text(c: Column) -> Column:
    return F.lower(F.trim(c))


def by_substring(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first rule whose substring occurs; the value itself if none does."""
    out = None
    for part, label in rules:
        out = F.when(c.contains(part), label) if out is None else out.when(c.contains(part), label)
    return c if out is None else out.otherwise(c)


def year_difference(later: Column, earlier: Column) -> Column:
    """Difference of calendar years, not elapsed time."""
    return F.year(later) - F.year(earlier)


def year_bin(date: Column, width: int = 5, last: int = 4995) -> Column:
    """Left edge of the right-closed bin (a, a + width] that holds the year; NULL outside (0, last]."""
    y = F.year(date)
    return F.when((y > 0) & (y <= last), (F.floor((y - 1) / width) * width).cast("int"))


def span_bin(years: Column, width: int = 5, last: int = 195) -> Column:
    """Left edge of the right-closed bin (a, a + width]; NULL for 0, negatives and what is above last."""
    return F.when((years > 0) & (years <= last), (F.ceil(years / width) * width - width).cast("int"))


def bin_left_edge(label: Column) -> Column:
    """The number at the left of a label such as `(5, 10]`."""
    return F.regexp_extract(label, r"[(\[]([^,]+)", 1).try_cast("double")


def presence(c: Column) -> Column:
    return c.isNotNull().cast("int")


def date_to_days(c: Column, origin: str = REFERENCE_DAY) -> Column:
    """Days since the origin; NULL if it isn't a date."""
    return F.datediff(c.try_cast("date"), F.lit(origin).cast("date")).cast("double")


def days_to_date(c: Column, origin: str = REFERENCE_DAY) -> Column:
    """The date so many days after the origin, rounded; NULL for NULL."""
    return F.date_add(F.lit(origin).cast("date"), F.round(c).cast("int"))


def bmi(weight: Column, height_cm: Column) -> Column:
    """Weight over squared height in metres; NULL for a height of 0."""
    return F.try_divide(weight, (height_cm / 100) * (height_cm / 100))


def clip(c: Column, low: Column, high: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, high), low))


def shifted_log(c: Column, low: Column) -> Column:
    """log x if the column's least value is above 0, log(x + 1) if it is 0, else log(x - least + 1)."""
    return F.when(low > 0, F.ln(c)).when(low == 0, F.ln(c + 1)).otherwise(F.ln(c - low + 1))


def shifted_exp(c: Column, low: Column) -> Column:
    """The inverse of shifted_log."""
    return F.when(low > 0, F.exp(c)).when(low == 0, F.exp(c) - 1).otherwise(F.exp(c) - 1 + low)


def first_maximum(*indicators: Column) -> Column:
    """The number, from 0, of the first of the largest indicators."""
    x = F.array(*indicators)
    return F.array_position(x, F.array_max(x)) - 1


def parse_pairs(text: Column, names: list[str], between: str = ", ", equals: str = " is ") -> Column:
    """A struct of the named values in text such as `age is 3, sex is F`; of repeated names the first counts."""
    parts = F.transform(F.split(text, between), lambda p: F.struct(F.trim(F.substring_index(p, equals, 1)).alias("k"), F.substring(p, F.length(F.substring_index(p, equals, 1)) + len(equals) + 1, F.lit(1 << 30)).alias("v")))
    get = lambda name: F.get(F.filter(parts, lambda x: (x["k"] == name)), F.lit(0))["v"]
    return F.struct(*[get(n).alias(n) for n in names])


def unit_hash(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that only the seed and the key decide."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by the rational approximation 26.2.17 of Abramowitz and Stegun, right to 7.5e-8."""
    # fixed values of that approximation
    p, terms = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t, series = 1 / (1 + p * F.abs(z)), F.lit(0.0)
    for b in reversed(terms):
        series = (series + b) * t
    upper = F.exp(-z * z / 2) * (0.5 / math.pi) ** 0.5 * series
    return F.when(z >= 0, 1 - upper).otherwise(upper)


#: Fixed values of algorithm AS 241 (Wichura 1988): numerators and denominators of three ratios of polynomials, lowest power first.
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def normal_quantile(p: Column) -> Column:
    """The quantile of the normal distribution at p in (0, 1), by algorithm AS 241; NULL outside."""

    def ratio(parts: tuple[tuple[float, ...], ...], r: Column) -> Column:
        sums = []
        for powers in parts:
            total = F.lit(0.0)
            for c in reversed(powers):
                total = total * r + c
            sums.append(total)
        return sums[0] / sums[1]

    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(TAIL, r - 1.6)).otherwise(ratio(FAR_TAIL, r - 5))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * ratio(MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * tail))
