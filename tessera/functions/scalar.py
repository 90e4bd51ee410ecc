"""Scalar functions of ids, names, paths and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers of units, in small letters; any other word counts as none.
UNITS = {"gib": 1 << 30, "mib": 1 << 20, "kib": 1 << 10, "g": 1 << 30, "m": 1 << 20, "k": 1 << 10}
#: Extension to language.
LANGUAGES = {"rs": "rust", "py": "python", "go": "go", "js": "javascript", "ts": "typescript", "html": "html", "c": "c", "java": "java"}


def is_address(c: Column) -> Column:
    """64 hex digits, either case."""
    return c.rlike("^[0-9a-fA-F]{64}$")


def short_id(c: Column) -> Column:
    return F.left(c, F.lit(12))


def first_component(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)


def language(path: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])
    return F.coalesce(F.try_element_at(pairs, extension(path)), F.lit("other"))


def safe_component(c: Column) -> Column:
    """A name that can't leave its folder: not empty, . or .., without / or NUL."""
    return ~c.rlike(r"^(|\.|\.\.)$") & ~c.rlike(r"[/\x00]")


def line_name(c: Column) -> Column:
    """1 to 128 of [A-Za-z0-9._/-], no / or . at an end, no .. inside."""
    return c.rlike(r"^[A-Za-z0-9_-]([A-Za-z0-9._/-]{0,126}[A-Za-z0-9_-])?$") & ~F.contains(c, F.lit(".."))


def archive_name(first: Column, last: Column) -> Column:
    pad = lambda x: F.lpad(x.cast("string"), 12, "0")
    return F.concat(pad(first), F.lit("-"), pad(last), F.lit(".jsonl"))


def quantity(c: Column) -> Column:
    """A number with thousands commas and a unit or another word after it, as a double."""
    number = F.regexp_replace(F.regexp_extract(c, r"([0-9,]*\.?[0-9]+)", 1), ",", "").try_cast("double")
    times = F.create_map(*[F.lit(x) for u, n in UNITS.items() for x in (u, float(n))])
    return number * F.coalesce(F.try_element_at(times, F.lower(F.regexp_extract(c, r"[0-9]\s*([A-Za-z]+)", 1))), F.lit(1.0))


def strict_address(c: Column) -> Column:
    """The 32 bytes of 64 hex digits of either case; null for anything else, signs included."""
    return F.when(is_address(c), F.unhex(c))


def minted(seed: str, counter: Column) -> Column:
    """An id of 32 hex digits from a seed and a counter, so that a run can be repeated."""
    return F.md5(F.concat_ws("|", F.lit(seed), counter.cast("string")).cast("binary"))


def display(raw: Column) -> Column:
    """Bytes as text; what isn't UTF-8 is replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def rename_kind(was: Column, now: Column) -> tuple[Column, Column]:
    """`rename` within one folder or `move`, and whether the extension changed."""
    return F.when(dirname(was) == dirname(now), "rename").otherwise("move"), extension(was) != extension(now)


def mode_bits(c: Column) -> Column:
    return c.bitwiseAND(F.lit(0o777))


def wilson(hits: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """The 95 % interval in percent, within 0..100; (0, 0) for n = 0."""
    h, m = hits.cast("double"), F.nullif(n, F.lit(0)).cast("double")
    p = h / m
    mid, bottom = p + z * z / (2 * m), 1 + z * z / m
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    clamped = lambda x: F.when(n > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * x / bottom))).otherwise(0.0)
    return clamped(mid - half), clamped(mid + half)


def factor(ratio: Column, cap: float = 2.0) -> Column:
    """Aggregate: the geometric mean of ratios of 1 at least, capped."""
    return F.least(F.lit(cap), F.exp(F.avg(F.ln(F.greatest(F.lit(1.0), ratio)))))


def pearson(x: str, y: str) -> Column:
    """Aggregate: Pearson's r, 0 where it isn't defined."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))
