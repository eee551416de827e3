"""Column functions. Text or column arguments, column results, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granulite.fixed import EPS, FIRST_X, FIRST_Y, GRID_N, SPACING


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tablet_label(tablet_id, n: int = GRID_N) -> Column:
    """Column letter and row number from the bottom; anything off the grid stays as text."""
    raw = _c(tablet_id).cast("string")
    k = raw.try_cast("bigint") - 1
    name = F.concat(F.char(65 + F.pmod(k, F.lit(n))), (F.floor(k / n) + 1).cast("string"))
    return F.when(k.between(0, n * n - 1), name).otherwise(raw)


def tablet_xy(tablet_id, x0: float = FIRST_X, y0: float = FIRST_Y, d: float = SPACING,
              n: int = GRID_N) -> Column:
    """``struct(x, y)`` of a cell, null off the grid."""
    k = _c(tablet_id).cast("bigint") - 1
    xy = F.struct((F.lit(x0) + F.pmod(k, F.lit(n)) * F.lit(d)).alias("x"),
                  (F.lit(y0) + F.floor(k / n) * F.lit(d)).alias("y"))
    return F.when(k.between(0, n * n - 1), xy)


def capture_stamp(ts) -> Column:
    return F.date_format(_c(ts), "MMdd_HHmm")


def capture_name(ts, light, name=None, label=None) -> Column:
    """``name_stamp_label_light`` for runs, ``stamp_light`` for single captures."""
    parts = [p for p in (name, None, label) if p is not None]
    if parts:
        return F.concat_ws("_", _c(name), capture_stamp(ts), _c(label), _c(light))
    return F.concat_ws("_", capture_stamp(ts), _c(light))


def safe_float(c, nd: int = 3) -> Column:
    """Fixed decimals, ``.`` as ``p`` and ``-`` as ``m``."""
    return F.translate(F.format_string(f"%.{nd}f", _c(c)), ".-", "pm")


def clean_name(c, default: str = "camera-settings-preset") -> Column:
    """Other characters become one ``_``, outer ones go, nothing left gives the default."""
    t = F.when(F.coalesce(_c(c), F.lit("")) == "", F.lit(default)).otherwise(_c(c))
    t = F.regexp_replace(t, "[^a-zA-Z0-9._-]", "_")
    t = F.regexp_replace(t, "_+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(default))


def strip_ext(c) -> Column:
    """Drop the text from the last dot on, unless that dot is first or missing."""
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"(?s)^(.+)\.[^.]*$", "$1")


def default_name(path) -> Column:
    """Last part of a folder path, else ``measurement``."""
    trimmed = F.regexp_replace(F.coalesce(_c(path), F.lit("")), r"[/\\]+$", "")
    return F.coalesce(F.nullif(F.regexp_extract(trimmed, r"([^/\\]*)$", 1), F.lit("")), F.lit("measurement"))


def normalize_number(c, decimals: int) -> Column:
    """Number rounded half up towards plus infinity; blank or non-finite gives null."""
    v = to_number(c)
    if decimals <= 0:
        return F.floor(v + 0.5).cast("double")
    k = float(10 ** decimals)
    return F.floor(v * k + 0.5) / k


def to_number(c) -> Column:
    """Finite number or null."""
    v = F.trim(_c(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def fmt_position(c) -> Column:
    """One decimal and a degree sign after rounding to three decimals, ``?`` if unknown.

    The shown digit is that of the exact binary value, exact halves going up in magnitude;
    decimal formatting would round the shortest decimal text instead.
    """
    v = normalize_number(c, 3)
    a = F.abs(v)
    whole = F.floor(a)
    f = a - whole
    tenth = F.floor(f * 10)
    up = ((f * 16 - (2 * tenth + 1)) + f * 4 >= 0).cast("bigint")
    n = whole * 10 + tenth + up
    sign = F.when(v < 0, "-").otherwise("")
    text = F.concat(sign, F.floor(n / 10).cast("string"), F.lit("."), F.pmod(n, F.lit(10)).cast("string"), F.lit("°"))
    return F.when(v.isNull(), "?").otherwise(text)


def record_stamp(ts) -> tuple[Column, Column]:
    """Record date and time."""
    return F.date_format(_c(ts), "yyyy.MM.dd"), F.date_format(_c(ts), "HH:mm")


def is_close(a: Column, b: Column, eps: float = EPS) -> Column:
    return F.abs(a - b) <= eps


def contains_any(c, words) -> Column:
    """True if any of the plain words occurs."""
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(_c(c), F.lit("")).contains(w)
    return out
