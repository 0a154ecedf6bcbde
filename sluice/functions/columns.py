"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def java_hash(col: Column) -> Column:
    """Java ``String.hashCode`` as an unsigned 32-bit LONG (UTF-16 units, polynomial of 31)."""
    units = F.flatten(F.transform(F.split(col, ""), lambda ch: _utf16_units(F.ascii(ch).cast("long"))))
    return F.aggregate(units, F.lit(0).cast("long"), lambda acc, u: F.pmod(acc * 31 + u, F.lit(1 << 32)))


def _utf16_units(code: Column) -> Column:
    """Code point to its one or two UTF-16 units; the empty string has none."""
    rest = code - 0x10000
    return (
        F.when(code == 0, F.array().cast("array<bigint>"))
        .when(code < 0x10000, F.array(code))
        .otherwise(F.array(F.floor(rest / 1024) + 0xD800, F.pmod(rest, F.lit(1024)) + 0xDC00))
    )


def shard_of(col: Column, n: int) -> Column:
    """Shard number in ``[0, n)``: hash with the sign bit cleared, modulo ``n``."""
    return F.pmod(java_hash(col).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(n)).cast("int")


def _trim_fraction(col: Column) -> Column:
    """Drop trailing zero digits of a six-digit fraction, and the dot if none is left."""
    return F.rtrim(F.rtrim(col, F.lit("0")), F.lit("."))


def iso_datetime(ts: Column) -> Column:
    """Timestamp as ISO text with a space; seconds always shown, zero fraction digits dropped."""
    return _trim_fraction(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def iso_time(micros: Column) -> Column:
    """Microseconds since midnight as ISO time text."""
    seconds = F.floor(micros / 1_000_000).cast("long")
    return _trim_fraction(
        F.format_string(
            "%02d:%02d:%02d.%06d",
            F.floor(seconds / 3600), F.pmod(F.floor(seconds / 60), F.lit(60)), F.pmod(seconds, F.lit(60)),
            F.pmod(micros, F.lit(1_000_000)),
        )
    )


def _keep(col: Column, head: int, tail: int) -> Column:
    """Stars between ``head`` leading and ``tail`` trailing characters; all stars if too short."""
    n = F.length(col)
    covered = F.concat(
        F.substring(col, 1, head), F.repeat(F.lit("*"), n - head - tail), F.substring(col, n - tail + 1, F.lit(tail))
    )
    return F.when(n < head + tail, F.repeat(F.lit("*"), n)).otherwise(covered)


def _mask_general(col: Column) -> Column:
    n = F.length(col)
    return (
        F.when(n < 3, F.repeat(F.lit("*"), n)).when(n < 6, _keep(col, 1, 1)).otherwise(_keep(col, 2, 2))
    )


def _mask_email(col: Column) -> Column:
    at = F.instr(col, "@")
    return F.when(
        at > 1, F.concat(F.substring(col, 1, 1), F.repeat(F.lit("*"), at - 2), F.substring(col, at, F.length(col)))
    ).otherwise(col)


# Mask type -> rule (kept leading / trailing characters, or all hidden).
MASKS = {
    "GENERAL": _mask_general,
    "NAME": lambda c: _keep(c, 1, 0),
    "PHONE": lambda c: _keep(c, 4, 2),
    "TEL": lambda c: _keep(c, 3, 4),
    "EMAIL": _mask_email,
    "ID_CARD": lambda c: _keep(c, 2, 2),
    "BANK_CARD": lambda c: _keep(c, 4, 4),
    "PASSWORD": lambda c: F.repeat(F.lit("*"), F.length(c)),
}


def mask(col: Column, kind: str) -> Column:
    """Hide part of a text; null and empty text stay as they are."""
    if kind not in MASKS:
        raise ValueError(f"unknown mask type {kind!r}; use one of {sorted(MASKS)}")
    return F.when(F.length(col) > 0, MASKS[kind](col)).otherwise(col)


def truncate_text(col: Column, max_len: int | None) -> Column:
    """Cut a text to ``max_len`` characters and say how many were cut."""
    if max_len is None or max_len == -1:
        return col
    if max_len == 0:
        return F.lit(None).cast("string")
    cut = (F.length(col) - max_len).cast("string")
    # Fixed value: the suffix of a cut text.
    suffix = F.concat(F.lit("......["), cut, F.lit("个字符被截断]"))
    return F.when(F.length(col) > max_len, F.concat(F.substring(col, 1, max_len), suffix)).otherwise(col)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100 * part / whole`` rounded half up, as a DECIMAL; null when ``whole`` is zero."""
    ratio = (part.cast("decimal(18,0)") * 100) / F.nullif(whole.cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    return F.round(ratio, digits).cast(f"decimal(9,{digits})")


def total_cost(cost: Column) -> Column:
    """Sum of costs at full scale, rounded once, as DECIMAL(18,2)."""
    return F.round(F.sum(cost.cast("decimal(28,8)")), 2).cast("decimal(18,2)")


def average_cost(cost: Column) -> Column:
    """Sum of costs at full scale over the number of rows, rounded once, as DECIMAL(18,2)."""
    return F.round(F.sum(cost.cast("decimal(28,8)")) / F.count(F.lit(1)).cast("decimal(18,0)"), 2).cast("decimal(18,2)")


def render_template(template: Column, params: Column) -> Column:
    """Replace ``${key}`` by ``params[key]``; a missing or null value shows as nothing.

    Text after an opening mark without a closing brace is kept unchanged.
    """
    pieces = F.split(template, r"\$\{")

    def fill(piece: Column) -> Column:
        end = F.instr(piece, "}")
        value = F.coalesce(F.try_element_at(params, F.trim(F.substring(piece, F.lit(1), end - 1))), F.lit(""))
        return F.when(end > 0, F.concat(value, F.substring(piece, end + 1, F.length(piece)))).otherwise(
            F.concat(F.lit("${"), piece)
        )

    return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), fill), ""))
