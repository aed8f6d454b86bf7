"""Strings: coordinates, sizes and durations as people write them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_range(text: str) -> tuple[str, int, int] | None:
    """chr:start-end; None for "all". Commas in numbers are allowed."""
    if text == "all":
        return None
    m = re.fullmatch(r"(.+):([\d,]+)-([\d,]+)", text)
    if not m:
        raise ValueError(f"not a range: {text!r}")
    start, end = (int(x.replace(",", "")) for x in m.groups()[1:])
    if start >= end:
        raise ValueError(f"{text!r}: the start must be below the end")
    return m[1], start, end


def format_range(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def format_bed(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("\t", chrom, start.cast("string"), end.cast("string"))


def first_fields(line: Column, n: int) -> Column:
    """The first n tab-separated fields of a line without its carriage return; null if there are fewer."""
    fields = F.split(F.regexp_replace(line, r"\r+$", ""), "\t")
    return F.when(F.size(fields) >= n, F.slice(fields, 1, n))


def pair_of_file(path: Column) -> tuple[Column, Column]:
    """Chromosomes of a file named prefix.CHROM1.CHROM2.parquet; empty if it isn't."""
    pattern = r"\.([^./]+)\.([^./]+)\.parquet$"
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)


def pretty_duration(seconds: float) -> str:
    if seconds < 1:
        return f"{seconds * 1000:.3f}ms"
    if seconds < 60:
        return f"{seconds:.3f}s"
    minutes, seconds = divmod(seconds, 60)
    if minutes < 60:
        return f"{minutes:.0f}m:{seconds:.3f}s"
    hours, minutes = divmod(minutes, 60)
    return f"{hours:.0f}h:{minutes:.0f}m:{seconds:.3f}s"


_UNITS = {"": 1, "b": 1, "k": 10**3, "kb": 10**3, "m": 10**6, "mb": 10**6, "g": 10**9, "gb": 10**9, "t": 10**12, "tb": 10**12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40}


def parse_size(text: str, least: int = 0) -> int:
    """Bytes of "125MB", "1GiB", ...; below least is refused."""
    m = re.fullmatch(r"\s*([\d.]+)\s*([a-zA-Z]*)\s*", text)
    if not m or m[2].lower() not in _UNITS:
        raise ValueError(f"not a size: {text!r}")
    size = int(float(m[1]) * _UNITS[m[2].lower()])
    if size < least:
        raise ValueError(f"{text} is below {least} bytes")
    return size


def pretty_size(n: int) -> str:
    for unit, name in ((10**12, "TB"), (10**9, "GB"), (10**6, "MB"), (10**3, "KB")):
        if n >= unit:
            return f"{n / unit:.2f}{name}"
    return f"{n}B"
