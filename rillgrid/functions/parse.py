"""Column parsers for job specifications and identifiers. A value that does not parse gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def duration_seconds(text: Column) -> Column:
    """`[D-]HH:MM:SS` as seconds."""
    p = r"^(?:(\d+)-)?(\d+):(\d{2}):(\d{2})$"
    part = lambda i: _group(text, p, i).cast("long")
    return F.coalesce(part(1), F.lit(0)) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)


def memory_mb(text: Column) -> Column:
    """`1000` (MB), `10G`, `512M`, `4096K` or `1T` as whole MB."""
    p = r"^(\d+)([KMGT]?)$"
    n, unit = _group(text, p, 1).cast("long"), F.regexp_extract(text, p, 2)
    return F.when(unit == "K", F.floor(n / 1024)).when(unit == "G", n * 1024).when(unit == "T", n * 1024 * 1024).otherwise(n)


def array_spec(text: Column) -> Column:
    """`lo-hi[%most]` as struct<lo, hi, most>."""
    p = r"^(\d+)-(\d+)(?:%(\d+))?$"
    lo, hi, most = (_group(text, p, i).cast("int") for i in (1, 2, 3))
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"), most.alias("most")))


def gpu_spec(text: Column) -> Column:
    """`2`, `type:2` or `2,VramPerGpu:40G` as struct<kind, count, vram_mb>."""
    p = r"^(?:([a-z]\w*):)?(\d+)(?:,VramPerGpu:(\d+[KMGT]?))?$"
    return F.when(text.rlike(p), F.struct(_group(text, p, 1).alias("kind"), _group(text, p, 2).cast("int").alias("count"), memory_mb(_group(text, p, 3)).alias("vram_mb")))


def dependency(text: Column) -> Column:
    """`type:id` or `singleton` as struct<kind, job_id>."""
    p = r"^(afterok|afterany|afternotok|aftercorr|singleton)(?::(\d+))?$"
    return F.when(text.rlike(p), F.struct(_group(text, p, 1).alias("kind"), _group(text, p, 2).cast("long").alias("job_id")))


def output_name(pattern: Column, name: Column, job_id: Column, task_id: Column) -> Column:
    """%x, %j, %A and %a of an output pattern filled in."""
    out = F.replace(pattern, F.lit("%x"), name)
    for mark, value in (("%j", job_id), ("%A", job_id), ("%a", F.coalesce(task_id.cast("string"), F.lit("")))):
        out = F.replace(out, F.lit(mark), value.cast("string"))
    return out


def trace_id(text: Column) -> Column:
    """`NET.STA.LOC.CHA` as struct<network, station, location, channel, band, instrument, component>."""
    part = lambda i: F.get(F.split(text, r"\."), F.lit(i))
    letter = lambda i: F.substring(part(3), i, 1)
    return F.struct(part(0).alias("network"), part(1).alias("station"), part(2).alias("location"), part(3).alias("channel"), letter(1).alias("band"), letter(2).alias("instrument"), letter(3).alias("component"))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def exact_mean(x: Column, digits: int = 4) -> Column:
    """Mean of numbers of fixed decimals, by an exact sum, so that it does not depend on the order of rows."""
    return F.sum(x.cast(f"decimal(28,{digits})")).cast("double") / F.count(x)


def elapsed(seconds: Column, limit: int) -> list[Column]:
    """Whole minutes, the seconds left, and the seconds over a limit."""
    return [F.floor(seconds / 60).cast("long").alias("minutes"), F.pmod(seconds, F.lit(60)).cast("long").alias("seconds"), F.greatest(seconds - limit, F.lit(0)).cast("long").alias("over")]


def path_parts(path: Column) -> list[Column]:
    """The folder and the name of a path; a path without a slash has the empty folder."""
    return [F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(path, r"([^/]*)$", 1).alias("name")]


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole of whole numbers, rounded half up in exact decimals; null for a whole of 0."""
    share = (part.cast("decimal(20,0)") * 100).cast("decimal(24,0)") / F.nullif(whole, F.lit(0)).cast("decimal(12,0)")
    return F.round(share, digits).cast("double")
