"""Scalar predicates and conversions of the data model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path components that scans leave out, and those that watching leaves out.
EXCLUDED = (".tidemark", ".git", ".DS_Store")
UNTRACKED = (".tidemark", ".git")
MODE_BITS = 0o777
LONGEST_PATH = 1024
LEAST_INTERVAL = 60


def excluded(path: Column, names: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether any whole component is excluded; .github is not .git."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the path holds any ignore pattern as a substring; each literal can be pushed to the scan."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.contains(p)
    return out


def ignore_patterns(lines: list[str]) -> list[str]:
    """Trimmed lines that aren't empty and no comments."""
    return [x for x in map(str.strip, lines) if x and not x.startswith("#")]


def safe_path(path: Column) -> Column:
    """Relative, at most 1024 bytes, no NUL, no backslash, no empty, ``.`` or ``..`` segment."""
    segments = F.forall(F.split(path, "/", -1), lambda s: ~s.isin("", ".", ".."))
    return (F.octet_length(path) <= LONGEST_PATH) & ~path.contains("\0") & ~path.contains("\\") & segments


def normalised(path: Column, root: Column) -> Column:
    """The path below root with forward slashes."""
    slashes = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashes.startswith(root), F.ltrim(F.substring(slashes, F.length(root) + 1, F.length(slashes)), F.lit("/"))).otherwise(slashes)


def mode_bits(mode: Column) -> Column:
    return mode.bitwiseAND(MODE_BITS)


def ref_name(address: Column) -> Column:
    """A peer's address as the name of its ref; different addresses may get one name."""
    return F.regexp_replace(address, "[^A-Za-z0-9.-]", "_")


def xml_escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def script_escaped(text: Column) -> Column:
    """For a literal in double quotes where only the backslash and the quote are special."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def enumerated(values: Column) -> Column:
    """An array of strings as it is shown: separated by a comma and a space."""
    return F.array_join(values, ", ")


def shell_quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def exit_code(code: Column, signal: Column) -> Column:
    return F.coalesce(code, signal + 128, F.lit(1))


def shown_time(secs: Column) -> Column:
    """Epoch seconds as ``YYYY-MM-DD HH:MM:SSZ``; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(secs), "yyyy-MM-dd HH:mm:ss'Z'")


def civil_date(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def stamp_nanos(secs: Column, nanos: Column) -> Column:
    return secs.cast("long") * 1_000_000_000 + nanos


def interval(secs: Column) -> Column:
    return F.greatest(secs, F.lit(LEAST_INTERVAL))


def is_loopback(address: Column) -> Column:
    host = F.regexp_extract(address, r"^(\[[^\]]*\]|[^:]*)", 1)
    return host.isin("127.0.0.1", "localhost", "[::1]", "::1")
