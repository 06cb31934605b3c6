"""Properties of file paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.vocabulary import GENERATED, KINDS, PACKAGES, SECRET_EXTENSIONS, SECRET_NAMES, TEXT_EXTENSIONS


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def depth(path: Column) -> Column:
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("int")


def suffix(name: Column) -> Column:
    """The lower-cased extension with its dot; a leading dot starts none, and neither does a trailing one."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def kind_of(name: Column, folder: Column | None = None) -> Column:
    extension = F.substring(suffix(name), 2, 1000)
    kind = F.lit("other")
    for k in reversed(KINDS):
        kind = F.when(extension.isin(KINDS[k]), k).otherwise(kind)
    return kind if folder is None else F.when(folder, "folder").otherwise(kind)


def sensitive(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(SECRET_NAMES) | low.startswith(".env.") | suffix(name).isin(SECRET_EXTENSIONS)


def is_text(name: Column) -> Column:
    return (kind_of(name) == "code") | suffix(name).isin(TEXT_EXTENSIONS)


def out_of_scope(path: Column) -> Column:
    """Whether a segment above the name, or the name if hidden, puts an entry out of scope by default."""
    segments = F.split(path, "/")
    above = F.slice(segments, 1, F.size(segments) - 1)
    closed = F.exists(above, lambda s: s.startswith(".") | s.isin(GENERATED) | F.lower(s).rlike("(" + "|".join(x.replace(".", r"\.") for x in PACKAGES) + ")$"))
    return closed | name_of(path).startswith(".")


def size_label(size: Column) -> Column:
    """Bytes in B, KB, MB or GB by powers of 1024."""
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, F.concat(F.format_number(size / 1024, 1), F.lit(" KB"))).when(
        size < 1 << 30, F.concat(F.format_number(size / (1 << 20), 1), F.lit(" MB"))
    ).otherwise(F.concat(F.format_number(size / (1 << 30), 1), F.lit(" GB")))


def duration_label(seconds: Column) -> Column:
    """Whole milliseconds under a second, else seconds with one digit."""
    short = F.concat(F.floor(seconds * 1000 + 0.5).cast("string"), F.lit(" ms"))
    return F.when(seconds < 1, short).otherwise(F.concat(seconds.cast("decimal(18,1)").cast("string"), F.lit(" s")))


def day_label(modified: Column) -> Column:
    """The day of a time in seconds, in the session's time zone; null if it isn't known."""
    return F.date_format(F.timestamp_seconds(modified), "yyyy-MM-dd")


def of_kind(kind: Column, wanted: str) -> Column:
    """Whether an entry is shown under a filter by kind, or under ``all``."""
    return F.lit(True) if wanted == "all" else kind == wanted


def allowed(actions, hits):
    """Actions on paths of the latest results; all others are dropped."""
    return actions.join(hits.select("path"), "path", "left_semi")
