"""String functions; every one is null for a null input."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..semantics import col

WHITE = r"[\s ]+"


def contains(a, text: str):
    return col(a).contains(text)


def starts_with(a, text: str):
    return col(a).startswith(text)


def ends_with(a, text: str):
    return col(a).endswith(text)


def contains_ignore_case(a, text: str):
    return F.lower(col(a)).contains(text.lower())


def starts_with_ignore_case(a, text: str):
    return F.lower(col(a)).startswith(text.lower())


def ends_with_ignore_case(a, text: str):
    return F.lower(col(a)).endswith(text.lower())


def match(a, pattern: str):
    return col(a).rlike(pattern)


def extract(a, pattern: str, group: int = 1):
    """The group of the first match, null without one."""
    c = col(a)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def replace(a, old: str, new: str):
    return F.replace(col(a), F.lit(old), F.lit(new))


def replace_ignore_case(a, old: str, new: str):
    quoted = "(?i)" + quote(old)
    return F.regexp_replace(col(a), quoted, new.replace("\\", "\\\\").replace("$", "\\$"))


def quote(text: str) -> str:
    """A literal inside a Java regular expression."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def upper(a):
    return F.upper(col(a))


def lower(a):
    return F.lower(col(a))


def capitalize(a):
    c = col(a)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def title(a):
    """First letter of every run of letters upper, the others lower."""
    return F.array_join(F.transform(F.regexp_extract_all(col(a), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def trim(a):
    return F.regexp_replace(col(a), f"^{WHITE}|{WHITE}$", "")


def ltrim(a):
    return F.regexp_replace(col(a), f"^{WHITE}", "")


def rtrim(a):
    return F.regexp_replace(col(a), f"{WHITE}$", "")


def _padded(c: Column, width: int, out: Column) -> Column:
    return F.when(F.length(c) >= width, c).otherwise(out)


def pad_left(a, width: int, fill: str = " "):
    return _padded(col(a), width, F.lpad(col(a), width, fill))


def pad_right(a, width: int, fill: str = " "):
    return _padded(col(a), width, F.rpad(col(a), width, fill))


def zfill(a, width: int):
    return pad_left(a, width, "0")


def center(a, width: int, fill: str = " "):
    """Spare space is split with the smaller half on the left."""
    c = col(a)
    left = F.floor((F.lit(width) - F.length(c)) / 2).cast("int")
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(F.concat(F.repeat(F.lit(fill), left), c), width, fill))


def slice_text(a, start: int, length: int | None = None):
    """From a 0-based start (negative: from the end); empty out of range."""
    c = col(a)
    begin = F.lit(start) if start >= 0 else F.greatest(F.length(c) + start, F.lit(0))
    size = F.length(c) if length is None else F.lit(length)
    return F.when(c.isNotNull(), F.substr(c, begin + 1, size))


def length(a):
    return F.length(col(a))


def count_text(a, text: str):
    """Occurrences that do not overlap; an empty text occurs length + 1 times."""
    c = col(a)
    if not text:
        return F.length(c) + 1
    return ((F.length(c) - F.length(replace(c, text, ""))) / len(text)).cast("int")


def find(a, text: str):
    """0-based position or -1."""
    return F.instr(col(a), text) - 1


def repeat(a, n: int):
    return F.repeat(col(a), n)


def cat(df: DataFrame, name: str, sep: str, order_by: list[str]) -> DataFrame:
    """One row: all values joined in order (the result is one string, so it must fit one)."""
    entry = F.struct(*map(col, order_by), col(name).alias("__v"))
    return df.where(col(name).isNotNull()).agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["__v"]), sep).alias(name))


def split_columns(df: DataFrame, name: str, sep: str, n: int | None = None) -> DataFrame:
    """name_0 ... name_k with trimmed parts; k comes from the data unless given."""
    parts = F.split(col(name), quote(sep))
    k = n if n is not None else (df.agg(F.max(F.size(F.when(col(name).isNotNull(), parts)))).first()[0] or 0)
    return df.withColumns({f"{name}_{i}": F.trim(F.get(parts, F.lit(i))) for i in range(k)})


def normalize_unicode(a, form: str = "NFC"):
    """Unicode normal form (Arrow batches; the JVM functions have none)."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return run(col(a))
