"""String helpers, all as built-in Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtstats.functions._cols import as_col

# Latin letters with diacritics and their plain-ASCII letters,
# one-to-one by position (the usual Latin-to-ASCII transliteration).
ASCII_FOLD_FROM = (
    "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
    "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
    "ĀāĂăĄąĆćĈĉĊċČčĎďĐđĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĦħĨĩĪīĬĭĮįİı"
    "ĴĵĶķĹĺĻļĽľĿŀŁłŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŦŧ"
    "ŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
)
ASCII_FOLD_TO = (
    "AAAAAACEEEEIIIINOOOOOOUUUUY"
    "aaaaaaceeeeiiiinoooooouuuuyy"
    "AaAaAaCcCcCcCcDdDdEeEeEeEeEeGgGgGgGgHhHhIiIiIiIiIi"
    "JjKkLlLlLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtTt"
    "UuUuUuUuUuUuWwYyYZzZzZz"
)
# Letters that fold to two ASCII letters.
ASCII_FOLD_MULTI = [("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"),
                    ("œ", "oe"), ("Þ", "TH"), ("þ", "th")]

assert len(ASCII_FOLD_FROM) == len(ASCII_FOLD_TO)


def ascii_fold(c) -> Column:
    """Transliterate accented Latin letters to ASCII (``Dončić`` -> ``Doncic``)."""
    out = as_col(c)
    for src, dst in ASCII_FOLD_MULTI:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return F.translate(out, ASCII_FOLD_FROM, ASCII_FOLD_TO)


def nth_word(c, n: int = 1, sep: str = " ") -> Column:
    """n-th piece of ``c`` split on the literal ``sep``; negative n counts
    from the end (-1 = last).  Missing pieces give NULL."""
    parts = F.split(as_col(c), re.escape(sep))
    return F.try_element_at(parts, F.lit(n))


def words_range(c, start: int, end: int, sep: str = " ") -> Column:
    """Pieces ``start..end`` (1-based, negatives from the end) joined by ``sep``."""
    parts = F.split(as_col(c), re.escape(sep))
    size = F.size(parts)
    s = F.lit(start) if start > 0 else size + F.lit(start + 1)
    e = F.lit(end) if end > 0 else size + F.lit(end + 1)
    return F.array_join(F.slice(parts, s, e - s + 1), sep)


def parse_number(c) -> Column:
    """First number in the text, grouping commas ignored: ``"$1,234"`` -> 1234.0,
    ``"30-52, under"`` -> 30.0, ``"TIE"`` -> NULL."""
    cleaned = F.regexp_replace(as_col(c), ",", "")
    num = F.regexp_extract(cleaned, r"-?([0-9]+\.?[0-9]*|\.[0-9]+)", 0)
    return F.when(num == "", F.lit(None).cast("double")).otherwise(num.try_cast("double"))


def title_case(c) -> Column:
    """Capitalise each space-separated word (``"76ers"`` stays ``"76ers"``)."""
    return F.initcap(as_col(c))


def clock_seconds(c) -> Column:
    """``"m:ss"`` game clock -> seconds remaining, as int."""
    col = as_col(c)
    return (F.split_part(col, F.lit(":"), F.lit(1)).try_cast("int") * 60
            + F.split_part(col, F.lit(":"), F.lit(2)).try_cast("int"))


def season_slug(year) -> Column:
    """Start year -> season slug ``1997`` -> ``"1997-98"``."""
    y = as_col(year).cast("int")
    return F.concat(y.cast("string"), F.lit("-"),
                    F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def season_end_year(slug) -> Column:
    """Season slug -> four-digit end year: ``"1999-00"`` -> 2000.

    Uses the full start year, so the century rolls over correctly."""
    return F.substring(as_col(slug), 1, 4).try_cast("int") + 1


def name_override(c, table, default=None) -> Column:
    """Ordered override table: the replacement of the first entry equal to the name,
    else ``default`` (the name itself)."""
    col = as_col(c)
    out = None
    for old, new in table:
        out = F.when(col == old, F.lit(new)) if out is None else out.when(col == old, F.lit(new))
    default = col if default is None else as_col(default)
    return default if out is None else out.otherwise(default)


def height_inches(c, sep: str = "-") -> Column:
    """``"6-7"`` -> 79; anything else is NULL."""
    parts = F.split(as_col(c), sep)
    return F.when(F.size(parts) == 2, parts[0].try_cast("int") * 12 + parts[1].try_cast("int"))


def game_season(game_id, pivot: int = 46) -> Column:
    """First year of the season of a game id whose 4th and 5th of ten digits are the
    year: two digits at or above ``pivot`` are 19xx, others 20xx."""
    two = F.substring(F.lpad(as_col(game_id).cast("string"), 10, "0"), 4, 2).try_cast("int")
    return F.when(two >= pivot, two + 1900).otherwise(two + 2000)


def split_typed(df, col: str, sep: str, into: dict[str, str]):
    """Split a text column into typed columns ``{name: type}``; missing or
    unreadable parts are NULL."""
    parts = F.split(F.col(col), sep)
    return df.withColumns({n: F.get(parts, F.lit(i)).try_cast(t) for i, (n, t) in enumerate(into.items())})
