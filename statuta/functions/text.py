"""Text expressions that run inside Spark's own code: cleaning, tokens, windows, metadata of titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDEOGRAPH = "一-鿿"


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, then every two neighbouring ideographs; empty for null."""
    low = F.lower(c)
    found = F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), F.regexp_extract_all(low, F.lit(f"(?=([{IDEOGRAPH}]{{2}}))"), F.lit(1)))
    return F.coalesce(found, F.array().cast("array<string>"))


def clean_text(c: Column) -> Column:
    """NUL to blank, lines without outer white space, several empty lines to one, none at the ends."""
    s = F.regexp_replace(c, "\\x00", " ")
    s = F.regexp_replace(s, r"\r\n?", "\n")
    s = F.regexp_replace(s, r"[ \t\f]*\n[ \t\f]*", "\n")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    return F.regexp_replace(s, r"^[ \t\f\n]+|[ \t\f\n]+$", "")


def char_windows(c: Column, size: int = 512, overlap: int = 100) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` behind the last; the one that reaches the end is the last."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    n = F.length(c)
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def articles(c: Column) -> Column:
    """The text cut in front of every article heading; what stands before the first is a piece too, blank pieces are none."""
    marked = F.regexp_replace(c, r"(第[零一二三四五六七八九十百千万\d]+条)", "\u0001$1")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def first_article(c: Column) -> Column:
    return F.regexp_extract(c, r"第[零一二三四五六七八九十百千万\d]+条", 0)


def title_date(c: Column) -> Column:
    """``YYYY-MM-DD`` of a title that ends in ``_YYYYMMDD``, else empty; not checked as a date."""
    d = F.regexp_extract(c, r"_(\d{8})$", 1)
    return F.when(d == "", "").otherwise(F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


def title_law(c: Column) -> Column:
    return F.regexp_replace(c, r"_\d{8}$", "")


def single_tokens(c: Column) -> Column:
    """As ``tokens``, with every single ideograph instead of pairs: the plain analyzer."""
    low = F.lower(c)
    return F.coalesce(F.regexp_extract_all(low, F.lit(f"[a-z0-9]+|[{IDEOGRAPH}]"), F.lit(0)), F.array().cast("array<string>"))


def mapped_score(cosine: Column) -> Column:
    """The store's score of a cosine, clamped to [-1, 1] first: itself from 0 up, else its place in [0, 0.5)."""
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    return F.round(F.when(s >= 0, s).otherwise((s + 1) / 2), 4)


def title_authority(title: Column, path: Column) -> Column:
    """The body that issued a document: what stands before 关于 in the title (four characters or more), else the path's part that ends in 监管局 or 监管分局, else empty."""
    before = F.regexp_replace(F.trim(F.regexp_extract(title, r"^(.*?)关于", 1)), r"(办公室|秘书处)$", "")
    part = F.get(F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p.rlike("监管(分)?局$")), F.lit(0))
    return F.when(F.length(before) >= 4, before).otherwise(F.coalesce(part, F.lit("")))


def without_number(line: Column) -> Column:
    """A list's line without the number in front of it."""
    return F.regexp_replace(line, r"^\s*\d{1,4}\s*[.、）)]\s*", "")
