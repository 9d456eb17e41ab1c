"""Clean forms of the mixed notations of names, dates, statuses and article numbers (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks and marks that carry no meaning at either end of a value.
BLANK = r"\s\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2060}\x{3000}\x{FEFF}"
STATUSES = ("有效", "已修订")
# Numerals and their digits, in the same order.
NUMERALS = "０１２３４５６７８９〇零一二两三四五六七八九壹贰叁肆伍陆柒捌玖拾佰仟"
DIGITS = "0123456789001223456789123456789十百千"


def strip(c: Column) -> Column:
    """Without blanks at both ends, the wide, hard and zero-width ones included."""
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def clean_name(c: Column) -> Column:
    """A law's name without book-title marks and outer blanks; null if nothing is left.

    Marks inside the name stay, as in a law about another law.
    """
    s = F.regexp_replace(c, f"^[{BLANK}《》〈〉]+|[{BLANK}《》〈〉]+$", "")
    return F.nullif(s, F.lit(""))


def clean_date(c: Column) -> Column:
    """``YYYY-MM-DD`` of a date in any of the notations; null if it tells no valid date."""
    s = F.translate(strip(c), NUMERALS[:10], DIGITS[:10])
    s = F.regexp_replace(s, r"^(\d{4})\s*[-./年]\s*(\d{1,2})\s*[-./月]\s*(\d{1,2})\s*日?(?:[ T].*)?$", "$1-$2-$3")
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.date_format(F.try_to_date(s, "yyyy-M-d"), "yyyy-MM-dd")


def clean_status(c: Column) -> Column:
    """One of ``STATUSES``; null for anything else, which tells nothing."""
    s = strip(c)
    return F.when(s.isin(*STATUSES), s)


# How places that Chinese numerals leave out are filled, in this order.
PLACES = (
    (r"(^|[百千万])0?十", "$11十"), (r"十(?=\D|$)", "0"), (r"十", ""),
    (r"百0?(\d)$", "0$1"), (r"百(?=\D|$)", "00"), (r"百0?(\d)(?=\D)", "0$1"), (r"百", ""),
    (r"千0?(\d\d)$", "0$1"), (r"千0?(\d)$", "00$1"), (r"千(?=\D|$)", "000"), (r"千", ""),
    (r"万0?(\d\d\d)$", "0$1"), (r"万0?(\d\d)$", "00$1"), (r"万0?(\d)$", "000$1"), (r"万$", "0000"), (r"万", ""),
)


def cn_number(c: Column) -> Column:
    """The value (long) of Chinese numerals below 亿, or of plain digits; null if ``c`` is neither.

    The numerals become digits and the places they leave out are filled with zeros, from the tens
    up; one chain of replacements, so that ``c`` is evaluated once.
    """
    s = F.translate(c, NUMERALS, DIGITS)
    for written, filled in PLACES:
        s = F.regexp_replace(s, written, filled)
    return s.try_cast("long")


def article_key(c: Column) -> Column:
    """The number of an article in any notation, as a string; a paragraph (款) behind it is ignored.

    ``第十三条``, ``第 13 条``, ``１３`` and ``十三条第二款`` all give ``13``; ``第十三条之一`` gives ``13之1``.
    What holds no number comes back without blanks; null, empty and blank give null.
    """
    s = F.regexp_replace(c, f"[{BLANK}]+", "")
    body = F.regexp_extract(s, r"^第?([0-9０-９〇零一二两三四五六七八九十百千万壹贰叁肆伍陆柒捌玖拾佰仟]+)(?:条|$)", 1)
    sub = F.regexp_extract(s, r"条之([0-9０-９一二三四五六七八九十]+)", 1)
    number = cn_number(F.nullif(body, F.lit(""))).cast("string")
    second = F.coalesce(F.concat(F.lit("之"), cn_number(F.nullif(sub, F.lit(""))).cast("string")), F.lit(""))
    return F.coalesce(F.concat(number, second), F.nullif(s, F.lit("")))
