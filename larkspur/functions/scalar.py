"""Column builders: numbers, dates, names and text."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def ptbr_decimal(c: Column) -> Column:
    """'R$ 1.234,56', '-1.234,5', '(12,00)' as numbers; what doesn't parse is 0."""
    s = F.translate(F.trim(c), "−", "-")
    negative = s.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(F.regexp_replace(s, r"R\$|[()\s]", ""), r"\.", "")
    v = F.coalesce(F.regexp_replace(bare, ",", ".").try_cast("decimal(18,4)").cast("double"), F.lit(0.0))
    return F.when(negative, -v).otherwise(v)


def intl_decimal(c: Column) -> Column:
    """'1,234.56' as a number; what doesn't parse is 0."""
    return F.coalesce(F.regexp_replace(F.trim(c), r"[,$\s]", "").try_cast("decimal(18,4)").cast("double"), F.lit(0.0))


def scaled_round(c: Column, places: int) -> Column:
    """A double to so many places as DuckDB has it: scaled, to a whole number, half away from zero, and back. F.round takes the shortest decimal
    that stands for the double, so 81.85725, which scales to 818572.4999999999, is 81.8573 to it and 81.8572 here."""
    return F.round(c * F.lit(10.0**places)) / F.lit(10.0**places)


def any_date(c: Column) -> Column:
    """DD/MM/YYYY, DD-MM-YYYY, D/M/YYYY or ISO; else null."""
    s = F.trim(c)
    day = F.regexp_extract(s, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", 1)
    iso = F.concat_ws("-", F.regexp_extract(s, r"[/-](\d{4})$", 1), F.lpad(F.regexp_extract(s, r"^\d{1,2}[/-](\d{1,2})[/-]", 1), 2, "0"), F.lpad(day, 2, "0"))
    return F.coalesce(F.when(day != "", iso.try_cast("date")), F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10).try_cast("date")))


def installment(c: Column) -> tuple[Column, Column]:
    """(n, m) of 'PARC n/m', where 1 <= n <= m <= 48 and m >= 2; else nulls."""
    pattern = r"(?i)parc(?:ela)?\s*(\d{1,2})\s*(?:/|de)\s*(\d{1,2})"
    n, m = (F.regexp_extract(c, pattern, i).try_cast("int") for i in (1, 2))
    good = (n >= 1) & (n <= m) & (m >= 2) & (m <= 48)
    return F.when(good, n), F.when(good, m)


@cache
def _foldings() -> tuple[str, str, str, dict[str, str]]:
    """What compatibility decomposition, without its marks, and case folding make of characters beyond ASCII: those that
    become one letter or digit, what they become, marks (which go), and those that become several characters."""
    one, to, marks, several = [], [], [], {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]):
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        if not folded:
            marks.append(c)
        elif len(folded) == 1 and folded.isascii() and folded.isalnum():
            one.append(c)
            to.append(folded)
        elif len(folded) > 1 and any(x.isascii() and x.isalnum() for x in folded):
            several[c] = folded
    return "".join(one), "".join(to), "".join(marks), several


def fold_key(c: Column) -> Column:
    """Names that differ in case, accents, kinds of quotes and dashes, separators or a .md at the end alone have one key: letters
    and digits of ASCII with a hyphen for each run of others. A name without any has the empty key."""
    one, to, marks, several = _foldings()
    plain = F.translate(F.lower(c), one + marks, to)
    table = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda x: F.coalesce(table[x], x)), "")  # only where there are such
    text = F.when(plain.rlike(f"[{''.join(several)}]"), spelled).otherwise(plain)
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"\.md$", ""), r"[^a-z0-9]+", "-"), F.lit("-"))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), F.lit("-"))


def url_key(c: Column) -> Column:
    """Scheme, www, fragment, query and trailing slash don't count, nor does case."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"^https?://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(s, r"[?#].*$", ""), r"/+$", "")


def strip_html(c: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, common entities back, white space collapsed."""
    s = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


def tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-cased words of letters, digits, '_' and '-', stop words out."""
    t = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_-]+"), lambda x: x != "")
    return F.filter(t, lambda x: ~x.isin(*stop)) if stop else t


def snippet(c: Column, n: int = 240) -> Column:
    return F.left(F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " ")), F.lit(n))


def valid_tag(c: Column) -> Column:
    return c.rlike(r"^[a-z0-9][a-z0-9-]*$")


def pluralised(c: Column) -> Column:
    irregular = F.when(c == "person", "people").when(c == "analysis", "analyses").when(c == "series", "series")
    return irregular.when(c.rlike("[^aeiou]y$"), F.regexp_replace(c, "y$", "ies")).when(c.rlike("(s|x|z|ch|sh)$"), F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))


def due_bucket(due: Column, today: Column) -> Column:
    n = F.datediff(due, today)
    return (
        F.when(due.isNull(), "none").when(n < 0, "overdue").when(n == 0, "today").when(n == 1, "tomorrow")
        .when(due <= F.date_add(F.trunc(today, "week"), 6), "week").when(F.trunc(due, "month") == F.trunc(today, "month"), "month").otherwise("later")
    )


def close_to(a: Column, b: Column, rel: float = 1e-6) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12)) < rel


#: Kinds of assets as spreadsheets name them.
ASSET_TYPES = {"ação": "acao", "acao": "acao", "fii": "fii", "etf": "etf"}


def asset_type(c: Column) -> Column:
    """One name for each kind of asset; others are lower-cased."""
    bare = F.lower(F.trim(c))
    return F.coalesce(*(F.when(bare == k, v) for k, v in ASSET_TYPES.items()), bare)


def broker(c: Column) -> Column:
    return F.lower(F.trim(c))


def crypto_exchange(c: Column) -> Column:
    """Two exchanges are known; all but the one are the other."""
    return F.when(F.lower(F.trim(c)) == "bipa", "bipa").otherwise("mercado_bitcoin")


def crypto_operation(bought: Column, sold: Column) -> Column:
    """What a trade of two assets is, seen from the home currency."""
    return F.when(sold == "BRL", "compra").when(bought == "BRL", "venda").otherwise("swap")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]+", "")
