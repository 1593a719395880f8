"""Display and cleaning functions over text columns. Null and empty are treated alike where their callers do so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends (SQL's trim only knows the space)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank(x: Column) -> Column:
    """True for null and the empty string."""
    return x.isNull() | (x == "")


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def compact_number(n: Column) -> Column:
    """1500 as 1.5K, 2400000 as 2.4M; below 1000 as it is; null: ''. 999950 becomes 1000K, without a carry."""
    n = n.cast("long")

    def scaled(divisor: int, suffix: str) -> Column:
        shown = F.replace(F.format_number(n / F.lit(float(divisor)), 1), F.lit(","), F.lit(""))
        return F.concat(F.regexp_replace(shown, r"\.0$", ""), F.lit(suffix))

    size = F.abs(n)
    return F.when(n.isNull(), "").when(size < 1000, n.cast("string")).when(size >= 10**9, scaled(10**9, "B")).when(size >= 10**6, scaled(10**6, "M")).otherwise(scaled(10**3, "K"))


def stats_line(counters: list[tuple[str, Column]]) -> Column:
    """Labels with compact counts joined by ' · '; counters that are zero or null are left out."""
    return F.concat_ws(" · ", *[F.when(n > 0, F.concat(F.lit(f"{label} "), compact_number(n))) for label, n in counters])


def escape_html(x: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def plain_text(x: Column) -> Column:
    """Literal ``\\n`` becomes a line end; escaped, with ``<br>`` for line ends."""
    x = F.replace(or_empty(x), F.lit("\\n"), F.lit("\n"))
    x = F.regexp_replace(x, "\r\n|\r", "\n")
    return F.replace(escape_html(x), F.lit("\n"), F.lit("<br>"))


def break_after_commas(x: Column) -> Column:
    return F.array_join(F.transform(F.split(or_empty(x), ", ", -1), escape_html), ",<br>")


def defang_url(x: Column) -> Column:
    return F.replace(or_empty(x), F.lit("https"), F.lit("httpx"))


def joined_title(*parts: Column, first: str = "Evidence") -> Column:
    """'Evidence <part> · <part> ...' without empty parts."""
    head, *rest = parts
    return F.concat_ws(" · ", F.concat_ws(" ", F.lit(first), F.nullif(head, F.lit(""))), *[F.nullif(p, F.lit("")) for p in rest])


def position_label(label: Column, checked: Column) -> Column:
    """The label, with the date of its check if there is one; null or empty label: ''."""
    dated = F.concat(label, F.lit(" (As of: "), F.date_format(checked, "yyyy-MM-dd"), F.lit(")"))
    return F.when(blank(label), "").when(checked.isNull(), label).otherwise(dated)


def region_label(kind: Column, name: Column, whole: str = "Bund") -> Column:
    return F.when(kind == "country", whole).otherwise(or_empty(name))


def prefixed(prefix: str, key: Column, missing: str | None = None) -> Column:
    """A constant prefix and an id; ``missing`` where the id is."""
    key = F.nullif(key.cast("string"), F.lit(""))
    return F.coalesce(F.concat(F.lit(prefix), key), F.lit(missing))


#: Addresses that ids are appended to.
WIKIDATA = "https://www.wikidata.org/wiki/"
WIKIPEDIA_DE = "https://www.wikidata.org/wiki/Special:GoToLinkedPage/de/"
POLITICIAN = "https://www.abgeordnetenwatch.de/politician/"
MANDATE = "https://www.abgeordnetenwatch.de/api/v2/candidacies-mandates/"


#: A letter that stood in a single manuscript (of the plane that the JVM keeps in one unit).
_HELD = "\ua66e"


def topic_text(x: Column) -> Column:
    """Text for an embedding model: without URLs and the signs of mentions and tags, white space tidied line by line."""
    x = F.regexp_replace(x, r"(?iuU)(?:https?://|www\.)\S+", " ")
    # a tag's underscores become a letter that texts do not have, so that the tag still ends where it did; then blanks
    # (one after another from the sign on: looking back from every place costs far too much on whole texts, and needs a bound)
    x = F.regexp_replace(x, r"(?U)((?<!\w)[@#][^\W_]*|\G(?<=_)[^\W_]*)_", "$1" + _HELD)
    x = F.regexp_replace(x, r"(?U)(?<!\w)[@#](?=\w)", "")
    x = F.replace(x, F.lit(_HELD), F.lit(" "))
    x = F.regexp_replace(x, r"(?U)[^\S\n]+", " ")
    x = F.regexp_replace(x, r"(?m)^ | $", "")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def chapter_display(path: Column, label: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(path, " > "), F.lit("")), label, F.lit(""))
