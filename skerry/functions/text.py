"""Text expressions: tokens, chunk windows, snippets, highlights, formats."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET_CHARS = 200


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks and the letters they decompose to."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain_letters()


def strip_marks(text: Column) -> Column:
    """Latin letters without their marks; free-standing combining marks go too."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{M}", "")


def blank(text: Column) -> Column:
    """Whether a text is null or white space."""
    return F.coalesce(~text.rlike(r"\S"), F.lit(True))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", "")


def white_tokens(text: Column) -> Column:
    """Tokens between white space, none blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased and without marks."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # Texts of ASCII alone, as many bytes as characters, have no marks.
    folded = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, ACCENTED, PLAIN))
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    return F.substring(text, 1, chars)


def join_snippets(parts: Column) -> Column:
    return F.array_join(parts, " ... ")


def _quote_pattern(term: Column) -> Column:
    return F.concat(F.lit(r"(?i)\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _quote_replacement(term: Column) -> Column:
    return F.replace(F.replace(term, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def highlight(text: Column, query: Column, chars: int = SNIPPET_CHARS) -> Column:
    """First ``chars`` characters with each query term marked ``**term**``, term by term, and an ellipsis.

    The query's casing replaces the text's, and later terms see the marks of earlier ones.
    """

    def mark(acc, term):
        bold = F.concat(F.lit("**"), _quote_replacement(term), F.lit("**"))
        return F.regexp_replace(acc, _quote_pattern(term), bold)

    return F.concat(F.aggregate(white_tokens(query), snippet(text, chars), mark), F.lit("..."))


def render_bold(marked: Column) -> Column:
    """Marked text as HTML, without the ellipsis at its end."""
    return F.regexp_replace(F.regexp_replace(marked, r"\.\.\.$", ""), r"\*\*(.+?)\*\*", "<b>$1</b>")


def bold_spans(marked: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(marked, r"\.\.\.$", ""), F.lit(r"\*\*(.+?)\*\*"), F.lit(1))


def card_size(n: Column) -> Column:
    kb = n / F.lit(1024.0)
    return (
        F.when(n <= 0, "--")
        .when(kb < 1024, F.concat(kb.cast("int").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", kb / 1024), F.lit(" MB")))
    )


def file_size(n: Column) -> Column:
    def unit(power, name):
        return F.concat(F.floor(n / F.lit(1024**power)).cast("long").cast("string"), F.lit(name))

    return F.when(n < 1024, unit(0, " B")).when(n < 1024**2, unit(1, " KB")).when(n < 1024**3, unit(2, " MB")).otherwise(unit(3, " GB"))


def card_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def full_date(ms: Column) -> Column:
    return F.when(ms <= 0, "Never").otherwise(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm"))


def clock_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "HH:mm:ss")


def percent_score(score: Column) -> Column:
    return F.concat((score * 100).cast("int").cast("string"), F.lit("%"))


def decimal_score(score: Column) -> Column:
    return F.concat(F.lit("Score: "), F.format_string("%.2f", score))


def latency_band(ms: Column) -> Column:
    return F.when(ms < 200, "good").when(ms < 400, "fair").otherwise("slow")


def is_relevant(score: Column) -> Column:
    return score > 0.75


def cache_key(query: Column) -> Column:
    return F.lower(F.trim(query))


def fallback_tokens(text: Column) -> Column:
    """Lower-cased tokens with all but ASCII letters, digits and underscores taken out."""
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda t: F.regexp_replace(t, "[^a-z0-9_]", "")), lambda t: t != "")
