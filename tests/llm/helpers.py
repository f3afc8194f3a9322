"""Small tables and plain versions of the operators' rules."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, _id string, size int, fp long, digest string, text_1 string, `key` string")


def words(text):
    return WORD.findall(text or "")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def table(spark, rows):
    """Documents from (doc_id, text[, source[, lang]]), with more columns whose names operators might use themselves."""
    full = []
    for r in rows:
        doc_id, text, source, lang = (*r, *("s1", "en")[len(r) - 2 :]) if len(r) < 4 else r
        full.append((doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2, "d", "t", None))
    return spark.createDataFrame(full, DOCS).repartition(3)


LONG = " ".join(f"word{i % 7919}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ODD = [
    (1, None),
    (2, ""),
    (3, "  \t\n "),
    (4, "One two three"),
    (5, "one TWO three"),
    (5, "one TWO three"),
    (6, LONG),
    (7, LONG),
    (8, "été naïve ÉTÉ straße 漢字 🎉 text"),
    (9, "a b\x0bc\x0cd e f"),
    (10, f"before it {PASSAGE} after it"),
    (11, f"{PASSAGE} and other words"),
    (12, None, None, None),
    (None, "no id one two three four five six seven eight nine ten eleven", "s2", None),
    (None, "no id one two three four five six seven eight nine ten eleven", "s2", None),
    (13, "line\nline\nother\nline", "s3", "fr"),
    (14, "x" * 70_000),
]
