"""Text cleaning, hashing and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskloom.functions import lexicons as L

# The characters that count as white space at the ends of a text.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim all Unicode white space at both ends."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def clean_markup(c) -> Column:
    """Replace markup blocks by a marker, links and emphasis by their text, squeeze blanks."""
    t = F.coalesce(_col(c), F.lit(""))
    # Markup patterns and replacements, in this order.
    for pattern, replacement in [
        (r"(?s)\{code[^}]*\}.*?\{code\}", "[CODE BLOCK]"),
        (r"(?s)\{quote\}.*?\{quote\}", "[QUOTE]"),
        (r"(?s)\{panel[^}]*\}.*?\{panel\}", "[PANEL]"),
        (r"\[([^|\]]+)\|[^\]]+\]", "$1"),
        (r"\*([^*]+)\*", "$1"),
        (r"_([^_]+)_", "$1"),
        (r"\^([^\^]+)\^", "$1"),
        (r"~([^~]+)~", "$1"),
        (r"(?U)\s+", " "),
    ]:
        t = F.regexp_replace(t, pattern, replacement)
    return F.trim(t)


def cut(c, n: int) -> Column:
    """First ``n`` characters, followed by three dots when something was cut."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def embedding_text(max_chars: int = 2048, description_chars: int = 300) -> Column:
    """Text handed to an embedding model, built from the work-item columns."""
    filled = lambda c: F.when(F.length(c) > 0, F.col(c))
    listed = lambda name, c: F.when(
        F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, ", "))
    )
    text = F.concat_ws(
        " | ",
        F.concat(F.lit("Title: "), F.col("summary")),
        F.concat(F.lit("Type: "), F.col("issue_type")),
        F.concat(F.lit("Status: "), F.col("status")),
        F.when(
            F.length("description") > 0,
            F.concat(F.lit("Description: "), cut(clean_markup("description"), description_chars)),
        ),
        listed("Components", "components"),
        listed("Labels", "labels"),
        F.concat(F.lit("Epic: "), filled("epic_key")),
        F.concat(F.lit("Parent: "), filled("parent_key")),
    )
    return cut(text, max_chars)


def model_input(c, prefix: str, n: int = 512) -> Column:
    """Instruction prefix and the first ``n`` characters of the text."""
    return F.concat(F.lit(prefix), F.substring(_col(c), 1, n))


def iso_time(c) -> Column:
    """ISO form of a timestamp, with microseconds only when there are any."""
    c = _col(c)
    micros = F.date_format(c, "SSSSSS")
    seconds = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))


def content_hash(with_status: bool = False) -> Column:
    """MD5 over the content columns; the form with status is the one of chunk metadata."""
    description = F.coalesce("description", F.lit(""))
    if with_status:
        parts = [F.col("summary"), description, F.col("status"), iso_time("updated")]
    else:
        parts = [F.col("key"), F.col("summary"), description, iso_time("updated")]
    return F.md5(F.concat_ws("|", *parts))


def chunk_name(key="source_key", kind="chunk_type", index="chunk_index") -> Column:
    """Readable chunk id."""
    return F.concat_ws("_", _col(key), _col(kind), _col(index).cast("string"))


def chunk_id(key="source_key", kind="chunk_type", index="chunk_index") -> Column:
    """First 12 hex digits of the MD5 of the readable id."""
    return F.substring(F.md5(chunk_name(key, kind, index)), 1, 12)


def project_key(key="key") -> Column:
    key = _col(key)
    return F.when(F.contains(key, F.lit("-")), F.split_part(key, F.lit("-"), F.lit(1))).otherwise("UNKNOWN")


def op_category(operation="operation") -> Column:
    """Text before the first dot."""
    return F.substring_index(_col(operation), ".", 1)


def split_sentences(c) -> Column:
    """Sentences end at ``.!?`` before white space and a capital; abbreviations do not."""
    dot = "###DOT###"
    # anchored on the dot: the look-behind runs at dots only
    guarded = F.regexp_replace(_col(c), f"(?<={'|'.join(L.ABBREVIATIONS)})\\.", dot)
    parts = F.split(guarded, r"(?<=[.!?])(?U:\s)+(?=[A-Z])", -1)
    restored = F.transform(parts, lambda s: strip(F.replace(s, F.lit(dot), F.lit("."))))
    return F.filter(restored, lambda s: s != "")
