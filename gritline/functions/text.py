"""Text expressions: line splitting, stripping, numbering, decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gritline.vocab import LINE_BREAK_CHARS, SNIPPET_CHARS, STRIP_CHARS

# A break at the very end closes the last line instead of opening an empty one.
# The group is atomic so that a final CR LF is never cut in two.
_SEPARATOR = f"(?>\r\n|[{LINE_BREAK_CHARS}])(?!\\z)"
_ANY_BREAK = f"\r\n|[{LINE_BREAK_CHARS}]"


def strip(text: Column) -> Column:
    """Trim Unicode white space from both ends."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def end_trim_break(line: Column) -> Column:
    """Drop the line break that :func:`raw_lines` leaves on a last line."""
    return F.rtrim(line, F.lit(LINE_BREAK_CHARS))


def raw_lines(content: Column) -> Column:
    """Array of lines; the last one may still carry its own line break."""
    return F.split(content, _SEPARATOR)


def lines(content: Column) -> Column:
    """Array of lines without breaks; one empty line for empty text."""
    return F.transform(raw_lines(content), end_trim_break)


def newline_breaks(content: Column) -> Column:
    """Rewrite every kind of line break as a plain newline."""
    return F.regexp_replace(content, _ANY_BREAK, "\n")


def line_count(content: Column) -> Column:
    """Newlines plus one: a trailing newline counts as one more line."""
    without = F.replace(content, F.lit("\n"), F.lit(""))
    return (F.length(content) - F.length(without) + 1).cast("int")


def number_lines(content: Column) -> Column:
    """``N| text`` lines, numbers right-justified to the widest one."""

    def numbered(texts: Column) -> Column:
        width = F.length(F.size(texts).cast("string"))
        return F.transform(
            texts, lambda text, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit("| "), text)
        )

    # The lines are a variable of the outer step, so that they are cut once and not for each line.
    return F.array_join(F.get(F.transform(F.array(lines(content)), numbered), F.lit(0)), "\n")


def snippet(text: Column) -> Column:
    return F.substring(strip(text), 1, SNIPPET_CHARS)


def decode_source(raw: Column) -> Column:
    """UTF-8 with replacement characters, CR LF and CR read as newline."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\r\n?", "\n")


def line_class(text: Column, language: Column) -> Column:
    """``blank``, ``comment`` or ``code``."""
    stripped = strip(text)
    comment = F.when(language == "python", stripped.startswith("#")).otherwise(
        stripped.startswith("//") | stripped.startswith("*")
    )
    slash_star = (F.coalesce(language, F.lit("")) != "python") & stripped.startswith("/*")
    return (
        F.when(stripped == "", "blank").when(comment | slash_star, "comment").otherwise("code")
    )


def escape_pipe(text: Column) -> Column:
    """Markdown table escape."""
    return strip(F.replace(text, F.lit("|"), F.lit("\\|")))
