"""Scalar text functions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line terminators of Python's splitlines, as a Java character class and one by one.
_TERMINATORS = r"\n\x0B\f\r\x1C-\x1E\x85\x{2028}\x{2029}"
_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"


def _times(text: Column, part: str) -> Column:
    """How often a fixed part stands in a text; most texts hold few of the parts, and are not split then."""
    return F.when(F.contains(text, F.lit(part)), F.size(F.split(text, part, -1)) - 1).otherwise(0)


def n_lines(text: Column) -> Column:
    """Lines as splitlines counts them: terminators, one more for text behind the last; a null text has none.

    Fixed parts are sought one by one, as one expression for all of them takes many times as long.
    """
    ends = sum((_times(text, end) for end in _ENDS), F.lit(0)) - _times(text, "\r\n")
    ended = F.lit(False)
    for end in _ENDS:
        ended = ended | F.endswith(text, F.lit(end))
    return F.coalesce(ends + F.when((text != "") & ~ended, 1).otherwise(0), F.lit(0)).cast("int")


def normalise_newlines(text: Column) -> Column:
    """CRLF and CR become LF, as text mode reads them."""
    return F.regexp_replace(text, "\r\n?", "\n")


def decode_utf8(data: Column) -> Column:
    """Bytes to text; invalid bytes become U+FFFD, newlines LF."""
    return normalise_newlines(F.make_valid_utf8(data.cast("string")))


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based character offset; only LF ends lines."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def snippet(line: Column) -> Column:
    return F.substring(F.regexp_replace(line, r"^\s+|\s+$", ""), 1, 200)


def simple_type_name(name: Column) -> Column:
    """Without type arguments and qualifiers."""
    bare = F.trim(F.substring_index(name, "<", 1))
    return F.element_at(F.split(bare, r"\."), -1)


def strip_html_comments(html: Column) -> Column:
    """Comments as spaces; length and line breaks stay."""
    comment = r"(?s)<!--.*?-->"
    blank = F.transform(F.regexp_extract_all(html, F.lit(comment), 0), lambda c: F.regexp_replace(c, r"[^\n]", " "))
    return F.array_join(F.zip_with(F.split(html, comment, -1), blank, lambda plain, c: F.concat(plain, F.coalesce(c, F.lit("")))), "")


def split_lines(text: Column) -> Column:
    """Lines without terminators, an empty one behind the last terminator."""
    return F.split(text, rf"\r\n|[{_TERMINATORS}]", -1)


def kebab_key(name: Column) -> Column:
    """What a kebab-case tag is looked up by: camel case and lower case agree without hyphens."""
    return F.lower(F.replace(name, F.lit("-"), F.lit("")))


def arity_label(arity: Column) -> Column:
    return F.when(arity == 0, "").when(arity == 1, "1 arg").otherwise(F.concat(arity.cast("string"), F.lit(" args")))


def node_radius(degree: Column, most: Column) -> Column:
    """10 to 30, by the square root of the degree."""
    share = F.sqrt(degree.cast("double")) / F.sqrt(F.greatest(most, F.lit(1)).cast("double"))
    return F.greatest(F.lit(10.0), F.least(F.lit(30.0), F.lit(10.0) + F.lit(20.0) * share))


def escape_markup(text: Column) -> Column:
    """The five characters that markup reserves."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def slug(name: Column) -> Column:
    """Letters, digits, dot, dash and underscore; anything else becomes an underscore."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def language_of(name: Column) -> Column:
    """A bundle file's language by extension."""
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.when(ext == "js", "javascript").when(ext == "html", "html").when(ext == "css", "css").when(ext == "json", "json").when(ext.isin("xml", "svg"), "xml").otherwise("plaintext")
