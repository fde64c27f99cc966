"""Column functions over strings.

White space and line breaks are written out as classes of code points, the same
in Spark and in the SQL of the checks, because each engine's own \\s differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all scripts (29 code points).
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
#: Line breaks.
NL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: White space at the ends, as a pattern, for SQL.
EDGES = f"^{WS}+|{WS}+$"
#: The same white space as characters.
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Its ASCII part, the rest, and line breaks other than \\n, as characters.
WS_ASCII, WS_OTHER = ("".join(c for c in WS_CHARS if c.isascii() == ascii) for ascii in (True, False))
NL_CHARS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
PAGE_NUMBER = rf"^[-–—]?{WS}*[0-9]{{1,4}}{WS}*[-–—]?{WS}*{NOT_WS}{{0,20}}$"


def sanitised(c: Column) -> Column:
    """Without control characters other than tab and line breaks."""
    return F.regexp_replace(c, CONTROL, "")


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), where c is computed once a row however often use names it: each branch of a CASE would compute it anew."""
    return F.transform(F.array(c), use)[0]


def each_replaced(c: Column, chars: str, by: str) -> Column:
    """c with each of some characters replaced."""
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit(by))
    return c


def compare_form(c: Column) -> Column:
    """For recall: no white space, case kept. ASCII's goes by plain search, faster than a pattern, and only other texts are searched for the rest."""
    return once(each_replaced(c, WS_ASCII, ""), lambda x: F.when(F.length(x) == F.octet_length(x), x).otherwise(each_replaced(x, WS_OTHER, "")))


def match_form(c: Column) -> Column:
    """For keyword matching: no white space, lower case."""
    return F.lower(compare_form(c))


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return stripped(F.regexp_replace(c, f"{WS}+", " "))


def clean_lines(c: Column) -> Column:
    """Array of stripped lines that are not blank. Breaks become \\n by plain search; those of two characters leave a blank line more."""
    return F.filter(F.transform(F.split(each_replaced(c, NL_CHARS, "\n"), "\n", -1), stripped), lambda x: x != "")


def is_page_number(c: Column) -> Column:
    """A page number, with or without dashes, and up to 20 characters after it."""
    return stripped(c).rlike(PAGE_NUMBER)


def any_of(c: Column, words: list[str]) -> Column:
    """Whether c contains any of the words; none of them: false."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def embed_text(title: Column, text: Column) -> Column:
    """Text with its title before it, unless that is empty or in the text already."""
    title = F.coalesce(title, F.lit(""))
    return F.when((title == "") | F.contains(text, title), text).otherwise(F.concat(title, F.lit("\n"), text))


def preview(text: Column, size: int = 200) -> Column:
    return F.translate(F.substring(text, 1, size), "\n", " ")


def quote(text: Column, size: int = 200) -> Column:
    """The first characters, marked where more follow."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def chunk_name(stem: Column, number: Column) -> Column:
    return F.format_string("%s_%04d", stem, number)


def page_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(first.cast("string"), F.lit("p"))).otherwise(
        F.concat(first.cast("string"), F.lit("~"), last.cast("string"), F.lit("p"))
    )


def file_stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def source_pdf(path: Column) -> Column:
    """The PDF that a file of pages was made of: its name with .pdf for the ending _pages.json; other names stay."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"_pages\.json$", ".pdf")


def chunks_file(path: Column) -> Column:
    """The file of chunks that belongs to a file of pages: its name with _chunks.json for the ending _pages.json; other names stay."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"_pages\.json$", "_chunks.json")


def document_stem(path: Column) -> Column:
    """A document's name from that of its file of pages, chunks or embeddings, or its PDF."""
    return F.regexp_replace(file_stem(path), "_(pages|chunks|embeddings)$", "")


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)
