"""Text functions as Column expressions. Words are runs of letters, digits and underscores, whatever the script."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import lexicons

WORD = r"[\p{L}\p{N}_]+"
NUMBER = r"\d+(?:[.,]\d+)?"
#: Stands for a dot that ends no sentence while sentences are cut. Of the private use area.
_KEPT_DOT = "\ue000"


def _any_of(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def words(text: Column) -> Column:
    """All words, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def keywords(text: Column, stopwords: Sequence[str] = lexicons.STOPWORDS) -> Column:
    """the set of words of three letters or more that are no stopwords."""
    stop = _any_of(stopwords)
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def match_form(text: Column) -> Column:
    """lower-cased, everything but words, spaces and apostrophes as a space, collapsed."""
    return collapsed(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s']", " "))


def quote_form(text: Column) -> Column:
    """Lower-cased and collapsed, everything but words and spaces deleted."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "), r"[^\p{L}\p{N}_\s]", "")


def message_text(text: Column) -> Column:
    """A message's lines without blank ones and ``[kind: name]`` markers, joined by spaces."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x))
    said = F.filter(lines, lambda x: (x != "") & ~(x.startswith("[") & x.endswith("]") & F.contains(x, F.lit(":"))))
    return F.array_join(said, " ")


def sentences(text: Column) -> Column:
    """sentences end at runs of ``.!?`` (which take colons along) or of ``;:``.

    A dot between digits, or behind an abbreviation, ends none. Blank sentences are left out.
    """
    names = "|".join(sorted((a.replace(".", r"\.") for a in lexicons.ABBREVIATIONS), key=len, reverse=True))
    # the dot first, so that only dots are looked behind
    behind = rf"""(?i)\.(?<=(?<![^ \t\n\r])['"()\[\]{{}}·]{{0,4}}(?:{names})['"()\[\]{{}}.:,;!?]{{0,4}}[ \t\n\r"']{{0,4}}\.)"""
    held = F.regexp_replace(F.regexp_replace(text, r"\.(?<=\d\.)(?=\d)", _KEPT_DOT), behind, _KEPT_DOT)
    cut = F.regexp_extract_all(held, F.lit(r"(?s)[^.!?;:]*(?:[.!?][.!?:]*|[;:]+)|[^.!?;:]+$"), F.lit(0))
    return F.filter(F.transform(cut, lambda s: F.trim(F.replace(s, F.lit(_KEPT_DOT), F.lit(".")))), lambda s: s != "")


def numbers(text: Column) -> Column:
    """numbers as they are written."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def number_form(number: Column) -> Column:
    """a decimal comma as a point, without leading zeros."""
    return F.regexp_replace(F.replace(number, F.lit(","), F.lit(".")), r"^0+(?=\d)", "")


def unknown_numbers(generated: Column, source: Column) -> Column:
    """Numbers of ``generated`` that ``source`` lacks, each spelling once, in order."""
    known = F.transform(numbers(source), number_form)
    return F.array_distinct(F.filter(numbers(generated), lambda n: ~F.array_contains(known, number_form(n))))


def function_word_language(text: Column) -> Column:
    """italiano or inglese if its function words are two or more and outweigh the other's 1.5 to 1."""
    found = words(text)
    italian = F.size(F.filter(found, lambda w: F.array_contains(_any_of(lexicons.ITALIAN_WORDS), w)))
    english = F.size(F.filter(found, lambda w: F.array_contains(_any_of(lexicons.ENGLISH_WORDS), w)))
    return F.when((italian >= 2) & (italian > 1.5 * english), "italiano").when((english >= 2) & (english > 1.5 * italian), "inglese").otherwise("misto/indeterminato")


def is_link_line(line: Column) -> Column:
    """P10: nothing but links, images and ``%tokens%``: without them no word is left."""
    rest = F.regexp_replace(F.regexp_replace(line, r"!?\[(?:[^\]\[]|\[[^\]]*\])*\]\([^)]*\)", " "), r"%[^\s%]+%", " ")
    return ~rest.rlike(r"[\p{L}\p{N}_]")


def without_navigation(markdown: Column) -> Column:
    """F16: the lines that are neither blank nor links only; three or more line ends become two."""
    kept = F.filter(F.split(markdown, "\n"), lambda x: (F.trim(x) != "") & ~is_link_line(x))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def unescaped(text: Column) -> Column:
    """The five XML entities and the non-breaking space as characters, ``&amp;`` last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def plain_text(markdown: Column) -> Column:
    """without navigation and markup. Images go first, so that no ``!alt`` stays."""
    text = F.array_join(F.filter(F.split(markdown, "\n"), lambda x: (F.trim(x) != "") & ~is_link_line(x)), "\n")
    text = F.regexp_replace(text, r"!\[(?:[^\]\[]|\[[^\]]*\])*\]\([^)]*\)", "")
    text = F.regexp_replace(text, r"\[((?:[^\]\[]|\[[^\]]*\])*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"(?m)^#{1,6}\s*", "")
    text = unescaped(F.regexp_replace(text, r"[*_`]{1,3}", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def html_markdown(html: Column) -> Column:
    """Lines of an HTML page as markdown: links kept, headings marked, other tags gone."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"""(?is)<a\b[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>""", "[$2]($1)")
    text = F.regexp_replace(text, r"(?i)<h[1-6][^>]*>", "\n# ")
    text = F.regexp_replace(text, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|nav|article|footer|header|body|html|head|title|tr|table)\b[^>]*>", "\n")
    return F.regexp_replace(text, r"(?s)<[^>]*>", "")


def title_form(title: Column) -> Column:
    """characters that links give a meaning as spaces, collapsed."""
    return collapsed(F.regexp_replace(title, r"[/#^\[\]|]", " "))


def label_form(stem: Column) -> Column:
    """a file's name as a label: spaces for - and _, capitals kept, else words capitalised."""
    plain = F.trim(F.regexp_replace(stem, r"[-_]+", " "))
    return F.when((plain == F.upper(plain)) & (plain != F.lower(plain)), plain).otherwise(F.initcap(plain))


def slug(name: Column) -> Column:
    """ASCII letters and digits joined by hyphens; ``documento`` if none is left. Letters of
    Latin-1 and Latin Extended-A lose their accents."""
    accented = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
    plain = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
    ascii_only = F.regexp_replace(F.translate(F.lower(name), accented, plain), r"[^\x00-\x7F]", "")
    out = F.trim(F.regexp_replace(ascii_only, r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(out == "", "documento").otherwise(out)


def excerpt(text: Column, most: int = 600) -> Column:
    """Text without fences and comments, collapsed; longer ones cut at a space, with an ellipsis."""
    plain = collapsed(F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"(?s)<!--.*?-->", ""))
    head = F.substring(plain, 1, most)
    space = F.length(head) - F.instr(F.reverse(head), " ") + 1
    cut = F.when((F.instr(head, " ") > 0) & (space > 1), F.substring(head, F.lit(1), space - 1)).otherwise(head)
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:\-]+$", ""), F.lit("…")))


def page_excerpt(markdown: Column, page: Column) -> Column:
    """The excerpt of what follows a page's anchor; empty if the page has none."""
    mark = F.concat(F.lit("<!-- pag "), page.cast("string"), F.lit(" -->\n"))
    at = F.instr(markdown, mark)
    return F.when(at > 0, excerpt(F.substring(markdown, at + F.length(mark), F.length(markdown)))).otherwise("")


def line_cut(text: Column, most: int = 1600) -> Column:
    """Longer texts end at their last line end, if it lies behind 60 %, and say so."""
    head = F.substring(text, 1, most)
    end = F.length(head) - F.instr(F.reverse(head), "\n")
    cut = F.when((F.instr(head, "\n") > 0) & (end > 0.6 * most), F.substring(head, F.lit(1), end)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(cut), F.lit("\n[...]")))


def parts(text: Column, size: int = 4000) -> Column:
    """Consecutive parts of ``size`` code points; one empty part for an empty text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def without_thinking(text: Column) -> Column:
    """what follows the first ``</think>``; empty if thinking began and didn't end."""
    at = F.instr(text, "</think>")
    return F.trim(F.when(at > 0, F.substring(text, at + 8, F.lit(2**31 - 1))).when(text.startswith("<think>"), "").otherwise(text))


def duration(seconds: Column) -> Column:
    """whole seconds, minutes, hours or days, whichever is the largest that fits."""
    s = F.floor(seconds).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("g")))


def italian_date(day: Column) -> Column:
    """day, Italian month and year."""
    # Month names.
    months = _any_of(["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"])
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(months, F.month(day)), F.year(day).cast("string"))


def has_number(text: Column) -> Column:
    return text.rlike(r"[0-9]")


def has_date(text: Column) -> Column:
    """A date of three numbers, or a year."""
    return text.rlike(r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b|\b\d{4}\b")
