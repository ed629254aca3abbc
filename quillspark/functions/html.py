"""Text of HTML pages by plain rules, as column expressions.

Scripts, styles and comments go; block elements end a line; other tags vanish;
the five XML entities and the no-break space are decoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import clean_markdown, let, word_count

#: What is hidden up to its end, or to the end of the page if it has none; so no part of a page is searched twice.
HIDDEN = r"(?is)<script\b[^>]*(?:\z|>.*?(?:</script\s*>|\z))|<style\b[^>]*(?:\z|>.*?(?:</style\s*>|\z))|<!--.*?(?:-->|\z)"
#: Tags of elements that end a line, and any tags.
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|th|thead|title|tr|ul)\b[^>]*>"
TAG = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def replace_tags(text: Column, tag: str, made: str) -> Column:
    """`made` for each match of a tag's pattern, which begins with `<` and ends at the next `>`.

    Only the text up to its last `>` is searched: there, every `<` has an end, so
    no part is read twice, while behind it a pattern would read on to the end of
    the text at every `<`.
    """

    def searched(whole: Column) -> Column:
        return let(F.substring_index(whole, ">", -1), lambda rest: F.concat(F.regexp_replace(F.left(whole, F.length(whole) - F.length(rest)), tag, made), rest))

    return let(text, searched)


def html_text(html: Column) -> Column:
    """Text with a line for each block."""
    text = F.regexp_replace(html, HIDDEN, "\n")
    text = replace_tags(replace_tags(text, BLOCK, "\n"), TAG, "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_lines(html: Column) -> Column:
    """Lines that aren't blank, without ASCII white space around them; none for null."""
    lines = F.transform(F.split(html_text(F.coalesce(html, F.lit(""))), "\n"), lambda x: F.btrim(x, F.lit("\t\n\x0b\x0c\r ")))
    return F.filter(lines, lambda x: x != "")


def elements(text: Column, name: str, made: Callable[[Column, Column], Column]) -> Column:
    """What is made of an element's attributes and content; an element that another of its name opens within, or that nothing closes, stays."""
    pieces = F.split(text, rf"(?i)<(?={name}\b)")

    def element(piece: Column, i: Column) -> Column:
        halves = F.split(piece, rf"(?i)</{name}\s*>", 2)
        head = F.get(halves, F.lit(0))
        attributes = F.substring_index(head, ">", 1)
        content = F.substring(head, F.length(attributes) + 2, F.length(head))
        whole = (F.size(halves) == 2) & F.contains(head, F.lit(">"))
        return F.when(i == 0, piece).when(whole, F.concat(made(attributes, content), F.get(halves, F.lit(1)))).otherwise(F.concat(F.lit("<"), piece))

    return F.array_join(F.transform(pieces, element), "")


def _link(attributes: Column, content: Column) -> Column:
    href = F.regexp_extract(attributes, r'(?i)\bhref\s*=\s*"([^"]*)"', 1)
    given = attributes.rlike(r'(?i)\bhref\s*=\s*"[^"]*"')
    return F.when(given, F.concat(F.lit("["), content, F.lit("]("), href, F.lit(")"))).otherwise(F.concat(F.lit("<"), attributes, F.lit(">"), content))


def _around(before: str, after: str, trimmed: bool = False) -> Callable[[Column, Column], Column]:
    return lambda attributes, content: F.concat(F.lit(before), F.btrim(content, F.lit("\t\n\x0b\x0c\r ")) if trimmed else content, F.lit(after))


def markdown(html: Column) -> Column:
    """Markdown of a page: headings, list items, links, emphasis and code; all else as `html_text` gives it."""
    own = F.regexp_replace(html, HIDDEN, "\n")
    own = elements(own, "head", lambda attributes, content: F.lit("\n"))
    for level in range(1, 7):
        own = elements(own, f"h{level}", _around("\n\n" + "#" * level + " ", "\n\n", trimmed=True))
    own = elements(own, "pre", _around("\n```\n", "\n```\n"))
    own = elements(own, "code", _around("`", "`"))
    own = elements(own, "(?:b|strong)", _around("**", "**"))
    own = elements(own, "a", _link)
    own = replace_tags(replace_tags(own, r"(?i)<li\b[^>]*>", "\n- "), r"(?i)</p\s*>", "\n\n")
    return clean_markdown(html_text(own))


def page_document(title: Column, url: Column, html: Column) -> Column:
    """A fetched page as a Markdown file: its title and source, then its content."""
    return F.concat(F.lit("# "), title, F.lit("\n\nSource: "), url, F.lit("\n\n"), markdown(html), F.lit("\n"))


def is_thin_page(html: Column, least_words: int = 80) -> Column:
    """Too few words to keep."""
    return word_count(markdown(html)) < least_words
