"""Words of a text compared as their letters and digits only.

Markup is removed first: entities become their characters, tags that end a block become a space
and other tags and bracket codes vanish.  What is left is brought to compatibility form and case
folded; invisible characters, punctuation and symbols vanish; white space separates words, and a
word without letters or digits is none.
"""

from __future__ import annotations

import html
import re
import unicodedata

# Elements that stand on lines of their own, after which a new word begins.
_BLOCK = "address|article|blockquote|br|center|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|tr|ul"
_BLOCK_TAG = re.compile(rf"</?(?:{_BLOCK})(?:\s[^<>]*|\s*/)?>", re.I)
_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*|\s*/)?>|<![^<>]*>|<\|[a-z_]+\|>", re.I)
_BRACKET_BLOCK = re.compile(r"\[/?(?:quote|code|list|table|tr|td|th|center|hr|br|\*)(?:=[^\[\]\n]*)?\]", re.I)
_BRACKET = re.compile(r"\[/?[a-z]+(?:=[^\[\]\n]*)?\]|\[/?[a-z]+(?: [a-z]+=[^\[\]\n]*)\]", re.I)
_CURLY = re.compile(r"\{\{[^{}\n]*\}\}")
_NOT_KEPT = re.compile(r"[^\w\s]|_")


def _without_comments(text: str) -> str:
    """Markup comments that are closed vanish; searched from left to right once."""
    parts, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (b := text.find("-->", a + 4)) >= 0:
        parts.append(text[at:a])
        at = b + 3
    return "".join(parts) + text[at:] if parts else text[at:]


def _without_tags(text: str) -> str:
    return _TAG.sub("", _BLOCK_TAG.sub(" ", _without_comments(text)))


def plain_words(text: str | None) -> list[str]:
    """The words of ``text``; none for null, empty and blank ones."""
    if not text:
        return []
    if "<" in text:
        text = _without_tags(text)
    if "&" in text:
        text = html.unescape(text)
        if "<" in text:
            text = _without_tags(text)
    if "[" in text:
        text = _BRACKET.sub("", _BRACKET_BLOCK.sub(" ", text))
    if "{{" in text:
        text = _CURLY.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        # marks and invisible characters vanish inside words
        text = "".join(c for c in text if c.isascii() or c.isspace() or unicodedata.category(c)[0] in "LN")
    return _NOT_KEPT.sub("", text).casefold().split()
