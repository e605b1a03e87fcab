"""Folding of names for comparison: mojibake undone, scripts joined, accents and case dropped."""

from __future__ import annotations

import re
import unicodedata

from cobbler.llm.confusables import skeleton

# Serbian Cyrillic letters and their Latin forms.
CYRILLIC = "абвгдђежзијклљмнњопрстћуфхцчџш"
LATIN = ["a", "b", "v", "g", "d", "đ", "e", "ž", "z", "i", "j", "k", "l", "lj", "m", "n", "nj", "o", "p", "r", "s", "t", "ć", "u", "f", "h", "c", "č", "dž", "š"]

_TO_LATIN = {ord(c): x for c, x in zip(CYRILLIC, LATIN, strict=True)} | {ord(c.upper()): x.upper() for c, x in zip(CYRILLIC, LATIN, strict=True)}
_STROKE = {ord("đ"): "d", ord("Đ"): "d", ord("ß"): "ss", ord("ł"): "l", ord("ø"): "o"}
_MOJIBAKE = re.compile("[ÃÅÄÂ]")
_APART = re.compile(r"[^a-z0-9]+")


def unbroken(text: str) -> str:
    """Undoes UTF-8 read as a one-byte code page, where that gives sense."""
    if not _MOJIBAKE.search(text):
        return text
    for codec in ("cp1252", "latin-1"):
        for t in (text, re.sub("([ÅÄÃÂ]) ", "\\1\u00a0", text)):
            try:
                return t.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
    # bytes that the code page lacks pass through as they are
    try:
        return b"".join(c.encode("cp1252") if ord(c) > 255 else c.encode("latin-1") for c in re.sub("([ÅÄÃÂ]) ", "\\1\u00a0", text)).decode("utf-8")
    except UnicodeError:
        return text


def is_cyrillic(c: str) -> bool:
    return "\u0400" <= c <= "\u04ff"


#: Letters that fold one by one whatever stands beside them: the quick way for most texts.
_QUICK = {n: d for n in range(0xC0, 0x180) if (c := chr(n)).isalpha() and c not in "ÃÅÄÂ" and (d := unicodedata.normalize("NFD", c).translate(_STROKE)[:2].rstrip("\u0300\u0301\u0302\u0303\u0306\u0307\u0308\u030a\u030b\u030c\u0327\u0328\u0304")).isascii()}


def plain(text: str) -> str:
    """Lower-case Latin letters, digits and single spaces."""
    quick = text if text.isascii() else text.translate(_QUICK)
    if quick.isascii() and quick.isprintable():
        return _APART.sub(" ", quick.lower()).strip()
    text = unbroken(text)
    if not text.isascii():
        if any(map(is_cyrillic, text)):
            # a word with Cyrillic only is transliterated, look-alikes in Latin words are not
            text = " ".join(w.translate(_TO_LATIN) if all(is_cyrillic(c) or not c.isalpha() or c in "xwqyXWQY" for c in w) and any(map(is_cyrillic, w)) else w for w in text.split(" "))
        text = unicodedata.normalize("NFD", skeleton(text).translate(_TO_LATIN)).translate(_STROKE)
        text = "".join(c for c in text if not unicodedata.combining(c))
    return _APART.sub(" ", text.lower()).strip()


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits between two words, neighbours swapped counting as one; more than ``most`` is most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            cost = before[j - 1] if x == y else 1 + min(before[j - 1], before[j], row[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and older[j - 2] + 1 < cost:
                cost = older[j - 2] + 1
            row[j] = cost
        if min(row) > most:
            return most + 1
    return row[-1]
