"""Spoken words of subtitle texts: repair of wrong encodings, cues, and what in a cue is not speech."""

from __future__ import annotations

import re
import unicodedata

_TIME = r"\d{1,3}\s*:\s*\d{1,2}(?:\s*:\s*\d{1,2})?\s*[.,:]\s*\d{1,3}"
TIME_LINE = re.compile(rf"^[^\S\n]*{_TIME}[^\n]{{0,40}}?{_TIME}[^\n]*$", re.M)
_NUMBER = re.compile(r"(?:^|\n)[^\S\n]*\d+[^\S\n]*\s*$")
_MARKUP = re.compile(r"<[^<>\n]{1,80}>|\{[^{}\n]{1,80}\}|&[a-z]{2,6};")
_SOUND = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|[♪♫][^♪♫\n]*[♪♫]|(?<!\*)\*[^*\n]+\*(?!\*)|[♪♫]")
_SPEAKER = re.compile(r"^[\s\-–—]*(?:[^\W\d_][\w.'’]*(?: [\w.'’]+){0,2}):(?=\s)", re.M)
#: A web or mail address: with its scheme, www or @, blanks between its letters or not; or a name and an ending in small letters.
_ADDRESS_SQUEEZED = re.compile(r"https?:|www\.\w|\w@\w+\.\w")
_ADDRESS = re.compile(r"[^\W_]{3,}\.[a-z]{2,}")
ADDRESS = "@"  # what stands for an address among the words of a cue
WORD = re.compile(r"[^\W_]+")
_GARBLED = re.compile("[Â-ÃÅÐ-Ñâ][\u0080-¿Œ-žˆ˜–-•…-›€™]")
_CYRILLIC_AS_LATIN = re.compile("[À-ÿ]{3}")


def _reencode(text: str, wrong: str) -> str | None:
    try:
        return text.encode(wrong).decode("utf-8")
    except UnicodeError:
        pass
    out, changed = [], False  # by line: a few damaged characters must not keep the rest damaged
    for line in text.split("\n"):
        try:
            fixed = line.encode(wrong).decode("utf-8")
            changed |= fixed != line
            line = fixed
        except UnicodeError:
            pass
        out.append(line)
    return "\n".join(out) if changed else None


def repaired(text: str) -> str:
    """The text as it was before it was read with a wrong encoding, where that can be told; else the text itself."""
    if text.isascii():
        return text
    for _ in range(2):
        if not _GARBLED.search(text):
            break
        fixed = _reencode(text, "cp1252") or _reencode(text, "latin-1")
        if fixed is None:
            break
        text = fixed
    if "вЂ" in text or "Р°" in text or "СЃ" in text:
        text = _reencode(text, "cp1251") or text
    if _CYRILLIC_AS_LATIN.search(text) and len(_CYRILLIC_AS_LATIN.findall(text)) * 3 > 0.3 * sum(map(str.isalpha, text)) > 0:
        try:
            text = text.encode("latin-1", "replace").decode("cp1251", "replace")
        except UnicodeError:
            pass
    return text


def squeezed(cue: str) -> str:
    return re.sub(r"\s+", "", cue).lower()


def split_cues(text: str) -> list[str]:
    """The raw texts of the cues, in order. Without a time line there is none."""
    parts = TIME_LINE.split(text.replace("\r\n", "\n").replace("\r", "\n"))[1:]
    return [_NUMBER.sub("", p) if i < len(parts) - 1 else p for i, p in enumerate(parts)]


def has_address(plain: str) -> bool:
    return bool(("." in plain and (_ADDRESS.search(plain) or _ADDRESS_SQUEEZED.search(squeezed(plain)))) or "://" in plain)


def speech(cue: str) -> list[str] | None:
    """The words of a cue, in lower case, and ADDRESS first if it has an address; None if nobody says anything in it (a sound
    description, nothing)."""
    plain = _MARKUP.sub("", cue)
    address = [ADDRESS] if has_address(plain) else []
    plain = unicodedata.normalize("NFKC", _SPEAKER.sub("", _SOUND.sub(" ", plain)))
    words = WORD.findall("".join(c for c in plain if unicodedata.category(c) not in ("Cf", "Mn")) if not plain.isascii() else plain)
    if any(any(map(str.isalpha, w)) for w in words):
        return address + [w.lower() for w in words]
    return address or ([] if "???" in plain else None)  # letters that were lost
