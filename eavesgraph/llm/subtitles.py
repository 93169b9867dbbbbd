"""Dialogue of subtitle files: encodings repaired, all but spoken words taken off."""

from __future__ import annotations

import re

#: Separates cues in the text that dialogue() gives.
CUE = "\x01"

_UTF8 = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_CYRILLIC = re.compile("(?<![A-Za-z])[\xc0-\xff\xa8\xb8]{4,}(?![A-Za-z])")
_CYRILLIC_WORD = re.compile("(?<![A-Za-z])[\xc0-\xff\xa8\xb8]+(?![A-Za-z])")
_POLISH = re.compile("[A-Za-z][\xb3\xb9\xbf\x9c\x9f]|[\xb3\xb9\xbf\x9c\x9f][a-z]")
#: What bytes of cp1252 that Latin-1 has as control characters, and of cp1250, look like.
_FROM_1252 = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_TO_1250 = {ord(bytes([b]).decode("latin-1")): bytes([b]).decode("cp1250", "replace") for b in range(0x80, 0x100) if bytes([b]).decode("cp1250", "replace").lower() in "ąćęłńóśźż"}


def _decoded(m: re.Match) -> str:
    try:
        return m.group().encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def repair(text: str) -> str:
    """Undo UTF-8 read as Latin-1 (also twice), and cp1251 or cp1250 read as Latin-1."""
    if text.isascii():
        return text
    for _ in range(3):
        if not _UTF8.search(text):
            if not re.search("[\xc3\xc5\xd0\xd1][Œ-™]", text):
                break
            text = text.translate(_FROM_1252)
            if not _UTF8.search(text):
                break
        text = _UTF8.sub(_decoded, text)
    if _CYRILLIC.search(text):
        text = _CYRILLIC_WORD.sub(lambda m: m.group().encode("latin-1").decode("cp1251", "replace"), text)
    if _POLISH.search(text):
        text = text.translate(_TO_1250)
    return text


_TIME = re.compile(r"\n[ \t]*(?:\d+[ \t]*\n)?[ \t]*\d+:\d+:\d+[.,]\d+[ \t]*-->[^\n]*")
_TAG = re.compile(r"<[^>\n\x01]*>|\{[^}\n\x01]*\}")
_SOUND = re.compile(r"\[[^\]\x01]*\]|\([^)\x01]*\)")
_SONG = re.compile(r"♪[^♪\n\x01]*♪?")
#: What only lines of adverts and credits hold, in lower case.
_AD_MARKS = ("www.", ".example", "http", "@", "***", "synced and corrected", "subtitles brought", "subtitles by", "downloaded from", "ripped by", "ripped and", "encoded by", "translated by", "needs translators", "become a vip", "best place for captions")


def _without_adverts(t: str) -> str:
    return "\n".join([line for line in t.split("\n") if not any([m in line for m in _AD_MARKS])])


def dialogue(text: str) -> str:
    """The spoken text in lower case, a CUE before each cue.

    Byte-order marks, cue numbers, times, tags, sound descriptions in brackets,
    songs and lines of adverts are taken off, whatever the line ends. A text
    without any time line is dialogue as a whole.
    """
    t = repair(text)
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = _TIME.sub(CUE, "\n" + t.replace("﻿", "").lower())
    if "<" in t or "{" in t:
        t = _TAG.sub("", t)
    if any([m in t for m in _AD_MARKS]):
        t = _without_adverts(t)
    if "[" in t or "(" in t:
        t = _SOUND.sub(" ", t)
    if "♪" in t:
        t = _SONG.sub(" ", t)
    return t


WORD = re.compile("[^\\s\x01!-/:-@\\[-`{-~…–—«»„“”‘’♪¡]+")
_ACCENT = re.compile("[\x80-ɏ�]")


def skeleton(t: str) -> str:
    """Every non-ASCII Latin letter as one placeholder, so that a lost letter matches it."""
    return t if t.isascii() else _ACCENT.sub("Q", t)
