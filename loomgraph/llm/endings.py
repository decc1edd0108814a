"""How a text ends: whole, or cut inside a word or sentence."""

from __future__ import annotations

import re

# What is put behind a cut.
_MARK = re.compile(r"(?:\s*(?:\.\.\.|…|&hellip;|\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|[\[(<]\s*(?:read |see )?(?:more|continued|truncated|cut|cont\.?|fortsetzung|suite|sigue)\s*[\])>]|\b(?:read more|continue reading|show more|see more|weiterlesen|mehr lesen|lire la suite|leer más|seguir leyendo)\b[\s.:>»]*|»+|>>+))+\s*$", re.IGNORECASE)
_CLOSING_TAGS = re.compile(r"(?:\s*</[A-Za-z][A-Za-z0-9]*\s*>|\s*<br\s*/?>)+\s*$")
_BROKEN_ENTITY = re.compile(r"(?:&#?\w{0,8}|�)$")
_STOP = re.compile(r"[.!?。؟][\"”“’'»«)\]*_]*$")
_INITIAL = re.compile(r"(?:\b[^\W\d_]|\b(?:Dr|Mr|Mrs|Ms|St|Mt|Mme|Mlle|Prof|Inst|Corp|Isl|Assn|Gt|Reg|Orch|Mus|Univ|Co|Nr|No|vol|p))\.$")
_NOTE = re.compile(r"^(?:\[\d+\]|\(\d+\)|\d+[.)]|[—–•*·#-])\s*\S")
_LABELLED = re.compile(r"^[^\W\d_][^:.!?]{0,40}:\s+\S")
_DATED = re.compile(r"^[^\W\d_][\w ’'.-]{0,40}\s(?:\d{1,2}[. ]+)?(?:de )?[^\W\d_]{3,12}(?: de)? \d{4}$")


#: Characters at the end that patterns anchored there look at: marks, tags and closing quotes are shorter.
TAIL = 256


def _tail(pattern: re.Pattern[str], t: str) -> int:
    """Where a pattern that reaches the end of the text begins in it; -1 if it doesn't match."""
    start = max(0, len(t) - TAIL)
    m = pattern.search(t[start:])
    return start + m.start() if m else -1


def visible(text: str) -> str:
    """The text without blanks and closing tags at its end."""
    t = text.rstrip(" \t\r\n ​ ﻿")
    while (at := _tail(_CLOSING_TAGS, t)) > 0:
        t = t[:at].rstrip()
    return t


def _broken_markup(t: str) -> bool:
    at = t.rfind("<")
    open_tag = at >= 0 and at > t.rfind(">") and t[at + 1 : at + 2].isascii() and (t[at + 1 : at + 2].isalpha() or t[at + 1 : at + 2] == "/")
    return open_tag or _tail(_BROKEN_ENTITY, t) >= 0


def _stops(t: str) -> bool:
    if _tail(_STOP, t) >= 0 and not t.endswith(("...", "…")):
        return True
    # a note in brackets behind a whole sentence; a quotation that trails off is closed all the same
    if t.endswith((".\"", ".”", ".»", "…”", "…\"", "...\"", "...”")):
        return True
    at = max(t.rfind("("), t.rfind("["))
    if t[-1:] in (")", "]") and at >= 0 and ")" not in t[at:-1] and "]" not in t[at:-1]:
        return _tail(_STOP, t[:at].rstrip()) >= 0
    return False


def _whole_tail(line: str, before: str) -> bool:
    """Whether a last line without a full stop is a heading, list, table row, note or signature."""
    if "|" in line:
        return not line.rstrip().endswith("|")
    if _NOTE.match(line):
        return True
    if _LABELLED.match(line) and ";" in line:
        return True
    if _LABELLED.match(line) and len(line) < 60 and before and "," not in line:
        return True
    if not before:
        return False
    words = line.split()
    # a heading: a capital and then small words, or one capitalised word used as such
    if len(words) <= 5 and _DATED.match(line) and any(w[:1].islower() for w in words[1:]):
        return True
    return 2 <= len(words) <= 4 and line[:1].isupper() and all(w.isalpha() and w.islower() for w in words[1:]) and len(words[-1]) > 3 and words[0].lower() not in OPENERS


# Words that open a sentence and so no heading, in four languages.
OPENERS = frozenset("a an the in on at by for from of to as when while after before during under each this that these those it he she they both no if with former critics according letters between der die das ein eine im in am bei nach von zu zwischen vor unter während als le la les un une en au aux dans de du des après avant pendant entre sous el los las una unos unas al del tras antes durante después bajo entre il y".split())
# Headings of one word.
_HEADINGS = frozenset("references notes sources bibliography footnotes links external faq appendix contents summary literature gallery legacy history einzelnachweise weblinks literatur quellen anmerkungen références notes bibliographie liens sources referencias notas fuentes bibliografía enlaces".split())


def cut_at_end(text: str | None, at_limit: bool = False) -> bool:
    """Whether a text ends inside a word or a sentence, whatever was put behind the cut.

    ``at_limit`` tells that the text has a length at which its source ends texts far too often; then only
    a full stop makes it whole. Null and blank texts are no cut texts.
    """
    if not text:
        return False
    t = visible(text)
    if not t:
        return False
    if _broken_markup(t):
        return True
    mark = _tail(_MARK, t)
    if mark > 0 and not t.endswith(("\"", "”", "»")) and (base := t[:mark].rstrip()):
        return not _stops(base) or t[mark:].startswith((".", "…")) and _tail(_STOP, base) < 0
    if t.endswith(("-", "‐", "–", ",", ";", "(", "[", "/", "“")):
        return True
    if _stops(t):
        return at_limit and _tail(_INITIAL, t) >= 0
    if at_limit:
        return True
    at = t.rfind("\n")
    line, before = t[at + 1 :].strip(), bool(t[: at + 1].strip())
    if line.lower().strip(":") in _HEADINGS and before:
        return False
    return not _whole_tail(line, before)
