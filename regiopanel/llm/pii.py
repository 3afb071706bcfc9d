"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, digits,
URL schemes, identifier cue words and the heads of bank account numbers.  From each anchor a deterministic parser of
its kind grows the span to the left and right, and a validator decides:

- email: the at-sign between a local part and a dotted domain;
- ip: four digit runs joined by dots, each at most 255;
- card: digits, singly separated by blanks or hyphens, 14 to 19 of them, Luhn;
- phone: a plus sign and 10 to 15 digits with blanks, dots, brackets, hyphens;
- url: scheme, host, and the rest up to white space;
- account: an IBAN, of its country's length, in groups or in one, whose check digits are
  right; or a cue word (account, passport, Konto, compte, cuenta, ...), fillers like "no."
  or "Nr.", and an identifier of 6 or more letters and digits with 4 digits or more, in
  groups or in one.  An identifier of an IBAN's shape must be a right one;
- address: English (12 Long Hill St.), French (12 bis, rue de la Paix), German
  (Hauptstrasse 12 a, Lange Strasse 5) and Spanish (Calle de Alcala, 42) forms, from the
  word for the kind of street to both sides.

The first four are the base kinds.  Their spans are those of leftmost,
non-overlapping matching of each kind's pattern from the left of the text, with
matches that fail the validator dropped and not tried again from a later start.
The other kinds add spans and change nothing in the base ones.

Positions count code points, ends are exclusive.  Defined cases: a null text is
empty and has no span; texts of any length are read whole, in one row; rows that
repeat are each reported; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import string

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_text, long_id

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("url", "account", "address")

_DIGIT = frozenset(string.digits)
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_PHONE = frozenset(" ().-" + string.digits)
_ALNUM = frozenset(string.ascii_letters + string.digits)

SCHEMES = ("http://", "https://", "ftp://")
# Cue words before an identifier, and street words, in four languages.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "customer id", "social security", "tax id",
                "konto", "kontonummer", "reisepass", "kundennummer", "steuernummer", "ausweis",
                "compte", "passeport", "sécurité sociale", "cuenta", "pasaporte", "dni", "nie")
ENGLISH_STREETS = ("street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "boulevard", "blvd", "drive", "dr", "square", "court", "way",
                   "terrace", "crescent", "highway")
FRENCH_STREETS = ("rue", "avenue", "boulevard", "place", "chemin", "allée", "impasse", "quai", "route", "cours")
GERMAN_STREETS = ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ufer", "damm", "chaussee")
SPANISH_STREETS = ("calle", "avenida", "avda.", "plaza", "paseo", "carretera", "camino", "ronda")
# Lengths of the countries' IBANs.
IBAN_LENGTHS = dict(x.split() for x in (
    "AD 24,AE 23,AL 28,AT 20,AZ 28,BA 20,BE 16,BG 22,BH 22,BR 29,BY 28,CH 21,CR 22,CY 28,CZ 24,DE 22,DK 18,DO 28,EE 20,EG 29,ES 24,FI 18,"
    "FO 18,FR 27,GB 22,GE 22,GI 23,GL 18,GR 27,GT 28,HR 21,HU 28,IE 22,IL 23,IQ 23,IS 26,IT 27,JO 30,KW 30,KZ 20,LB 28,LC 32,LI 21,LT 20,"
    "LU 20,LV 21,MC 27,MD 24,ME 22,MK 19,MR 27,MT 31,MU 30,NL 18,NO 15,PK 24,PL 28,PS 29,PT 25,QA 29,RO 24,RS 22,SA 24,SE 24,SI 19,SK 24,"
    "SM 27,TN 24,TR 26,UA 29,VA 22,VG 24,XK 20").split(","))

_FILLER = re.compile(r"(?:[ :#=.\"]|\b(?:no|nr|num|number|nummer|numéro|número|n°|nº|is|ist|est|es|id)\b\.?|n[°º])*", re.IGNORECASE)
_IDENTIFIER = re.compile(r"[A-Za-z0-9]+(?:[ -][A-Za-z0-9]*[0-9][A-Za-z0-9]*|-[A-Za-z0-9]+)*")
_NAME = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_NUMBER_BEFORE = re.compile(r"(?<![\w])[0-9]{1,5}[a-zA-Z]?(?: ?(?:bis|ter))?,? $")
_ENGLISH_BEFORE = re.compile(rf"(?<![\w])[0-9]{{1,5}}[a-zA-Z]?,? (?:{_NAME} ){{1,3}}$")
_FRENCH_AFTER = re.compile(rf"(?: (?:de|du|des|la|le|les|et|aux?|sur|d['’]|l['’]|{_NAME}))*? {_NAME}(?: (?:{_NAME}|de {_NAME}))*| (?:de l['’]|d['’]|l['’]){_NAME}")
_GERMAN_BEFORE = re.compile(rf"(?:{_NAME}[ -]){{0,2}}(?:[A-ZÄÖÜ][\wäöüß-]*)?$")
_GERMAN_AFTER = re.compile(r" [0-9]{1,4}(?: ?[a-z]\b)?(?![\w])")
_SPANISH_AFTER = re.compile(rf"(?: (?:de|del|la|las|los|el|y|{_NAME}))*? {_NAME}(?: (?:(?:de|del|la|las|los|el|y) )*{_NAME})*,?(?: n[ºo°]\.?)? [0-9]{{1,5}}(?![\w])")


def _run(text: str, at: int, chars: frozenset) -> int:
    """End of the run of ``chars`` that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def parse_email(text: str, at: int, floor: int):
    """The address around the at-sign ``at``; its local part starts no earlier
    than ``floor``."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    last = end
    while end < len(text) and text[end] == ".":
        stop = _run(text, end + 1, _LABEL)
        if stop == end + 1:
            break
        end = stop
    return (start, end, True) if end > last else None


def parse_ip(text: str, at: int, floor: int):
    end = _run(text, at, _DIGIT)
    parts = [text[at:end]]
    for _ in range(3):
        if end >= len(text) or text[end] != ".":
            return None
        stop = _run(text, end + 1, _DIGIT)
        if stop == end + 1:
            return None
        parts.append(text[end + 1:stop])
        end = stop
    return at, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def luhn(digits: list[int]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def parse_card(text: str, at: int, floor: int):
    end, n = _run(text, at, _DIGIT), len(text)
    while end + 1 < n and text[end] in " -" and text[end + 1] in _DIGIT:
        end = _run(text, end + 1, _DIGIT)
    if end - at < 2:
        return None
    digits = [int(c) for c in text[at:end] if c in _DIGIT] if end - at <= 37 else []
    return at, end, 14 <= len(digits) <= 19 and luhn(digits)


def parse_phone(text: str, at: int, floor: int):
    if at + 1 >= len(text) or text[at + 1] not in _DIGIT:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 2 and text[end - 1] not in _DIGIT:
        end -= 1
    if end < at + 4:
        return None
    n = sum(c in _DIGIT for c in text[at:end])
    return at, end, 10 <= n <= 15


def parse_url(text: str, at: int, floor: int):
    end = text.index("://", at) + 3
    host = _run(text, end, _LABEL | {"."})
    if host == end:
        return None
    while host < len(text) and not text[host].isspace() and text[host] not in "\"'<>":
        host += 1
    return at, host, True


def _cue_starts(text: str, at: int, cue: int) -> bool:
    return (at == 0 or text[at - 1] not in _ALNUM) and (at + cue >= len(text) or text[at + cue] not in _ALNUM)


def iban_ok(value: str) -> bool:
    """Length and check digits of an IBAN without blanks."""
    if IBAN_LENGTHS.get(value[:2].upper()) != str(len(value)) or not value.isalnum() or not value.isascii():
        return False
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def parse_iban(text: str, at: int, head: int):
    """An IBAN whose country and first check digit are at ``at``; groups are parted by
    single blanks."""
    if at and text[at - 1] in _ALNUM:
        return None
    want, end, value = int(IBAN_LENGTHS[text[at:at + 2].upper()]), at, []
    while len(value) < want and end < len(text):
        if text[end] in _ALNUM:
            value.append(text[end])
        elif text[end] != " " or text[end - 1] == " ":
            return None
        end += 1
    if len(value) < want or end < len(text) and text[end] in _ALNUM:
        return None
    return (at, end, True) if iban_ok("".join(value)) else None


def parse_account(text: str, at: int, cue: int):
    if not _cue_starts(text, at, cue):
        return None
    start = _FILLER.match(text, at + cue, at + cue + 40).end()
    found = _IDENTIFIER.match(text, start, start + 60)
    if not found:
        return None
    value = re.sub("[ -]", "", found.group())
    if len(value) < 6 or sum(c in _DIGIT for c in value) < 4:
        return None
    shaped = value[:2].isalpha() and value[2:4].isdigit() and IBAN_LENGTHS.get(value[:2].upper()) == str(len(value))
    return None if shaped and not iban_ok(value) else (start, found.end(), True)


def parse_address(text: str, at: int, cue: int):
    """An address around the street word at ``at``, by the forms of its languages."""
    word, end = text[at:at + cue].lower(), at + cue
    alone = _cue_starts(text, at, cue)
    if alone and word in ENGLISH_STREETS:
        before = _ENGLISH_BEFORE.search(text, max(0, at - 80), at)
        if before:
            dotted = word in ("st", "ave", "rd", "ln", "blvd", "dr") and text[end:end + 1] == "."
            return before.start(), end + dotted, True
    if alone and word in FRENCH_STREETS:
        before = _NUMBER_BEFORE.search(text, max(0, at - 14), at)
        after = before and _FRENCH_AFTER.match(text, end, end + 80)
        if after:
            return before.start(), after.end(), True
    if alone and word in SPANISH_STREETS or word == "avda." and not (at and text[at - 1] in _ALNUM):
        after = _SPANISH_AFTER.match(text, end, end + 80)
        if after:
            return at, after.end(), True
    if word in GERMAN_STREETS and (end >= len(text) or text[end] not in _ALNUM):
        after = _GERMAN_AFTER.match(text, end, end + 12)
        before = after and _GERMAN_BEFORE.search(text, max(0, at - 60), at)
        # a word with this ending, or a capitalised street word behind names
        if after and (before.start() < at or text[at].isupper()) and (before.start() == 0 or text[before.start() - 1] not in _ALNUM):
            return (before.start(), after.end(), True) if before.group() or text[at].isupper() else None
    return None


def build_automaton() -> ahocorasick.Automaton:
    """Anchors with the kinds that they may start."""
    a = ahocorasick.Automaton()
    for d in string.digits:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    streets = ENGLISH_STREETS + FRENCH_STREETS + GERMAN_STREETS + SPANISH_STREETS
    for words, kind in ((SCHEMES, "url"), (ACCOUNT_CUES, "account"), (streets, "address")):
        for w in words:
            for form in {w, w.capitalize(), w.upper()}:
                a.add_word(form, (kind, len(form)))
    for country in IBAN_LENGTHS:
        for d in string.digits:
            a.add_word(country + d, ("iban", 3))
    a.make_automaton()
    return a


def find_spans(text: str, automaton) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text by start, then kind as listed."""
    spans = []
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended

    def take(kind: str, found) -> None:
        if found:
            start, end, valid = found
            done[kind] = end
            if valid:
                spans.append((start, end, kind))

    ip_run = -1  # end of the digit run that was tried last
    for last, (anchor, length) in automaton.iter(text):
        at = last - length + 1
        if anchor == "digit":
            if at >= done["card"]:
                found = parse_card(text, at, 0)
                take("card", found)
            if at >= done["ip"] and at >= ip_run:
                ip_run = _run(text, at, _DIGIT)
                take("ip", parse_ip(text, at, 0))
        elif anchor == "@":
            if at >= done["email"]:
                take("email", parse_email(text, at, done["email"]))
        elif anchor == "+":
            if at >= done["phone"]:
                take("phone", parse_phone(text, at, 0))
        elif anchor == "url":
            if at >= done["url"]:
                take("url", parse_url(text, at, 0))
        elif anchor == "address":
            found = parse_address(text, at, length)
            if found and found[0] >= done["address"]:
                take("address", found)
        elif at >= done["account"]:
            take("account", (parse_account if anchor == "account" else parse_iban)(text, at, length))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[0], order[s[2]], s[1]))


_SCHEMA = ("doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, a digest of their spans,
    and all spans as ``kind:start:end``, comma-joined."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        automaton = build_automaton()
        for b in batches:
            rows = []
            for t in b["text"]:
                spans = find_spans(t, automaton) if t else []
                kinds = [k for _, _, k in spans]
                said = [f"{k}:{s}:{e}" for s, e, k in spans]
                base = ",".join(x for x, k in zip(said, kinds) if k in BASE)
                rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return long_id(docs.select(id_text(id_col), F.col(text_col).alias("text")).mapInPandas(run, _SCHEMA))
