"""Personal data by anchor expansion.

One Aho-Corasick pass over a text yields anchors: at-signs, digits, plus signs, schemes and identifier cues.
From each anchor a deterministic parser reads outwards, as far as the form allows, and validates what it read.
Only the neighbourhoods of anchors are looked at in Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.llm.common import fresh, quoted, with_text_columns

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LABEL = LETTERS | DIGITS | {"-"}
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
PHONE = DIGITS | frozenset(" ().-")
ACCOUNT = LETTERS | DIGITS | frozenset(" -")
USERINFO = LETTERS | DIGITS | frozenset("-._~%!$&'()*+,;=:")

#: Kinds in the order in which spans are listed; the first four are the base, the others are added.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "iban", "login")
#: Cues after which an account number is looked for, and the schemes before a login.
CUES = ("account", "acct", "ssn", "passport", "konto", "cuenta", "compte", "iban")
SCHEMES = ("://",)

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def email_at(text: str, at: int, low: int) -> tuple[Span | None, int]:
    """Around the at-sign at ``at``; ``low``: where the last match ended. The span, and where to go on."""
    start = at
    while start > low and text[start - 1] in LOCAL:
        start -= 1
    end, n, labels = at + 1, len(text), 0
    while True:
        stop = end
        while stop < n and text[stop] in LABEL:
            stop += 1
        if stop == end:
            end -= 1  # the dot before it isn't part
            break
        labels += 1
        end = stop
        if end < n and text[end] == ".":
            end += 1
        else:
            break
    if start == at or labels < 2:
        return None, low
    return (start, end), end


def ip_at(text: str, first: int) -> tuple[Span | None, bool, int]:
    """From a run of digits at ``first``: the span if its parts hold, whether four parts are there, where to go on."""
    n, end, parts = len(text), first, []
    while True:
        stop = end
        while stop < n and text[stop] in DIGITS:
            stop += 1
        if stop == end:
            return None, False, end
        parts.append(text[end:stop])
        end = stop
        if len(parts) == 4:
            break
        if end >= n or text[end] != ".":
            return None, False, end
        end += 1
    fits = all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)
    return ((first, end) if fits else None), True, end


def card_at(text: str, first: int) -> tuple[Span | None, int]:
    """The run of digits, singly parted by a blank or hyphen, from ``first``."""
    n, end, digits = len(text), first + 1, [text[first]]
    while end < n:
        c = text[end]
        if c in DIGITS:
            digits.append(c)
            end += 1
        elif c in " -" and end + 1 < n and text[end + 1] in DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    held = 13 <= len(digits) <= 19 and luhn("".join(digits))
    return ((first, end) if held else None), end


def phone_at(text: str, plus: int) -> tuple[Span | None, int]:
    n, end = len(text), plus + 2
    if end >= n or text[plus + 1] not in DIGITS:
        return None, plus + 1
    while end < n and text[end] in PHONE:
        end += 1
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3 or text[end - 1] not in DIGITS:
        return None, plus + 1
    held = 9 <= sum(c in DIGITS for c in text[plus:end]) <= 15
    return ((plus, end) if held else None), end


def iban_holds(token: str) -> bool:
    if not (15 <= len(token) <= 34 and token[:2].isalpha() and token[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in token[4:] + token[:4])) % 97 == 1


def account_after(text: str, cue_end: int) -> tuple[str, Span] | None:
    """After a cue: up to 12 characters on, an identifier with six digits or more, or a valid IBAN."""
    n, start = len(text), cue_end
    while start < n and start - cue_end < 12 and text[start] not in DIGITS and not (text[start].isupper() and text[start + 2 : start + 4].isdigit()):
        if text[start] == "\n" or text[start] == "@":
            return None
        start += 1
    if start >= n or start - cue_end >= 12:
        return None
    end = start
    while end < n and text[end] in ACCOUNT and (text[end] in DIGITS or text[end] in " -" and text[end - 1] not in " -" or text[end] in LETTERS and text[end].isupper()):
        end += 1
    while end > start and text[end - 1] not in DIGITS and text[end - 1] not in LETTERS:
        end -= 1
    token = "".join(c for c in text[start:end] if c not in " -")
    if token.isascii() and iban_holds(token):
        return "iban", (start, end)
    return ("account", (start, end)) if 6 <= sum(c in DIGITS for c in token) <= 20 else None


def login_after(text: str, scheme_end: int) -> Span | None:
    """User and password of an address: what stands between the scheme and an at-sign."""
    end = scheme_end
    while end < len(text) and text[end] in USERINFO:
        end += 1
    if end < len(text) and text[end] == "@" and ":" in text[scheme_end:end]:
        return scheme_end, end
    return None


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ("@", "+", *DIGITS, *SCHEMES):
        found.add_word(word, word)
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            found.add_word(form, "cue")
    found.make_automaton()
    return found


def find_spans(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[Span]]:
    """Spans of ``text`` (code points, end exclusive) by kind, each list by start."""
    spans: dict[str, list[Span]] = {k: [] for k in KINDS}
    email_low = ip_low = card_low = phone_low = added_low = 0
    for last, what in automaton.iter(text):
        if what == "@":
            if last >= email_low:
                span, email_low = email_at(text, last, email_low)
                if span:
                    spans["email"].append(span)
        elif what == "+":
            if last >= phone_low:
                span, phone_low = phone_at(text, last)
                if span:
                    spans["phone"].append(span)
        elif what == "://":
            if (span := login_after(text, last + 1)) and span[0] >= added_low:
                spans["login"].append(span)
                added_low = span[1]
        elif what == "cue":
            if last >= added_low and (found := account_after(text, last + 1)):
                spans[found[0]].append(found[1])
                added_low = found[1][1]
        else:
            if last >= card_low:
                span, card_low = card_at(text, last)
                if span:
                    spans["card"].append(span)
            # A match starts at any digit that its predecessor hasn't taken; within a run the first is leftmost.
            if last >= ip_low:
                span, whole, end = ip_at(text, last)
                if span:
                    spans["ip"].append(span)
                if whole:
                    ip_low = end
                else:  # no match starts at another digit of this run either: go on behind the run
                    ip_low = last + 1
                    while ip_low < len(text) and text[ip_low] in DIGITS:
                        ip_low += 1
    return spans


def listed(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


COUNTS = tuple(f"n_{k}" for k in BASE)
FIELDS = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def _finder() -> Callable[[list], list[list]]:
    automaton = _automaton()

    def compute(texts: list) -> list[list]:
        rows = []
        for text in texts:
            spans = find_spans(text or "", automaton)
            base = hashlib.sha256(listed(spans, BASE).encode()).hexdigest()
            rows.append((*(len(spans[k]) for k in BASE), base, listed(spans, KINDS)))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]

    return compute


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_sha256 and spans (``kind:start:end``, comma-joined).

    Base kinds are leftmost and don't overlap within a kind; the added kinds are accounts and IBANs after a
    cue, and logins in addresses. A null text is empty: no spans, the hash of nothing. Every row gives a row,
    repeated ones too; long texts are read whole; clashing columns are replaced.
    """
    return with_text_columns(docs, text_col, FIELDS, _finder)


def _masker(mask: str) -> Callable[[], Callable[[list], list[list]]]:
    def make() -> Callable[[list], list[list]]:
        automaton = _automaton()

        def masked(text: str | None) -> str | None:
            if not text:
                return text
            spans = sorted((a, -b, k) for k, found in find_spans(text, automaton).items() for a, b in found)
            out, done = [], 0
            for a, b, k in spans:
                if a >= done:
                    out += [text[done:a], mask.format(k.upper())]
                done = max(done, -b)
            return "".join([*out, text[done:]])

        return lambda texts: [[masked(t) for t in texts]]

    return make


def mask_personal_data(docs: DataFrame, mask: str = "[{}]") -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind; overlapping spans become one, named by the first.

    Null and empty texts stay as they are, and so do repeated rows; an empty table gives an empty one; texts are read
    whole, however long; no column can clash. A column n_chars, if there is one, is counted anew; all other columns pass through.
    """
    name = fresh(docs.columns, "masked")
    masked = with_text_columns(docs, "text", T.StructType([T.StructField(name, T.StringType())]), _masker(mask))
    new = {"text": F.col(name), "n_chars": F.length(name).cast("long")}
    return masked.select(*[new.get(c, F.col(quoted(c))).alias(c) for c in docs.columns])


def op4(docs: DataFrame) -> DataFrame:
    """The contract's columns; nulls, empty and long texts, ties and repeated rows as in ``personal_data``."""
    return personal_data(docs.select("doc_id", "text")).select("doc_id", *COUNTS, "base_sha256", "spans")
