"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, ``://``, plus signs, digits and cue words in
any case.
From each anchor a local parser expands to the boundaries of what may stand there and
validates it: e-mail addresses left and right of the at-sign, dotted addresses and card
numbers from the first digit of a run, phone numbers from the plus sign, URLs with
credentials around the scheme, and accounts, IBANs and secrets behind their cue.

Within a kind spans do not overlap, and the leftmost one wins.  Null and empty texts have no
spans; repeated rows are searched one by one; an empty table gives an empty one.  Columns
other than doc_id and text are not read, whatever their names.  Places count code points,
ends exclusive.  Spans have no largest length, and a text's work grows in proportion to its
length: runs of blanks behind a cue are taken once and never given back.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
GROUPED = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"://[A-Za-z0-9._%+~-]+:[^\s/@:\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]{1,5})?[^\s\"'<>]*")
IBAN = re.compile(r"[^\S\n]*+(?:(?:no|nr|number)\.?)?[^\S\n]*+[:=#]?[^\S\n]*+([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"[^\S\n]*+(?:(?:no|nr|number|id)\.?)?[^\S\n]*+[:=#]?[^\S\n]*+([A-Z]{0,3}[0-9](?:[ -]?[0-9]){5,16})(?![A-Za-z0-9])", re.I)
SECRET = re.compile(r"(?:[_-]?(?:id|key|token|secret))?[\"']?[^\S\n]*+[:=][^\S\n]*+[\"']?", re.I)
TOKEN = re.compile(r"([A-Za-z0-9+/_=.-]{16,})", re.I)

#: Cue words and the kind behind them (fixed values), in lower case.
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "passport", "ssn", "social security", "routing"),
    "secret": ("api_key", "apikey", "api key", "access_key", "secret", "token", "password", "passwd"),
}


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in ("@", "+", *DIGITS):
        out.add_word(c, (1, c))
    out.add_word("://", (3, "://"))
    for kind, cues in CUES.items():
        for cue in cues:
            out.add_word(cue, (len(cue), kind))
    out.make_automaton()
    return out


ANCHORS = _automaton()
#: For texts whose lower case has another length.
LOWERED = str.maketrans(UPPER, LOWER)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def iban_valid(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as in ``KINDS``, then start."""
    text = text or ""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where each kind goes on looking

    def add(kind: str, start: int, end: int, valid: bool = True):
        done[kind] = end
        if valid:
            found[kind].append((start, end))

    digit, spelt = -2, 0  # the last digit seen; where the last run behind a secret's cue ends
    low = text.lower()  # never shorter, so of equal length character by character
    for last, (size, what) in ANCHORS.iter(low if len(low) == len(text) else text.translate(LOWERED)):
        at = last - size + 1
        if what in DIGITS:
            starts_run, digit = at != digit + 1, at
            if starts_run:
                if at >= done["ip"] and (m := DOTTED.match(text, at)):
                    add("ip", at, m.end(), all(map(octet, m[0].split("."))))
                if at >= done["card"] and (m := GROUPED.match(text, at)):
                    number = m[0].replace(" ", "").replace("-", "")
                    add("card", at, m.end(), 13 <= len(number) <= 19 and luhn(number))
        elif what == "@":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                add("email", start, m.end())
        elif what == "+":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                add("phone", at, m.end(), 9 <= sum(c in DIGITS for c in m[0]) <= 15)
        elif what == "://":
            if at >= done["url"] and (m := LOGIN.match(text, at)):
                start = at
                while start > done["url"] and text[start - 1].isascii() and text[start - 1].isalnum():
                    start -= 1
                if start < at:
                    add("url", start, m.end())
        elif at >= done[what] and not (at and text[at - 1].isalpha()):
            m = {"iban": IBAN, "account": ACCOUNT, "secret": SECRET}[what].match(text, last + 1)
            if m and what == "secret":  # not again in a run that has no digit: its end has none either
                m = TOKEN.match(text, m.end()) if m.end() >= spelt else None
                spelt = m.end() if m else spelt
            if m and m.start(1) >= done[what]:
                # A word that is spelt out is no secret: it needs a digit.
                valid = iban_valid(m[1]) if what == "iban" else what == "account" or any(c in DIGITS for c in m[1])
                if valid:
                    add(what, m.start(1), m.end(1))
    return [(kind, s, e) for kind in KINDS for s, e in found[kind]]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, joined with those that overlap it, replaced by ``[kind]``."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _search(with_text: bool):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            spans, texts = [], []
            for text in batch.column(1).to_pylist():
                own = find(text)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                texts.append((redacted(text, own) if own else text) if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span), pa.array(texts, pa.string())], ["doc_id", "spans", "redacted"])

    return run


def search(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, spans and the redacted text."""
    return docs.select("doc_id", "text").mapInArrow(_search(with_text), "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>, redacted string")


def joined(spans, kinds=KINDS):
    """``kind:start:end`` of spans of some kinds, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
