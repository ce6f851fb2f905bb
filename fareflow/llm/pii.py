"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, colons, digits, ``://``, street words and identifier cues. From each
anchor a small deterministic parser expands to the left and right, finds the boundaries and validates what it found.
Text without anchors costs the pass alone.

Kinds, in order: email, ip, card, phone (the fixed base, see below), then what the method adds: login (a scheme's
``user:password@``), account (an IBAN with valid check digits, or an identifier of 6 or more characters with four digits,
after a cue such as *account* or *passport*), secret (a quoted or bare credential of 16 or more characters after a
cue such as *token* or *password*), ipv6 (eight groups, or ``::`` and three groups or more), street (a house number and one to four
capitalized words beside a street word, in the order of English, German, French or Spanish; a German street word may end its name).
No kind has a greatest length but by its own format.

Base, leftmost and non-overlapping within a kind, failing matches dropped and not retried:
email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip, four dotted numbers up to 255; card, digits joined by
single blanks or hyphens, 14 to 19 of them passing Luhn's test; phone, ``+`` and 10 to 15 digits with blanks, dots,
hyphens and brackets.

A pure function of one row over bounded Arrow batches: no shuffle. Null text counts as empty and has no spans. Repeated rows
are treated alike; an empty table gives an empty result. ``find_pii`` looks at id and text alone; ``redact_documents`` leaves all other
columns as they are.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account", "secret", "ipv6", "street")
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "tax id", "customer id", "member id", "license no", "konto", "cuenta", "compte")
SECRET_CUES = ("token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "api-key", "access_key", "private_key")

#: Street words: those that follow the name and number, those that precede the name, and German endings.
STREETS_AFTER = ("Street", "St.", "Avenue", "Ave", "Road", "Rd.", "Boulevard", "Blvd", "Lane", "Drive", "Court", "Square")
STREETS_BEFORE = ("rue", "avenue", "boulevard", "place", "chemin", "Calle", "calle", "Avenida", "avenida", "Plaza", "plaza", "Paseo", "paseo")
STREETS_IN = ("straße", "strasse", "str.", "Straße", "Strasse", "platz", "gasse", "allee")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://([^\s/?#@:]+:[^\s/?#@]*)@")
_ACCOUNT = re.compile(r"(?:\s*(?:number|nummer|num|no|nr|id|code)\b\.?)?\s{0,2}[:#=]?\s{0,2}([A-Za-z0-9][A-Za-z0-9-]*)")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_GROUPS = re.compile(r"[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Za-z:])")
_NAME = r"[A-ZÀ-ÖØ-Þ][\w'’-]{0,40}"
_ENGLISH = re.compile(rf"(?<![\w.,-])[0-9]{{1,5}}[A-Za-z]? (?:{_NAME} ){{1,4}}\Z")
_ROMANCE = re.compile(rf"(?:(?: (?:de|du|des|la|las|los|le|les|del|d['’]))*[ ']{_NAME}){{1,4}}(?P<after>,? (?:n[°º.o]{{1,2}} ?)?[0-9]{{1,5}}\b)?")
_BEFORE = re.compile(r"(?<![\w.,-])[0-9]{1,5}(?: ?(?:bis|ter))?,? \Z")
_GERMAN = re.compile(rf"(?:{_NAME}[ -]){{0,3}}(?:{_NAME})?\Z")
_NUMBER = re.compile(r" [0-9]{1,4} ?[a-z]?(?!\w)")
_SET = re.compile(r"[\"']?\s{0,2}[:=]\s{0,2}")
_SECRET = re.compile(_SET.pattern + r"(?:\"([^\"\s]{16,})\"|'([^'\s]{16,})'|([A-Za-z0-9_+/=.-]{16,}))")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for x in "0123456789":
        a.add_word(x, ("d", 1))
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", (":", 3))
    a.add_word(":", ("6", 1))
    for kind, words in ((">", STREETS_AFTER), ("<", STREETS_BEFORE), ("=", STREETS_IN)):
        for word in words:
            a.add_word(word, (kind, len(word)))
    for kind, cues in (("a", ACCOUNT_CUES), ("s", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.title(), cue.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban(x: str) -> bool:
    x = x.replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", x):
        return False
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _account(text: str, at: int, end: int) -> int | None:
    """The end of the account that starts at a place: an IBAN, as long as one is valid, or else the identifier up to end, if it has
    six characters and four digits."""
    if m := _IBAN.match(text, at):
        upto = m.end()
        while upto > at:
            if _iban(text[at:upto]):
                return upto
            upto = text.rfind(" ", at, upto)
    value = text[at:end].rstrip("-")
    return at + len(value) if len(value) >= 6 and sum(map(value.count, "0123456789")) >= 4 else None


def _ipv6(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The address around a colon; least: where the search may start."""
    hexes = "0123456789abcdefABCDEF"
    if not (text[at - 1 : at] in hexes and text[at + 1 : at + 2] in hexes + ":") or not 0 < at < len(text) - 2:
        return None
    start = at
    while start > max(least, at - 4) and text[start - 1] in hexes:
        start -= 1
    if start and (text[start - 1].isalnum() or text[start - 1] in ":."):
        return None
    m = _GROUPS.match(text, start)
    if not m or m.group().count(":") < 7 and "::" not in m.group():
        return None
    try:
        ipaddress.IPv6Address(m.group())
    except ValueError:
        return None
    return m.span()


def _street(text: str, what: str, at: int, end: int) -> tuple[int, int] | None:
    """The address around a street word."""
    left = text[max(0, at - 200) : at]
    if what == ">":
        if m := _ENGLISH.search(left):
            return at - len(left) + m.start(), end + (text[at:end] in ("Ave", "Blvd") and text[end : end + 1] == ".")
    elif what == "<":
        if (not at or not text[at - 1].isalnum()) and (m := _ROMANCE.match(text, end)):
            if before := _BEFORE.search(left):
                return at - len(left) + before.start(), m.end("after") if m.group("after") and text[at].isupper() else m.start() + len(m.group()) - len(m.group("after") or "")
            if m.group("after"):
                return at, m.end()
    elif number := _NUMBER.match(text, end):
        m = _GERMAN.search(left)
        start = at - len(left) + m.start()
        if start < at or text[at].isupper():
            return start, number.end()
    return None


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, place in KINDS) of every span, in order of start and then kind; code points, end exclusive."""
    if not text:
        return []
    spans: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    run = -1
    plain = 0  # the end of the last bare run after a secret's cue that has no digit: no part of it is looked at again
    for last, (what, size) in _automaton().iter(text):
        at = last - size + 1
        if what == "d":
            if at == run:  # inside the same run of digits: nothing starts here
                run += 1
                continue
            run = at + 1
            if at >= done["ip"] and (m := _IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                    spans.append((at, m.end(), 1))
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((at, m.end(), 2))
        elif what == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                spans.append((start, m.end(), 0))
        elif what == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    spans.append((at, m.end(), 3))
        elif what == ":":
            if m := _LOGIN.match(text, at):
                spans.append((m.start(1), m.end(1), 4))
        elif what == "6":
            if at >= done["ipv6"] and (found := _ipv6(text, at, done["ipv6"])):
                done["ipv6"] = found[1]
                spans.append((*found, 7))
        elif what in "<=>":
            if at >= done["street"] and not text[last + 1 : last + 2].isalpha() and (found := _street(text, what, at, last + 1)) and found[0] >= done["street"]:
                done["street"] = found[1]
                spans.append((*found, 8))
        elif at and (text[at - 1].isalnum() or text[at - 1] in "_-") or last + 1 < len(text) and text[last + 1].isalpha():
            continue  # a cue inside a longer word
        elif what == "a":
            if (m := _ACCOUNT.match(text, last + 1)) and m.start(1) >= done["account"] and (end := _account(text, *m.span(1))):
                done["account"] = end
                spans.append((m.start(1), end, 5))
        elif not (m := _SET.match(text, last + 1)) or m.end() < max(plain, done["secret"] - 1):
            continue
        elif (m := _SECRET.match(text, last + 1)) and (g := next(i for i in (1, 2, 3) if m.group(i))) and m.start(g) >= done["secret"]:
            if any(c.isdigit() for c in m.group(g)):
                done["secret"] = m.end(g)
                spans.append((m.start(g), m.end(g), 6))
            elif g == 3:
                plain = m.end(g)
    spans.sort(key=lambda s: (s[0], s[2]))
    return spans


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str | None, spans=None) -> str | None:
    """The text with each span (overlapping ones taken together) replaced by ``<KIND>``, the first one's."""
    spans = find(text) if spans is None else spans
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


FOUND = [*[(f"n_{k}", pa.int64(), "long") for k in BASE], ("base_sha256", pa.string(), "string"), ("spans", pa.string(), "string")]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a count for each base kind, base_sha256 and spans."""

    def row(text):
        spans = find(text)
        base = [s for s in spans if s[2] < len(BASE)]
        return *[sum(s[2] == k for s in base) for k in range(len(BASE))], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)

    def run(batches):
        for batch in slices(batches, text_col):
            rows = list(zip(*map(row, batch.column(text_col).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array(list(v), k) for v, (_, k, _) in zip(rows, FOUND)]], [id_col, *[n for n, _, _ in FOUND]])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{n} {k}" for n, _, k in FOUND))


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with personal data replaced in the text; chars_col, if there, follows the text."""

    def run(batches):
        for batch in slices(batches, text_col):
            at, n = batch.schema.get_field_index(text_col), batch.schema.get_field_index(chars_col)
            old = batch.column(at).to_pylist()
            texts = [redact(t) for t in old]
            if n >= 0:
                chars = [c if t is o else len(t) for t, o, c in zip(texts, old, batch.column(n).to_pylist())]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(chars, batch.schema.field(n).type))
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
