"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and
identifier cues. At each anchor a deterministic local parser expands to the left and right and
validates what it finds. Parsers never look back before the end of the last match of their kind,
so spans of a kind are leftmost and do not overlap. A parser that fails remembers how far the run it
looked at goes, or reads a bounded number of characters, so the pass is linear in the text.

Kinds: email, ip, card, phone (the base kinds; a parser finds just what the pattern of its kind
finds), address (a web, mail or phone URI that carries a login or a person's address) and account
(an IBAN whose check digits hold, or an identifier right after a cue such as `SSN`, in any case) and
secret (a key with a known prefix and length, or the value that a cue such as `token` is set to).
The n_* columns count each kind and n_spans all; spans of the last three come on top of the base
ones and replace none.

Defined results: null text counts as empty, with no spans and the digest of the empty string;
rows keep their ids, repeated or null; an empty table gives an empty table; only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account", "secret")

#: Words that announce an identifier.
CUES = ("ssn", "social security", "account no", "account number", "acct", "passport", "konto", "compte", "cuenta", "customer id", "member id", "tax id")
#: Words that a secret is set to.
SECRET_CUES = ("password", "passwd", "pwd", "secret", "token", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "private key", "private_key")
#: Prefixes of keys as their issuers write them, and how many word characters follow at least.
KEY_PREFIXES = {"AKIA": 16, "ASIA": 16, "ghp_": 36, "gho_": 36, "ghs_": 36, "github_pat_": 22, "sk_live_": 16, "xoxb-": 16, "xoxp-": 16, "glpat-": 20}
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:", "tel:")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE_REST = re.compile(r"[ ().0-9-]+")
URI_RUN = re.compile(r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]")
LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'*+;=-]++(?::[^@/?#\s]*+)?@[A-Za-z0-9.-]")
TEL = re.compile(r"[0-9().+-]*")
AFTER_CUE = re.compile(r"[ \t]*(?:(?:no|nr|num|number|code)\b\.?)?[ \t]*[:=#]?[ \t]*", re.IGNORECASE)

SET_TO = re.compile(r"[\"']?[ \t]{0,4}(?::=|=>|[:=])[ \t]{0,4}[\"'`]?")
SECRET = re.compile(r"[A-Za-z0-9+/_.~=-]+")
KEY = re.compile(r"[A-Za-z0-9_-]+")
LEAST_SECRET, MOST_IDENTIFIER, MOST_GROUPS = 16, 34, 9
WORD = re.compile(r"[A-Za-z0-9]{1,35}")
#: Characters of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
IBAN_AT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
DIGITS = re.compile(r"[^0-9]")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def iban_ok(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    # the text is searched in lower case
    for kind, entries in (("scheme", SCHEMES), ("cue", CUES), ("set", SECRET_CUES), ("key", KEY_PREFIXES)):
        for w in entries:
            a.add_word(w.lower(), (kind, len(w)))
    # an IBAN is anchored by its first digit, right after two letters, and needs no cue
    a.make_automaton()
    return a


def _email(text: str, at: int, since: int) -> tuple[int, int] | None:
    start = at
    while start > since and text[start - 1] in LOCAL:
        start -= 1
    if start == at or not (m := DOMAIN.match(text, at + 1)):
        return None
    return start, m.end()


def _phone(text: str, at: int) -> tuple[int, int, bool] | None:
    if at + 1 >= len(text) or not "0" <= text[at + 1] <= "9" or not (m := PHONE_REST.match(text, at + 2)):
        return None
    end = m.end()
    while end > at + 3 and not "0" <= text[end - 1] <= "9":
        end -= 1
    if end <= at + 3 or not "0" <= text[end - 1] <= "9":
        return None
    return at, end, 8 <= len(DIGITS.sub("", text[at:end])) <= 15


def _trimmed(text: str, start: int, end: int) -> int:
    """The end of a URI's run without closing punctuation, which is no part of it."""
    while end > start and text[end - 1] in ".,;:!?)'":
        end -= 1
    return end


def _uri(text: str, after: int, end: int, scheme: str) -> bool:
    """Whether the URI whose scheme ends at `after` and whose run ends at `end` carries a login or an address."""
    if scheme == "mailto:":
        return ADDRESS.match(text, after, end) is not None
    if scheme == "tel:":
        m = TEL.match(text, after, end)
        return m.end() == end and len(DIGITS.sub("", m.group())) >= 8
    return LOGIN.match(text, after, end) is not None


def _identifier(text: str, after: int) -> tuple[int, int] | None:
    """The identifier after a cue: words of letters and digits, each with a digit, 6 to 34 digits in at most 9 of them."""
    at = AFTER_CUE.match(text, after).end()
    end, digits = at, 0
    for _ in range(MOST_GROUPS):
        m = WORD.match(text, end + 1 if end > at else end)
        n = len(DIGITS.sub("", m.group())) if m else 0
        if not n or len(m.group()) > MOST_IDENTIFIER:
            break
        end, digits = m.end(), digits + n
        if digits > MOST_IDENTIFIER or end >= len(text) or text[end] not in " -":
            break
    return (at, end) if end > at and 6 <= digits <= MOST_IDENTIFIER else None


def _value(text: str, start: int, run_end: int) -> tuple[int, int] | None:
    """The run of a secret's characters at start if it looks made by a machine: long, of letters and digits."""
    end = run_end
    while end > start and text[end - 1] in ".=~-":
        end -= 1
    value = text[start : min(end, start + 64)]
    ok = end - start >= LEAST_SECRET and any("0" <= c <= "9" for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 8
    return (start, end) if ok else None


def _key(text: str, at: int, prefix: str) -> tuple[int, int] | None:
    """A key with a known prefix, written as its issuer writes it and not inside a word."""
    least = KEY_PREFIXES.get(prefix)
    if least is None or (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
        return None
    m = KEY.match(text, at + len(prefix), at + len(prefix) + 256)
    return (at, m.end()) if m and m.end() - m.start() >= least else None


def _iban(text: str, digit: int) -> tuple[int, int] | None:
    start = digit - 2
    if start < 0 or (start and text[start - 1].isalnum()) or not (m := IBAN_AT.match(text, start)):
        return None
    length = IBAN_LENGTH.get(text[start:digit])
    if length is None:
        return None
    body, seen = m.group(), 0
    for i, c in enumerate(body):
        seen += c != " "
        if seen == length:
            end = start + i + 1
            whole = end >= len(text) or not text[end].isalnum()
            return (start, end) if whole and iban_ok(body[: i + 1].replace(" ", "")) else None
    return None


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order of start; offsets in code points, end exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = run_end = chain_end = account_end = address_end = uri_end = secret_end = value_start = value_end = 0
    low = text.lower()
    if len(low) != len(text):  # some capitals grow; then lower only what anchors are made of
        low = text.translate(ASCII_LOWER)
    for last, (kind, n) in _automaton().iter(low):
        at = last - n + 1
        if kind == "digit":
            if at >= run_end:  # the numbers joined by single dots, in fours
                m = NUMBERS.match(text, at)
                run_end, parts, start = m.end(), m.group().split("."), at
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    end = start + sum(map(len, four)) + 3
                    if all(map(_part_ok, four)):
                        out["ip"].append((start, end))
                    start = end + 1
            if at >= chain_end:
                m = CARD.match(text, at)
                chain_end = m.end() if m else at + 1
                if m and 16 <= len(digits := DIGITS.sub("", m.group())) <= 19 and luhn(digits):
                    out["card"].append(m.span())
            if at >= account_end and (found := _iban(text, at)) and found[0] >= account_end:
                out["account"].append(found)
                account_end = found[1]
        elif kind == "at":
            if found := _email(text, at, email_end):
                out["email"].append(found)
                email_end = found[1]
        elif kind == "plus":
            if found := _phone(text, at):
                if found[2]:
                    out["phone"].append(found[:2])
        elif kind == "scheme":
            if at >= address_end:
                if last >= uri_end:  # schemes inside one run share its end
                    uri_end = URI_RUN.match(text, last + 1).end()
                    uri_trimmed = _trimmed(text, last + 1, uri_end)
                if last + 1 < uri_trimmed and _uri(text, last + 1, uri_trimmed, low[at : last + 1]):
                    out["address"].append((at, uri_trimmed))
                    address_end = uri_trimmed
        elif kind == "key":
            if at >= secret_end and (found := _key(text, at, text[at : last + 1])):
                out["secret"].append(found)
                secret_end = found[1]
        elif kind == "set":
            if at >= secret_end and not (at and text[at - 1].isalpha()) and (m := SET_TO.match(text, last + 1)):
                if not value_start <= m.end() < value_end:
                    run = SECRET.match(text, m.end())
                    value_start, value_end = m.end(), run.end() if run else m.end()
                if (found := _value(text, m.end(), value_end)) and found[0] >= secret_end:
                    out["secret"].append(found)
                    secret_end = found[1]
        elif at >= account_end and not (at and text[at - 1].isalnum()) and not text[last + 1 : last + 2].isalpha():
            if found := _identifier(text, last + 1):
                out["account"].append(found)
                account_end = found[1]
    return out


def _join(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_address long, n_account long, n_secret long, n_spans long"


def _run(batches):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for b in batches:
        found = [find_spans(t or "") for t in b.column(1).to_pylist()]
        counts = {k: pa.array([len(x[k]) for x in found], pa.int64()) for k in KINDS}
        base = [_join(x, BASE_KINDS) for x in found]
        digests = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string())
        spans = pa.array([_join(x, KINDS) for x in found], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *[counts[k] for k in BASE_KINDS], digests, spans, *[counts[k] for k in KINDS[len(BASE_KINDS) :]], pa.array([sum(map(len, x.values())) for x in found], pa.int64())], names)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, and all spans."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_run, SCHEMA)


def redact(text: str, mask: str = "[{}]") -> str:
    """text with every span replaced by its kind; overlapping spans by the kind of the first."""
    out, done = [], 0
    for a, b, k in sorted((a, b, k) for k, spans in find_spans(text).items() for a, b in spans):
        if b > done:
            if a >= done:
                out += [text[done:a], mask.format(k)]
            done = b
    return "".join([*out, text[done:]])
