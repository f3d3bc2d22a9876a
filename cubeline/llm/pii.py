"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, scheme marks
(``://``), plus signs, digits and identifier cues such as ``iban`` or
``password``. At each anchor a deterministic parser reads outwards to the span's
bounds and validates it. Work is linear in the text: an anchor inside the last span
of its kind is not parsed, digits inside a run that was read start nothing new, and
what a parser reads in vain holds no other anchor that would read it again (an
identifier ends at the mark that a cue needs before the next one, an address at
the next scheme's slashes).

Base kinds, as leftmost non-overlapping matches that are dropped if they fail:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 16 to 19 digits that pass Luhn
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 8 to 15 digits

Added kinds: ``account``, an identifier of at least six letters and digits, one a
digit, after a cue; ``secret``, what follows ``password=`` and the like, or a key
``AKIA`` with 16 capitals or digits; ``url``, an address with a user and password
before its host.

Defined cases: a null text counts as empty; spans are in code points, end
exclusive; rows that repeat stay as they are; an empty table gives an empty
result; other columns are ignored or, in ``mask_pii``, kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, id_text

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "secret", "url")
KINDS = BASE + ADDED

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LABEL = ALNUM | {"-"}
LOCAL = ALNUM | frozenset("._%+-")
PHONE = DIGITS | frozenset(" ().-")
#: Cues of identifiers, each in the spellings that are looked for.
ACCOUNT_CUES = ("iban", "IBAN", "account", "Account", "acct", "passport", "Passport", "ssn", "SSN")
SECRET_CUES = ("password=", "passwd=", "api_key=", "secret=", "token=")
KEY_CUE = "AKIA"

_AUTOMATON = []


def _automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for d in DIGITS:
            a.add_word(d, ("d", 1))
        for word, kind in (("@", "@"), ("+", "+"), ("://", ":"), (KEY_CUE, "k"), *((c, "a") for c in ACCOUNT_CUES), *((c, "s") for c in SECRET_CUES)):
            a.add_word(word, (kind, len(word)))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def _run(t: str, at: int, chars: frozenset) -> int:
    n = len(t)
    while at < n and t[at] in chars:
        at += 1
    return at


def _email(t: str, at: int, since: int) -> tuple[int, int] | None:
    start = at
    while start > since and t[start - 1] in LOCAL:
        start -= 1
    end = _run(t, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    whole = 0
    while end < len(t) and t[end] == ".":
        more = _run(t, end + 1, LABEL)
        if more == end + 1:
            break
        whole = end = more
    return (start, whole) if whole else None


def _ip(t: str, at: int) -> tuple[int, bool]:
    """End of four dotted numbers at a digit run, or of the run; whether the four are there and valid (None: not there)."""
    end = _run(t, at, DIGITS)
    first, parts = end, [t[at:end]]
    for _ in range(3):
        if end >= len(t) or t[end] != ".":
            return first, None
        more = _run(t, end + 1, DIGITS)
        if more == end + 1:
            return first, None
        parts.append(t[end + 1 : more])
        end = more
    return end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _card(t: str, at: int) -> tuple[int, bool]:
    end, n = at + 1, len(t)
    while end < n:
        if t[end] in DIGITS:
            end += 1
        elif t[end] in " -" and end + 1 < n and t[end + 1] in DIGITS:
            end += 2
        else:
            break
    if end - at < 16:
        return end, False
    digits = t[at:end].replace(" ", "").replace("-", "")
    return end, 16 <= len(digits) <= 19 and luhn(digits)


def _phone(t: str, at: int) -> tuple[int, bool] | None:
    """End of the match at a plus sign, and whether it is valid."""
    if at + 1 >= len(t) or t[at + 1] not in DIGITS:
        return None
    end = _run(t, at + 2, PHONE)
    while end > at + 3 and t[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3 or t[end - 1] not in DIGITS:
        return None
    return end, 8 <= sum(c in DIGITS for c in t[at:end]) <= 15


def _word_start(t: str, at: int) -> bool:
    return not at or not (t[at - 1].isalnum() or t[at - 1] == "_")


def _account(t: str, at: int, after: int) -> tuple[int, int] | None:
    if not _word_start(t, at):
        return None
    start = after
    while start < len(t) and start - after < 12 and t[start] in " :=#.":
        start += 1
    if start == after:
        return None
    end = _run(t, start, LABEL)
    while end > start and t[end - 1] == "-":
        end -= 1
    found = t[start:end]
    return (start, end) if sum(c in ALNUM for c in found) >= 6 and any(c in DIGITS for c in found) else None


def _value(t: str, after: int) -> tuple[int, int] | None:
    end = after
    while end < len(t) and not t[end].isspace() and t[end] not in "\"'<>,;":
        end += 1
    return (after, end) if end > after else None


def _url(t: str, at: int, after: int) -> tuple[int, int] | None:
    start = at
    while start and (t[start - 1] in ALNUM or t[start - 1] in "+.-"):
        start -= 1
    end, sign = after, -1
    while end < len(t) and not t[end].isspace() and t[end] not in "\"'<>/?#":
        if t[end] == "@":
            sign = end
        end += 1
    if start == at or sign < 0 or ":" not in t[after:sign]:
        return None
    while end < len(t) and not t[end].isspace() and t[end] not in "\"'<>":
        end += 1
    return start, end


def find_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    t = text or ""
    if not t:
        return out
    end = dict.fromkeys(KINDS, 0)
    run_ip = run_card = run_end = 0

    def add(kind: str, found: tuple[int, int] | None) -> None:
        if found and found[0] >= end[kind]:
            out[kind].append(found)
            end[kind] = found[1]

    for last, (kind, size) in _automaton().iter(t):
        at = last - size + 1
        if kind == "d":
            if at >= run_card:
                run_card, valid = _card(t, at)
                if valid:
                    out["card"].append((at, run_card))
            if at >= run_ip and at >= run_end:
                run_end = _run(t, at, DIGITS)
                stop, valid = _ip(t, at)
                if valid is not None:
                    run_ip = stop
                    if valid:
                        out["ip"].append((at, stop))
        elif kind == "@":
            add("email", _email(t, at, end["email"]))
        elif kind == "+":
            if at >= end["phone"] and (found := _phone(t, at)):
                end["phone"] = found[0]
                if found[1]:
                    out["phone"].append((at, found[0]))
        elif kind == ":":
            if at >= end["url"]:
                add("url", _url(t, at, last + 1))
        elif kind == "a":
            if last >= end["account"]:
                add("account", _account(t, at, last + 1))
        elif kind == "s":
            if last + 1 >= end["secret"]:
                add("secret", _value(t, last + 1))
        elif at >= end["secret"] and _word_start(t, at):
            stop = _run(t, last + 1, ALNUM)
            add("secret", (at, stop) if stop - last - 1 == 16 and t[at:stop].upper() == t[at:stop] else None)
    return out


def _listed(spans: dict, kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in blocks(batches):
        spans = [find_spans(t) for t in texts]
        counts = [pa.array([len(s[k]) for s in spans], pa.int64()) for k in BASE]
        base = [_listed(s, BASE) for s in spans]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *counts, pa.array(base, pa.string()), pa.array([_listed(s, KINDS) for s in spans], pa.string())],
            names=["doc_id", *(f"n_{k}" for k in BASE), "base", "spans"],
        )


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans), a row for each document; spans as kind:start:end."""
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return id_text(docs, doc_id, text).mapInArrow(_found, f"doc_id long, {counts}, base string, spans string")


def mask(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    spans = sorted((a, -b, k) for k, found in find_spans(text).items() for a, b in found)
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with personal data in the text replaced and, if there, its length in ``n_chars``; all other columns as they were."""

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(mask)

    out = docs.withColumn(text, masked(F.col(f"`{text}`")))
    return out.withColumn(n_chars, F.length(F.col(f"`{text}`")).cast("long")) if n_chars in docs.columns else out


def base_sha256(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
