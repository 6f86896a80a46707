"""Operator 7, personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds: email, secret, iban, card, phone, ssn, ip (v4 and v6).
"""

from __future__ import annotations

import bisect
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import free

#: Characters on either side of a span in which context words count.
WINDOW = 40
THRESHOLD = 0.5
RAISE, LOWER = 0.25, 0.35


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern
    base: float
    #: Words that make the kind likelier, or unlikelier, next to the span. The latter count only where no checksum
    #: confirmed the span and none of the former is there.
    near: frozenset[str]
    against: frozenset[str]
    #: Strings of which every text with a span of the kind has one; texts without any are skipped.
    needs: tuple[str, ...]
    #: The same of the text in lower case; none if empty.
    words: tuple[str, ...] = ()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


#: A quoted value of at least 12 characters runs to its closing quote, on the same line and past escaped ones; a bare one,
#: or one that is not closed, to white space. A closed quote of fewer characters is no secret.
SECRET = re.compile(
    r"(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd)[\"']?\s{0,3}(?>:=|=>|={1,3}|::?)\s{0,3}"
    r"(?:\"(?P<double>(?:\\.|[^\"\\\n]){12,}+)\"|'(?P<single>(?:\\.|[^'\\\n]){12,}+)'"
    r"|(?:\"(?!(?:\\.|[^\"\\\n])*+\")|'(?!(?:\\.|[^'\\\n])*+')|(?![\"']))(?P<bare>\S{12,}))"
)
#: Secrets that need no name before them: cloud, code host and chat keys, signed tokens, bearer tokens, private keys in PEM
#: (to the end mark, or else to the next dashes).
KNOWN = re.compile(
    r"(?<![A-Za-z0-9_-])(?P<key>A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}|sk-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?)(?![A-Za-z0-9_-])"
    r"|(?<![A-Za-z0-9])(?:[Bb]earer|BEARER)\s{1,3}(?P<bearer>[A-Za-z0-9._~+/=-]{16,})"
    r"|-----BEGIN\ (?P<pem>[A-Z0-9 ]{0,40}PRIVATE\ KEY-----(?:[^-]|-(?!----))*+(?:-----END\ [A-Z0-9 ]{0,40}-----)?)"
)
KNOWN_NEEDS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "xox", "AIza", "eyJ", "earer", "BEARER", "PRIVATE KEY-----")
#: Words of which, in lower case, every named secret has one.
SECRET_WORDS = ("key", "secret", "token", "passw", "pwd")
DIGITS = tuple("0123456789")
_W = frozenset
PHONE = _W("phone tel telephone mobile call fax telefon teléfono téléphone handy móvil".split())
KINDS = (
    Kind("email", re.compile(r"(?<![\w.+%-])\w[\w.+%-]{0,63}@(?:[^\W_](?:[\w-]{0,62}[^\W_])?\.){1,8}[^\W\d_]{2,24}(?![\w@-])"), 0.9, _W("email mail contact kontakt correo courriel".split()), _W(), ("@",)),
    Kind("secret", SECRET, 0.85, _W("key auth bearer credentials".split()), _W("example placeholder".split()), ("=", ":"), SECRET_WORDS),
    Kind("secret", KNOWN, 0.85, _W("key auth bearer credentials".split()), _W("example placeholder".split()), KNOWN_NEEDS),
    # looked ahead at, as a match may run on into the next one
    Kind("iban", re.compile(r"(?<![A-Za-z0-9])(?=(?P<ahead>[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])))"), 0.2, _W("iban bank account konto compte cuenta".split()), _W(), DIGITS),
    Kind("card", re.compile(r"\d+(?:[ -]\d+)*"), 0.2, _W("card visa mastercard amex credit karte carte tarjeta".split()), _W(), DIGITS),
    Kind("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]|\.\d)"), 0.6, PHONE, _W("order isbn invoice version".split()), DIGITS),
    # without country code only beside a word that tells
    Kind("phone", re.compile(r"(?<![\w.,+-])(?:0\d{1,5}[ /-]{1,3}\d{2,8}(?:[ -]\d{2,6}){0,3}|0\d{6,12}|\d{3} \d{3} \d{4})(?![\w-]|[.,]\d)"), 0.3, PHONE, _W("order isbn invoice version".split()), DIGITS),
    Kind("ssn", re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"), 0.55, _W("ssn social security".split()), _W("order part invoice".split()), DIGITS),
    Kind("ip", re.compile(r"(?<![\w:.])[0-9A-Fa-f:]{3,39}(?![\w:]|\.\d)"), 0.3, _W("ip ipv6 address host server adresse".split()), _W("version release section chapter v".split()), (":",)),
    Kind("ip", re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\w)"), 0.6, _W("ip address host server adresse".split()), _W("version release section chapter v".split()), DIGITS),
)
WORD = re.compile(r"\w+")
GROUP = re.compile(r"\d+")
#: Card numbers of the known issuers, and the groups that they are printed in besides a single one. Any number that
#: passes Luhn counts; of overlapping ones those of both come first, then those of a known issuer.
ISSUED = re.compile(
    r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11,16}"
    r"|(?:6011|64[4-9]\d|65\d\d|62\d\d|35(?:2[89]|[3-8]\d))\d{12,15}|(?:5018|5020|5038|5893|6304|6759|676[1-3])\d{9,15}"
)
PRINTED = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
#: Characters of an IBAN by country.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 "
    "KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}


def _ipv6(span: str) -> bool:
    try:
        ipaddress.IPv6Address(span)
    except ValueError:
        return False
    return True


def _checked(kind: str, span: str) -> tuple[bool, float]:
    """(passed a checksum, score to add); a failed checksum takes all."""
    if kind == "card":  # _cards proposes none that fails
        return True, 0.6
    if kind == "iban":
        ok = mod97(span.replace(" ", ""))
        return ok, 0.75 if ok else -1.0
    if kind == "ip" and ":" in span:
        # a full address says what it is; short ones ("a::1") need a word beside them
        groups = sum(map(bool, span.split(":")))
        return False, -1.0 if groups < 2 or not _ipv6(span) else 0.3 if groups >= 4 else 0.0
    if kind == "phone" and not 7 <= sum(c.isdigit() for c in span) <= 15:
        return False, -1.0
    return False, 0.0


def _iban_end(text: str, start: int, end: int) -> int:
    """Where an IBAN of its country's length ends within the span (words in capitals may follow it); start if the
    country is unknown, or the span too short or cut within a word."""
    left = IBAN_LENGTHS.get(text[start : start + 2].upper(), 0)
    if not left:
        return start
    for at in range(start, end):
        left -= text[at] != " "
        if not left:
            return at + 1 if at + 1 == len(text) or not text[at + 1].isalnum() else start
    return start


def _cards(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of the card numbers in a run of digit groups, by start: 13 to 19 digits from the start of a group to
    the end of one that pass Luhn and are not one digit repeated. A run may hold other numbers beside a card (expiry
    date, CVV, year, another card). Of overlapping ones the better known stays (ISSUED, PRINTED),
    then the earlier, then the longer."""
    if end - start < 13:
        return []
    groups = [m.span() for m in GROUP.finditer(text, start, end)]
    digits = "".join(text[a:b] for a, b in groups)
    if len(digits) < 13:
        return []
    # sums[p][i]: of the first i digits with those at positions of parity p doubled, so a number is a difference of two
    sums: tuple[list[int], list[int]] = [0], [0]
    for i, c in enumerate(digits):
        d = ord(c) - 48
        twice = d * 2 - 9 * (d > 4)
        sums[i % 2].append(sums[i % 2][-1] + twice)
        sums[1 - i % 2].append(sums[1 - i % 2][-1] + d)
    first, last = 0, len(groups)
    if start and text[start - 1] in ".,+-":
        first = 1
    if text[end : end + 1] in (".", ",") and text[end + 1 : end + 2].isdigit():
        last -= 1
    at = [0]
    for a, b in groups:
        at.append(at[-1] + b - a)
    proposed = []
    for g in range(first, last):
        i = at[g]
        for h in range(g + 1, last + 1):
            j = at[h]
            if j - i > 19:
                break
            if j - i > 12 and (sums[j % 2][j] - sums[j % 2][i]) % 10 == 0 and len(set(digits[i:j])) > 1:
                issued = bool(ISSUED.fullmatch(digits, i, j))
                printed = h == g + 1 or tuple(b - a for a, b in groups[g:h]) in PRINTED
                proposed.append((-issued - (issued and printed), groups[g][0], -groups[h - 1][1]))
    kept: list[tuple[int, int]] = []
    for _, a, b in sorted(proposed):
        i = bisect.bisect_left(kept, (a, -b))
        if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or -b <= kept[i][0]):
            kept.insert(i, (a, -b))
    return kept


def _proposed(kind: str, text: str, m: re.Match) -> list[tuple[int, int, int]]:
    """(where the context before it ends, start, end) of the spans of a match."""
    start, end = m.span(m.lastgroup or 0)
    if kind == "card":
        return [(a, a, b) for a, b in _cards(text, start, end)]
    if kind == "iban":
        end = _iban_end(text, start, end)
    return [(m.start(), start, end)]


def _within(start: int, end: int, spans: list[tuple[int, int]]) -> bool:
    """Whether the span is a part, not the whole, of one of spans (by start, apart from each other)."""
    i = bisect.bisect_right(spans, start, key=lambda s: s[0]) - 1
    return i >= 0 and end <= spans[i][1] and (start, end) != spans[i]


def _named(pattern: re.Pattern, text: str, low: str) -> Iterator[re.Match]:
    """pattern.finditer(text) for named secrets: tried only where a name may begin, as seen in low."""
    starts = set()
    for w in SECRET_WORDS:
        at = low.find(w)
        while at >= 0:
            # names that end in key begin up to 7 characters before it: api_key, access_key
            starts.update(range(max(0, at - 7), at + 1) if w == "key" else (at,))
            at = low.find(w, at + 1)
    end = 0
    for at in sorted(starts):
        if at >= end and (m := pattern.match(text, at)):
            yield m
            end = m.end()


def find(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, checksum passed) of the spans in a text, by start. Where spans overlap the one of the
    higher score stays, then the earlier, then the longer; parts of a secret or an IBAN give way to it. Null has none."""
    if not text:
        return []
    found, low = [], text.lower()
    for k in KINDS:
        if not any(c in text for c in k.needs) or k.words and not any(w in low for w in k.words):
            continue
        matches = _named(k.pattern, text, low) if k.words and len(low) == len(text) else k.pattern.finditer(text)
        for before, start, end in (p for m in matches for p in _proposed(k.name, text, m)):
            checked, score = _checked(k.name, text[start:end]) if end > start else (False, -1.0)
            around = text[max(0, before - WINDOW) : before] + " " + text[end : end + WINDOW]
            words = set(WORD.findall(around.lower()))
            lower = not checked and not words & k.near and bool(words & k.against)
            score = min(1.0, k.base + score + RAISE * bool(words & k.near) - LOWER * lower)
            if score >= threshold:
                found.append((k.name, start, end, round(score, 4), checked))
    # nothing within a secret or an IBAN may take its place, as the rest of it would stay
    for kind in ("secret", "iban"):
        whole: list[tuple[int, int]] = []  # in order, apart from each other: of overlapping ones the earlier, then the longer
        for a, b in sorted((f[1:3] for f in found if f[0] == kind), key=lambda s: (s[0], -s[1])):
            if not whole or a >= whole[-1][1]:
                whole.append((a, b))
        if whole:
            stay = set(whole)
            found = [f for f in found if (f[0] != kind or f[1:3] in stay) and not _within(f[1], f[2], whole)]
    found.sort(key=lambda f: (-f[3], f[1], -f[2]))
    kept: list[tuple[str, int, int, float, bool]] = []  # by start; they don't overlap, so two neighbours decide
    for f in found:
        i = bisect.bisect_left(kept, f[1], key=lambda g: g[1])
        if (i == 0 or kept[i - 1][2] <= f[1]) and (i == len(kept) or f[2] <= kept[i][1]):
            kept.insert(i, f)
    return kept


def redact(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """text with each span replaced by its kind in angle brackets."""
    if not text:
        return text
    at, out = 0, []
    for kind, start, end, _, _ in find(text, threshold):
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


#: Texts that no pattern can match are not sent to Python.
MAY_HOLD = r"[0-9@=:]|A[KS]IA|gh[pousr]_|github_pat_|sk-|xox|AIza|eyJ|[Bb]earer|BEARER|PRIVATE KEY-----"


def pii_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Operator 7: one row for each span: doc_id, kind, start, end (characters, end excluded), score, checksum (whether
    one confirmed it), value_hash (SHA-256 of the span, so that the report holds no personal data itself). Rows of docs
    without a span, null and empty texts give none; repeated rows give theirs each time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *f, t[f[1] : f[2]]) for i, t in zip(b.index, b["body"]) for f in find(t, threshold)]
            o = pd.DataFrame(rows, columns=["at", "kind", "start", "end", "score", "checksum", "value"])
            o.insert(0, "doc_id", b["doc_id"].loc[o["at"]].to_numpy())
            yield o.drop(columns="at")

    kind = docs.schema["doc_id"].dataType.simpleString()
    hit = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("body")).where(F.col("body").rlike(MAY_HOLD))
    o = hit.mapInPandas(run, "doc_id string, kind string, start long, end long, score double, checksum boolean, value string")
    return o.select(F.col("doc_id").cast(kind).alias("doc_id"), "kind", "start", "end", "score", "checksum", F.sha2("value", 256).alias("value_hash"))


def redact_docs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all rows and columns, with the spans of text replaced, and n_chars, if there, set anew on changed rows."""

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([redact(t, threshold) for t in text], index=text.index, dtype=object)

    new, = free(docs, "redacted")
    d = docs.withColumn(new, F.coalesce(clean(F.when(F.col("text").rlike(MAY_HOLD), F.col("text"))), F.col("text")))
    cols = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cols["n_chars"] = F.when(F.col(new) != F.col("text"), F.length(new)).otherwise(F.col("n_chars")).cast(kind)
    return d.select(*(cols.get(c, d[c]).alias(c) for c in docs.columns))
