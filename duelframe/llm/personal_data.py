"""Personal data in texts, disguised forms included, at offsets of the original text.

Base identifiers are found in the text itself: e-mail addresses, IPv4 addresses, payment card numbers
(14 to 19 digits, Luhn) and phone numbers with a country code. A transducer then writes a normalised
text in which every character knows the source characters it stands for: look-alike letters and
digits become ASCII, zero-width characters vanish, runs of spelled digits become digits, and
at/dot disguises become signs. The same detectors run on it and each match is mapped back; a match that
equals a base span of its kind or lies inside one is dropped, a wider or differing one stands beside it.
Base spans stay as they are.

Null and empty texts have no spans; repeated rows are judged alike; an empty table gives an empty result;
columns other than doc_id and text are left out.
"""

from __future__ import annotations

import re
import string

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# Patterns of the base identifiers.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Characters that look like ASCII ones (Cyrillic, Greek, other signs).
LOOKALIKES = dict(zip("авеіјкмнорсԁтухѕԛԝһАВЕІЈКМНОРСТУХЅαικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。∙＠﹫", "abeijkmhopcdtyxsqwhABEIJKMHOPCTYXSaikvoptuxABEZHIKMNOPTYX...@@"))
WIDE = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}                       # full-width forms
DIGITS = {chr(start + d): str(d) for start in (0x0660, 0x06F0, 0x0966) for d in range(10)}
UNSEEN = "​‌‍⁠﻿­"
SINGLE = LOOKALIKES | WIDE | DIGITS | {c: "" for c in UNSEEN}
# Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_WORD = "|".join(SPELLED)
_ODD = re.compile("[" + re.escape("".join(SINGLE)) + "]")
_RUN = re.compile(rf"(?:(?<![A-Za-z])plus[\s-]+)?(?<![A-Za-z])(?:{_WORD})(?:[\s,.-]+(?:{_WORD}|[0-9]))*(?![A-Za-z])", re.I)
_NAME = r"[A-Za-z0-9%+_-]"
_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_AT = re.compile(rf"(?<={_NAME}){_OPEN}(?:at|@){_CLOSE}(?={_NAME})", re.I)
_DOT = re.compile(rf"(?<={_NAME}){_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}(?={_NAME})", re.I)
# After ' at ' a domain: names joined by ' dot ', or by '.' (signs that _DOT wrote among them) where the last one has a letter.
_BARE = re.compile(rf"(?<={_NAME})(\s+at\s+)(?={_NAME}+(?:(?:\.|\s+dot\s+){_NAME}+)*(?:\s+dot\s+{_NAME}|\.[0-9%+_-]*[A-Za-z]))|(?<={_NAME})(\s+dot\s+)(?={_NAME})", re.I)
# Matches wherever one of the patterns above does: brackets, ' dot ', ' at ' before a dotted name, a spelled digit next to another or to a figure.
_HINT = re.compile(rf"[\[({{<]\s*(?:at|@|dot|punkt|point|punto|\.)\s*[\])}}>]|\sdot\s|\sat\s+{_NAME}+\.|(?<![A-Za-z])(?:{_WORD})[\s,.-]+(?:{_WORD}|[0-9])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


#: The same as IP in linear time: a digit run fails or matches as a whole, so only its start is tried.
_IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of EMAIL in linear time: each @ is extended to the left, up to the last match or @, then to the right."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        low = domain.end() if domain else at + 1
        at = text.find("@", low)
    return found


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the valid identifiers, leftmost and non-overlapping within a kind."""
    spans = []
    spans += [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            spans += [("ip", m.start(), m.end()) for m in _IP_RUNS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
        if "+" in text:
            spans += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return spans


_DIGIT = re.compile("[0-9]")


class Trace:
    """A rewritten text whose characters carry the source span they stand for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, replace) -> None:
        out, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = replace(m)
            if new is None:
                continue
            a, b = m.span()
            out.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            for k, (c, lo, hi) in enumerate(new):
                out.append(c)
                start.append(self.start[a + lo])
                end.append(self.end[a + hi - 1])
            at = b
        if not out and not at:
            return
        out.append(self.text[at:])
        start += self.start[at:]
        end += self.end[at:]
        self.text, self.start, self.end = "".join(out), start, end


def _single(m: re.Match):
    return [(c, 0, len(m.group())) for c in SINGLE[m.group()]]


def _spelled(m: re.Match):
    out = []
    for w in re.finditer(rf"plus|{_WORD}|[0-9]", m.group(), re.I):
        out.append(("+" if w.group().lower() == "plus" else SPELLED.get(w.group().lower(), w.group()), w.start(), w.end()))
    return out if len(out) >= 3 else None


def normalise(text: str) -> Trace:
    trace = Trace(text)
    trace.rewrite(_ODD, _single)
    trace.rewrite(_AT, lambda m: [("@", 0, len(m.group()))])
    trace.rewrite(_DOT, lambda m: [(".", 0, len(m.group()))])
    trace.rewrite(_BARE, lambda m: [("@" if m.group(1) else ".", 0, len(m.group()))])
    trace.rewrite(_RUN, _spelled)
    return trace


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans added by the transducer), each by start and kind."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(detect(text), key=order)
    if plain(text):
        return base, []
    return base, sorted(hidden(text, base), key=order)


def plain(text: str) -> bool:
    """Nothing in the text is rewritten by `normalise`."""
    return (text.isascii() or not _ODD.search(text)) and not _HINT.search(text)


def hidden(text: str, base: list[tuple[str, int, int]]) -> set[tuple[str, int, int]]:
    """Spans of the normalised text that are no part of a base span of their kind."""
    trace = normalise(text)
    added = set()
    places = {kind: sorted((s, e) for k, s, e in base if k == kind) for kind in KINDS}
    for kind, a, b in detect(trace.text):
        lo, hi = min(trace.start[a:b]), max(trace.end[a:b])
        before = bisect_right(places[kind], lo, key=lambda p: p[0])     # spans of a kind don't overlap: only the last one that starts in time can hold it
        if not before or places[kind][before - 1][1] < hi:
            added.add((kind, lo, hi))
    return added


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches):
    for batch in batches:
        base, added = [], []
        for text in batch.column("text").to_pylist():
            b, a = find(text or "")
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in b])
            added.append([{"kind": k, "start": s, "end": e} for k, s, e in a])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(added, kind)], names=["doc_id", "base", "added"])


SPANS = "array<struct<kind: string, start: int, end: int>>"


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): spans of each text in code points, end exclusive."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, f"doc_id long, base {SPANS}, added {SPANS}")


def digests(spans: DataFrame) -> DataFrame:
    """Counts and digests: n_* and base_sha256 are of the base identifiers, `spans` has all of them, n_added the others."""
    def text(c):
        place = F.transform(c, lambda s: F.struct(s["start"], F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["end"], s["kind"].alias("kind")))
        return F.concat_ws(",", F.transform(F.array_sort(place), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
