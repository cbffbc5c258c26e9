"""Personal data: base patterns over the source text, and disguised identifiers found through offset-preserving maps.

A cascade of transducers rewrites a text to normal forms: look-alike letters and digits, unseen characters, spelled-out
digits, letters among digits and "at"/"dot" disguises become plain. A transducer is an automaton (a compiled pattern) that
reads its text once, and a rule for what it writes in place of each stretch it accepts. What it leaves behind is a list
of these stretches, so a map back to the source takes memory by disguises, not by characters; maps are followed from the
last transducer to the first. The base patterns run over the normal forms, and what they find is mapped back to
source offsets. Spans that the base patterns found stay as they are; a disguised one is added unless a single span holds
it whole, as a base span can be a fragment of it.

A bare "at" is a disguise before a domain with a worded or bracketed "dot". Before a plain domain, as in "look at
example.com", it is one only if the name before it holds a mark or digit, if a word for mail stands shortly before it, or
if the line holds nothing else.

Defined results: a null text counts as empty and has no spans; texts are scanned whole at any length; equal rows give
equal rows; an empty table gives an empty result; the other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalane.llm.common import text_slices

KINDS = ("email", "ip", "card", "phone")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def _emails(text: str):
    """Leftmost matches of local@domain: a match can only end behind an @, so only those are looked at."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, (done := found.end())
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, in order of start, then kind."""
    spans = [Span(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (y.lstrip("0") or "0" for y in m[0].split("."))):
            spans.append(Span(m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(Span(m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append(Span(m.start(), 3, m.end()))
    return sorted(spans)


def _homoglyphs() -> dict[str, str]:
    plain = dict(zip("АВЕКМНОРСТУХавекмнорстухіјѕԁһӏ", "ABEKMHOPCTYXabekmhopctyxijsdhl"))  # Cyrillic
    plain |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιναρυ", "ABEZHIKMNOPTYXoivapu"))  # Greek
    plain |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full width
    for zero in (0x660, 0x6F0, 0x966, 0x9E6, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # other scripts' digits
        plain |= {chr(zero + i): str(i) for i in range(10)}
    plain |= {"․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", "﹫": "@"}
    return plain | dict.fromkeys("​‌‍⁠﻿­", "")  # unseen characters


HOMOGLYPHS = _homoglyphs()
_ALIKE = str.maketrans({k: v for k, v in HOMOGLYPHS.items() if v})
_UNSEEN = re.compile("[" + "".join(k for k, v in HOMOGLYPHS.items() if not v) + "]+")
_NAMES = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT_NAMES = [n for n in _NAMES if n != "oh"]
_NAME = "(?:" + "|".join(_NAMES) + ")"
#: Runs of at least seven spelled digits; "plus" before them stands for +.
_SPELLED = re.compile(rf"(?:\bplus[\s,-]+)?\b{_NAME}(?:[\s,.-]+{_NAME})" r"{6,}\b", re.I)
_SPELLED_ITEM = re.compile(rf"plus|{_NAME}", re.I)
#: Four or more digits, spelled or plain, with nothing but blanks, marks and dots between; no pattern of numbers has fewer.
_ITEM = rf"(?:\b{_NAME}\b|[0-9])"
_GROUP = re.compile(rf"(?:\bplus[\s,-]+)?{_ITEM}(?:(?:[\s,.()\[\]{{}}<>-]|\bdot\b)*+{_ITEM}){{3,}}+", re.I)
_GROUP_ITEM = re.compile(rf"\bplus\b|\b{_NAME}\b|[0-9]+", re.I)
_APART = re.compile(r"[\s,-]+")
_AT = rf"(?:\s{{0,3}}[\[({{<]\s{{0,3}}(?:at|@)\s{{0,3}}[\])}}>]\s{{0,3}}|\s+(?:at|@)\s+|\s{{0,3}}@\s{{0,3}})"
_DOT = rf"(?:\s{{0,3}}[\[({{<]\s{{0,3}}(?:dot|\.)\s{{0,3}}[\])}}>]\s{{0,3}}|\s+dot\s+|\.)"
_WORDED_DOT = rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:dot|\.)\s{{0,3}}[\])}}>]\s{{0,3}}|\s+dot\s+"
_NAME_PART = r"[A-Za-z0-9._%+-]+"
_DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+-]){_NAME_PART}(?:(?:{_WORDED_DOT}){_NAME_PART}){{0,3}}{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
#: What a lower-cased text with disguised marks, or a whole spelled digit, holds; literals lead, which makes misses quick.
_BRACKETED = re.compile(r"[\[({<]\s{0,3}(?:at|dot|@|\.)\s{0,3}[\])}>]")
_WORDED = re.compile(r"dot(?<=\sdot)\s|at(?<=\sat)\s+[a-z0-9-]+\.[a-z]")
_APART_MARK = re.compile(r"@\s|@(?<=\s@)")
_WHOLE_NAME = re.compile("(?:" + "|".join(_DIGIT_NAMES) + r")\b")
_DOTTED_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_AT_ONLY, _DOT_ONLY = re.compile(_AT, re.I), re.compile(_WORDED_DOT, re.I)
_MAIL_WORD = re.compile(r"\b(?:e-?mails?|mail|write|contact|reach|address)\b[^\n]{0,24}$", re.I)
#: Numbers in which letters stand for 1 and 0: groups of digits and such letters, apart from other letters.
_LETTERED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9lIOo]+(?:[ .()-]{1,2}[0-9lIOo]+)*+(?![A-Za-z0-9])")
_LETTERED_MARK = re.compile(r"[0-9](?:(?<=[lIOo].)|[lIOo]|[ .-][lIOo]{1,4}[ .-][0-9])")
_LETTER_DIGITS = str.maketrans("lIOo", "1100")

Edit = tuple[int, int, str]


class Stretches:
    """Where the stretches that one transducer rewrote lie, before and after: its text's offsets to those of the text read."""

    def __init__(self, edits: Iterable[Edit]):
        self.read_start, self.read_end, self.start, self.end = (array("q") for _ in range(4))
        shift = 0
        for s, e, new in edits:
            self.read_start.append(s)
            self.read_end.append(e)
            self.start.append(s + shift)
            self.end.append(s + shift + len(new))
            shift += len(new) - (e - s)

    def read(self, at: int) -> tuple[int, int]:
        """The stretch of the text read that the character written at `at` stands for."""
        k = bisect_right(self.start, at) - 1
        while k >= 0 and self.start[k] == self.end[k] and at < self.end[k]:
            k -= 1
        if k < 0:
            return at, at + 1
        if at < self.end[k]:
            return self.read_start[k], self.read_end[k]
        return at - self.end[k] + self.read_end[k], at - self.end[k] + self.read_end[k] + 1


class Normal:
    """What a cascade of transducers has written so far, and the maps back to its source."""

    def __init__(self, text: str):
        self.text, self.maps = text, []

    def through(self, edits: list[Edit]) -> Normal:
        """Replaces stretches (start, end, new), in order and apart; each new character stands for its whole stretch."""
        if edits:
            out, at = [], 0
            for s, e, new in edits:
                out += (self.text[at:s], new)
                at = e
            self.text = "".join([*out, self.text[at:]])
            self.maps.append(Stretches(edits))
        return self

    def source(self, start: int, end: int) -> tuple[int, int]:
        last = end - 1
        first, stop = start, end
        for stretches in reversed(self.maps):
            first, stop = stretches.read(first)[0], stretches.read(last)[1]
            last = stop - 1
        return first, stop


def seen(text: str) -> Normal:
    """Look-alikes become what they look like, one for one; unseen characters go."""
    return Normal(text.translate(_ALIKE)).through([(m.start(), m.end(), "") for m in _UNSEEN.finditer(text)])


def spelled_runs(text: str) -> list[Edit]:
    """Digits for long runs of spelled ones; each stands for its own word, separators go with the word before them."""
    edits = []
    for run in _SPELLED.finditer(text):
        items = list(_SPELLED_ITEM.finditer(text, run.start(), run.end()))
        edits += [(m.start(), n.start() if n else run.end(), _NAMES.get(m[0].lower(), "+")) for m, n in zip(items, [*items[1:], None])]
    return edits


def spelled_groups(text: str) -> list[Edit]:
    """Digits for every spelled digit of a group, in runs of any length and next to plain digits."""
    edits = []
    for group in _GROUP.finditer(text):
        items = [m for m in _GROUP_ITEM.finditer(text, group.start(), group.end()) if m[0][0].isdigit() or m[0].lower() == "plus" or m[0].lower() in _NAMES]
        for m, n in zip(items, [*items[1:], None]):
            apart = n is not None and _APART.fullmatch(text, m.end(), n.start())
            if not m[0][0].isdigit():
                edits.append((m.start(), n.start() if apart else m.end(), _NAMES.get(m[0].lower(), "+")))
            elif apart and not n[0][0].isdigit() and apart[0] not in " -":
                edits.append((m.end(), n.start(), " "))
    return edits


def lettered_digits(text: str) -> list[Edit]:
    """Digits for l, I, O and o within numbers that hold more digits than such letters."""
    edits = []
    for m in _LETTERED.finditer(text):
        plain = sum(map(str.isdigit, m[0]))
        if plain >= 3 and plain < sum(map(str.isalnum, m[0])) <= 2 * plain:
            edits.append((m.start(), m.end(), m[0].translate(_LETTER_DIGITS)))
    return [(s + i, s + i + 1, c) for s, e, new in edits for i, c in enumerate(new) if c != text[s + i]]


def undisguised(text: str) -> list[Edit]:
    """@ and . for worded or bracketed ones within what has the shape of a mail address."""
    edits = []
    for m in _DISGUISED.finditer(text):
        at = _AT_ONLY.search(text, m.start(), m.end())
        if at[0] == "@" and "(" not in m[0] and "[" not in m[0] and "{" not in m[0] and " " not in m[0]:
            continue
        if at[0].strip().lower() == "at" and not _DOT_ONLY.search(text, at.end(), m.end()) and not _addressed(text, m, at):
            continue
        edits += [(d.start(), d.end(), ".") for d in _DOT_ONLY.finditer(text, m.start(), at.start())]
        edits.append((at.start(), at.end(), "@"))
        edits += [(d.start(), d.end(), ".") for d in _DOT_ONLY.finditer(text, at.end(), m.end())]
    return edits


def _addressed(text: str, m: re.Match, at: re.Match) -> bool:
    """Whether a bare "at" before a plain domain is that of an address."""
    name = text[m.start() : at.start()]
    if re.search(r"[0-9_%+]|[a-z][.-][a-z]", name, re.I) or _MAIL_WORD.search(text, max(0, m.start() - 40), m.start()):
        return not name.endswith(".")
    begin, stop = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
    return not text[begin : m.start()].strip() and not text[m.end() : stop if stop >= 0 else len(text)].strip(" \t\r.")


def undotted(text: str) -> list[Edit]:
    """Plain dots for worded or bracketed ones between the numbers of an address."""
    return [(d.start(), d.end(), ".") for m in _DOTTED_IP.finditer(text) for d in _DOT_ONLY.finditer(text, m.start(), m.end())]


def normal_forms(text: str) -> Iterator[Normal]:
    """The normal forms of a text in which something was disguised.

    Spelled digits are rewritten by runs in one and by groups in another, as a spelled digit beside an identifier may
    belong to it or not; letters among digits in a third.
    """
    strange = not text.isascii() and not HOMOGLYPHS.keys().isdisjoint(text)
    first = seen(text) if strange else Normal(text)
    low = first.text.lower()
    names = sum(map(low.count, _DIGIT_NAMES))
    names = names if names and _WHOLE_NAME.search(low) else 0
    marked = _BRACKETED.search(low) or _WORDED.search(low) or ("@" in low and _APART_MARK.search(low))
    if strange or marked or names:
        plain, unseen = first.text, list(first.maps)

        def cascade(*transducers) -> Normal:
            form = Normal(plain)
            form.maps = list(unseen)
            for transducer in transducers:
                form.through(transducer(form.text))
            return form

        runs = names >= 5 and _SPELLED.search(plain)
        if strange or marked or runs:
            yield cascade(spelled_runs, undisguised, undotted)
        if names and (edits := spelled_groups(plain)):
            yield cascade(lambda _: edits, undisguised, undotted)
    if _LETTERED_MARK.search(first.text) and (edits := lettered_digits(first.text)):
        first.through(edits)
        yield first.through(undotted(first.text))


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans with the disguised ones."""
    base = base_spans(text)
    added: list[Span] = []
    for normal in normal_forms(text):
        for s, kind, e in base_spans(normal.text):
            start, end = normal.source(s, e)
            if not any(x.start <= start and end <= x.end for x in (*base, *added)):
                added.append(Span(start, kind, end))
    return base, sorted([*base, *added]) if added else base


def described(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[x.kind]}:{x.start}:{x.end}" for x in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; where spans of several kinds overlap, their union is, by the first."""
    out, at = [], 0
    k = 0
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1].start < end:
            k += 1
            end = max(end, spans[k].end)
        out += (text[at:start], MASKS[KINDS[kind]])
        at = end
        k += 1
    return "".join([*out, text[at:]])


def digests(docs: DataFrame) -> DataFrame:
    """Per document the counts of its spans, a hash of the base spans and all spans in words."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    base, spans = all_spans(text)
                    counts = [sum(x.kind == k for x in spans) for k in range(4)]
                    rows.append((*counts, len(spans), hashlib.sha256(described(base).encode()).hexdigest(), described(spans)))
                columns = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x, type=pa.int64()) for x in columns[:5]), *(pa.array(x, type=pa.string()) for x in columns[5:])],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_spans", "base_sha256", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_spans long, base_sha256 string, spans string")


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with what was found in `text` masked; a null text stays null, and every other column as it was."""
    at = docs.columns.index(text)
    # Columns go by their places, as their names may hold dots.
    placed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches):
        for batch in batches:
            null, start = batch.column(at).is_null().to_pylist(), 0
            for part in text_slices(batch, f"c{at}"):
                texts = part.column(at).to_pylist()
                new = [None if no else masked(x, all_spans(x)[1]) for x, no in zip(texts, null[start : start + len(texts)])]
                start += len(texts)
                yield part.set_column(at, batch.schema.field(at), pa.array(new, type=batch.schema.field(at).type))

    return placed.mapInArrow(run, placed.schema).toDF(*docs.columns)
