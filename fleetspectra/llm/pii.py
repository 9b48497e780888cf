"""Personal data, also in disguise, with spans in the source text.

Plain identifiers are found in the source itself. Disguised ones are found in a normalised copy: a chain of
transducers rewrites the text and carries along, for every character it writes, the source characters that
it stands for. A match in the copy is mapped back, so every span is given in code points of the source.

Transducers, in this order:

1. ``fold``: full-width forms, digits of other scripts and look-alike letters become ASCII; invisible
   characters vanish.
2. ``digits``: runs of spelled digits ("four one double five") become digits, "plus" before them a plus;
   "dot" and the like join runs to one ("one nine two dot one") and become dots.
3. ``marks``: "[at]", "(dot)", " dot " and the like become ``@`` and ``.``; a bare " at " only in front of a
   domain that is disguised itself or ends in a well-known label.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetspectra.llm.common import small_batches, take

# The kinds in their order, and what counts as one of them.
KINDS = ("email", "ip", "card", "phone")
# An address is found from its "@": what stands before it in the first class, and a domain after it.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The leftmost match never starts inside a run of digits; saying so keeps long runs linear.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
CARD_DIGITS = (14, 19)
PHONE_DIGITS = (10, 15)

# Letters of other scripts that look like ASCII ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B", "Е": "E",
    "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "κ": "k", "τ": "t", "υ": "u", "Α": "A",
    "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ℓ": "l", "․": ".", "。": ".", "·": ".",
    "\u2022": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-",
    "\u00a0": " ", "\u2007": " ", "\u202f": " ",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
REPEATS = {"double": 2, "triple": 3}
# Last labels of a domain that let a bare " at " count.
KNOWN_LABELS = "com org net edu gov io info biz de fr es uk eu us"
# A run of fewer spelled digits is prose, unless it makes a whole IP address.
LEAST_DIGITS = 3


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _holds(kind: str, match: str) -> bool:
    if kind == "ip":
        parts = (p.lstrip("0") for p in match.split("."))
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    digits = re.sub("[^0-9]", "", match)
    if kind == "card":
        return CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)
    return PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1]


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses that do not overlap; every character is looked at a bounded number of times."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def _finds(kind: str, text: str) -> list[tuple[int, int]]:
    if kind == "email":
        return _emails(text)
    found = PATTERNS[kind].finditer(text)
    return [m.span() for m in found if _holds(kind, m.group())]


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of undisguised identifiers: leftmost, not overlapping per kind."""
    out = []
    for k, (kind, mark) in enumerate(zip(KINDS, ("@", ".", "", "+"))):
        if mark in text:
            out += [(a, b, k) for a, b in _finds(kind, text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


class Tape:
    """A text and the way back to its source. Rules leave the rest of the text as it is.

    Every rewriting keeps its edits only: where they are in the new text, and what they stand for in the
    old one. So the way back costs a search per rewriting, and long texts cost no more than their edits.
    """

    def __init__(self, text: str):
        self.text = text
        self.rewritings: list[tuple[list[int], list[int], list[int], list[int]]] = []

    def rewrite(self, pattern: re.Pattern, fn) -> None:
        """Replace each match by ``fn(match)``, or keep it where that gives None."""
        out, at, size = [], 0, 0
        edits: tuple[list[int], list[int], list[int], list[int]] = ([], [], [], [])
        for m in pattern.finditer(self.text):
            new = fn(m)
            if new is None:
                continue
            a, b = m.span()
            out += [self.text[at:a], new]
            size += a - at
            for values, v in zip(edits, (size, size + len(new), a, b)):
                values.append(v)
            size += len(new)
            at = b
        if out:
            out.append(self.text[at:])
            self.text = "".join(out)
            self.rewritings.append(edits)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the rewritten text."""
        first, last = start, end - 1
        for new_start, new_end, old_start, old_end in reversed(self.rewritings):
            i, j = bisect_right(new_start, first) - 1, bisect_right(new_start, last) - 1
            if i >= 0:
                inside = first < new_end[i]
                first = old_start[i] if inside else first + old_end[i] - new_end[i]
            if j >= 0:
                inside = last < new_end[j]
                last = old_end[j] - 1 if inside else last + old_end[j] - new_end[j]
        return first, last + 1


_FOLD = re.compile(
    "[" + re.escape("".join(LOOK_ALIKES) + INVISIBLE) + r"\uff01-\uff5e\u3000]|(?![0-9])\d"
)
_WORD = "|".join([*DIGIT_WORDS, *REPEATS])
_GAP = r"[\x20,.\t-]{1,3}"
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_DOT = rf"(?:\x20(?:dot|punkt|point|punto)\x20|\s?{_OPEN}\s?(?:dot|\.)\s?{_SHUT}\s?)"
_RUN = rf"(?:{_WORD}|[0-9]+)(?:{_GAP}(?:{_WORD}|[0-9]+))*"
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:(plus)\x20)?({_RUN}(?:{_DOT}{_RUN})*)(?![^\W_])")
_SPELLED_DOT = re.compile(rf"(?i)({_DOT})")
# Where a spelled run can be at all: a digit word next to another one or to a number.
_SPELLED_HINT = re.compile(
    rf"(?i)(?<![^\W_])(?:(?:{_WORD})(?:{_GAP}|{_DOT})(?:{_WORD}|[0-9]+)|[0-9]+(?:{_GAP}|{_DOT})(?:{_WORD}))(?![^\W_])"
)
_BRACKET_AT = re.compile(rf"(?i)\s?{_OPEN}\s?(?:at|@)\s?{_SHUT}\s?")
_BRACKET_DOT = re.compile(rf"(?i)\s?{_OPEN}\s?(?:dot|\.)\s?{_SHUT}\s?")
_LABEL = r"[A-Za-z0-9-]+"
_BARE_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9])\x20(?:dot|punkt|point|punto)\x20(?=[A-Za-z0-9])")
_BARE_AT = re.compile(
    rf"(?i)(?<=[A-Za-z0-9])\x20at\x20(?={_LABEL}(?:\.{_LABEL})*(\.)(?:{'|'.join(KNOWN_LABELS.split())})(?![A-Za-z0-9-]))"
)
_HINT = re.compile(
    rf"(?i){_OPEN}\s?(?:at|dot|@|\.)\s?{_SHUT}|\x20(?:dot|punkt|point|punto)\x20|\x20at\x20{_LABEL}\."
)


def _fold(m: re.Match) -> str:
    c = m.group()
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c in INVISIBLE:
        return ""
    if "\uff01" <= c <= "\uff5e":
        return chr(ord(c) - 0xFEE0)
    return " " if c == "\u3000" else str(int(c))


def _digits(run: str) -> tuple[str, int] | None:
    """Digits of a run without dots and how many are spelled, or None where it ends in a repeat."""
    out, times, spoken = [], 1, 0
    for word in re.findall(r"[A-Za-z]+|[0-9]+", run):
        lower = word.lower()
        if lower in REPEATS:
            times = REPEATS[lower]
            continue
        spoken += lower in DIGIT_WORDS
        out.append(DIGIT_WORDS.get(lower, word) * times)
        times = 1
    return ("".join(out), spoken) if times == 1 else None


def _address(read: list[tuple[str, int] | None]) -> str | None:
    """The IP address that four runs make, if some digit of it is spelled."""
    if len(read) != 4 or None in read or not any(spoken for _, spoken in read):
        return None
    text = ".".join(digits for digits, _ in read)
    return text if _holds("ip", text) else None


def _spelled(m: re.Match) -> str | None:
    """Digits of a spelled run; the run may hold plain numbers, but needs spelled ones as well."""
    plus = "+" if m.group(1) else ""
    parts = _SPELLED_DOT.split(m.group(2))
    read = [_digits(r) for r in parts[::2]]
    if not plus:
        address = _address(read)
        if address is None and len(parts) == 1 and parts[0].count(".") == 3:
            address = _address([_digits(r) for r in parts[0].split(".")])
        if address:
            return address
    if None not in read:
        if sum(spoken for _, spoken in read) < LEAST_DIGITS:
            return None
        return plus + ".".join(digits for digits, _ in read)
    # Where a part makes no sense, each stands for itself.
    good = [r is not None and r[1] >= LEAST_DIGITS for r in read]
    if not any(good):
        return None
    parts[::2] = [r[0] if ok else old for r, ok, old in zip(read, good, parts[::2])]
    head = "" if not plus else plus if good[0] else m.string[m.start() : m.start(2)]
    return head + "".join(parts)


def normalised(text: str) -> Tape | None:
    """The text after all transducers, or None if none of them changes it."""
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(_FOLD, _fold)
    if _SPELLED_HINT.search(tape.text):
        # "dot" between spelled numbers joins them, so it is read together with them.
        tape.rewrite(_SPELLED, _spelled)
    if _HINT.search(tape.text):
        tape.rewrite(_BRACKET_AT, lambda m: "@")
        tape.rewrite(_BRACKET_DOT, lambda m: ".")
        tape.rewrite(_BARE_DOT, lambda m: ".")
        tape.rewrite(_BARE_AT, lambda m: "@")
    return tape if tape.text != text else None


def disguised_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifiers that show in the normalised text only, or reach farther there, as source spans."""
    tape = normalised(text)
    if tape is None:
        return []
    out = []
    for a, b, k in plain_spans(tape.text):
        start, end = tape.source(a, b)
        # A plain span that covers it says the same or more.
        if not any(s <= start and end <= e for s, e, _ in plain):
            out.append((start, end, k))
    return out


def digest_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, plain, disguised``, lists of ``start, end, kind``.

    Spans are in code points of the source, end exclusive, by start and kind. A null text is empty and has
    none; repeated rows give repeated results; an empty table gives an empty result; further columns are
    ignored. Texts are read whole, one at a time.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def column(found: list[list[tuple[int, int, int]]]) -> pa.Array:
        rows = [[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in f] for f in found]
        return pa.array(rows, pa.list_(span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, hidden = [], []
            for value in batch.column("text"):
                source = value.as_py() or ""
                plain.append(plain_spans(source))
                hidden.append(disguised_spans(source, plain[-1]))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "plain": column(plain),
                    "disguised": column(hidden),
                }
            )

    spans = "array<struct<start: bigint, end: bigint, kind: string>>"
    return take(small_batches(docs), doc_id=doc_id, text=text).mapInArrow(
        run, f"doc_id long, plain {spans}, disguised {spans}"
    )
