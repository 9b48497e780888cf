"""Benchmark decontamination by template windows.

A text is rewritten to a template: numbers, units after numbers, and names become typed placeholders, all
other words are lowered and bared of punctuation. A question that was given new numbers and names keeps its
template. Windows of ``WINDOW`` template tokens of the benchmark are hash-joined with all windows of all
documents. For each place where an item fits a document, the slots of the matched windows are compared: every
value of the item must turn into one and the same value everywhere, and no two of its names into one, or the
window is a chance match.

A text is split at white space once, each distinct piece is taken apart once a batch, and three streams of tokens
come from it, so that what surrounds a passage hides nothing: ``v``, its bare words without placeholders,
whatever their case, spacing and punctuation; ``n``, where a run of capitalised words is one name ("Bill
Smith", "University of Texas"), a run of numbers one number ("twenty-five", "1 1/2") and a unit behind it one
unit; ``p``, which is ``n`` with capitalised words plain where they may just open a sentence. Of items there
is ``f`` as well, which is ``n`` with a plain first word.

Each task holds the hashes of the benchmark's windows to see which of its own windows can match; the
benchmark is taken in blocks of a stated size, one pass over the documents each, so a benchmark of any size
is served by bounded memory. The join proper, on hash and complete template, is Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.llm.common import Words, pieces, small_batches, take
from fleetspectra.sources.tables import materialize

WINDOW = 13
# Items shorter than a window match whole. With other values, those of fewer tokens match too much by chance.
LEAST_TOKENS = 6
# With other values, a window needs so many tokens that are not placeholders.
LEAST_PLAIN = 5
# Word for word, items of one or two words are the only ones left out.
LEAST_WORDS = 3
# Windows of the benchmark that tasks hold at a time.
BLOCK_WINDOWS = 500_000

# The ways to read documents, and with what stream of theirs each form of an item is met.
STREAMS = ("v", "n", "p")
FORMS = {"v": "v", "n": "n", "f": "n", "p": "p"}

# Words that are no name where they are capitalised, as far as LEAST_PLAIN counts.
OPENERS = (
    "the this that these those there then an and but or if in on at of for from to with by as is are was were "
    "do does did has have had can could should would he she it they we you his her its their our your my what "
    "which who whose whom when where why how after before later now each every all some many much find"
)
# Number words and units.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
    "million billion half third quarter dozen first second twice"
)
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz ounce ounces pound "
    "pounds ton tons ml l liter liters litre litres gallon gallons cup cups meter meters metre metres "
    "kilometer kilometers kilometre kilometres gram grams kilogram kilograms second seconds sec s minute "
    "minutes min hour hours hr hrs h day days week weeks month months year years dollar dollars cent cents "
    "euro euros usd eur gbp percent pct degree degrees km/h mph kph kb mb gb tb hz khz mhz ghz w kw kwh v a"
)
# Number words that "and" may follow, words inside names, and short forms whose dot ends no sentence.
SCALES = "hundred thousand million billion"
PARTICLES = "of de del della der den di da du la le van von bin ibn al el y"
TITLES = "Mr Mrs Ms Dr Prof St Jr Sr Mt"
# Marks of placeholders by kind; a plain token has kind 0.
NUMBER, UNIT, NAME = 1, 2, 3
MARKS = {NUMBER: "\x01n", UNIT: "\x01u", NAME: "\x01c"}

# What is known of a token by itself.
_NUM, _UNIT, _MAYBE_UNIT, _NAME, _INITIAL, _PARTICLE, _AND, _SCALE, _OPENER, _JOINS = (1 << i for i in range(10))
_WORD_FLAGS: dict[str, int] = {}
for _words, _flag in (
    (NUMBER_WORDS, _NUM),
    (UNITS, _MAYBE_UNIT),
    (SCALES, _SCALE),
    (PARTICLES, _PARTICLE),
    ("and", _AND),
):
    for _word in _words.split():
        _WORD_FLAGS[_word] = _WORD_FLAGS.get(_word, 0) | _flag
_OPENERS = frozenset(OPENERS.split())
_UNIT_WORDS = frozenset(UNITS.split())
_UNITS = "|".join(re.escape(u) for u in sorted(UNITS.split(), key=len, reverse=True))
_CAPITAL = "A-ZÀ-ÖØ-Þ"
_WORD = re.compile(r"[^\W_]+")
_PART = re.compile(
    rf"(?P<num>[$£€]?\d+(?:[.,]\d+)*(?:/\d+)?|[½¼¾⅓⅔])(?:(?i:st|nd|rd|th)(?![^\W_]))?"
    rf"(?P<unit>(?:%|°[CF]?|(?i:{_UNITS}))(?![^\W_]))?"
    rf"|(?P<name>[{_CAPITAL}](?:['’][{_CAPITAL}])?[^\W\d_]+(?:-[{_CAPITAL}][^\W\d_]+)*)"
    rf"|[^\W_]+"
)
_SHORT_FORM = re.compile(rf"(?:[{_CAPITAL}]|{'|'.join(TITLES.split())})\.")
_SENTENCE_END = frozenset(".!?:;\"“”«»")


class _Raw(NamedTuple):
    """A piece of text between white space: its bare words, its tokens as (flags, word), whether its edges are
    free of punctuation, and whether a sentence may end with it."""

    words: tuple[str, ...]
    tokens: tuple[tuple[int, str], ...]
    head: bool
    tail: bool
    ends: bool


def _take_apart(raw: str) -> _Raw:
    if raw.isalpha() and raw.islower():
        return _Raw((raw,), ((_WORD_FLAGS.get(raw, 0), raw),), True, True, False)
    words = tuple(w.lower() for w in _WORD.findall(raw))
    short = _SHORT_FORM.fullmatch(raw) is not None
    if short and len(raw) == 2:
        return _Raw(words, ((_INITIAL, words[0]),), True, True, False)
    bare = raw.strip(".,;:!?()\"'").lower()
    if "/" in bare and bare in _UNIT_WORDS:
        at = raw.lower().index(bare)
        return _Raw(words, ((_MAYBE_UNIT, bare),), not at, at + len(bare) == len(raw), raw[-1] in _SENTENCE_END)
    tokens: list[tuple[int, str]] = []
    end, first = 0, None
    for m in _PART.finditer(raw):
        gap, end = raw[end : m.start()], m.end()
        joins = _JOINS if not gap or gap.isspace() else 0
        if first is None:
            first = m.start()
        if m["num"]:
            tokens.append((_NUM | joins, m["num"]))
            if m["unit"]:
                tokens.append((_UNIT | _JOINS, m["unit"].lower().replace("%", "pct")))
            continue
        word = m.group().lower()
        flags = _WORD_FLAGS.get(word, 0)
        # Words of a number stand together across a hyphen.
        if flags & _NUM and gap == "-":
            joins = _JOINS
        name = m["name"]
        if name and not flags & _NUM and (name[1].islower() or name[1] in "'’"):
            flags |= _NAME | (_OPENER if word in _OPENERS else 0)
            word = "".join(_WORD.findall(word))
        tokens.append((flags | joins, word))
    if first is None:
        return _Raw(words, (), False, False, any(c in _SENTENCE_END for c in raw))
    tail = raw[end:]
    return _Raw(
        words,
        tuple(tokens),
        not first or raw[:first].isspace(),
        short or not tail or tail.isspace(),
        not short and any(c in _SENTENCE_END for c in tail),
    )


# Short pieces come again in the next batch; a stated number of them is kept.
_known_raw = lru_cache(maxsize=30_000)(_take_apart)


# Most pieces are a word, in small letters or with a capital one, and its punctuation: they need no loop.
_TAIL = ".,;:!?#$%&*"
_PLAIN_RAW = rf"^[{_CAPITAL}]?\p{{Ll}}+[{_TAIL}]*$"
_TITLES = pa.array([f"{t}." for t in TITLES.split()], pa.large_string())
_FLAGGED = sorted({*_WORD_FLAGS, *_OPENERS})
_FLAGGED_WORDS = pa.array(_FLAGGED, pa.large_string())
# By place in the list, and 0 behind it for all other words.
_SMALL_FLAGS = np.array([*(_WORD_FLAGS.get(w, 0) for w in _FLAGGED), 0], np.int64)
_OPENER_FLAGS = np.array([*(_OPENER * (w in _OPENERS) for w in _FLAGGED), 0], np.int64)


class _Stream(NamedTuple):
    """Tokens of a batch in one form: hash, whether plain, kind, their parts and the first of each, and starts
    of texts."""

    hashes: np.ndarray
    plain: np.ndarray
    kinds: np.ndarray | None
    parts: np.ndarray
    first: np.ndarray | None
    starts: np.ndarray


class Tokens:
    """The streams of a batch of texts, from one split at white space."""

    def __init__(self, texts: pa.Array):
        self.raw = raw = Words(texts, lower=False)
        pieces_ = raw.dictionary.cast(pa.large_string())
        mask = pc.and_not(pc.match_substring_regex(pieces_, _PLAIN_RAW), pc.is_in(pieces_, _TITLES))
        easy = np.asarray(mask)
        chosen = pieces_.filter(mask)
        bare = pc.utf8_rtrim(chosen, _TAIL)
        small = pc.utf8_lower(bare)
        known = np.asarray(pc.fill_null(pc.index_in(small, _FLAGGED_WORDS), len(_FLAGGED)))
        capital = np.asarray(pc.not_equal(bare, small))
        flags = _SMALL_FLAGS[known]
        capital &= flags & _NUM == 0
        flags = flags | capital * (_NAME | _OPENER_FLAGS[known])

        n, n_easy = len(easy), len(chosen)
        self._edges = np.ones((n, 3), bool)
        self._edges[easy, 1] = np.asarray(pc.equal(pc.binary_length(bare), pc.binary_length(chosen)))
        self._edges[easy, 2] = np.asarray(pc.match_substring_regex(chosen, "[.:;!?]"))
        hard = [
            _known_raw(t) if len(t) <= 40 else _take_apart(t)
            for t in pieces_.filter(pc.invert(mask)).to_pylist()
        ]
        if hard:
            self._edges[~easy] = [(r.head, r.tail, r.ends) for r in hard]
        hard_words = [w for r in hard for w in r.words]
        hard_tokens = [t for r in hard for t in r.tokens]
        more = pa.array([*hard_words, *(w for _, w in hard_tokens)], pa.large_string())
        pool = pa.chunked_array([small, more]).combine_chunks().dictionary_encode()
        self.pool = pool.dictionary
        digest = xxhash.xxh64_intdigest
        shown = self.pool.to_pylist()
        self._hashes = np.fromiter((digest(w) for w in shown), np.uint64, len(shown))
        ids = np.asarray(pool.indices).astype(np.int64)
        cut = n_easy + len(hard_words)
        flags = np.concatenate([flags, np.array([f for f, _ in hard_tokens], np.int64)])
        self._words = self._spread(easy, [len(r.words) for r in hard], ids[:cut])
        token_ids = np.concatenate([ids[:n_easy], ids[cut:]])
        self._tokens = self._spread(easy, [len(r.tokens) for r in hard], token_ids, flags)

    def _spread(self, easy: np.ndarray, sizes: list[int], *flat: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where each piece's lot begins in the batch, and what the lots hold, one after another: easy pieces
        have one thing each in the flat lists, the others theirs behind these."""
        size = np.ones(len(easy), np.int64)
        size[~easy] = sizes
        start = np.zeros(len(easy), np.int64)
        n_easy = int(easy.sum())
        start[easy] = np.arange(n_easy)
        start[~easy] = n_easy + np.cumsum(size[~easy]) - size[~easy]
        n = size[self.raw.codes]
        begins = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(begins[-1]) + np.repeat(start[self.raw.codes] - begins[:-1], n)
        return begins, *(f[at] for f in flat)

    def bare(self) -> _Stream:
        begins, codes = self._words
        plain = np.ones(len(codes), bool)
        return _Stream(self._hashes[codes], plain, None, codes, None, begins[self.raw.starts])

    def template(self, form: str) -> _Stream:
        begins, codes, flags = self._tokens
        starts = begins[self.raw.starts]
        n = len(codes)
        # Whether a token stands next to the one before, nothing but white space between.
        joins = flags & _JOINS != 0
        heads = begins[:-1]
        full = np.flatnonzero(heads < begins[1:])
        at, raw = heads[full], self.raw.codes[full]
        before = self.raw.codes[np.maximum(full - 1, 0)]
        joins[at] = self._edges[raw, 0] & self._edges[before, 1]
        opens = np.zeros(n, bool)
        opens[at] = ~self._edges[raw, 0] | self._edges[before, 2]
        texts = starts[:-1][starts[:-1] < starts[1:]]
        joins[texts], opens[texts] = False, True

        def after(x: np.ndarray) -> np.ndarray:
            out = np.zeros(n, bool)
            out[:-1] = x[1:] & joins[1:]
            return out

        def behind(x: np.ndarray) -> np.ndarray:
            out = np.zeros(n, bool)
            out[1:] = x[:-1] & joins[1:]
            return out

        name = flags & _NAME != 0
        if form == "p":
            name &= ~opens
        elif form == "f":
            name[texts] = False
        name |= (flags & _INITIAL != 0) & after(name | (flags & _INITIAL != 0))
        particle = flags & _PARTICLE != 0
        one = particle & behind(name) & after(name)
        two = particle & behind(name) & after(particle & after(name))
        name |= one | two | (particle & behind(two))
        number = flags & _NUM != 0
        number |= (flags & _AND != 0) & behind(flags & _SCALE != 0) & after(number)
        unit = (flags & _MAYBE_UNIT != 0) & behind(number) & ~name
        number &= ~unit
        kinds = np.zeros(n, np.int8)
        kinds[name], kinds[number], kinds[unit | (flags & _UNIT != 0)] = NAME, NUMBER, UNIT
        same = np.zeros(n, bool)
        same[1:] = joins[1:] & (kinds[1:] == kinds[:-1]) & ((kinds[1:] == NUMBER) | (kinds[1:] == NAME))
        first = np.flatnonzero(~same)
        kinds = kinds[first]
        hashes = self._hashes[codes[first]]
        for kind, mark in MARKS.items():
            hashes[kinds == kind] = xxhash.xxh64_intdigest(mark)
        alone = np.diff(first, append=n) == 1
        plain = (kinds == 0) | ((kinds == NAME) & alone & (flags[first] & _OPENER != 0))
        return _Stream(hashes, plain, kinds, codes, first, np.searchsorted(first, starts))

    def stream(self, form: str) -> _Stream:
        return self.bare() if form == "v" else self.template(form)

    def shown(self, s: _Stream, i: int, width: int) -> list[tuple[str, str | None]]:
        """Tokens from ``i`` on as the template has them, each placeholder with its typed value."""
        if s.kinds is None:
            return [(w, None) for w in self.pool.take(pa.array(s.parts[i : i + width])).to_pylist()]
        cuts = [*s.first[i : i + width].tolist(), s.first[i + width] if i + width < len(s.first) else len(s.parts)]
        words = self.pool.take(pa.array(s.parts[cuts[0] : cuts[-1]])).to_pylist()
        out = []
        for kind, a, b in zip(s.kinds[i : i + width].tolist(), cuts, cuts[1:]):
            value = " ".join(words[a - cuts[0] : b - cuts[0]])
            mark = MARKS.get(kind)
            out.append((mark, mark[1:] + value) if mark else (value, None))
        return out


def template(text: str | None, form: str = "p") -> list[str]:
    """Template tokens of one text; a placeholder carries its value behind its mark."""
    tokens = Tokens(pa.array([text], pa.string()))
    s = tokens.stream(form)
    return [t if v is None else "\x01" + v for t, v in tokens.shown(s, 0, len(s.hashes))]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` tokens: a polynomial in an odd number, modulo 2^64."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # By windows of doubled width, so that a width costs its binary digits.
    base, out, done = 0x9E3779B97F4A7C15, None, 0
    with np.errstate(over="ignore"):
        power, size = hashes, 1
        while True:
            if width & size:
                right = power[done : done + n]
                factor = np.uint64(pow(base, size, 1 << 64))
                out = right.copy() if out is None else out * factor + right
                done += size
            if size * 2 > width:
                break
            factor = np.uint64(pow(base, size, 1 << 64))
            power, size = power[:-size] * factor + power[size:], size * 2
    return out.view(np.int64)


def _windows(batch: pa.RecordBatch, forms: Iterable[str], widths: dict, filters: dict | None, whole_below: int = 0):
    """Windows of a batch as (row, form, width, place, hash, template, slots), of the widths of each form.

    With ``filters``, only windows whose hash is among those of their form and width. With ``whole_below``, a
    text of fewer tokens gives the one window it is, as benchmark items do. Windows of bare words have no
    slots and any share of numbers and names.
    """
    tokens = Tokens(batch.column("text"))
    for form in forms:
        s = tokens.stream(form)
        ends, counts = s.starts[1:], np.diff(s.starts)
        plain_before = np.concatenate([[0], np.cumsum(s.plain)])
        for width in widths.get(form, ()):
            found = window_hashes(s.hashes, width)
            if filters is None:
                at = np.arange(len(found))
            else:
                # The rest is looked at only where a window of the benchmark may be.
                table, values = filters[form, width]
                at = np.flatnonzero(table[found & (len(table) - 1)])
                at = at[np.isin(found[at], values)]
            text_of = np.searchsorted(ends, at, side="right")
            good = at + width <= ends[text_of] if len(at) else np.zeros(0, bool)
            at, text_of = at[good], text_of[good]
            good = plain_before[at + width] - plain_before[at] >= min(LEAST_PLAIN, width)
            if whole_below:
                n = counts[text_of]
                good &= (n == width) | (n >= whole_below) & (width == whole_below)
            for i, row in zip(at[good].tolist(), text_of[good].tolist()):
                shown = tokens.shown(s, i, width)
                yield (
                    row,
                    form,
                    width,
                    int(i - s.starts[row]),
                    int(found[i]),
                    " ".join(t for t, _ in shown),
                    [v for _, v in shown if v is not None],
                )


WINDOW_SCHEMA = (
    "row_id long, doc_id long, form string, width int, place int, hash long, template string, slots array<string>"
)


def _emit(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    rows = [f[0] for f in found]
    take_rows = pa.array(rows, pa.int64())
    return pa.record_batch(
        {
            "row_id": batch.column("row_id").take(take_rows),
            "doc_id": batch.column("doc_id").take(take_rows),
            "form": pa.array([f[1] for f in found], pa.string()),
            "width": pa.array([f[2] for f in found], pa.int32()),
            "place": pa.array([f[3] for f in found], pa.int32()),
            "hash": pa.array([f[4] for f in found], pa.int64()),
            "template": pa.array([f[5] for f in found], pa.string()),
            "slots": pa.array([f[6] for f in found], pa.list_(pa.string())),
        }
    )


def _filters(streams: np.ndarray, hashes: np.ndarray, widths: np.ndarray) -> dict:
    """Per stream and width a table of low bits, for a fast no, and the sorted hashes."""
    out = {}
    for stream in STREAMS:
        for width in np.unique(widths[streams == stream]):
            values = np.unique(hashes[(streams == stream) & (widths == width)])
            table = np.zeros(1 << max(16, int(np.ceil(np.log2(len(values) * 16)))), bool)
            table[values & (len(table) - 1)] = True
            out[stream, int(width)] = (table, values)
    return out


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """``item_id, form, stream, width, place, hash, template, slots`` of every item with enough tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            least = {form: LEAST_WORDS if form == "v" else LEAST_TOKENS for form in FORMS}
            widths = {form: range(n, window + 1) for form, n in least.items()}
            found = list(_windows(part, tuple(FORMS), widths, None, whole_below=window))
            if found:
                yield _emit(part, found)

    rows = take(benchmark, doc_id=item_id, text=text).withColumn("row_id", F.lit(0).cast("long"))
    return rows.select("row_id", "doc_id", "text").mapInArrow(run, WINDOW_SCHEMA).select(
        F.col("doc_id").alias("item_id"),
        "form",
        F.when(F.col("form") == "f", "n").otherwise(F.col("form")).alias("stream"),
        "width",
        "place",
        "hash",
        "template",
        "slots",
    )


def _equal(keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return on


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per contaminated row and item: ``row_id, doc_id, item_id, n_windows, item_windows,
    first_token, reparameterised, numbers_merged``.

    ``n_windows`` counts the item's windows found at the best place, out of ``item_windows``;
    ``reparameterised`` says that some slot has another value there. All four, and ``first_token``, are in the
    form of the item that the greatest share was found of: bare words or template. Windows that touch or
    overlap are judged together, those apart for themselves: with other values their slots must be consistent,
    one value becoming one value everywhere and no two names one name (that two numbers did is only told, by
    ``numbers_merged``); with the item's own values they always count. Null and empty texts hold no windows; items shorter than a window
    are found only whole, with other values those of ``LEAST_TOKENS`` tokens or more, word for word those of
    ``LEAST_WORDS`` or more. Repeated rows and items are found each; null ids are kept. Empty tables give an empty result;
    further columns are ignored. ``docs`` must read the same rows in the same order again, as a table or
    files do; ``row_id`` then numbers them.
    """
    spark = docs.sparkSession
    items = materialize(benchmark_windows(benchmark, item_id, item_text, window), "items")
    rows = take(small_batches(docs), doc_id=doc_id, text=text).select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"
    )
    known = items.select("stream", "width", "hash").distinct()
    n_blocks = -(-known.count() // block_windows) or 1
    found = None
    for block in range(n_blocks):
        # By hash, so blocks are even; each holds about BLOCK_WINDOWS of them.
        some = known.filter(F.pmod(F.xxhash64("hash"), F.lit(n_blocks)) == block).toArrow()
        filters = _filters(
            np.asarray(some.column("stream").to_pylist(), object),
            np.asarray(some.column("hash")).astype(np.int64),
            np.asarray(some.column("width")).astype(np.int64),
        )
        shared = spark.sparkContext.broadcast(filters)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            filters = shared.value
            widths = {f: sorted(w for s, w in filters if s == f) for f in STREAMS}
            for part in pieces(batches):
                hits = list(_windows(part, STREAMS, widths, filters))
                if hits:
                    yield _emit(part, hits)

        matches = rows.mapInArrow(run, WINDOW_SCHEMA)
        found = matches if found is None else found.unionByName(matches)
    found = materialize(found, "windows")
    its = items.select(
        "item_id",
        F.col("form").alias("item_form"),
        F.col("stream").alias("s"),
        F.col("width").alias("w"),
        F.col("hash").alias("h"),
        F.col("template").alias("t"),
        F.col("place").alias("item_place"),
        F.col("slots").alias("item_slots"),
    )
    met = (
        found.join(
            its,
            (F.col("hash") == F.col("h"))
            & (F.col("width") == F.col("w"))
            & (F.col("form") == F.col("s"))
            & (F.col("template") == F.col("t")),
        )
        .withColumn("shift", F.col("place") - F.col("item_place"))
        .withColumn("other", F.col("item_slots") != F.col("slots"))
    )
    at = ["row_id", "doc_id", "item_id", "item_form", "shift"]
    # A run is a stretch of windows of which each begins one token after the one before.
    in_order = W.partitionBy(*at).orderBy("item_place")
    met = met.withColumn("run", F.col("item_place") - F.dense_rank().over(in_order))
    met = materialize(met.select(*at, "run", "item_place", "place", "item_slots", "slots", "other"), "met")
    # What each value of the item turns into, over all windows of a run with other values.
    run = [*at, "run"]
    changed = met.join(
        met.filter("other").select(*[F.col(k).alias(f"_{k}") for k in run]).distinct(),
        _equal(run),
        "left_semi",
    )
    pairs = changed.select(*run, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).select(
        *run, F.col("s.item_slots").alias("value"), F.col("s.slots").alias("became")
    )
    pairs = materialize(pairs.distinct(), "slots")
    run_keys = [F.col(k).alias(f"_{k}") for k in run]
    # A number or unit becomes one value; that two numbers become one is only told.
    is_name = F.col("value").startswith("c")
    parted = pairs.filter(~is_name).groupBy(*run, "value").agg(F.count("*").alias("n")).filter("n > 1")
    fused = pairs.filter(F.col("value").startswith("n")).groupBy(*run, "became").agg(F.count("*").alias("n"))
    fused = fused.filter("n > 1").select(*run_keys).distinct()
    # Names are compared by their words, as "Mary Miller" may also be "Mary" or "Later Mary": if all words of one
    # value are in another, what the two become must share a word, and the other way round. The item's distinct
    # names bound the sets.
    common = F.array(*[F.lit(w) for w in f"{OPENERS} {PARTICLES}".split()])

    def name_words(column: str) -> Column:
        return F.array_except(F.split(F.substr(column, F.lit(2)), " "), common)

    def unlike(x: Column, y: Column, one: str, other: str) -> Column:
        inside = F.size(F.array_except(x[one], y[one])) == 0
        return inside & ~F.arrays_overlap(x[other], y[other])

    names = pairs.filter(is_name).select(*run, name_words("value").alias("v"), name_words("became").alias("b"))
    names = names.filter("size(v) > 0 and size(b) > 0").groupBy(*run).agg(F.collect_set(F.struct("v", "b")).alias("s"))
    mixed_up = names.filter(
        F.exists("s", lambda x: F.exists("s", lambda y: unlike(x, y, "v", "b") | unlike(x, y, "b", "v")))
    )
    loose = parted.select(*run_keys).unionByName(mixed_up.select(*run_keys)).distinct()
    # Windows with the item's own values count whatever stands around them.
    kept = met.filter("other").join(loose, _equal(run), "left_anti")
    kept = kept.join(fused.withColumn("fused", F.lit(True)), _equal(run), "left")
    counted = met.withColumn("fused", F.lit(False)).filter(~F.col("other")).unionByName(
        kept.select(*met.columns, F.coalesce("fused", F.lit(False)).alias("fused"))
    )
    consistent = counted.groupBy(*at).agg(
        F.count_distinct("item_place").alias("n_windows"),
        F.min("place").alias("first_token"),
        F.max("other").alias("other"),
        F.max("fused").alias("fused"),
    )
    sizes = items.groupBy(F.col("item_id").alias("i"), F.col("form").alias("f")).agg(
        F.count_distinct("place").alias("item_windows")
    )
    sized = consistent.join(
        sizes, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_form") == F.col("f"))
    )
    best = sized.groupBy("row_id", "doc_id", "item_id").agg(
        F.max(
            F.struct(
                (F.col("n_windows") / F.col("item_windows")).alias("part"),
                (~F.col("other")).alias("same"),
                "n_windows",
                "item_windows",
                (-F.col("first_token")).alias("earlier"),
                "fused",
            )
        ).alias("b")
    )
    return best.select(
        "row_id",
        "doc_id",
        "item_id",
        F.col("b.n_windows").alias("n_windows"),
        F.col("b.item_windows").alias("item_windows"),
        (-F.col("b.earlier")).alias("first_token"),
        (~F.col("b.same")).alias("reparameterised"),
        F.col("b.fused").alias("numbers_merged"),
    )
