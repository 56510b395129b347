"""Personal data in whole texts, also where it is disguised, with spans of the source text.

Base detectors read the text as it is. Then transducers rewrite every text in steps (look-alike characters,
bracketed and spelled at/dot, spelled digits, letters for digits); each step carries for every character of
its output the source characters it came from. The detectors then read a rewritten text, and what they find across a rewritten place is mapped back and added to the base spans.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .workers import bounded, task

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number that starts inside a run of digits can't match where its start didn't
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, in one pass over the @ signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def detect(text: str) -> list[Span]:
    """Spans (kind, start, end) in code points: by kind in the order of KINDS, then by start."""
    out: list[Span] = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


class Mapped:
    """A rewritten text: for each character, the source range it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] = []  # the three are filled by the first edit
        self.end: list[int] = []
        self.changed: bytearray | None = None
        self.runs: tuple[str, list[re.Match[str]]] = "", []  # a text and its runs that hold digits' names

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges (in order, not overlapping) of the present text. Every character of a replacement
        stands for the whole range."""
        if not edits:
            return
        if self.changed is None:
            n = len(self.text)
            self.start, self.end, self.changed = list(range(n)), list(range(1, n + 1)), bytearray(n)
        texts, start, end, changed, at = [], [], [], bytearray(), 0
        for s, e, new in edits:
            texts += [self.text[at:s], new]
            start += self.start[at:s]
            end += self.end[at:s]
            changed += self.changed[at:s]
            if e > s:
                start += [self.start[s]] * len(new)
                end += [self.end[e - 1]] * len(new)
                changed += b"\1" * len(new)
                if not new and changed:
                    changed[-1] = 1  # something went after this character
            at = e
        texts.append(self.text[at:])
        start += self.start[at:]
        end += self.end[at:]
        changed += self.changed[at:]
        self.text, self.start, self.end, self.changed = "".join(texts), start, end, changed

    def source(self, s: int, e: int) -> tuple[int, int]:
        return self.start[s], self.end[e - 1]

    def touched(self, s: int, e: int) -> bool:
        return 1 in self.changed[s:e]


#: Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    "АВЕЅІЈКМНОРСТУХаесѕіјорухԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι",
    "ABESIJKMHOPCTYXaecsijopyxdqwhABEZHIKMNOPTYXovi",
)
#: Characters without width.
INVISIBLE = frozenset("­​‌‍⁠﻿᠎‎‏")
_DASHES, _DOTS = frozenset("‐‑‒–—−﹣－"), frozenset("․。．｡﹒·")


@cache
def plain(c: str) -> str:
    """The ASCII character that a character imitates, nothing for an invisible one, else itself. Letters of
    Latin alphabets with marks are letters of their languages and stay."""
    if c in INVISIBLE:
        return ""
    if c in _DASHES:
        return "-"
    if c in _DOTS:
        return "."
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    if c.isspace():
        return " "
    x = c.translate(LOOK_ALIKES)
    n = unicodedata.normalize("NFKC", x)
    return n if len(n) == 1 and n.isascii() else c


_ODD = re.compile(r"[\x80-\xbf]|[^\x00-\xff]")


def _characters(m: Mapped) -> None:
    if not m.text.isascii():
        m.rewrite([(x.start(), x.end(), p) for x in _ODD.finditer(m.text) if (p := plain(x[0])) != x[0]])


_AT, _DOT = r"(?:at|arroba|chez|ät|@)", r"(?:dot|dt|punkt|punto|point|\.)"
_BRACKET_AT = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}{_AT}\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
_BRACKET_DOT = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}{_DOT}\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
_ENTITY_AT, _ENTITY_DOT = re.compile(r"&#0*64;|&#x0*40;|&commat;|(?<=[A-Za-z0-9])%40(?=[A-Za-z0-9-]+\.)", re.I), re.compile(r"&#0*46;|&#x0*2e;|&period;", re.I)
_GAP = r"(?:[ \t]{1,3}|[ \t]?[_-]{1,2}[ \t]?)"
#: name AT host DOT top: only where a spelled dot, or a name unlike a word, tells it from prose. With white
#: space around the words names may hold _ and -; otherwise those are the gaps.
_SAY_AT, _SAY_DOT = r"(?:at|arroba)", r"(?:dot|punkt|punto|point)"


def _spelled(gap: str, more: str) -> tuple[re.Pattern[str], re.Pattern[str]]:
    """The pattern, and what each of its matches holds: from at to the first dot, which is quicker to look for."""
    dot = rf"{gap}{_SAY_DOT}{gap}"
    name = rf"[A-Za-z0-9][A-Za-z0-9.%+{more}]{{0,63}}(?:{dot}[A-Za-z0-9][A-Za-z0-9%+{more}]{{0,63}}){{0,3}}"
    label = rf"[A-Za-z0-9{more.replace('_', '')}]{{1,63}}"
    whole = re.compile(rf"(?<![A-Za-z0-9._%+-])({name})({gap}{_SAY_AT}{gap}|[ \t]{{0,2}}@[ \t]{{0,2}})({label}(?:(?:{dot}|\.){label}){{1,5}})(?![A-Za-z0-9])", re.I)
    return whole, re.compile(rf"(?:(?<=[ \t_-]){_SAY_AT}{gap}|@[ \t]{{0,2}}){label}(?:{dot}|\.){label}", re.I)


_SPELLED = (_spelled(r"[ \t]{1,3}", "_-"), _spelled(r"[ \t]?[_-]{1,2}[ \t]?", ""))
_SPELLED_DOT = re.compile(rf"{_GAP}(?:dot|punkt|punto|point){_GAP}", re.I)
_NUMBER_DOT = re.compile(rf"(?<=[0-9])(?:{_GAP}(?:dot|punkt|punto|point){_GAP})(?=[0-9])", re.I)
#: Ends of host names that a spelled at without a spelled dot may have.
TOPS = frozenset("com org net edu gov io co info biz de fr es uk eu us ch at".split())


def _at_and_dot(m: Mapped) -> None:
    for pattern, new in ((_ENTITY_AT, "@"), (_ENTITY_DOT, "."), (_BRACKET_AT, "@"), (_BRACKET_DOT, ".")):
        m.rewrite([(x.start(), x.end(), new) for x in pattern.finditer(m.text)])
    for pattern, core in _SPELLED:
        if not core.search(m.text):
            continue
        edits = []
        for x in pattern.finditer(m.text):
            before, after = ([(x.start(g) + d.start(), x.start(g) + d.end(), ".") for d in _SPELLED_DOT.finditer(x[g])] for g in (1, 3))
            top = x[3].rpartition(".")[2].lower() in TOPS
            odd = re.search(r"[0-9._]", x[1]) or "@" in x[2]
            if after or odd and top and x[2] != "@":
                edits += [*before, *([(x.start(2), x.end(2), "@")] if x[2] != "@" else []), *after]
        m.rewrite(edits)
    m.rewrite([(x.start(), x.end(), ".") for x in _NUMBER_DOT.finditer(m.text)])


#: The digits' names in four languages.
DIGITS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789", strict=True)),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789", strict=True)),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789", strict=True)),
    **{"oh": "0", "ein": "1", "zwo": "2", "une": "1"},
}
_BY_LETTER = {c: sorted((n[1:] for n in DIGITS if n[0] == c), key=len, reverse=True) for c in sorted({n[0] for n in DIGITS})}
_NAME = "(?:" + "|".join(f"{c}(?:{'|'.join(x)})" for c, x in _BY_LETTER.items()) + ")"
_TIMES = r"(?:(?:double|doppel|triple)[ \t-]{1,2})?"
_ITEM = rf"(?:(?<![^\W\d_]){_TIMES}{_NAME}(?![^\W\d_])|[0-9]++)"
#: Names and figures in a row, with separators between them; one pass, as no run starts within another.
_RUN = re.compile(rf"(?:(?<![^\W\d_])|(?=[0-9+]))(?:(?:\+|(?<![^\W\d_])plus)[ \t]{{0,2}}+)?{_ITEM}(?:[ \t,().-]{{0,3}}+(?:(?:dot|punkt|punto|point)[ \t]{{1,2}})?{_ITEM})*+", re.I)
_PART = re.compile(rf"(?P<times>double|doppel|triple)|(?P<name>{_NAME}(?![^\W\d_]))|(?P<plus>plus(?![^\W_]))|(?P<dot>dot|punkt|punto|point)|(?P<figure>[0-9]+)|(?P<gap>[ \t,().-]+)|(?P<rest>.)", re.I)


def _parts(run: re.Match[str]) -> list[tuple[str | None, int, int, str]]:
    return [(p.lastgroup, p.start() + run.start(), p.end() + run.start(), p[0]) for p in _PART.finditer(run[0])]


def _figures(parts: list[tuple[str | None, int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits that turn the names of a run into figures and close the gaps beside them."""
    edits, times = [], 1
    for i, (kind, s, e, x) in enumerate(parts):
        new = x
        if kind == "times":
            times, new = (3 if x.lower() == "triple" else 2), ""
        elif kind == "name":
            new, times = DIGITS[x.lower()] * times, 1
        elif kind == "plus":
            new = "+"
        elif kind == "dot":
            new = "."
        elif kind == "gap":
            near = {parts[j][0] for j in (i - 1, i + 1) if 0 <= j < len(parts)}
            if near & {"name", "plus", "dot", "times"} and not set(x) & set("().-"):
                new = ""
            elif near & {"dot", "plus", "times"}:
                new = ""
            elif len(x) > 1 and set(x) <= set(" \t,"):
                new = " "
        if new != x:
            edits.append((s, e, new))
    return edits


def _named_runs(m: Mapped) -> list[re.Match[str]]:
    if m.runs[0] is not m.text:
        m.runs = m.text, [x for x in _RUN.finditer(m.text) if x[0].lower() != x[0].upper()]  # not figures alone
    return m.runs[1]


def _spelled_digits(m: Mapped) -> None:
    edits = []
    for run in _named_runs(m):
        parts = _parts(run)
        named = [i for i, p in enumerate(parts) if p[0] == "name"]
        if len(named) < 3:
            continue
        commas = [i for i, p in enumerate(parts[: named[0]]) if "," in p[3]]
        edits += _figures(parts[commas[-1] + 1 if commas else 0 :])  # a list before the first name is no part of the number
    m.rewrite(edits)


_AS_DIGITS = str.maketrans("OoIl|", "00111")
_LETTERS = re.compile(r"(?<=[0-9])([ -]?)([OoIl|]{1,4})(?=[ -]?[0-9])")


def _letters_for_digits(m: Mapped) -> None:
    m.rewrite([(x.start(2), x.end(2), x[2].translate(_AS_DIGITS)) for x in _LETTERS.finditer(m.text)])


_BESIDE = " \t().-"


def _beside(text: str, s: int, e: int) -> bool:
    """Whether a figure or a plus is next to a range but for separators."""
    s -= 1
    while s >= 0 and text[s] in _BESIDE:
        s -= 1
    while e < len(text) and text[e] in _BESIDE:
        e += 1
    return s >= 0 and text[s] in "0123456789+" or e < len(text) and text[e] in "0123456789+"


def _adjoining_names(m: Mapped) -> None:
    """Fewer names than make a number by themselves, beside figures or a plus, but not in an address."""
    edits = []
    for run in _named_runs(m):
        if m.text[run.end() : run.end() + 1] in {"@", "%", "_"} or m.text[run.start() - 1 : run.start()] in {"@", "%", "_"}:
            continue
        group: list[tuple[str | None, int, int, str]] = []
        for p in [*_parts(run), ("gap", 0, 0, ",")]:
            if "," not in p[3]:
                group.append(p)
                continue
            kinds = {x[0] for x in group}
            if "name" in kinds and (kinds & {"figure", "plus"} or _beside(m.text, group[0][1], group[-1][2])):
                edits += _figures(group)
            group = []
    m.rewrite(edits)


_MIXED = r"(?<![^\W\d_])[0-9OoIl|]++(?![^\W\d_])"
_NUMBER = re.compile(rf"[0-9OoIl|](?<![^\W\d_][OoIl|])[0-9OoIl|]*+(?![^\W\d_])(?:[ \t().-]{{1,3}}+{_MIXED})*+")


def _adjoining_letters(m: Mapped) -> None:
    """Look-alikes in and beside figures, in groups of any length."""
    edits = []
    for x in _NUMBER.finditer(m.text):
        if (new := x[0].translate(_AS_DIGITS)) != x[0] and re.search("[0-9]", x[0]):
            edits += [(x.start() + k, x.start() + k + 1, new[k]) for k in range(len(new)) if new[k] != x[0][k]]
    m.rewrite(edits)


TRANSDUCERS: tuple[Callable[[Mapped], None], ...] = (_characters, _at_and_dot, _spelled_digits, _letters_for_digits)
#: They run after the others, whose finds stay: what adjoins a number may be a word of the text. The base rules
#: (number of digits, Luhn) refuse most of what isn't part of it.
ADJOINING: tuple[Callable[[Mapped], None], ...] = (_adjoining_names, _adjoining_letters)
#: A phone number that is whole without it doesn't take up a word that is an article, a pronoun or the like.
_WORD_AFTER = re.compile(r"[ \t]+(?:un|une|uno|ein|one|oh|[OoIl|]{1,2})", re.I)


def _behind(m: Mapped) -> list[Span]:
    return [(kind, *m.source(s, e)) for kind, s, e in detect(m.text) if m.touched(s, e)]


def _held(span: Span, by: list[Span]) -> bool:
    """Whether a span of its kind holds it; `by`: by kind, then by start, as detect() gives them."""
    i = bisect_right(by, (KINDS.index(span[0]), span[1]), key=lambda x: (KINDS.index(x[0]), x[1])) - 1
    return i >= 0 and by[i][0] == span[0] and span[2] <= by[i][2]


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in the same order. A span found behind a disguise is added unless a base
    span of its kind holds it already."""
    base = detect(text)
    m = Mapped(text)
    for step in TRANSDUCERS:
        step(m)
    first, before = [] if m.changed is None else _behind(m), m.text
    for step in ADJOINING:
        step(m)
    if m.changed is None:
        return base, base
    first = [x for x in first if not _held(x, base)]
    phones = {x: y for kind, x, y in (*first, *base) if kind == "phone"}
    more = [x for x in (_behind(m) if m.text is not before else []) if not _held(x, base)]
    more = [(k, a, b) for k, a, b in more if not (k == "phone" and a in phones and _WORD_AFTER.fullmatch(text, phones[a], b))]
    added = [*more, *(x for x in first if not _held(x, more))]
    if not added:
        return base, base
    return base, sorted({*base, *added}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id`, base and spans: arrays of (kind, start, stop) in code points, stop exclusive.

    Row by row without a shuffle: null and empty texts have no spans, repeated rows are all returned, an empty
    table has no rows, other columns don't matter. A task holds a batch bounded by bytes; of a longer text the
    text, and where it was rewritten two numbers a character."""
    source = bounded(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, t in slices(texts):
                found = [find(x) for x in texts[s:t]]
                columns = [pa.array([[dict(zip(("kind", "start", "stop"), y, strict=True)) for y in x[i]] for x in found], pa.list_(kind)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, t - s), *columns], ["id", "base", "spans"])

    kinds = "array<struct<kind: string, start: int, stop: int>>"
    return source.mapInArrow(task(run), f"id {id_type}, base {kinds}, spans {kinds}").withColumnRenamed("id", id_col)


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e in sorted(find(text)[1], key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"<{kind.upper()}>"]
        at = e
    return "".join(out) + text[at:]


def mask_texts(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """`df` with masked texts, all other columns as they are but for the number of characters, which is
    brought up to date where that column exists. Null texts stay null, empty ones empty, repeated rows are
    masked alike, and an empty table stays empty."""
    at, chars = df.columns.index(text_col), df.columns.index(chars_col) if chars_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for s, t in slices([x or "" for x in texts]):
                part, done = b.slice(s, t - s), [mask(x) for x in texts[s:t]]
                columns = part.columns
                if chars is not None and done != texts[s:t]:
                    old = columns[chars].to_pylist()
                    columns[chars] = pa.array([n if x == y or y is None else len(y) for n, x, y in zip(old, texts[s:t], done, strict=True)], columns[chars].type)
                columns[at] = pa.array(done, pa.string())
                yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return bounded(df).mapInArrow(task(run), df.schema)


def report(df: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of all spans), base_sha256, spans as kind:start:end."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return spans(df).select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def base_digest(found: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()
