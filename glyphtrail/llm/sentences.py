"""Split every document into sentences by cascading rule tables.

Levels of the cascade:

1. Paragraphs: an empty line, also one of blanks, always ends a sentence.
2. Candidates: an end mark with the closing quotes or brackets after it; where the
   script is Thai, a run of blanks.
3. Protection: a candidate inside a quotation or bracket of the same paragraph breaks
   nothing, and neither does one whose frame goes on after the quotation.
4. Rules: ordered pairs of a pattern before and a pattern after the position, each
   either *break* or *keep*. The tables of the paragraph's script come first, the
   common table last, and the first pair that matches decides.

The scripts of a paragraph select the tables; the recorded language is not trusted. Among
languages of the Latin script, the one whose own common words and letters it has
is taken if a paragraph has three or more of them and none of another; else all apply.
Invisible characters are skipped and full-width letters and digits are read as plain
ones while matching; offsets always refer to the text as given.

Defined results: null, empty and blank texts give no sentence; a text without any end
mark is one sentence per paragraph; repeated rows give the same rows again under their
own ids; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

KEEP, BREAK = False, True

# Abbreviations by what may follow them. Patterns are read as is.
#: Always followed by the rest of their phrase.
LEADING = {
    "en": r"Dr Mr Mrs Ms Prof St Mt Gen Col Capt Lt Sgt Rev Hon Sen Rep Gov vs approx incl excl i\.e e\.g cf viz al Eq ed eds resp est dept",
    "de": r"Dr Prof Hr Fr Frl bzw ca z\.?\ ?B d\.?\ ?h u\.?\ ?a i\.?\ ?d\.?\ ?R s\.?\ ?o vgl evtl inkl exkl ggf zzgl Abb Nr Tab Kap St Str sog Dipl Ing",
    "fr": r"M MM Dr Pr Me p\.\ ?ex c\.-à-d env fig chap vol éd av boul cf n°",
    "es": r"Sr Sra Srta Dr Dra D Dña Ud Uds p\.\ ?ej aprox pág págs fig cap núm art tel Lic Ing Prof",
    "ru": r"см рис табл стр гл т\.\ ?е т\.\ ?к т\.\ ?н им напр г-н ул пл кв доц проф акад англ",
    "hi": r"डॉ श्री प्रो पं कु सं",
    "ar": r"د أ م ص ج هـ",
}
#: Followed by a number.
NUMBERED = {
    "en": r"No Nos Fig Figs p pp Ch Sec Vol Art Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
    "de": r"S Bd Art Abs Ziff Z",
    "fr": r"no p pp art t",
    "es": r"n p pp vol",
    "ru": r"с п ст д кв пикс",
    "hi": r"पृ क्र",
    "ar": r"رقم",
}
#: May end a sentence: the next letter decides.
CLOSING = r"etc usw usf u\.\ ?s\.\ ?w Co Inc Ltd Jr Sr a\.m p\.m A\.M P\.M U\.S U\.K и\ т\.\ ?д и\ т\.\ ?п и\ др пикс гг г"
#: What a German ordinal stands before.
GERMAN_ORDINAL = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Jh|Kapitel|Auflage|Stock|Platz|Klasse|Etage"
#: Common words and letters by which languages of the Latin script are told apart.
COMMON_WORDS = {
    "en": "the and of to was is that it with for on at by from this not are he she his her has had will be an or as",
    "de": "der die das und ist nicht ein eine mit von auf für den dem im zu des sich als auch war wird bei nach aus er sie ü ö ä ß",
    "fr": "le les des et est une du dans pour que qui sur pas avec au par ce cette sont il elle à è ê ç où ne se",
    "es": "el los las y es una del en para que con por no se al más su como fue lo ñ ó á í ¿ ¡ era está",
}
END_MARKS = r"[.!?…。！？｡．।॥؟۔]"
CLOSERS = r"[\"”“’'»›)\]}）］｝」』】〉》]"
PAIRS = (("“", "”"), ("«", "»"), ("„", "“”"), ("「", "」"), ("『", "』"), ("‹", "›"), ("(", ")"), ("（", "）"), ("[", "]"), ("【", "】"), ("《", "》"))


def _any(words: str) -> str:
    """The words as one group, not inside a longer word; also capitalised or in capitals."""
    parts = sorted(regex.split(r"(?<!\\) ", words), key=len, reverse=True)
    either = [f"[{w[0]}{w[0].upper()}]{w[1:]}" if w[0].islower() else w for w in parts]
    either += [w.upper() for w in parts if "\\" not in w and len(w) > 1] + [r"I\.E", r"E\.G"]
    return r"(?<![\p{L}\p{M}\p{N}.])(?:" + "|".join(either) + r")"


GAP = r"[\s\p{Cf}]"
#: Closing marks after an end mark; only a guillemet may stand apart.
TAIL = rf"(?:[ \u00a0\u202f]?»|{CLOSERS})*"
OPENERS = r"[\"“„«‹'‘(\[（「『【¿¡—–]"


def _table(language: str) -> list[tuple[bool, str, str]]:
    rows = []
    if language in LEADING:
        rows.append((KEEP, rf"{_any(LEADING[language])}\.", rf"{GAP}+\S"))
    if language in NUMBERED:
        rows.append((KEEP, rf"{_any(NUMBERED[language])}\.", rf"{GAP}+[\p{{N}}#]"))
    if language == "de":
        rows.append((KEEP, r"(?<![\p{L}\p{N}.,])\p{N}{1,2}\.", rf"{GAP}+(?:{GERMAN_ORDINAL})\b"))
    if language in ("zh", "ja"):
        # The frame of a quotation goes on right after it.
        rows.append((KEEP, rf"{END_MARKS}[”」』]", r"[\p{L}\p{N}、，,]"))
        rows.append((BREAK, rf"[。！？｡．]{CLOSERS}*", r"(?s:.|$)"))
    if language == "th":
        rows.append((BREAK, r"[\p{Thai}\p{N}\p{P}]", rf"{GAP}*[ \t 　]"))
    return rows


#: The last table, for every script.
COMMON: list[tuple[bool, str, str]] = [
    # Enumeration at the start of a paragraph.
    (KEEP, r"^\s*\p{N}{1,3}\.", rf"{GAP}+\S"),
    # Inside an abbreviation of several parts.
    (KEEP, r"(?<![\p{L}\p{M}\p{N}.])\p{L}\.", rf"{GAP}+\p{{L}}{{1,2}}\."),
    # The sentence goes on in lower case or after a comma, semicolon or colon.
    (KEEP, rf"{_any(CLOSING)}\.{CLOSERS}*", rf"{GAP}++(?![\p{{Lu}}\p{{Lo}}]|{OPENERS})"),
    (BREAK, rf"{_any(CLOSING)}\.{CLOSERS}*", rf"{GAP}+"),
    # Initials.
    (KEEP, r"(?<![\p{L}\p{M}\p{N}])\p{Lu}\.", rf"{GAP}+\p{{Lu}}"),
    (KEEP, rf"{END_MARKS}[\p{{Cf}}]*{TAIL}", rf"{GAP}*[—–-]?{GAP}*[\p{{Ll}},;:]"),
    (BREAK, rf"[。！？｡।॥؟۔]{CLOSERS}*", r"(?s:.|$)"),
    (BREAK, rf"{END_MARKS}{TAIL}", rf"{GAP}|$"),
]

SCRIPTS = {
    "latin": ("en", "de", "fr", "es"),
    "cyrillic": ("ru",),
    "han": ("zh", "ja"),
    "devanagari": ("hi",),
    "arabic": ("ar",),
    "thai": ("th",),
}
_SCRIPT = {
    "latin": regex.compile(r"\p{Latin}"),
    "cyrillic": regex.compile(r"\p{Cyrillic}"),
    "han": regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]"),
    "devanagari": regex.compile(r"\p{Devanagari}"),
    "arabic": regex.compile(r"\p{Arabic}"),
    "thai": regex.compile(r"\p{Thai}"),
}
_PARAGRAPH = regex.compile(r"(?:\r\n?|\n)(?:[^\S\r\n]*(?:\r\n?|\n))+")
_CANDIDATE = regex.compile(rf"{END_MARKS}+{TAIL}")
_THAI_GAP = regex.compile(r"(?<=\S)(?=[ \t 　]+\S)")
_INVISIBLE = regex.compile(r"\p{Cf}")
_WIDE = {c: c - 0xFEE0 for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]}


#: Last runs of letters of all listed abbreviations: only before these, single letters
#: and numbers can a rule with a word list match, so elsewhere such rules are left out.
_RUN = regex.compile(r"(?r)[\p{L}\p{M}]*")
_LISTED = {
    m.group().lower()
    for words in [*LEADING.values(), *NUMBERED.values(), CLOSING]
    for word in regex.split(r"(?<!\\) ", words)
    if (m := _RUN.match(word))
}


_COUNTED = {w: language for language, words in COMMON_WORDS.items() for w in words.split()}
_SHARED = {w for words in COMMON_WORDS.values() for w in set(words.split()) if sum(w in x.split() for x in COMMON_WORDS.values()) > 1}
_PIECES = regex.compile(r"[\p{L}\p{M}]+|[¿¡]")


def languages(text: str, script: str) -> tuple[str, ...]:
    """The languages whose tables apply to a paragraph of ``script``."""
    every = SCRIPTS[script]
    if script != "latin":
        return every
    counts = dict.fromkeys(every, 0)
    low = text.lower()
    for word in [*_PIECES.findall(low), *(c for c in low if not c.isascii())]:
        if word in _COUNTED and word not in _SHARED:
            counts[_COUNTED[word]] += 1
    first, second = sorted(counts.values())[:-3:-1]
    return (max(counts, key=counts.get),) if first >= 3 and not second else every


@lru_cache(maxsize=None)
def cascade(chosen: tuple[str, ...], listed: bool = True) -> tuple[regex.Pattern, tuple[bool, ...]]:
    """The tables of some languages as one ordered alternation, and each rule's verdict."""
    rules = [r for language in chosen for r in _table(language)] + COMMON
    rules = [r for r in rules if listed or not r[1].startswith(("^", "(?<!"))]
    body = "|".join(rf"((?<={before})(?={after}))" for _, before, after in rules)
    return regex.compile(body), tuple(r[0] for r in rules)


_STRAIGHT = regex.compile('"')
_MARKS = [(left, right, regex.compile(f"[{regex.escape(left)}{regex.escape(right)}]")) for left, right in PAIRS]


def _protected(text: str) -> list[tuple[int, int]]:
    """Spans of quotations and brackets that close in ``text``, outermost ones only."""
    spans = []
    opened = None
    for m in _STRAIGHT.finditer(text):
        # A straight mark opens after a blank or an opening mark and before a letter; it
        # closes after anything but a blank. One that can do neither, as for inches, is none.
        at = m.start()
        before, after = text[at - 1 : at] if at else " ", text[at + 1 : at + 2] or " "
        if opened is None:
            if not after.isspace() and (before.isspace() or not (before.isalnum() or before in ".,;:!?")):
                opened = at
        elif not before.isspace():
            spans.append((opened, at + 1))
            opened = None
    for left, right, either in _MARKS:
        if left not in text:
            continue
        opened = None
        for m in either.finditer(text):
            if m.group() == left and opened is None:
                opened = m.start()
            elif m.group() in right and opened is not None:
                spans.append((opened, m.end()))
                opened = None
    return sorted(spans)


def _cuts(text: str) -> list[int]:
    """Where sentences of one paragraph end, in its own offsets."""
    seen = [name for name, letter in _SCRIPT.items() if letter.search(text)]
    # Only rules with word lists differ between languages of one script.
    every, chosen = tuple(x for script in seen for x in SCRIPTS[script]), None
    spots = {m.end(): m.start() for m in _CANDIDATE.finditer(text)}
    if "thai" in seen:
        spots |= {m.start(): m.start() for m in _THAI_GAP.finditer(text)}
    spans, cuts, k, reach = _protected(text), [], 0, 0
    for at in sorted(spots):
        while k < len(spans) and spans[k][0] < at:
            reach, k = max(reach, spans[k][1]), k + 1
        if at < reach:
            continue
        mark = spots[at]
        listed = text[mark] == "."
        if listed:
            run = _RUN.match(text, 0, mark).group()
            listed = len(run) < 2 or run.lower() in _LISTED
        if listed and chosen is None:
            chosen = tuple(x for script in seen for x in languages(text, script))
        rules, verdicts = cascade(chosen if listed else every, listed)
        m = rules.match(text, at)
        if m and verdicts[m.lastindex - 1]:
            cuts.append(at)
    return cuts


def split(text: str | None) -> list[tuple[int, int]]:
    """Sentences of ``text`` as (start, end) in code points, blanks around excluded."""
    if not text or text.isspace():
        return []
    plain = text.translate(_WIDE)
    out, at = [], 0
    ends = [(m.start(), m.end()) for m in _PARAGRAPH.finditer(plain)] + [(len(plain), len(plain))]
    for stop, resume in ends:
        part = plain[at:stop]
        if part and not part.isspace():
            if _INVISIBLE.search(part):
                kept = [i for i, c in enumerate(part) if not _INVISIBLE.match(c)]
                cuts = [kept[c - 1] + 1 for c in _cuts("".join(part[i] for i in kept))]
            else:
                cuts = _cuts(part)
            low = 0
            for cut in [*cuts, len(part)]:
                piece = part[low:cut]
                body = piece.strip()
                if body:
                    start = at + low + len(piece) - len(piece.lstrip())
                    out.append((start, start + len(body)))
                low = cut
        at = resume
    return out


def sentence_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc id, start_at, end_at) of every sentence; a narrow operator."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for a, b in split(t):
                    rows.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[doc_id, "start_at", "end_at"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, start_at int, end_at int")
