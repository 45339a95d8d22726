"""Sentence boundaries in wiki text of any script.

Lines are the outer units: a line feed always ends a sentence, and lines of pure
markup hold none. Within a line, bracket pairs, quotations, links, notes and
templates are matched first and closed to boundaries. What is left is a lattice of
gaps, one after each run of terminators (with the closers, notes and templates that
belong to it). In scripts with spaces a gap is classified by the word before it
(abbreviation classes, initials, ordinals) and by the first character after it. Words that
the corpus nearly always carries on from in small letters, although a full stop follows
them, are abbreviations too, beside those of the lists. In
scripts without spaces the text on both sides of a gap is segmented into words by a
dictionary lattice (lattice.py) and the gap is classified by final words, opening
particles and verbs of saying; Thai, which has no terminator, takes its gaps from spaces.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.lattice import CHINESE, JAPANESE, segment
from sparkloom.shared import materialize, release

# --- fixed values -------------------------------------------------------------
#: A line that begins with one of these holds no sentence.
SKIPPED = ("=", "{", "|", "}", "!", "[[Category:", "[[File:", "#REDIRECT", "<!--", "__")
#: Abbreviations that introduce what follows: they never end a sentence.
NEVER_FINAL = frozenset(
    "mr mrs ms dr prof st gen col capt lt sgt rev hon messrs mt ft approx vs cf viz i.e e.g "
    "hr fr frl mio mrd tsd bzw ca z z.b d.h u.a vgl geb gest ggf inkl evtl sog "
    "mm mme mlle mgr me env ex av apr "
    "sr sra srta dra dna aprox ej p.ej ee pág núm "
    "г-н г-жа ул пл пр просп пер см ср напр близ т.е им акад проф д-р гр св о-в "
    "डॉ पं प्रो सु.श्री د أ ดร พล.อ รศ ผศ".split()
)
#: Abbreviations that introduce a number: no end if a digit follows.
BEFORE_NUMBER = frozenset(
    "no nos nr vol vols fig figs p pp ch sec art bd s abb kap t tome chap n núm nº n.º pág págs cap "
    "т с стр д кв кн гл рис табл № ج ص ฉบับ มาตรา".split()
)
#: Abbreviations that may also be the last word of a sentence: an end if no small letter follows.
MAYBE_FINAL = frozenset(
    "etc co ltd bros jr inc corp a.m p.m am pm b.c a.d ad bc ibid cit "
    "usw jh jhd str "
    "cía vda "
    "г гг в вв чел руб коп тыс млн млрд т.д т.п др проч "
    "م هـ".split()
)
#: Forms of companies, of which several may follow each other.
COMPANY = frozenset("ltd inc co corp llc bros gmbh plc".split())
#: Names of months after which, or before which, an ordinal number stands.
MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember jänner "
    "jan feb mär apr jun jul aug sep sept okt nov dez jh jhd jahrhundert jahrhunderts jhs".split()
)
#: Verbs of saying in Hindi, by which the sentence runs on from a quotation.
HI_SAYING = ("लिखा", "कहा", "बोला", "बोले", "पूछा", "बताया")
# -------------------------------------------------------------------------------

_TERMS = ".!?…。！？｡؟۔।॥‼⁇⁈⁉"
_HARD = "。！？｡।॥۔"
_OPEN = "([{（［｛「『【〈《〔“„«‹"
_CLOSE = ")]}）］｝」』】〉》〕”»›"
_PAIR = dict(zip(_OPEN[:12], _CLOSE[:12])) | {"“": "”", "„": "”", "«": "»", "‹": "›", "[[": "]]", "{{": "}}"}
#: Quotation marks whose UTF-8 bytes were read as Latin-1 or Windows-1252.
_BROKEN = {"\x9c": "“", "œ": "“", "\x9d": "”", "\x9e": "„", "ž": "„"}
_EVENT = re.compile(
    r"<!--.*?-->|<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>|<(nowiki|math|code|pre|gallery)\b[^<>]*>.*?</\1\s*>|<[^<>]*>"
    r"|â[\x80€][\x9c-\x9eœž]|https?://[^\s\]<>|}]+|\[\[[^\[\]]*\]\]|\{\{[^{}]*\}\}|\[\[|\]\]|\{\{|\}\}|[" + re.escape(_OPEN + _CLOSE) + "\"]|[" + re.escape(_TERMS) + "]+"
)
_LIST = re.compile(r"[*:;\s﻿]*")
_DELIMITER = re.compile(r"[\s()\[\]{}（）「」『』“”„«»‹›\"<>|,;:،、，；：]")
_SPACED = re.compile(r"(?:^|[\s(])(\w{1,2})\.$")
_NEXT_SKIP = re.compile(r"(?:'{2,}|\[\[(?:[^\[\]|]*\|)?|[\"“„«‹「『（(\[\s¿¡*]|&nbsp;|\{\{[^{}]*\}\}|<[^<>]*>)*")
_WORD = re.compile(r"\w+")
_KANA = re.compile(r"[\u3040-\u30ff]")
_CLAUSE = re.compile(r"[\s。！？｡!?；;，,、…「」『』“”（）()《》<>\[\]{}]")
#: First characters of the particles of both languages, and characters on each side of a gap that tell its words.
_MAY_JOIN = frozenset(w[0] for d in (JAPANESE, CHINESE) for w, (name, _) in d.items() if name == "join")
_CONTEXT = 24
_THAI_GAP = re.compile(r"[ \t 　]+")
_HAS_THAI = re.compile(r"[฀-๿]")
_TRAIL_SPACE = " \t 　\r\x0b\x0c   ​﻿\x85  "


def _spaceless(ch: str) -> bool:
    return "぀" <= ch <= "ヿ" or "㐀" <= ch <= "鿿" or "豈" <= ch <= "﫿" or "\U00020000" <= ch <= "\U0003ffff"


def _match(spans: list[tuple[int, int, str]], stack: list[tuple[int, str]], s: int, e: int, tok: str) -> None:
    """Opens or closes a pair; the German closing mark is the English opening one."""
    if tok == "“" and any(o == "„" for _, o in stack):
        want, kind = "„", "quote"
    elif tok in _PAIR:
        stack.append((s, tok))
        return
    else:
        want = next((o for _, o in reversed(stack) if _PAIR[o] == tok), "")
        kind = {"}}": "template", "]]": "link"}.get(tok) or ("quote" if tok in "”»›」』" else "bracket")
    while want and stack:
        at, opener = stack.pop()
        if opener == want:
            spans.append((at, e, kind))
            return


def _protected(line: str, events: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that no sentence may end in, outermost only, each with its kind.

    Openers without a closer, and closers without an opener, protect nothing. The
    German closer is the English opener, so a closing mark is sought for „ first.
    """
    spans, stack, straight = [], [], None
    for s, e, tok in events:
        first = tok[0]
        if first in _TERMS:
            continue
        if first == "<" or first == "h":
            spans.append((s, e, "note" if tok[:4].lower() in ("<ref", "<!--") else "tag"))
        elif e - s > 2 and first in "[{":
            spans.append((s, e, "link" if first == "[" else "template"))
        elif first == "â":
            _match(spans, stack, s, e, _BROKEN[tok[2]])
        elif tok == '"':
            if straight is None:
                straight = s
            else:
                spans.append((straight, e, "quote"))
                straight = None
        else:
            _match(spans, stack, s, e, tok)
    spans.sort(key=lambda x: (x[0], -x[1]))
    outer: list[tuple[int, int, str]] = []
    for x in spans:
        if not outer or x[0] >= outer[-1][1]:
            outer.append(x)
    return outer


def _says(clause: list[tuple[str, str]]) -> bool:
    """Whether the words of a clause end in a verb of saying, which a particle or the person spoken to may follow."""
    k = len(clause)
    while k and clause[k - 1][1] in ("after", "person"):
        k -= 1
    return k > 0 and clause[k - 1][1] == "say"


def _joins(line: str, s: int, at: int, quoted: bool) -> bool:
    """Whether the word behind a gap, in a script without spaces, joins it to the words before the mark at s.

    A Japanese particle before a comma is a conjunction, which begins a sentence where the
    words before the mark end one, and so does a particle behind a final word.
    """
    rest = line[at : at + _CONTEXT]
    japanese = bool(_KANA.search(rest[:1]))
    opening = _CLAUSE.split(rest, maxsplit=1)[0]
    if not opening:
        return False
    words = segment(opening, JAPANESE if japanese else CHINESE)
    if words[0][1] != "join":
        return False
    if quoted:
        return True
    before = _CLAUSE.split(line[max(0, s - _CONTEXT) : s])[-1]
    left = segment(before, JAPANESE if japanese else CHINESE)
    if japanese:
        return words[0][0] not in ("が", "で", "と", "も") or (len(words) > 1 and not (left and left[-1][1] in ("final", "say") and words[0][0] != "と"))
    return words[0][0] == "的"


def _runs_on(line: str, s: int, at: int) -> bool:
    """Whether the sentence runs on behind a closing quotation that ends at at, in a script without spaces."""
    rest = line[at:]
    if not rest:
        return False
    if "ऀ" <= rest.lstrip()[:1] <= "ॿ":
        clause = re.split("[।?!\n]", rest, maxsplit=1)[0].rstrip()
        return any(w in clause[-12:] for w in HI_SAYING)
    if not _spaceless(rest[0]):
        return False
    if _joins(line, s, at, True):
        return True
    clauses = re.split("[，,、]", re.split("[。！？!?；;\n]", rest, maxsplit=1)[0])
    words = JAPANESE if _KANA.search("".join(clauses)) else CHINESE
    return any(_says(segment(c, words)) for c in {clauses[0], clauses[-1]})


def _ends(line: str, s: int, e: int, after: int, quoted: bool, never: Container[str]) -> bool:
    """Whether the terminators line[s:e], whose closers reach to after, end a sentence."""
    marks = line[s:e]
    rest = line[after:]
    if not rest.strip(_TRAIL_SPACE):
        return True
    if quoted and _runs_on(line, s, after):
        return False
    if not quoted and rest[0] in _MAY_JOIN and _spaceless(line[s - 1 : s] or " ") and _joins(line, s, after, False):
        return False
    if any(c in _HARD for c in marks):
        return True
    nxt = line[_NEXT_SKIP.match(line, after).end() :][:1]
    gap = rest[0] in _TRAIL_SPACE or rest.startswith("&nbsp;")
    if nxt.islower():
        return False
    if rest.lstrip(_TRAIL_SPACE)[:1] in tuple(",;:،、，；：–—-)]}）"):
        return False
    if "." not in marks:  # ? ! … ؟
        return gap or not (nxt.isascii() and nxt.isalnum()) or after > e or nxt.isupper()
    if not gap and after == e:
        return len(marks) == 1 and _ends_unspaced(line, s, after, nxt, never)
    if len(marks) > 1:
        return True
    return _full_stop_ends(line, s, after, nxt, never)


def _ends_unspaced(line: str, s: int, after: int, nxt: str, never: Container[str]) -> bool:
    """A full stop without a space behind it ends a sentence between a whole word, or a long number, and a capital
    or a letter of a script without capitals; else it belongs to a name, number or address."""
    raw = _DELIMITER.split(line[max(0, s - 24) : s])[-1].strip("'’*")
    begins = nxt == line[after : after + 1] and nxt.isalpha() and not nxt.islower() and not _HAS_THAI.match(nxt)
    whole = (raw.isalpha() and len(raw) > 1 and not raw[-1].isupper()) or (raw.isdigit() and len(raw) > 2)
    return begins and whole and _full_stop_ends(line, s, after, nxt, never)


def _full_stop_ends(line: str, s: int, after: int, nxt: str, never: Container[str]) -> bool:
    """Classifies a single full stop by the words on both sides of it."""
    raw = _DELIMITER.split(line[max(0, s - 24) : s])[-1].strip("'’*")
    if not raw or (len(raw) > LONGEST and raw.isalpha()):
        return True
    word = raw.lower()
    if after > s + 1:  # a closing quotation or bracket stands behind the mark
        return True
    digit = nxt.isdigit()
    before = line[: s - len(raw)].rstrip(_TRAIL_SPACE)
    if word.endswith("&nbsp"):
        return True
    if word.isdigit():
        nextword = _WORD.match(line, _NEXT_SKIP.match(line, after).end())
        return not (len(word) <= 2 and nextword and nextword.group().lower() in MONTHS)
    joined = word
    tail = _SPACED.search(before[-4:]) if len(word) <= 2 else None
    if tail:  # spaced abbreviations: z. B., т. д., p. ex.
        joined = tail.group(1).lower() + "." + word
    if joined in ("т.д", "т.п", "a.m", "p.m", "u.a.m"):
        return True
    if word in never or joined in never:
        return False
    if digit and word in BEFORE_NUMBER:
        return False
    if word in MAYBE_FINAL:
        follows = _WORD.match(line, after + 1)  # Bros. Ltd.
        return not (follows and line[follows.end() : follows.end() + 1] == "." and follows.group().lower() in COMPANY)
    if len(word) == 1 and word.isalpha():
        if raw.isupper():
            return False
        if raw.islower():
            return before[-1:].isdigit() or before.endswith(("&nbsp;", "}}"))  # a unit
        return before[-1:].isdigit()
    if "." in word and all(len(x) <= 1 for x in word.split(".")):
        return word in MAYBE_FINAL
    return True


def _thai_gaps(line: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    out = []
    for m in _THAI_GAP.finditer(line):
        s, e = m.span()
        if s == 0 or e == len(line) or any(a < s < b for a, b, _ in spans):
            continue
        left, right = line[s - 1], line[e]
        if any(c.isdigit() or (c.isalpha() and c < "ɐ") for c in (left, right)):
            continue
        if _HAS_THAI.match(right) or _HAS_THAI.match(left):
            out.append((s, e))
    return out


def split_line(line: str, never: Container[str] = NEVER_FINAL) -> list[tuple[int, int]]:
    """Sentences of one line as (start, end) in code points; see sentences(). never: abbreviations that end no sentence."""
    if not line or line.isspace():
        return []
    end = len(line.rstrip(_TRAIL_SPACE))
    head = _LIST.match(line).end()
    bare = line.lstrip(_TRAIL_SPACE)
    if bare.startswith(SKIPPED) or head >= end:
        return []
    events = [(m.start(), m.end(), m.group()) for m in _EVENT.finditer(line, head, end)]
    if not events and not _HAS_THAI.search(line):
        return [(head, end)]
    spans = _protected(line, events)
    starts = {a: (b, k) for a, b, k in spans}
    cuts: list[tuple[int, int]] = []
    k = 0
    for s, e, tok in events:
        if tok[0] not in _TERMS:
            continue
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        quoted, after = False, e
        if k < len(spans) and spans[k][0] <= s:
            a, b, kind = spans[k]  # within a protected span: an end only where its closer follows at once
            if kind not in ("quote", "bracket") or line[e : b - 1].strip("”»›」』）)\"'’   "):
                continue
            if kind == "bracket" and line[:a].rstrip(_TRAIL_SPACE) and not _bracket_sentence(line, a, cuts, head):
                continue
            quoted, after = True, b
        while after < end:  # closers, notes and templates directly behind the mark belong to it
            there = starts.get(after)
            if there and there[1] in ("note", "template"):
                after = there[0]
            elif line[after] in "”»›」』）)’" or line.startswith("''", after) or (line[after] == '"' and '"' in tok):
                after += 1
            else:
                break
        if cuts and after <= cuts[-1][0]:
            continue
        if _ends(line, s, e, after if (quoted or after > e) else e, quoted, never):
            cuts.append((after, after))
    if _HAS_THAI.search(line):
        cuts = sorted(set(cuts) | set(_thai_gaps(line, spans)))
    out, at = [], head
    for a, b in [*cuts, (end, end)]:
        a = min(a, end)
        while at < a and line[at] in _TRAIL_SPACE:
            at += 1
        stop = a
        while stop > at and line[stop - 1] in _TRAIL_SPACE:
            stop -= 1
        if stop > at:
            out.append((at, stop))
        at = max(at, b)
    return out


def _bracket_sentence(line: str, a: int, cuts: list[tuple[int, int]], head: int) -> bool:
    """Whether the bracket that opens at a opens a sentence too."""
    start = cuts[-1][1] if cuts else head
    return not line[start:a].strip(_TRAIL_SPACE)


def split_text(text: str, cache: dict[str, list[tuple[int, int]]], never: Container[str] = NEVER_FINAL) -> tuple[list[int], list[int]]:
    """Starts and ends of all sentences of a text, in code points."""
    starts: list[int] = []
    ends: list[int] = []
    at = 0
    for line in text.split("\n"):
        spans = cache.get(line)
        if spans is None:
            spans = cache[line] = split_line(line, never)
        for a, b in spans:
            starts.append(at + a)
            ends.append(at + b)
        at += len(line) + 1
    return starts, ends


#: Characters of lines that a worker remembers; revisions of a page share most of their lines.
CACHE_CHARS = 1 << 23


#: Letters of the longest word that may be an abbreviation.
LONGEST = 8
#: A word is learnt as an abbreviation from so many small letters behind its full stops, and this share of the letters there.
LEAST_SMALL, SMALL_SHARE = 8, 0.9
#: Learnt abbreviations that come to the driver and go out with the tasks; more are read by the workers from the shared folder.
MOST_LEARNT = 4096
_STOPPED = re.compile(r"(?<![\w.])([^\W\d_]{2,8})\. ([^\W\d_])")


def stopped_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n_small, n_other): letters behind a word and its full stop, over all lines of prose of all texts; equal lines of a batch are read once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: Counter[str] = Counter()
        other: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(small.keys() | other.keys())
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([small[w] for w in words], pa.int64()), pa.array([other[w] for w in words], pa.int64())], ["word", "n_small", "n_other"])
            small.clear()
            other.clear()
            return out

        for batch in batches:
            lines: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                lines.update(x for x in text.split("\n") if ". " in x)
            for line, n in lines.items():
                if not line.startswith(SKIPPED):
                    for word, nxt in _STOPPED.findall(line):
                        (small if nxt.islower() else other)[word.lower()] += n
            if len(small) + len(other) > 1 << 16:
                yield flush()
        yield flush()

    slim = docs.select(F.col(text_col).alias("text")).filter("text <> ''")
    return slim.mapInArrow(work, "word string, n_small bigint, n_other bigint").groupBy("word").agg(F.sum("n_small").alias("n_small"), F.sum("n_other").alias("n_other"))


#: The words that this process read last, by their files: a worker's tasks share them.
_READ: dict[tuple[str, ...], pa.Array] = {}


@dataclass
class StoredWords:
    """Words that stay in Parquet files of the shared folder; a worker holds them as one sorted column, of some 15 bytes a word."""

    files: tuple[str, ...]
    known: dict[str, bool] = field(default_factory=dict)

    def column(self) -> pa.Array:
        if self.files not in _READ:
            parts = []
            for file in self.files:
                where, path = fs.FileSystem.from_uri(file)
                with where.open_input_file(path) as f:
                    parts += pq.read_table(f, columns=["word"], use_threads=False).column("word").chunks
            words = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
            _READ.clear()
            _READ[self.files] = words.take(pc.sort_indices(words))  # by bytes, which is the order of code points
        return _READ[self.files]

    def __contains__(self, word: str) -> bool:
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) > 1 << 16:
                self.known.clear()
            words = self.column()
            at = bisect_left(range(len(words)), word, key=lambda i: words[i].as_py())
            hit = self.known[word] = at < len(words) and words[at].as_py() == word
        return hit


@dataclass
class EitherOf:
    """What one of two sets of words holds."""

    listed: Container[str]
    learnt: Container[str]

    def __contains__(self, word: str) -> bool:
        return word in self.listed or word in self.learnt


def learnt_abbreviations(docs: DataFrame, text_col: str = "text") -> Container[str]:
    """All words that sentences run on from behind a full stop, by all texts. More than MOST_LEARNT don't come to the driver but stay in the shared folder."""
    shown = (F.col("n_small") >= LEAST_SMALL) & (F.col("n_small") >= SMALL_SHARE * (F.col("n_small") + F.col("n_other")))
    found = materialize(stopped_words(docs, text_col).filter(shown & ~F.col("word").isin(*(MAYBE_FINAL | BEFORE_NUMBER))).select("word"))
    if found.count() > MOST_LEARNT:
        return StoredWords(tuple(sorted(found.inputFiles())))  # the files stay as long as the result may be computed
    out = frozenset(r.word for r in found.collect())
    release(found)
    return out


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_char, end_char): one row for each sentence of each text, whole texts.

    Positions are code points from 0, the end exclusive. Null, empty and blank texts
    have no sentence; a line without an end mark is one. Repeated rows give repeated
    rows' sentences once for each row. Other columns are ignored. Abbreviations are those of
    the lists and those that the texts themselves show.
    """
    learnt = learnt_abbreviations(docs, text_col)
    never = NEVER_FINAL | learnt if isinstance(learnt, frozenset) else EitherOf(NEVER_FINAL, learnt)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("text <> ''")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[tuple[int, int]]] = {}
        held = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            counts, starts, ends = [], [], []
            for text in batch.column(1).to_pylist():
                known = len(cache)
                a, b = split_text(text, cache, never)
                held += len(text) if len(cache) > known else 0
                if held > CACHE_CHARS:
                    cache.clear()
                    held = 0
                counts.append(len(a))
                starts += a
                ends += b
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, counts)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                ["doc_id", "start_char", "end_char"],
            )

    return slim.mapInArrow(work, "doc_id bigint, start_char int, end_char int")
