"""Sentence units of documents in any language and script.

Method: document-centred disambiguation. Where a point may or may not end a sentence, unambiguous occurrences elsewhere
in the document tell: a word that the document also writes in lower case is a common word, so its capital marks a new
sentence; a word it never does is a name, so an initial before it ends nothing. A word that goes on after its point
somewhere in the document and never stands there without one is an abbreviation, which ends a sentence only before a common
word; one that the corpus takes for an abbreviation but that here stands without a point, and never goes on, is none. What the document leaves open, the
corpus decides: words that nearly always bear a point and mostly go on after it are abbreviations, counted over all
documents. Fixed lists hold what is known of common abbreviations; terminators follow the script: full-width stops end
sentences without a space, the danda ends Hindi ones, and in Thai a space between two Thai letters does.

Documents are segmented where they lie; the corpus counts are one aggregation with partial sums, of which only the
words that pass the test for abbreviations reach the tasks.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations after which a sentence goes on.
GOES_ON = frozenset(
    "no nos fig figs vol vols pp ca cf approx vs eg e.g i.e ie viz para paras pat pats sec secs ser eq eqs ref refs ex dr prof st mr mrs ms messrs m.p b.p r.i "
    "nr abb tab abs gem vgl zw bzgl bzw ggf z d.h z.b u.a o.ä evtl inkl exkl max sog ca env p.ex c.-à-d av chap mme mlle "
    "núm num pág págs aprox sr sra dra ej p.ej art ee ed eds "
    "см табл рис стр ок т п пп гл напр ср т.е им проф ص د डॉ श्री cap lám".split()
)
#: Those that may end a sentence: company forms, times of day, what closes a list.
MAY_END = frozenset("inc co ltd corp bros llc plc gmbh al a.m p.m u.s u.k uu jr sr ph.d b.c a.d ff г гг".split())
#: Units written with a point.
UNITS = frozenset("lb lbs in cu ft oz sq min hr hrs sec gal yd мин ч".split())
#: What closes a list and goes on only before a comma or the like.
CLOSES = frozenset("etc usw usf u.s.w т.д т.п др и.т.д".split())
#: German words before an ordinal.
BEFORE_ORDINAL = frozenset("das der des dem den die am im vom zum zur beim ein eine einem einen eines einer ab bis seit ins und jede jeder jedes".split())
#: Words after a number sign, which go on before a number only.
NUMBERED = frozenset("n p s seite page art".split())
#: Pairs of quotation marks; the straight ones open behind white space.
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "‘": "’", "《": "》"}
CLOSERS = "\"'”’»›」』)]}）】》〉"
#: Characters that are misread for Latin letters.
LOOKS = str.maketrans("аеорсхуАВЕКМНОРСТХіјгтопս015†|", "aeopcxyABEKMHOPCTXijrtonuols" + "tl")

_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
#: Words that a task counts before it sends their counts on.
HELD = 500_000
#: Stops; a point right before a digit, a small letter or the like is none.
_STOP = re.compile(r"[!?…。！？｡．।॥؟۔][.!?…。！？｡．।॥؟۔]*|\.[.!?…。！？]+|\.(?![0-9a-z,;:/_*^=\-])")
_HEAD = re.compile(r"[^\W_][\w'’-]*")
_IN_THAI = re.compile("[ก-๎]")
_SOLID = re.compile(r"\S")
_THAI = re.compile(r"(?<=[ก-ฺเ-๎])\s+(?=[ก-ฺเ-๎])")
_TAIL = re.compile(r"(?:[ \xa0 ]?»|[\"'”’›」』)\]}）】》〉“])+")
_QUOTES = re.compile(r"[\"“„«「『‘《]|(?<![^\s(\[（])'(?=\w)")
_LOWER = re.compile(r"(?<![\w'’-])[^\W\d_A-Z][^\W\d_]*")
_ITEM = re.compile(r"[\[【(（]?\s*(?:\d{1,5}|[ivxIVX]{1,5}|[A-Za-z])\s*[\])】）]?\.?")
_ROUND = re.compile(r"[()（）]")
_POINT = re.compile(r"\.\s+")
#: A point after which a text may go on, within a paragraph; what heads an item does not show it.
_GOES = re.compile(r"\.(?:(?:[^\S\n]+\n?|\n)[^\S\n]*(?=[^\W_A-Z])(?!\d+[.)、．])|\s?(?=[,;]))")
_LAST = re.compile(r"(?<![^\W_])[^\W\d_]+$")
_BARE = re.compile(r"[(\[\"'“„«‘]*([^\W\d_]{1,24})[,;:!?)\]\"'”“»’]*")


def _cjk(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "豈" <= c <= "﫿" or "＀" <= c <= "￯" or "\U00020000" <= c <= "\U0003ffff"


def _last_word(text: str, i: int) -> str:
    """The word of up to 24 letters right before text[i]; empty if there is none."""
    tail = text[max(0, i - 25) : i]
    word = tail[tail.rfind(" ") + 1 :]  # most words stand behind a space
    if not word.isalpha():
        m = _LAST.search(tail)
        word = m[0] if m else ""
    return word if len(word) < 25 else ""


def _spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """(opening, closing) places of quotations within text[a:b]; a mark without its mate is none."""
    out, at = [], a
    gone = set()  # mates that don't come again
    while m := _QUOTES.search(text, at, b):
        i, c = m.start(), m[0]
        at = i + 1
        if c in "\"'":
            if i > a and not text[i - 1].isspace() and text[i - 1] not in "([（：:，,、" and not _cjk(text[i - 1]):
                continue
            end = i + 1
            while c not in gone:
                end = text.find(c, end, b)
                if end < 0 or end + 1 >= b or (not text[end + 1].isalnum() or _cjk(text[end + 1])) and not (text[end - 1].isspace() and text[end + 1].isalnum()):
                    break
                end += 1
            else:
                continue
            if end < 0:
                gone.add(c)
        else:
            ends = []
            for x in PAIRS[c]:
                if x not in gone and (e := text.find(x, i + 1, b)) >= 0:
                    ends.append(e)
                else:
                    gone.add(x)
            end = min(ends, default=-1)
        if 0 <= end:
            out.append((i, end))
            at = end + 1
    return out


class Segmenter:
    """Splits texts; ``abbreviations``: further ones that the corpus shows; ``ordinary``: words that it shows to be none."""

    def __init__(self, abbreviations: frozenset[str] = frozenset(), ordinary: frozenset[str] = frozenset()):
        self.ordinary = ordinary
        self.learned = abbreviations - MAY_END - CLOSES - UNITS - NUMBERED
        self.listed = GOES_ON | MAY_END | UNITS | NUMBERED | CLOSES
        self.known = self.learned | GOES_ON | MAY_END | UNITS | NUMBERED
        self.on = frozenset(y for x in GOES_ON if len(x) > 1 for y in (x, x.capitalize(), x.upper()))
        self.tails = frozenset(x[-5:] for x in self.learned | GOES_ON | MAY_END if len(x) > 4)

    def sentences(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) of each sentence in code points, in order; nothing for null, empty and blank texts."""
        if not text:
            return []
        out: list[tuple[int, int]] = []
        self._known: set[str] | None = None
        self._on: set[str] | None = None
        self._thai = _IN_THAI.search(text) is not None
        self._quoted = _QUOTES.search(text) is not None
        at = 0
        for m in _BLANK.finditer(text):
            self._paragraph(text, at, m.start(), out)
            at = m.end()
        self._paragraph(text, at, len(text), out)
        return out

    def _common(self, text: str, word: str) -> bool:
        """Does the document write the word in lower case, too?"""
        if self._known is None:
            self._known = set(_LOWER.findall(text))
        return word.lower() in self._known

    def _shown(self, text: str) -> set[str]:
        """Words of two to 24 letters, in lower case, that the document itself shows to be abbreviations.

        They never stand without a point and go on after it: before a comma or semicolon, or before a small word or a
        number. As a sentence may begin with a stray small word or a number, the latter must be more than half of the
        word's points, and three, where the corpus has the word as an ordinary one.
        """
        if self._on is None:
            on: Counter[str] = Counter()
            sure = set()
            self._went: set[str] = set()
            self._low = ""
            for m in _GOES.finditer(text):
                i, k = m.start(), m.end()
                w = _last_word(text, i)
                if len(w) < 2 or i > len(w) and text[i - len(w) - 1] != " " and unicodedata.category(text[i - len(w) - 1])[0] == "M":
                    continue
                word, c = w.lower(), text[k]
                if c in ",;":
                    sure.add(word)
                elif self._small(_HEAD.match(text, k)[0]):
                    on[word] += 1
                elif not c.isdigit():
                    continue
                self._went.add(word)
            self._on = set()
            for w in self._went - self.listed:
                bare, pointed = self._uses(text, w)
                if not bare and (w in sure or w not in self.ordinary or on[w] > 2 and on[w] * 2 > pointed):
                    self._on.add(w)
        return self._on

    def _uses(self, text: str, word: str) -> tuple[int, int]:
        """How often the document has the word, given in lower case, without a point and with one."""
        low = self._low = self._low or text.lower()
        bare = pointed = 0
        k = low.find(word)
        while k >= 0:
            e = k + len(word)
            if not low[e : e + 1].isalnum() and not (k and low[k - 1].isalnum()):
                if low[e : e + 1] == ".":
                    pointed += 1
                else:
                    bare += 1
            k = low.find(word, e)
        return bare, pointed

    def _paragraph(self, text: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
        b = a + len(text[a:b].rstrip())
        if (first := _SOLID.search(text, a, b)) is None:
            return
        a = self._from = first.start()
        self._brackets: list[int] | None = None
        ends = []
        quotes = None if self._quoted else []
        start = a
        skip = a
        for m in _STOP.finditer(text, a, b):
            i, j = m.span()
            if i < skip:
                continue
            mark = m[0]
            after = text[j] if j < b else ""
            if mark == ".":
                if after == " " or after == "\n":  # most points: a known abbreviation, or a plain word and a capital behind
                    space = max(text.rfind(" ", start, i), text.rfind("\n", start, i))
                    token = text[space + 1 if space >= 0 else start : i]
                    if token in self.on:
                        continue
                    if (
                        len(token) > 1
                        and text[j + 1 : j + 2].isupper()
                        and token.isalpha()
                        and token.islower()
                        and token not in self.known
                        and token not in self._shown(text)
                        and (token.isascii() or len(token) > 4 and token[-5:] not in self.tails)
                        and text.find("(", start, i) < 0
                        and text.find("（", start, i) < 0
                    ):
                        if quotes is None:
                            quotes = _spans(text, a, b)
                        if not quotes or not any(q[0] < i < q[1] for q in quotes):
                            ends.append(j)
                            start = skip = j + 1
                            continue
                elif after and (after.isdigit() or after.islower()):
                    continue
            elif mark == "。" and after and after not in "，、；：,;:)）" and after not in CLOSERS and after not in "“ \xa0 " and text.find("(", start, i) < 0 and text.find("（", start, i) < 0:
                if quotes is None:
                    quotes = _spans(text, a, b)
                if not quotes or not any(q[0] < i < q[1] for q in quotes):
                    ends.append(j)
                    start = _SOLID.search(text, j, b).start()
                    skip = j
                    continue
            if quotes is None:
                quotes = _spans(text, a, b)
            inside = next((q for q in quotes if q[0] < i < q[1]), None) if quotes else None
            if inside is not None:
                close = inside[1]
                tail = text[j:close]
                if tail.strip(" \xa0 )]）") or not self._quote_ends(text, inside, i, b):
                    continue
                end = close + 1
                t = _TAIL.match(text, end, b)
                if t and text[end] in CLOSERS:
                    end = t.end()
            else:
                end = j
                t = _TAIL.match(text, j, b)
                if t and not any(t.start() <= q[0] < t.end() for q in quotes):
                    end = t.end()
                if not self._ends(text, start, i, j, end, b, mark):
                    continue
            if end < b:
                ends.append(end)
                start = _SOLID.search(text, end, b).start()
                skip = end
        if self._thai:
            ends = sorted({*ends, *(m.start() for m in _THAI.finditer(text, a, b))})
        s = a
        for e in [*ends, b]:
            t = s + len(text[s:e].rstrip())
            if t > s:
                out.append((s, t))
            if e < b:
                s = _SOLID.search(text, e, b).start()

    @staticmethod
    def _next_word(text: str, k: int, b: int) -> str:
        while k < b and text[k].isspace():
            k += 1
        m = _HEAD.match(text, k, b)
        return m[0] if m else text[k : k + 1]

    def _telling(self, text: str, k: int, b: int, names: bool) -> str:
        """The next word that tells how the text goes on: not one of a script without case, and with ``names`` no name.

        A name is a word with a capital that the document writes within sentences, too, and never without it.
        """
        word = ""
        while True:
            while k < b and text[k].isspace():
                k += 1
            m = _HEAD.match(text, k, b)
            word = m[0] if m else text[k : k + 1]
            foreign = word and (_cjk(word[0]) or "ぁ" <= word[0] <= "ヿ")
            name = names and word[:1].isupper() and len(word) > 1 and not self._common(text, word) and re.search(rf"[a-z,] {re.escape(word)}\b", text) is not None
            if not foreign and not name:
                return word
            k += len(word)

    @staticmethod
    def _small(word: str) -> bool:
        """A word in lower case throughout; pH is none."""
        return word[:1].islower() and word == word.lower()

    def _quote_ends(self, text: str, quote: tuple[int, int], i: int, b: int) -> bool:
        """A stop right before the closing mark: does the sentence around the quotation end with it?"""
        opening, close = quote
        k = close + 1
        while k < b and text[k] in CLOSERS:
            k += 1
        if k >= b:
            return True
        gap = text[k].isspace()
        word = self._next_word(text, k, b)
        c = word[:1]
        first = text[opening + 1 : i].lstrip()[:1]
        if c in ",;:，；：、.。)）" or c in "-–—":
            return False
        if first.islower() and text[i] == ".":
            return True  # the point can only be the outer sentence's
        if _cjk(c) or "ぁ" <= c <= "ヿ":
            if "ぁ" <= c <= "ゟ":  # particles
                return False
            before = text[:opening].rstrip()[-1:] if opening else ""
            return before in ":：" or text[close] in "」』"
        if self._small(word):
            return False
        if c.isalpha() and not c.isupper() and not c.islower():  # scripts without case
            before = text[:opening].rstrip()[-1:]
            return before == ":" and gap
        return True

    def _ends(self, text: str, start: int, i: int, j: int, end: int, b: int, mark: str) -> bool:
        """Does the stop at text[i:j], with closing marks up to ``end``, end the sentence that began at ``start``?"""
        if end >= b:
            return True
        gap = text[end].isspace()
        word = self._next_word(text, end, b)
        c = word[:1]
        if mark[0] in "。！？｡．।॥؟۔":
            if c in "，、；：,;:)）" or c in CLOSERS:
                return False
            if mark[0] == "．" and i and text[i - 1].isdigit():
                return False
            return not self._open_bracket(text, start, i, b) or end > j
        if c in ",;:，；、：)]" or not gap and c in "-–—":
            return False
        if mark[0] in "!?":
            if self._open_bracket(text, start, i, b) and end == j:
                return False
            return gap or c.isalpha() or c in "¿¡(\"'“„«"
        if len(mark) > 1 or mark == "…":  # an ellipsis
            if gap and i and text[i - 1].isspace() and text[start].isascii():
                word = self._telling(text, end, b, True)
                c = word[:1]
            return not self._small(word) and c not in ",;:" and (gap or c.isupper())
        # a single point
        if end == j and self._open_bracket(text, start, i, b):
            return False
        if end > j and self._small(word) and text[start] not in "([（\"'":
            opened = text.rfind("(", start, i)  # a whole sentence in brackets ends with them
            if opened < 0 or not text[opened + 1].isupper() or text.count(" ", opened, i) < 3:
                return False
        token_at = i
        while token_at > start and not text[token_at - 1].isspace():
            token_at -= 1
        token = text[token_at:i].lstrip("([{\"'“„«‘（")
        before = text[i - 1]
        if end == j and _ITEM.fullmatch(text[start:j].rstrip(".")) and j - start < 9 and (text[start : start + 1] in "([【" or text[start:i].strip().isdigit() or self._heads(text, start, i)):
            return False
        if not gap:
            if not token:
                return False
            if _cjk(before) or "ぁ" <= before <= "ヿ":
                return _cjk(c) or "ぁ" <= c <= "ヿ"
            if end > j:
                return c.isupper() or c in "([\"“„«¿¡"
            if c.isupper() and len(word) == 1 and len(token.rpartition(".")[2]) > 1 and re.match(r"\.\s+[A-Z]", text[end + 1 : end + 4]):
                return True  # an initial begins the next sentence
            if not (c.isupper() and len(word) > 1 and word[1:2].islower() or c in "¿¡" or (c.isupper() and len(word) == 1 and text[end + 1 : end + 2] == " ")):
                return c == "(" and len(token) > 1
            last = token.rpartition(".")[2]
            kind = self._abbreviation(text, token)
            if kind == "shown":
                return self._common(text, word)
            return (len(last) > 1 or not last.isalpha()) and kind not in ("on", "list") or kind == "end"
        kind = self._abbreviation(text, token)
        if kind == "end":
            return True
        if kind in ("on", "learned"):
            return False
        if kind == "shown":
            return c.isupper() and self._common(text, word)
        if kind == "may":
            often = token.lower() in ("al", "a.m", "p.m")  # more often within a sentence than at its end
            if gap and c and (often or not c.isascii()):
                word = self._telling(text, end, b, often)
                c = word[:1]
            if c.isalpha() and not self._small(word):
                return not (token.lower() in ("u.s", "u.k") and word.translate(LOOKS) in ("Pat", "Patent", "Pub", "Ser", "Appl"))
            return not c.isalpha() and c not in "-–—&%"
        if kind == "unit":
            word = self._telling(text, end, b, True)
            c = word[:1]
            return c.isupper() or not c.isalnum() and c not in "-–—&%" or word != word.lower()
        low = token.lower()
        if low in NUMBERED and (c.isdigit() or word in ("ex", "ej", "B", "h")):
            return False
        if len(token) == 1 and token.isalpha():
            return self._after_letter(text, start, token_at, token, word, c)
        if token.isdigit() and len(token) <= 2 and c.isupper():
            previous = text[start:token_at].split()
            if previous and previous[-1].lower() in BEFORE_ORDINAL:
                return False
        if "ऀ" <= before <= "ॿ":
            return False  # Hindi sentences end with a danda
        return True

    def _after_letter(self, text: str, start: int, token_at: int, token: str, word: str, c: str) -> bool:
        """A single letter with a point: an initial, part of an abbreviation in pieces, or the end of a formula."""
        previous = text[max(start, token_at - 12) : token_at].split()
        last = previous[-1] if previous else ""
        low = token.lower()
        if (last.lower(), low) in (("т.", "д"), ("т.", "п")):
            return c not in ",;"
        if last.lower() in ("т.", "z.", "d.", "u.", "p.", "o.", "e.", "i.", "s."):
            return False
        if low in ("т", "п", "z") or (low == "d" and word == "h"):
            return False
        if last and not last[-1].isalnum() and last[-1] not in ".,;:)]\"'”»":
            return True  # an operator before it: the end of a formula
        if token.isupper():
            if len(word) == 1 and c.isupper() and re.match(rf"\s*{word}\.", text[token_at + len(token) + 1 :][:4]):
                return False  # initials in a row
            if not c.isupper():
                return not c.isalpha() and not c.isdigit()
            return self._common(text, word)
        return not (self._small(word) and low in ("г", "с", "v", "n"))

    def _abbreviation(self, text: str, token: str) -> str:
        """What the document, the lists or the corpus say of the word; a list's word is known, so they say how it goes on."""
        low = token.lower()
        if low not in GOES_ON and any("a" <= c <= "z" for c in low) and not low.isalpha() or not low.isascii():
            if any("a" <= c <= "z" for c in low) and not low[0].isdigit():
                low = "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c)).translate(LOOKS).lower() if low not in GOES_ON else low
        if low in self._shown(text) or token.lower() in self._shown(text):
            return "shown"
        if low in CLOSES:
            return "end"
        if low in GOES_ON:
            return "on"
        if low in MAY_END:
            return "may"
        if low in UNITS:
            return "unit"
        if "." in low and re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", low):
            return "may" if low in MAY_END else "on"
        if "-" not in low and low in self.learned and (low in self._went or not self._uses(text, low)[0]):
            return "learned"
        return ""

    @staticmethod
    def _heads(text: str, start: int, i: int) -> bool:
        """A lone letter or roman number at a sentence's start heads an item only in lower case; A. B. is a name."""
        return text[start:i].strip("[]()（）【】 ").islower() and len(text[start:i]) > 1

    def _open_bracket(self, text: str, start: int, i: int, b: int) -> bool:
        """Is text[i] within brackets that were opened in the sentence and are closed behind it?"""
        if self._brackets is None:  # of the paragraph, with how many are open before each
            self._brackets = [m.start() for m in _ROUND.finditer(text, self._from, b)]
            self._depths = [0, *accumulate(1 if text[k] in "(（" else -1 for k in self._brackets)]
        k = bisect_left(self._brackets, i)
        if k == len(self._brackets) or text[self._brackets[k]] in "(（":
            return False
        return self._depths[k] > self._depths[bisect_left(self._brackets, start)]


def abbreviations(texts: DataFrame, text: str) -> DataFrame:
    """word, learned: what the whole corpus shows to be an abbreviation after which sentences go on, or else an ordinary word.

    A word is learned if nine of ten of its occurrences have a point and half of those (with three more counted against
    it, so that chance doesn't decide on rare words) go on in lower case, with a number or a comma. One that goes on somewhere is
    ordinary if less than nine of ten have a point, or less than one in five of those goes on. Words of up to 24 letters.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain: Counter[str] = Counter()
        on: Counter[str] = Counter()
        up: Counter[str] = Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            words = sorted(set(plain) | set(on) | set(up))
            yield pa.record_batch([pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in (plain, on, up)]], names=["word", "plain", "on", "up"])
            for c in (plain, on, up):
                c.clear()

        for batch in batches:
            raw: Counter[str] = Counter()
            for x in batch.column(0).to_pylist():
                if x:
                    raw.update(x.split())
                    pieces = _POINT.split(x)
                    for before, behind in zip(pieces, pieces[1:]):  # noqa: B905
                        if behind and (word := _last_word(before, len(before))):
                            c = behind[0]
                            (on if c.islower() or c.isdigit() or c in ",;" else up)[word.lower()] += 1
            for token, n in raw.items():
                if not token.endswith(".") and (m := _BARE.fullmatch(token)):
                    plain[m[1].lower()] += n
            if len(plain) + len(on) + len(up) > HELD:
                yield from flushed()
        yield from flushed()

    counts = texts.select(text).mapInArrow(count, "word string, plain bigint, on bigint, up bigint")
    sums = counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("plain", "on", "up")])
    pointed = F.col("on") + F.col("up")
    mostly = pointed * 10 >= (pointed + F.col("plain")) * 9
    learned = mostly & (F.col("on") * 2 >= pointed + 3)
    ordinary = (F.col("on") > 0) & (~mostly | (F.col("up") > F.col("on") * 4))
    return sums.filter(learned | ordinary).select("word", learned.alias("learned"))


#: More learned abbreviations than this are an error: no language has as many.
MOST = 200_000
#: The same for ordinary words, of which the texts' languages have more.
MOST_ORDINARY = 1_000_000


def split_sentences(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, start_pos, end_pos (int, code points; the end is exclusive): one row per sentence of each document.

    A blank line always ends a sentence; sentences cover all but white space; null, empty and blank texts have none.
    """
    told = abbreviations(documents, f"`{text}`").limit(MOST + MOST_ORDINARY + 1).collect()
    words, ordinary = (frozenset(r.word for r in told if r.learned == x) for x in (True, False))
    if len(words) > MOST or len(ordinary) > MOST_ORDINARY:
        raise ValueError(f"more than {MOST} abbreviations or {MOST_ORDINARY} ordinary words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(words, ordinary)
        for batch in batches:
            found = [segmenter.sentences(x) for x in batch.column(1).to_pylist()]
            flat = np.array([x for f in found for x in f], dtype=np.int32).reshape(-1, 2)
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["k", "start_pos", "end_pos"])

    source = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    out = source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, start_pos int, end_pos int")
    return out.withColumnRenamed("k", key)
