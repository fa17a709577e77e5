"""Freely typed values mapped to the entries of a reference list.

Method: a multi-pattern automaton over the entries' names and aliases finds mentions embedded in the typed value; of
mentions that overlap, the longest wins. Values in which it finds none go to token-set similarity over an inverted
index of the entries' tokens: weights of the shared tokens, which are more the rarer a token is in the list, against
those of both sets; tokens of letters may differ by a slip, tokens with digits may not. What neither
resolves, or what names more than one entry, is reported as unmatched.

What is particular to a kind of list (spellings, what counts as a token, what must not be taken for an entry) is a set
of ``Rules``; the plain ones suit names of places, brands or titles.

The reference list is small by nature; the resolver refuses lists of more than ``MOST`` entries. It is built once and
sent to the tasks; each task resolves each distinct value once, so hot values cost no more than rare ones and nothing
is shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most entries of a reference list, and most entries that a token may stand in to be looked up while a rarer one is there.
MOST, COMMON = 100_000, 1000
UNMATCHED = "UNMATCHED"


def edits(a: str, b: str) -> int:
    """Edits (replace, insert, remove, swap of neighbours) from a to b."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def plain(value: str) -> str:
    """Upper case without accents and compatibility forms; anything but letters and digits is one space."""
    s = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", value).upper())
    return " ".join(re.findall(r"[^\W_]+", "".join(c for c in s if not unicodedata.combining(c))))


def _own(name: str) -> list[str]:
    return [plain(name)]


def _words(text: str) -> list[str]:
    return plain(text).split()


def _bounded(s: str, start: int, end: int) -> bool:
    return not (s[start - 1 : start].isalnum() or s[end : end + 1].isalnum())


def _never(s: str, mentioned: list[str]) -> bool:
    return False


def _one_group(s: str) -> list[list[str]]:
    return [s.split()]


def _variants(word: str) -> set[str]:
    """The word and, from four letters on, what is left without one of them; words with digits stand for themselves."""
    return {word} | ({word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) > 3 and word.isalpha() else set())


def _slip(a: str, b: str) -> float:
    """1 for equal words; the share of letters that agree for words of letters that are one edit apart."""
    if a == b:
        return 1.0
    if not (a.isalpha() and b.isalpha()) or min(len(a), len(b)) < 4 or edits(a, b) > 1:
        return 0.0
    return 1 - 1 / max(len(a), len(b))


@dataclass(frozen=True)
class Rules:
    """How values and entries of a kind of list are read."""

    #: a value's text as the automaton sees it
    normalise: Callable[[str], str] = plain
    #: an entry's or alias's spellings, normalised
    spellings: Callable[[str], list[str]] = _own
    #: an entry's or alias's tokens
    tokens: Callable[[str], list[str]] = _words
    #: may text[start:end] be a mention where it stands?
    alone: Callable[[str, int, int], bool] = _bounded
    #: does the value, with these mentions, mean something that is not in the list?
    refused: Callable[[str, list[str]], bool] = _never
    #: the value's tokens, a list for each thing that it may name
    groups: Callable[[str], list[list[str]]] = _one_group
    #: under which keys a token, typed or of an entry, is looked up
    near: Callable[[str], list[str] | set[str]] = _variants
    #: how like a typed token is to an entry's, from 0 to 1
    alike: Callable[[str, str], float] = _slip
    #: weight of a token; rarity is the logarithm of one plus entries / entries with the token
    weight: Callable[[str, float], float] = lambda token, rarity: rarity
    #: least similarity
    threshold: float = 0.7
    #: is a group that no entry fits a sign that the value is in another list?
    closed: bool = False


PLAIN = Rules()


class Resolver:
    """Resolves typed values against ``names``; equal values give equal results. aliases: further names of entries."""

    def __init__(self, names: list[str], aliases: dict[str, list[str]] | None = None, rules: Rules = PLAIN):
        if len(names) > MOST:
            raise ValueError(f"a reference list of more than {MOST} entries")
        self.names, self.aliases, self.rules = sorted(set(names)), aliases or {}, rules
        unknown = set(self.aliases) - set(self.names)
        if unknown:
            raise ValueError(f"aliases of unknown entries: {', '.join(sorted(unknown)[:5])}")
        called = [(n, x) for n in self.names for x in (n, *self.aliases.get(n, []))]
        spelt: dict[str, set[str]] = defaultdict(set)
        self.sets: list[tuple[str, list[str]]] = []
        holding: dict[str, set[str]] = defaultdict(set)
        for name, x in called:
            for s in rules.spellings(x):
                if s:
                    spelt[s].add(name)
            tokens = list(dict.fromkeys(rules.tokens(x)))
            if tokens:
                self.sets.append((name, tokens))
            for t in tokens:
                holding[t].add(name)
        self.weights = {t: rules.weight(t, math.log(1 + len(self.names) / len(own))) for t, own in holding.items()}
        self.unknown = math.log(1 + len(self.names))
        index: dict[str, set[int]] = defaultdict(set)
        for i, (_, tokens) in enumerate(self.sets):
            for t in tokens:
                for key in rules.near(t):
                    index[key].add(i)
        self.index = dict(index)
        self.automaton = ahocorasick.Automaton()
        for s, own in spelt.items():
            self.automaton.add_word(s, (len(s), frozenset(own)))
        if spelt:
            self.automaton.make_automaton()
        self.resolve = lru_cache(maxsize=200_000)(self._resolve)

    def __getstate__(self):
        return self.names, self.aliases, self.rules

    def __setstate__(self, state):
        self.__init__(*state)

    def _mentions(self, s: str) -> list[tuple[int, int, frozenset[str]]]:
        """Mentions that stand alone, longest first, none overlapping; a spelling of several entries names them all."""
        found = []
        for end, (size, names) in self.automaton.iter(s) if len(self.automaton) else ():
            if self.rules.alone(s, end + 1 - size, end + 1):
                found.append((end + 1 - size, end + 1, names))
        taken: list[tuple[int, int, frozenset[str]]] = []
        for m in sorted(found, key=lambda m: (m[0] - m[1], m[0])):
            if all(m[1] <= t[0] or t[1] <= m[0] for t in taken):
                taken.append(m)
        return taken

    def _resolve(self, value: str) -> str:
        s = self.rules.normalise(value)
        mentions = self._mentions(s)
        if self.rules.refused(s, [s[a:b] for a, b, _ in mentions]):
            return UNMATCHED
        found = set().union(*(m[2] for m in mentions))
        if not mentions:
            for group in self.rules.groups(s):
                names = self._most_similar(group)
                if self.rules.closed and not names:
                    return UNMATCHED
                found |= names
        return found.pop() if len(found) == 1 else UNMATCHED

    def _most_similar(self, typed: list[str]) -> set[str]:
        """The entries of the greatest similarity to the typed tokens, if it reaches the threshold."""
        typed = list(dict.fromkeys(typed))
        looked = sorted((self.index.get(key, set()) for t in typed for key in self.rules.near(t)), key=len)
        # entries that share common tokens only can't be told apart by them while a rarer token is there
        near = set().union(*(own for own in looked if len(own) <= COMMON or len(own) == len(looked[0])))
        best, names = self.rules.threshold, set()
        for i in near:
            name, tokens = self.sets[i]
            shared = total = 0.0
            open_ = set(typed)
            for t in tokens:
                like, match = max((self.rules.alike(x, t), x) for x in typed)
                total += self.weights[t]
                if like:
                    shared += like * self.weights[t]
                    open_.discard(match)
            total += sum(self.weights.get(x, self.rules.weight(x, self.unknown)) for x in open_)
            similarity = shared / total if total else 0.0
            if similarity > best + 1e-12:
                best, names = similarity, {name}
            elif similarity >= best - 1e-12:
                names.add(name)
        return names


def resolve_values(df: DataFrame, column: str, names: list[str], into: str = "gene", aliases: dict[str, list[str]] | None = None, rules: Rules = PLAIN) -> DataFrame:
    """``df`` with ``into``: the entry that ``column`` means, 'UNMATCHED' if none; null stays null, a blank is unmatched."""
    resolver = Resolver(names, aliases, rules)

    @F.pandas_udf("string")
    def resolved(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            codes, distinct = pd.factorize(values)
            known = pd.Series([*map(resolver.resolve, distinct), None], dtype=object).to_numpy()  # the code of null is -1
            yield pd.Series(known[codes], dtype=object)

    return df.withColumn(into, resolved(F.col(f"`{column}`")))


def reference_names(entries: DataFrame, column: str) -> list[str]:
    """The distinct non-null entries, on the driver; more than MOST are an error."""
    rows = entries.select(F.col(f"`{column}`").alias("x")).filter("x is not null").distinct().limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a reference list of more than {MOST} entries")
    return sorted(r.x for r in rows)
