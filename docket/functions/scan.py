"""Which of many fixed strings a text holds: one automaton over all of them, one pass a text, however many they are."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a word, so that a word stays a positive bigint.
WORD = 62


@lru_cache(maxsize=16)
def automaton(patterns: tuple[str, ...]) -> ahocorasick.Automaton:
    """Built once a Python worker for a list of patterns."""
    out = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        out.add_word(p, i)
    out.make_automaton()
    return out


def bits_of(patterns: tuple[str, ...], text: str) -> list[int]:
    """Bit i of the words, WORD bits each, is set if the text holds pattern i; matches may overlap and lie within each other."""
    words = [0] * -(-len(patterns) // WORD)
    for i in {i for _, i in automaton(patterns).iter(text)}:
        words[i // WORD] |= 1 << i % WORD
    return words


class Literals:
    """Fixed strings that texts are scanned for.  `scan` gives the bits of a text, `holds` asks them for one string.

    A null text has null bits, and asking them gives null; an empty text holds nothing.  An empty string is refused.
    """

    def __init__(self, patterns: list[str]) -> None:
        self.patterns = tuple(dict.fromkeys(patterns))
        if not self.patterns or "" in self.patterns:
            raise ValueError("patterns must be given, and none may be empty")
        self._place = {p: i for i, p in enumerate(self.patterns)}

    def scan(self, text: Column) -> Column:
        patterns = self.patterns

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else bits_of(patterns, t) for t in texts], dtype="object")

        return run(text)

    def holds(self, bits: Column):
        """Function of a pattern: whether the text of these bits holds it."""

        def ask(pattern: str) -> Column:
            i = self._place[pattern]
            return F.get(bits, F.lit(i // WORD)).bitwiseAND(F.lit(1 << i % WORD)) != 0

        return ask
