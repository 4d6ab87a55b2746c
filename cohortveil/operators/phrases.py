"""Many phrases looked for in one scan of a text.

The phrases form one automaton (Aho-Corasick), which reads a text once however many they
are.  It is built once per task from the phrases, which are a declared vocabulary.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WORD = re.compile(r"\w")


def automaton(phrases) -> ahocorasick.Automaton:
    """Matches phrases and gives their first places in the list."""
    out = ahocorasick.Automaton()
    for k, phrase in reversed(list(enumerate(phrases))):
        out.add_word(phrase, k)
    out.make_automaton()
    return out


def phrase_hits(text: Column, phrases) -> Column:
    """Sorted places in the list of the phrases that a text contains anywhere."""
    phrases = tuple(phrases)

    @F.pandas_udf(ArrayType(IntegerType()))
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = automaton(phrases)
        for batch in batches:
            yield pd.Series([sorted({k for _, k in machine.iter(t)}) if isinstance(t, str) else [] for t in batch])

    return hits(text)


def _ending(text: str, end: int) -> int | None:
    """End of a term as a whole word, with or without ``s`` or ``es``; None if the word goes on."""
    for suffix in ("s", "es", ""):
        at = end + len(suffix)
        if text.startswith(suffix, end) and not _WORD.match(text, at):
            return at
    return None


def term_hits(text: Column, terms) -> Column:
    """Sorted places in the list of the terms that a text names as whole words.

    Longer terms come first, of equally long ones those first in the list, and use up the
    words they match, so a term inside a longer one does not count.
    """
    terms = tuple(terms)
    rank = {k: r for r, k in enumerate(sorted(range(len(terms)), key=lambda k: -len(terms[k])))}

    def named(machine: ahocorasick.Automaton, t: str) -> list[int]:
        spans = []
        for last, k in machine.iter(t):
            begin = last + 1 - len(terms[k])
            end = _ending(t, last + 1)
            if end is not None and not (begin and _WORD.match(t, begin - 1)):
                spans.append((rank[k], begin, end, k))
        taken: list[tuple[int, int]] = []
        found = set()
        for _, begin, end, k in sorted(spans):
            if all(end <= a or b <= begin for a, b in taken):
                taken.append((begin, end))
                found.add(k)
        return sorted(found)

    @F.pandas_udf(ArrayType(IntegerType()))
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = automaton(terms)
        for batch in batches:
            yield pd.Series([named(machine, t) if isinstance(t, str) else [] for t in batch])

    return hits(text)
