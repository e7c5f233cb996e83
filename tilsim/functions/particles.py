"""Numerals, particles and reduplication as Column expressions.

They give what the functions of the same names in :mod:`tilsim.functions.grammar` give, and
null where those have no form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilsim.functions import grammar as g
from tilsim.functions.sounds import BACK, VOWELS, harmony_letters, high_vowel, low_vowel
from tilsim.functions.words import tr_lower

_BLANK = "[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def _some(word: Column) -> Column:
    return F.nullif(word, F.lit(""))


def full_reduplicate(word: Column) -> Column:
    return F.concat(_some(word), F.lit(" "), word)


def m_reduplicate(word: Column) -> Column:
    rest = F.when(word.rlike(f"^[{VOWELS}âîû]"), word).otherwise(F.substr(word, F.lit(2)))
    return F.when(~word.startswith("m"), F.concat(_some(word), F.lit(" m"), rest))


def _particle(word: Column, conj: Column) -> Column:
    last = F.regexp_extract(word, f"([{VOWELS}])[^{VOWELS}]*$", 1)
    return F.when(conj.isin("de", "da"), F.when((last != "") & (F.instr(F.lit(BACK), last) > 0), "da").otherwise("de")).otherwise(conj)


def conjoin(word: Column, conj: Column) -> Column:
    return F.when(conj.isin(*g.CONJUNCTIONS), F.concat(_some(word), F.lit(" "), _particle(word, conj)))


def coordinate(items: Column, conj: Column) -> Column:
    n = F.size(items)
    last = F.element_at(items, -1)
    pair = {key: F.concat(F.lit(f"{a} "), F.get(items, F.lit(0)), F.lit(f" {b} "), F.get(items, F.lit(1))) for key, (a, b) in g.CORRELATIVES.items()}
    both = F.lit(None).cast("string")
    for key, made in pair.items():
        both = F.when(conj == key, made).otherwise(both)
    listed = F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" "), _particle(last, conj), F.lit(" "), last)
    many = F.when(conj.isin(*g.CORRELATIVES), F.when(n == 2, both)).when(conj.isin(*g.CONJUNCTIONS), listed)
    known = conj.isin(*g.CONJUNCTIONS, *g.CORRELATIVES)
    return F.when(known & (n > 0) & ~F.exists(items, lambda x: x.isNull()), F.when(n == 1, F.get(items, F.lit(0))).otherwise(many))


def _numeral(text: Column, after_vowel: Callable[[Column, Column], Column], after_consonant: Callable[[Column, Column], Column]) -> Column:
    word = F.regexp_replace(F.regexp_replace(tr_lower(text), f"^{_BLANK}+|{_BLANK}+$", ""), f"{_BLANK}+", " ")
    plain = harmony_letters(word)
    own = F.regexp_extract(plain, "[^ ]*$", 0)  # the last word decides
    low, high = low_vowel(own), high_vowel(own)
    voiced = F.when(word.endswith("t"), F.concat(F.substr(word, F.lit(1), F.length(word) - 1), F.lit("d"))).otherwise(word)
    return F.when(word != "", F.when(own.rlike(f"[{VOWELS}]$"), F.concat(word, after_vowel(low, high))).otherwise(F.concat(voiced, after_consonant(low, high))))


def ordinal(text: Column) -> Column:
    return _numeral(text, lambda low, high: F.concat(F.lit("nc"), high), lambda low, high: F.concat(high, F.lit("nc"), high))


def distributive(text: Column) -> Column:
    return _numeral(text, lambda low, high: F.concat(F.lit("ş"), low, F.lit("r")), lambda low, high: F.concat(low, F.lit("r")))


#: Generators that need no Python.
NATIVE: dict[str, Callable[..., Column]] = {f.__name__: f for f in (full_reduplicate, m_reduplicate, conjoin, coordinate, ordinal, distributive)}
