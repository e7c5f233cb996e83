"""Numbers, dates, times, abbreviations and tokens as Column expressions.

Every function takes and returns Columns and stays in the JVM. Closed sets are literal
arrays and maps. Data that the reference behaviour has no word for gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONES = ("", *"bir iki üç dört beş altı yedi sekiz dokuz".split())
TENS = ("", *"on yirmi otuz kırk elli altmış yetmiş seksen doksan".split())
MONTHS = tuple("Ocak Şubat Mart Nisan Mayıs Haziran Temmuz Ağustos Eylül Ekim Kasım Aralık".split())
SCALES = ((10**12, "trilyon"), (10**9, "milyar"), (10**6, "milyon"))
#: Long form, and the short forms that stand for it.
_SHORT = """
Avrupa Birliği: AB | bilgisayar: PC | Birleşmiş Milletler: BM | doktor: Dr | dolar: USD | et: @ | euro: EUR | gram: g gr | kilogram: kg | kilometre: km
Millî Eğitim Bakanlığı: MEB | metre: m | metreküp: m³ | metrekare: m² | NATO: NATO | numara: No no | öğrenci: Öğr | profesör: Prof | santimetre: cm
sayın: Sn sn | televizyon: TV | türk lirası: TL | Türk Dil Kurumu: TDK | Türkiye Büyük Millet Meclisi: TBMM | Türkiye Cumhuriyeti: TC
Türkiye Radyo ve Televizyon Kurumu: TRT | ve benzeri: vb vb. | ve diğerleri: vd vd. | ve saire: vs vs. | yüzde: %
"""
ABBREVIATIONS = {short: full.strip() for entry in _SHORT.replace("\n", "|").split("|") if entry.strip() for full, shorts in [entry.split(":")] for short in shorts.split()}
PUNCTUATION = '.,!?:;"()[]{}…—–'
_SPACES = "[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
LOWER, UPPER = "abcçdefgğhıijklmnoöprsştuüvyzâîû", "ABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZÂÎÛ"


def tr_lower(c: Column) -> Column:
    """Turkish lower case: the dotted capital I loses no dot, the dotless one gains none."""
    return F.lower(F.translate(c, "İI", "iı"))


def tr_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def _pick(words: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), index.cast("int") + 1)


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def _hundreds(n: int) -> str:
    """0 to 999 in words; 0 is the empty string."""
    head = [] if n < 100 else ["yüz"] if n < 200 else [ONES[n // 100], "yüz"]
    return " ".join(w for w in (*head, TENS[n // 10 % 10], ONES[n % 10]) if w)


_BELOW = "|".join(_hundreds(n) for n in range(1000))


def below_thousand(n: Column) -> Column:
    """0 to 999 in words, looked up in a constant array; 0 is the empty string."""
    return F.element_at(F.split(F.lit(_BELOW), "\\|"), n.cast("int") + 1)


def number_words(n: Column) -> Column:
    """A whole number below 10^15 in words; null beyond it."""
    n = n.cast("bigint")
    a = F.abs(n)
    parts = [F.when(k > 0, F.concat(below_thousand(k), F.lit(f" {name}"))).otherwise("") for size, name in SCALES for k in [F.floor(a / F.lit(size)) % 1000]]
    thousand = F.floor(a / 1000) % 1000
    parts += [F.when(thousand == 1, "bin").when(thousand > 1, F.concat(below_thousand(thousand), F.lit(" bin"))).otherwise(""), below_thousand(a % 1000)]
    words = F.when(a == 0, "sıfır").otherwise(_joined(*parts))
    return F.when(a < F.lit(10**15), F.when(n < 0, F.concat(F.lit("eksi "), words)).otherwise(words))


def plain_decimal(x: Column) -> Column:
    """The shortest form of a number that isn't negative, without an exponent: 1.5E-5 is
    0.000015; null for what is no number."""
    text = x.cast("double").cast("string")
    e = F.nullif(F.split_part(text, F.lit("E"), F.lit(2)), F.lit("")).try_cast("int")
    digits = F.regexp_replace(F.replace(F.split_part(text, F.lit("E"), F.lit(1)), F.lit(".")), "0+$", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    low = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    part = F.substr(digits, e + 2)
    high = F.concat(F.rpad(F.substr(digits, F.lit(1), e + 1), e + 1, F.lit("0")), F.lit("."), F.when(part == "", "0").otherwise(part))
    return F.when(text.rlike("^[0-9]"), F.when(e.isNull(), text).when(e < 0, low).otherwise(high))


def float_words(x: Column) -> Column:
    """A decimal number digit by digit after the point; null from 10^15 on."""
    text = plain_decimal(F.abs(x.cast("double")))
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    digits = F.array_join(F.transform(F.split(part, ""), lambda d: F.element_at(F.array(*map(F.lit, ("sıfır", *ONES[1:]))), d.cast("int") + 1)), " ")
    words = F.concat(number_words(whole.try_cast("bigint")), F.lit(" virgül "), digits)
    minus = (x < 0) | (x.cast("string").startswith("-"))
    return F.when(minus, F.concat(F.lit("eksi "), words)).otherwise(words)


def month_name(month: Column) -> Column:
    """Of a number from 1 to 12 or of a month's name in any case; other names pass."""
    text = month.cast("string")
    names = F.create_map(*(F.lit(x) for m in MONTHS for x in (m.lower(), m)))
    number = text.try_cast("int")
    return F.when(number.isNotNull(), F.when(number.between(1, 12), _pick(MONTHS, F.greatest(F.least(number, F.lit(12)), F.lit(1)) - 1))).otherwise(F.coalesce(names[F.lower(text)], text))


def date_words(day: Column, month: Column, year: Column) -> Column:
    """Day and year in words around the month's name; null for a month number out of 1 to 12."""
    return F.concat(number_words(day), F.lit(" "), month_name(month), F.lit(" "), number_words(year))


def time_words(hour: Column, minute: Column) -> Column:
    """Hour and minute in words, the hour alone on the hour; null out of range."""
    both = F.concat(number_words(hour), F.lit(" "), number_words(minute))
    return F.when(hour.between(0, 23) & minute.between(0, 59), F.when(minute == 0, number_words(hour)).otherwise(both))


def expand_abbreviation(token: Column) -> Column:
    """The long form by exact, then by upper-cased lookup; other tokens pass."""
    table = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    return F.coalesce(table[token], table[F.upper(token)], token)


def _filled(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda t: t != "")


def normalize(text: Column) -> Column:
    """Per token between white space: whole numbers in words, abbreviations in full; joined
    by one space. A number beyond 10^15 stays as it is."""

    def one(t: Column) -> Column:
        plain = t.rlike("^-?[0-9]+$")
        return F.when(plain, F.coalesce(number_words(t.try_cast("bigint")), t)).otherwise(expand_abbreviation(t))

    return F.array_join(F.transform(_filled(text), one), " ")


_MARKS = "".join("\\" + c if c in ".[](){}?" else c for c in PUNCTUATION)
_SPACE = _SPACES[1:-2]
#: Stands for an apostrophe that ends a word and is dropped; no character of any text.
_DROPPED = "\ufdd0"
_LONE_APOSTROPHE = f"(?<![^{_SPACE}])([{_MARKS}]*+[^{_SPACE}{_MARKS}'][^{_SPACE}']*+)'(?=[{_MARKS}]*+(?![^{_SPACE}]))"
_TOKEN = "(?! )(?:" + "|".join((
    "[\\wÀ-ÖØ-öø-ſ]++(?=[ \\n]|\\z)",  # most words: letters up to a space
    f"(?:(?<![^{_SPACE}])|\\G|(?<={_DROPPED}))[{_MARKS}]",  # a mark at either end of a chunk
    f"[^{_SPACE}{_MARKS}'{_DROPPED}][^{_SPACE}'{_DROPPED}]*+(?=['{_DROPPED}])",  # a word before its apostrophe
    f"[^{_SPACE}{_MARKS}'{_DROPPED}](?:[^{_SPACE}'{_DROPPED}]*[^{_SPACE}{_MARKS}'{_DROPPED}])?",  # a word without one
    f"'(?:[^{_SPACE}]*[^{_SPACE}{_MARKS}])?",  # what an apostrophe begins
)) + ")"


def tokenize(text: Column) -> Column:
    """White space, then punctuation off both ends mark by mark, then the first apostrophe
    inside a word, which stays with what follows it unless nothing does. One pass of one
    pattern; null for a null text."""
    kept = F.when(F.contains(text, F.lit("'")), F.regexp_replace(text, _LONE_APOSTROPHE, f"$1{_DROPPED}")).otherwise(text)
    return F.regexp_extract_all(kept, F.lit(_TOKEN), F.lit(0))
