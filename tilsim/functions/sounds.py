"""Vowel harmony, syllables, stress and IPA as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilsim.functions.words import tr_lower, tr_upper

VOWELS = "aıoueiöü"
BACK, FRONT, ROUND = "aıou", "eiöü", "oöuü"
HARD = "fstkçşhp"
_WIDE, _NARROW = "âîûÂÎÛAEIİOÖUÜ", "aiuaiuaeıioöuü"
#: Two consonants that may begin a syllable.
ONSETS = tuple("bl br çr dr fl fr gl gr kl kr pl pr sk sp st şp şt tr".split())
_SYLLABIC = "aeıioöuüâîû"
#: Words with the stress before their last syllable: its place from 0.
STRESS = {
    word: place
    for place, words in enumerate((
        "ankara artvin batman bursa diyarbakır erzurum eskişehir izmir kayseri konya mersin muş rize samsun sivas spor stres trabzon trafik tren van",
        "adana antalya bisiklet istanbul klima malatya otobüs",
        "denizli gaziantep kocaeli",
    ))
    for word in words.split()
}
IPA = dict(zip("abcçdefghıijklmnoöprsştuüvyz", "a b dʒ tʃ d e f ɡ h ɯ i ʒ k l m n o ø p ɾ s ʃ t u y v j z".split(), strict=True))


def harmony_letters(word: Column) -> Column:
    """Circumflexes and capitals of vowels give way to plain small letters."""
    return F.translate(word, _WIDE, _NARROW)


def last_vowel(word: Column) -> Column:
    return F.nullif(F.regexp_extract(word, f"([{VOWELS}])[^{VOWELS}]*$", 1), F.lit(""))


def low_vowel(stem: Column) -> Column:
    """a after a back vowel, e after a front one; null without a vowel."""
    return F.translate(last_vowel(stem), VOWELS, "aaaaeeee")


def high_vowel(stem: Column) -> Column:
    """ı, i, u or ü by the last vowel; null without one."""
    return F.translate(last_vowel(stem), VOWELS, "ııuuiiüü")


def ends_in_vowel(stem: Column) -> Column:
    return stem.rlike(f"[{VOWELS}]$")


def hardens(stem: Column) -> Column:
    return stem.rlike(f"[{HARD}]$")


def syllables(word: Column) -> Column:
    """The syllables of a word: the boundary stands before a vowel that follows one, before
    a single consonant, and before the last consonant of more, or the last two of three or
    more if they may begin a syllable. No vowel: the word itself; empty: none."""
    v, c = f"[{_SYLLABIC}]", f"[^{_SYLLABIC}\u0001]"
    onset = "|".join(ONSETS)
    marked = word
    marked = F.regexp_replace(marked, f"(?<={v}{c})(?=(?:{onset}){v})", "\u0001")  # of three consonants
    marked = F.regexp_replace(marked, f"({v}{c}{{2,}})(?=(?:{onset}){v})", "$1\u0001")  # of four or more
    marked = F.regexp_replace(marked, f"(?<={v}{c}{{1,40}})(?=[^{_SYLLABIC}\u0001]{v})(?<!\u0001[^{_SYLLABIC}])(?<!\u0001)", "\u0001")
    marked = F.regexp_replace(marked, f"(?<={v})(?={c}?{v})", "\u0001")
    marked = F.regexp_replace(marked, "\u0001+", "\u0001")
    return F.when(word == "", F.array().cast("array<string>")).otherwise(F.split(marked, "\u0001"))


def stress(word: Column) -> Column:
    """The place of the stressed syllable from 0: the last, but for a closed list; null for
    the empty word."""
    table = F.create_map(*(F.lit(x) for pair in STRESS.items() for x in pair))
    return F.when(word != "", F.coalesce(table[tr_lower(word)], F.size(syllables(word)) - 1))


def stress_mark(word: Column) -> Column:
    """Syllables parted by a middle dot, the stressed one in capitals."""
    low = tr_lower(word)
    at = stress(low)
    return F.when(word == "", "").otherwise(F.array_join(F.transform(syllables(low), lambda s, i: F.when(i == at, tr_upper(s)).otherwise(s)), "·"))


_ONE_TO_ONE = {c: x for c, x in IPA.items() if len(x) == 1 and c != x}


def ipa(text: Column) -> Column:
    """IPA letter by letter. ğ lengthens the vowel before it inside a word and is silent
    elsewhere; k and l go by the nearest vowel to the left, else to the right, anywhere in
    the text: the text is cut before each vowel, and each piece has its letters replaced."""
    low = F.regexp_replace(F.lower(text), f"(?<=[{VOWELS}])ğ(?=[^ \t\n])", "ː")
    low = F.replace(F.replace(F.replace(low, F.lit("ğ")), F.lit("c"), F.lit("dʒ")), F.lit("ç"), F.lit("tʃ"))
    first = F.regexp_extract(low, f"[{VOWELS}]", 0)

    def by(piece: Column, vowel: Column) -> Column:
        return F.when(vowel == "", piece).when(F.instr(F.lit(FRONT), vowel) > 0, F.replace(piece, F.lit("k"), F.lit("c"))).otherwise(F.replace(piece, F.lit("l"), F.lit("ɫ")))

    pieces = F.regexp_extract_all(low, F.lit(f"[{VOWELS}][^{VOWELS}]*"), F.lit(0))
    sounded = F.concat(by(F.regexp_extract(low, f"^[^{VOWELS}]*", 0), first), F.array_join(F.transform(pieces, lambda p: by(p, F.substr(p, F.lit(1), F.lit(1)))), ""))
    return F.translate(sounded, "".join(_ONE_TO_ONE), "".join(_ONE_TO_ONE.values()))
