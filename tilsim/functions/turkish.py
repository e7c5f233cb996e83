"""The same functions under Turkish names and with Turkish names of axes.

String functions mirror :mod:`tilsim.functions.grammar`; ``register`` puts both the string
functions and the Column functions into a session for SQL.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tilsim.functions import analysis as _a
from tilsim.functions import grammar as _g

_NAMES = {
    "kip": dict(zip("şimdiki geçmiş gelecek geniş duyulan dilek gereklilik istek emir ulaç ortaç".split(), "pres past fut aorist evid cond necess opt imp conv_arak part_dik".split(), strict=True)),
    "kişi": {f"{n}{t}": f"{n}{k}" for n in "123" for t, k in (("tekil", "sg"), ("çoğul", "pl"))},
    "birleşik": dict(p.split("-") for p in "hikâye-hikaye hikaye-hikaye rivayet-rivayet şart-sart iken-ken".split()),
    "tasvir": dict(zip("tezlik sürerlik gelerlik kalma yaklaşma".split(), "iver adur agel akal ayaz".split(), strict=True)),
    "çatı": {"ettirgen": "caus", "edilgen": "pass", "dönüşlü": "refl", "işteş": "recip"},
    "sayı": {"tekil": "sg", "çoğul": "pl"},
    "durum": dict(zip("yalın belirtme yönelme bulunma ayrılma tamlayan vasıta".split(), "nom acc dat loc abl gen ins".split(), strict=True)),
    "ulaç": {**{k: k for k in _g.CONVERBS}, "dıkça": "dikce", "dikçe": "dikce", "ınca": "inca", "maksızın": "meksizin"},
    "fiilimsi": {**{k: k for k in _g.PARTICIPLES}, "ış": "is", "iş": "is"},
}


def _to(axis: str, value):
    if value is None or value in _NAMES[axis].values():
        return value
    key = _g.tr_lower(value)
    if key not in _NAMES[axis]:
        raise ValueError(f"bilinmeyen {axis}: {value}")
    return _NAMES[axis][key]


def _verb(kip, kişi, olumsuz, yeterlik, soru, birleşik, tasvir=None, çatı=None) -> dict:
    chain = [_to("çatı", v) for v in ([çatı] if isinstance(çatı, str) else çatı or ())]
    return {"tense": _to("kip", kip), "person": _to("kişi", kişi), "negative": olumsuz, "ability": yeterlik, "question": soru, "aux": _to("birleşik", birleşik), "aspect": _to("tasvir", tasvir), "voice_chain": chain}


def çekimle(fiil, kip, kişi=None, *, olumsuz=False, yeterlik=False, soru=False, birleşik=None, tasvir=None, çatı=None):
    return _g.conjugate(fiil, **_verb(kip, kişi, olumsuz, yeterlik, soru, birleşik, tasvir, çatı))


def son_kelimeyi_çek(fiil, kip, kişi=None, *, olumsuz=False, yeterlik=False, soru=False, birleşik=None):
    return çekimle(fiil, kip, kişi, olumsuz=olumsuz, yeterlik=yeterlik, soru=soru, birleşik=birleşik)


def _core(sayı, iyelik, durum) -> dict:
    return {"number": _to("sayı", sayı), "possessive": _to("kişi", iyelik), "case": _to("durum", durum)}


def ad_çekimle(ad, *, sayı="tekil", iyelik=None, durum="yalın"):
    return _g.decline(ad, **_core(sayı, iyelik, durum))


def yüklem(ad, *, kişi="3tekil", sayı="tekil", iyelik=None, durum="yalın"):
    given = {k: v for k, v in _core(sayı, iyelik, durum).items() if v not in (None, "sg", "nom")}
    return _g.predicative(ad, person=_to("kişi", kişi), **given)


def ekfiil(ad, birleşik=None, kişi="3tekil", *, durum=None, iyelik=None, sayı="tekil", soru=False):
    return _g.copula(ad, _to("birleşik", birleşik), _to("kişi", kişi), case=_to("durum", durum), possessive=_to("kişi", iyelik), number=_to("sayı", sayı), question=soru)


def ki_ekle(ad, *, durum="bulunma", iyelik=None, sayı="tekil"):
    return _g.with_ki(ad, **_core(sayı, iyelik, durum))


def ulaç(fiil, tür):
    return _g.converb(fiil, _to("ulaç", tür))


def fiilimsi(fiil, tür, *, iyelik=None, durum=None):
    return _g.participle(fiil, _to("fiilimsi", tür), possessive=_to("kişi", iyelik), case=_to("durum", durum))


def gibilik(fiil, *, taban="geniş", olumsuz=False):
    return _g.converb_casina(fiil, base=_to("kip", taban), negative=olumsuz)


def iken(fiil, *, taban="geniş", olumsuz=False):
    return _g.converb_ken(fiil, base=_to("kip", taban), negative=olumsuz)


def birleşik_çekim(fiil, taban, birleşik, kişi="3tekil", *, olumsuz=False):
    return _g.compound(fiil, _to("kip", taban), _to("birleşik", birleşik), _to("kişi", kişi), negative=olumsuz)


def türet(kelime, tür):
    return _g.derivations(kelime, {"isim": "noun", "ad": "noun", "fiil": "verb"}.get(tür, tür))


def çözümle(yüzey, tür=None, *, kökler=None):
    """Readings as dictionaries with Turkish keys; their chains are left out."""
    pos = {"fiil": "verb", "isim": "noun", "ad": "noun", "sıfat": "adj", "sayı": "num", "bağlaç": "conj", "edat": "postp"}.get(tür, tür)
    found = _a.analyze(yüzey, pos, roots=kökler)
    return [{"sözlük_biçimi": r.lemma, "tür": r.pos, "çözüm": r.kind, "eksenler": dict(r.axes), "parçalar": list(r.parts), "varsayımsal": r.hypothetical} for r in found]


def cumle_uret(ozne, yuklem, *, kip="şimdiki", olumsuz=False, soru=False):
    return _g.clause(ozne, yuklem, tense=_to("kip", kip), negative=olumsuz, question=soru)


def isim_tamlamasi(tamlayan, tamlanan, *, tur="belirtili"):
    return _g.possessive_phrase(tamlayan, tamlanan, kind=tur)


def isim_obeği(baş, *, on_sifatlar=(), tamlayan=None, miktar=None, durum="yalın", iyelik=None):
    return _g.noun_phrase(baş, adjectives=on_sifatlar, owner=tamlayan, quantity=miktar, case=_to("durum", durum), possessive=_to("kişi", iyelik))


def derece_obeği(baş, *, derece=None):
    return _g.degree_phrase(baş, degree=derece)


#: Names that take the same arguments.
çekim_tablosu, ad_çekim_tablosu, fiil_çöz, ad_çöz, eşitlik = _g.paradigm, _g.paradigm_noun, _g.verb, _g.noun, _g.equative
yoğunlaştır, küçült, zarf_yap, sifat_tamlamasi = _g.intensify, _g.diminutive, _g.adverb, _g.adjective_phrase
sıralı, dağıtımlı, edat_obeği, bağla, koordine_et, koordinasyon = _g.ordinal, _g.distributive, _g.postposition, _g.conjoin, _g.coordinate, _g.coordinate_phrase
tam_ikile, ulaç_ikile, m_ikile = _g.full_reduplicate, _g.converb_reduplicate, _g.m_reduplicate


def columns() -> dict:
    """Column functions by their Turkish names."""
    from tilsim.functions import sounds, words

    return {
        "sayıya_çevir": words.number_words, "ondalığa_çevir": words.float_words, "tarihe_çevir": words.date_words, "saate_çevir": words.time_words, "kısaltma_aç": words.expand_abbreviation,
        "normalleştir": words.normalize, "ipa": sounds.ipa, "hecele": sounds.syllables, "vurgu": sounds.stress, "vurgu_işaretle": sounds.stress_mark,
    }


def tables() -> dict:
    """Table operators by their Turkish names."""
    from tilsim.operators import entities, lemmatize, spelling, syntax

    return {
        "temel_biçim": lemmatize.lemmatize, "temel_biçim_detay": lemmatize.lemmatize, "temel_biçim_metin": lemmatize.lemmatize_text, "temel_biçim_metin_detay": lemmatize.lemmatize_text,
        "yazım_geçerli": spelling.is_valid, "öneri": spelling.suggest, "denetle": spelling.check, "özel_adlar": entities.tag,
        "cümle_çözümle": syntax.analyze_sentences,
    }


_SQL = "ad_çekimle çekimle dağıtımlı eşitlik küçült m_ikile sıralı tam_ikile ulaç ulaç_ikile yoğunlaştır zarf_yap".split()


def register(spark: SparkSession) -> list[str]:
    """Makes the one-word functions callable from SQL, as Arrow batches; impossible forms
    are null. Returns their names."""
    from pyspark.sql import functions as F

    for name in _SQL:
        spark.udf.register(name, F.arrow_udf(_batches(globals()[name], 2 if name in ("çekimle", "ulaç") else 1), "string"))
    return list(_SQL)


def _batches(func, n: int):
    import pyarrow as pa

    def one(words: pa.Array) -> pa.Array:
        return pa.array([_quiet(func, w) for w in words.to_pylist()], pa.string())

    def two(words: pa.Array, axis: pa.Array) -> pa.Array:
        return pa.array([_quiet(func, w, x) for w, x in zip(words.to_pylist(), axis.to_pylist(), strict=True)], pa.string())

    run = one if n == 1 else two
    run.__annotations__ = {**dict.fromkeys(("words", "axis")[:n], pa.Array), "return": pa.Array}
    return run


def _quiet(func, *args):
    if args[0] is None:
        return None
    try:
        return func(*args)
    except (ValueError, TypeError):
        return None
