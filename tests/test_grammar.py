"""Forms checked by hand, and laws that all forms keep."""

import itertools

import pytest

from tilsim.functions import analysis as a
from tilsim.functions import grammar as g

VERBS = """
gelmek pres 1sg geliyorum | gitmek fut 3sg gidecek | gitmek past 1pl gittik | yemek pres 3sg yiyor | demek fut 1sg diyeceğim | okumak aorist 3sg okur
bilmek aorist 2pl bilirsiniz | yazmak aorist 3sg yazar | başlamak pres 3pl başlıyorlar | olmak necess 1sg olmalıyım | almak opt 1pl alalım | görmek imp 3sg görsün
çalışmak evid 2sg çalışmışsın | bakmak cond 3pl baksalar | tatmak pres 3sg tadıyor | ölmek aorist 3sg ölür
"""


@pytest.mark.parametrize("row", [r.split() for r in VERBS.replace("\n", "|").split("|") if r.strip()])
def test_verbs(row):
    lemma, tense, person, form = row
    assert g.conjugate(lemma, tense, person) == form


def test_axes_of_verbs():
    assert g.conjugate("gelmek", "aorist", "1sg", negative=True) == "gelmem"
    assert g.conjugate("gelmek", "past", "3sg", negative=True, ability=True) == "gelemedi"
    assert g.conjugate("gelmek", "pres", "1sg", question=True) == "geliyor muyum"
    assert g.conjugate("gelmek", "past", "2sg", question=True) == "geldin mi"
    assert g.conjugate("gelmek", "pres", "3pl", aux="hikaye") == g.compound("gelmek", "pres", "hikaye", "3pl") == "geliyorlardı"
    assert g.conjugate("yapmak", "past", "3sg", voice_chain=["caus", "pass"]) == "yaptırıldı"
    assert g.conjugate("yapmak", "past", "3sg", aspect="iver") == "yapıverdi"
    assert g.conjugate("aday olmak", "fut", "1sg") == "aday olacağım"
    assert g.conjugate("gelmek", "imp", "1sg") is None and g.conjugate("gelmek", "imp", "2sg", question=True) is None
    assert [g.converb("gitmek", k) for k in ("arak", "madan", "dikce")] == ["giderek", "gitmeden", "gittikçe"]
    assert g.participle("okumak", "dik", possessive="3sg", case="loc") == "okuduğunda"
    assert g.converb_casina("gülmek") == "gülercesine" and g.converb_ken("gelmek", base="pres") == "geliyorken"
    for bad in ({"tense": "x"}, {"tense": "past", "person": "4sg"}, {"tense": "past", "aux": "x"}, {"tense": "past", "aspect": "x"}, {"tense": "past", "voice_chain": ["x"]}):
        with pytest.raises(ValueError):
            g.conjugate("gelmek", **bad)


NOUNS = """
kitap acc kitabı | renk acc rengi | burun dat burna | hak gen hakkın | saat loc saatte | saat acc saati | şehir abl şehirden | su gen suyun | araba ins arabayla
ağaç dat ağaca | kalp acc kalbi | ben dat bana | o ins onunla | kendi acc kendini | ne gen neyin | lütuf dat lütfa | ev loc evde
"""


@pytest.mark.parametrize("row", [r.split() for r in NOUNS.replace("\n", "|").split("|") if r.strip()])
def test_nouns(row):
    assert g.decline(row[0], case=row[1]) == row[2]


def test_layers_of_nouns():
    assert g.decline("göz", number="pl", possessive="1pl", case="abl") == "gözlerimizden"
    assert g.decline("araba", possessive="3sg", case="acc") == "arabasını" and g.decline("su", possessive="1sg") == "suyum"
    assert g.decline("sen", number="pl", case="dat") == "size"
    assert g.predicative("genç", person="1sg") == "gencim" and g.copula("öğrenci", "hikaye", "1pl") == "öğrenciydik"
    assert g.copula("ev", "hikaye", "1sg", case="loc", question=True) == "evde miydim" and g.copula("hasta", "ken") == "hastayken"
    assert g.with_ki("bugün") == "bugünkü" and g.with_ki("ev") == "evdeki" and g.equative("çocuk") == "çocukça"


def test_small_generators():
    assert (g.intensify("beyaz"), g.intensify("açık"), g.intensify("yorgun")) == ("bembeyaz", "apaçık", None)
    assert (g.diminutive("küçük"), g.diminutive("yeşil", "-ImsI"), g.adverb("hafif")) == ("küçücük", "yeşilimsi", "hafifçe")
    assert (g.ordinal("yirmi dört"), g.distributive("iki")) == ("yirmi dördüncü", "ikişer")
    assert g.coordinate(["a", "b", "c"], "ve") == "a, b ve c" and g.coordinate(["su", "çay"], "ne_ne") == "ne su ne çay" and g.conjoin("okul", "de") == "okul da"
    assert g.postposition("ben", "için") == "benim için" and g.postposition("ev", "göre") == "eve göre" and g.postposition("ev", "ile", True) == "evle"
    assert g.converb_reduplicate("gitmek") == "gide gide" and g.m_reduplicate("araba") == "araba maraba"
    assert g.possessive_phrase("ev", "kapı") == "evin kapısı" and g.noun_phrase("kapı", adjectives=["büyük"], owner="ev", case="acc") == "büyük evin kapısını"
    assert g.clause("biz", "gitmek", tense="fut") == "biz gideceğiz" and g.degree_phrase("iyi", degree="en") == "en iyi"
    for call in (lambda: g.coordinate(["a"] * 3, "ne_ne"), lambda: g.m_reduplicate("masa"), lambda: g.postposition("ev", "ait"), lambda: g.ordinal(" ")):
        with pytest.raises(ValueError):
            call()


def test_table_sizes():
    assert (len(g.paradigm("gelmek")), len(g.paradigm_noun("ev")), len(g.derivations("göz", "noun")), len(g.derivations("gelmek", "verb")), len(g.LEXICAL)) == (110, 61, 17, 33, 28)
    assert g.derivations("göz", "noun", "en") is None and g.derivations("iyi", "adj") is None


@pytest.mark.parametrize("lemma", ["gitmek", "okumak", "yemek"])
def test_every_verb_form_is_read_back(lemma):
    for tense, person, negative, ability in itertools.product(g.PERSONAL, g.PERSONS, (False, True), (False, True)):
        form = g.conjugate(lemma, tense, person, negative=negative, ability=ability)
        if form is not None:
            axes = {k: v for k, v in (("tense", tense), ("person", person), ("negative", negative), ("ability", ability)) if v}
            found = [r for r in a.analyze(form, "verb", roots={lemma}) if r.kind == "conjugate" and r.axes == axes]
            assert found and form.startswith("".join(p for p, _ in found[0].parts))


@pytest.mark.parametrize("headword", ["kitap", "burun", "hak"])
def test_every_noun_form_is_read_back(headword):
    for number, possessive, case in itertools.product(("sg", "pl"), (None, *g.PERSONS), g.CASES):
        form = g.decline(headword, number=number, possessive=possessive, case=case)
        axes = {k: v for k, v, d in (("number", number, "sg"), ("possessive", possessive, None), ("case", case, "nom")) if v != d}
        assert any(r.kind == "decline" and r.axes == axes for r in a.analyze(form, "noun", roots={headword}))


def test_readings():
    one = a.analyze("okuyor", roots={"okumak"})
    assert [(r.lemma, r.kind, r.parts) for r in one] == [("okumak", "conjugate", [("oku", "KÖK"), ("yor", "Iyor")])]
    assert {r.kind for r in a.analyze("de")} >= {"conjunction"} and not a.analyze("evdeki", roots={"masa"})
    chains = a.analyze("gözlükçülük", roots={"göz"}, max_derivation_depth=3)
    assert len(chains) == 7 and sum(not r.hypothetical for r in chains) == 2
    assert [r.lemma for r in a.analyze("aday oldu", roots={"aday olmak"})] == ["aday olmak"]
    assert a.analyze("koşa koşa", roots={"koşmak"})[0].kind == "reduplication_converb"
    assert {r.kind for r in a.analyze("bembeyaz", roots={"beyaz"})} == {"intensify"} and {r.kind for r in a.analyze("birinci", roots={"bir"})} >= {"ordinal"}
    assert all(r.hypothetical for r in a.analyze("kitap") if r.kind == "decline")
    with pytest.raises(ValueError):
        a.analyze(" ")


def tree_of(text, roots, adjectives=()):
    from tilsim.functions import phrases

    leaves = []
    for token in text.split():
        found = [r for r in a.analyze(token.lstrip("'"), roots=roots) if not r.hypothetical]
        best = min(found, key=lambda r: (r.kind not in ("decline", "conjugate"), len(r.parts), r.order), default=None)
        reading = best and {"lemma": best.lemma, "pos": best.pos, "kind": best.kind, "axes": best.axes}
        leaves.append(phrases.leaf(token, reading, "adj" if best and best.lemma in adjectives else None))
    return phrases.parse(leaves)


TREES = {
    "çocuk okula gitti": "(S (NP (NOUN çocuk)) (VP (NP (NOUN okula)) (VERB gitti)))",
    "büyük ev": "(NP (ADJ büyük) (NOUN ev))",
    "evin kapısı": "(NP (NOUN evin) (NOUN kapısı))",
    "ev ve okul": "(CoordP (NP (NOUN ev)) (CCONJ ve) (NP (NOUN okul)))",
    "eve göre": "(PP (NP (NOUN eve)) (ADP göre))",
    "kapı mapı": "(NP (NOUN kapı) (MRED mapı))",
    "Ali 'nin evi": "(NP (NOUN Ali'nin) (NOUN evi))",
}


@pytest.mark.parametrize("text", TREES)
def test_trees(text):
    from tilsim.functions import phrases

    tree = tree_of(text, {"çocuk", "okul", "gitmek", "ev", "kapı", "büyük"}, {"büyük"})
    assert tree.bracketed() == TREES[text]
    rows = phrases.dependencies(tree)
    assert sum(r["head"] == 0 for r in rows) == 1 and all(0 <= r["head"] <= len(rows) and r["head"] != r["id"] for r in rows)
    nodes = phrases.flat(tree)
    assert nodes[0]["parent_id"] is None and all(n["parent_id"] < n["node_id"] for n in nodes[1:])


def test_dependencies():
    from tilsim.functions import phrases

    rows = phrases.dependencies(tree_of("çocuk okula gitti", {"çocuk", "okul", "gitmek"}))
    assert [(r["form"], r["head"], r["deprel"]) for r in rows] == [("çocuk", 3, "nsubj"), ("okula", 3, "obl"), ("gitti", 0, "root")]
    assert rows[1]["feats"] == "Case=Dat|Number=Sing" and rows[2]["feats"] == "Number=Sing|Person=3|Tense=Past"


def test_layers_upon_layers():
    first = lambda s, roots, depth=1: [(r.lemma, r.kind, r.axes) for r in a.analyze(s, roots=roots, max_derivation_depth=depth)]
    assert first("evdekiler", {"ev"}) == [("ev", "with_ki", {"number": "pl", "ki_case": "loc"})]
    assert first("yazdırıcı", {"yazmak"}) == [("yazmak", "derivation", {"suffix": "-IcI", "src_pos": "verb", "voice_chain": ("caus",)})]
    assert ("okumak", "participle", {"ptype": "mak", "voice_chain": ("caus",)}) in first("okutmak", {"okumak"})
    assert first("güzelleşti", {"güzel"}) == [("güzel", "conjugate", {"tense": "past", "person": "3sg", "derivation": "-lAş-"})]
    assert first("kitapçıdan", {"kitap"}, 2) == [("kitap", "derivation", {"suffix": "-CI", "src_pos": "noun", "case": "abl"})]
