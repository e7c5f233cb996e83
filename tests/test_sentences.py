"""Elements, types and clauses of sentences."""

import pytest

from tilsim.functions import analysis as a
from tilsim.functions import sentences
from tilsim.functions.grammar import tr_lower
from tilsim.operators.entities import PERSONS

LEXICON = {
    **dict.fromkeys("gitmek okumak gelmek demek sanmak oturmak konuşmak vermek almak".split(), "verb"), **dict.fromkeys("ev kitap okul hava deniz akşam çocuk ben".split(), "noun"),
    **dict.fromkeys("güzel küçük sıcak".split(), "adj"), "yarın": "adv",
}


def analyzed(text):
    toks = []
    for token in text.split():
        found = [r for r in a.analyze(token, roots=set(LEXICON)) if not r.hypothetical]
        as_dict = lambda r: r and {"lemma": r.lemma, "pos": r.pos, "kind": r.kind, "axes": r.axes}
        best = min(found, key=lambda r: (r.kind not in ("decline", "conjugate"), len(r.parts), r.order), default=None)
        verb = next((r for r in found if r.kind == "conjugate"), None)
        toks.append({"surface": token, "best": as_dict(best), "verb": as_dict(verb), "lexicon_pos": (LEXICON.get(best.lemma) if best else None) or LEXICON.get(tr_lower(token))})
    return sentences.analyze(toks, frozenset(PERSONS))


ELEMENTS = {
    "Ali kitabı okudu": ["özne Ali", "belirtili nesne kitabı", "yüklem okudu"],
    "küçük çocuk okula gitti mi": ["özne küçük çocuk", "dolaylı tümleç okula", "yüklem gitti mi"],
    "akşama eve geldi": ["zarf tümleci akşama", "dolaylı tümleç eve", "yüklem geldi"],
    "Ali gel": ["cümle dışı unsur Ali", "yüklem gel"],
    "bana göre okudu": ["edat tümleci bana göre", "yüklem okudu"],
    "çocuk kitap okudu": ["özne çocuk", "belirtisiz nesne kitap", "yüklem okudu"],
}


@pytest.mark.parametrize("text", ELEMENTS)
def test_elements(text):
    assert [f"{e.label} {' '.join(e.tokens)}" for e in analyzed(text)["elements"]] == ELEMENTS[text]


def test_types():
    kind = lambda text: analyzed(text)["sentence_type"]
    assert kind("Ali geldi")["yapi"] == "basit" and kind("Ali geldi ve Veli gitti")["yapi"] == "bağlı" and kind("Ali geldi Veli gitti")["yapi"] == "sıralı"
    assert kind("gelirse gideriz")["yapi"] == "birleşik" and kind("Ali gelmedi")["olumluluk"] == "olumsuz" and kind("geldin mi")["soru"]
    assert kind("gitti eve")["yuklem_yeri"] == "devrik" and kind("hava güzel")["yuklem_turu"] == "isim" and kind("gel")["kip"] == "emir"
    assert sentences.analyze([])["sentence_type"]["eksiltili"]


def test_clauses():
    roles = lambda text: [(c["role"], c["connector"]) for c in analyzed(text)["clauses"]]
    assert roles("Ali geldi ve Veli gitti") == [("bağımsız", None), ("bağımsız", "ve")]
    assert roles("Ali gelecek dedi") == [("yan", None), ("temel", None)]
    assert roles("gelsin diye gitti") == [("yan", "diye"), ("temel", None)]
    assert roles("okuyarak geldi") == [("yan", None), ("temel", None)]


def test_table(spark):
    from tilsim.operators import syntax

    lexicon = spark.createDataFrame(list(LEXICON.items()), "lemma string, pos string")
    texts = spark.createDataFrame([(1, "Ali kitabı okudu."), (2, "hava güzel"), (3, "")], "sent_id int, text string")
    rows = {r["sent_id"]: r for r in syntax.analyze_sentences(texts, lexicon, lexicon).collect()}
    assert set(rows) == {1, 2} and rows[2]["sentence_type"]["yuklem_turu"] == "isim"
    assert [e["label"] for e in rows[1]["elements"]][:2] == ["özne", "belirtili nesne"]
    parsed = {r["sent_id"]: r["tree"] for r in syntax.parse(texts, lexicon, lexicon).collect()}
    assert parsed[2].startswith("(")
