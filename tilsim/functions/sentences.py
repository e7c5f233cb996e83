"""Elements, type and clauses of a sentence from its tokens' best readings.

Each token gets a role from closed sets and its reading; the predicate is sought from the
right; what is left is grouped into elements; clauses end at predicates and subordinators.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from tilsim.functions.analysis import INTERJECTIONS
from tilsim.functions.grammar import POSTPOSITIONS, tr_lower


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


_QUESTION = re.compile("m[ıiuü](y[ıiuü]m|s[ıiuü]n|y[ıiuü]z|s[ıiuü]n[ıiuü]z|d[ıiuü]r|l[ae]r)?")
_IF = re.compile("s[ae](m|n|k|n[ıiuü]z)?$")
_CA = re.compile("[çc][ae]$")
_COORDINATORS = _set("ama ancak fakat lakin ve veya yahut yoksa") | {"ya da"}
_POINTING = _set("bu bunlar o onlar şu şunlar")
_OBLIQUE = {f: c for c, forms in {
    "abl": "benden bizden ondan onlardan senden sizden", "acc": "beni bizi onları onu seni sizi", "dat": "bana bize ona onlara sana size",
    "gen": "benim bizim onların onun senin sizin", "loc": "bende bizde onda onlarda sende sizde",
}.items() for f in forms.split()}
_PURE = INTERJECTIONS - _set("ay be deh ey hah hay işte marş na of oh üf yaşa yazık")
_TIMES = _set("akşam akşamüstü asır bahar bugün dün gece geçmiş gelecek gün gündüz güz hafta ilkbahar kış öğle öğleüstü sabah sene sonbahar vakit yarın yaz yıl yüzyıl zaman")
_REPORTING = _set("demek düşünmek sanmak sormak söylemek ummak zannetmek")
_DEGREES = _set("az biraz böyle çok daha en epey fazla gayet oldukça öyle pek şöyle")
_NOUNS_ALL_THE_SAME = _set("çocuk memur")
_NARRATIVE = _set("aorist evid fut past pres")
_MOOD = dict(p.split("-") for p in "cond-şart imp-emir necess-gereklilik opt-istek".split())
_NOT_PREDICATE = ("SORU", "NEG", "ADP", "CONJ", "UNLEM")
_VERBAL = ("FIIL", "ULAC", "ORTAC")
_PLACED = ("abl", "dat", "loc")
_OUTSIDE = "cümle dışı unsur"
_GOVERNED = ("dolaylı tümleç", "zarf tümleci", "özne", "belirtili nesne", "belirtisiz nesne")


@dataclass(frozen=True)
class Tok:
    idx: int
    surface: str
    reading: dict | None
    role: str
    case: str | None = None
    pos: str | None = None

    @property
    def low(self) -> str:
        return tr_lower(self.surface)

    @property
    def tense(self) -> str | None:
        return self.reading["axes"].get("tense") if self.reading else None

    @property
    def conditional(self) -> bool:
        return self.tense == "cond" or self.tense == "aorist" and bool(_IF.search(self.low))


@dataclass(frozen=True)
class Element:
    label: str
    tokens: tuple[str, ...]
    head_id: int
    aliases: tuple[str, ...] = ()


def classify(idx: int, surface: str, reading: dict | None, lexicon_pos: str | None, names: frozenset[str]) -> Tok:
    low = tr_lower(surface)
    tok = lambda role, case=None, pos=None: Tok(idx, surface, reading, role, case, pos)
    if _QUESTION.fullmatch(low):
        return tok("SORU")
    if low == "değil":
        return tok("NEG")
    if low in POSTPOSITIONS:
        return tok("ADP", None, "postp")
    if low in _COORDINATORS or low in ("ki", "de", "da"):
        return tok("CONJ", None, "conj")
    if low in _POINTING:
        return tok("MOD", None, "det")
    if low in _OBLIQUE:
        return tok("AD", _OBLIQUE[low], "pron")
    if idx == 1 and low in _PURE:
        return tok("UNLEM", None, "ünlem")
    capital = surface[:1].isupper()
    if reading is None:
        return tok("ADV", None, "adv") if _CA.search(low) else tok("AD", None, "noun") if capital else tok("X")
    by_pos = {"ünlem": "UNLEM", "yansıma": "UNLEM", "conj": "CONJ", "postp": "ADP"}.get(reading["pos"])
    if by_pos:
        return tok(by_pos, None, reading["pos"])
    kind, axes = reading["kind"], reading["axes"]
    by_kind = {"conjugate": "FIIL", "converb": "ULAC", "converb_casina": "ULAC", "converb_ken": "ULAC", "participle": "ORTAC"}.get(kind)
    if by_kind:
        return tok(by_kind, None, "verb")
    case = axes.get("case")
    if kind == "copula":
        return tok("NOMPRED", case, "noun")
    noun = low in _NOUNS_ALL_THE_SAME or capital and low in names
    if case is None and not axes.get("number") and not axes.get("possessive") and not noun:
        if lexicon_pos == "adv" or _CA.search(low) and lexicon_pos != "noun":
            return tok("ADV", None, "adv")
        if lexicon_pos in ("adj", "num", "det"):
            return tok("MOD", None, lexicon_pos)
    return tok("AD", case, "noun")


def _nominal_label(case: str | None) -> tuple[str, tuple[str, ...]]:
    if case == "acc":
        return "belirtili nesne", ()
    return ("dolaylı tümleç", ("yer tamlayıcısı",)) if case in _PLACED else ("özne", ())


def label_body(body: list[Tok]) -> tuple[list[Element], bool]:
    """Elements of what isn't the predicate, and whether a dependent clause was among it."""
    out: list[Element] = []
    dependent, i = False, 0
    joined = any(t.role == "CONJ" for t in body)
    while i < len(body):
        t, before = body[i], body[i - 1] if i else None
        if t.role in ("ULAC", "ORTAC"):
            dependent, words = True, (t.surface,)
            if out and before and before.role == "AD" and before.case in (*_PLACED, "acc") and out[-1].head_id == before.idx:
                out.pop()
                words = (before.surface, t.surface)
            out.append(Element("zarf tümleci", words, t.idx))
        elif t.role == "ADV":
            out.append(Element("zarf tümleci", (t.surface,), t.idx))
        elif t.role == "FIIL":
            dependent |= t.conditional
            out.append(Element("zarf tümleci" if t.conditional else "yüklem" if t.tense in _NARRATIVE or joined else "özne", (t.surface,), t.idx))
        elif t.role in ("MOD", "AD", "NOMPRED", "X"):
            group = [t]
            while group[-1].role == "MOD" and i + len(group) < len(body) and (n := body[i + len(group)]).role in ("MOD", "AD", "X") and n.pos != "pron":
                group.append(n)
            i += len(group)
            head, words = group[-1], tuple(x.surface for x in group)
            if i < len(body) and body[i].role == "ADP":
                out.append(Element("edat tümleci", (*words, body[i].surface), body[i].idx))
                i += 1
            elif head.role == "MOD" and group[0].low in _DEGREES or head.case in _PLACED and head.reading and head.reading["lemma"] in _TIMES:
                out.append(Element("zarf tümleci", words, head.idx))
            else:
                label, aliases = _nominal_label(head.case)
                out.append(Element(label, words, head.idx, aliases))
            continue
        elif t.role == "ADP":
            if out and before and out[-1].label in _GOVERNED and out[-1].head_id == before.idx:
                out.append(Element("edat tümleci", (*out.pop().tokens, t.surface), t.idx))
            else:
                out.append(Element("edat tümleci", (t.surface,), t.idx))
        else:
            out.append(Element(_OUTSIDE, (t.surface,), t.idx))
        i += 1
    return out, dependent


def _addressed(elements: list[Element]) -> list[Element]:
    return [Element(_OUTSIDE, e.tokens, e.head_id) if e.label == "özne" else e for e in elements]


def _bare_object(elements: list[Element]) -> list[Element]:
    """Of two or more bare subjects without another verb the last is an object."""
    bare = [e for e in elements if e.label == "özne"]
    if any(e.label == "yüklem" for e in elements) or len(bare) < 2:
        return elements
    last = max(bare, key=lambda e: e.head_id)
    return [replace(e, label="belirtisiz nesne") if e is last else e for e in elements]


def _depends(t: Tok) -> bool:
    return t.role in ("ULAC", "ORTAC") or t.role == "FIIL" and t.conditional


def _predicate_of(kept: list[Tok]) -> Tok | None:
    for roles in (_VERBAL, ("NOMPRED",)):
        if found := [t for t in kept if t.role in roles]:
            return found[-1]
    rest = [t for t in kept if t.role not in _NOT_PREDICATE]
    return rest[-1] if rest else None


def clauses(toks: list[Tok], tail: int, pred: int, trailing: list[Tok]) -> list[dict]:
    """role (temel, yan or bağımsız), elements, predicate_id and connector of each clause."""
    if tail <= 0:
        return []
    joined = any(t.role == "CONJ" and t.low in _COORDINATORS for t in toks[:tail])

    def ends(k: int) -> bool:
        t = toks[k]
        return k == pred or t.role in ("ULAC", "ORTAC", "NOMPRED") or t.role == "FIIL" and (t.conditional or t.tense in _NARRATIVE or joined)

    borders = {k for k in range(tail) if ends(k)}
    borders |= {k - 1 for k in range(1, tail) if toks[k].low == "diye" or toks[k].low == "ki" and toks[k].role == "CONJ"}
    main = toks[pred]
    reported = main.reading is not None and main.reading["lemma"] in _REPORTING and pred > 0 and toks[pred - 1].role in _VERBAL
    if reported:
        borders.add(pred - 1)
    spans, start = [], 0
    for b in sorted(borders):
        spans.append((toks[start : b + 1], b))
        start = b + 1
    if start < tail:
        spans = [*spans[:-1], (spans[-1][0] + toks[start:tail], spans[-1][1])] if spans else [(toks[:tail], -1)]
    records: list[dict] = []
    after_ki = False
    for span, b in spans:
        connector, forced, kept = None, after_ki, []
        for t in span:
            if not kept and t.role == "CONJ" and t.low in _COORDINATORS:
                connector = t.surface
            elif t.low == "ki" and t.role == "CONJ":
                after_ki = True
                if not kept:
                    forced, connector = True, connector or t.surface
            elif t.low == "diye" and not kept and records:
                records[-1]["forced"] = True
                records[-1]["connector"] = records[-1]["connector"] or t.surface
            else:
                kept.append(t)
        own = toks[b] if b >= 0 else None
        if own is not None and (not any(own is t for t in kept) or own.low in ("ki", "diye")):
            own = _predicate_of(kept)
        if kept or own is not None:
            records.append({"kept": kept, "connector": connector, "forced": forced, "pred": own})
    if reported and len(records) > 1 and not (records[-1]["connector"] and tr_lower(records[-1]["connector"]) in _COORDINATORS):
        for r in records[:-1]:
            r["forced"] = True
    side = lambda r: r["forced"] or r["pred"] is not None and _depends(r["pred"])
    others = sum(r["pred"] is not None and not side(r) for r in records)
    out = []
    for r in records:
        own = r["pred"]
        elements, _ = label_body([t for t in r["kept"] if t is not own])
        if own is not None and own.role == "FIIL" and not r["forced"] and own.tense == "imp":
            elements = _addressed(elements)
        elements = _bare_object(elements)
        if own is not None:
            elements.append(Element("yüklem", (own.surface, *(t.surface for t in (trailing if r is records[-1] else []))), own.idx))
        role = "yan" if side(r) and others else "bağımsız" if others > 1 else "temel"
        out.append({"role": role, "elements": sorted(elements, key=lambda e: e.head_id), "predicate_id": own.idx if own else 0, "connector": r["connector"]})
    return out


def _type(kind="isim", place="kurallı", negative=False, question=False, mood="haber", form="basit", elliptic=True) -> dict:
    return {"yuklem_turu": kind, "yuklem_yeri": place, "olumluluk": "olumsuz" if negative else "olumlu", "soru": question, "kip": mood, "yapi": form, "eksiltili": elliptic}


def analyze(tokens: list[dict], names: frozenset[str] = frozenset()) -> dict:
    """elements, sentence_type and clauses of tokens with ``surface``, ``best`` and ``verb``
    readings (or None) and ``lexicon_pos``; quotation marks are left out."""
    tokens = [t for t in tokens if t["surface"] != '"']
    toks = [classify(i, t["surface"], t["best"], t["lexicon_pos"], names) for i, t in enumerate(tokens, 1)]
    none = {"elements": [], "clauses": []}
    if not toks:
        return {**none, "sentence_type": _type(mood=None)}
    question = any(t.role == "SORU" for t in toks)
    tail = len(toks)
    while tail and toks[tail - 1].role in ("SORU", "NEG"):
        tail -= 1
    trailing = toks[tail:]
    pred = next((k for k in range(tail - 1, -1, -1) if toks[k].role in _VERBAL), None)
    if pred is None:
        pred = next((k for k in range(tail - 1, -1, -1) if toks[k].role not in _NOT_PREDICATE), None)
    if pred is None:
        return {**none, "sentence_type": _type(question=question)}
    main = toks[pred]
    if main.reading is not None and main.reading["lemma"] in _REPORTING and pred:
        said, verb = toks[pred - 1], tokens[pred - 1]["verb"]
        if verb and said.role in ("AD", "MOD", "NOMPRED", "X") and said.case is None and verb["axes"].get("tense") in ("past", "evid", "pres", "fut"):
            toks[pred - 1] = Tok(said.idx, said.surface, verb, "FIIL", None, "verb")
    verb = tokens[pred]["verb"]
    verbal = verb is not None or main.role in _VERBAL
    told = verb or main.reading
    negative = any(t.role == "NEG" for t in trailing) or bool(told and told["axes"].get("negative")) or main.low == "yok"
    question = question or bool(told and told["axes"].get("question"))
    mood = "haber"
    if verb is not None:
        tense = verb["axes"].get("tense")
        mood = "şart" if tense == "aorist" and _IF.search(main.low) else _MOOD.get(tense, "haber")
    last = max(t.idx for t in (main, *trailing))
    body = [t for k, t in enumerate(toks) if k != pred and t.role not in ("SORU", "NEG")]
    elements, dependent = label_body(body)
    if mood == "emir":
        elements = _addressed(elements)
    elements = _bare_object(elements)
    elements.append(Element("yüklem", (main.surface, *(t.surface for t in trailing)), main.idx))
    elements.sort(key=lambda e: e.head_id)
    parts = clauses(toks, tail, pred, trailing)
    dependent = dependent or any(c["role"] == "yan" for c in parts)
    many = sum(e.label == "yüklem" for e in elements) > 1
    form = "birleşik" if dependent else ("bağlı" if any(t.role == "CONJ" for t in body) else "sıralı") if many else "basit"
    kind = _type("fiil" if verbal else "isim", "kurallı" if last == len(toks) else "devrik", negative, question, mood, form, False)
    return {"elements": elements, "sentence_type": kind, "clauses": parts}
