"""Readings of a surface form: which lemma and axes give it.

A reading is confirmed by generating the form. Stems are generated first and only those
that the surface can begin with go on to tenses, persons and cases, so few forms are made.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from itertools import product

from tilsim.functions import grammar as g

KINDS = (
    *"conjugate decline copula converb converb_casina converb_ken participle with_ki".split(),
    *"intensify diminutive ordinal distributive conjunction derivation".split(),
    *(f"reduplication_{x}" for x in ("full", "converb", "m")), *"postposition interjection onomatopoeia".split(),
)
POS = tuple("verb noun adj num conj postp ünlem yansıma".split())
_LETTERS = "aeıioöuüâîû"
FINITE = g.PERSONAL
CHAINS = tuple(base + ("caus",) * n + last for base in ((), ("refl",), ("recip",)) for n in range(4) for last in ((), ("pass",)))
NUMERALS = frozenset("altı altmış beş bin bir dokuz doksan dört elli iki kırk milyar milyon on otuz sekiz seksen sıfır üç yedi yetmiş yirmi yüz trilyon".split())
INTERJECTIONS = frozenset(
    "aferin ah aman ay be bravo bre çüş deh ey eyvah eyvallah hadi hah hay haydi haydin hey hıh hişt hoppala hoşt ıh inşallah işte kışt marş maşallah na of oh oho öf pist pöh tüh üf vah vay yahu yaşa yazık".split()
)
ONOMATOPOEIA = frozenset("cık cız cik çat çıt fır fış gak gıcır gümbür güm gür hav hır hış küt me miyav mö pat patır pır şar şır şırıl tak tık tik vak vır vız zır".split()) - {"cık"}

_NEEDS = {"pres": "yor", "fut": "c[ae]", "evid": "m[ıiuü]ş", "necess": "m[ae]l[ıi]", "cond": "s[ae]", "past": "[dt][ıiuü]", "hikaye": "[dt][ıiuü]", "rivayet": "m[ıiuü]ş", "sart": "s[ae]"}
_NEEDS = {k: re.compile(p) for k, p in _NEEDS.items()}
_NEGATIVE, _ABLE = re.compile("m[aeıiuü]"), re.compile("[ae]bil|[ae]m[aeıiuü]")
_TENSE_LABEL = {"pres": "Iyor", "past": "DI", "fut": "AcAk", "aorist": "Ir", "evid": "mIş", "cond": "sA", "necess": "mAlI", "opt": "A", "imp": "imp"}
_PARTICIPLE_LABEL = {"dik": "DIk", "ma": "mA", "mak": "mAk"}


@dataclass
class Reading:
    lemma: str
    pos: str | None
    kind: str
    axes: dict
    parts: list[tuple[str, str]]
    hypothetical: bool = False
    chain: list[Reading] = field(default_factory=list)

    @property
    def order(self) -> tuple:
        """How readings of one form are sorted: fewer parts, no voice, kind, lemma, axes."""
        return (len(self.parts), bool(self.axes.get("voice_chain")), KINDS.index(self.kind), self.lemma, repr(sorted(self.axes.items())))

    @property
    def segments(self) -> list[dict]:
        out, at = [], 0
        for surface, label in self.parts:
            out.append({"surface": surface, "label": label, "start": at, "end": at + len(surface)})
            at += len(surface)
        return out


def _has_vowel(s: str) -> bool:
    return any(c in _LETTERS for c in s)


def _undone(p: str) -> Iterator[str]:
    """Roots that could stand as ``p`` before a suffix: sounds given back."""
    back = {"d": "t", "ğ": "k", "b": "p", "c": "ç"}.get(p[-1]) or ("k" if p[-2:] == "ng" else None)
    if back:
        yield p[:-1] + back
    if p[-1] in "iı":
        yield p[:-1] + "e"
    if len(p) > 1 and p[-1] == p[-2]:
        yield p[:-1]
    if len(p) > 1 and p[-1] not in _LETTERS and p[-2] not in _LETTERS and _has_vowel(p):
        for v in "ıiuü":
            yield p[:-1] + v + p[-1]


def root_candidates(token: str) -> dict[str, None]:
    """Nouns and infinitives whose forms could be ``token``, in the order they are tried."""
    out: dict[str, None] = {}
    if token in ("bana", "sana"):
        out[{"b": "ben", "s": "sen"}[token[0]]] = None
    for end in range(1, len(token) + 1):
        p = token[:end]
        if _has_vowel(p):
            for root in (p, *_undone(p)):
                if _has_vowel(root):
                    out.update(dict.fromkeys((root, root + "mak", root + "mek")))
    at = token.rfind("yor")
    if at > 1 and token[at - 1] in "ıiuü":
        out.update(dict.fromkeys(token[: at - 1] + v + ("mek" if v in "eiüö" else "mak") for v in "aeıioöuü"))
    return out


def _is_verb(lemma: str) -> bool:
    return lemma.endswith(("mak", "mek"))


def _quiet(f, *args, **kw):
    try:
        return f(*args, **kw)
    except (ValueError, KeyError, IndexError, TypeError):
        return None


# Confirming.


def _conjugations(surface: str, lemma: str, question: bool) -> Iterator[dict]:
    base = g.verb(lemma)
    if not g.last_vowel(base.root):
        return
    negatives = (False, True) if _NEGATIVE.search(surface) else (False,)
    abilities = (False, True) if _ABLE.search(surface) else (False,)
    tenses = [t for t in FINITE if t not in _NEEDS or _NEEDS[t].search(surface)]
    auxes = [a for a in (None, *g.AUX) if a is None or _NEEDS[a].search(surface)]
    for chain in CHAINS:
        voiced = _quiet(g.with_voice, base, chain)
        if voiced is None or not surface.startswith(voiced.prefix + voiced.root[:-1]):
            continue
        for aspect in (None, *(a for a in g.ASPECTS if a[1:] in surface)):
            v = voiced if aspect is None else _quiet(g.with_aspect, voiced, aspect)
            if v is None or not surface.startswith(v.prefix + v.root[:-1]):
                continue
            for tense, person, negative, able, aux in product(tenses, g.PERSONS, negatives, abilities, auxes):
                if _quiet(g._conjugate, lemma, tense, person, negative, able, question, aux, aspect, chain) == surface:
                    axes = {"tense": tense, "person": person}
                    for k, value in (("negative", negative), ("ability", able), ("question", question), ("aux", aux), ("aspect", aspect), ("voice_chain", chain)):
                        if value:
                            axes[k] = value
                    yield axes


def _nominals(surface: str, lemma: str) -> Iterator[tuple[str, dict]]:
    for number, possessive, case in product(("sg", "pl"), (None, *g.PERSONS), g.CASES):
        form = _quiet(g._decline, lemma, number, possessive, case)
        if form is not None:
            yield form, {k: v for k, v, d in (("number", number, "sg"), ("possessive", possessive, None), ("case", case, "nom")) if v != d}


def _copulas(surface: str, lemma: str, question: bool) -> Iterator[dict]:
    for form, core in _nominals(surface, lemma):
        if not surface.startswith(form[:-1]) and not surface.startswith(lemma[:-1]):
            continue
        for aux in (None, *g.AUX) if question else (None, *g.AUX, "ken"):
            for person in ("3sg",) if aux == "ken" else g.PERSONS:
                if _quiet(g.copula, lemma, aux, person, question=question, **core) == surface:
                    axes = {"aux": aux, "person": person, **core, "question": question}
                    yield {k: v for k, v in axes.items() if v and not (aux == "ken" and k == "person")}


# Parts.


def _cut(surface: str, steps: list[tuple[int, str]], start: int, root: str = "KÖK") -> list[tuple[str, str]]:
    """The root up to ``start``, then a part up to each step's place if it isn't empty."""
    out, at = [(surface[:start], root)], start
    for end, label in steps:
        if surface[at:end]:
            out.append((surface[at:end], label))
        at = end
    return out


def _verb_parts(surface: str, lemma: str, axes: dict) -> list[tuple[str, str]]:
    chain, aspect, aux = axes.get("voice_chain", ()), axes.get("aspect"), axes.get("aux")
    negative, able, tense, person = axes.get("negative", False), axes.get("ability", False), axes["tense"], axes.get("person", "3sg")
    form = lambda t, p, n=False, a=False, x=None, c=chain: g._conjugate(lemma, t, p, n, a, False, x, aspect, c)
    start = len(form("imp", "2sg", c=()))
    steps, end = [], start
    for i in range(len(chain)):
        end = len(form("imp", "2sg", c=chain[: i + 1]))
        steps.append((end, chain[i]))
    if negative or able:
        end = len(form("imp", "2sg", negative, able))
        steps.append((end, "AmA" if negative and able else "Abil" if able else "mA"))
    bare = form(tense, None, negative, able) or surface
    steps.append((len(bare), _TENSE_LABEL[tense]))
    if aux and (more := form(tense, None, negative, able, aux)) is not None:
        steps.append((len(more), aux))
    if person != "3sg":
        steps.append((len(surface), person))
    out, at = [(surface[:start], "KÖK")], start
    for i, (stop, label) in enumerate(steps):
        if surface[at:stop] or i < len(chain) or label in ("AmA", "Abil", "mA"):
            out.append((surface[at:stop], label))
        at = stop
    return out


def _noun_parts(surface: str, lemma: str, axes: dict) -> list[tuple[str, str]]:
    rest, now, out = dict(axes), g.decline(lemma, **axes), []
    for axis in ("case", "possessive", "number"):
        if axis in rest:
            value = rest.pop(axis)
            shorter = g.decline(lemma, **rest)
            if now[len(shorter) :]:
                out.append((now[len(shorter) :], "lAr" if axis == "number" else value))
            now = shorter
    return [*reversed([*out, (surface[: len(now)], "KÖK")])]


def _copula_parts(surface: str, lemma: str, axes: dict) -> list[tuple[str, str]]:
    core = {k: axes[k] for k in ("case", "possessive", "number") if k in axes}
    aux, person, question = axes.get("aux"), axes.get("person", "3sg"), axes.get("question", False)
    steps = []
    if "case" in core:
        steps.append((len(g.decline(lemma, **core)), core["case"]))
    if question:
        steps.append((len(g.copula(lemma, None, "3sg", question=True, **core)), "mI"))
    if aux:
        steps.append((len(g.copula(lemma, aux, "3sg", question=question, **core)), aux))
    if person != "3sg":
        steps.append((len(surface), person))
    return _cut(surface, steps, len(lemma))


def _root_end(lemma: str) -> int:
    return len(g.conjugate(lemma, "imp", "2sg"))


def _participle_parts(surface: str, lemma: str, axes: dict) -> list[tuple[str, str]]:
    kind, possessive = axes["ptype"], axes.get("possessive")
    steps = [(len(g.participle(lemma, kind)), _PARTICIPLE_LABEL.get(kind, kind))]
    if possessive:
        steps.append((len(g.participle(lemma, kind, possessive=possessive)), possessive))
    if "case" in axes:
        steps.append((len(surface), axes["case"]))
    return _cut(surface, steps, _root_end(lemma))


def _on_finite(surface: str, lemma: str, axes: dict, label: str) -> list[tuple[str, str]]:
    base = g.conjugate(lemma, axes["base"], None, negative=axes.get("negative", False))
    if not surface.startswith(base):
        return [(surface, "KÖK")]
    core = {"tense": axes["base"], "person": "3sg"} | ({"negative": True} if axes.get("negative") else {})
    return [*_verb_parts(base, lemma, core), (surface[len(base) :], label)]


def _ki_parts(surface: str, lemma: str, axes: dict) -> list[tuple[str, str]]:
    base = g.decline(lemma, **axes)
    return [*_noun_parts(base, lemma, axes), (surface[len(base) :], "ki")] if surface.startswith(base) else [(surface, "KÖK")]


# One token.


def _verb_readings(surface: str, lemma: str, hyp: bool) -> Iterator[Reading]:
    for axes in _conjugations(surface, lemma, False):
        yield Reading(lemma, "verb", "conjugate", axes, _verb_parts(surface, lemma, axes), hyp)
    root = g.verb(lemma).root
    if not surface.startswith(root[:-1]) or not g.last_vowel(root):
        return
    for kind in g.CONVERBS:
        if _quiet(g.converb, lemma, kind) == surface:
            yield Reading(lemma, "verb", "converb", {"kind": kind}, _cut(surface, [(len(surface), kind)], _root_end(lemma)), hyp)
    for name, make, bases, ending in (("converb_casina", g.converb_casina, ("aorist", "evid"), "cAsInA"), ("converb_ken", g.converb_ken, "aorist pres evid fut".split(), "ken")):
        if surface.endswith("ken") if ending == "ken" else re.search("[cç][ae]s[ıi]n[ae]$", surface):
            for base, negative in product(bases, (False, True)):
                if _quiet(make, lemma, base=base, negative=negative) == surface:
                    axes = {"base": base} | ({"negative": True} if negative else {})
                    yield Reading(lemma, "verb", name, axes, _on_finite(surface, lemma, axes, ending), hyp)
    seen = set()
    for kind, possessive, case in product(g.PARTICIPLES, (None, *g.PERSONS), (None, *g.CASES)):
        if _quiet(g.participle, lemma, kind, possessive=possessive, case=case) == surface:
            axes = {"ptype": kind} | {k: v for k, v in (("possessive", possessive), ("case", case)) if v not in (None, "nom")}
            if repr(axes) not in seen:
                seen.add(repr(axes))
                yield Reading(lemma, "verb", "participle", axes, _participle_parts(surface, lemma, axes), hyp)


def _noun_readings(surface: str, lemma: str, hyp: bool) -> Iterator[Reading]:
    for form, axes in _nominals(surface, lemma):
        if form == surface:
            yield Reading(lemma, "noun", "decline", axes, _noun_parts(surface, lemma, axes), hyp)
    for axes in _copulas(surface, lemma, False):
        yield Reading(lemma, "noun", "copula", axes, _copula_parts(surface, lemma, axes), hyp)
    if re.search("k[ıiuü]$", surface):
        grid = [{"case": "loc"}] if lemma in g._ROUND_KI else [{"case": c} | ({"possessive": p} if p else {}) for c in ("loc", "gen") for p in (None, "3sg")]
        for axes in grid:
            if _quiet(g.with_ki, lemma, **axes) == surface:
                yield Reading(lemma, "noun", "with_ki", axes, _ki_parts(surface, lemma, axes), hyp)


_CLASSES = {"A": "[ae]", "I": "[ıiuü]", "C": "[cç]", "D": "[dt]", "G": "[gk]"}
_ENDINGS = [(s, re.compile("".join(_CLASSES.get(c, c) for c in s.template) + ("m[ae]k" if s.makes_verb else "") + "$")) for s in g.LEXICAL]


def strip_suffix(form: str) -> Iterator[tuple[str, str, g.Suffix]]:
    """Stem, lemma and suffix of each of the 28 suffixes that ``form`` could end in."""
    for suffix, ending in _ENDINGS:
        m = ending.search(form)
        if m and m.start() > 0:
            stem = form[: m.start()]
            for s in (stem[:-1], stem) if suffix.vowel_first and stem.endswith("y") else (stem,):
                lemma = s if suffix.source == "noun" else _quiet(g.put, s, "mAk")
                if s and lemma and g.derive(lemma, suffix) == form:
                    yield s, lemma, suffix


def _derived(form: str, stem: str, lemma: str, s: g.Suffix, hyp: bool) -> Reading:
    return Reading(lemma, g.derived_pos(s), "derivation", {"suffix": s.label, "src_pos": s.source}, [(stem, "kök"), (form[len(stem) :], s.label)], hyp)


def _chains(surface: str, roots: Collection[str] | None, depth: int) -> Iterator[Reading]:
    queue, seen = deque([(surface, [], depth)]), set()
    while queue:
        now, chain, left = queue.popleft()
        if not left:
            continue
        for stem, lemma, s in strip_suffix(now):
            known = {x for r in chain for x in (r.lemma, r.lemma[:-3] if r.axes["src_pos"] == "verb" else r.lemma)}
            if stem in known or lemma in {r.lemma for r in chain}:
                continue
            leaf = _derived(now, stem, lemma, s, roots is not None and lemma not in roots)
            more = [leaf, *chain]
            if len(more) > 1 and (key := tuple(r.lemma for r in more)) not in seen:
                seen.add(key)
                parts = [leaf.parts[0], *(r.parts[1] for r in more)]
                yield Reading(lemma, leaf.pos, "derivation", dict(leaf.axes), parts, leaf.hypothetical or roots is None, more)
            queue.append((stem, more, left - 1))


def _adjective_roots(surface: str) -> dict[str, None]:
    n = len(surface)
    out = dict.fromkeys(surface[j:] for j in (2, 3, 4) if j < n)
    for k in range(2, 8):
        if k < n:
            out.update(dict.fromkeys((surface[: n - k], surface[: n - k] + "k")))
    return out


def _adjective_readings(surface: str, roots: Collection[str]) -> Iterator[Reading]:
    for lemma in _adjective_roots(surface):
        if lemma in roots:
            if _quiet(g.intensify, lemma) == surface:
                yield Reading(lemma, "adj", "intensify", {}, [(surface[: -len(lemma)], "pekiştirme"), (lemma, "kök")])
            for suffix in ("-CIk", "-ImsI", "-ImtIrak"):
                if _quiet(g.diminutive, lemma, suffix) == surface:
                    root = lemma[:-1] if lemma.endswith("k") and suffix == "-CIk" else lemma
                    yield Reading(lemma, "adj", "diminutive", {"suffix": suffix}, [(root, "kök"), (surface[len(root) :], suffix)])


def _numeral_roots(surface: str) -> Iterator[tuple[str, str]]:
    *head, last = surface.split()
    for k in range(1, len(last)):
        for root in dict.fromkeys((last[:k], last[: k - 1] + "t" if last[k - 1] == "d" else last[:k])):
            if root in NUMERALS:
                yield " ".join([*head, root]), root


def _numeral_readings(surface: str, roots: Collection[str] | None) -> Iterator[Reading]:
    for kind, make in (("ordinal", g.ordinal), ("distributive", g.distributive)):
        for lemma, root in _numeral_roots(surface):
            if (roots is None or lemma in roots) and _quiet(make, lemma) == surface:
                at = len(lemma) if " " in lemma else len(root)
                yield Reading(lemma, "num", kind, {}, [(surface[:at], "kök"), (surface[at:], kind)])


def _closed(surface: str, pos: str | None) -> Iterator[Reading]:
    if surface in ("de", "da") and pos in (None, "conj"):
        yield Reading("de", "conj", "conjunction", {}, [(surface, "conj")])
    for name, kind, words in (("postp", "postposition", g.POSTPOSITIONS), ("ünlem", "interjection", INTERJECTIONS), ("yansıma", "onomatopoeia", ONOMATOPOEIA)):
        if surface in words and pos in (None, name):
            yield Reading(surface, name, kind, {}, [(surface, "kök")])


def _distinct(readings: list[Reading]) -> list[Reading]:
    seen: dict[tuple, Reading] = {}
    for r in readings:
        seen.setdefault((r.lemma, r.pos, r.kind, repr(sorted(r.axes.items()))), r)
    return list(seen.values())


def _phrase(tokens: list[str], roots: Collection[str] | None) -> list[Reading]:
    surface, hyp, out = " ".join(tokens), roots is None, []
    known = lambda x: roots is None or x in roots
    if len(tokens) == 2:
        first, second = tokens
        if first == second:
            if known(first):
                sub = analyze(first)
                out.append(Reading(first, sub[0].pos if sub else None, "reduplication_full", {}, [(first, "kök"), (" " + second, "ikileme")], hyp))
            if roots is not None:
                for lemma in root_candidates(first):
                    if lemma in roots and _is_verb(lemma) and _quiet(g.converb_reduplicate, lemma) == surface:
                        out.append(Reading(lemma, "verb", "reduplication_converb", {}, [(first, "kök"), (" " + second, "ikileme")]))
        elif known(first) and _quiet(g.m_reduplicate, first) == surface:
            sub = analyze(first)
            out.append(Reading(first, sub[0].pos if sub else None, "reduplication_m", {}, [(first, "kök"), (" " + second, "m-ikileme")], hyp))
    if re.match("m[ıiuü]", tokens[-1]):
        for lemma in root_candidates(" ".join(tokens[:-1])):
            if known(lemma):
                if _is_verb(lemma):
                    out += [Reading(lemma, "verb", "conjugate", a, _verb_parts(surface, lemma, a), hyp) for a in _conjugations(surface, lemma, True)]
                out += [Reading(lemma, "noun", "copula", a, _copula_parts(surface, lemma, a), hyp) for a in _copulas(surface, lemma, True)]
    head = " ".join(tokens[:-1])
    for root in root_candidates(tokens[-1]):
        if _is_verb(root) and known(lemma := f"{head} {root}"):
            out += [Reading(lemma, "verb", "conjugate", a, _verb_parts(surface, lemma, a), hyp) for a in _conjugations(surface, lemma, False)]
    out += _numeral_readings(surface, roots)
    return sorted(_distinct(out), key=lambda r: r.order)


# Layers upon layers.

_VOICED = re.compile("[ıiuü][lnrşt]$")


def _stacked(token: str, form: str, core: list[Reading], extra: Callable[[Reading], dict], whole: bool) -> Iterator[Reading]:
    """Noun forms of ``form``, itself formed as ``core`` says, that give the token."""
    for made, axes in _nominals(token, form):
        if made == token and axes:
            parts = _noun_parts(token, form, axes)
            for r in core:
                yield Reading(r.lemma, r.pos, r.kind, {**r.axes, **axes} if whole else {**axes, **extra(r)}, parts, r.hypothetical, r.chain)


def _inflected_derivations(token: str, roots: Collection[str], depth: int) -> Iterator[Reading]:
    for form in root_candidates(token):
        if form != token:
            core = [_derived(form, stem, lemma, s, False) for stem, lemma, s in strip_suffix(form) if lemma in roots]
            core += [r for r in _chains(form, roots, depth) if not r.hypothetical]
            yield from _stacked(token, form, core, lambda r: {}, True) if core else ()


def _inflected_ki(token: str, roots: Collection[str]) -> Iterator[Reading]:
    for form in root_candidates(token):
        if form != token and re.search("k[ıiuü]$", form):
            core = [r for base in root_candidates(form) if base in roots for r in _noun_readings(form, base, False) if r.kind == "with_ki"]
            named = lambda r: {"ki_case": r.axes["case"]} | ({"ki_possessive": r.axes["possessive"]} if "possessive" in r.axes else {})
            yield from _stacked(token, form, core, named, False) if core else ()


def _voiced_root(stem: str, roots: Collection[str]) -> tuple[str, tuple[str, ...]] | None:
    """The verb and the voices that make a bare voiced stem."""
    found = [r for lemma in root_candidates(stem) if lemma in roots and _is_verb(lemma) for r in _verb_readings(stem, lemma, False) if r.axes.get("tense") == "imp" and r.axes.get("voice_chain")]
    best = min(found, key=lambda r: r.order, default=None)
    return best and (best.lemma, best.axes["voice_chain"])


def _voiced_derivations(token: str, roots: Collection[str]) -> Iterator[Reading]:
    for stem, _, s in strip_suffix(token):
        if s.source == "verb" and _VOICED.search(stem) and (found := _voiced_root(stem, roots)):
            axes = {"suffix": s.label, "src_pos": "verb", "voice_chain": found[1]}
            yield Reading(found[0], g.derived_pos(s), "derivation", axes, [(stem, "kök"), (token[len(stem) :], s.label)])


def _voiced_participles(token: str, roots: Collection[str]) -> Iterator[Reading]:
    for lemma in root_candidates(token):
        if _is_verb(lemma) and _VOICED.search(lemma[:-3]) and token.startswith(lemma[:-4]) and (found := _voiced_root(lemma[:-3], roots)):
            for r in _verb_readings(token, lemma, False):
                if r.kind == "participle":
                    yield Reading(found[0], "verb", "participle", {**r.axes, "voice_chain": found[1]}, r.parts)


def _derived_verbs(token: str, roots: Collection[str]) -> Iterator[Reading]:
    for lemma in root_candidates(token):
        if _is_verb(lemma) and token.startswith(lemma[:-4]):
            base = next(((b, s.label) for _, b, s in strip_suffix(lemma) if s.label in ("-lAş-", "-lAn-") and b in roots), None)
            for axes in _conjugations(token, lemma, False) if base else ():
                yield Reading(base[0], "verb", "conjugate", {**axes, "derivation": base[1]}, _verb_parts(token, lemma, axes))


def analyze(surface: str, pos: str | None = None, *, roots: Collection[str] | None = None, max_derivation_depth: int = 1) -> list[Reading]:
    """Readings in their fixed order: inflections sorted, then the other kinds as found.
    With ``roots`` only their lemmas count; without, readings are hypothetical."""
    if not isinstance(surface, str) or not surface.strip():
        raise ValueError(f"no surface form: {surface!r}")
    if pos is not None and pos not in POS:
        raise ValueError(f"unknown part of speech: {pos}")
    tokens = g.tr_lower(surface.strip()).split()
    if len(tokens) > 1:
        return _phrase(tokens, roots)
    token, hyp, out = tokens[0], roots is None, []
    for lemma in root_candidates(token):
        if roots is None or lemma in roots:
            if _is_verb(lemma) and pos in (None, "verb") and g.vowels(lemma) > 1:
                out += _verb_readings(token, lemma, hyp)
            if pos in (None, "noun"):
                out += _noun_readings(token, lemma, hyp)
    out = sorted(_distinct(out), key=lambda r: r.order)
    if roots is not None and pos in (None, "adj"):
        out += _adjective_readings(token, roots)
    out += _closed(token, pos)
    if pos in (None, "num"):
        out += _numeral_readings(token, roots)
    if pos in (None, "noun", "verb", "adj"):
        seen = set()
        for stem, lemma, s in strip_suffix(token):
            if (roots is None or lemma in roots) and (lemma, s.label) not in seen:
                seen.add((lemma, s.label))
                out.append(_derived(token, stem, lemma, s, hyp))
        if max_derivation_depth > 1:
            out += _chains(token, roots, max_derivation_depth)
    if roots is None:
        return out
    more: list[Reading] = []
    if max_derivation_depth > 1 and pos in (None, "noun", "adj"):
        more += _inflected_derivations(token, roots, max_derivation_depth)
    if pos in (None, "noun"):
        more += _inflected_ki(token, roots)
    if pos in (None, "noun", "adj"):
        more += _voiced_derivations(token, roots)
    if pos in (None, "noun", "verb", "adj"):
        more += _voiced_participles(token, roots)
    if pos in (None, "verb"):
        more += _derived_verbs(token, roots)
    seen: dict[tuple, Reading] = {}
    for r in more:
        seen.setdefault((r.lemma, r.kind, repr(sorted(r.axes.items())), tuple(x.lemma for x in r.chain)), r)
    return out + list(seen.values())


def lemma_candidates(surface: str, max_derivation_depth: int = 1) -> list[str]:
    """Every lemma whose presence among the roots could matter to :func:`analyze`: what a
    lexicon is joined with."""
    tokens = g.tr_lower((surface or "").strip()).split()
    if not tokens:
        return []
    if len(tokens) > 1:
        out = {tokens[0]: None, **root_candidates(tokens[0]), **root_candidates(" ".join(tokens[:-1]))}
        out.update(dict.fromkeys(f"{' '.join(tokens[:-1])} {r}" for r in root_candidates(tokens[-1])))
    else:
        out = {**root_candidates(tokens[0]), **_adjective_roots(tokens[0])}
        queue = deque([(tokens[0], max_derivation_depth)])
        while queue:
            form, left = queue.popleft()
            for stem, lemma, _ in strip_suffix(form) if left else ():
                out[lemma] = None
                queue.append((stem, left - 1))
    out.update(dict.fromkeys(lemma for lemma, _ in _numeral_roots(" ".join(tokens))))
    return list(out)
