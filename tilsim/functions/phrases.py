"""Phrase trees of a sentence and the dependencies that follow from them.

A sentence is a row of leaves; rewriting passes group neighbours, in an order that matters:
names with their suffixes, reduplications, genitives, adjectives, nouns, participles,
postpositions, subordinate clauses, coordinations, at last the clause.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from tilsim.functions import grammar as g

CONJUNCTIONS = frozenset("ama ancak fakat ki ve veya".split())
DEGREES = frozenset("az biraz çok daha en epey fazla oldukça pek".split())
_LEAF = {"adj": "ADJ", "conj": "CCONJ", "noun": "NOUN", "num": "NUM", "postp": "ADP", "verb": "VERB"}
_IN_VP = frozenset("AdjP AdvP CoordP NOUN NP PP".split())
_JOINED = frozenset("ADJ AdjP AdvP CoordP NP".split())
_NAME_CASES = {"gen": "n?[ıiuü]n", "abl": "[dt][ae]n", "loc": "[dt][ae]", "ins": "y?l[ae]", "dat": "y?[ae]", "acc": "y?[ıiuü]"}


@dataclass(eq=False)
class Node:
    tag: str
    token: str | None = None
    reading: dict | None = None  # lemma, kind, axes
    children: list[Node] = field(default_factory=list)
    governs: list[str] | None = None

    @property
    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves] if self.children else [self]

    @property
    def surface(self) -> str:
        return " ".join(x.token for x in self.leaves)

    @property
    def leaf(self) -> bool:
        return not self.children

    def axis(self, name: str):
        return (self.reading or {}).get("axes", {}).get(name)

    def bracketed(self) -> str:
        return f"({self.tag} {self.token})" if self.leaf else f"({self.tag} {' '.join(c.bracketed() for c in self.children)})"


def _over(tag: str, *children: Node) -> Node:
    return Node(tag, children=list(children))


def leaf(token: str, reading: dict | None, lexicon_pos: str | None = None) -> Node:
    low = token.lower()
    if low in g.POSTPOSITIONS:
        tag = "ADP"
    elif low in CONJUNCTIONS:
        tag = "CCONJ"
    elif low == "diye":
        tag = "VERB"
    elif low in DEGREES:
        tag = "ADJ"
    elif reading is None:
        tag = "X"
    elif reading["kind"] == "copula":
        tag = "VERB"
    else:
        tag = "ADJ" if reading["pos"] == "noun" and lexicon_pos == "adj" else _LEAF.get(reading["pos"], "X")
    return Node(tag, token, reading)


def name_case(suffix: str) -> str | None:
    """The case that a suffix after an apostrophe marks, if just one does."""
    hits = [c for c, p in _NAME_CASES.items() if re.fullmatch(p, suffix)]
    return hits[0] if len(hits) == 1 else None


def _pairs(nodes: list[Node], join: Callable[[Node, Node, Node | None], Node | None]) -> list[Node]:
    """Left to right: two neighbours become what ``join`` makes of them, if anything."""
    out, i = [], 0
    while i < len(nodes):
        made = join(nodes[i], nodes[i + 1], nodes[i + 2] if i + 2 < len(nodes) else None) if i + 1 < len(nodes) else None
        out.append(nodes[i] if made is None else made)
        i += 1 if made is None else 2
    return out


def _listed(nodes: list[Node], fits: Callable[[Node, Node], bool], wrap: Callable[[Node], Node] = lambda n: n) -> list[Node]:
    """X (CCONJ X)+ becomes CoordP; ``fits`` compares a member with the first."""
    out, i = [], 0
    while i < len(nodes):
        first, j = nodes[i], i + 1
        group = [first]
        if fits(first, first):
            while j + 1 < len(nodes) and nodes[j].tag == "CCONJ" and fits(first, nodes[j + 1]):
                group += [nodes[j], nodes[j + 1]]
                j += 2
        if len(group) > 1:
            out.append(_over("CoordP", *(n if n.tag == "CCONJ" else wrap(n) for n in group)))
            i = j
        else:
            out.append(first)
            i += 1
    return out


def _name(a: Node, b: Node, _) -> Node | None:
    if a.leaf and b.leaf and b.token.startswith("'") and len(b.token) > 1 and (case := name_case(g.tr_lower(b.token[1:]))):
        return Node("NOUN", a.token + b.token, {"lemma": a.token, "pos": "noun", "kind": "decline", "axes": {"case": case}})
    return None


def _doubled(a: Node, b: Node, after: Node | None) -> Node | None:
    same = a.leaf and b.leaf and a.tag == b.tag and a.tag in ("VERB", "ADJ", "NOUN") and g.tr_lower(a.token) == g.tr_lower(b.token)
    return _over("AdvP", a, b) if same and (a.tag == "VERB" or after is None or after.tag != "NOUN") else None


def _m_doubled(a: Node, b: Node, _) -> Node | None:
    if a.leaf and b.leaf and a.tag in ("NOUN", "ADJ"):
        x, y = g.tr_lower(a.token), g.tr_lower(b.token)
        if x and x[0] != "m" and g.m_reduplicate(x) == f"{x} {y}":
            return _over("NP" if a.tag == "NOUN" else "AdjP", a, Node("MRED", b.token))
    return None


def _genitive(n: Node) -> bool:
    return n.leaf and n.tag == "NOUN" and n.axis("case") == "gen"


def _owner(n: Node) -> bool:
    if n.tag != "CoordP" or n.leaf:
        return _genitive(n)
    members = [c for c in n.children if c.tag != "CCONJ"]
    return all(_genitive(c.children[0] if c.tag == "NP" and not c.leaf else c) for c in members)


def _nouns(nodes: list[Node]) -> list[Node]:
    """(ADJ | NUM | AdjP | CoordP)* NOUN becomes NP."""
    out: list[Node] = []
    for n in nodes:
        if n.tag == "NOUN" and n.leaf:
            group = [n]
            while out and out[-1].tag in ("ADJ", "NUM", "AdjP", "CoordP"):
                group.insert(0, out.pop())
            n = _over("NP", *group)
        out.append(n)
    return out


def _adjectives(nodes: list[Node]) -> list[Node]:
    out: list[Node] = []
    run: list[Node] = []
    for n in [*nodes, None]:
        if n is not None and n.tag == "ADJ":
            run.append(n)
            continue
        out += [_over("AdjP", *run)] if len(run) > 1 else run
        run = []
        if n is not None:
            out.append(n)
    return out


def _with_postposition(a: Node, b: Node, _) -> Node | None:
    if a.tag in ("NP", "NOUN") and b.tag == "ADP":
        made = _over("PP", _over("NP", a) if a.leaf else a, b)
        known = g.POSTPOSITIONS.get(b.surface.lower())
        made.governs = known[1].split() if known else None
        return made
    return None


def _that_clause(nodes: list[Node]) -> list[Node]:
    for i, n in enumerate(nodes):
        if i and n.leaf and n.tag == "CCONJ" and n.token.lower() == "ki":
            tag = {"VERB": "CompP", "VP": "CompP", "S": "CompP", "NP": "RelP"}.get(nodes[i - 1].tag)
            if tag:
                return [*nodes[: i - 1], _over(tag, *nodes[i - 1 :])]
    return nodes


def _said_clause(nodes: list[Node]) -> list[Node]:
    for i, n in enumerate(nodes):
        if i and n.leaf and n.tag == "VERB" and n.token.lower() == "diye":
            return [_over("DiyeP", *nodes[: i + 1]), *nodes[i + 1 :]]
    return nodes


def _nominative(n: Node) -> bool:
    if n.leaf:
        return n.reading is None or n.axis("case") in (None, "nom")
    for c in reversed(n.children):
        if c.leaf and c.tag == "NOUN" or c.tag == "NP" and not c.leaf:
            return _nominative(c)
    return True


def _clause(nodes: list[Node]) -> list[Node]:
    at = max((i for i, n in enumerate(nodes) if n.tag in ("VERB", "VP")), default=None)
    if at is None or not nodes[at].leaf:
        return nodes
    first = at
    while first and nodes[first - 1].tag in _IN_VP and not (nodes[first - 1].tag in ("NP", "NOUN") and _nominative(nodes[first - 1])):
        first -= 1
    inside = [_over("NP", n) if n.leaf and n.tag == "NOUN" else n for n in nodes[first:at]]
    return [_over("S", *nodes[:first], _over("VP", *inside, nodes[at]))]


def parse(leaves: list[Node]) -> Node:
    """The tree over the leaves; S where more than one phrase is left."""
    nodes = _pairs(list(leaves), _name)
    nodes = _pairs(nodes, _doubled)
    nodes = _pairs(nodes, _m_doubled)
    nodes = _listed(nodes, lambda _, n: _genitive(n), lambda n: _over("NP", n))
    nodes = _pairs(nodes, lambda a, b, _: _over("NP", a, b) if _owner(a) and b.tag in ("NOUN", "NP") else None)
    nodes = _adjectives(nodes)
    nodes = _listed(nodes, lambda _, n: n.tag in ("ADJ", "AdjP"))
    nodes = _nouns(nodes)
    nodes = _pairs(nodes, lambda a, b, _: _over("NP", a, b) if a.leaf and a.tag == "VERB" and (a.reading or {}).get("kind") == "participle" and b.tag in ("NOUN", "NP") else None)
    nodes = _pairs(nodes, _with_postposition)
    nodes = _said_clause(_that_clause(nodes))
    nodes = _listed(nodes, lambda first, n: n.tag == ("NP" if first.tag == "CoordP" and n is not first else first.tag) and first.tag in ("NP", "AdjP", "AdvP", "CoordP"))
    nodes = _clause(nodes)
    nodes = [_over("VP", n) if n.leaf and n.tag == "VERB" else n for n in nodes]
    return nodes[0] if len(nodes) == 1 and not nodes[0].leaf else _over("S", *nodes)


def flat(tree: Node) -> list[dict]:
    """Rows of the tree in depth-first order; the root's parent is null."""
    out: list[dict] = []

    def walk(n: Node, parent: int | None, place: int) -> None:
        me = len(out)
        out.append({"node_id": me, "parent_id": parent, "ord": place, "tag": n.tag, "surface": n.surface, "governs": n.governs})
        for k, c in enumerate(n.children):
            walk(c, me, k)

    walk(tree, None, 0)
    return out


# Dependencies.


def _head(n: Node) -> Node:
    if n.leaf:
        return n
    kids = n.children
    if n.tag == "NP":
        nouns = [c for c in kids if c.leaf and c.tag == "NOUN"]
        owned = [c for c in nouns if c.axis("possessive")]
        if nouns:
            return (owned or nouns)[-1]
    elif n.tag in ("VP", "S"):
        for pick in ([c for c in kids if c.leaf and c.tag == "VERB"], [c for c in kids if not c.leaf and c.tag == "VP"]):
            if pick:
                return _head(pick[0])
        return _head(kids[-1])
    elif n.tag == "PP":
        return next((c for c in kids if c.leaf and c.tag == "ADP"), None) or _head(kids[-1])
    elif n.tag == "AdjP":
        if last := [c for c in kids if c.leaf and c.tag == "ADJ"]:
            return last[-1]
    elif n.tag in ("AdvP", "CoordP"):
        return _head(kids[0])
    return _head(([c for c in kids if c.tag != "MRED"] or kids)[-1])


def _relation(parent: str, n: Node) -> str:
    if n.tag == "MRED" or parent == "AdvP":
        return "compound:redup"
    members = [c for c in n.children if c.tag != "CCONJ"] if n.tag == "CoordP" else []
    case = _head(n).axis("case")
    if parent == "NP":
        if n.tag in ("ADJ", "AdjP") or members and members[0].tag in ("ADJ", "AdjP"):
            return "amod"
        if n.tag == "NUM":
            return "nummod"
        if n.tag in ("NP", "NOUN") or members and members[0].tag in ("NP", "NOUN"):
            return "nmod:poss" if case == "gen" else "nmod"
    elif parent == "PP" and n.tag in ("NP", "NOUN"):
        return "nmod"
    elif parent == "AdjP" and n.tag == "ADJ":
        return "advmod"
    elif parent == "CoordP":
        return "cc" if n.tag == "CCONJ" else "conj" if n.tag in _JOINED else "dep"
    elif parent in ("VP", "S"):
        if n.tag in ("AdjP", "AdvP") or members and members[0].tag in ("AdjP", "AdvP"):
            return "advmod"
        if n.tag in ("NP", "NOUN", "CoordP"):
            return "obj" if case == "acc" else "obl" if case in ("dat", "loc", "abl", "ins") else "nsubj"
        if n.tag == "PP":
            return "obl"
    return "dep"


def features(reading: dict | None, upos: str) -> str:
    """Universal features in the order of their names, _ for none."""
    if reading is None:
        return "_"
    axes, kind, f = reading["axes"], reading["kind"], {}
    case, person, owner, tense = (axes.get(k) for k in ("case", "person", "possessive", "tense"))
    nominal = upos in ("NOUN", "NUM")
    if case in ("acc", "dat", "gen", "abl", "loc", "ins"):
        f["Case"] = case.capitalize()
    elif nominal and case is None:
        f["Case"] = "Nom"
    if person:
        f |= {"Number": "Plur" if person[1:] == "pl" else "Sing", "Person": person[0]}
    elif nominal:
        f["Number"] = "Sing"
    if owner:
        f |= {"Number[psor]": "Plur" if owner[1:] == "pl" else "Sing", "Person[psor]": owner[0]}
    if tense in ("past", "pres", "fut", "aorist"):
        f["Tense"] = {"aorist": "Aor"}.get(tense, tense.capitalize())
    if axes.get("negative"):
        f["Polarity"] = "Neg"
    form = "Part" if kind == "participle" else "Conv" if kind.startswith("converb") else None
    if form:
        f["VerbForm"] = form
    voices = axes.get("voice_chain") or ()
    if "pass" in voices or "caus" in voices:
        f["Voice"] = "Pass" if "pass" in voices else "Cau"
    return "|".join(f"{k}={v}" for k, v in sorted(f.items())) or "_"


def dependencies(tree: Node) -> list[dict]:
    """A row per leaf: id from 1, form, lemma, upos, xpos, feats, head (0 for the root) and
    deprel. The head of a phrase stands for it towards the head of its parent."""
    leaves = tree.leaves
    number = {id(x): i for i, x in enumerate(leaves, 1)}
    heads: dict[int, tuple[int, str]] = {}

    def under(n: Node, top: Node) -> None:
        for c in n.children:
            mine = _head(c)
            if mine is not top:
                heads[id(mine)] = (number[id(top)], _relation(n.tag, c))
            under(c, mine)

    root = _head(tree)
    heads[id(root)] = (0, "root")
    under(tree, root)
    out = []
    for i, x in enumerate(leaves, 1):
        head, relation = heads.get(id(x), (0, "root"))
        upos = x.tag
        if upos == "MRED":
            upos = leaves[head - 1].tag if head and leaves[head - 1].tag in ("NOUN", "ADJ") else "NOUN"
        r = x.reading
        out.append({"id": i, "form": x.token, "lemma": r["lemma"] if r else None, "upos": upos, "xpos": r["kind"] if r else "_", "feats": features(r, upos), "head": head, "deprel": relation, "misc": "_"})
    return out
