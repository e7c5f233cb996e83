"""Toxicity by a weighted lexicon.

Texts are folded (zero-width marks go, homoglyphs and digit substitutions become the
letters they stand for), scanned once by an Aho-Corasick automaton, and the weights of
the matches that no exception phrase covers are summed and divided by the length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms and their weights; each also matches with a plural or adverb ending.
LEXICON: dict[str, float] = {
    "idiot": 1.0, "moron": 1.0, "scum": 1.0, "imbecile": 1.0, "worthless": 0.8, "disgusting": 0.8, "pathetic": 0.8, "stupid": 0.8,
    "trash": 0.8, "loser": 0.8, "clown": 0.8, "dumbass": 1.0, "asshole": 1.0, "bastard": 1.0, "bitch": 1.0, "fuck": 1.0, "fucking": 1.0,
    "fucker": 1.0, "shit": 0.8, "bullshit": 0.8, "retard": 1.0, "degenerate": 0.6, "vermin": 0.8, "filthy animal": 1.0, "subhuman": 1.2,
    "kill yourself": 2.0, "go die": 1.5, "drop dead": 1.0, "piece of garbage": 1.0, "shut up": 0.6, "cretin": 1.0, "dimwit": 0.8,
    "halfwit": 0.8, "lowlife": 0.8, "nitwit": 0.8, "numbskull": 0.8, "scumbag": 1.0, "wanker": 1.0, "twat": 1.0,
}
#: A match that lies within one of these is no match.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "trash folder", "take out the trash", "class clown", "clown fish", "clown loach", "rodeo clown",
    "circus clown", "sore loser", "winner and loser", "the idiot by dostoevsky", "scum of the pond", "pond scum", "soap scum", "degenerate matter",
    "degenerate case", "degenerate triangle", "stupid mistake", "vermin control",
)
ENDINGS = ("", "s", "es", "ly", "ness")
#: Summed weight per 1,000 characters from which a document with LEAST_HITS matches, or
#: with matches that weigh LEAST_WEIGHT together, is toxic.
THRESHOLD = 0.45
LEAST_HITS = 2
LEAST_WEIGHT = 1.5
#: Shorter texts count as this long, so that one mild word doesn't weigh endlessly.
LEAST_CHARS = 400
UNIT = 1000.0

_SWAPS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i", "€": "e", "£": "i"}
_LOOKALIKES = dict(zip("абвгдеёкмнорстухіјѕԁԛԝһӏәαβγδεηικνορτυχωℓıłøđħŧßþðμ", "abbrдeekmhopctyxijsdqwhieabydenikvoptuxwiilodhtbpdu", strict=True))


@lru_cache(1)
def fold_table() -> dict[int, str | None]:
    """For str.translate, one character to one: marks and zero-width characters map to
    themselves here, as :func:`strip_table` has dropped them before."""
    out: dict[int, str | None] = {}
    for code in [*range(0x20, 0x3000), *range(0xFF00, 0xFFEF), *range(0x1D400, 0x1D800)]:
        ch = chr(code)
        base = unicodedata.normalize("NFKD", ch)
        base = "".join(x for x in base if not unicodedata.combining(x)).lower()
        base = "".join(_LOOKALIKES.get(x, x) for x in base)
        base = "".join(_SWAPS.get(x, x) for x in base)
        if len(base) == 1 and base != ch:
            out[code] = base
        elif ch.isspace():
            out[code] = " "
    out.update({ord(c): " " for c in "\t\n\r\v\f-_"})
    return out


@lru_cache(1)
def strip_table() -> dict[int, None]:
    return dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)])


def fold(text: str) -> tuple[str, str]:
    """The text without invisible marks, and its folded form of the same length."""
    bare = text if text.isascii() else text.translate(strip_table())
    return bare, bare.translate(fold_table())


def _written(span: str, stem: str) -> bool:
    """Whether a span that folds to the stem is the stem, plain or with some character that
    is no letter of the alphabet; with plain letters alone it may be another word."""
    return span.lower() == stem or any(not c.isalpha() or not unicodedata.name(c, "").startswith("LATIN ") for c in span)


class Matcher:
    def __init__(self, lexicon: Mapping[str, float] | None = None, exceptions: tuple[str, ...] = EXCEPTIONS, stems: tuple[tuple[str, float], ...] = ()):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for term, weight in (LEXICON if lexicon is None else lexicon).items():
            for ending in ENDINGS:
                key = fold(term + ending)[1]
                if key.strip() and (not self.auto.exists(key) or self.auto.get(key)[1] < weight):
                    self.auto.add_word(key, (len(key), float(weight), None))
        for stem, weight in stems:
            if (key := fold(stem)[1]).strip() and not self.auto.exists(key):
                self.auto.add_word(key, (len(key), float(weight), stem.lower()))
        for phrase in exceptions:
            if (key := fold(phrase)[1]).strip():
                self.auto.add_word(key, (len(key), 0.0, None))
        self.some = len(self.auto) > 0
        self.auto.make_automaton()

    def measure(self, text: str | None) -> tuple[int, float]:
        """Matches that count, and the sum of their weights. Of overlapping matches the
        longest counts, the heavier of equally long ones."""
        if not text or not self.some:
            return 0, 0.0
        bare, folded = fold(text)
        found = []
        for end, (n, weight, stem) in self.auto.iter(folded):
            start = end - n + 1
            if (start == 0 or not bare[start - 1].isalpha()) and (_written(bare[start : end + 1], stem) if stem else end + 1 == len(bare) or not bare[end + 1].isalpha()):
                found.append((n, weight, start, end))
        if not found:
            return 0, 0.0
        found.sort(key=lambda m: (-m[0], -m[1], m[2]))
        taken: list[tuple[int, int]] = []
        hits, total = 0, 0.0
        by_end: dict[int, None] = {}
        for n, weight, start, end in found:
            if any(p in by_end for p in range(start, end + 1)):
                continue
            by_end.update(dict.fromkeys(range(start, end + 1)))
            taken.append((start, end))
            if weight:
                hits, total = hits + 1, total + weight
        return hits, total


_KIND = "struct<hits:int,weight:double,score:double>"


@lru_cache(4)
def _matcher(lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...], stems: tuple[tuple[str, float], ...]) -> Matcher:
    return Matcher(dict(lexicon), exceptions, stems)


def toxicity(text: Column, lexicon: Mapping[str, float] | None = None, exceptions: tuple[str, ...] = EXCEPTIONS, stems: Sequence[tuple[str, float]] = (), threshold: float = THRESHOLD) -> Column:
    """A struct ``hits, weight, score, toxic`` per text; zeros for a null or empty text."""
    terms, stems = tuple((LEXICON if lexicon is None else lexicon).items()), tuple(stems)

    def score(texts: pa.Array) -> pa.Array:
        matcher = _matcher(terms, exceptions, stems)
        rows = [(*matcher.measure(t), len(t or "")) for t in texts.to_pylist()]
        scores = [round(UNIT * w / max(n, LEAST_CHARS), 6) for _, w, n in rows]
        toxic = [s >= threshold and (h >= LEAST_HITS or w >= LEAST_WEIGHT) for s, (h, w, _) in zip(scores, rows, strict=True)]
        columns = [pa.array([h for h, _, _ in rows], pa.int32()), pa.array([w for _, w, _ in rows], pa.float64()), pa.array(scores, pa.float64()), pa.array(toxic, pa.bool_())]
        return pa.StructArray.from_arrays(columns, ["hits", "weight", "score", "toxic"])

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "struct<hits:int,weight:double,score:double,toxic:boolean>")(text)


#: At most so many labelled rows of each class are read to learn stems.
LEARN_ROWS = 3000
#: Signed root of the likelihood ratio from which a beginning marks toxic documents.
Z = 4.5
#: Share of the toxic documents that have a beginning at least: fewer may be copies of one.
SHARE = 0.02
_STEM = (4, 11)
_WORD = re.compile(r"[^\W\d_]+")


def learn_stems(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", least: int = 5, odds: float = 3.0, z: float = Z, share: float = SHARE) -> list[tuple[str, float]]:
    """Word beginnings that mark toxic documents of any language, with their weights.

    From at most ``rows`` labelled documents of each class, picked by a hash of the id:
    beginnings of 4 to 11 letters, counted where a document has them twice or more, whose
    log odds between the classes are at least ``odds`` and whose likelihood ratio against
    equal shares has a root of at least ``z``, which holds at zero counts as well; at least
    ``least`` toxic documents and a ``share`` of them have it. The shortest such beginning stands for the longer ones; one that begins a term of the lexicon
    is left to the lexicon. Null texts, ids and labels teach nothing; of repeated ids the mean
    label rounds, a tie to 1. Without labels of both classes nothing is learnt. The ids are
    broadcast: at most 2 x ``rows``.
    """
    lab = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).dropna().groupBy("__id").agg(F.floor(F.avg("__y") + 0.5).cast("int").alias("__y"))
    order = F.md5(F.col("__id").cast("string").cast("binary"))
    picked = lab.filter("__y = 1").orderBy(order).limit(rows).unionByName(lab.filter("__y = 0").orderBy(order).limit(rows))

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean, n = Counter(), Counter(), [0, 0]
            for y, t in zip(batch["__y"].to_pylist(), batch["__t"].to_pylist(), strict=True):
                found: Counter = Counter()
                for w, times in Counter(_WORD.findall((t or "").lower())).items():
                    for k in range(_STEM[0], min(len(w), _STEM[1]) + 1):
                        found[w[:k]] += times
                (toxic if y else clean).update([w for w, times in found.items() if times > 1])
                n[y] += 1
            toxic[""], clean[""] = n[1], n[0]
            keys = list(toxic | clean)
            yield pa.RecordBatch.from_pydict({"s": pa.array(keys, pa.string()), "a": pa.array([toxic[k] for k in keys], pa.int64()), "b": pa.array([clean[k] for k in keys], pa.int64())})

    from tilsim.llm.common import materialize

    each = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t")).join(F.broadcast(picked), "__id").select("__y", "__t")
    counts = materialize(each.mapInArrow(beginnings, "s string, a bigint, b bigint").groupBy("s").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "toxic-stems")
    sizes = counts.filter("s = ''").first()
    n1, n0 = (sizes["a"], sizes["b"]) if sizes else (0, 0)
    if not n1 or not n0:
        return []
    a, b = F.col("a"), F.col("b")
    lo = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))

    def against(seen: Column, n: int) -> Column:
        """Twice the log likelihood of a share against that of both classes together."""
        both = (a + b) / float(n1 + n0)
        part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
        return 2 * (part(seen, both) + part(n - seen, 1 - both))

    found = counts.filter((F.col("s") != "") & (a >= max(least, share * n1))).withColumn("lo", lo).filter((F.col("lo") >= odds) & (F.sqrt(against(a, n1) + against(b, n0)) >= z))
    chosen: dict[str, float] = {}
    for s, value in sorted(((r["s"], r["lo"]) for r in found.select("s", "lo").collect()), key=lambda x: (len(x[0]), x[0])):
        if not any(s[:k] in chosen for k in range(_STEM[0], len(s))) and not any(t.startswith(s) for t in LEXICON):
            chosen[s] = round(min(1.0, (value - 1) / 4), 4)
    return list(chosen.items())


def score_documents(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, hits, weight, score, toxic`` for each input row, with stems learnt from
    ``labels`` if there are any.

    Null and empty texts score 0 and aren't toxic; repeated rows stay; null ids stay;
    other columns of ``docs`` are neither read nor returned. No text is shuffled.
    """
    stems = learn_stems(docs, labels, id_col=id_col, text_col=text_col) if labels is not None else []
    t = docs.select(F.col(id_col).alias("doc_id"), toxicity(F.col(text_col).cast("string"), stems=stems, threshold=threshold).alias("__t"))
    return t.select("doc_id", "__t.hits", "__t.weight", "__t.score", "__t.toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the toxic rows; columns and other rows as they are.

    Rows with a null or empty text stay, repeated rows go or stay together, null ids stay;
    an empty table gives an empty one. No text is shuffled.
    """
    stems = learn_stems(docs, labels, id_col=id_col, text_col=text_col) if labels is not None else []
    return docs.filter(~toxicity(F.col(text_col).cast("string"), stems=stems, threshold=threshold)["toxic"])
