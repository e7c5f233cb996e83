"""The tagging model: counting, log-probabilities, decoding and measuring."""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMOOTHING = 1e-9
UNKNOWN = log(SMOOTHING)
START, END = "<S>", "</S>"
_MAJOR = {**{p: p for p in "Adj Adverb Conj Det Interj Noun Num Postp Pron Prop Punc Verb".split()}, "Punct": "Punc"}
_TAGS = {
    "person": {f"A{n}{k}": f"{n}{k}" for n in "123" for k in ("sg", "pl")},
    "possessive": {f"P{n}{k}": f"{n}{k}" for n in "123" for k in ("sg", "pl")},
    "case": {c.capitalize(): c for c in "abl acc dat gen ins loc nom".split()},
    "tense": {"Aor": "aorist", "Cond": "cond", "Fut": "fut", "Imp": "imp", "Narr": "evid", "Neces": "neces", "Opt": "opt", "Past": "past", "Pres": "pres", "Prog1": "pres", "Prog2": "pres"},
    "voice": dict(zip("Caus Pass Recip Reflex".split(), "caus pass recip refl".split(), strict=True)),
    "ptype": dict(p.split(":") for p in "AorPart:aorist AsLongAs:aslong ByDoingSo:by FutPart:fut Inf1:inf1 Inf2:inf2 Inf3:inf3 Ness:ness PastPart:past PresPart:pres Since:since While:while Without:without".split()),
}


def _table(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def parse_tag(tag: Column) -> Column:
    """lemma and major part of speech of a corpus tag: that of its last derived group."""
    rest = F.when(F.instr(tag, "+") > 0, F.substr(tag, F.instr(tag, "+") + 1)).otherwise("")
    last = F.regexp_replace(F.element_at(F.split(rest, "\\^DB"), -1), "^\\++", "")
    return F.struct(F.split_part(tag, F.lit("+"), F.lit(1)).alias("lemma"), F.coalesce(_table(_MAJOR)[F.split_part(last, F.lit("+"), F.lit(1))], F.lit("unmapped")).alias("major_pos"))


def parse_tag_full(tag: Column) -> Column:
    """lemma, part of speech and axes: of each axis the last tag that names it counts, of
    voices all in order; defaults are null."""
    rest = F.when(F.instr(tag, "+") > 0, F.substr(tag, F.instr(tag, "+") + 1)).otherwise("")
    tags = F.filter(F.transform(F.split(F.replace(rest, F.lit("^DB"), F.lit("")), "\\+"), F.trim), lambda t: t != "")
    named = lambda axis: F.filter(F.transform(tags, lambda t: _table(_TAGS[axis])[t]), lambda v: v.isNotNull())
    last = lambda axis: F.element_at(F.concat(F.array(F.lit(None).cast("string")), named(axis)), -1)
    voices = named("voice")
    major = parse_tag(tag)
    return F.struct(
        major["lemma"].alias("lemma"), major["major_pos"].alias("major_pos"), last("tense").alias("tense"), last("person").alias("person"), F.when(F.array_contains(tags, "Neg"), True).alias("negative"),
        last("case").alias("case"), F.when(F.array_contains(tags, "A3pl"), "pl").alias("number"), last("possessive").alias("possessive"), F.when(F.size(voices) > 0, voices).alias("voice"), last("ptype").alias("ptype"),
    )


def fine_state(tag: Column) -> Column:
    """Verb:tense, Noun:case, or the part of speech."""
    full = parse_tag_full(tag)
    major = full["major_pos"]
    name = lambda base, axis: F.when(axis.isNotNull(), F.concat(F.lit(base + ":"), axis)).otherwise(base)
    return F.when(major == "Verb", name("Verb", full["tense"])).when(major.isin("Noun", "unmapped"), name("Noun", full["case"])).otherwise(major)


def reading_state(kind: Column, axes: Column, pos: Column) -> Column:
    """The fine state of a reading."""
    name = lambda base, axis: F.when(axis.isNotNull(), F.concat(F.lit(base + ":"), axis)).otherwise(base)
    return (
        F.when((kind.startswith("conv") | (kind == "conjugate")), name("Verb", F.coalesce(axes["tense"], axes["base"])))
        .when(kind == "participle", F.when(axes["ptype"].isin("ness", *(f"inf{i}" for i in (1, 2, 3))), name("Noun", axes["case"])).otherwise("Adj"))
        .when(kind == "decline", name("Noun", axes["case"]))
        .when(kind == "copula", "Noun")
        .otherwise(F.coalesce(_table({p: p.capitalize() for p in "adj conj num postp".split()})[pos], F.lit("Noun")))
    )


def emission_counts(tokens: DataFrame, pos: str = "pos", surface: str = "surface") -> DataFrame:
    return tokens.groupBy(F.col(pos).alias("pos"), F.lower(surface).alias("surface")).agg(F.count(F.lit(1)).alias("n"))


def transition_counts(tokens: DataFrame, sentence: str = "sent_id", idx: str = "idx", pos: str = "pos") -> DataFrame:
    """Pairs of neighbours, with a start before each sentence and an end after it."""
    w = Window.partitionBy(sentence).orderBy(idx)
    pairs = tokens.select(F.coalesce(F.lag(pos).over(w), F.lit(START)).alias("prev"), F.col(pos).alias("next"), F.lead(pos).over(w).alias("__after"))
    ends = pairs.filter("__after IS NULL").select(F.col("next").alias("prev"), F.lit(END).alias("next"))
    return pairs.select("prev", "next").unionByName(ends).groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"))


def transition_counts_of(sentences: DataFrame, codes: str, states: tuple[str, ...], sentence: str = "sent_id") -> DataFrame:
    """:func:`transition_counts` of rows that hold their tokens' states in order, each as its
    place in ``states`` (array<tinyint>). Nothing but a byte a token is shuffled, and no
    token is sorted; rows of the same sentence go side by side, as their places are equal.
    """
    lists = sentences.filter(F.size(codes) > 0).groupBy(sentence).agg(F.collect_list(codes).alias("__l"))
    longest = F.array_max(F.transform("__l", lambda x: F.size(x)))
    woven = F.flatten(F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.filter(F.transform("__l", lambda x: F.get(x, i)), lambda c: c.isNotNull())))
    line = lists.select(F.when(F.size("__l") == 1, F.get("__l", F.lit(0))).otherwise(woven).alias("__c"))
    outside = F.array(F.lit(-1).cast("tinyint"))
    pairs = line.select(F.explode(F.arrays_zip(F.concat(outside, "__c").alias("p"), F.concat("__c", outside).alias("n"))).alias("x")).groupBy("x.p", "x.n").agg(F.count(F.lit(1)).alias("n_pairs"))
    name = lambda c, other: F.when(F.col(c) < 0, other).otherwise(F.get(F.array(*map(F.lit, states)), F.col(c).cast("int")))
    return pairs.select(name("p", START).alias("prev"), name("n", END).alias("next"), F.col("n_pairs").alias("n"))


def log_probabilities(counts: DataFrame, given: str, least: int = 1, smoothing: float = SMOOTHING) -> DataFrame:
    """ln((n + s) / (sum + distinct x s)) within ``given``, after rows below ``least`` went.

    The sums of each state go to every worker, as a window would gather all its rows."""
    kept = counts.filter(F.col("n") >= least)
    sums = kept.groupBy(F.col(given).alias("__g")).agg(F.sum("n").alias("__n"), F.count(F.lit(1)).alias("__d"))
    made = kept.join(F.broadcast(sums), F.col(given).eqNullSafe(F.col("__g")))
    return made.withColumn("log_prob", F.log((F.col("n") + smoothing) / (F.col("__n") + F.col("__d") * smoothing))).drop("n", "__g", "__n", "__d")


def rank_statistical(rows: DataFrame, emission: DataFrame, key: list[str], surface: str = "surface", state: str = "state") -> DataFrame:
    """Adds ``rank`` by how likely the surface is under the reading's state; equals keep
    their order."""
    em = emission.select(F.col("pos").alias(state), F.col("surface").alias("__s"), "log_prob")
    scored = rows.withColumn("__s", F.lower(surface)).join(em, ["__s", state], "left").withColumn("log_prob", F.coalesce("log_prob", F.lit(UNKNOWN)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("log_prob").desc(), "ord"))).drop("__s")


#: Transitions go to every worker: pairs of states, whose number doesn't grow with the data.
MOST_TRANSITIONS = 1_000_000


#: Of numbers that decoding holds at once.
_HELD = 1 << 22


def _decode(starts: np.ndarray, states: np.ndarray, lps: np.ndarray, hop: np.ndarray, start: int, end: int) -> np.ndarray:
    """The state of each token, all sentences a step at a time. ``starts``: of the sentences'
    tokens; ``states`` and ``lps``: a row of candidates each, filled up with -inf;
    ``hop``: by former and next state."""
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = starts[:-1][order], lengths[order]
    back = np.zeros(states.shape, np.int32)
    before, value = np.full((len(order), 1), start), np.zeros((len(order), 1))
    last = np.zeros(len(order), np.int64)
    ends = np.searchsorted(-lengths, -np.arange(lengths[0] + 1 if len(lengths) else 1), side="left")  # longer ones than each place

    def finish(low: int, high: int) -> None:
        last[low:high] = (value[low:high] + hop[before[low:high], end]).argmax(1)

    for j in range(len(ends) - 1):
        n = ends[j]
        if n < len(before):
            finish(n, len(before))
        at = first[:n] + j
        now = states[at]
        total = value[:n, :, None] + hop[before[:n, :, None], now[:, None, :]]
        best = total.argmax(1)
        back[at] = best
        value = np.take_along_axis(total, best[:, None, :], 1)[:, 0] + lps[at]
        before = now
    finish(0, len(before))
    out = np.zeros(len(states), np.int64)
    for j in range(len(ends) - 2, -1, -1):
        n = ends[j]
        at = first[:n] + j
        out[at] = states[at, last[:n]]
        last[:n] = back[at, last[:n]]
    return out


def _merged(lines: pa.Array) -> pa.Array:
    """Tokens of the same place as one with all their candidates."""
    out = []
    for line in lines.to_pylist():
        places: dict[object, list] = {}
        for x in line:
            places.setdefault(x["i"], []).extend(zip(range(len(x["p"])), x["p"], x["lp"], strict=True))
        out.append([{"i": i, "p": [p for _, p, _ in c], "lp": [lp for *_, lp in c]} for i, all_c in places.items() for c in [sorted(all_c)]])
    return pa.array(out, lines.type)


def viterbi(tokens: DataFrame, emission: DataFrame, transition: DataFrame, sentence: str = "sent_id", idx: str = "idx", surface: str = "surface", candidates: str = "candidates") -> DataFrame:
    """``<sentence>, idx, pos``: the likeliest sequence of states through the candidates.

    ``candidates`` holds each token's states in order of first appearance; a token without
    any stands as the sentence's end and gets null. Emissions come by a join of one row a
    surface; one Arrow pass goes along all sentences of a batch at once and keeps a pointer
    back from each state, so it is linear in the tokens. Of equal paths the first stays.
    More than MOST_TRANSITIONS pairs of states are an error.
    """
    rows = transition.select("prev", "next", "log_prob").limit(MOST_TRANSITIONS + 1).collect()
    if len(rows) > MOST_TRANSITIONS:
        raise ValueError(f"more than {MOST_TRANSITIONS} transitions: these are no states of words")
    hops: dict[str, list[tuple[str, float]]] = {}
    for r in rows:
        hops.setdefault(r["prev"], []).append((r["next"], r["log_prob"]))
    cand = F.array_distinct(F.when(F.size(candidates) > 0, F.col(candidates)).otherwise(F.array(F.lit(END))))
    each = tokens.select(sentence, idx, F.lower(surface).alias("__s"), cand.alias("__p"))
    em = emission.groupBy(F.col("surface").alias("__s")).agg(F.collect_list(F.struct("pos", "log_prob")).alias("__e"))
    of = lambda p: F.coalesce(F.get(F.filter("__e", lambda e: e["pos"] == p), F.lit(0))["log_prob"], F.lit(UNKNOWN))
    each = each.join(em, "__s", "left").select(sentence, F.struct(F.col(idx).alias("i"), F.col("__p").alias("p"), F.transform("__p", of).alias("lp")).alias("x"))
    lines = each.groupBy(sentence).agg(F.array_sort(F.collect_list("x")).alias("line"))

    def walk(line: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Offsets of the sentences, and the places and states of all their tokens."""
        sizes = pc.list_value_length(line).to_numpy(zero_copy_only=False)
        if len(line) and len(flat := line.flatten()) > 1:
            i = pc.fill_null(flat.field("i").cast(pa.int64()), -1).to_numpy() if pa.types.is_integer(flat.field("i").type) else np.array(flat.field("i").to_pylist(), object)
            ends = np.cumsum(sizes)
            same = i[1:] == i[:-1]
            same[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(i))] - 1] = False
            if same.any():
                line = _merged(line)
                sizes = pc.list_value_length(line).to_numpy(zero_copy_only=False)
        flat = line.flatten()
        starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        counts = pc.list_value_length(flat.field("p")).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = flat.field("p").flatten().dictionary_encode(null_encoding="encode")
        names = [*coded.dictionary.to_pylist(), START, END]
        lps = flat.field("lp").flatten().to_numpy(zero_copy_only=False)
        codes, number = coded.indices.to_numpy(zero_copy_only=False), {x: k for k, x in reversed(list(enumerate(names)))}
        hop = np.full((len(names), len(names)), UNKNOWN)
        for a, name in enumerate(names):
            for to, lp in hops.get(name, ()):
                if to in number:
                    hop[a, number[to]] = lp
        start, end = number[START], number[END]
        most = int(counts.max(initial=1))
        wide = np.arange(most) < counts[:, None]
        found, s = np.zeros(len(counts), np.int64), 0
        begins = np.concatenate(([0], np.cumsum(counts)))
        while s < len(line):
            e = int(np.searchsorted(starts, starts[s] + max(1, _HELD // most), side="right")) - 1
            e = min(len(line), max(s + 1, min(e, s + max(1, _HELD // most**2))))
            a, b = starts[s], starts[e]
            states, values = np.zeros((b - a, most), np.int64), np.full((b - a, most), -np.inf)
            states[wide[a:b]], values[wide[a:b]] = codes[begins[a] : begins[b]], lps[begins[a] : begins[b]]
            found[a:b] = _decode(starts[s : e + 1] - a, states, values, hop, start, end)
            s = e
        said = pa.array([None if x == END else x for x in names], pa.string())
        return pa.array(starts.astype(np.int32)), flat.field("i"), said.take(pa.array(found))

    kind = lines.schema["line"].dataType.elementType["i"].dataType.simpleString()

    def run(all_lines: pa.Array) -> pa.Array:
        starts, i, pos = walk(all_lines)
        return pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([i, pos], ["i", "pos"]))

    run.__annotations__ = {"all_lines": pa.Array, "return": pa.Array}
    path = F.arrow_udf(run, f"array<struct<i:{kind},pos:string>>")
    return lines.select(sentence, F.inline(path("line"))).select(sentence, F.col("i").alias(idx), "pos")


#: Words of several classes, which the sentence decides, and lemmas of pronouns.
FUNCTION_WORDS = {
    word: tuple(classes.split())
    for classes, words in {
        "Det Num": "bir", "Adverb Adj": "az böyle çok öyle şöyle", "Adverb": "daha en hemen hep pek", "Det": "her", "Det Adj": "bazı birçok bütün tüm",
        "Adj Pron": "hangi kaç", "Pron Adj": "ne", "Pron Det": "bu o şu",
    }.items() for word in words.split()
}
PRONOUNS = tuple("ben biz bu bunlar kendi kim ne o onlar sen siz şu şunlar".split())
_OF_READINGS = {"adj": "Adj", "conj": "Conj", "num": "Num", "postp": "Postp", "verb": "Verb", "ünlem": "Interj"}
_OF_LEXICON = {"adj": "Adj", "adv": "Adverb", "conj": "Conj", "det": "Det", "interj": "Interj", "noun": "Noun", "num": "Num", "postp": "Postp", "pron": "Pron", "verb": "Verb"}


def reading_major(kind: Column, pos: Column) -> Column:
    """The part of speech of a reading: Verb for verbal kinds, Noun for a copula, else by
    its own class; Noun where that is unknown or null."""
    own = F.coalesce(_table(_OF_READINGS)[pos], F.lit("Noun"))
    return F.when(kind.isin("conjugate", "converb", "converb_casina", "converb_ken", "participle"), "Verb").when(kind == "copula", "Noun").otherwise(own)


def reading_major_lex(kind: Column, pos: Column, lexicon_pos: Column) -> Column:
    """The same, where a declined noun takes the finer class that the lexicon has for its
    lemma; ``lexicon_pos`` is null where it has none."""
    base = reading_major(kind, pos)
    return F.when((base == "Noun") & (kind == "decline"), F.coalesce(_table(_OF_LEXICON)[lexicon_pos], base)).otherwise(base)


_SEEN = "array<struct<lemma:string,kind:string,pos:string,hypothetical:boolean,major:string>>"


def with_majors(tokens: DataFrame, key: list[str], lexicon: DataFrame | None = None, readings: str = "readings") -> DataFrame:
    """Adds ``seen``: the readings (lemma, kind, pos, hypothetical) of each token with their
    part of speech, in order. ``lexicon`` (lemma, pos) refines nouns, of several classes of
    a lemma by the least; it is joined, so it may be of any size."""
    rows = tokens.select(*key, F.posexplode(readings).alias("__o", "__r")).select(*key, "__o", "__r.lemma", "__r.kind", "__r.pos", "__r.hypothetical")
    if lexicon is None:
        rows = rows.withColumn("major", reading_major(F.col("kind"), F.col("pos")))
    else:
        known = lexicon.groupBy(F.col("lemma").alias("__l")).agg(F.min("pos").alias("__lp"))
        rows = rows.join(known, F.lower("lemma") == F.col("__l"), "left").withColumn("major", reading_major_lex(F.col("kind"), F.col("pos"), F.col("__lp")))
    seen = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__o", "lemma", "kind", "pos", "hypothetical", "major"))).alias("__s"))
    made = tokens.join(seen, key, "left")
    plain = F.transform("__s", lambda x: F.struct(x["lemma"].alias("lemma"), x["kind"].alias("kind"), x["pos"].alias("pos"), x["hypothetical"].alias("hypothetical"), x["major"].alias("major")))
    return made.withColumn("seen", F.coalesce(plain, F.array()).cast(_SEEN)).drop("__s")


def _added(lemma: Column, major: Column) -> Column:
    return F.struct(lemma.alias("lemma"), F.lit("funcword").alias("kind"), F.lit("x").alias("pos"), F.lit(False).alias("hypothetical"), major.alias("major"))


def augment_function_candidates(token: Column, seen: Column) -> Column:
    """``seen`` and a candidate for each further class of a function word, then Pron where a
    declined pronoun has no such candidate yet. Only adds; null tokens add nothing."""
    low = F.lower(token)
    some = F.array().cast("array<string>")
    table = F.create_map(*(x for word, classes in FUNCTION_WORDS.items() for x in (F.lit(word), F.array(*map(F.lit, classes)))))
    have = F.transform(seen, lambda r: r["major"])
    new = F.filter(F.coalesce(table[low], some), lambda p: ~F.array_contains(have, p))
    pronouns = F.filter(seen, lambda r: (r["kind"] == "decline") & F.lower(r["lemma"]).isin(*PRONOUNS))
    more = F.when((F.size(pronouns) > 0) & ~F.array_contains(F.concat(have, new), "Pron"), F.array(_added(F.lower(F.get(pronouns, F.lit(0))["lemma"]), F.lit("Pron")))).otherwise(F.array().cast(_SEEN))
    return F.concat(seen, F.transform(new, lambda p: _added(low, p)).cast(_SEEN), more.cast(_SEEN))


def augment_oov_candidates(token: Column, seen: Column) -> Column:
    """``seen`` and Noun where no candidate is more than hypothetical."""
    none = ~F.exists(seen, lambda r: ~F.coalesce(r["hypothetical"], F.lit(False)))
    return F.when(none, F.concat(seen, F.array(_added(F.lower(token), F.lit("Noun"))).cast(_SEEN))).otherwise(seen)


def tag_three_ways(gold: DataFrame, lexicon: DataFrame, emission: DataFrame, transition: DataFrame, freq: DataFrame | None = None, lex: bool = True, function_words: bool = True, oov_noun: bool = True) -> DataFrame:
    """``sent_id, idx, token, gold, isolated, rule, hmm``: each token's part of speech by the
    first reading alone, by the rules of its context, and by :func:`viterbi`.

    ``gold`` has ``sent_id, idx, token, gold``. A token without candidates has nulls; what is
    added to the readings takes part in the HMM, and in the others where a token has nothing
    else. Punctuation of the gold is left out.
    """
    from tilsim.operators import analyze, ranking

    key = ["sent_id", "idx"]
    tokens = gold.select(*key, "token", "gold").withColumn("surface", F.regexp_replace("token", "^'", ""))
    read = tokens.join(analyze.analyze(tokens, lexicon), "surface", "left").withColumn("readings", F.coalesce("readings", F.array().cast(f"array<{analyze.READING}>"))).drop("surface")
    known = with_majors(read, key, lexicon if lex else None)
    more = F.col("seen")
    if function_words:
        more = augment_function_candidates(F.col("token"), more)
    if oov_noun:
        more = augment_oov_candidates(F.col("token"), more)
    known = known.withColumn("__more", more).withColumn("__have", F.transform("__more", lambda r: r["major"]))
    rows = analyze.reading_rows(read.select(*key, "token", "readings"))
    at = F.when(F.col("rank") == 1, F.col("ord"))
    alone = ranking.rank(rows, key, pos=lexicon).groupBy(*key).agg(F.min(at).alias("__alone"))
    ruled = ranking.rank_in_context(read.select(*key, "token"), rows, freq=freq, pos=lexicon).groupBy(*key).agg(F.min(at).alias("__ruled"))
    decoded = viterbi(known.select(*key, "token", F.col("__have").alias("candidates")), emission, transition, surface="token").withColumnRenamed("pos", "hmm")
    out = known.join(alone, key, "left").join(ruled, key, "left").join(decoded, key, "left").filter("gold != 'Punc'")
    pick = lambda c: F.coalesce(F.get("__have", F.col(c)), F.get("__have", F.lit(0)))
    return out.select(*key, "token", "gold", pick("__alone").alias("isolated"), pick("__ruled").alias("rule"), "hmm")


def evaluate_three_ways(tagged: DataFrame) -> DataFrame:
    """One row per method with :func:`evaluate`'s measures of :func:`tag_three_ways`."""
    out = None
    for method in ("isolated", "rule", "hmm"):
        one = evaluate(tagged, "gold", method).select(F.lit(method).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def compare(tagged: DataFrame) -> DataFrame:
    """Adds how the three methods differ on each token."""
    return tagged.withColumn("divergence", divergence(F.col("isolated"), F.col("hmm"), F.col("rule"), F.col("gold")))


def evaluate(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """tokens, covered (predicted at all), correct, accuracy, accuracy of the covered."""
    ok = (F.col(gold) == F.col(predicted)).cast("int")
    return rows.agg(F.count(F.lit(1)).alias("tokens"), F.count(predicted).alias("covered"), F.coalesce(F.sum(ok), F.lit(0)).alias("correct")).select("*", (F.col("correct") / F.nullif("tokens", F.lit(0))).alias("accuracy"), (F.col("correct") / F.nullif("covered", F.lit(0))).alias("covered_accuracy"))


def confusion(rows: DataFrame, gold: str = "gold", predicted: str = "predicted", most: int = 12) -> DataFrame:
    """The most frequent mistakes."""
    wrong = rows.filter(F.col(gold) != F.col(predicted)).groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))
    return wrong.orderBy(F.desc("n"), gold, predicted).limit(most)


def divergence(product: Column, hmm: Column, rule: Column, gold: Column) -> Column:
    """How three methods differ on a token: all right, all wrong, some right, or without gold."""
    right = (product == gold).cast("int") + (hmm == gold).cast("int") + (rule == gold).cast("int")
    return F.when(gold.isNull(), "no_gold").when(right == 3, "all_right").when(right == 0, "all_wrong").otherwise("some_right")
