"""The DataFrame operators on small tables."""

import itertools
from math import exp, log

import pytest
from pyspark.sql import functions as F

from tilsim.functions import sounds, words
from tilsim.functions import grammar as g
from tilsim.operators import analyze as an
from tilsim.operators import entities, forms, hmm, lemmatize, ranking, spelling
from tilsim.sources import tables

LEXICON = [
    ("gelmek", "verb"), ("gitmek", "verb"), ("okumak", "verb"), ("görmek", "verb"), ("yazmak", "verb"), ("demek", "verb"), ("ev", "noun"), ("kitap", "noun"), ("çocuk", "noun"), ("göz", "noun"),
    ("şeker", "noun"), ("kapı", "noun"), ("yüz", "num"), ("güzel", "adj"), ("ben", "pron"), ("biz", "pron"), ("okul", "noun"), ("su", "noun"), ("gözlük", "noun"), ("araba", "noun"),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "lemma string, pos string").cache()


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_words(spark):
    for n, want in ((0, "sıfır"), (-7, "eksi yedi"), (1000, "bin"), (1_001_110, "bir milyon bin yüz on"), (999_999_999_999_999, None), (10**15, "null")):
        got = one(spark, n, "bigint", words.number_words)
        assert got is None if want == "null" else got == want if want else got.startswith("dokuz yüz doksan dokuz trilyon")
    assert one(spark, -0.0, "double", words.float_words) == "eksi sıfır virgül sıfır" and one(spark, 1e16, "double", words.float_words) is None
    assert one(spark, "42 km yol KM -3 99999999999999999999", "string", words.normalize) == "kırk iki kilometre yol KM eksi üç 99999999999999999999"
    assert one(spark, "\"Ali'nin evi,\" (dedi) ... '", "string", words.tokenize) == ['"', "Ali", "'nin", "evi", ",", '"', "(", "dedi", ")", ".", ".", ".", "'"]
    assert one(spark, "IĞDIR İzmir", "string", words.tr_lower) == "ığdır izmir" and one(spark, None, "string", words.tokenize) is None
    df = spark.createDataFrame([(5, "3", 2024), (1, "EKIM", 1999), (1, "13", 2000)], "d int, m string, y int")
    assert [r[0] for r in df.select(words.date_words(F.col("d"), F.col("m"), F.col("y"))).collect()] == ["beş Mart iki bin yirmi dört", "bir Ekim bin dokuz yüz doksan dokuz", None]


def brute_syllables(word):
    v = [i for i, c in enumerate(word) if c in "aeıioöuüâîû"]
    cuts = [0]
    for p, q in itertools.pairwise(v):
        n = q - p - 1
        cuts.append(q if n == 0 else q - 2 if n >= 3 and word[q - 2 : q] in sounds.ONSETS else q - 1)
    return [word[x:y] for x, y in itertools.pairwise([*cuts, len(word)])] if word else []


def test_syllables_against_brute_force(spark):
    import random

    rng = random.Random(5)
    some = ["".join(rng.choice("aeıobdkrstlmnşt") for _ in range(rng.randrange(0, 14))) for _ in range(400)] + ["krt", "elektronik", "kontrplak", "saat", "ekspres", "ofblendble", "akstrandblenktra"]
    rows = spark.createDataFrame([(w,) for w in some], "w string").select("w", sounds.syllables(F.col("w")).alias("s")).collect()
    assert all(r["s"] == brute_syllables(r["w"]) for r in rows)


def test_ipa_and_stress(spark):
    assert one(spark, "öğrenci dağ kelime kırk", "string", sounds.ipa) == "øːɾendʒi da kelime cɯɾk"
    assert one(spark, "İstanbul", "string", sounds.stress_mark) == "is·TAN·bul" and one(spark, "geldi", "string", sounds.stress) == 1
    df = spark.createDataFrame([("kitap",), ("göz",), ("krt",)], "w string")
    assert [tuple(r) for r in df.select(sounds.low_vowel(F.col("w")), sounds.high_vowel(F.col("w")), sounds.hardens(F.col("w"))).collect()] == [("a", "ı", True), ("e", "ü", False), (None, None, True)]


def test_forms(spark, lexicon):
    df = spark.createDataFrame([("gelmek", "past", "1sg"), ("krt", "past", "1sg"), (None, "past", "1sg")], "l string, t string, p string")
    assert [r[0] for r in df.select(forms.form("conjugate", "l", F.col("t"), F.col("p"), negative=True)).collect()] == ["gelmedim", None, None]
    with pytest.raises(ValueError):
        forms.form("decline", "l", case="x")
    verbs, nouns = lexicon.filter("pos = 'verb'"), lexicon.filter("pos = 'noun'")
    table = {(r["lemma"], r["cell_key"]): r["form"] for r in forms.paradigm(verbs).collect()}
    assert table == {(v, k): f for v, p in LEXICON if p == "verb" for k, f in g.paradigm(v).items()}
    assert forms.paradigm_noun(nouns).count() == 61 * nouns.count()
    assert forms.derivations(lexicon).filter("lemma = 'göz'").count() == 17
    counts = spark.createDataFrame([("geldim", 3), ("gelir", 2), ("evde", 4), ("xx", 9)], "surface string, n bigint")
    hits, none = forms.lemma_counts(lexicon, counts)
    assert {tuple(r) for r in hits.collect()} == {("gelmek", 5), ("ev", 4)} and none.count() == len(LEXICON) - 2


def test_analysis_of_tables(spark, lexicon):
    from tilsim.functions import analysis as a

    surfaces = ["geldim", "kitabı", "evdeki", "gözlükçü", "xyz", " ", None, "güzelce", "evde miydim", "geldim"]
    got = {r["surface"]: r["readings"] for r in an.analyze(spark.createDataFrame([(s,) for s in surfaces], "surface string"), lexicon, max_derivation_depth=2).collect()}
    roots = {w for w, _ in LEXICON}
    assert len(got) == 8
    for s, readings in got.items():
        want = a.analyze(s, roots=roots, max_derivation_depth=2) if s.strip() else []
        assert [(r["lemma"], r["kind"], r["axes_text"]) for r in readings] == [(r.lemma, r.kind, repr(sorted(r.axes.items()))) for r in want]
    parsed = an.parse_text(spark.createDataFrame([(1, "Çocuk okula gitti.")], "doc_id int, text string"), lexicon).orderBy("idx").collect()
    assert [r["token"] for r in parsed] == ["Çocuk", "okula", "gitti", "."] and [len(r["readings"]) > 0 for r in parsed] == [True, True, True, False]
    record = an.reading_rows(an.analyze(spark.createDataFrame([("geldim",)], "surface string"), lexicon)).select(an.reading_json(F.struct("lemma", "pos", "kind", "axes", "segments", "hypothetical", "chain")).alias("j")).first()["j"]
    assert record.startswith('{"schema_version":"1","lemma":"gelmek"') and '"tense":"past"' in record


def rows_of(spark, lexicon, texts):
    tokens = an.parse_text(spark.createDataFrame(list(enumerate(texts)), "sent_id int, text string"), lexicon, "sent_id")
    return tokens.select("sent_id", "idx", "token"), an.reading_rows(tokens)


def test_ranking(spark, lexicon):
    tokens, rows = rows_of(spark, lexicon, ["benim kitabın", "biz geldik", "yüz kitap"])
    freq = spark.createDataFrame([("kitap", 50), ("gelmek", 100)], "lemma string, n bigint")
    d = ranking.disambiguate(rows, ["sent_id", "idx"], freq, lexicon)
    totals = d.groupBy("sent_id", "idx").agg(F.sum("confidence").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in totals)
    ctx = ranking.rank_in_context(tokens, rows, freq=freq, pos=lexicon)
    assert ctx.count() == rows.count()
    second = ctx.filter("sent_id = 0 AND idx = 1").orderBy("rank").collect()
    assert {r["evidence"] for r in second} == {-1} and second[0]["lemma"] == "kitap"
    assert ctx.filter("sent_id = 1 AND idx = 1 AND rank = 1").first()["evidence"] == 3
    assert ctx.filter("sent_id = 2 AND idx = 1 AND rank = 1").first()["evidence"] == 3
    assert ranking.rank(rows, ["sent_id", "idx"], freq, lexicon, prefer_inflected=True).count() == rows.count()


CORPUS = [("bu", "Det"), ("ev", "Noun"), ("güzel", "Adj")], [("ev", "Noun"), ("güzel", "Noun")], [("Bu", "Pron")]


def test_hmm_against_brute_force(spark):
    tokens = spark.createDataFrame([(s, i, w, p) for s, sent in enumerate(CORPUS) for i, (w, p) in enumerate(sent)], "sent_id int, idx int, surface string, pos string")
    em, tr = hmm.emission_counts(tokens), hmm.transition_counts(tokens)
    assert {(r["pos"], r["surface"]): r["n"] for r in em.collect()}[("Noun", "ev")] == 2
    pairs = {(r["prev"], r["next"]): r["n"] for r in tr.collect()}
    assert pairs == {("<S>", "Det"): 1, ("Det", "Noun"): 1, ("Noun", "Adj"): 1, ("Adj", "</S>"): 1, ("<S>", "Noun"): 1, ("Noun", "Noun"): 1, ("Noun", "</S>"): 1, ("<S>", "Pron"): 1, ("Pron", "</S>"): 1}
    em_lp, tr_lp = hmm.log_probabilities(em, "pos"), hmm.log_probabilities(tr, "prev")
    e = {(r["pos"], r["surface"]): r["log_prob"] for r in em_lp.collect()}
    t = {(r["prev"], r["next"]): r["log_prob"] for r in tr_lp.collect()}
    s = hmm.SMOOTHING
    assert abs(e["Noun", "ev"] - log((2 + s) / (3 + 2 * s))) < 1e-12 and abs(exp(t["<S>", "Det"]) - 1 / 3) < 1e-9
    sents = {0: [("Bu", ["Pron", "Det"]), ("ev", ["Noun", "Verb"]), ("güzel", ["Noun", "Adj"])], 1: [("ev", ["Noun"]), ("x", []), ("güzel", ["Adj", "Noun"])], 2: [("yy", ["Verb", "Noun"])]}
    got = {}
    df = spark.createDataFrame([(k, i, w, c) for k, x in sents.items() for i, (w, c) in enumerate(x)], "sent_id int, idx int, surface string, candidates array<string>")
    for r in hmm.viterbi(df, em_lp, tr_lp).collect():
        got[r["sent_id"], r["idx"]] = r["pos"]
    lp = lambda table, key: table.get(key, hmm.UNKNOWN)
    for k, x in sents.items():
        best = None
        for path in itertools.product(*[c or ["</S>"] for _, c in x]):
            total = sum(lp(t, (a, b)) for a, b in itertools.pairwise(("<S>", *path, "</S>"))) + sum(lp(e, (p, w.lower())) for p, (w, _) in zip(path, x, strict=True))
            if best is None or total > best[0] + 1e-12:
                best = (total, path)
        assert tuple(got[k, i] or "</S>" for i in range(len(x))) == best[1]


def test_tags(spark):
    tags = ["hazin+Adj^DB+Noun+Zero+A3sg+Pnon+Dat", "yap+Verb+Pos^DB+Adj+PresPart", "rahatla+Verb^DB+Verb+Caus+Pos+Past+A3pl", "x", "ev+Noun+A3sg+P1sg+Loc", "de+Foo"]
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    full = [r[0] for r in df.select(hmm.parse_tag_full(F.col("t"))).collect()]
    assert [(r["lemma"], r["major_pos"]) for r in full] == [("hazin", "Noun"), ("yap", "Adj"), ("rahatla", "Verb"), ("x", "unmapped"), ("ev", "Noun"), ("de", "unmapped")]
    assert (full[2]["tense"], full[2]["person"], full[2]["number"], full[2]["voice"]) == ("past", "3pl", "pl", ["caus"]) and full[4]["possessive"] == "1sg" and full[1]["ptype"] == "pres"
    assert [r[0] for r in df.select(hmm.fine_state(F.col("t"))).collect()] == ["Noun:dat", "Adj", "Verb:past", "Noun", "Noun:loc", "Noun"]


def test_similarity_join_against_brute_force(spark, lexicon):
    import random

    rng = random.Random(2)
    typos = {"".join(rng.choice("gkeöozüuşsrıi") for _ in range(rng.randrange(1, 7))) for _ in range(60)} | {"seker", "kapi", "goz", "kiyap"}
    got = {(r["word"], r["lemma"]): r["distance"] for r in spelling.similar(spark.createDataFrame([(t,) for t in typos], "word string"), lexicon).collect()}
    want = {(t, w): d for t in typos for w, _ in LEXICON if (d := spelling.weighted_distance(t, w)) <= 2}
    assert got == want


def test_spelling(spark, lexicon):
    df = spark.createDataFrame([("seker",), ("kapi",), ("geldim",), ("goruyorum",), ("",), ("evd",)], "word string")
    got = {r["word"]: (r["is_valid"], r["suggestions"]) for r in spelling.check(df, lexicon).collect()}
    assert got["geldim"] == (True, []) and got["seker"][1][0] == "şeker" and "kapı" in got["kapi"][1] and "görüyorum" in got["goruyorum"][1] and "ev" in got["evd"][1] and got[""] == (False, [])
    with pytest.raises(ValueError):
        spelling.suggest(df, lexicon, max_suggestions=0)


def test_lemmas(spark, lexicon):
    df = spark.createDataFrame([("kitabımdan",), ("bana",), ("...",), ("sekerler",), ("geldi",)], "word string")
    got = {r["word"]: (r["lemma"], r["corrected"]) for r in lemmatize.lemmatize(df, lexicon).collect()}
    assert got["kitabımdan"] == ("kitap", False) and got["bana"] == ("ben", False) and got["..."] == (None, None) and got["geldi"][0] == "gelmek"
    texts = spark.createDataFrame([(7, "Çocuk okula gitti ."), (8, "biz geldik")], "doc_id int, text string")
    lists = {r["doc_id"]: r["lemmas"] for r in lemmatize.lemma_lists(lemmatize.lemmatize_text(texts, lexicon)).collect()}
    assert lists == {7: ["çocuk", "okul", "gitmek", None], 8: ["biz", "gelmek"]}


def test_entities(spark, lexicon):
    texts = [(1, "Mustafa Kemal Atatürk Ankara'ya gitti"), (2, "Kitap okudu Ali"), (3, "Ankara Üniversitesi ve Abajur"), (4, "Bu ev"), (5, "Kadirhan geldi")]
    got = {(r["doc_id"], r["surface"], r["type"], r["index"]) for r in entities.tag(spark.createDataFrame(texts, "doc_id int, text string"), lexicon).collect()}
    assert got == {(1, "Mustafa Kemal Atatürk", "PER", 1), (1, "Ankara", "LOC", 4), (2, "Ali", "PER", 3), (3, "Ankara Üniversitesi", "LOC", 1), (3, "Abajur", "PROPER", 4), (5, "Kadirhan", "PROPER", 1)}


def test_sources(spark, tmp_path):
    (tmp_path / "lex.tsv").write_text("ev\tnoun\ngelmek\tverb\n\nxx\nve\tconj\n", encoding="utf-8")
    lex = tables.read_lexicon(spark, str(tmp_path / "lex.tsv"))
    assert lex.count() == 3 and {r[0] for r in tables.roots(lex).collect()} == {"ev", "gelmek"} and tables.roots(lex, "conj").count() == 1
    with pytest.raises(ValueError):
        tables.roots(lex, "zzz")
    (tmp_path / "a.dict").write_text("# c\nEv\ngelmek\ndeğil [P:Verb]\n! [P:Punc]\nIşık [P:Noun]\ngüzel [P:Adj; A:x]\n", encoding="utf-8")
    (tmp_path / "b.dict").write_text("ev [P:Adv]\nfoo [P:Xyz]\n", encoding="utf-8")
    built = {tuple(r) for r in tables.build_lexicon(spark, [str(tmp_path / "a.dict"), str(tmp_path / "b.dict")]).collect()}
    assert built == {("ev", "noun"), ("gelmek", "verb"), ("ışık", "noun"), ("güzel", "adj"), ("foo", "noun")}
    (tmp_path / "c.txt").write_bytes("<DATA>\n<S>\nşu\tşu+Det\tşu+Pron\nev\tev+Noun+A3sg+Pnon+Nom\nyok\n</S>\n<S id=2>\ngel\tgel+Verb+Pos+Imp+A2sg\n</S>\n".encode("cp1254"))
    got = [(r["sent_id"], r["idx"], r["surface"], r["major_pos"]) for r in tables.read_tagged(spark, str(tmp_path / "c.txt")).orderBy("sent_id", "idx").collect()]
    assert got == [(1, 0, "şu", "Det"), (1, 1, "ev", "Noun"), (2, 0, "gel", "Verb")]
    assert tables.read_log_probs(spark, str(tmp_path / "none.tsv"), "pos", "surface").count() == 0
    (tmp_path / "f.txt").write_text("ev 3\nbad\nx y\n z  4 \n", encoding="utf-8")
    assert {tuple(r) for r in tables.read_surface_counts(spark, str(tmp_path / "f.txt")).collect()} == {("ev", 3), ("z", 4)}
    rows = spark.createDataFrame([("s1", "Ali geldi", 2, "geldi", "VERB", 0, "root"), ("s1", "Ali geldi", 1, "Ali", "PROPN", 2, "nsubj")], "sent_id string, text string, id int, form string, upos string, head int, deprel string")
    assert tables.conllu(rows).first()["conllu"] == "# sent_id = s1\n# text = Ali geldi\n1\tAli\t_\tPROPN\t_\t_\t2\tnsubj\t_\t_\n2\tgeldi\t_\tVERB\t_\t_\t0\troot\t_\t_\n"
