"""The driver's query catalogue: queries over the shared tables and their SQL.

The shared tables hold no Turkish text, so queries of morphology bring a small seed of
words of their own; the others run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilsim.functions import sounds, words
from tilsim.functions import grammar as g
from tilsim.operators import analyze, entities, forms, hmm, lemmatize, ranking, spelling, syntax
from tilsim.sources import tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL of closed sets.


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _below_thousand_sql(n: str) -> str:
    ones, tens = _list(words.ONES), _list(words.TENS)
    h = f"(({n}) // 100)"
    return f"concat_ws(' ', CASE WHEN {h} = 1 THEN 'yüz' WHEN {h} > 1 THEN {ones}[{h} + 1] || ' yüz' END, nullif({tens}[(({n}) // 10) % 10 + 1], ''), nullif({ones}[({n}) % 10 + 1], ''))"


def _number_sql(n: str) -> str:
    """Whole numbers from 0 below 10^9 in words."""
    mill, thou, rest = f"((({n}) // 1000000) % 1000)", f"((({n}) // 1000) % 1000)", f"(({n}) % 1000)"
    return (
        f"CASE WHEN ({n}) = 0 THEN 'sıfır' ELSE concat_ws(' ', CASE WHEN {mill} > 0 THEN {_below_thousand_sql(mill)} || ' milyon' END, "
        f"CASE WHEN {thou} = 1 THEN 'bin' WHEN {thou} > 1 THEN {_below_thousand_sql(thou)} || ' bin' END, nullif({_below_thousand_sql(rest)}, '')) END"
    )


def _any_number_sql(n: str) -> str:
    """Whole numbers from 0 below 10^15 in words."""
    part = lambda size: f"((({n}) // {size}) % 1000)"
    scaled = ", ".join(f"CASE WHEN {part(size)} > 0 THEN {_below_thousand_sql(part(size))} || ' {name}' END" for size, name in words.SCALES)
    return f"CASE WHEN ({n}) = 0 THEN 'sıfır' ELSE concat_ws(' ', {scaled}, CASE WHEN {part(1000)} = 1 THEN 'bin' WHEN {part(1000)} > 1 THEN {_below_thousand_sql(part(1000))} || ' bin' END, nullif({_below_thousand_sql(part(1))}, '')) END"


_VOWEL = f"[{sounds.VOWELS}]"
_LAST_SQL = "regexp_extract({w}, '([aıoueiöü])[^aıoueiöü]*$', 1)"
_LOW_SQL = "translate(" + _LAST_SQL + ", 'aıoueiöü', 'aaaaeeee')"
_HIGH_SQL = "translate(" + _LAST_SQL + ", 'aıoueiöü', 'ııuuiiüü')"
_HARD_SQL = "regexp_matches({w}, '[fstkçşhp]$')"
_WORDS_SQL = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^ \\t\\n\\r]+')) AS token FROM documents"


_BLANKS_SQL = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_CHUNKS_SQL = f"SELECT doc_id, list_filter(regexp_split_to_array(text, '{_BLANKS_SQL}'), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL"
_MARKS_SQL = "[" + "".join("\\" + c if c in ".[](){}?-" else c for c in words.PUNCTUATION) + "]*"
_TOKENS_SQL = f"""WITH c AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS chunk FROM ({_CHUNKS_SQL})),
    h AS (SELECT doc_id, i, regexp_extract(chunk, '^({_MARKS_SQL})', 1) AS head, chunk FROM c),
    r AS (SELECT doc_id, i, head, substr(chunk, length(head) + 1) AS rest, regexp_extract(substr(chunk, length(head) + 1), '({_MARKS_SQL})$', 1) AS tail FROM h),
    b AS (SELECT doc_id, i, head, tail, left(rest, length(rest) - length(tail)) AS body FROM r),
    w AS (SELECT doc_id, i, head, tail, CASE WHEN strpos(body, chr(39)) > 1 THEN [left(body, strpos(body, chr(39)) - 1), CASE WHEN substr(body, strpos(body, chr(39))) = chr(39) THEN '' ELSE substr(body, strpos(body, chr(39))) END] ELSE [body] END AS words FROM b),
    t AS (SELECT doc_id, flatten(list(list_filter(string_split(head, '') || words || string_split(tail, ''), lambda x: x <> '') ORDER BY i)) AS t FROM w GROUP BY doc_id)
    SELECT doc_id, (generate_subscripts(t, 1) - 1)::INT AS pos, unnest(t) AS token FROM t"""


def _token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[^ \\t\\n\\r]+"), F.lit(0))).alias("pos", "token"))


# Tokens and numbers.


@_query(f"SELECT token, count(*) AS n FROM ({_TOKENS_SQL}) GROUP BY token ORDER BY n DESC, token LIMIT 20")
def token_counts(spark, sf_dir):
    t = _table(spark, sf_dir, "documents").select(F.explode(words.tokenize(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(20)


@_query("SELECT doc_id, (generate_subscripts(t, 1) - 1)::INT AS pos, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r]+') AS t FROM documents)")
def token_positions(spark, sf_dir):
    return _token_rows(spark, sf_dir)


@_query(_TOKENS_SQL)
def tokenize_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words.tokenize(F.col("text"))).alias("pos", "token"))




@_query(f"SELECT o_orderkey, {_number_sql('o_orderkey')} AS in_words, 'eksi ' || {_number_sql('o_orderkey + 1')} AS below FROM orders")
def number_words_orders(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", words.number_words(F.col("o_orderkey")).alias("in_words"), words.number_words(-F.col("o_orderkey") - 1).alias("below"))


@_query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN x.w = '0' THEN 'sıfır' ELSE " + _number_sql("x.w::BIGINT") + " END || ' virgül ' || "
    f"array_to_string(list_transform(string_split(x.f, ''), lambda d: {_list(('sıfır', *words.ONES[1:]))}[d::INT + 1]), ' ') AS tax_words "
    "FROM (SELECT l_orderkey, l_linenumber, split_part(l_tax::VARCHAR, '.', 1) AS w, split_part(l_tax::VARCHAR, '.', 2) AS f FROM lineitem) x"
)
def float_words_lineitem(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", words.float_words(F.col("l_tax")).alias("tax_words"))


@_query(f"SELECT o_orderkey, {_number_sql('day(o_orderdate)')} || ' ' || {_list(words.MONTHS)}[month(o_orderdate)] || ' ' || {_number_sql('year(o_orderdate)')} AS in_words FROM orders")
def date_words_orders(spark, sf_dir):
    d = F.col("o_orderdate")
    return _table(spark, sf_dir, "orders").select("o_orderkey", words.date_words(F.dayofmonth(d), F.month(d), F.year(d)).alias("in_words"))


@_query(f"SELECT event_id, CASE WHEN minute(ts) = 0 THEN {_number_sql('hour(ts)')} ELSE {_number_sql('hour(ts)')} || ' ' || {_number_sql('minute(ts)')} END AS in_words FROM events")
def time_words_events(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", words.time_words(F.hour("ts"), F.minute("ts")).alias("in_words"))


_ABBREVIATION_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in words.ABBREVIATIONS.items())


@_query(
    f"""WITH a(short, long) AS (VALUES {_ABBREVIATION_ROWS}), p AS (SELECT p_partkey, {_list([*words.ABBREVIATIONS, "KM", "tl", "Foo"])}[p_partkey % {len(words.ABBREVIATIONS) + 3} + 1] AS token FROM part)
    SELECT p_partkey, token, coalesce(x.long, y.long, token) AS expanded FROM p LEFT JOIN a x ON x.short = token LEFT JOIN a y ON y.short = upper(token)"""
)
def abbreviation_expand(spark, sf_dir):
    some = F.array(*map(F.lit, [*words.ABBREVIATIONS, "KM", "tl", "Foo"]))
    p = _table(spark, sf_dir, "part").select("p_partkey", F.element_at(some, (F.col("p_partkey") % len([*words.ABBREVIATIONS, 1, 1, 1]) + 1).cast("int")).alias("token"))
    return p.select("p_partkey", "token", words.expand_abbreviation(F.col("token")).alias("expanded"))


@_query(
    f"""WITH a(short, long) AS (VALUES {_ABBREVIATION_ROWS}), c AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS chunk FROM ({_CHUNKS_SQL})),
    n AS (SELECT doc_id, i, chunk, CASE WHEN regexp_matches(chunk, '^-?[0-9]+$') THEN try_cast(chunk AS BIGINT) END AS v FROM c),
    e AS (SELECT doc_id, i, CASE WHEN abs(v) < 1000000000000000 THEN CASE WHEN v < 0 THEN 'eksi ' ELSE '' END || {_any_number_sql('abs(v)')} WHEN regexp_matches(chunk, '^-?[0-9]+$') THEN chunk ELSE coalesce(x.long, y.long, chunk) END AS said
      FROM n LEFT JOIN a x ON x.short = chunk LEFT JOIN a y ON y.short = upper(chunk)),
    g AS (SELECT doc_id, string_agg(said, ' ' ORDER BY i) AS said FROM e GROUP BY doc_id)
    SELECT documents.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(said, '') END AS normalized FROM documents LEFT JOIN g USING (doc_id)"""
)
def normalize_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", words.normalize(F.col("text")).alias("normalized"))


# Sounds.


@_query(f"SELECT token, last, length(regexp_replace(token, '[^{sounds.VOWELS}]', '', 'g')) AS n_vowels, count(*) AS n FROM (SELECT token, nullif({_LAST_SQL.format(w='token')}, '') AS last FROM ({_WORDS_SQL})) GROUP BY ALL")
def vowel_stats(spark, sf_dir):
    t = _token_rows(spark, sf_dir).select("token", sounds.last_vowel(F.col("token")).alias("last"), F.regexp_count("token", F.lit(_VOWEL)).cast("bigint").alias("n_vowels"))
    return t.groupBy("token", "last", "n_vowels").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT c_custkey, nullif({_LOW_SQL.format(w='lower(c_mktsegment)')}, '') AS low, nullif({_HIGH_SQL.format(w='lower(c_mktsegment)')}, '') AS high, {_HARD_SQL.format(w='lower(c_mktsegment)')} AS hard FROM customer")
def harmony_class(spark, sf_dir):
    w = F.lower("c_mktsegment")
    return _table(spark, sf_dir, "customer").select("c_custkey", sounds.low_vowel(w).alias("low"), sounds.high_vowel(w).alias("high"), sounds.hardens(w).alias("hard"))


@_query("SELECT token, greatest(length(regexp_replace(token, '[^aeıioöuüâîû]', '', 'g')), 1) AS n_syllables, greatest(length(regexp_replace(token, '[^aeıioöuüâîû]', '', 'g')), 1) - 1 AS stressed FROM (SELECT DISTINCT token FROM (" + _WORDS_SQL + f")) WHERE token NOT IN ({', '.join(repr(w) for w in sounds.STRESS)})")
def syllable_counts(spark, sf_dir):
    t = _token_rows(spark, sf_dir).select("token").distinct().filter(~F.col("token").isin(*sounds.STRESS))
    return t.select("token", F.size(sounds.syllables(F.col("token"))).cast("bigint").alias("n_syllables"), sounds.stress(F.col("token")).cast("bigint").alias("stressed"))


_LETTERS_SQL = f"SELECT token, generate_subscripts(l, 1) AS i, unnest(l) AS c FROM (SELECT DISTINCT token, string_split({{letters}}, '') AS l FROM ({_WORDS_SQL}))"
_STRESS_ROWS = ", ".join(f"('{w}', {k})" for w, k in sounds.STRESS.items())


@_query(
    f"""WITH s(word, place) AS (VALUES {_STRESS_ROWS}), l AS ({_LETTERS_SQL.format(letters="lower(translate(token, 'İI', 'iı'))")}),
    v AS (SELECT token, i, lag(i) OVER (PARTITION BY token ORDER BY i) AS p FROM l WHERE c IN ('a', 'e', 'ı', 'i', 'o', 'ö', 'u', 'ü', 'â', 'î', 'û')),
    cuts AS (SELECT v.token, CASE WHEN v.i - p = 1 THEN v.i WHEN v.i - p >= 4 AND a.c || b.c IN ({', '.join(repr(x) for x in sounds.ONSETS)}) THEN v.i - 2 ELSE v.i - 1 END AS cut
      FROM v LEFT JOIN l a ON a.token = v.token AND a.i = v.i - 2 LEFT JOIN l b ON b.token = v.token AND b.i = v.i - 1 WHERE p IS NOT NULL),
    k AS (SELECT l.token, l.i, l.c, (sum(CASE WHEN cut IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY l.token ORDER BY l.i))::INT AS syl FROM l LEFT JOIN cuts ON cuts.token = l.token AND cut = l.i),
    m AS (SELECT token, syl, string_agg(c, '' ORDER BY i) AS part FROM k GROUP BY ALL),
    n AS (SELECT m.token, syl, part, coalesce(place, max(syl) OVER (PARTITION BY m.token)) AS stressed FROM m LEFT JOIN s ON s.word = lower(translate(m.token, 'İI', 'iı')))
    SELECT token, string_agg(CASE WHEN syl = stressed THEN translate(part, '{words.LOWER}', '{words.UPPER}') ELSE part END, '·' ORDER BY syl) AS marked FROM n GROUP BY token"""
)
def stress_marks(spark, sf_dir):
    return _token_rows(spark, sf_dir).select("token").distinct().select("token", sounds.stress_mark(F.col("token")).alias("marked"))


_IPA_ROWS = ", ".join(f"('{c}', '{x}')" for c, x in sounds.IPA.items())


@_query(
    f"""WITH sound(c, x) AS (VALUES {_IPA_ROWS}), l AS ({_LETTERS_SQL.format(letters="lower(token)")}),
    w AS (SELECT token, i, c, lag(c) OVER o AS before, lead(c) OVER o AS after, last_value(CASE WHEN c IN ('a', 'ı', 'o', 'u', 'e', 'i', 'ö', 'ü') THEN c END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearest,
      first_value(CASE WHEN c IN ('a', 'ı', 'o', 'u', 'e', 'i', 'ö', 'ü') THEN c END IGNORE NULLS) OVER (PARTITION BY token ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first FROM l WINDOW o AS (PARTITION BY token ORDER BY i)),
    p AS (SELECT token, i, CASE WHEN w.c = 'ğ' THEN CASE WHEN before IN ('a', 'ı', 'o', 'u', 'e', 'i', 'ö', 'ü') AND after IS NOT NULL THEN 'ː' ELSE '' END
      WHEN w.c = 'k' AND coalesce(nearest, first) IN ('e', 'i', 'ö', 'ü') THEN 'c' WHEN w.c = 'l' AND coalesce(nearest, first) IN ('a', 'ı', 'o', 'u') THEN 'ɫ' ELSE coalesce(x, w.c) END AS x FROM w LEFT JOIN sound ON sound.c = w.c)
    SELECT token, string_agg(x, '' ORDER BY i) AS ipa FROM p GROUP BY token"""
)
def ipa_tokens(spark, sf_dir):
    return _token_rows(spark, sf_dir).select("token").distinct().select("token", sounds.ipa(F.col("token")).alias("ipa"))


# Particles and reduplication.


@_query("SELECT n_nationkey, lower(n_name) || ' ' || lower(n_name) AS doubled FROM nation")
def reduplicate_full(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", forms.form("full_reduplicate", F.lower("n_name")).alias("doubled"))


@_query("SELECT n_nationkey, CASE WHEN n_name LIKE 'M%' THEN NULL WHEN regexp_matches(lower(n_name), '^[aeıioöuü]') THEN lower(n_name) || ' m' || lower(n_name) ELSE lower(n_name) || ' m' || substr(lower(n_name), 2) END AS doubled FROM nation")
def m_reduplicate(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", forms.form("m_reduplicate", F.lower("n_name")).alias("doubled"))


@_query("""SELECT r_regionkey, CASE WHEN n = 1 THEN names[1] ELSE array_to_string(names[1:n - 1], ', ') || ' ve ' || names[n] END AS names FROM
    (SELECT n_regionkey AS r_regionkey, list(n_name ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY ALL)""")
def coordinate_names(spark, sf_dir):
    lists = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return lists.select("r_regionkey", forms.form("coordinate", "names", conj="ve").alias("names"))


@_query(f"SELECT n_nationkey, lower(n_name) || CASE WHEN {_LAST_SQL.format(w='lower(n_name)')} IN ('a', 'ı', 'o', 'u') THEN ' da' ELSE ' de' END AS joined FROM nation")
def conjoin_de_da(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", forms.form("conjoin", F.lower("n_name"), conj="de").alias("joined"))


def _numeral_sql(after_vowel: str, after_consonant: str) -> str:
    w = "w"
    voiced = f"CASE WHEN {w} LIKE '%t' THEN left({w}, length({w}) - 1) || 'd' ELSE {w} END"
    parts = {"I": _HIGH_SQL.format(w=w), "A": _LOW_SQL.format(w=w)}
    build = lambda template: " || ".join(parts.get(c, f"'{c}'") for c in template)
    return f"CASE WHEN regexp_matches({w}, '[aıoueiöü]$') THEN {w} || {build(after_vowel)} ELSE {voiced} || {build(after_consonant)} END"


_DAYS_SQL = f"SELECT o_orderkey, {_number_sql('day(o_orderdate)')} AS w FROM orders"


@_query(f"SELECT o_orderkey, {_numeral_sql('ncI', 'IncI')} AS nth FROM ({_DAYS_SQL})")
def ordinal_dayofmonth(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", forms.form("ordinal", words.number_words(F.dayofmonth("o_orderdate"))).alias("nth"))


@_query(f"SELECT o_orderkey, {_numeral_sql('şAr', 'Ar')} AS each_of FROM ({_DAYS_SQL})")
def distributive_dayofmonth(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", forms.form("distributive", words.number_words(F.dayofmonth("o_orderdate"))).alias("each_of"))


# Morphology over a seed.

#: Nouns without alternations, whose suffixes SQL can spell out.
_NOUNS = "araba ay bina cadde defter deniz dünya el ev gece göl göz hafta kalem kapı kız köy kuş masa okul orman para pencere ses sıra şoför top tuz ütü yol".split()
_VERBS = "almak bakmak bulmak çalışmak dinlemek gelmek görmek gülmek kalmak konuşmak okumak sevmek sormak süpürmek uyumak yazmak".split()


def _seed(spark: SparkSession, values: list[str], name: str = "lemma") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def _seed_sql(values: list[str]) -> str:
    return f"(SELECT unnest({_list(values)}) AS w)"


def _suffix_sql(template: str, w: str = "w") -> str:
    vowel = f"regexp_matches({w}, '[aıoueiöü]$')"
    low, high, hard = _LOW_SQL.format(w=w), _HIGH_SQL.format(w=w), _HARD_SQL.format(w=w)
    flat = f"translate({low}, 'ae', 'ıi')"
    out, i = [], 0
    while i < len(template):
        c, optional = template[i], template[i + 1 : i + 2] == "~"
        i += 2 if optional else 1
        sound = {"A": low, "I": high, "H": flat, "D": f"CASE WHEN {hard} THEN 't' ELSE 'd' END", "C": f"CASE WHEN {hard} THEN 'ç' ELSE 'c' END"}.get(c, f"'{c}'")
        if optional:
            sound = f"CASE WHEN {'NOT ' if c == 'I' else ''}{vowel} THEN {sound} ELSE '' END"
        out.append(f"({sound})")
    return " || ".join([w, *out])


_DECLINED = {"acc": "y~I", "dat": "y~A", "loc": "DA", "abl": "DAn", "gen": "n~In", "ins": "y~lA", "pl.nom": "lAr", "poss.1sg": "I~m", "poss.3sg": "s~I", "poss.1pl": "I~mIz", "poss.3pl": "lArH"}


@_query(" UNION ALL ".join(f"SELECT w AS lemma, '{k}' AS cell_key, {_suffix_sql(t)} AS form FROM {_seed_sql(_NOUNS)}" for k, t in _DECLINED.items()))
def decline_seed(spark, sf_dir):
    return forms.paradigm_noun(_seed(spark, _NOUNS)).filter(F.col("cell_key").isin(*_DECLINED))


_ROOTS_SQL = "(SELECT l, left(l, length(l) - 3) AS w FROM (SELECT unnest({verbs}) AS l))"
_CONJUGATED = {"past.1sg": "DIm", "past.3sg": "DI", "past.1pl": "DIk", "past.3pl": "DIlAr", "evid.3sg": "mIş", "evid.2sg": "mIşsIn", "cond.1sg": "sAm", "fut.3sg": "y~AcAk", "necess.3sg": "mAlH", "imp.3sg": "sIn", "neg.past.3sg": "mAdH", "conv_arak": "y~ArAk", "part_dik": "DIğI"}


@_query(" UNION ALL ".join(f"SELECT l AS lemma, '{k}' AS cell_key, {_suffix_sql(t)} AS form FROM {_ROOTS_SQL.format(verbs=_list(_VERBS))}" for k, t in _CONJUGATED.items()))
def conjugate_seed(spark, sf_dir):
    return forms.paradigm(_seed(spark, _VERBS)).filter(F.col("cell_key").isin(*_CONJUGATED))


def _layered_sql(rows: str, layers: list[str]) -> str:
    """l and w of ``rows`` with one suffix after the other on w."""
    for layer in layers:
        rows = f"SELECT l, {_suffix_sql(layer)} AS w FROM ({rows})"
    return rows


_PERSON_SETS = {
    "z": {"1sg": "y~Im", "2sg": "sIn", "3sg": "", "1pl": "y~Iz", "2pl": "sInIz", "3pl": "lAr"},
    "k": {"1sg": "m", "2sg": "n", "3sg": "", "1pl": "k", "2pl": "nIz", "3pl": "lAr"},
}


def _conjugation_sql(verbs: list[str] = _VERBS) -> str:
    """Every cell as a row of suffixes on the root."""
    vowel = "regexp_matches(w, '[aıoueiöü]$')"
    rows = f"SELECT l, w FROM {_ROOTS_SQL.format(verbs=_list(verbs))}"
    # before -yor a final low vowel gives way to a high one
    bare = "CASE WHEN regexp_matches(w, '[ae]$') THEN left(w, length(w) - 1) ELSE w END"
    present = f"SELECT l, CASE WHEN regexp_matches(w, '[ıiuü]$') THEN w ELSE ({bare}) || {_HIGH_SQL.format(w=f'({bare})')} END || 'yor' AS w FROM ({rows})"
    negative = f"SELECT l, w || 'm' || {_HIGH_SQL.format(w='w')} || 'yor' AS w FROM ({rows})"
    high = "w IN ('al', 'bul', 'gel', 'gör', 'kal') OR length(regexp_replace(w, '[^aıoueiöü]', '', 'g')) > 1"
    aorist = f"SELECT l, CASE WHEN {vowel} THEN w || 'r' WHEN {high} THEN w || {_HIGH_SQL.format(w='w')} || 'r' ELSE w || {_LOW_SQL.format(w='w')} || 'r' END AS w FROM ({rows})"
    cells: list[tuple[str, str, list[str]]] = []
    for base, stem, ends in (("past", "DI", "k"), ("cond", "sA", "k"), ("evid", "mIş", "z"), ("fut", "y~AcAk", "z"), ("necess", "mAlH", "z")):
        for person, end in _PERSON_SETS[ends].items():
            soft = "y~AcAğ" if base == "fut" and person in ("1sg", "1pl") else stem
            cells += [(f"{base}.{person}", rows, [soft, end]), (f"neg.{base}.{person}", rows, ["mA", soft, end])]
    others = {f"opt.{p}": ["y~A", t] for p, t in {"1sg": "yIm", "2sg": "sIn", "3sg": "", "1pl": "lIm", "2pl": "sInIz", "3pl": "lAr"}.items()}
    others |= {f"imp.{p}": t for p, t in {"2sg": [""], "3sg": ["sIn"], "2pl": ["y~In"], "3pl": ["sIn", "lAr"]}.items()}
    others |= {"conv_arak": ["y~ArAk"], "part_dik": ["DIğI"]}
    for key, layers in others.items():
        cells += [(key, rows, layers), (f"neg.{key}", rows, ["mA", *layers])]
    for person, end in _PERSON_SETS["z"].items():
        cells += [(f"pres.{person}", present, [end]), (f"neg.pres.{person}", negative, [end]), (f"aorist.{person}", aorist, [end])]
        cells.append((f"neg.aorist.{person}", rows, ["mA", {"1sg": "m", "1pl": "y~Iz"}.get(person, "z"), "" if person in ("1sg", "1pl") else end]))
    cells += [("ability.pres.3sg", rows, ["y~A", "biliyor"]), ("ability.aorist.3sg", rows, ["y~A", "bilir"])]
    return " UNION ALL ".join(f"SELECT l AS lemma, '{key}' AS cell_key, w AS form FROM ({_layered_sql(base, layers)})" for key, base, layers in cells)


@_query(_conjugation_sql())
def conjugate_paradigm(spark, sf_dir):
    return forms.paradigm(_seed(spark, _VERBS))


def _declension_sql(nouns: list[str] = _NOUNS) -> str:
    """Every cell as a row of suffixes; after the third person's possessive an n stands
    before the case."""
    case = {"acc": "y~I", "dat": "y~A", "loc": "DA", "abl": "DAn", "gen": "n~In", "ins": "y~lA"}
    after_n = {"acc": "nI", "dat": "nA", "loc": "ndA", "abl": "ndAn", "gen": "nIn", "ins": "nlA"}
    own = {"1sg": "I~m", "2sg": "I~n", "3sg": "s~I", "1pl": "I~mIz", "2pl": "I~nIz", "3pl": "lArH"}
    cells = [("nom", []), *((c, [t]) for c, t in case.items()), ("pl.nom", ["lAr"]), *((f"pl.{c}", ["lAr", t]) for c, t in case.items())]
    cells += [(f"poss.{p}", [t]) for p, t in own.items()]
    cells += [(f"poss.{p}.{c}", [t, (after_n if p in ("3sg", "3pl") else case)[c]]) for p, t in own.items() for c in case]
    cells += [("pl.poss.1pl.abl", ["lAr", "I~mIz", "DAn"]), ("pred.3sg", ["DIr"]), ("ki.loc", ["DA", "ki"]), ("ki.gen", ["n~In", "ki"]), ("ca", ["CA"])]
    rows = f"SELECT w AS l, w FROM {_seed_sql(nouns)}"
    return " UNION ALL ".join(f"SELECT l AS lemma, '{key}' AS cell_key, w AS form FROM ({_layered_sql(rows, layers)})" for key, layers in cells)


@_query(_declension_sql())
def decline_paradigm(spark, sf_dir):
    return forms.paradigm_noun(_seed(spark, _NOUNS))


@_query(
    " UNION ALL ".join(
        f"SELECT w AS lemma, '-{t}{'-' if verb else ''}' AS suffix, {_suffix_sql(t)}{' || ' + _quote if verb else ''} AS form, {str(verb).upper()} AS is_verb FROM {_seed_sql(_NOUNS)}"
        for t, verb, _quote in (("lIk", False, ""), ("CI", False, ""), ("lI", False, ""), ("sIz", False, ""), ("DAş", False, ""), ("CA", False, ""), ("sAl", False, ""), ("lA", True, "'m' || " + _LOW_SQL.format(w="w") + " || 'k'"))
    )
)
def derivations_seed(spark, sf_dir):
    made = forms.derivations(_seed(spark, _NOUNS).withColumn("pos", F.lit("noun")))
    return made.filter(F.col("suffix").isin("-lIk", "-CI", "-lI", "-sIz", "-DAş", "-CA", "-sAl", "-lA-")).drop("category")


_LEXICON = [(v, "verb") for v in _VERBS] + [(n, "noun") for n in _NOUNS] + [("güzel", "adj"), ("iki", "num"), ("ben", "pron"), ("biz", "pron")]
_SENTENCES = ["Biz okula geldik.", "Kızın kalemi masada mı?", "iki deniz gördüm", "Ben evdeyken uyudun.", "Gözlükçü yoldan bakıyor", "Ali Ankara'ya gelecekmiş", "Mustafa Kemal Atatürk"]


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LEXICON, "lemma string, pos string")


def _sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_SENTENCES)), "sent_id int, text string")


@_query()
def analyze_seed(spark, sf_dir):
    rows = analyze.reading_rows(analyze.parse_text(_sentences(spark), _lexicon(spark), "sent_id", max_derivation_depth=2))
    return rows.select("sent_id", "idx", "token", "ord", "lemma", "pos", "kind", "axes_text", F.array_join(F.transform("segments", lambda s: s["surface"]), "+").alias("parts"), "hypothetical")


@_query()
def rank_in_context_seed(spark, sf_dir):
    tokens = analyze.parse_text(_sentences(spark), _lexicon(spark), "sent_id")
    ranked = ranking.rank_in_context(tokens.select("sent_id", "idx", "token"), analyze.reading_rows(tokens), pos=_lexicon(spark))
    return ranked.select("sent_id", "idx", "token", "rank", "evidence", "lemma", "kind", "axes_text")


@_query()
def confidence_seed(spark, sf_dir):
    rows = analyze.reading_rows(analyze.parse_text(_sentences(spark), _lexicon(spark), "sent_id"))
    return ranking.disambiguate(rows, ["sent_id", "idx"], pos=_lexicon(spark)).select("sent_id", "idx", "rank", "lemma", "kind", F.round("confidence", 6).alias("confidence"))


@_query()
def lemmatize_seed(spark, sf_dir):
    return lemmatize.lemmatize_text(_sentences(spark), _lexicon(spark), id_col="sent_id").withColumn("confidence", F.round("confidence", 6))


@_query()
def spelling_seed(spark, sf_dir):
    return spelling.check(_seed(spark, ["kalm", "gozluk", "denız", "evde", "koy", "masa"], "word"), _lexicon(spark))


@_query()
def entity_spans_seed(spark, sf_dir):
    return entities.tag(_sentences(spark), _lexicon(spark), "sent_id")


@_query()
def parse_seed(spark, sf_dir):
    return syntax.tree_rows(syntax.parse(_sentences(spark), _lexicon(spark), _lexicon(spark)))


@_query()
def dependency_seed(spark, sf_dir):
    return syntax.dependency_rows(syntax.parse(_sentences(spark), _lexicon(spark), _lexicon(spark)))


@_query()
def conllu_seed(spark, sf_dir):
    rows = dependency_seed(spark, sf_dir).join(_sentences(spark), "sent_id")
    return tables.conllu(rows)


@_query()
def sentence_elements_seed(spark, sf_dir):
    made = syntax.analyze_sentences(_sentences(spark), _lexicon(spark), _lexicon(spark))
    return made.select("sent_id", "sentence_type.*", F.inline("elements")).withColumn("tokens", F.array_join("tokens", " ")).drop("aliases")


@_query()
def clauses_seed(spark, sf_dir):
    made = syntax.analyze_sentences(_sentences(spark), _lexicon(spark), _lexicon(spark))
    return made.select("sent_id", F.posexplode("clauses").alias("clause", "c")).select("sent_id", "clause", "c.role", "c.predicate_id", "c.connector", F.size("c.elements").alias("n_elements"))


@_query()
def entity_spans_documents(spark, sf_dir):
    return entities.tag(_table(spark, sf_dir, "documents"))


@_query("SELECT a.p_partkey AS left_key, b.p_partkey AS right_key FROM part a JOIN part b ON levenshtein(a.p_name, b.p_name) <= 1 AND a.p_partkey < b.p_partkey")
def similar_names(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return spelling.row_pairs(p, spelling.similar(p, p, 1.0, "p_name", "p_name"), "p_partkey", "p_name")


# Readings, sentences and names, by grammar or by tables written out by hand.


_READ_NOUNS, _READ_VERBS = ["göl", "araba", "kuş"], ["gelmek", "uyumak"]


def _noun_axes(key: str) -> str:
    parts = key.split(".")
    axes = {"case": parts[-1]} if parts[-1] in g.CASES and parts[-1] != "nom" else {}
    if "pl" in parts:
        axes["number"] = "pl"
    if "poss" in parts:
        axes["possessive"] = parts[parts.index("poss") + 1]
    return repr(sorted(axes.items()))


def _verb_axes(key: str) -> str:
    parts = key.split(".")
    axes = {"person": parts[-1], "tense": parts[-2]} | ({"negative": True} if "neg" in parts else {}) | ({"ability": True} if "ability" in parts else {})
    return repr(sorted(axes.items()))


_NOUN_CELLS = {k: _noun_axes(k) for k, _, _ in g.noun_cells() if k.split(".")[0] not in ("ki", "pred", "ca")}
_VERB_CELLS = {k: _verb_axes(k) for k, _ in g.paradigm_cells() if not k.split(".")[-1].startswith(("conv", "part"))}


def _expected_sql(cells: dict[str, str]) -> str:
    return "(VALUES " + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in cells.items()) + ") x(cell_key, axes_text)"


def _read_back(spark: SparkSession, made: DataFrame, cells: dict[str, str], kind: str) -> DataFrame:
    """Of each form the reading that it was made from, if analysis finds it."""
    want = made.join(spark.createDataFrame(list(cells.items()), "cell_key string, axes_text string"), "cell_key")
    read = analyze.reading_rows(analyze.analyze(made.withColumnRenamed("form", "surface"), _lexicon(spark))).filter((F.col("kind") == kind) & ~F.col("hypothetical"))
    return want.join(read.select(F.col("surface").alias("form"), "lemma", "axes_text"), ["form", "lemma", "axes_text"]).select("lemma", "cell_key", "form", "axes_text")


@_query(f"SELECT lemma, cell_key, form, axes_text FROM ({_declension_sql(_READ_NOUNS)}) JOIN {_expected_sql(_NOUN_CELLS)} USING (cell_key)")
def analyze_declined(spark, sf_dir):
    return _read_back(spark, forms.paradigm_noun(_seed(spark, _READ_NOUNS)), _NOUN_CELLS, "decline")


@_query(f"SELECT lemma, cell_key, form, axes_text FROM ({_conjugation_sql(_READ_VERBS)}) JOIN {_expected_sql(_VERB_CELLS)} USING (cell_key)")
def analyze_conjugated(spark, sf_dir):
    return _read_back(spark, forms.paradigm(_seed(spark, _READ_VERBS)), _VERB_CELLS, "conjugate")


@_query(f"SELECT DISTINCT w AS word, ok AS is_valid FROM (SELECT unnest([form, form || 'qx']) AS w, unnest([TRUE, FALSE]) AS ok FROM ({_declension_sql(_READ_NOUNS[:1])}))")
def valid_forms(spark, sf_dir):
    made = forms.paradigm_noun(_seed(spark, _READ_NOUNS[:1]))
    return spelling.is_valid(made.select(F.explode(F.array("form", F.concat("form", F.lit("qx")))).alias("word")), _lexicon(spark))


_PLAIN = ["öğrenci okudu", "büyük ev", "eve göre", "kitap ve defter", "Ben eve gidiyorum", "Ali kitabı okudu", "Öğrenci kitap okudu", "Geldi çocuk", "Çocuk okula gitmedi", "Evlerden çocuklar geldi"]
_PLAIN_LEXICON = [
    *((w, "noun") for w in "çocuk defter ev kitap okul öğrenci".split()), *((w, "verb") for w in "gelmek gitmek okumak".split()), ("büyük", "adj"), ("ben", "pron"), ("ve", "conj"), ("göre", "postp"),
]


def _plain(spark: SparkSession, *ids: int) -> tuple[DataFrame, DataFrame]:
    rows = [(i, t) for i, t in enumerate(_PLAIN) if i in ids]
    return spark.createDataFrame(rows, "sent_id int, text string"), spark.createDataFrame(_PLAIN_LEXICON, "lemma string, pos string")


def _values_sql(columns: str, rows: list[tuple]) -> str:
    said = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper()
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) v({columns})"


_TREES = [
    (0, 0, -1, 0, "S", "öğrenci okudu"), (0, 1, 0, 0, "NP", "öğrenci"), (0, 2, 1, 0, "NOUN", "öğrenci"), (0, 3, 0, 1, "VP", "okudu"), (0, 4, 3, 0, "VERB", "okudu"),
    (1, 0, -1, 0, "NP", "büyük ev"), (1, 1, 0, 0, "ADJ", "büyük"), (1, 2, 0, 1, "NOUN", "ev"),
    (2, 0, -1, 0, "PP", "eve göre"), (2, 1, 0, 0, "NP", "eve"), (2, 2, 1, 0, "NOUN", "eve"), (2, 3, 0, 1, "ADP", "göre"),
    (3, 0, -1, 0, "CoordP", "kitap ve defter"), (3, 1, 0, 0, "NP", "kitap"), (3, 2, 1, 0, "NOUN", "kitap"), (3, 3, 0, 1, "CCONJ", "ve"), (3, 4, 0, 2, "NP", "defter"), (3, 5, 4, 0, "NOUN", "defter"),
]


@_query(_values_sql("sent_id, node_id, parent_id, ord, tag, surface", _TREES))
def parse_phrases(spark, sf_dir):
    texts, lexicon = _plain(spark, 0, 1, 2, 3)
    return syntax.tree_rows(syntax.parse(texts, lexicon, lexicon)).withColumn("parent_id", F.coalesce("parent_id", F.lit(-1))).drop("governs")


#: A conjunction hangs on the first conjunct, a noun on its postposition.
_ARCS = [
    (0, 1, "öğrenci", 2, "nsubj"), (0, 2, "okudu", 0, "root"), (1, 1, "büyük", 2, "amod"), (1, 2, "ev", 0, "root"), (2, 1, "eve", 2, "nmod"), (2, 2, "göre", 0, "root"),
    (3, 1, "kitap", 0, "root"), (3, 2, "ve", 1, "cc"), (3, 3, "defter", 1, "conj"), (4, 1, "Ben", 3, "nsubj"), (4, 2, "eve", 3, "obl"), (4, 3, "gidiyorum", 0, "root"),
]


@_query(_values_sql("sent_id, id, form, head, deprel", _ARCS))
def dependency_phrases(spark, sf_dir):
    texts, lexicon = _plain(spark, 0, 1, 2, 3, 4)
    return syntax.dependency_rows(syntax.parse(texts, lexicon, lexicon)).select("sent_id", "id", "form", "head", "deprel")


_ELEMENTS = [
    (4, "kurallı", "olumlu", "özne", "Ben", 1), (4, "kurallı", "olumlu", "dolaylı tümleç", "eve", 2), (4, "kurallı", "olumlu", "yüklem", "gidiyorum", 3),
    (5, "kurallı", "olumlu", "özne", "Ali", 1), (5, "kurallı", "olumlu", "belirtili nesne", "kitabı", 2), (5, "kurallı", "olumlu", "yüklem", "okudu", 3),
    (6, "kurallı", "olumlu", "özne", "Öğrenci", 1), (6, "kurallı", "olumlu", "belirtisiz nesne", "kitap", 2), (6, "kurallı", "olumlu", "yüklem", "okudu", 3),
    (7, "devrik", "olumlu", "yüklem", "Geldi", 1), (7, "devrik", "olumlu", "özne", "çocuk", 2),
    (8, "kurallı", "olumsuz", "özne", "Çocuk", 1), (8, "kurallı", "olumsuz", "dolaylı tümleç", "okula", 2), (8, "kurallı", "olumsuz", "yüklem", "gitmedi", 3),
]


@_query(_values_sql("sent_id, yuklem_yeri, olumluluk, label, tokens, head_id", _ELEMENTS))
def sentence_elements(spark, sf_dir):
    texts, lexicon = _plain(spark, 4, 5, 6, 7, 8)
    made = syntax.analyze_sentences(texts, lexicon, lexicon).select("sent_id", "sentence_type.yuklem_yeri", "sentence_type.olumluluk", F.inline("elements"))
    return made.withColumn("tokens", F.array_join("tokens", " ")).drop("aliases")


_LEMMAS = [
    (0, 0, "öğrenci", "öğrenci"), (0, 1, "okudu", "okumak"), (4, 0, "Ben", "ben"), (4, 1, "eve", "ev"), (4, 2, "gidiyorum", "gitmek"), (7, 0, "Geldi", "gelmek"), (7, 1, "çocuk", "çocuk"),
    (8, 0, "Çocuk", "çocuk"), (8, 1, "okula", "okul"), (8, 2, "gitmedi", "gitmek"), (9, 0, "Evlerden", "ev"), (9, 1, "çocuklar", "çocuk"), (9, 2, "geldi", "gelmek"),
]


@_query(_values_sql("sent_id, idx, token, lemma", _LEMMAS))
def lemmas_of_sentences(spark, sf_dir):
    texts, lexicon = _plain(spark, 0, 4, 7, 8, 9)
    return lemmatize.lemmatize_text(texts, lexicon, id_col="sent_id").select("sent_id", "idx", "token", "lemma")


_SPANS = [(4, 1, "Gözlükçü", "PROPER"), (5, 1, "Ali", "PER"), (5, 2, "Ankara", "LOC"), (6, 1, "Mustafa Kemal Atatürk", "PER")]


@_query(_values_sql("sent_id, index, surface, type", _SPANS))
def entity_names(spark, sf_dir):
    return entities.tag(_sentences(spark), _lexicon(spark), "sent_id").drop("tokens")


_GOLD = [(0, "Biz", "Pron"), (0, "okula", "Noun"), (0, "geldik", "Verb"), (0, ".", "Punc"), (1, "bir", "Det"), (1, "deniz", "Noun"), (1, "gördüm", "Verb"), (2, "Xyz", "Noun"), (2, "gelecekmiş", "Verb")]


@_query("SELECT method, 8::BIGINT AS tokens, 8::BIGINT AS covered, 8::BIGINT AS correct, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS covered_accuracy FROM (VALUES ('isolated'), ('rule'), ('hmm')) m(method)")
def three_ways_seed(spark, sf_dir):
    rows = [(s, i, w, p) for i, (s, w, p) in enumerate(_GOLD)]
    gold = spark.createDataFrame(rows, "sent_id int, idx int, token string, gold string")
    counted = gold.withColumnRenamed("token", "surface").withColumnRenamed("gold", "pos")
    em, tr = hmm.log_probabilities(hmm.emission_counts(counted), "pos"), hmm.log_probabilities(hmm.transition_counts(counted), "prev")
    return hmm.evaluate_three_ways(hmm.tag_three_ways(gold, _lexicon(spark), em, tr))


# Counting, windows and decoding over whole tables.



def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens tagged by their length class: S up to 3 letters, M up to 6, L beyond."""
    n = F.length("token")
    return _token_rows(spark, sf_dir).select(F.col("doc_id").alias("sent_id"), F.col("pos").alias("idx"), F.col("token").alias("surface"), F.when(n <= 3, "S").when(n <= 6, "M").otherwise("L").alias("pos"))


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitions of :func:`_tagged`, counted without a row for each token."""
    n = F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[^ \\t\\n\\r]+"), F.lit(0)), lambda t: F.when(F.length(t) <= 3, 0).when(F.length(t) <= 6, 1).otherwise(2).cast("tinyint"))
    return hmm.transition_counts_of(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sent_id"), n.alias("codes")), "codes", ("S", "M", "L"))


_CLASS_SQL = "(SELECT doc_id AS sent_id, idx, surface, CASE WHEN length(surface) <= 3 THEN 'S' WHEN length(surface) <= 6 THEN 'M' ELSE 'L' END AS pos FROM (SELECT doc_id, generate_subscripts(t, 1) - 1 AS idx, unnest(t) AS surface FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r]+') AS t FROM documents)))"
_EMITTED_SQL = f"(SELECT pos, surface, count(*) AS n FROM {_CLASS_SQL} GROUP BY ALL)"
_PAIRS_SQL = f"""(SELECT prev, next, count(*) AS n FROM (
    SELECT coalesce(lag(pos) OVER (PARTITION BY sent_id ORDER BY idx), '<S>') AS prev, pos AS next FROM {_CLASS_SQL}
    UNION ALL SELECT pos, '</S>' FROM (SELECT pos, lead(pos) OVER (PARTITION BY sent_id ORDER BY idx) AS after FROM {_CLASS_SQL}) WHERE after IS NULL) GROUP BY ALL)"""


@_query(_EMITTED_SQL[1:-1])
def emission_counts(spark, sf_dir):
    return hmm.emission_counts(_tagged(spark, sf_dir))


@_query(_PAIRS_SQL[1:-1])
def transition_counts(spark, sf_dir):
    return _transitions(spark, sf_dir)


@_query(f"SELECT pos, surface, round(ln((n + 1e-9) / (sum(n) OVER (PARTITION BY pos) + count(*) OVER (PARTITION BY pos) * 1e-9)), 9) AS log_prob FROM {_EMITTED_SQL} WHERE n >= 2")
def emission_logprob(spark, sf_dir):
    return hmm.log_probabilities(hmm.emission_counts(_tagged(spark, sf_dir)), "pos", least=2).withColumn("log_prob", F.round("log_prob", 9))


@_query(f"SELECT prev, next, round(ln((n + 1e-9) / (sum(n) OVER (PARTITION BY prev) + count(*) OVER (PARTITION BY prev) * 1e-9)), 9) AS log_prob FROM {_PAIRS_SQL}")
def transition_logprob(spark, sf_dir):
    return hmm.log_probabilities(_transitions(spark, sf_dir), "prev").withColumn("log_prob", F.round("log_prob", 9))


_STATES = ("S", "M", "L")
_UNKNOWN_SQL = f"{hmm.UNKNOWN!r}::DOUBLE"


def _viterbi_sql() -> str:
    """Forward along each turn with the better way back from each state, then back."""
    lp = lambda table, *on: f"coalesce((SELECT log_prob FROM {table} WHERE {' AND '.join(on)}), {_UNKNOWN_SQL})"
    hop = {(a, b): f"h.{a}{b}" for a in ("B", *_STATES) for b in (*_STATES, "E")}
    name = {"B": hmm.START, "E": hmm.END}
    hops = ", ".join(f"{lp('tr', f'prev = {chr(39)}{name.get(a, a)}{chr(39)}', f'next = {chr(39)}{name.get(b, b)}{chr(39)}')} AS {a}{b}" for a, b in hop if (a, b) != ("B", "E"))
    emitted = ", ".join(f"coalesce(max(CASE WHEN em.pos = '{x}' THEN log_prob END), {_UNKNOWN_SQL}) AS e{x}" for x in _STATES)
    top = lambda to: f"greatest({', '.join(f'f.v{a} + {hop[a, to]}' for a in _STATES)})"
    back = lambda to: "CASE " + " ".join(f"WHEN f.v{a} + {hop[a, to]} = {top(to)} THEN '{a}'" for a in _STATES) + " END"
    begin = ", ".join(f"{hop['B', x]} + w.e{x} AS v{x}" for x in _STATES) + ", " + ", ".join(f"NULL::VARCHAR AS b{x}" for x in _STATES)
    on = ", ".join(f"{top(x)} + w.e{x}" for x in _STATES) + ", " + ", ".join(back(x) for x in _STATES)
    return f"""WITH RECURSIVE em AS (SELECT pos, surface, ln((n + 1e-9) / (sum(n) OVER (PARTITION BY pos) + count(*) OVER (PARTITION BY pos) * 1e-9)) AS log_prob FROM {_EMITTED_SQL} WHERE n >= 2),
    tr AS (SELECT prev, next, ln((n + 1e-9) / (sum(n) OVER (PARTITION BY prev) + count(*) OVER (PARTITION BY prev) * 1e-9)) AS log_prob FROM {_PAIRS_SQL}),
    h AS (SELECT {hops}),
    t AS (SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS idx, unnest(l) AS surface FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[^ \\t\\n\\r]+') AS l FROM conversations)),
    w AS (SELECT conv_id, turn, idx, {emitted} FROM t LEFT JOIN em USING (surface) GROUP BY ALL),
    f AS (SELECT w.conv_id, w.turn, w.idx, {begin} FROM w, h WHERE w.idx = 0
      UNION ALL SELECT w.conv_id, w.turn, w.idx, {on} FROM f JOIN w ON w.conv_id = f.conv_id AND w.turn = f.turn AND w.idx = f.idx + 1, h),
    last AS (SELECT f.conv_id, f.turn, f.idx, {back('E')} AS pos FROM f, h WHERE f.idx = (SELECT max(idx) FROM f g WHERE g.conv_id = f.conv_id AND g.turn = f.turn)),
    p AS (SELECT conv_id, turn, idx, pos FROM last
      UNION ALL SELECT f.conv_id, f.turn, f.idx - 1, CASE p.pos WHEN 'S' THEN f.bS WHEN 'M' THEN f.bM ELSE f.bL END FROM p JOIN f ON f.conv_id = p.conv_id AND f.turn = p.turn AND f.idx = p.idx WHERE f.idx > 0)
    SELECT conv_id, turn, idx::INT AS idx, pos FROM p"""


@_query(_viterbi_sql())
def viterbi_conversations(spark, sf_dir):
    em = hmm.log_probabilities(hmm.emission_counts(_tagged(spark, sf_dir)), "pos", least=2)
    tr = hmm.log_probabilities(_transitions(spark, sf_dir), "prev")
    tokens = _table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("sent_id"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[^ \\t\\n\\r]+"), F.lit(0))).alias("idx", "surface"))
    made = hmm.viterbi(tokens.withColumn("candidates", F.array(*map(F.lit, _STATES))), em, tr)
    return made.select("sent_id.conv_id", "sent_id.turn", "idx", "pos")


# Candidates of the tagger, by tables written out by hand.

_SEEN_ROWS = [
    # id, token, lemma, kind, pos, hypothetical; the lexicon's class of the lemma, what the reading counts as
    (1, "geldi", "gelmek", "conjugate", "verb", False, "verb", "Verb"), (2, "gelip", "gelmek", "converb", "verb", False, "verb", "Verb"), (3, "gelen", "gelmek", "participle", "verb", False, "verb", "Verb"),
    (4, "öğrenciyim", "öğrenci", "copula", "noun", False, "noun", "Noun"), (5, "kırmızı", "kırmızı", "decline", "noun", False, "adj", "Adj"), (6, "iki", "iki", "decline", "noun", False, "num", "Num"),
    (7, "hızlı", "hızlı", "decline", "noun", False, "adv", "Adverb"), (8, "onu", "o", "decline", "noun", False, "det", "Det"), (9, "bir", "bir", "number", "num", False, "num", "Num"),
    (10, "ama", "ama", "conjunction", "conj", False, "conj", "Conj"), (11, "için", "için", "postposition", "postp", False, "postp", "Postp"), (12, "eyvah", "eyvah", "interjection", "ünlem", False, None, "Interj"),
    (13, "şırıl", "şırıl", "onomatopoeia", "yansıma", False, None, "Noun"), (14, "çok", "çok", "decline", "noun", False, "adj", "Adj"), (15, "zzz", "zzzmek", "conjugate", "verb", True, None, "Verb"), (16, "Foo", None, None, None, None, None, None),
    (17, "kendisi", "kendi", "decline", "noun", False, "pron", "Pron"), (18, "Bu", "bu", "decline", "noun", False, "noun", "Noun"), (19, "evi", "ev", "decline", "noun", False, None, "Noun"),
]
#: What the tagger may choose from, in order.
_CANDIDATES = {
    1: "Verb", 2: "Verb", 3: "Verb", 4: "Noun", 5: "Adj", 6: "Num", 7: "Adverb", 8: "Det Pron", 9: "Num Det", 10: "Conj", 11: "Postp", 12: "Interj", 13: "Noun", 14: "Adj Adverb", 15: "Verb Noun", 16: "Noun",
    17: "Pron", 18: "Noun Pron Det", 19: "Noun",
}


@_query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{token}', {repr(major) if major else 'NULL'}, '{_CANDIDATES[i]}')" for i, token, *_, major in _SEEN_ROWS) + ") v(id, token, major, candidates)")
def tag_candidates(spark, sf_dir):
    kind = "id int, token string, readings array<struct<lemma:string,kind:string,pos:string,hypothetical:boolean>>"
    tokens = spark.createDataFrame([(i, token, [(lemma, k, pos, hyp)] if k else []) for i, token, lemma, k, pos, hyp, _, _ in _SEEN_ROWS], kind)
    lexicon = spark.createDataFrame([(r[2], r[6]) for r in _SEEN_ROWS if r[6]], "lemma string, pos string")
    seen = hmm.with_majors(tokens, ["id"], lexicon)
    more = hmm.augment_oov_candidates(F.col("token"), hmm.augment_function_candidates(F.col("token"), F.col("seen")))
    return seen.select("id", "token", F.get("seen", F.lit(0))["major"].alias("major"), F.array_join(F.transform(more, lambda r: r["major"]), " ").alias("candidates"))


@_query("""WITH t AS (SELECT doc_id, generate_subscripts(t, 1) AS i, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r]+') AS t FROM documents)),
    p AS (SELECT token AS first, lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS second FROM t)
    SELECT first, second, count(*) AS n FROM p WHERE second IS NOT NULL GROUP BY ALL ORDER BY n DESC, first, second LIMIT 100""")
def bigram_counts(spark, sf_dir):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[^ \\t\\n\\r]+"), F.lit(0))
    pairs = _table(spark, sf_dir, "documents").select(tokens.alias("t")).select(F.inline(F.arrays_zip(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))).alias("first"), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))).alias("second"))))
    return pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "first", "second").limit(100)


@_query("SELECT source, token, n, rank FROM (SELECT source, token, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, token)::INT AS rank FROM (SELECT source, token, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[^ \\t\\n\\r]+')) AS token FROM documents) GROUP BY ALL)) WHERE rank <= 5")
def topk_per_group(spark, sf_dir):
    t = _table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[^ \\t\\n\\r]+"), F.lit(0))).alias("token"))
    counts = t.groupBy("source", "token").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "token"))).filter("rank <= 5")


@_query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearest FROM events")
def nearest_left_context(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return _table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("nearest"))


@_query("""SELECT conv_id, island, min(turn) AS first_turn, count(*) AS n_turns FROM (
    SELECT conv_id, turn, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM (
    SELECT conv_id, turn, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS starts FROM conversations)) GROUP BY ALL""")
def role_islands(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _table(spark, sf_dir, "conversations").withColumn("starts", (~F.col("role").eqNullSafe(F.lag("role").over(w))).cast("int"))
    t = t.withColumn("island", F.sum("starts").over(w))
    return t.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n_turns"))
