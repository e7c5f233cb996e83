"""Proper nouns: types by gazetteer, case and apostrophe; spans by typed neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilsim.functions.words import tokenize, tr_lower
from tilsim.operators import analyze as an


def _sorted(words: str) -> tuple[str, ...]:
    return tuple(sorted(words.split()))


PERSONS = _sorted(
    "ahmet ali arda aslı aylin ayşe banu berk burak büşra can cem ceren deniz derya dilek ebru ece eda efe elif emine emre engin erdem esra fatma ferhat figen gizem gökhan gül haluk hande hasan hatice hülya hüseyin ibrahim irem işıl ismail kaan kaya kemal kübra levent leyla mehmet melek merve meryem murat mustafa nazlı necati nur oğuz onur orhan osman ömer özge pınar rıza sadık seda selin sema serkan sevgi sibel şeyma taner tarık tolga tuğba tülay ufuk ümit vedat veli volkan yağmur yasemin yıldız yusuf zafer zeynep"
)
PLACES = _sorted(
    "adana adıyaman afrika afyonkarahisar ağrı akdeniz aksaray almanya amasya amerika ankara antalya ardahan artvin asya avrupa avusturya aydın azerbaycan balıkesir bartın batman bayburt belçika bilecik bingöl bitlis boğaziçi bolu brezilya bulgaristan burdur bursa çanakkale çankırı çin çorum denizli dicle diyarbakır düzce edirne ege elazığ erzincan erzurum eskişehir fırat fransa gaziantep giresun gümüşhane gürcistan hakkari hatay hindistan hollanda iğdır ingiltere irak iran ispanya istanbul isviçre ısparta italya izmir japonya kahramanmaraş kanada karabük karadeniz karaman kars kastamonu kayseri kırıkkale kırklareli kırşehir kızılırmak kilis kocaeli konya kütahya malatya manisa mardin marmara meksika mersin mısır muğla muş nevşehir niğde okyanusya ordu osmaniye polonya portekiz rize rusya sakarya samsun siirt sinop sivas suriye şanlıurfa şırnak tekirdağ tokat trabzon tunceli türkiye ukrayna uşak van yalova yozgat yunanistan zonguldak"
)
ORGANISATIONS = _sorted("ab beşiktaş bm fenerbahçe galatasaray hürriyet meb milliyet nato osym ösym sgk tbmm tdk thy trabzonspor trt tübitak unesco unicef yök")
FUNCTION_WORDS = _sorted(
    "ama ancak artık ayrıca bazı belki ben bir biraz birçoğu birçok birkaç biz böyle bu bunlar bütün çok çünkü daha eğer en evet fakat hâlbuki hangi hatta hayır hem hepsi her herkes hiç hiçbir işte kaç kendi keşke kim kimi kimisi kimse lakin nasıl ne neden nerede nereye niçin niye o onlar oysa öyle pek sen siz şöyle şu şunlar tabii tüm ve veya yahut yani"
)
HEADS = _sorted(
    "bakanlığı bakanlık başkanlığı belediye belediyesi boğazı bulvarı cadde caddesi camii dağı gölü hastane hastanesi havalimanı ilçe ilçesi ili kalesi köprüsü kulübü lise lisesi mahalle mahallesi meydanı müdürlüğü müzesi nehri okul okulu ovası sarayı sokağı sokak spor stadyumu üniversite üniversitesi vadisi"
)


def proper_type(base: Column, apostrophe: Column, first: Column, common: Column) -> Column:
    """PER, LOC, ORG, PROPER or null. Function words and small letters never are; the
    gazetteer decides first, then an apostrophe, a capital inside a sentence, and at its
    beginning a capital of a word that isn't common."""
    low = tr_lower(base)
    return F.when((base != "") & ~low.isin(*FUNCTION_WORDS) & base.rlike("^\\p{Lu}"), F.when(low.isin(*PLACES), "LOC").when(low.isin(*PERSONS), "PER").when(low.isin(*ORGANISATIONS), "ORG").when(apostrophe | ~first | ~common, "PROPER"))


def tag(texts: DataFrame, roots: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``<id_col>, index, surface, type, tokens`` of each name; ``index`` counts tokens from 1.

    Neighbours join a span if their types go together, as islands of a window: a
    person takes names and surnames, a place or an organisation only head nouns, a name
    becomes a person's with a person's name. ``roots`` tells common words at a beginning.
    """
    toks = texts.select(F.col(id_col), tokenize(F.col(text)).alias("t"))
    # only capitals can be names, and most tokens go by that alone; outer, as otherwise the
    # optimizer's test for empty lists tokenizes every text once more
    each = toks.select(id_col, "t", F.posexplode_outer("t").alias("i", "tok")).filter(F.col("tok").rlike("^\\p{Lu}"))
    tok = F.translate("tok", "’", "'")
    after = F.get("t", F.col("i") + 1)
    apos = F.contains(tok, F.lit("'")) | F.coalesce(F.substr(after, F.lit(1), F.lit(1)).isin("'", "’"), F.lit(False))
    each = each.select(id_col, "i", F.substring_index(tok, "'", 1).alias("base"), apos.alias("apos"))
    firsts = each.filter("i = 0").select(F.col("base").alias("surface"))
    if roots is None:
        each = each.withColumn("common", F.lit(False))
    else:
        seen = an.analyze(firsts, roots).select(F.col("surface").alias("base"), F.exists("readings", lambda r: ~r["hypothetical"]).alias("common"))
        each = each.join(seen, "base", "left").withColumn("common", F.coalesce("common", F.lit(False)) & (F.col("i") == 0))
    named = each.withColumn("type", proper_type(F.col("base"), F.col("apos"), F.col("i") == 0, F.col("common"))).filter("type IS NOT NULL")
    # islands: a name that can only follow takes the kind of span of the name before it
    w = Window.partitionBy(id_col).orderBy("i")
    follows = F.coalesce(F.col("i") == F.lag("i").over(w) + 1, F.lit(False))
    head = follows & (F.col("type") == "PROPER") & tr_lower(F.col("base")).isin(*HEADS)
    named = named.withColumn("follows", follows).withColumn("head", head)
    named = named.withColumn("fixed", F.when(~F.col("head"), ~F.col("type").isin("PER", "PROPER")))
    named = named.withColumn("place", F.last("fixed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    begins = ~F.col("follows") | (~F.col("head") & (F.col("place") | F.lag("place").over(w)))
    named = named.withColumn("span", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = named.groupBy(id_col, "span").agg(F.min(F.struct("i", "type")).alias("first"), F.max(F.when((F.col("type") == "PER") & ~F.col("place"), "PER")).alias("person"), F.array_sort(F.collect_list(F.struct("i", "base"))).alias("names"))
    tokens = F.transform("names", lambda x: x["base"])
    return spans.select(id_col, (F.col("first.i") + 1).alias("index"), F.array_join(tokens, " ").alias("surface"), F.coalesce("person", "first.type").alias("type"), tokens.alias("tokens"))
