import json

from tilsim.__main__ import main
from tilsim.functions import turkish as t


def test_turkish_names():
    assert t.çekimle("gelmek", "şimdiki", "1tekil") == "geliyorum" and t.çekimle("yapmak", "geçmiş", "3tekil", çatı=["ettirgen", "edilgen"]) == "yaptırıldı"
    assert t.ad_çekimle("ev", sayı="çoğul", durum="ayrılma") == "evlerden" and t.ekfiil("öğrenci", "hikâye", "1çoğul") == "öğrenciydik"
    assert t.yüklem("genç", kişi="1tekil") == "gencim" and t.ki_ekle("ev") == "evdeki" and t.ulaç("gitmek", "ip") == "gidip" and t.fiilimsi("okumak", "dik", iyelik="3tekil") == "okuduğu"
    assert t.cumle_uret("biz", "gitmek", kip="gelecek") == "biz gideceğiz" and t.isim_tamlamasi("ev", "kapı") == "evin kapısı" and t.sıralı("bir") == "birinci"
    assert t.çözümle("geldi", "fiil", kökler={"gelmek"})[0]["sözlük_biçimi"] == "gelmek"


def test_sql(spark):
    assert "çekimle" in t.register(spark)
    row = spark.sql("SELECT `çekimle`('gelmek', 'geçmiş') AS a, `sıralı`('dört') AS b, `m_ikile`('masa') AS c").first()
    assert tuple(row) == ("geldi", "dördüncü", None)


def test_command_line(capsys):
    assert main(["analyze", "geldim", "--roots", "gelmek", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["lemma"] == "gelmek"
    assert main(["analyze", "x" * 201]) == 2 and main(["version"]) == 0


def test_command_line_ranks_with_confidence(spark, capsys):
    assert main(["analyze", "geldik", "--roots", "gelmek", "--json", "--disambiguate"]) == 0
    rows = json.loads(capsys.readouterr().out)
    assert rows[0]["kind"] == "conjugate" and rows[0]["confidence"] > 0.9 and abs(sum(r["confidence"] for r in rows) - 1) < 1e-5


def test_sentences_by_their_turkish_name(spark):
    lexicon = spark.createDataFrame([("gelmek", "verb"), ("okul", "noun"), ("biz", "pron")], "lemma string, pos string")
    made = t.tables()["cümle_çözümle"](spark.createDataFrame([(1, "Biz okula geldik")], "sent_id int, text string"), lexicon).first()
    assert [(e["label"], list(e["tokens"])) for e in made["elements"]] == [("özne", ["Biz"]), ("dolaylı tümleç", ["okula"]), ("yüklem", ["geldik"])]
