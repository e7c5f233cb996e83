from tilsim.operators import entities

WANT = {(0, 1, "Ali", "PER"), (2, 1, "Mustafa Kemal", "PER"), (3, 2, "Ali", "PER"), (5, 1, "İzmir", "LOC"), (8, 1, "Ege Üniversitesi", "LOC")}


def test_texts_are_tokenized_once(spark):
    """Small letters and apostrophes go before anything costly, whatever the quote."""
    texts = "Ali’nin evi | 'Ankara'da | Mustafa Kemal'e | Çok Ali ’ x | ahmet | İzmir | Ve |  | Ege Üniversitesi'nde".split("|")
    table = spark.createDataFrame([*enumerate(x.strip() for x in texts), (99, None)], "doc_id int, text string")
    made = entities.tag(table)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert {(r.doc_id, r["index"], r.surface, r.type) for r in made.collect()} == WANT
