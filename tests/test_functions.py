from pyspark.sql import functions as F

from larder.functions import money, text


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_names(spark):
    assert one(spark, text.plain_name(F.lit("  Crème Brûlée, 2-Pack! "))) == ("creme brulee 2 pack",)
    words = ["berries", "tomatoes", "dishes", "glass", "eggs", "gas", "pies"]
    assert one(spark, *[text.singular(F.lit(w)) for w in words]) == ("berry", "tomato", "dish", "glass", "egg", "gas", "pie")


def test_similarities(spark):
    a, b, none = F.array(F.lit("red"), F.lit("onion")), F.array(F.lit("onion")), F.array().cast("array<string>")
    assert one(spark, text.jaccard(a, b), text.containment(a, b), text.jaccard(none, none), text.dice(a, b)) == (0.5, 1.0, 0.0, 2 / 3)
    assert one(spark, text.trigram_similarity(F.lit("word"), F.lit("word")))[0] == 1.0
    assert one(spark, F.size(text.grams(F.lit("ab"), 3)))[0] == 0


def test_codes(spark):
    assert one(spark, text.price(F.lit("$1.2.3")), text.price(F.lit("free")), text.zip_code(F.lit("12345-6789")), text.zip_code(F.lit("x"))) == (1.2, None, "12345", "")
    assert one(spark, text.iso_minutes(F.lit("PT1H30M")), text.iso_minutes(F.lit("about 45 min"))) == (90, 45)
    assert one(spark, text.idempotency_key(F.lit(" A "), F.lit(""), F.lit(None).cast("string"), F.lit(7))) == ("a:7",)


def test_money(spark):
    size = F.lit(None).cast("double")
    assert one(spark, money.packages(F.lit(10.0), F.lit(4.0)), money.packages(F.lit(10.0), size), money.packages(F.lit(0.0), F.lit(4.0))) == (3, 1, 1)
    assert one(spark, money.bankable(F.lit(10000), F.lit(2000)), money.surplus(F.lit(1), F.lit(2))) == (3000, 0)
    assert one(spark, money.goal_percent(F.lit(50), F.lit(0)), money.goal_percent(F.lit(125), F.lit(1000)), money.goal_percent(F.lit(-1), F.lit(10))) == (0, 13, 0)
    assert one(spark, money.nudge_days(F.lit(None).cast("double")), money.nudge_days(F.lit(1.0)), money.nudge_days(F.lit(100.0))) == (21, 10, 35)
    assert one(spark, money.sane_price(F.lit(0.0), F.lit(1.0)), money.sane_price(F.lit(2.0), F.lit(None).cast("double")), money.sane_price(F.lit(9.0), F.lit(1.0))) == (False, True, False)
    assert str(one(spark, money.week_start(F.lit("2026-04-29").cast("date")))[0]) == "2026-04-27"
