"""Functions of plain SQL against the column functions of the same rules."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from larder.functions import dirty_json, matching, money, sql, text, units

c = F.col


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    return spark


def same(spark, rows, schema, call, column):
    df = spark.createDataFrame(rows, schema)
    df.createOrReplaceTempView("rows_of_test")
    got = [tuple(r) for r in spark.sql(f"SELECT {call} AS x FROM rows_of_test").collect()]
    want = [tuple(r) for r in df.select(column.alias("x")).collect()]
    assert len(got) == len(rows) and all(a == b or isinstance(a[0], float) and abs(a[0] - b[0]) <= 1e-9 * abs(b[0]) for a, b in zip(got, want)), [x for x in zip(rows, got, want) if x[1] != x[2]][:3]


def test_arithmetic(session):
    numbers = [*itertools.product([None, 0.0, 0.5, 2.0, 10.0, 11.0, -1.0], repeat=2)]
    same(session, numbers, "a double, b double", "whole_packages(a, b)", money.packages(c("a"), c("b")))
    same(session, [x for x in numbers if None not in x], "a double, b double", "budget_surplus(a, b)", money.surplus(c("a"), c("b")).cast("double"))
    same(session, numbers, "a double, b double", "goal_percent(a, b)", money.goal_percent(c("a"), c("b")))
    kinds = [None, "g", "lb", "ml", "cup", "fl oz", "each", "dozen", "other"]
    rows = [(q, a, b, d) for q in (1.5, None) for a in kinds for b in kinds for d in (None, 0.5, 0.0)]
    same(session, rows, "q double, a string, b string, d double", "convert_units(q, a, b, d)", units.converted(c("q"), c("a"), c("b"), c("d")))
    same(session, rows, "q double, a string, b string, d double", "convert_units(q, a, b)", units.converted(c("q"), c("a"), c("b")))
    same(session, rows, "q double, a string, b string, d double", "base_unit_price(3.5D, q, a)", units.price_per_base_unit(F.lit(3.5), c("q"), c("a")))


def test_texts(session):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcsxzhoieyéÉßœ -!'19S") for _ in range(rng.randint(0, 12))) for _ in range(600)] + [None, "tomatoes", "berries", "dishes", "glass"]
    rows = [(a, b) for a, b in zip(names, reversed(names))]
    same(session, rows, "a string, b string", "plain_name(a)", text.plain_name(c("a")))
    same(session, rows, "a string, b string", "singular_word(a)", text.singular(c("a")))
    words = [(" ".join(rng.choice("red Onion salt sea".split()) for _ in range(rng.randint(1, 4))), "Sea  salt!") for _ in range(50)]
    same(session, words, "a string, b string", "word_overlap(a, b)", text.jaccard(F.split(text.plain_name(c("a")), " "), F.split(text.plain_name(c("b")), " ")))
    docs = [('{"a": [{"budget": 1}]}',), ('{"a": "budget", "b": "x\\"budget\\": 1"}',), ("[1]",), ('{"spend" : {}}',), ("{}",), (' {"k": {"l": [[{"jar": 0}]]}}',)]
    same(session, docs, "a string", "payload_is_safe(a, array('budget', 'spend', 'jar'))", dirty_json.is_shareable(c("a"), ["budget", "spend", "jar"]))


def test_recipe_lines(session):
    lines = ["1 1/2 cups flour", " 2 - 3 oz. sea salt", "4 eggs", "salt to taste", "1/2 tsp  pepper", "12", "Sugar 2 kg"]
    session.createDataFrame([(1, "\n".join(lines) + "\n\n"), (2, None), (3, "")], "id int, recipe string").createOrReplaceTempView("recipes_of_test")
    got = session.sql("SELECT id, l.* FROM recipes_of_test, LATERAL recipe_lines(recipe) AS l ORDER BY id, line").collect()
    want = session.createDataFrame([(x,) for x in lines], "x string").select(matching.ingredient_line(c("x")).alias("l")).select("l.*").collect()
    assert [(r.id, r.line) for r in got] == [(1, i + 1) for i in range(len(lines))] and [(r.quantity, r.unit, r.name) for r in got] == [tuple(w) for w in want]


def test_a_query_in_sql_alone(session):
    session.read.parquet("/root/testdata/sf0.001/part.parquet").createOrReplaceTempView("part_of_test")
    r = session.sql("SELECT sum(whole_packages(p_size, 12)) AS n, count_if(word_overlap(p_name, 'red widget') > 0.3) AS alike, max(convert_units(p_size, 'oz', 'g')) AS most FROM part_of_test").first()
    rows = session.table("part_of_test").collect()
    assert r.n == sum(max(1, -(-x.p_size // 12)) for x in rows) and abs(r.most - 28.349523125 * max(x.p_size for x in rows)) < 1e-6 and r.alike == sum(bool({"red", "widget"} & set(x.p_name.split())) for x in rows)
