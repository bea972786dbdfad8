import pytest
from pyspark.sql import functions as F

from stratadoc.functions import text as T


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "grams"), [("", []), (" 　", []), ("ab", ["ab"]), ("abc", ["abc"]), ("a b（c）d", ["abc", "bcd"]), ("aaaa", ["aaa", "aaa"])])
def test_char_ngrams(spark, text, grams):
    assert value(spark, T.char_ngrams(F.col("t")), t=text) == grams


def test_norm_drops_wide_spaces_and_marks(spark):
    assert value(spark, T.norm(F.col("t")), t="**NULL**　「x」 y") == "NULLxy"


def test_identifiers(spark):
    found = value(spark, T.identifiers(F.col("t")), t="`a.b()` user_id x 403 1234567 user_id 中文")
    assert found == ["a.b()", "user_id", "403"]


def test_tokenize_code_and_prose(spark):
    found = value(spark, T.tokenize(F.col("t")), t="`orderMapper.insert()` auth:staff:x 优惠券表 Redis!")
    assert found == ["ordermapper", "insert", "auth:staff:x", "优惠", "惠券", "券表", "redis"]


def test_code_spans_split_what_prose_keeps(spark):
    assert value(spark, T.tokenize(F.col("t")), t="`a1:b2:c3` a1:b2:c3") == ["a1", "b2", "c3", "a1:b2:c3"]


@pytest.mark.parametrize(("needle", "hay", "compat", "edit1"), [
    ("精洗价直接手动填写", "精洗价直接手动填写", True, True),
    ("精洗价直接手动填写", "x精洗价直手动填写y", True, True),
    ("精洗价直接手动填写", "精洗价直接手工填写", True, True),
    ("精洗价直接手动填写", "精洗价就直接手动填写", False, True),
    ("abcdefg", "abcdxfg", False, False),
    ("abcdefgh", "abcdxfgh", True, True),
    ("abcdefgh", "abxdxfgh", False, False),
    ("abcdefgh", "", False, False),
])
def test_fuzzy_in(spark, needle, hay, compat, edit1):
    assert value(spark, T.fuzzy_in(F.col("n"), F.col("h")), n=needle, h=hay) is compat
    assert value(spark, T.fuzzy_in(F.col("n"), F.col("h"), "edit1"), n=needle, h=hay) is edit1


def test_refusal_only_when_it_is_all(spark):
    assert value(spark, T.is_refusal(F.col("t")), t="资料里没有提到。") is True
    assert value(spark, T.is_refusal(F.col("t")), t="规则如下" * 20 + "资料里没有提到其他") is False


def test_heading_path_and_render(spark):
    row = spark.sql("select map(3, 'c', 1, 'a') as p, map() as q, 'body' as t")
    assert row.select(T.heading_path(F.col("p"))).first()[0] == "a > c"
    assert row.select(T.render(F.col("t"), F.col("p"))).first()[0] == "[章节] a > c\nbody"


def test_lone_fences(spark):
    assert value(spark, T.lone_fences(F.col("t")), t="```\na\n  ~~~\nb") == 2
