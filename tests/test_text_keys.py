"""Text forms and blocking keys, by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from bizmatch.functions import text as T
from bizmatch.functions.keys import blocking_keys

# raw, clean, norm, stripped, numbers
FORMS = [
    ("A&B  Co., Ltd.", "a b co ltd", "a b company limited", "a b", ""),
    ("abc solutions pvt ltd", "abc solutions pvt ltd", "abc solutions private limited", "abc solutions", ""),
    ("Private Limited", "private limited", "private limited", "", ""),
    ("As Good Cafe", "as good cafe", "as good cafe", "good cafe", ""),
    ("S.A.R.L. Dupont", "s a r l dupont", "s a r l dupont", "s a r l dupont", ""),
    ("O’Brien St", "o’brien st", "o’brien street", "o’brien st", ""),
    ("société anonyme dupont", "société anonyme dupont", "société anonyme dupont", "société anonyme dupont", ""),
    ("12B Main St. 560001-02", "12b main st 560001 02", "12b main street 560001 02", "12b main st 560001 02", "12 560001 02"),
    ("x co inc ltd sa ab as llc", "x co inc ltd sa ab as llc", "x company incorporated limited sa ab as limited liability company", "x", ""),
    ("x co inc ltd sa ab as llc gmbh", "x co inc ltd sa ab as llc gmbh", "x company incorporated limited sa ab as limited liability company gmbh", "x gmbh", ""),
    ("  Foo Bar_baz ", "foo bar baz", "foo bar baz", "foo bar baz", ""),
    ("a\x1cb", "a b", "a b", "a b", ""),
    ("", "", "", "", ""),
    (None, "", "", "", ""),
]


def test_forms(spark):
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(FORMS)], "k int, raw string")
    clean = T.clean_text("raw")
    got = df.select("k", clean.alias("c"), T.normalize_abbreviations(clean).alias("n"), T.strip_legal_suffixes(clean).alias("s"), T.extract_numerical_tokens(clean).alias("z"), T.first_token(clean).alias("f"), T.normalize_name_for_matching("raw").alias("m")).orderBy("k").collect()
    for r, (_, c, n, s, z) in zip(got, FORMS):
        assert (r["c"], r["n"], r["s"], r["z"]) == (c, n, s, z)
        assert r["f"] == (c.split() or [""])[0] and r["m"] == (s or c)


def test_ampersand_and_words(spark):
    df = spark.createDataFrame([("a & b&c", "the red inc fox ox store")], "x string, y string")
    r = df.select(T.normalize_ampersand("x").alias("a"), T.significant_words("y", 3).alias("w"), T.tokens(F.lit("")).alias("none")).first()
    assert r["a"] == "a and b and c" and r["w"] == ["red", "fox"] and r["none"] == []


KEYS = [
    (("abc", "12 main road", "12"), "p3:abc, exact:abc, w1:abc, num_w:12_main, num_p3:12_abc, aw1:main"),
    (("acme red foods", "85 wayne road 12345", "85 12345"), "p4:acme, p3:acm, exact:acme red foods, w1:acme, w2:red, wlast:foods, num:12345, num_w:85_wayne, num_p3:85_acm, aw1:wayne, aw2:12345"),
    (("ab", "1234 1234", "1234 1234"), "num:1234, num:1234, num_w:1234_1234, aw1:1234, aw2:1234"),
    (("", "", ""), ""),
    ((None, None, None), ""),
    (("the and inc", "st", ""), "p4:the , p3:the, exact:the and inc"),
    (("a" * 26, "", "7"), f"p4:aaaa, p3:aaa, w1:{'a' * 26}, num_p3:7_aaa"),
]


@pytest.mark.parametrize("record,keys", KEYS)
def test_keys(spark, record, keys):
    df = spark.createDataFrame([record], "n string, a string, z string")
    assert ", ".join(df.select(blocking_keys("n", "a", "z").alias("k")).first()["k"]) == keys


def test_preprocess_only_what_is_there(spark):
    df = spark.createDataFrame([("Acme Ltd",)], "business_name string")
    assert T.preprocess_dataframe(df).columns == ["business_name", "business_name_clean", "business_name_norm", "business_name_stripped"]
    assert T.preprocess_dataframe(spark.createDataFrame([(1,)], "x int")).columns == ["x"]
