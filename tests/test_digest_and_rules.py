import hashlib

import pytest
from pyspark.sql import functions as F

from kinweft.config import ConfigError, read_config, read_policy
from kinweft.functions import digest, scalars
from kinweft.operators import rules
from kinweft.sources import demo


def test_canonical_json_orders_keys_and_drops_absent_ones():
    assert digest.canonical_json({"b": 2, "a": 1.0, "c": ...}) == '{"a":1,"b":2}'
    with pytest.raises(TypeError):
        digest.canonical_json(float("nan"))


def test_keys_sort_like_words():
    assert list(sorted(["directContributorIds", "configId", "Config", "config"], key=digest.word_order)) == ["config", "Config", "configId", "directContributorIds"]


def test_config_and_policy_digests_are_the_published_ones():
    from kinweft.config import digest as of

    assert of(read_config(demo.CONFIG)) == "f486bd5388e8249b68d8774d56e083cb9ba001c6b61f5f1c9acd07b1674bd314"
    assert of(read_policy(demo.POLICY)) == "4ff4e1d80601e2c82a7bb22352a3eb89f17ffe9050e2fe7d2c9393552fc6dbb0"


@pytest.mark.parametrize("change", [{"extra": 1}, {"directContributorIds": []}, {"directContributorIds": ["a", "a"]}, {"freshness": {"currentEmploymentMaxDays": 1, "reviewEmploymentMaxDays": 730, "relationshipMaxDays": 3}}])
def test_bad_configurations_are_refused(change):
    with pytest.raises(ConfigError):
        read_config(demo.CONFIG | change)


def test_column_digests_equal_driver_digests(spark):
    row = spark.createDataFrame([("x\"y\n", 1.0, None, ["a", "b"])], "some_text string, num double, gone string, many array<string>")
    body = digest.json_object({digest.camel(f.name): digest.json_value(F.col(f.name), f.dataType) for f in row.schema.fields})
    text, scoped = row.select(body, digest.scoped_id_column("w", "kind", body)).first()
    value = {"someText": "x\"y\n", "num": 1, "many": ["a", "b"]}
    assert text == digest.canonical_json(value)
    assert scoped == digest.scoped_id("w", "kind", value)
    assert digest.sha256_hex("a") == hashlib.sha256(b"a").hexdigest()


@pytest.mark.parametrize(
    "rule,value,want",
    [
        ({"operator": "equals", "value": ["Software", "x"]}, "ＳＯＦＴＷＡＲＥ", True), ({"operator": "equals"}, None, True), ({"operator": "in", "value": ["5"]}, 5, False), ({"operator": "in", "value": [5, True]}, [7, 5], True),
        ({"operator": "not_in", "value": ["a"]}, None, True), ({"operator": "not_in", "value": ["a"]}, ["b", "A"], False), ({"operator": "contains_token", "value": ["vp"]}, "Group VP, Sales", True), ({"operator": "contains_token", "value": ["vp sales"]}, "vp sales", False),
        ({"operator": "range", "value": {"min": 2, "max": 4}}, 4, True), ({"operator": "range", "value": {"min": 2}}, "3", False), ({"operator": "exists"}, "", False), ({"operator": "exists"}, [], True), ({"operator": "exists"}, None, False),
    ],
)
def test_rule_operators(spark, rule, value, want):
    df = spark.createDataFrame([(rules.attribute(value),)], f"a {rules.ATTRIBUTE}")
    assert df.select(rules.matches(rule, F.col("a"))).first()[0] is want


def test_scalars(spark):
    cells = ["=1", " +2", "\t3", "ok", "-x", "\x00=4", "​@a", "a=b"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(scalars.neutralize_formula(F.col("c"))).collect()]
    assert got == ["'=1", "' +2", "'\t3", "ok", "'-x", "'=4", "'​@a", "a=b"]
    assert scalars.terminal_safe("ok\u001b[31m\n") == "ok\\u001b[31m\\n"
    assert scalars.profile_url("https://Example.com/in/Ann/?x=1#y") == "https://example.com/in/Ann"
    assert scalars.profile_url("http://example.com") is None
    df = spark.createDataFrame([(x,) for x in (-2.5, 99.5, 140.0)], "x double").select(scalars.score(F.col("x")))
    assert [r[0] for r in df.collect()] == [0, 100, 100]


def test_escapes_and_composition_equal_python(spark):
    from kinweft.functions import scalars

    texts = [None, "", "a\tb\r\n", "".join(map(chr, range(0x00, 0x100))), "x y z", "ﬁ Å ① é", "日本\x85", "\\n", "plain"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", scalars.escape_terminal(F.col("t")).alias("e"), scalars.nfkc(F.col("t")).alias("n")).orderBy("i").collect()
    import unicodedata

    assert [r.e for r in rows] == [None if t is None else scalars.terminal_safe(t) for t in texts]
    assert [r.n for r in rows] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
