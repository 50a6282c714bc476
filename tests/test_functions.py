"""Column functions against worked examples and plain models."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossweave.functions import arrays, documents, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "x", "y"),
    [
        (text.trim, "　a\t\n", "a"),
        (text.safe_text, " - ", ""),
        (text.safe_text, None, ""),
        (text.strict_int, "12", 12),
        (text.strict_int, "12x", 0),
        (text.strict_int, " 12", 0),
        (text.strict_int, "-7", -7),
        (text.prefix_int, "12x", 12),
        (text.prefix_int, "x", 0),
        (text.story_source, " CN ", "official_cn"),
        (text.story_source, "official_cn_legacy", "official_cn"),
        (text.story_source, "PINNED", "pinned"),
        (text.story_source, None, "jp_pending"),
        (lambda c: text.truncate(c, 2), "日本語", "日本…"),
        (lambda c: text.truncate(c, 3), "日本語", "日本語"),
        (text.id_of_file, "eventStory/event_12.json", 12),
        (text.id_of_file, "event_x.json", -1),
        (lambda c: F.array_join(text.split_list(c), "+"), "a, b;\r\n c,", "a+b+c"),
        (lambda c: text.as_bool(c, True), " Off", False),
        (lambda c: text.as_bool(c, True), "?", True),
        (lambda c: text.as_int(c, 5), "x", 5),
        (text.is_transient, "got http 503 from a", True),
        (text.is_transient, "http 404", False),
        (lambda c: text.parse_row_key(c)["kind"], "3|__title__|a|b", "title"),
        (lambda c: text.parse_row_key(c)["text"], "3|__title__|a|b", "a|b"),
        (lambda c: text.parse_row_key(c)["text"], "3|a|b", "a|b"),
        (lambda c: text.etag_matches(F.lit('"a", "b"'), c), '"b"', True),
        (lambda c: F.size(text.ids_from_json(c)), "", 0),
    ],
)
def test_text(spark, f, x, y):
    assert one(spark, x, f) == y


def test_equal_text_is_blank(spark):
    assert spark.range(1).select(text.blank_if_equal(F.lit(" a "), F.lit("a")).alias("y")).first().y == ""


def test_xml_reply(spark):
    reply = '<think>no <t id="1">x</t></think><t id="1"> A &amp; B </t>\n<t  id="3">first</t><t id="3">c\nd</t><t id="9">out</t><t id="0">out</t>'
    assert one(spark, reply, lambda c: text.parse_xml_items(c, F.lit(3))) == ["A & B", "", "c\nd"]
    assert one(spark, "", lambda c: text.parse_xml_items(c, F.lit(2))) == ["", ""]
    assert one(spark, "", lambda c: text.parse_xml_items(c, F.lit(0))) == []
    assert one(spark, ["a<b", "c & d"], text.xml_items, "array<string>") == '<item id="1">a&lt;b</item>\n<item id="2">c &amp; d</item>\n'


@pytest.mark.parametrize(("value", "strict", "prefix"), [("12.9", 12, 12), ('"12"', 12, 12), ('"12x"', 0, 12), ('" 12"', 0, 12), ("null", 0, 0), ("true", 0, 0), ('"x"', 0, 0), ("[1]", 0, 0)])
def test_integers_of_documents(spark, value, strict, prefix):
    doc = lambda c: documents.document(c)
    assert one(spark, f'{{"k": {value}}}', lambda c: documents.get_int(doc(c), "k")) == strict
    assert one(spark, f'{{"k": {value}}}', lambda c: documents.get_prefix_int(doc(c), "k")) == prefix


def test_strings_and_objects_of_documents(spark):
    get = lambda t, f: one(spark, t, lambda c: f(documents.document(c)))
    assert get('{"k": 7}', lambda d: documents.get_string(d, "k")) == ""
    assert get('{"k": "v"}', lambda d: documents.get_string(d, "k")) == "v"
    assert get("nonsense", lambda d: documents.get_string(d, "k")) == ""
    assert get('[{"a": 1}, 2, {"a": 3}]', lambda d: F.size(documents.objects(d))) == 2
    assert get('{"a": 1}', lambda d: F.size(documents.objects(d))) == 0


LIST = st.lists(st.sampled_from(["1", "2", "3", ""]), max_size=5)


@settings(max_examples=15, deadline=None)
@given(LIST, LIST)
def test_ids_merge_in_order(spark, have, add):
    want = list(have)
    for x in add:
        if x and x not in want:
            want.append(x)
    got = spark.createDataFrame([(have, add)], "a array<string>, b array<string>").select(arrays.merge_ids(F.col("a"), F.col("b")).alias("y")).first().y
    assert got == want


def test_ordered_keys_and_digest(spark):
    row = spark.createDataFrame([(["c", "x", "a"], ["a", "b", "c"])], "o array<string>, k array<string>")
    assert row.select(arrays.ordered_keys(F.col("o"), F.col("k")).alias("y")).first().y == ["c", "a", "b"]
    assert row.select(arrays.digest(F.col("k"), 2).alias("y")).first().y == "a; b; 1 more"
    assert one(spark, ["x", " ", "y"], arrays.complete_enough, "array<string>") is True
    assert one(spark, ["x", " ", ""], arrays.complete_enough, "array<string>") is False


def test_natural_order(spark):
    names = ["a10", "a2", "a02b", "b1", "a402", "a42"]
    got = [r.x for r in spark.createDataFrame([(n,) for n in names], "x string").orderBy(text.natural_key(F.col("x"))).collect()]
    assert got == ["a2", "a02b", "a10", "a42", "a402", "b1"]


def test_natural_order_follows_the_unicode_collation(spark):
    want = ["a", "A", "a2", "á2", "a10", "B", "e", "é", "z", "あ", "ア", "か2", "か10", "漢"]
    got = [r.x for r in spark.createDataFrame([(n,) for n in reversed(want)], "x string").orderBy(text.natural_key(F.col("x"))).collect()]
    assert got == want


def test_links(spark):
    rows = spark.createDataFrame([("cards", "f", ["3", "4"]), ("virtualLive", "f", ["5"]), ("characters", "f", ["6"]), ("eventStory", "77", None), ("skills", "f", ["1"]), ("music", "f", []), ("music", "f", None)], "c string, f string, ids array<string>")
    got = [r.x for r in rows.select(text.link(F.col("c"), F.col("f"), F.col("ids"), "https://x/").alias("x")).collect()]
    assert got == ["https://x/cards/3/", "https://x/live/5/", "https://x/character/6/", "https://x/eventstory/77/", None, None, None]
