import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewater.errors import Corruption, InvalidArgument
from tidewater.functions import analysis, scoring
from tidewater.plans import query as Q
from tidewater.plans.schema import FieldMapping, Schema


def show(text):
    return str(Q.parse(text, "d"))


@pytest.mark.parametrize(
    "text,want",
    [
        ("", "*"), (" \t\n", "*"), ("cat", "d:cat"), ("f:cat", "f:cat"), ("f : cat", "f:cat"), ('"a field":x', "a field:x"), ("a b", "(d:a AND d:b)"), ("a AND b", "(d:a AND d:b)"),
        ("a OR b", "(d:a OR d:b)"), ("a b OR c", "((d:a AND d:b) OR d:c)"), ("a (b OR c)", "(d:a AND (d:b OR d:c))"), ("((a))", "d:a"), ("ORDER ANDY", "(d:ORDER AND d:ANDY)"), ("or and", "(d:or AND d:and)"),
        ('"two words', "d:two words"), ('f:"x y"', "f:x y"), ("OR x", "(d:OR AND d:x)"), ("AND x", "(d:AND AND d:x)"), ("NOT x", "(d:NOT AND d:x)"), ("-x", "d:-x"), ("v0.1_b-c", "d:v0.1_b-c"), ("a ANDb", "(d:a AND d:ANDb)"),
    ],
)
def test_parse(text, want):
    assert show(text) == want


@pytest.mark.parametrize(
    "text,at,what",
    [
        ("*", 0, "expected term"), ('""', 2, "expected term"), ("c++", 1, "expected term"), ("x AND", 2, "trailing characters"), ("x OR", 4, "expected term"), ("x AND OR y", 2, "trailing characters"), ("(a", 2, "expected ')'"),
        ("a)", 1, "trailing characters"), ("f:(a)", 2, "expected term after ':'"), ("a:b:c", 3, "expected term"), ("naïve", 2, "expected term"), ("x ü", 2, "expected term"), ("ü", 0, "expected term"), ("()", 1, "expected term"),
    ],
)
def test_errors(text, at, what):
    with pytest.raises(InvalidArgument, match=f"query parse error at offset {at}: {what.replace('(', '.').replace(')', '.')}"):
        Q.parse(text, "d")


@given(st.text(alphabet='ab:() "ORAND.-*é', max_size=20))
def test_parse_ends_in_a_tree_or_an_error(text):
    try:
        Q.parse(text, "d")
    except InvalidArgument as e:
        assert "query parse error at offset" in str(e)


def test_leaves_and_masks():
    schema = Schema.from_mappings({"mappings": {"t": {}, "k": {"type": "keyword"}}})
    node = Q.parse('cat "The Cat-dog" k:A-b OR x:y OR t:the', "t")
    every = Q.leaves(node, schema)
    assert every == [("t", "cat"), ("t", "cat"), ("t", "dog"), ("k", "A-b"), ("x", "y")]
    bit = {x: i for i, x in enumerate(dict.fromkeys(every))}
    assert Q.dnf(node, schema, bit) == [0b111]
    assert Q.dnf(Q.parse("(a OR b) (c OR d)", "t"), schema, {("t", x): i for i, x in enumerate("abcd")}) == [6, 10]  # a is a stop word
    assert Q.dnf(Q.parse("(p OR q) (r OR s)", "t"), schema, {("t", x): i for i, x in enumerate("pqrs")}) == [5, 6, 9, 10]


def test_analyze():
    assert analysis.analyze("The Quick-brown FOX's v0.1, Iechä release2024") == ["quick", "brown", "fox", "s", "v0", "1", "iech", "release2024"]
    assert analysis.analyze("K of 12") == ["12"]
    assert analysis.analyze("Keep AS is", "keyword") == ["Keep AS is"] and analysis.analyze("", "keyword") == []
    assert len(analysis.STOP_WORDS) == 18


def test_columns_agree_with_plain(spark):
    texts = ["", "The cat", "Iechä Kelvin K", "a" * 3000, "x-y_z 1.5", None, "İstanbul ÄB c"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", analysis.tokens(F.col("t"), "text").alias("s"), analysis.tokens(F.col("t"), "keyword").alias("k")).collect():
        assert r.s == (None if r.t is None else analysis.analyze(r.t)) and r.k == (None if r.t is None else analysis.analyze(r.t, "keyword"))
    rows = [(r.position, r.token, r.start, r.end) for r in analysis.token_table(spark.createDataFrame([(1, "é The cat-Sat")], "i int, t string"), ["i"], "t").orderBy("position").collect()]
    assert rows == [(1, "cat", 7, 10), (2, "sat", 11, 14)]


def test_schema():
    s = Schema.from_mappings({"mappings": {"title": {"boost": 2, "stored": True}, "body": {"type": "text", "stored": "yes", "position_decay": 0.5}, "tag": {"type": "keyword", "analyzer": "standard"}}, "store_doc_quality": True})
    assert [f.name for f in s.fields] == ["_id", "body", "tag", "title"] and s.store_doc_quality
    assert s.get("tag").analyzer == "keyword" and s.get("title").boost == 2.0 and not s.get("body").stored and s.default_field() == "body" and s.id_of("title") == 3
    assert Schema.from_json(s.to_json()) == s
    assert Schema().add_text_fields("a", "b").with_id().fields[0].name == "_id" and Schema([FieldMapping("_id", "keyword")]).default_field() == "_id"
    for bad in ({}, {"mappings": []}, {"mappings": {"a": 3}}, {"mappings": {"a": {"type": "number"}}}, {"mappings": {"": {}}}):
        with pytest.raises(InvalidArgument):
            Schema.from_mappings(bad)
    with pytest.raises(InvalidArgument):
        Schema().add_text_fields("a", "a")
    for bad in ("[", "{}", '{"fields": [{"name": "a"}]}', '{"fields": [{"x": 1}]}'):
        with pytest.raises(Corruption):
            Schema.from_json(bad)


def test_varbyte():
    for v in (0, 1, 127, 128, 300, 2**32 - 1, 2**64 - 1):
        raw = scoring.varbyte_encode(v)
        assert scoring.varbyte_decode(b"\x05" + raw, 1) == (v, 1 + len(raw))
    assert len(scoring.varbyte_encode(2**64 - 1)) == 10
    for bad, bits in ((b"", 64), (b"\x80", 64), (scoring.varbyte_encode(2**32), 32), (b"\xff" * 11, 64)):
        with pytest.raises(ValueError):
            scoring.varbyte_decode(bad, 0, bits)
