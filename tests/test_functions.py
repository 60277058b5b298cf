import pytest
from pyspark.sql import functions as F

from quarry.functions import hashes, lineproto, maps, parse


def one(spark, column, value="", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


@pytest.mark.parametrize(
    "line,want",
    [
        ('{"a": 1.0, "b": "x", "c": null}', {"a": "1.0", "b": "x", "c": None}),
        ('{"a": 1, "a": 2}', {"a": "2"}),
        ("[1]", None),
        ("3", None),
        ('{"a": 1', None),
        ("{'a': 1}", None),
        ('{"a": 1} xyz', None),
        (None, None),
        ("", None),
    ],
)
def test_parse_json(spark, line, want):
    assert one(spark, parse.parse_json(F.col("v")), line) == want


@pytest.mark.parametrize(
    "text,kind,want",
    [
        (" 42 ", "integer", 42), ("+7", "integer", 7), ("1.0", "integer", None), ("9223372036854775808", "integer", None), ("", "integer", None),
        ("1.5", "float", 1.5), ("1.5f", "float", None), ("1e3", "float", 1000.0), (".5", "float", 0.5), ("1.5d", "float", None), ("-inf", "float", float("-inf")),
        ("T", "boolean", True), ("False", "boolean", False), ("1", "boolean", None), ("yes", "boolean", None), ("x", "string", "x"), (None, "integer", None),
    ],
)
def test_coerce(spark, text, kind, want):
    assert one(spark, parse.coerce(F.col("v"), kind), text) == want


@pytest.mark.parametrize(
    "text,fmt,want",
    [
        ("1700000000", "unix_s", 1700000000 * 10**9), (" 5 ", "unix_ms", 5 * 10**6), ("1.5", "unix_ms", None), ("9223372036854775807", "unix_s", None),
        ("2024-01-01T00:00:00Z", "rfc3339", 1704067200 * 10**9), ("2024-01-01T01:00:00.123456789+01:00", "rfc3339", 1704067200 * 10**9 + 123456789),
        ("2024-01-01", "rfc3339", None), ("x", "rfc3339", None), (None, "rfc3339", None),
    ],
)
def test_timestamps(spark, text, fmt, want):
    assert one(spark, parse.parse_ts_ns(F.col("v"), fmt), text) == want


def test_unknown_format_is_an_error():
    with pytest.raises(ValueError):
        parse.parse_ts_ns(F.lit("1"), "hours")


@pytest.mark.parametrize("x,want", [(1.0, "1"), (1e20, "100000000000000000000"), (1e-7, "0.0000001"), (0.1, "0.1"), (-2.5, "-2.5"), (1.25e-5, "0.0000125"), (123456789.125, "123456789.125"), (0.0, "0"), (-0.0, "-0"), (1.5e16, "15000000000000000")])
def test_plain_float(spark, x, want):
    assert one(spark, parse.plain_float(F.col("v")), x, "double") == want


def test_lossy_decoding(spark):
    assert one(spark, parse.decode_lossy(F.col("v")), bytearray(b"a\xffb"), "binary") == "a�b"


def test_fnv_vector(spark):
    df = spark.createDataFrame([({"a": "b"}, 0)], "tags map<string,string>, ts long")
    hashed = hashes.fnv1a([b"a\0b\0" + bytes(8)])[0]
    assert int(hashed) == 18082658368423242550
    got = df.select(hashes.fnv1a_mod(hashes.identity(F.col("tags"), []), F.col("ts"), 1000)).first()[0]
    assert got == 18082658368423242550 % 1000
    assert [int(h) for h in hashes.fnv1a([b"", b"abc", b"a"])] == [14695981039346656037, int(hashes.fnv1a([b"abc"])[0]), int(hashes.fnv1a([b"a"])[0])]


def test_fnv_of_long_values(monkeypatch):
    monkeypatch.setattr(hashes, "GRID", 40)
    values = [bytes(range(n)) for n in (0, 3, 100, 41, 40, 7, 7, 90)]
    for v, h in zip(values, hashes.fnv1a(values), strict=True):
        want = hashes.OFFSET
        for b in v:
            want = (want ^ b) * hashes.PRIME % 2**64
        assert int(h) == want


def test_merge_last_wins(spark):
    df = spark.createDataFrame([({"a": "1", "b": "1"}, {"b": "2"}, None)], "x map<string,string>, y map<string,string>, z map<string,string>")
    assert df.select(maps.shown(maps.merge(F.col("x"), F.col("y"), F.col("z")))).first()[0] == "a=1,b=2"


def test_line_protocol_escapes(spark):
    tags = F.create_map(F.lit("k,1"), F.lit("a b=c\n"))
    fields = {"s": (F.lit('q"\\x\ny\r\t'), "string"), "n": (F.lit(None).cast("bigint"), "integer"), "f": (F.lit(1e20), "float")}
    line = one(spark, lineproto.encode_line(F.lit("t x"), tags, fields, F.lit(5)))
    assert line == 't\\ x,k\\,1=a\\ b\\=c\\  s="q\\"\\\\x\\ny ",f=100000000000000000000 5'


@pytest.mark.parametrize("fields,reason", [({}, "no fields"), ({"f": (F.lit, float("nan"))}, "not finite")])
def test_unencodable(spark, fields, reason):
    made = {k: (F.lit(v), "float") for k, (_, v) in fields.items()}
    assert one(spark, lineproto.encode_line(F.lit("t"), maps.empty_map(), made, F.lit(5))) is None
    assert reason in one(spark, lineproto.unencodable(F.lit("t"), made))


def test_inject_tags(spark):
    tags = F.create_map(F.lit("h"), F.lit("n 1"))
    assert one(spark, lineproto.inject_tags(F.col("v"), tags), "a\\ b,x=1 f=1") == "a\\ b,x=1,h=n\\ 1 f=1"
    assert one(spark, lineproto.inject_tags(F.col("v"), tags), "nospace") == "nospace"


def test_parse_line(spark):
    r = one(spark, lineproto.parse_line(F.col("v")), 't\\ x,a=b\\,c f="x, y=z",n=42i,b=true 12')
    assert (r.table, r.tags, r.fields, r.ts_ns) == ("t x", {"a": "b,c"}, {"f": '"x, y=z"', "n": "42i", "b": "true"}, 12)
    assert one(spark, lineproto.parse_line(F.col("v")), "nothing") is None


ODD_JSON = [
    '{"a":"x","b":1}', '{"a":1.0,"b":1e3}', '{"a":null,"b":null}', '{"a":"null"}', '{"b":{"c":[1,"2",null]},"a":[]}', '{"a":1,"a":2}', '{"a":1,"a":null}', '{"a":null,"a":3}', "{}", "[]", '[{"a":1}]', '[{"a":1}] {"b":2}',
    '{"a":1} xyz', '{"a":1', "{'a':1}", '{"a":tru}', "", "   ", "null", '  {"a":"s p"}  ', '\t{"a":1}', '{"A":1,"a":2}', '{"a":"\\u0041\\n"}', '{"x":"null","a":true}', '{"b":-0,"a":12345678901234567890}', "3", '"s"', '{"a":"}"', '{"a.b":7}',
]


def test_reading_named_keys_says_what_the_map_says(spark):
    keys = ["a", "b", "a.b", "z"]
    df = spark.createDataFrame([(x,) for x in ODD_JSON] + [(None,)], "line string")
    of_map, of_read = parse.MapKeys(F.col("m")), parse.ReadKeys(F.col("r"))
    x = df.withColumns({"m": parse.parse_json(F.col("line")), "r": parse.read_json(F.col("line"), keys)})
    for k in [None, *keys]:
        if k is None:
            pair = [F.coalesce(s.ok, F.lit(False)) for s in (of_map, of_read)]
            same = x.where(~pair[0].eqNullSafe(pair[1]))
            assert same.select("line").collect() == [], same.collect()
            continue
        for name in ("has", "text", "value"):
            left, right = (F.when(F.coalesce(s.ok, F.lit(False)), getattr(s, name)(k)) for s in (of_map, of_read))
            if name == "has":
                left, right = F.coalesce(left, F.lit(False)), F.coalesce(right, F.lit(False))
            wrong = x.where(~left.eqNullSafe(right)).select("line", left.alias("map"), right.alias("read"))
            assert wrong.collect() == [], (k, name)
