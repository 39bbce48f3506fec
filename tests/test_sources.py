import json

import pytest
from pyspark.sql import functions as F

from glyphtrail.sources import captures, evolution, rejects

GOOD = {"t": "obs", "cap": 3, "blocks": [{"rect": [0, 1, 2.5, 3], "pconf": 0.5, "otext": "a"}]}


def bad(**change):
    return json.dumps({**GOOD, **change})


def entry(**change):
    return bad(blocks=[{**GOOD["blocks"][0], **change}])


JSON = [
    (json.dumps(GOOD), None), (bad(cap=-1), "cap_invalid"), (bad(cap=1.5), "cap_invalid"), (bad(cap=2.0), None), (bad(cap=True), "cap_invalid"), (bad(cap="3"), "cap_invalid"),
    (bad(t=3), "t_invalid"), (bad(t=None), "t_invalid"), (bad(blocks=[]), None), (bad(blocks=None), None), (entry(rect=[1, 2, 3]), "rect_invalid"), (entry(rect=["1", 2, 3, 4]), "rect_invalid"),
    (entry(rect=None), "rect_invalid"), (entry(pconf="0.5"), "pconf_invalid"), (entry(pconf=1.01), "pconf_invalid"), (entry(pconf=True), "pconf_invalid"), (entry(otext=None), None),
    (json.dumps(GOOD) + "}", "extra_data"), (json.dumps(GOOD) * 2, "extra_data"), (json.dumps(GOOD)[:-1], "unbalanced"), ('{"t": "obs', "unterminated_string"), ("[1]", "not_an_object"),
    ('{"t": "x", "cap": 1, "v": NaN}', "not_json_constant"), ("{'t': 'x', 'cap': 1}", "invalid_json"), ('{"t": "x", "cap": 1,}', "invalid_json"), ('{"t": "a\\\\", "cap": 1}', None),
    ('{"t": "a\\"}", "cap": 1}', None), ('{"t": "x", "cap": 1, "z": ' + "[" * 30000 + "]" * 30000 + "}", "nested_too_deep"), ('{"t": "' + "y" * 300000 + '", "cap": 1}', None),
]

CSV = [
    ("1,0,1,2,3,text,0.5,0.5", None), ('1,0,1,2,3,"a ""b"", c",0.5,', None), ('1,0,1,2,3,"two\nlines",1e-1,0.5', None), ("1,0,1,2,3,,1,0.5", None), ('"1",0,1,2,3,x,"0.25",0.5', None),
    ("1,0,1,2,3,text,0,5,0.5", "column_count"), ("1,0", "column_count"), ('1,0,1,2,3,"open,0.5,0.5', "quote_unclosed"), ('1,0,1,2,3,"a" b,0.5,0.5', "quote_misplaced"), ('1,0,1,2,3,a "b" c,0.5,0.5', "quote_misplaced"),
    ("1.5,0,1,2,3,x,0.5,0.5", "cap_invalid"), ("-1,0,1,2,3,x,0.5,0.5", "cap_invalid"), (",0,1,2,3,x,0.5,0.5", "cap_invalid"), ("1,0,1,2,Infinity,x,0.5,0.5", "rect_invalid"), ("1,0,12px,2,3,x,0.5,0.5", "rect_invalid"),
    ("1,0,1,2,3,x,80%,0.5", "pconf_invalid"), ("1,0,1,2,3,x,NaN,0.5", "pconf_invalid"), ("1,0,1,2,3,x,-0.1,0.5", "pconf_invalid"),
]


def lines(spark, rows):
    data = [(i, f, i + 2, s, "x") for i, (f, s) in enumerate(rows)]
    return spark.createDataFrame(data, "raw_id long, file_name string, line_no int, line string, reason string")


@pytest.mark.parametrize("name,cases", [("a.jsonl", JSON), ("a.csv", CSV)])
def test_reasons(spark, name, cases):
    got = {r.raw_id: r.reason for r in rejects.load_lines(lines(spark, [(name, s) for s, _ in cases])).collect()}
    assert [got[i] for i in range(len(cases))] == [reason for _, reason in cases]


def test_one_bad_quote_does_not_leak_into_the_next_record(spark):
    rows = lines(spark, [("a.csv", '1,0,1,2,3,"open,0.5,0.5'), ("a.csv", "1,0,1,2,3,fine,0.5,0.5"), ("a.jsonl", '{"t": "open'), ("a.jsonl", json.dumps(GOOD))]).coalesce(1)
    assert [r.raw_id for r in rejects.rejected(rows).orderBy("raw_id").collect()] == [0, 2]


def test_blank_header_null_and_unknown(spark):
    rows = [("a.csv", rejects.CSV_HEADER), ("a.csv", "  "), ("a.jsonl", None), ("a.jsonl", "\t"), ("a.txt", "hello"), (None, "hello")]
    got = rejects.load_lines(lines(spark, rows)).collect()
    assert sorted((r.raw_id, r.reason) for r in got) == [(4, "unknown_format"), (5, "unknown_format")]
    assert rejects.load_lines(lines(spark, [])).count() == 0
    assert rejects.loaded_blocks(lines(spark, [("a.jsonl", json.dumps(GOOD))] * 2)).count() == 2


def test_rejects_on_the_test_table(spark, data):
    raw = spark.read.parquet(f"{data}/raw_lines.parquet")
    found = rejects.load_lines(raw)
    good = found.where("reason is null").count()
    assert good + rejects.rejected(raw).count() == found.count() and good > 0


def files(spark, *versions):
    """versions: one list of records per file of a recorder."""
    rows = [(100 * n + i, n, "r", n, i, json.dumps(x) if x is not None else None, "clash") for n, records in enumerate(versions, 1) for i, x in enumerate(records)]
    return spark.createDataFrame(rows, "line_id long, file_id long, recorder string, file_no int, line_no int, line string, rec string")


def changes(df):
    return sorted((r.file_id, r.rec, r.field_name, r.change_kind, r.new_name) for r in evolution.schema_changes(df).collect())


def test_added_removed_renamed_retyped(spark):
    one = {"t": "obs", "ts": 1760000000000, "cap": 5, "raw": 7, "blocks": [{"rect": [1, 2, 3, 4], "pconf": 0.5, "nav": "top"}]}
    two = {"t": "obs", "ts_ms": 1760000009000, "cap": "5", "zoom": {"w": 1}, "blocks": [{"box": [1, 2, 3, 5], "pconf": 0.6, "nav": None}]}
    got = changes(files(spark, [one, one], [two, two]))
    assert got == [(2, "obs", "blocks.rect", "renamed", "blocks.box"), (2, "obs", "cap", "retyped", None), (2, "obs", "raw", "removed", None), (2, "obs", "ts", "renamed", "ts_ms"), (2, "obs", "zoom", "added", None)]


def test_discriminator_and_names_follow_renames(spark):
    a, b, c = {"t": "meta", "v": 1}, {"kind": "meta", "ver": 2}, {"kind": "meta", "version": "3"}
    df = files(spark, [a], [b], [c])
    assert changes(df)[:2] == [(2, "meta", "t", "renamed", "kind"), (2, "meta", "v", "renamed", "ver")]
    rows = {r.file_id: (r.t, r.fields.v) for r in evolution.unified_records(df).collect()}
    assert rows == {1: ("meta", 1), 2: ("meta", 2), 3: ("meta", None)}
    steady = evolution.unified_records(files(spark, [a], [b]))
    assert dict(steady.select("fields.*").dtypes)["v"] == "bigint" and [r.v for r in steady.orderBy("file_id").select("fields.v").collect()] == [1, 2]


def test_cast_to_the_union_schema(spark):
    one = {"t": "obs", "a": 1, "line_id": True, "big": 10**400, "blocks": [{"rect": [1, 2], "odd": 1}, 7, {"odd": {"x": 1}}]}
    two = {"t": "obs", "a": 2.5, "line_id": False, "big": 3, "blocks": [], "note": None}
    table = evolution.unified_records(files(spark, [one], [two]))
    assert dict(table.select("fields.*").dtypes) == {"t": "string", "a": "double", "line_id": "boolean", "big": "double", "note": "string", "blocks": "array<struct<odd:string,rect:array<double>>>"}
    first, second = table.orderBy("file_id").collect()
    assert first.fields.a == 1.0 and first.fields.big == float("inf") and second.fields.big == 3.0 and second.fields.blocks == []
    assert [(b.odd, b.rect) for b in first.fields.blocks] == [("1", [1.0, 2.0]), (None, None), ('{"x": 1}', None)]
    log = evolution.change_log(files(spark, [one], [two], [one])).collect()
    assert [(r.file_no, r.field_name) for r in log] == sorted((r.file_no, r.field_name) for r in log)


def test_numbers_of_any_size(spark):
    long = "9" * 401
    cases = [bad(cap=1e30), bad(cap=2**63), '{"t":"obs","cap":' + long + "}", '{"t":"obs","cap":1e400}', '{"t":"obs","cap":' + "9" * 5000 + "}", entry(rect=[int(long), 1, 2, 3])]
    rows = lines(spark, [("a.jsonl", s) for s in cases] + [("a.csv", "1e30,1,2,3,4,x,0.5,0.5"), ("a.csv", "9007199254740993,1,2,3,4,x,0.5,1e999"), ("a.csv", "1,1e400,2,3,4,x,0.5,0.5")])
    got = {r.raw_id: r for r in rejects.load_lines(rows).collect()}
    assert [got[i].reason for i in range(9)] == [None] * 8 + ["rect_invalid"]
    assert [got[i].cap for i in (0, 1, 2, 3, 6)] == [None] * 5 and got[7].cap == 9007199254740993
    assert got[1].cap_text == str(2**63) and got[2].cap_text == long and got[4].cap_text == "9" * 5000 and got[5].blocks[0].rect[0] == float("inf")
    table = files(spark, [{"t": "obs", "x": 10**400}], [{"t": "obs", "x": 1}])
    assert changes(table) == [] and changes(table.withColumn("line", F.replace("line", F.lit('"x": 1}'), F.lit('"x": ' + "7" * 5000 + "}")))) == []


def test_drift_edges(spark):
    assert changes(files(spark, [{"t": "obs", "x": None}], [{"t": "obs", "x": 3}])) == []
    assert changes(files(spark, [{"t": "obs", "blocks": []}], [{"t": "obs", "blocks": None}, None, {"t": "odd"}])) == []
    assert changes(files(spark)) == [] and evolution.unified_cells(files(spark)).count() == 0
    same = [{"t": "obs", "x": 1}] * 3
    assert changes(files(spark, same, same)) == []
    assert evolution.promote(["number", None]) == "number" and evolution.promote(["number", "array"]) == "string" and evolution.promote([None]) is None


def test_profiles_of_many_words_are_compared_whole(spark):
    words = ["".join("abcdefghij"[int(d)] for d in f"{i:04d}") for i in range(1000)]
    df = files(spark, [{"t": "obs", "word": w} for w in words], [{"t": "obs", "quill": w} for w in words[::10]])
    assert changes(df) == [(2, "obs", "word", "renamed", "quill")]
    assert {r.field_name for r in evolution.unified_cells(df).collect()} == {"t", "word"}
    other = [{"t": "obs", "quill": w[::-1] + "z"} for w in words[::10]]
    assert [c[3] for c in changes(files(spark, [{"t": "obs", "word": w} for w in words], other))] == ["added", "removed"]


def test_capture_stream(spark):
    text = ['{"t":"meta","bk":[100,90]}', "", "{broken", '{"t":"obs","cap":1,"blocks":[{"rect":[1,2,3,4],"otext":"a","pconf":0.5,"tconf":0.5,"cvotes":{"10":2}}]}', '{"t":"meta","bk":[0,5]}', '{"t":"obs","cap":2,"blocks":[]}', '{"t":"probe"}', '{"t":null}']
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(text)], "session_id string, line_no int, line string")
    rows = captures.with_buckets(captures.records(df), ["session_id"], ["line_no"])
    got = {r.line_no: (r.status, r.bk) for r in rows.collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "meta", 2: "skipped", 3: "obs", 4: "meta", 5: "obs", 6: "event", 7: "skipped"}
    assert got[5][1] == [100.0, 90.0]
    block = captures.blocks(rows, ["session_id"]).first()
    assert block.srcq == 0 and block.class_votes == {10: 2} and block.obsn == 1
    view = spark.range(1).select(captures.viewport_text(F.lit("412x780.5")).alias("a"), captures.viewport_text(F.lit("412")).alias("b")).first()
    assert view.a == [412.0, 780.5] and view.b is None
