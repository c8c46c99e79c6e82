from __future__ import annotations

import pytest

from arboris.plans.jobs import compare, exit_codes, from_repository
from arboris.sources.documents import Caps, Refused, child_path, dita_nodes, json_nodes, xml_nodes, yaml_nodes


def refused(read, text, **caps):
    with pytest.raises(Refused) as e:
        list(read(text, None, Caps(**caps)))
    return e.value.code


def test_xml():
    got = list(xml_nodes('<a xml:id="k"><b x="1"> t <c/>tail</b><b/></a>', "u"))
    assert [(n["node_ref"], n["node_type"], n["parent_ref"]) for n in got] == [("n", "a", None), ("n.0", "b", "n"), ("n.0.0", "c", "n.0"), ("n.1", "b", "n")]
    assert got[0]["identity"] == {"id": "s:k"} and got[1]["content"] == {"text": "s:t"} and got[1]["structural"] == {"x": "s:1"}
    assert [n["loc"]["xpath"] for n in got] == ["/a", "/a/b[1]", "/a/b[1]/c", "/a/b[2]"]


def test_xml_is_hardened():
    assert refused(xml_nodes, '<!DOCTYPE a [<!ENTITY x SYSTEM "file:///etc/passwd">]><a>&x;</a>') == "UNSAFE_XML"
    assert refused(xml_nodes, '<!DOCTYPE a [<!ENTITY x "b"><!ENTITY y "&x;&x;">]><a b="&y;"/>') == "UNSAFE_XML"
    assert refused(xml_nodes, "<a><b></a>") == "INVALID_INPUT"
    assert refused(xml_nodes, "<a/>", max_bytes=2) == "UNSAFE_XML"
    assert refused(xml_nodes, "<a>" * 9 + "</a>" * 9, max_depth=8) == "UNSAFE_XML"
    assert refused(xml_nodes, "<a>" + "<b/>" * 9 + "</a>", max_nodes=8) == "UNSAFE_XML"


def test_dita():
    got = list(dita_nodes('<map><topicref keys=" k  l " href="././x.dita#y"><topicmeta><navtitle> T </navtitle></topicmeta></topicref><topicref href="./z" id="i"/></map>'))
    assert [n["identity"].get("id") for n in got] == [None, "s:keys:k l", "s:i"]
    assert got[1]["identity"]["href"] == "s:x.dita#y" and got[1]["content"] == {"navtitle": "s:T"}


def test_json():
    got = {n["node_ref"]: n for n in json_nodes('{"b": [1, true, null], "a": "x", "a": 2.5}')}
    assert got["n"]["node_type"] == "data:document" and got["n.0"]["node_type"] == "data:object"
    assert got["n.0.0"]["identity"] == {"key": "s:b"} and got["n.0.0.0"]["node_type"] == "data:array"
    assert got["n.0.0.0.1"]["content"] == {"value": "b:true", "text": "s:True"} and got["n.0.0.0.2"]["content"] == {"value": "n:"}
    assert got["n.0.1"]["content"]["value"] == "f:2.5"
    assert refused(json_nodes, "{") == "INVALID_INPUT" and refused(json_nodes, "NaN") == "INVALID_INPUT"
    assert refused(json_nodes, "1e999") == "UNSAFE_JSON" and refused(json_nodes, "[" * 200_000 + "]" * 200_000) == "UNSAFE_JSON"
    assert child_path("$", "ok_1") == "$.ok_1" and child_path("$", 'k"y') == '$["k\\"y"]' and child_path("$", 3) == "$[3]"


def test_yaml():
    same = list(yaml_nodes("a: 1\nb: [x, true]\n"))
    twin = list(json_nodes('{"a": 1, "b": ["x", true]}'))
    assert [(n["node_ref"], n["node_type"], n["content"]) for n in same] == [(n["node_ref"], n["node_type"], n["content"]) for n in twin]
    for bad in ("a: &x 1\nb: *x\n", "a: !t 1\n", "<<: {a: 1}\n", "a: 1\n---\nb: 2\n", "1: a\n", "a: 2020-01-01\n", "a: .inf\n"):
        assert refused(yaml_nodes, bad) == "UNSAFE_YAML", bad
    assert refused(yaml_nodes, "a: [") == "INVALID_INPUT"


def test_batch_of_requests(spark):
    dita = '<map id="m"><topicref keys="a" navtitle="A"/><topicref keys="b" navtitle="B"/><topicref keys="c" navtitle="C"/></map>'
    locale = '<map id="m"><topicref keys="a" navtitle="AA"/><topicref keys="c" navtitle="CC"/><topicref keys="b" navtitle="BB"/></map>'
    rows = [
        ("d", "dita-map-v1", dita, locale), ("j", "generic-json-v1", '{"a":1,"b":2}', '{"b":2,"a":1}'), ("k", "generic-json-v1", '{"items":["a","b","c"]}', '{"items":["a","c","b"]}'),
        ("bad", "generic-xml-v1", "<a>", "<a/>"), ("none", "nope", "x", "y"), ("y", "generic-yaml-v1", "n: Ada\n", "n: Grace\nactive: true\n"), ("null", "generic-xml-v1", None, "<a/>"),
    ]
    batch = compare(spark.createDataFrame(rows, "pair_id string, profile_id string, source_content string, locale_content string"), "fr-FR")
    state = {r["pair_id"]: (r["state"], r["error_code"]) for r in batch.jobs.collect()}
    assert state == {
        "d": ("COMPLETED", None), "j": ("COMPLETED", None), "k": ("COMPLETED", None), "y": ("COMPLETED", None),
        "bad": ("REJECTED", "INVALID_INPUT"), "none": ("REJECTED", "UNSUPPORTED_CONTRACT"), "null": ("REJECTED", "INVALID_INPUT"),
    }

    def changes(profile, pair):
        rows = batch.by_profile[profile].result.operations.where(f"pair_id = '{pair}' and type <> 'MATCH'").groupBy("type").count().collect()
        return {r["type"]: r["count"] for r in rows}

    assert changes("dita-map-v1", "d") == {"REORDER": 1, "UPDATE": 3}
    assert changes("generic-json-v1", "j") == {} and changes("generic-json-v1", "k") == {"REORDER": 1}
    assert changes("generic-yaml-v1", "y") == {"UPDATE": 1, "INSERT": 1}
    codes = {r["pair_id"]: r["exit_code"] for r in exit_codes(batch.jobs, batch.by_profile["dita-map-v1"].issues).collect()}
    assert codes["bad"] == 1 and codes["d"] == 2


def test_repository(spark):
    objects = spark.createDataFrame([("o", "1", "one"), ("o", "2", "two"), ("p", None, "bare"), ("p", "9", "nine")], "object_id string, revision string, content string")
    refs = spark.createDataFrame([("a", "x", "o", "1", "p", None), ("b", "x", "o", None, "q", None)], "pair_id string, profile_id string, source_object string, source_revision string, locale_object string, locale_revision string")
    got = {r["pair_id"]: (r["source_content"], r["locale_content"], r["error_code"]) for r in from_repository(refs, objects).collect()}
    assert got == {"a": ("one", "bare", None), "b": ("two", None, "CCMS_READ_FAILED")}


def test_command_line(spark, tmp_path, capsys):
    from arboris import cli

    (tmp_path / "a.json").write_text('{"a": 1, "b": "x"}')
    (tmp_path / "b.json").write_text('{"a": 1}')
    args = [str(tmp_path / "a.json"), str(tmp_path / "b.json"), "--profile", "generic-json-v1", "--out", str(tmp_path / "out")]
    assert cli.main(args) == 2 and "MISSING_IN_LOCALE 1" in capsys.readouterr().out
    assert list((tmp_path / "out" / "report.csv").glob("*.csv"))
    (tmp_path / "b.json").write_text("{")
    assert cli.main(args) == 1


def test_metadata_and_redaction(spark):
    from pyspark.sql import functions as F

    from arboris.functions.text import redacted, safe_name
    from arboris.plans.jobs import metadata

    df = spark.createDataFrame([({"ID": "1", "Rev": "2", "Other": "3", "token": "t", "text": "x"},)], "m map<string,string>")
    r = df.select(metadata(F.col("m"), {"ID": "object_id", "Rev": "revision"}).alias("a"), redacted(F.col("m")).alias("b"), safe_name(F.lit("../a b?.csv")).alias("c")).first()
    assert r["a"] == {"object_id": "1", "revision": "2"} and r["b"]["token"] == r["b"]["text"] == "[REDACTED]" and r["b"]["ID"] == "1"
    assert r["c"] == "a_b_.csv" or r["c"] == "_a_b_.csv"
