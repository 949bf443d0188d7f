"""The library's names, used as another program would."""

import json

from cipherlode import api


def test_every_name_is_there():
    assert all(hasattr(api, name) for name in api.__all__)


def test_lines_and_tokens():
    assert api.split_lines("a\r\nb c\rd\n") == ["a", "b", "c", "d", ""]
    read = api.Tokens("h('x') // y")
    assert [read.text[a:b] for a, b in zip(read.start, read.end, strict=True)] == ["h", "(", "'x'", ")"] and len(read.comments) == 1


def test_a_table_of_files(spark):
    files = spark.createDataFrame([("a/k.js", "require('crypto').createECDH('secp384r1');\n"), ("package.json", '{"dependencies": {"jose": "^5.0.0"}}')], "path string, text string")
    found = api.settled(api.scan_table(files))
    whole = api.report(found, "t", "now")
    assert [(f["file"], f["algorithm"]) for f in whole["findings"]] == [("a/k.js", "ECDH P-384")] and whole["dependencies"][0]["declared_in"] == ["package.json"]
    assert json.loads(api.to_json(whole)) == whole
    bom = json.loads("".join(r.line for r in api.cbom_lines(found, "t", "now").collect()))
    assert bom == api.document(found, "t", "now") and api.over_threshold(found, "high") == 1
