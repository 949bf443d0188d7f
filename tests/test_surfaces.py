"""The command line and the tool server, over one small tree."""

import io
import json
import re

import pytest

from cipherlode import cli, rpc


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("surfaces") / "shop"
    (root / "src").mkdir(parents=True)
    (root / "src/keys.js").write_text("import { generateKeyPairSync } from 'node:crypto';\nexport const backup = () => generateKeyPairSync('rsa', { modulusLength: 2048 });\n")
    return root


@pytest.fixture(autouse=True)
def one_session(spark, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)


def test_a_pipe_gets_markdown(tree, capsys):
    assert cli.main([str(tree), "--now", "then"]) == 0
    out = capsys.readouterr().out
    assert out.startswith("# Post-quantum cryptography inventory: shop\n") and "Scanned then by" in out and "RSA 2048\\-bit" in out


def test_named_files_a_summary_and_the_threshold(tree, tmp_path, capsys):
    names = {k: str(tmp_path / k) for k in ("json", "md", "cbom")}
    assert cli.main([str(tree), "--fail-on", "high", *(x for k, v in names.items() for x in (f"--{k}", v))]) == 1
    said = capsys.readouterr()
    assert "at priority high or above: 1" in said.err
    lines = said.out.splitlines()
    assert lines[0] == "cipherlode: 1 quantum-vulnerable public-key use in 1 file; 0 libraries; no TLS configuration found"
    assert lines[1] == "  read 1 files; priority: 1 high, 0 medium, 0 low; dynamic: 0"
    assert [x.split(": ")[1] for x in lines[2:]] == [names["md"], names["json"], names["cbom"]]
    whole = json.load(open(names["json"]))
    assert [(f["file"], f["line"], f["algorithm"]) for f in whole["findings"]] == [("src/keys.js", 2, "RSA 2048-bit")]
    bom = json.load(open(names["cbom"]))
    assert (bom["bomFormat"], bom["specVersion"]) == ("CycloneDX", "1.6") and bom["components"]
    assert re.match("# ", open(names["md"]).read())


def test_a_terminal_gets_two_files(tree, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli.sys.stdout, "isatty", lambda: True, raising=False)
    assert cli.main([str(tree), "--exclude", "src/"]) == 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["cipherlode.json", "cipherlode.md"]
    assert capsys.readouterr().out.startswith("cipherlode: 0 quantum-vulnerable")


def test_wrong_use(tree, tmp_path, capsys):
    assert cli.main([str(tmp_path / "nowhere")]) == 2
    assert cli.main([str(tree), "--json", str(tmp_path / "no/such/folder.json")]) == 2
    with pytest.raises(SystemExit) as stopped:
        cli.main([str(tree), "--fail-on", "never"])
    assert stopped.value.code == 2
    capsys.readouterr()


def asked(spark, *lines):
    out = io.StringIO()
    assert rpc.listen(spark, io.StringIO("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines)), out) == 0
    return [json.loads(x) for x in out.getvalue().splitlines()]


def request(n, method, **params):
    return {"jsonrpc": "2.0", "id": n, "method": method, "params": params}


def test_protocol(spark):
    replies = asked(spark, request(1, "initialize"), {"jsonrpc": "2.0", "method": "notifications/initialized"}, request(2, "ping"), "", "{", "[]", request(3, "tools/list"), request(4, "other"), request(5, "tools/call", name="x"))
    assert [(r["id"], r.get("error", {}).get("code")) for r in replies] == [(1, None), (2, None), (None, -32700), (None, -32600), (3, None), (4, -32601), (5, -32602)]
    assert replies[0]["result"]["protocolVersion"] == rpc.PROTOCOL_VERSION and replies[4]["result"]["tools"] == [rpc.TOOL]


def test_the_tool(spark, tree):
    call = lambda n, **a: request(n, "tools/call", name=rpc.TOOL["name"], arguments=a)
    short, full, bad, nowhere = (r["result"] for r in asked(spark, call(1, directory=str(tree)), call(2, directory=str(tree), detail="full"), call(3, directory=str(tree), exclude="src"), call(4, directory="/no/such")))
    assert bad["isError"] and nowhere["isError"]
    view = json.loads(short["content"][0]["text"])
    assert view["view"] == "summary" and [(g["algorithm"], g["at"]) for g in view["toReview"]] == [("RSA 2048-bit", ["src/keys.js:2"])]
    assert len(json.loads(full["content"][0]["text"])["findings"]) == 1
