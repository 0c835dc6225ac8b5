"""The command line and its three JSON contracts."""

import json
import re

import pytest

from lodestone import cli
from lodestone.output import dumps, number

from .test_engine import write


def run(spark, capsys, *args):
    code = cli.main(list(args), lambda: spark)
    out = capsys.readouterr()
    return code, out.out, out.err


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("cli")
    folder = write(base / "in", {"1001": ("# Apple <page> & more\n\nOne golden apple.", {"title": "Golden", "last_modified_at": "2026-02-10T10:00:00Z", "source_url": "http://x/1"}), "7": ("# heading\n\nleft\n\n## middleterm\n\ncenter\n\n## right\n\nright", {})})
    assert cli.main(["index", folder, "--db", str(base / "index")], lambda: spark) == 0
    return folder, str(base / "index")


def test_usage(spark, capsys):
    assert run(spark, capsys)[0] == 2
    code, out, err = run(spark, capsys, "other")
    assert code == 2 and "unknown command: other" in err and "Usage" in err
    for flag in ("help", "-h", "--help"):
        code, out, _ = run(spark, capsys, flag)
        assert code == 0 and "Usage" in out


@pytest.mark.parametrize("args,message", [
    ([], "requires --q"), (["--q", "x", "--db", " "], "non-empty --db"), (["--q", "x", "--mode", "m"], "--mode"), (["--q", "x", "--fusion", "f"], "--fusion"), (["--q", "x", "--alpha", "1.5"], "--alpha"), (["--q", "x", "--rrf-k", "0"], "--rrf-k"),
    (["--q", "x", "--top-k=0"], "--top-k"), (["--q", "x", "--offset", "-1"], "--offset"), (["--q", "x", "--limit", "-1"], "--limit"), (["--q", "x", "--candidate-k", "0"], "--candidate-k"), (["--q", "x", "--expand", "-1"], "--expand"),
    (["--q", "x", "--from", "2026-1-1"], "YYYY-MM-DD"), (["--q", "x", "--to", "2026-02-30"], "YYYY-MM-DD"), (["--q", "x", "--from", "2026-02-02", "--to", "2026-02-01"], "date range"), (["--what"], "not defined"), (["--alpha", "x"], "invalid value"), (["--q"], "needs an argument"),
])
def test_query_checks(spark, capsys, args, message):
    code, _, err = run(spark, capsys, "query", *args)
    assert code == 2 and message in err


@pytest.mark.parametrize("args,message", [(["--db"], "requires a value"), (["--db="], "non-empty"), (["-x"], "unknown flag"), (["a", "b"], "at most one")])
def test_index_checks(spark, capsys, args, message):
    code, _, err = run(spark, capsys, "index", *args)
    assert code == 2 and message in err


def test_index_flags_in_any_order():
    assert cli.parse_index(["--json", "f", "--db=p", "--rebuild"]) == ("f", "p", True, True)
    assert cli.parse_index([]) == (".", "", False, False)


def test_index_json(spark, capsys, built):
    code, out, _ = run(spark, capsys, "index", "--json", built[0], "--db", built[1])
    found = json.loads(out)
    assert code == 0 and list(found) == sorted(found)
    assert found["documents"] == {"deleted": 0, "inserted": 0, "skipped": 2, "updated": 0} and found["schemaVersion"] == "1" and found["incremental"] is True
    assert set(found) == set("checkedFiles chunkWrites command dbPath dbStats documents embedding incremental inputFolder metadataPath pageCount rebuild runId schemaVersion status".split())
    code, out, _ = run(spark, capsys, "index", built[0], "--db", built[1])
    assert "documents skipped: 2" in out and "mode: incremental (default)" in out


def test_query_json(spark, capsys, built):
    code, out, _ = run(spark, capsys, "query", "--db", built[1], "--q", "golden", "--mode=lexical", "--json", "--explain")
    found = json.loads(out)
    assert code == 0 and "\\u003cpage\\u003e \\u0026 more" in out and re.search(r'"alpha=0.70"', out)
    assert found["request"]["Alpha"] == 0.7 and found["request"]["Limit"] == 0 and found["pagination"] == {"limit": 0, "offset": 0}
    (hit,) = found["results"]
    assert list(hit) == "rank chunkId documentId pageId title localPath spaceKey sourceUrl chunkText chunkIndex lexicalScore vectorScore fusedScore fusion".split()
    assert hit["chunkId"] == "1001:000000" and hit["lexicalScore"] == 1 and hit["fusion"] == "lexical"


def test_no_hits_are_null(spark, capsys, built):
    code, out, _ = run(spark, capsys, "query", "--db", built[1], "--q", "absent", "--mode", "lexical", "--json")
    assert code == 0 and json.loads(out)["results"] is None and json.loads(out)["count"] == 0
    assert run(spark, capsys, "query", "--db", built[1], "--q", "absent", "--mode", "lexical")[1] == "no results\n"


def test_window_from_the_first_chunk_has_no_start(spark, capsys, built):
    _, out, _ = run(spark, capsys, "query", "--db", built[1], "--q", "middleterm", "--mode", "lexical", "--expand", "1", "--json")
    (hit,) = json.loads(out)["results"]
    assert "contextStartIndex" not in hit and hit["contextEndIndex"] == 2 and hit["contextChunkCount"] == 3 and hit["baseChunkText"] == "## middleterm\n\ncenter"


def test_text_output(spark, capsys, built):
    code, out, _ = run(spark, capsys, "query", "--db", built[1], "--q", "golden", "--top-k", "2", "--explain", "--expand", "1")
    assert code == 0 and out.startswith("1. [") and "context-range=" in out and "- top weighted-components" in out and "- top gap=" in out and "- returned=2" in out


def test_syntax_error_exits_with_2(spark, capsys, built):
    code, _, err = run(spark, capsys, "query", "--db", built[1], "--q", "what is x?")
    assert code == 2 and "syntax error" in err


def test_stats(spark, capsys, built):
    code, out, _ = run(spark, capsys, "stats", "--db", built[1], "--json")
    assert code == 0 and json.loads(out)["stats"]["documents"] == 2 and json.loads(out)["stats"]["chunks"] == 4
    assert "chunks: 4" in run(spark, capsys, "stats", "--db", built[1])[1]
    assert run(spark, capsys, "stats", "x")[0] == 2 and run(spark, capsys, "stats", "--db", built[1] + "none")[0] == 2


def test_numbers():
    assert [number(x) for x in (0.0, 1.0, 0.7, 1e-7, 1e21, 123456.5, 1 / 3)] == ["0", "1", "0.7", "1e-7", "1e+21", "123456.5", "0.3333333333333333"]
    assert dumps({"a": [], "b": {}, "c": None}) == '{\n  "a": [],\n  "b": {},\n  "c": null\n}'
