import pytest

from spindrift.lang import parse, wire
from spindrift.service import Service
from tests.engine.test_end_to_end import APP, PATTERN

SETTINGS = {"patterns": [PATTERN], "timeZone": {"kind": "utc"}}


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    logs = tmp_path_factory.mktemp("service-logs")
    (logs / "harbor.log").write_text(APP)
    s = Service(spark, str(tmp_path_factory.mktemp("service-data")))
    s.logs = str(logs)
    assert s.call("search", request={})["error"]["message"] == "no folder is open" and s.workspace_info() is None
    assert s.open_folder(s.logs, SETTINGS)["events"] == 4
    return s


def test_folders(service):
    assert service.folder_settings(service.logs)["patterns"] == [PATTERN]
    assert service.recent_folders() == [service.logs] and service.indexing_progress()["phase"] == "ready"
    assert service.preview_folder(service.logs, SETTINGS)["sources"][0]["format"] == {"kind": "log4j", "pattern": PATTERN}
    assert service.initial_folder(["-x", service.logs]) == service.logs and service.initial_folder(["-x"]) is None
    assert "is not a folder" in service.call("open_folder", path="/nowhere")["error"]["message"]
    service.cancel_indexing()
    assert service.progress.cancelled


def test_search(service):
    first = service.search({"query": "| logfmt", "limit": 3})
    assert first["total"] == 4 and sum(map(sum, first["histogram"]["buckets"])) == 4 and len(first["rows"]) == 3
    assert first["rows"][0]["parsed"] == [["took", "35ms"]] and first["rows"][0]["fields"] == [["trip", "trip-3"]]
    assert first["eventsScanned"] == 4 and first["filesScanned"] >= 1
    rest = service.search({"query": "| logfmt", "limit": 3, "after": first["next"], "rowsOnly": True})
    assert len(rest["rows"]) == 1 and rest["next"] is None and rest["total"] is None
    forward = service.search({"direction": "forward", "limit": 1, "rowsOnly": True})
    assert forward["rows"][0]["lineNo"] == 1


def test_a_label_filter_reads_only_its_partition(service):
    assert service.count_statistics({"query": '{level="error"}'})["eventsScanned"] == 1


def test_errors(service):
    assert service.call("search", request={"query": "{level="}) == {"error": {"kind": "query", "message": "expected a quoted label value, found end of query", "start": 7, "end": 7}}
    assert service.parse_query("{")["error"]["start"] == 1
    assert "unknown format" in service.call("export", request={}, path="/x", format="xml")["error"]["message"]


def test_labels_and_export(service, tmp_path):
    assert service.labels()[0] == {"name": "level", "stream": True, "values": [["info", 2], ["error", 1], ["warn", 1]], "truncated": False}
    assert service.export({"query": '{level="info"}'}, str(tmp_path / "out"), "json") == 2


def test_query_trees(service):
    text = '{a="b", level=~`x\\d`} |= "p" or "q" | json | logfmt | regexp `(?P<n>.)` | (a > 2s or b == 5MB) and c != "d"'
    tree = service.parse_query(text)["query"]
    assert tree["stages"][4]["expr"]["left"]["left"] == {"type": "cmp", "name": "a", "op": ">", "value": {"type": "duration", "value": 2000.0}, "text": "2s"}
    assert service.format_query(tree) == str(parse(text)) and wire.from_tree(tree) == parse(text)
