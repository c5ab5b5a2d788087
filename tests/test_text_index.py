import pytest

from quern.operators import archive_io, bm25, search
from quern.operators.text_index import TextIndex
from quern.session import fresh_path
from quern.store import Store

DOCS = [(1, "alpha beta beta"), (2, "beta gamma"), (3, "alpha alpha delta delta"), (4, ""), (5, None), (6, "Gamma, GAMMA; beta"), (7, "gammas running")]


def rounded(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


@pytest.mark.parametrize("stemming", [False, True])
def test_stored_postings_rank_like_the_texts(spark, tmp_path, stemming):
    df = spark.createDataFrame(DOCS, "id int, text string")
    index = TextIndex(spark, str(tmp_path / "i")).build(df, ["id"], "text", stemming)
    for query, operator in (("Beta gamma", "or"), ("beta gamma", "and"), ("alpha", "or"), ("runs", "or"), ("nowhere", "or")):
        assert rounded(index.scores(query, operator)) == rounded(bm25.scores(df, ["id"], "text", query, stemming, operator))


def test_an_index_grows_and_is_reopened(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "id int, text string")
    TextIndex(spark, str(tmp_path / "i")).build(df.where("id < 3"), ["id"], "text")
    again = TextIndex(spark, str(tmp_path / "i"))
    assert again.refresh(df) == 3 and again.refresh(df) == 0
    assert rounded(again.scores("gamma beta")) == rounded(bm25.scores(df, ["id"], "text", "gamma beta"))


def test_an_empty_index(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i")).build(spark.createDataFrame([], "id int, text string"), ["id"], "text")
    assert index.scores("beta").count() == 0 and index.refresh(spark.createDataFrame(DOCS, "id int, text string")) == 5


def test_archives_artifacts_and_oddities(spark):
    a, b = Store(spark, fresh_path(spark, "a")), Store(spark, fresh_path(spark, "b"))
    a.append_absent("sessions", spark.createDataFrame([("s", "cli")], "id string, source_agent string"))
    a.append_absent("parts", spark.createDataFrame([("s", "m", "p", "tool_call", '{"tool_name":"ls","call_id":"k"}'), ("s", "m", "q", "text", "broken")], "session_id string, message_id string, id string, type string, body string"))
    path = fresh_path(spark, "archive")
    assert archive_io.export_archive(a, path) == {"sessions": 1, "parts": 2}
    assert archive_io.import_archive(spark, path, b) == {"sessions": 1, "parts": 2} and archive_io.import_archive(spark, path, b) == {"sessions": 0, "parts": 0}
    assert {(r.id, r.tool_name, r.call_id) for r in b.table("parts").collect()} == {("p", "ls", "k"), ("q", None, None)}
    assert {(r["table"], r.finding) for r in archive_io.diagnose(a).collect()} == {("sessions", "older_layout"), ("parts", "older_layout")}
    # An append that adds nothing leaves a folder that no version names; young ones may belong to a commit under way.
    assert {r.finding for r in archive_io.diagnose(b).collect()} == {"orphan_folders"} and archive_io.clean_up(b) == 0 and archive_io.clean_up(b, retention=-10) == 2
    kept = archive_io.Artifacts(spark)
    assert kept.read(kept.write(spark.range(5))).count() == 5
    with pytest.raises(ValueError):
        archive_io.Artifacts(spark, ceiling=10).write(spark.range(5))
    assert [archive_io.endpoint(x) for x in ("-", "a.JSONL", "b.archive", "/data/store")] == ["stream", "stream", "archive", "store"]


def test_arms_and_transcript():
    assert search.arm("fts", False, False) == "fts" and search.arm("vector", True, False) == "fts" and search.arm("vector", True, True) == "vector"
    with pytest.raises(search.SearchError):
        search.arm("vector", False, True)
    hit = lambda n: {"session_id": "s", "message_id": f"m{n}", "base": n / 10}
    groups = [{"root": "s", "project": None, "matched": 3, "hits": [hit(1), hit(2), hit(3)]}, {"root": "t", "project": "/p", "matched": 1, "hits": [hit(4)]}]
    text = search.transcript(groups, {("s", f"m{n}"): "x" * 300 for n in range(5)}, budget=400)
    assert "[m1]" in text and "[m2]" not in text and "(2 more)" in text and "best 0.300" in text and "[m4]" in text
