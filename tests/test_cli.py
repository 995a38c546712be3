import json

import pytest

from tests.test_sources import CHAT, doc
from voxtide import cli
from voxtide.sources import documents


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "d.json").write_text(json.dumps(doc()))
    (tmp_path / "chat").mkdir()
    (tmp_path / "chat" / "a.cha").write_text(CHAT)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.cha").write_text(CHAT.replace("thấy gì", "thấy gì đó"))
    return tmp_path


def test_validate(spark, folder, capsys):
    assert cli.main(["validate", str(folder / "json")], spark) == 0
    (folder / "json" / "bad.json").write_text("{")
    assert cli.main(["validate", str(folder / "json")], spark) == 1 and "INVALID_DOCUMENT" in capsys.readouterr().err


def test_folder_of_both_formats(spark, folder, capsys):
    (folder / "both").mkdir()
    (folder / "both" / "d.json").write_text(json.dumps(doc()))
    (folder / "both" / "a.cha").write_text(CHAT)
    assert cli.main(["validate", str(folder / "both")], spark) == 0
    assert {r.recording_id.split("/")[-1] for r in cli._load(spark, str(folder / "both")).utt.collect()} == {"a.cha", doc()["document_id"]}
    (folder / "both" / "odd.txt").write_text("what")
    assert cli.main(["validate", str(folder / "both")], spark) == 1 and capsys.readouterr().err.count("\n") == 1


def test_evaluate_reports(spark, folder, capsys):
    (folder / "other" / "broken.cha").write_text("*PAR:\tmột hai .\n")
    (folder / "chat" / "broken.cha").write_text("*PAR:\tmột ba .\n")
    assert cli.main(["evaluate", str(folder / "chat"), str(folder / "other"), "--report", str(folder / "report")], spark) == 0
    r = json.loads("\n".join(x.value for x in spark.read.text(str(folder / "report")).collect()))
    assert r["sessions_evaluated"] == 2 and 0 < r["metrics"]["wer"]["ci_95"][0] <= r["metrics"]["wer"]["mean"] <= r["metrics"]["wer"]["ci_95"][1]


def test_tag(spark, folder):
    (folder / "src").mkdir()
    (folder / "src" / "x.cha").write_bytes("@Begin\n*PAR:\tđi .\n%mor:\told\n@End\n".encode())
    path = documents.texts(spark, str(folder / "src")).first().path
    spark.createDataFrame([(path, 0, "new", "1|0|ROOT")], "path string, utt_idx int, mor string, gra string").write.parquet(str(folder / "tiers"))
    assert cli.main(["tag", str(folder / "src"), str(folder / "tiers"), str(folder / "tagged")], spark) == 0
    assert documents.texts(spark, str(folder / "tagged")).first().content == "@Begin\n*PAR:\tđi .\n%mor:\tnew\n%gra:\t1|0|ROOT\n@End\n"


def test_convert_refuses_to_overwrite(spark, folder):
    args = ["convert", str(folder / "chat"), str(folder / "out"), "--to", "json"]
    assert cli.main(args, spark) == 0
    with pytest.raises(Exception, match="(?i)exists"):
        cli.main(args, spark)
    assert cli.main([*args, "--force"], spark) == 0
    text = "".join(r.value for r in spark.read.text(str(folder / "out")).collect())
    assert json.loads(text)["utterances"][1]["tokens"][4]["text"] == "&-ờ"


def test_evaluate(spark, folder, capsys):
    assert cli.main(["evaluate", str(folder / "chat"), str(folder / "chat")], spark) == 0 and "syer 0.0" in capsys.readouterr().out
    assert cli.main(["evaluate", str(folder / "chat"), str(folder / "other")], spark) == 0 and "syer 0.0 " not in capsys.readouterr().out


def test_list_features(spark, capsys):
    assert cli.main(["list-features", "--pack", "motor_neuro"], spark) == 0 and capsys.readouterr().out.count("\n") == 48
    assert cli.main(["list-features", "--domain", "nope"], spark) == 2


def test_extract(spark, folder):
    assert cli.main(["extract", str(folder / "json"), str(folder / "feat"), "--packs", "motor_neuro"], spark) == 0
    assert spark.read.option("header", True).csv(str(folder / "feat" / "recordings.csv")).count() == 1
    assert json.loads(spark.read.text(str(folder / "feat" / "provenance.json")).first().value)["packs"] == ["motor_neuro"]


def test_task_specifications(spark, folder, capsys):
    from voxtide.sources import taskspecs

    spec = {"version": 1, "task": "semantic_fluency", "item_aliases": {"cat": ["mèo"], "dog": ["chó"]}, "subcategories": {"pets": ["cat", "dog"]}}
    got = taskspecs.parse(json.dumps(spec))
    assert (got.kind, got.aliases, got.categories) == ("semantic", spec["item_aliases"], {"cat": "pets", "dog": "pets"})
    assert taskspecs.parse(json.dumps({"version": 1, "initials": ["m"], "exclusions": []}), "phonemic_fluency").initials == ("m",)
    bad = ["[]", "x", "{}", '{"version": 2}', '{"version": true, "task": "delayed_recall"}', '{"version": 1, "task": "other"}', '{"version": 1, "task": "delayed_recall"}', '{"version": 1, "task": "delayed_recall", "idea_aliases": {"a": "b"}}']
    for text in bad:
        with pytest.raises(taskspecs.InvalidTaskSpec):
            taskspecs.parse(text)
    assert taskspecs.digest('{"b": 1, "a": [1, 2]}') == taskspecs.digest('{"a":[1,2],"b":1}')
    (folder / "spec.json").write_text('{"version": 2}')
    assert cli.main(["extract", str(folder / "json"), str(folder / "no"), "--packs", "adult_neuro", "--task-spec", str(folder / "spec.json")], spark) == 2
