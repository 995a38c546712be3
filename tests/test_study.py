import json

from voxtide.operators import study

S = "participant string, session string, arm string, split string, edits long, ref_count long, reference_ms long, retained_ms long, utterances long, retained_utterances long, vectors long, valid_vectors long, failed boolean, runtime_s double, audio_s double, expects_vad boolean"


def row(p, arm, edits, kept=95, utt=100, failed=False, rt=10.0, vad=True):
    return (p, f"{p}-s", arm, "dev", edits, 100, 100, kept, 100, utt, 100, 95, failed, rt, 60.0, vad)


def test_study(spark):
    rows = [row(p, "N0", 50, 0, 0, vad=False) for p in "ab"] + [row(p, "P0", 40) for p in "ab"] + [row("a", "PF", 30, utt=96), row("b", "PF", 31, utt=96), row("a", "PD", 31, utt=99), row("b", "PD", 32, utt=99), row("a", "PX", 1, kept=94), row("b", "PX", 1, kept=95)]
    df = spark.createDataFrame(rows, S)
    g = {r.arm: r for r in study.gates(df).collect()}
    assert g["N0"].passed and g["N0"].duration_retention is None and g["P0"].passed and not g["PX"].passed
    best = study.choose(df, "P0", ["PF", "PD", "PX"]).collect()
    assert [r.arm for r in best] == ["PD"]  # a tie of one point goes to fewer missed utterances
    r = json.loads(study.report(df, "P0", ["PF", "PD", "PX"]))
    assert r["selected"] == "PD" and "a-s" not in json.dumps(r) and {d["arm"]: d["sign_agreement"] for d in r["differences"]}["PF"] == 2
    assert "Selected: PD" in study.markdown(json.dumps(r))


def test_nothing_eligible(spark):
    df = spark.createDataFrame([row("a", "P0", 10), row("a", "PF", 11), row("a", "PD", 5, failed=True)], S)
    assert study.choose(df, "P0", ["PF", "PD"]).count() == 0 and json.loads(study.report(df, "P0", ["PF", "PD"]))["selected"] is None
    assert study.gates(df.where("false")).count() == 0
