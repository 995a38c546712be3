import random

import pytest

from voxtide.llm import turns
from voxtide.llm.transcript import Cleaner, bare_words, cluster_number

LABELS = [("PAR", "PAR"), ("Patient", "PAR"), ("Bệnh nhân", "PAR"), ("INV", "INV"), ("Examiner", "INV"), ("Người hỏi", "INV")]
FORMS = ["um", "uh", "er", "hmm", "erm", "ah", "ờ", "ừ", "à", "ừm", "xxx"]
C = Cleaner(LABELS, FORMS)


@pytest.mark.parametrize(
    "text, label, words",
    [
        ("PAR: hello there", "PAR", "hello there"),
        ("*Bệnh nhân: tôi", "PAR", "tôi"),
        ("[1:20] [Patient] tôi thấy", "PAR", "tôi thấy"),
        (">> S00: \x15100_200\x15 I won", "#0", "i won"),
        ("Speaker 1> um er…", "#1", ""),
        ("(24.8s) Patient : lúc 6:45 sáng", "PAR", "lúc 6:45 sáng"),
        ("the new examiner asked: why", None, "the new examiner asked: why"),
        ("bệnh nhân bệnh nhân giường bên", None, "bệnh nhân bệnh nhân giường bên"),
        ("Examiner - at 17:20 we left", "INV", "at 17:20 we left"),
        ("patient people wait", None, "patient people wait"),
        ("00:00:18 --> 00:00:21 The name 00:00:06.815", None, "the name"),
        ("a *he gets up and walks to the open door* b ♪ one two three four five six seven eight ♪ c", None, "a b c"),
        ("it is 2*3 and 4*5 here", None, "it is 2*3 and 4*5 here"),
        ("a (COUGHS) b ((door slams)) c [nhạc...] d {music} e <breath> f *ho* g ♪ noise ♪ h &=tiếng:ồn i", None, "a b c d e f g h i"),
        ("Ummmm, &-ừừ… hmmmm errr! bà à, xxx. summer", None, "bà summer"),
        ("uuum errrm aah her hum", None, "her hum"),
        ("2 * 3 * 4 and a<b", None, "2 3 4 and a<b"),
        ("unclosed [ bracket (here", None, "unclosed bracket (here"),
        ("x-ray neighbour's off-by-one", None, "x-ray neighbour's off-by-one"),
        ("[noise] PAR: yes", "PAR", "yes"),
        ("*music* (SIGHS) um", None, ""),
        ("Người  hỏi: vâng", "INV", "vâng"),
        ("Bà à", None, "bà"),
        ("", None, ""),
        ("   ", None, ""),
        (None, None, ""),
        ("*PAR: ừm *nhạc* có *ho*", "PAR", "có"),
        ("INV", None, "inv"),
    ],
)
def test_clean(text, label, words):
    assert C.split(text) == (label, words.split())


def test_long_text():
    t = "PAR: " + "lúc 6:45 (12.5s) um we <breath> went, " * 20_000
    label, words = C.split(t)
    assert label == "PAR" and len(words) == 80_000


def test_edges_and_clusters():
    assert bare_words(["a,", "…b!", "c-d", "'e'"]) == ["a", "b", "c-d", "e"]
    assert [cluster_number(x) for x in ("SPEAKER_01", "spk2", "S00", "cluster-1", "Speaker 0", "3", "x1", "")] == ["1", "2", "0", "1", "0", "3", None, None]
    assert cluster_number("3", bare=False) is None


SEG = "segment_id long, recording_id string, segment_no int, start_ms long, end_ms long, text string, speaker string, salt string"
RES = "recording_id string, utterance_speakers array<string>, cluster_to_role map<string,string>"
TURN = "turn_id long, recording_id string, start_ms long, end_ms long, cluster_id string"


def run(spark, seg, res, dia, text=True):
    mk = spark.createDataFrame
    lab = mk(LABELS, "label string, speaker_role string")
    forms = mk([(f,) for f in FORMS], "form string")
    out = turns.speaker_turns(mk([(*s, "clash", "clash") for s in seg], SEG), mk(res, RES), mk(dia, TURN), lab, forms, text)
    return {tuple(r) for r in out.select("recording_id", "turn_no", "speaker", "first_segment_no", "last_segment_no", "n_words").collect()}


def test_speakers(spark):
    roles = {"0": "INV", "1": "PAR"}
    seg = [
        (1, "r", 0, 0, 10, "PAR: a b", ), (2, "r", 1, 10, 20, "c"), (2, "r", 1, 10, 20, "c"), (3, "r", 2, 20, 30, "um"), (4, "r", 3, 30, 40, "S00: d e"), (5, "r", 4, 40, 50, "f"), (6, "r", 5, 50, 60, "g"),
        (7, "r", 6, None, None, "h"), (8, "r", 7, 60, 70, None), (9, "r", 8, 70, 80, "S07: i"), (10, "q", 0, 0, 5, "PAR> x"), (11, "q", 1, 5, 6, "y"), (12, None, 0, 0, 1, "PAR: z"), (13, "q", None, 0, 1, "PAR: z"),
    ]
    res = [("r", ["INV", "*PAR:", None, None, "spk1", "?", "unknown", "", "Người hỏi"], roles)]
    dia = [(1, "r", 50, 55, "spk0"), (2, "r", 54, 60, "SPEAKER_01"), (2, "r", 54, 60, "SPEAKER_01"), (3, "r", 50, 52, "cluster-1"), (4, "r", 55, 50, "0"), (5, "r", None, 60, "0"), (6, "r", 0, 99, None)]
    want = {("r", 1, "PAR", 0, 1, 3), ("r", 2, "INV", 3, 3, 2), ("r", 3, "PAR", 4, 5, 2), ("r", 4, "INV", 8, 8, 1), ("q", 1, "PAR", 0, 0, 1)}
    assert run(spark, seg, res, dia) == want == run(spark, seg, res, dia, False)


def test_empty_tables(spark):
    assert run(spark, [], [], []) == set()
    assert run(spark, [(1, "r", 0, 0, 1, "PAR: a")], [], []) == {("r", 1, "PAR", 0, 0, 1)}


def test_hot_recording_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENTS_PER_BUCKET", 7)
    rng = random.Random(2)
    who = [rng.choice(["PAR", "INV"]) for _ in range(200)]
    seg = [(i, "r", i, i * 10, i * 10 + 10, f"{w}: a") for i, w in enumerate(who)]
    want, n = set(), 0
    start = 0
    for i in range(1, 201):
        if i == 200 or who[i] != who[start]:
            n += 1
            want.add(("r", n, who[start], start, i - 1, i - start))
            start = i
    assert run(spark, seg, [("r", [], {})], []) == want


def test_overlap_against_brute_force(spark):
    rng = random.Random(4)
    spans = [(i, rng.choice("ab"), s := rng.randrange(0, 2_000_000), s + rng.randrange(1, 900_000)) for i in range(40)]
    ts = [(rng.choice("ab"), str(rng.randrange(3)), s := rng.randrange(0, 2_000_000), s + rng.choice([5, 1000, 700_000])) for _ in range(60)]
    got = {(r.id, r["class"]): r.overlap for r in turns.overlap_by_class(spark.createDataFrame(spans, "id long, entity string, start long, end long"), spark.createDataFrame(ts, "entity string, class string, start long, end long")).collect()}
    want = {}
    for i, e, s, z in spans:
        for e2, c, a, b in ts:
            if e == e2 and (o := min(z, b) - max(s, a)) > 0:
                want[i, c] = want.get((i, c), 0) + o
    assert got == want


def test_texts_of_long_turns_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENTS_PER_BUCKET", 3)
    seg = [(i, "r", i, 0, 1, f"{'PAR' if i < 8 else 'INV'}: w{i}") for i in range(10)]
    df = lambda rows, s: spark.createDataFrame(rows, s)
    out = turns.speaker_turns(
        df(seg, "segment_id long, recording_id string, segment_no int, start_ms long, end_ms long, text string"), df([], "recording_id string, utterance_speakers array<string>, cluster_to_role map<string,string>"),
        df([], "turn_id long, recording_id string, start_ms long, end_ms long, cluster_id string"), df([("PAR", "PAR"), ("INV", "INV")], "label string, speaker_role string"), df([], "form string, kind string, lang string"), True,
    )
    assert sorted((r.turn_no, r.part_no, r.first_segment_no, r.last_segment_no, r.n_words, r.text) for r in out.collect()) == [
        (1, 1, 0, 7, 8, "w0 w1 w2"), (1, 2, 0, 7, 8, "w3 w4 w5"), (1, 3, 0, 7, 8, "w6 w7"), (2, 1, 8, 9, 2, "w8"), (2, 2, 8, 9, 2, "w9"),
    ]


def test_no_join_is_broadcast(spark, tmp_path, monkeypatch):
    # Alike entries compress so well that Spark takes the exploded results for a small table.
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(turns, "materialise", lambda df, *a, f=turns.materialise: (plan(df), f(df, *a))[1])

    def stored(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    n, roles = 300, {"0": "INV", "1": "PAR"}
    seg = [(3 * i + k, f"r{i}", k, 10 * k, 10 * k + 10, t, "", "") for i in range(n) for k, t in enumerate(("INV: a b", "c", "d"))]
    out = turns.speaker_turns(
        stored("seg", seg, SEG), stored("res", [(f"r{i}", ["INV", "PAR", None] + ["PAR"] * 200, roles) for i in range(n)], RES), stored("dia", [(i, f"r{i}", 0, 99, "spk0" if i % 2 else "spk1") for i in range(n)], TURN),
        stored("lab", LABELS, "label string, speaker_role string"), stored("forms", [(f,) for f in FORMS], "form string"), False,
    )
    plan(out)
    got = {tuple(r) for r in out.select("recording_id", "turn_no", "speaker", "first_segment_no", "last_segment_no", "n_words").collect()}
    want = [((1, "INV", 0, 0, 2), (2, "PAR", 1, 1, 1), (3, "INV", 2, 2, 1)) if i % 2 else ((1, "INV", 0, 0, 2), (2, "PAR", 1, 2, 2)) for i in range(n)]
    assert got == {(f"r{i}", *t) for i, ts in enumerate(want) for t in ts}
    assert len(plans) == 4 and not [p for p in plans if "BroadcastHashJoin" in p]
