"""Windows, repair, alignment, clustering, scoring and tagging against brute force."""

import random

import numpy as np
import pytest

from voxtide.operators import alignment, scoring, windows
from voxtide.sources import tagging


def brute_cuts(levels, cap, search):
    out, start = [], 0
    while start < len(levels):
        end = start + cap
        if end >= len(levels):
            end = len(levels)
        else:
            span = range(max(start + 1, end - search), end)
            best = min(span, key=lambda i: levels[i])
            end = end if levels[best] >= levels[end - 1] else best
        out.append((start, end))
        start = end
    return out


def test_quiet_cuts(spark):
    rng = random.Random(4)
    data = {k: [float(rng.randrange(9)) for _ in range(n)] for k, n in (("a", 1), ("b", 30), ("c", 301), ("d", 31))}
    df = spark.createDataFrame([(k, i, x, "z") for k, xs in data.items() for i, x in enumerate(xs)] + [("a", None, 1.0, "z")], "k string, i long, x double, end string")
    got = {}
    for r in windows.quiet_cuts(df, ["k"], "i", "x", 30, 7).orderBy("k", "window_no").collect():
        got.setdefault(r.k, []).append((r.first, r.end))
    assert got == {k: brute_cuts(xs, 30, 7) for k, xs in data.items()}
    assert windows.quiet_cuts(df.limit(0), ["k"], "i", "x", 30, 7).count() == 0
    with pytest.raises(ValueError):
        windows.quiet_cuts(df, ["k"], "i", "x", 5, 5)


def test_quietest_sample():
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000).astype(np.float32)
    x[1500:1900] *= 0.01
    at = windows.quietest_sample(x, 1000, 3000, 300, 50)
    want = min([*range(0, 1701, 50), 1700], key=lambda i: float((x[1000 + i : 1300 + i].astype(float) ** 2).sum()))
    assert at == 1000 + want + 150 and 1500 < at < 1900
    assert windows.quietest_sample(x, 0, 200, 300, 50) == 200 and windows.quietest_sample(np.zeros(1000), 0, 1000, 300, 50) == 1000


def test_fold_windows(spark):
    rows = [("r", 0, 5), ("r", 7, 9), ("r", 10, 21), ("r", 22, 60), ("r", 61, 62), ("r", None, 3), (None, 1, 2)]
    got = windows.fold_windows(spark.createDataFrame(rows, "k string, s long, e long"), ["k"], "s", "e", 20).collect()
    assert sorted((str(r.k), r.s, r.e) for r in got) == [("None", 1, 2), ("r", 0, 9), ("r", 10, 21), ("r", 22, 60), ("r", 61, 62)]


def test_segments_are_repaired(spark):
    seg = spark.createDataFrame([("r", 1, 0, 1000, "xin, chào... ."), ("r", 2, 900, 800, None), ("r", 3, None, None, "a 1"), ("q", 4, 0, 10, "x")], "recording_id string, segment_id long, start_ms long, end_ms long, text string")
    w = [(1, 0, "xin,", 0, 300), (1, 1, ".", 300, 310), (1, 2, "chào", 200, 1200), (1, 3, "bạn", 100, 150), (1, 4, "ơi", 50, 90), (2, 0, "a", 10, 20), (2, 1, "…", None, None), (2, 2, "b", 15, 40), (3, 0, "a", 1, 2), (3, 1, "1", None, 9), (4, 0, None, 1, 2)]
    words = spark.createDataFrame(w, "segment_id long, word_no int, word string, start_ms long, end_ms long")
    s, w = windows.normalize_segments(seg, words, spark.createDataFrame([("r", 5000)], "recording_id string, duration_ms long"))
    assert {r.segment_id: (r.start_ms, r.end_ms, r.text) for r in s.collect()} == {1: (0, 1000, "xin chào"), 2: (10, 40, ""), 3: (None, None, "a 1"), 4: (0, 10, "x")}
    assert {(r.segment_id, r.word_no): r.start_ms for r in w.collect()} == {(1, 0): 0, (1, 2): None, (1, 3): 100, (1, 4): None, (2, 0): 10, (2, 2): 15, (3, 0): 1, (3, 1): None}


def test_suspected_repetition(spark):
    texts = {"loop": "ừ " * 8, "short": "ừ " * 7, "unk": "a Unk. b", "few": "một hai ba. " * 10, "fine": " ".join(map(str, range(30))), "blank": " "}
    df = spark.createDataFrame([(k, i, x) for k, t in texts.items() for i, x in enumerate(t.split(" "))], "k string, i int, w string")
    r = {x.k: x for x in windows.suspected_repetition(df, ["k"], "i", "w").collect()}
    assert {k: x.suspected for k, x in r.items()} == {"loop": True, "short": False, "unk": True, "few": True, "fine": False} and r["loop"].longest_run == 8


def test_alignment(spark):
    path = {"ok": [0, 5, 5, 0, 5, 7, 7], "merged": [5, 5, 7], "short": [5, 0], "empty": [0, 0]}
    frames = spark.createDataFrame([(k, i, x) for k, xs in path.items() for i, x in enumerate(xs)], "k string, frame int, label int")
    targets = spark.createDataFrame([(k, *t) for k in (*path, "none") for t in ((0, 5, 0), (1, 5, 1), (2, 7, 1))], "k string, pos int, label int, word int")
    got = {(r.k, r.word): (r.start_ms, r.end_ms) for r in alignment.aligned_words(frames, targets, ["k"], 0, 12.5).collect()}
    assert got[("ok", 0)] == (12, 38) and got[("ok", 1)] == (50, 88) and all(v == (None, None) for (k, _), v in got.items() if k != "ok") and len(got) == 10
    seg = spark.createDataFrame([(1, 1000, 2000), (2, 0, 900), (3, None, None)], "segment_id long, start_ms long, end_ms long")
    words = spark.createDataFrame([(1, 0, "a", 10, 20), (1, 1, ".", None, None), (1, 2, "b", 30, 400), (2, 0, "a", 1, 2), (2, 1, "b", None, None), (3, 0, "a", 1, 2)], "segment_id long, word int, text string, start_ms long, end_ms long")
    assert {tuple(r) for r in alignment.time_segments(seg, words).collect()} == {(1, 1010, 1400), (2, 0, 900), (3, None, None)}


def brute_linkage(x, k):
    groups = [[i] for i in range(len(x))]
    far = lambda a, b: np.mean([np.linalg.norm(x[i] - x[j]) for i in a for j in b])
    while len(groups) > k:
        a, b = min(((a, b) for a in range(len(groups)) for b in range(a + 1, len(groups))), key=lambda p: far(groups[p[0]], groups[p[1]]))
        groups[a] += groups.pop(b)
    label = {i: min(g) for g in groups for i in g}
    return [sorted(set(label.values())).index(label[i]) for i in range(len(x))]


def test_clusters(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (9, 4)), rng.normal(2, 1, (8, 4))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k in (1, 2, 5):
        assert alignment.average_linkage(unit, k).tolist() == brute_linkage(unit, k)
    rows = [("r", i, v.tolist()) for i, v in enumerate(x)] + [("r", 0, x[0].tolist()), ("r", 99, None), ("one", 1, [1.0, 0.0, 0.0, 0.0]), (None, 1, [0.0] * 4)]
    df = spark.createDataFrame(rows, "k string, s long, v array<double>")
    got = {(r.k, r.s): r.cluster for r in alignment.clusters(df, "k", "s", "v").collect()}
    assert [got["r", i] for i in range(17)] == brute_linkage(unit, 2) and got["r", 99] is None and got["one", 1] == 0 and (None, 1) in got
    assert all(v is None for k, v in {(r.k, r.s): r.cluster for r in alignment.clusters(df, "k", "s", "v", most=5).collect()}.items() if k[0] == "r")


def test_items_and_report(spark):
    chat = "@Begin\n*PAR:\txin chào_bạn . \x150_900\x15\n%com:\tkhông\n*INV:\té , •1_2•\r\nrest"
    df = spark.createDataFrame([(1, chat), (2, None), (3, "no tiers here")], "k long, t string")
    assert {r.k: r.items for r in scoring.lenient_items(df, "t").collect()} == {1: ["xin", "chào_bạn", "é"], 2: [], 3: []}
    assert {r.k: r.items for r in scoring.plain_items(df, "t").collect()}[3] == ["no", "tiers", "here"]
    pairs = spark.createDataFrame([(["a_b", "c"], ["a", "c", "d", "e"]), ([], ["x"]), (["a"], None)], "g array<string>, p array<string>")
    s = scoring.session_scores(pairs, "g", "p")
    assert [(r.wer_edits, r.wer_ref, r.syer_edits, r.syer_ref, r.cer_edits) for r in s.collect()] == [(3, 2, 3, 3, 3), (1, 0, 1, 0, 1), (1, 1, 1, 1, 1)]
    m = {r.metric: (r.sessions, r.mean) for r in scoring.report(s, scoring.METRICS).collect()}
    assert m["wer"] == (3, pytest.approx((1 + 0 + 1) / 3)) and set(m) == set(scoring.METRICS)
    ci = scoring.intervals_of_means(s, ["wer"], samples=200)
    assert ci == scoring.intervals_of_means(s, ["wer"], samples=200) and 0 <= ci["wer"][0] <= m["wer"][1] <= ci["wer"][1] <= 1


def test_strict_items_and_uncertainty(spark):
    from voxtide.sources import tiers

    text = "tôi <con mèo> [/] &-ờ xxx . &+ab [: đi về]"
    tok = tiers.tier_roles(spark.createDataFrame([("s", 0, i, x) for i, x in enumerate(text.split())], "k string, utt_idx int, tok_idx int, text string"), ["k", "utt_idx"])
    assert scoring.strict_items(tok, ["k"]).first().items == ["tôi", "con", "mèo", "ờ"]
    utt = spark.createDataFrame([("s", 0, 1.0, 1.0)], "k string, utt_idx int, start_s double, end_s double")
    assert {r.code for r in scoring.uncertainty(tok, utt, ["k"]).collect()} == {"UNTRANSCRIBED_SPAN", "NONWORD_FRAGMENT", "REPLACEMENT_ANNOTATION", "ZERO_DURATION_UTTERANCE"}


def test_layer_agreement(spark):
    s = "k string, place int, pos string, head string, rel string"
    g = spark.createDataFrame([("a", 0, "noun", "0", "ROOT"), ("a", 1, "verb", "1", "OBJ"), ("a", 2, "adj", "1", "X")], s)
    p = spark.createDataFrame([("a", 0, "NOUN", "0", "root"), ("a", 1, "verb", "1", "SUBJ")], s)
    assert tuple(scoring.layer_agreement(g, p, ["k"]).first()) == ("a", 2, 2, 2, 1)


def test_morphology_is_replaced_and_all_else_stays(spark):
    old = "@UTF8\r\n*PAR:\txin chào \x150_9\x15\r\n\tbạn .\r\n%mor:\ta\r\n\tb\r\n%wor:\tx\r\n%gra:\t1\r\n*INV:\tờ .\n%com:\tz\n\n@End"
    new = "@UTF8\r\n*PAR:\txin chào \x150_9\x15\r\n\tbạn .\r\n%mor:\tm0\r\n%gra:\tg0\r\n%wor:\tx\r\n*INV:\tờ .\n%com:\tz\n\n@End"
    files = spark.createDataFrame([("a", old), ("b", "*PAR:\tx"), ("c", old), ("d", "no tier"), ("e", None)], "path string, content string")
    tiers = spark.createDataFrame([("a", 0, "m0", "g0"), ("a", 1, None, None), ("b", 0, "m", "g"), ("c", 0, "m", "g")], "path string, utt_idx int, mor string, gra string")
    done, odd = tagging.replace_morphology(files, tiers)
    assert {r.path: r.content for r in done.collect()} == {"a": new, "b": "*PAR:\tx\n%mor:\tm\n%gra:\tg\n", "d": "no tier"}
    assert {tuple(r) for r in odd.collect()} == {("c", "UTTERANCE_COUNT_MISMATCH")}
