"""Measures against hand calculation and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtide.operators import clinical, conversation as conv, evaluation as ev, frames as fr, intervals, lexical as lex, morphosyntax as morph, motor, nonlinear, order, tasks, transcription as tr

TOK = "recording_id string, speaker_id string, utt_idx int, tok_idx int, token_id string, norm string, kind string, word_id string"


def toks(spark, utterances, speaker="PAR"):
    return spark.createDataFrame([("r", speaker, u, i, f"{u}_{i}", w.lstrip("&"), "filler" if w.startswith("&") else "word", None) for u, ws in enumerate(utterances) for i, w in enumerate(ws.split())], TOK)


def brute_mtld(ws):
    def one(ws):
        f, types, n = 0.0, set(), 0
        for w in ws:
            types.add(w)
            n += 1
            if n > 1 and len(types) / n <= 0.72:
                f, types, n = f + 1, set(), 0
        return f + ((1 - len(types) / n) / 0.28 if n else 0)

    a, b = one(ws), one(ws[::-1])
    return (len(ws) / a + len(ws) / b) / 2 if a and b else None


def test_ordered_diversity(spark):
    rng = random.Random(3)
    ws = [rng.choice("a b c d e f g h i j k l m".split()) for _ in range(150)]
    r = lex.ordered_diversity(toks(spark, [" ".join(ws[:70]), " ".join(ws[70:])]), "norm", ["utt_idx", "tok_idx"], "x").first()
    assert math.isclose(r.x_mtld, brute_mtld(ws))
    assert math.isclose(r.x_mattr_20, np.mean([len(set(ws[i : i + 20])) / 20 for i in range(131)]))
    short = lex.ordered_diversity(toks(spark, ["a b"]), "norm", ["utt_idx", "tok_idx"], "x").first()
    assert short.x_mattr_20 is None and short.x_mtld is None


def test_type_frequencies(spark):
    ws = ("a " * 20 + "b " * 15 + "c d e f g h i").split()
    r = lex.diversity(toks(spark, [" ".join(ws)]), "norm", "x").first()
    n, v, v1 = len(ws), 9, 7
    hdd = sum((1 - math.prod(max(n - f - k, 0) / (n - k) for k in range(42))) / 42 for f in (20, 15, *[1] * 7))
    assert math.isclose(r.x_ttr, v / n) and math.isclose(r.x_hapax_ratio, v1 / n) and math.isclose(r.x_brunet_w, n ** (v**-0.165)) and math.isclose(r.x_honore_r, 100 * math.log(n) / (1 - v1 / v)) and math.isclose(r.x_hdd_42, hdd, rel_tol=1e-9)
    one = lex.diversity(toks(spark, ["a a a"]), "norm", "x").first()
    assert one.x_entropy == 0 and one.x_hdd_42 is None


def test_disfluency_skips_fillers_between(spark):
    r = lex.disfluency(toks(spark, ["a &um a b b", "b"])).first()
    assert r.disfluency_immediate_repetition_count == 2 and r.disfluency_filler_count == 1 and r.disfluency_maze_count == 3 and math.isclose(r.disfluency_maze_ratio, 3 / 6)


UTT = "recording_id string, speaker_id string, utt_idx int, utterance_id string, start_s double, end_s double"


def test_two_latencies_differ(spark):
    u = spark.createDataFrame([("r", "INV", 0, "u0", 0.0, 5.0), ("r", "INV", 1, "u1", 1.0, 2.0), ("r", "PAR", 2, "u2", 3.0, 4.0), ("r", "PAR", 3, "u3", 6.0, 7.0), ("r", "PAR", 4, "u4", None, None)], UTT)
    o = {r.speaker_id: r for r in conv.ordered_latency(u).collect()}["PAR"]
    assert math.isclose(o.discourse_response_latency_mean_s, 1.0) and math.isclose(o.discourse_examiner_prompt_ratio, 0.5)
    a = {r.speaker_id: r for r in conv.asof_latency(u).collect()}["PAR"]
    assert math.isclose(a.time_response_latency_s, (1.0 + 1.0) / 2)


def test_overlaps(spark):
    u = spark.createDataFrame([("r", "A", 0, "a", 0.0, 100.0), ("r", "B", 1, "b", 50.0, 170.0), ("r", "A", 2, "c", 160.0, 165.0), ("r", "B", 3, "d", 100.0, 100.0)], UTT)
    r = {x.speaker_id: x for x in conv.overlap_measures(u).collect()}
    assert math.isclose(r["A"].discourse_overlap_s, 55.0) and math.isclose(r["A"].discourse_overlap_ratio, 55 / 105)


def test_trees(spark):
    s = "recording_id string, speaker_id string, utt_idx int, tok_idx int, token_id string, dep_head string, dep_rel string, is_word boolean"
    good = [("r", "P", 0, 0, "a", None, "root", True), ("r", "P", 0, 1, "b", "a", "obj", True), ("r", "P", 0, 2, "c", "b", "advcl", True)]
    u = spark.createDataFrame([("r", "P", 0, "u", 0.0, 1.0), ("s", "P", 0, "u", 0.0, 1.0)], UTT)
    bad = [("s", "P", 0, 0, "a", None, "root", True), ("s", "P", 0, 1, "b", "c", "obj", True), ("s", "P", 0, 2, "c", "b", "advcl", True)]
    r = {x.recording_id: x for x in morph.dependencies(spark.createDataFrame(good + bad, s), u).collect()}
    assert r["r"].morph_tree_depth_max == 2 and math.isclose(r["r"].morph_dependency_length_mean_tokens, 1.0) and r["r"].morph_clause_count == 2
    assert r["s"].morph_tree_depth_max is None and r["s"].morph_dep_root_ratio is None


def test_coherence(spark):
    r = clinical.lexical_coherence(toks(spark, ["a b c", "b c d", "x"])).first()
    assert math.isclose(r.discourse_local_lexical_coherence, (2 / 4 + 0) / 2)


def test_alias_order_and_nearness(spark):
    al = spark.createDataFrame([("k1", 0, "window"), ("k2", 1, "windows"), ("k3", 2, "bridge")], "key string, key_pos int, alias string")
    v = spark.createDataFrame([("windows",), ("windowss",), ("bridg",), ("x",), (None,), ("",)], "v string")
    # 'windows' equals a later key's alias, which beats nearness to an earlier one.
    assert {(r.v, r.key) for r in tasks.match_aliases(v, "v", al).collect()} == {("windows", "k2"), ("windowss", "k2")}
    edge = spark.createDataFrame([("abcdefghijklmnopqrst", ), ], "v string")
    twenty = spark.createDataFrame([("k", 0, "abcdefghijklmnopqxyz")], "key string, key_pos int, alias string")
    assert tasks.match_aliases(edge, "v", twenty).count() == 1  # exactly 0.85


def test_recall_order(spark):
    rng = random.Random(5)
    for _ in range(3):
        order = rng.sample(range(8), rng.randrange(1, 9))
        hits = spark.createDataFrame([("r", "P", 0, i, k) for i, k in enumerate(order)] + [("r", "P", 1, 0, order[0])], "recording_id string, speaker_id string, utt_idx int, tok_idx int, key_pos int")
        best = [1] * len(order)
        for i in range(len(order)):
            best[i] = max([best[j] + 1 for j in range(i) if order[j] < order[i]], default=1)
        assert math.isclose(tasks.recall_order(hits, 8).first().task_recall_order_score, max(best) / 8)


def test_vowel_space(spark):
    rows = [("r", "t1", "vowel", "i", 300.0, 2400.0, 0.0), ("r", "t2", "vowel", "a", 800.0, 1200.0, 1.0), ("r", "t3", "vowel", "u", 350.0, 700.0, 2.0)]
    r = motor.vowel_space(spark.createDataFrame(rows, "recording_id string, token_id string, segment_type string, segment_label string, f1_hz double, f2_hz double, start_s double")).first()
    assert r.artic_vowel_space_area_hz2 == 395000 and math.isclose(r.artic_vowel_articulation_index, 3200 / 2550)


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edits(spark):
    rng = random.Random(0)
    text = lambda: " ".join(rng.choice(["a", "b", "cá", "d_e"]) for _ in range(rng.randrange(12)))
    rows = [(i, text(), text()) for i in range(60)] + [(97, None, "a b"), (98, "", None), (99, " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1, 3000)))]
    for r in ev.edit_counts(spark.createDataFrame(rows, "k long, g string, p string"), "g", "p", ["syer", "wer", "cer"]).collect():
        g, p = r.g or "", r.p or ""
        syllables = [x.replace("_", " ").split() for x in (g, p)]
        if r.k == 99:
            assert (r.wer_edits, r.wer_ref, r.syer_edits) == (1, 3000, 1)
            continue
        assert (r.wer_edits, r.wer_ref) == (brute_edits(g.split(), p.split()), len(g.split()))
        assert (r.syer_edits, r.syer_ref) == (brute_edits(*syllables), len(syllables[0]))
        assert (r.cer_edits, r.cer_ref) == (brute_edits(*("".join(x) for x in syllables)), len("".join(syllables[0])))


def test_overlapping_hypotheses_count_twice_up_to_the_interval(spark):
    s = "recording_id string, speaker string, start_ms long, end_ms long"
    ref = spark.createDataFrame([("r", "A", 0, 2000), ("s", "A", 0, 400), ("t", None, 0, 1000)], s)
    hyp = spark.createDataFrame([("r", "A", 0, 1500), ("r", "A", 500, 1500), ("u", "A", 0, 9), ("t", None, 0, 500), ("r", "A", 7, 7)], s)
    got = {x.recording_id: (x.reference_ms, x.uncovered_ms, x.der) for x in ev.diarization_error(ref, hyp).collect()}
    assert got == {"r": (1500, 0, 0.0), "s": (0, 0, 0.0), "t": (500, 250, 0.5), "u": (0, 0, 0.0)}


def test_meeting_with_a_wrong_end_far_away(spark):
    rng = random.Random(2)
    iv = lambda n: [("r", i, s := rng.randrange(0, 5000), s + rng.choice([1, 50, 700])) for i in range(n)]
    a, b = iv(60) + [("r", 900, 3, 10**15), (None, 901, 0, 10)], iv(60) + [("r", 800, 2, 1)]
    got = intervals.meet(spark.createDataFrame(a, "k string, i long, s long, e long"), spark.createDataFrame(b, "k string, j long, t long, u long"), ["k"], ("s", "e"), ("t", "u"), 100).collect()
    assert sorted((r.i, r.j, r.lo, r.hi) for r in got) == sorted((x[1], y[1], max(x[2], y[2]), min(x[3], y[3])) for x in a for y in b if x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3]))


def test_windows_end_with_the_sound(spark):
    w = spark.createDataFrame([("r", 0, 1000), ("q", 0, 1000), ("p", 5000, 6000)], "recording_id string, start_ms long, end_ms long")
    sound = spark.createDataFrame([("r", 1010), ("p", 4000)], "recording_id string, sound_ms long")
    assert {tuple(r) for r in tr.window_merge(w, sound=sound).collect()} == {("r", 0, 1010), ("q", 0, 1030)}


SEG = "recording_id string, token_id long, segment_type string, segment_label string, start_s double, end_s double"


def test_rhythm_of_sequences(spark):
    """Neighbours of a class join across a gap, by summed lengths; another segment between them ends the interval."""
    a = [("a", 0, "vowel", "i", 0.0, 1.0), ("a", 1, "vowel", "i", 1.5, 2.0), ("a", 2, "stop", "t", 2.0, 2.5), ("a", 3, "pause", "", 2.5, 2.5), ("a", 4, "stop", "t", 2.5, 2.75), ("a", 5, "vowel", "i", 3.0, 3.5)]
    b, c = [("b", 0, "vowel", "i", 0.0, 1.0), ("b", 1, None, "i", 1.0, 2.0)], [("c", 0, "vowel", "i", 1.0, 1.0), ("c", 1, "stop", "t", 1.0, 2.0)]
    r = {x.recording_id: x for x in motor.rhythm(spark.createDataFrame(a + b + c, SEG)).collect()}
    assert math.isclose(r["a"].rhythm_percent_vocalic, 100 * 2 / 2.75) and math.isclose(r["a"].rhythm_rpvi_v, 1.0) and math.isclose(r["a"].rhythm_rpvi_c, 0.25) and math.isclose(r["a"].rhythm_npvi_v, 100.0)
    assert r["b"].rhythm_percent_vocalic is None and r["c"].rhythm_varco_c is None


def test_syllable_train(spark):
    row = lambda k, i, s, e, x="pa": (k, i, "vowel", x, s, e)
    rows = [row("a", 0, 0.0, 0.1), row("a", 1, 0.2, 0.9, "ta"), row("a", 2, 0.5, 0.6), row("tie", 0, 0.0, 0.1), row("tie", 1, 0.0, 0.2), row("one", 0, 0.0, 1.0), row("two", 0, 0.0, 0.1), row("two", 1, 0.5, 0.6, None), row("bad", 0, 0.0, 0.0), row("bad", 1, 1.0, 2.0)]
    r = {x.recording_id: x for x in motor.syllable_train(spark.createDataFrame(rows, SEG)).collect()}
    assert math.isclose(r["a"].task_ddk_rate_syllables_s, 3 / 0.6) and math.isclose(r["a"].task_ddk_decay_ratio, 0.2 / 0.3) and r["a"].task_ddk_sequential_alternating_ratio == 1.0
    assert all(v is None for k in ("tie", "one", "bad") for n, v in r[k].asDict().items() if n != "recording_id")
    assert r["two"].task_ddk_acceleration_syllables_s2 is None and r["two"].task_ddk_sequential_alternating_ratio is None and math.isclose(r["two"].task_ddk_inter_onset_mean_s, 0.5)


def test_unknown_clause_types(spark):
    s = "recording_id string, speaker_id string, sentence_id string, t_unit_id string, clause_id string, clause_type string, sentence_status string"
    rows = [("a", "P", "1", "1", "1", "Embedded ", "reduced"), ("a", "P", "1", "1", "2", "main", "reduced"), ("b", "P", "1", "1", "1", "relative", "reduced"), ("c", "P", "1", "n/a", "1", "main", "odd"), ("d", "P", "none", "1", "1", "main", "reduced")]
    r = {x.recording_id: x for x in clinical.units(spark.createDataFrame(rows, s)).collect()}
    assert (r["a"].morph_embedding_count, r["a"].morph_dependent_clause_ratio) == (1, 0.5) and (r["b"].morph_embedding_count, r["b"].morph_dependent_clause_ratio) == (None, None)
    assert r["b"].morph_reduced_sentence_ratio == 1.0 and r["c"].morph_reduced_sentence_ratio is None and r["c"].morph_t_unit_count is None and r["c"].morph_dependent_clause_ratio == 0.0
    assert r["d"].morph_sentence_count is None and r["d"].morph_embedding_count is None


def test_dependency_groups():
    """Each relation's group, as published for these measures."""
    want = {"root": "root", "nsubj": "subject", "nsubj:pass": "subject", "csubj": "subject", "csubj:pass": "subject", "obj": "object", "iobj": "object", "amod": "nominal_modifier", "nmod": "nominal_modifier", "nmod:poss": "nominal_modifier", "appos": "nominal_modifier", "compound": "nominal_modifier", "advmod": "adverbial_modifier", "obl": "adverbial_modifier", "obl:agent": "adverbial_modifier", "dislocated": "adverbial_modifier", "ccomp": "clausal_complement", "xcomp": "clausal_complement", "advcl": "clausal_complement", "acl": "clausal_complement", "acl:relcl": "clausal_complement", "conj": "coordination", "cc": "coordination", "case": "function", "mark": "function", "det": "function", "aux": "function", "aux:pass": "function", "cop": "function", "clf": "function"}
    assert {r: g for g, rs in morph.DEP_GROUPS.items() for r in rs} == want
    assert set(morph.CLAUSE_HEADS) == {"root", "ccomp", "xcomp", "advcl", "acl", "acl:relcl", "csubj", "csubj:pass"}


def test_overlap_of_a_monologue_is_missing(spark):
    u = spark.createDataFrame([("r", "A", 0, "a", 0.0, 10.0), ("s", "A", 0, "a", 0.0, 10.0), ("s", "B", 1, "b", 20.0, 30.0), ("t", "A", 0, "a", 0.0, 10.0), ("t", "B", 1, "b", 5.0, 30.0)], UTT)
    assert {(x.recording_id, x.speaker_id): x.time_overlap_s for x in conv.island_overlap(u).collect()} == {("r", "A"): None, ("s", "A"): 0.0, ("s", "B"): 0.0, ("t", "A"): 5.0, ("t", "B"): 5.0}


def test_diarization_error(spark):
    s = "recording_id string, speaker string, start_ms long, end_ms long"
    ref = spark.createDataFrame([("r", "A", 0, 10_000), ("r", "B", 20_000, 20_400)], s)
    assert ev.diarization_error(ref, spark.createDataFrame([("r", "B", 0, 10_000)], s)).first().der == 1.0
    assert ev.diarization_error(ref, spark.createDataFrame([("r", "A", 100, 5000)], s)).first().der == pytest.approx(4750 / 9500)


def test_retention_of_exactly_half(spark):
    s = "recording_id string, start_ms long, end_ms long"
    ref, win = spark.createDataFrame([("r", 0, 100), ("r", 200, 301), ("q", 0, 10)], s), spark.createDataFrame([("r", 50, 250)], s)
    r = {x.recording_id: x for x in ev.retention(ref, win).collect()}
    assert (r["r"].retained_utterances, r["r"].retained_ms, r["q"].retained_ms) == (1, 100, 0)


def test_gate_and_selection(spark):
    d = spark.createDataFrame([(95, 100), (94, 100), (0, 0)], "a long, b long")
    assert [r[0] for r in d.select(ev.gate(F.col("a"), F.col("b"))).collect()] == [True, False, None]
    arms = spark.createDataFrame([("x", 0.300, 0.4, 9.0, True), ("y", 0.310, 0.4, 1.0, True), ("z", 0.311, 0.4, 0.1, True), ("w", 0.1, 0.4, 0.1, False)], "arm string, rate double, base double, rt double, ok boolean").withColumn("g", F.lit(1))
    assert ev.select_arm(arms, ["g"], "rate", "base", "ok", [F.col("rt").asc_nulls_last(), F.col("arm")]).first().arm == "y"  # a tie of exactly one point


def test_auroc_with_ties(spark):
    rows = [(0.1, False), (0.4, True), (0.4, False), (0.8, True), (None, True)]
    pos, neg = [s for s, y in rows if y and s is not None], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert math.isclose(ev.auroc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first().auroc, want)


def test_bootstrap_is_seeded():
    v = [0.1, 0.5, 0.9, None, float("nan")]
    assert ev.bootstrap(v, seed=3) == ev.bootstrap(v, seed=3) and ev.bootstrap([]) is None
    lo, hi = ev.bootstrap(v, seed=3)
    assert 0.1 <= lo <= 0.5 <= hi <= 0.9


def test_cross_validation(spark):
    rng = random.Random(1)
    rows = [(f"p{i}", float(i % 2), i % 2 + rng.gauss(0, 0.3) if i % 7 else None, 1.0) for i in range(60)]
    out = ev.cross_validated(spark.createDataFrame(rows, "p string, y double, x double, constant double"), ["x", "constant"], "y", "p", folds=3, strengths=(0.1,))
    assert out.count() == 60 and ev.auroc(out.withColumn("y", F.col("label") > 0.5), "probability", "y").first().auroc > 0.8


def test_retraces_and_loops(spark):
    r = tr.retraces(toks(spark, ["a b a b c c c", "x &um x"])).collect()
    assert {(x.utt_idx, x.tok_idx, x.n, x.text) for x in r} == {(0, 0, 2, "a b"), (0, 4, 1, "c"), (0, 5, 1, "c"), (1, 0, 1, "x")}
    lo = tr.loops(toks(spark, ["k " * 8 + "z", "k " * 7]), ["utt_idx"], "tok_idx", "norm").collect()
    assert [(x.utt_idx, x.first, x.length) for x in lo] == [(0, 0, 8)]


def test_numbers_and_windows(spark):
    assert [tr.spell_number(n) for n in (0, 15, 21, 24, 105, 1005, 1_000_010)] == ["không", "mười lăm", "hai mươi mốt", "hai mươi tư", "một trăm lẻ năm", "một nghìn không trăm lẻ năm", "một triệu không trăm mười"]
    t = tr.spelled_text(spark.createDataFrame([("có 5% và 007, 12.",), (None,)], "t string"), "t").collect()
    assert t[0].spelled == "có năm phần trăm và 007, mười hai." and t[1].spelled is None
    w = tr.window_merge(spark.createDataFrame([("r", 0, 1000), ("r", 1700, 2000), ("r", 2701, 45_000)], "recording_id string, start_ms long, end_ms long")).collect()
    assert sorted((x.start_ms, x.end_ms) for x in w) == [(0, 2030), (2671, 22_671), (22_671, 42_671), (42_671, 45_030)]


def test_word_groups(spark):
    w = spark.createDataFrame([("u", 0, 2), ("u", 1, 1), ("v", 0, 2)], "u string, pos int, size int")
    s = spark.createDataFrame([("u", 0, 0, 5), ("u", 1, 6, 9), ("u", 2, 10, 12), ("v", 0, 1, 2)], "u string, pos int, start_ms long, end_ms long")
    assert {tuple(r) for r in tr.group_words(w, s, ["u"]).collect()} == {("u", 0, 0, 9, True), ("u", 1, 10, 12, True), ("v", 0, None, None, False)}


def test_spectral_shape(spark):
    p = [0.0, 1.0, 3.0, 0.0]
    r = fr.spectral_shape(spark.createDataFrame([(p,), ([0.0, 0.0],), (None,)], "p array<double>"), "p", 10.0).collect()
    c = (10 + 60) / 4
    assert math.isclose(r[0].centroid, c) and math.isclose(r[0].spread, math.sqrt((1 * (10 - c) ** 2 + 3 * (20 - c) ** 2) / 4)) and r[0].rolloff_85 == 20.0 and r[1].centroid is None and r[2].entropy is None
    assert math.isclose(r[0].entropy, -(0.25 * math.log(0.25) + 0.75 * math.log(0.75)) / math.log(4))


def series(spark, **values):
    return spark.createDataFrame([(k, float(i), None if x is None else float(x)) for k, xs in values.items() for i, x in enumerate(xs)], "k string, o double, v double")


def test_nonlinear_measures(spark, monkeypatch):
    rng = np.random.default_rng(0)
    noise = rng.normal(size=4000)
    data = dict(white=10 + noise, brown=1000 + np.cumsum(noise), wave=2 + np.sin(np.arange(300) / 5), flat=np.full(100, 0.01), short=1 + rng.random(63), just=1 + rng.random(64), gap=[*(1 + rng.random(70)), None], low=[*(1 + rng.random(70)), 0.0], long=1 + rng.random(1500))
    monkeypatch.setattr(nonlinear, "PLACES", 150)
    r = {x.k: x for x in nonlinear.nonlinear(series(spark, **data), "k", "o", "v").collect()}
    assert set(r) == set(data)
    assert abs(r["white"].voice_dfa - 0.5) < 0.08 and abs(r["brown"].voice_dfa - 1.5) < 0.15
    assert all(getattr(r[k], n) is None for k in ("short", "gap", "low") for n in nonlinear.NAMES) and all(getattr(r["just"], n) is not None for n in nonlinear.NAMES)
    assert r["flat"].voice_pitch_period_entropy == 0.0 and r["flat"].voice_correlation_dimension is None and 0 < r["wave"].voice_rpde < 1
    assert r["long"].voice_correlation_dimension is None and 1.5 < r["just"].voice_correlation_dimension < 2.2
    # Against the formulas, written plainly.
    x = data["wave"]
    t = np.arange(len(x))
    left = np.log(x) - np.polyval(np.polyfit(t, np.log(x), 1), t)
    p = np.histogram(left, 32)[0] / len(x)
    assert math.isclose(r["wave"].voice_pitch_period_entropy, -sum(q * math.log(q) for q in p if q) / math.log(32), rel_tol=1e-9)
    c = np.array([sum(abs(x[i + k] - x[i]) <= 0.1 * x.std() for i in range(len(x) - k)) for k in range(1, 101)])
    p = c / c.sum()
    assert math.isclose(r["wave"].voice_rpde, -sum(q * math.log(q) for q in p if q) / math.log(100), rel_tol=1e-9)
    assert nonlinear.nonlinear(series(spark, a=[1.0]).limit(0), "k", "o", "v").count() == 0


def test_positions(spark):
    rows = [("hot" if i % 3 else "k", i * 7919 % 1009, i) for i in range(1009)]
    got = order.positions(spark.createDataFrame(rows, "k string, o long, v long").repartition(7), ["k"], ["o"], "at").collect()
    for k in ("hot", "k"):
        assert [r.o for r in sorted((r for r in got if r.k == k), key=lambda r: r.at)] == sorted(o for x, o, _ in rows if x == k) and sorted(r.at for r in got if r.k == k) == list(range(sum(x == k for x, *_ in rows)))
