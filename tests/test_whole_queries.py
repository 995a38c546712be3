"""Queries over all their words, against brute force and SQL of their own."""

import os

import pytest

from voxtide.plans import layer_queries as lq, speech_queries as sq

DATA = os.environ.get("VOXTIDE_TESTDATA", "/root/testdata/sf0.001")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def key_of(w):
    exact = [k for k, a in lq.ALIASES if a == w]
    near = [k for k, a in lq.ALIASES if 1 - edits(w, a) / max(len(w), len(a)) >= 0.85]
    return min(exact or near, key=lq.CONCEPTS.index, default=None)


def test_words_of_any_letters_are_matched(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lq, "ALIASES", (*lq.ALIASES, ("bus", "nghiêng-nghiêng"), ("corner", "đường-phố-nhỏ")))
    said = {"r1": ["window", "Cửa", "sổ,", "nghiêng-nghiêng", "nghiêng-nghiềng", "đường-phố-nho", "bridgess", "it's", "x2", "..."], "r2": ["Đường", "phố", "đẹp"]}
    segs, words = [(i, r, 0, 0, 900, "", None) for i, r in enumerate(said)], []
    for i, (r, ws) in enumerate(said.items()):
        words += [(100 * i + n, r, i, n, w, 50 * n, 50 * n + 40) for n, w in enumerate(ws)]
    save = lambda rows, kinds, name: spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    save(segs, "segment_id long, recording_id string, segment_no int, start_ms long, end_ms long, text string, decoded_at timestamp", "asr_segment")
    save(words, "word_id long, recording_id string, segment_id long, word_no int, word string, start_ms long, end_ms long", "word_timing")
    save([("r1", ["PAR"]), ("r2", ["PAR"])], "recording_id string, utterance_speakers array<string>", "speaker_result")
    save([("um", "filler", "en")], "form string, kind string, lang string", "nonword_form")
    d = str(tmp_path)
    norms = {r: [n for w in ws if (n := w.lower().strip(",."))] for r, ws in said.items()}
    keys = {n: k for ns in norms.values() for n in ns if (k := key_of(n))}
    assert {"nghiêng-nghiêng", "nghiêng-nghiềng", "đường-phố-nho"} <= set(keys)
    assert {r.norm: r.key for r in lq.alias_match(spark, d).collect()} == keys
    got = {r.recording_id: r for r in lq.picture_coverage(spark, d).collect()}
    assert set(got) == set(said)
    for r, ns in norms.items():
        hits = [keys[n] for n in ns if n in keys]
        assert got[r].task_picture_concept_coverage == round(len(set(hits)) / len(lq.CONCEPTS), 6)
        assert got[r].task_picture_concept_density == round(len(set(hits)) / len(ns), 6)
        assert got[r].task_repeat_ratio == (round((len(hits) - len(set(hits))) / len(hits), 6) if hits else None)
    # In order of mention r1 names window, bus, bus, corner, bridge: three of the first mentions rise.
    order = {r.recording_id: r for r in lq.recall_order(spark, d).collect()}
    assert [v for k, v in order["r1"].asDict().items() if k not in ("recording_id", "speaker_id")] == [pytest.approx(3 / len(lq.CONCEPTS), abs=1e-6)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_sessions_of_words_without_a_segment(spark):
    import duckdb

    want = duckdb.sql(f"""
        WITH w AS (SELECT DISTINCT recording_id, word_id, start_ms AS s, end_ms AS e FROM '{DATA}/word_timing.parquet' WHERE recording_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL),
        c AS (SELECT *, CASE WHEN s - lag(e) OVER q <= 700 THEN 0 ELSE 1 END AS cut FROM w WINDOW q AS (PARTITION BY recording_id ORDER BY s, e, word_id)),
        r AS (SELECT *, sum(cut) OVER (PARTITION BY recording_id ORDER BY s, e, word_id ROWS UNBOUNDED PRECEDING) AS no FROM c)
        SELECT recording_id, no::BIGINT, count(*), min(s), max(e) FROM r GROUP BY ALL""").fetchall()
    got = [(r.recording_id, r.session_no, r.words, r.start_ms, r.end_ms) for r in sq.session_split_700ms(spark, DATA).collect()]
    assert sorted(got) == sorted(want)
    loose = {r for (r,) in duckdb.sql(f"SELECT DISTINCT recording_id FROM '{DATA}/word_timing.parquet' WHERE segment_id IS NULL").fetchall()}
    assert loose and loose <= {r for r, *_ in got}
