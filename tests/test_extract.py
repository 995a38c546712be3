import io
import json
import wave

import numpy as np

from voxtide.extract import TaskSpec, extract
from voxtide.sources import documents


def document(name, words):
    toks = lambda u: [{"id": f"u{u}_t{k}", "text": w, "kind": "filler" if w == "ờ" else "word", "start_s": u * 3 + 0.1 * k, "end_s": u * 3 + 0.1 * k + 0.08} for k, w in enumerate(words)]
    utts = [{"id": f"u{u}", "speaker_id": "PAR" if u % 2 else "INV", "start_s": u * 3, "end_s": u * 3 + 2.5, "tokens": toks(u)} for u in range(4)]
    return json.dumps({"version": 2, "document_id": name, "language": "vie", "media": [], "speakers": [{"id": "PAR", "name": "L", "role": "p"}, {"id": "INV", "name": "M", "role": "i"}], "utterances": utts, "annotations": [], "raw_tiers": {}})


def sound():
    t = np.arange(16000 * 12) / 16000
    x = 0.3 * np.sin(2 * np.pi * 150 * t) * (np.sin(2 * np.pi * 0.4 * t) > -0.6)
    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000), w.writeframes((x * 32000).astype("<i2").tobytes())
    return bytearray(b.getvalue())


def test_batch(spark):
    d = documents.read_json(spark.createDataFrame([("a", document("d1", "tôi thấy ờ con chó con mèo".split())), ("b", "{nope"), ("c", document("d2", ["x"]))], "path string, content string"))
    audio = spark.createDataFrame([("d1", "d1.wav", sound())], "recording_id string, path string, content binary")
    want = spark.createDataFrame([("d1", "PAR")], "recording_id string, speaker_id string")
    b = extract(d, wanted=want, audio=audio, spec=TaskSpec("picture", {"dog": ["chó"], "cat": ["mèo"], "tree": ["cây"]}))
    r, u, i = b.recordings.toPandas(), b.utterances.toPandas(), b.issues.toPandas()
    assert list(r.columns) == ["recording_id", "speaker_id", *sorted(r.columns[2:])] and len(r) == 1 and r.lex_word_count[0] == 12
    assert abs(r.task_picture_concept_coverage[0] - 2 / 3) < 1e-9 and 145 < r.voice_f0_median_hz[0] < 155
    own = [c for c in r.columns[2:]]
    eg = [c for c in u.columns if c.startswith("egemaps")]
    missing = int(r[own].isna().sum().sum()) + int(u.drop(columns=eg).iloc[:, 5:].isna().sum().sum())
    assert missing == i.feature.notna().sum() and not i[i.feature.notna()].duplicated(["recording_id", "speaker_id", "utterance_id", "feature"]).any()
    assert {("d2", "TARGET_SPEAKER_REQUIRED"), ("b", "INVALID_DOCUMENT")} <= set(zip(i.recording_id, i.code))
    assert json.loads(b.provenance)["features"] == 485


def test_packs_are_pruned(spark):
    d = documents.read_json(spark.createDataFrame([("a", document("d1", ["a"]))], "path string, content string"))
    b = extract(d, wanted=spark.createDataFrame([("d1", "PAR"), ("d1", "XXX")], "recording_id string, speaker_id string"), packs=["motor_neuro"])
    assert len(b.recordings.columns) == 2 + 47 and {r.code for r in b.issues.collect()} == {"MISSING_ANNOTATION", "UNKNOWN_TARGET_SPEAKER"}
