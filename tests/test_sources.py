import io
import json
import struct
import wave

import numpy as np
import pytest

from voxtide import catalog
from voxtide.sources import documents, manifests, sinks, tiers, wav

CHAT = (
    "@UTF8\n@Begin\n@Languages:\tvie\n@Participants:\tPAR Lan, INV Minh\n@ID:\tvie|PAR|Lan|Participant|\n@Media:\ta.wav | audio\n*INV:\tbạn thấy gì ? \x150_1500\x15\n*PAR:\ttôi tôi [/] thấy &-ờ cửa-sổ\n\tđẹp . \x151600_4000\x15\n"
    "%wor:\ttôi \x151600_1800\x15 tôi \x151800_2000\x15 thấy \x152000_2400\x15 ờ \x152400_2500\x15 cửa-sổ \x152500_3000\x15 đẹp \x153000_3500\x15 .\n%mor:\tpron verb noun adj .\n%pho:\tabc\n@End\n"
)


def files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def test_chat(spark):
    d = documents.read_chat(files(spark, a=CHAT, b=CHAT.replace("vie\n", "eng\n", 1), c="x", e=CHAT.replace("1800_2000", "1700_2000")))
    assert {r.recording_id: r.message for r in d.errors.collect()} == {"b": "@Languages must be 'vie'", "c": "CHAT file must start with @Begin"}
    t = {(r.recording_id, r.token_id): r for r in d.tok.collect()}
    assert t["a", "u0002_t0005"].kind == "filler" and t["a", "u0002_t0006"].start_s == 2.5 and t["a", "u0002_t0003"].kind == "retracing"
    assert t["e", "u0002_t0006"].start_s is None  # times that don't rise are not believed
    w = {(r.recording_id, r.code) for r in d.warnings.collect()}
    assert w == {("a", "UNSUPPORTED_CHAT_TIER"), ("e", "UNSUPPORTED_CHAT_TIER"), ("e", "UNTRUSTED_CHAT_WOR")}
    mor = {(r.token_id, r.s_val) for r in d.ann.where("recording_id = 'a' and layer = 'mor'").collect()}
    assert ("u0002_t0001", "pron") in mor and ("u0002_t0002", "verb") not in mor and len(mor) == 5
    assert {(r.speaker_id, r.name) for r in d.speakers.where("recording_id = 'a'").collect()} == {("PAR", "Lan"), ("INV", "Minh")}


def test_chat_round_trip(spark):
    d = documents.read_chat(files(spark, a=CHAT))
    text = sinks.to_chat(d).first().content
    again = documents.read_chat(files(spark, a=text))
    key = ["utt_idx", "tok_idx", "text", "kind"]
    assert again.errors.count() == 0 and sorted(map(tuple, again.tok.select(*key).collect())) == sorted(map(tuple, d.tok.select(*key).collect()))
    assert sorted(map(tuple, again.utt.select("utt_idx", "start_s", "end_s").collect())) == sorted(map(tuple, d.utt.select("utt_idx", "start_s", "end_s").collect()))


def test_roles(spark):
    items = "<tôi đi> [//] tôi (.) &=ho xxx về- [: x y] .".split()
    t = spark.createDataFrame([("u", i, x) for i, x in enumerate(items)], "u string, tok_idx int, text string")
    assert [r.tier_role for r in tiers.tier_roles(t, ["u"]).orderBy("tok_idx").collect()] == ["retraced", "retraced", "skip", "word", "skip", "skip", "untranscribed", "skip", "skip", "skip", "skip", "word"]


def doc(**kw):
    return {"version": 2, "document_id": "d", "language": "vie", "media": [], "speakers": [{"id": "P", "name": "x", "role": ""}], "utterances": [{"id": "u1", "speaker_id": "P", "start_s": 0, "end_s": 2.0, "tokens": [{"id": "t1", "text": "Má"}, {"id": "t2", "text": "b", "dep_head": "t1"}]}], "annotations": [{"layer": "pos", "source": "x", "confidence": 0.9, "values": {"t1": "NOUN", "t2": 3}}], "raw_tiers": {}} | kw


def test_json(spark):
    bad = [doc(document_id="l", language="eng"), doc(document_id="s", utterances=[{"id": "u", "speaker_id": "Q", "start_s": 0, "end_s": 1, "tokens": []}]), doc(document_id="t", utterances=[{"id": "u", "speaker_id": "P", "start_s": 2, "end_s": 1, "tokens": []}]), doc(document_id="a", annotations=[{"layer": "x", "confidence": 2, "values": {}}])]
    v1 = {"version": 1, "transcript_id": "old", "utterances": [{"speaker": "examiner", "start_s": 0, "end_s": 1, "tokens": [{"kind": "filler", "text": "ờ"}]}]}
    d = documents.read_json(files(spark, good=json.dumps(doc()), v1=json.dumps(v1), nope="{", **{f"b{i}": json.dumps(b) for i, b in enumerate(bad)}))
    assert {r.recording_id for r in d.errors.collect()} == {"nope", "l", "s", "t", "a"}
    t = {r.token_id: r for r in d.tok.collect()}
    assert t["t1"].norm == "má" and t["u0001_t0001"].kind == "filler" and t["t1"].kind == "word"
    assert {(r.token_id, r.s_val, r.d_val) for r in d.ann.collect()} == {("t1", "NOUN", None), ("t2", None, 3.0)}
    again = documents.read_json(sinks.to_json(d).withColumnRenamed("recording_id", "path"))
    assert again.errors.count() == 0 and sorted(map(str, again.tok.collect())) == sorted(map(str, d.tok.collect())) and sorted(map(str, again.ann.collect())) == sorted(map(str, d.ann.collect()))


def test_manifests(spark, tmp_path):
    rows = [{"recording_id": "a", "audio_path": "a.wav", "transcript_path": "a.json", "target_speakers": ["P", "Q"]}, {"recording_id": "b", "audio_path": "", "transcript_path": "b"}, {"recording_id": "c", "audio_path": "x", "transcript_path": "y"}, {"recording_id": "c", "audio_path": "x", "transcript_path": "y"}]
    (tmp_path / "m.json").write_text(json.dumps({"version": 2, "rows": rows}))
    good, bad = manifests.read_batch(spark, str(tmp_path / "m.json"), "/base")
    assert [r.audio_path for r in good.collect()] == ["/base/a.wav"] and bad.count() == 3 and manifests.targets(good).count() == 2
    study = [{"session_id": "s1", "participant_id": "p1", "audio_path": "x", "channel_index": 0, "sha256": "a" * 64, "split": "dev", "reference_path": "r", "asr_revision": "1"}, {"session_id": "secret name!", "participant_id": "p", "sha256": "b" * 64, "split": "dev", "channel_index": 0}]
    (tmp_path / "s.json").write_text(json.dumps({"version": 1, "rows": study}))
    good, bad = manifests.read_study(spark, str(tmp_path / "s.json"))
    assert good.count() == 1 and "secret" not in str(bad.collect())


def sound(x, width=2, rate=16000, channels=1):
    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        n = np.round(np.clip(x, -1, 1 - 2.0 ** -(8 * width - 1)) * 2 ** (8 * width - 1)).astype("<i8")
        if width == 1:
            n = n + 128
        w.writeframes(b"".join(struct.pack("<q", int(v))[:width] for v in n))
    return b.getvalue()


def test_wav(spark):
    t = np.arange(16000) / 16000
    x = 0.5 * np.sin(2 * np.pi * 200 * t)
    for width in (1, 2, 3, 4):
        y, rate, w = wav.decode(sound(x, width))
        assert (rate, w) == (16000, width) and np.abs(y[0] - x).max() < 2.0 ** -(8 * width - 2) + 1e-6
    rows = [("ok", bytearray(sound(x))), ("quiet", bytearray(sound(0 * x))), ("short", bytearray(sound(x[:240]))), ("bad", bytearray(b"RIFFxx"))]
    f = spark.createDataFrame(rows, "path string, content binary")
    i = {r.path: r for r in wav.info(f).collect()}
    assert i["ok"].audio_rms_dbfs == pytest.approx(20 * np.log10(0.5 / np.sqrt(2)), abs=1e-3) and i["quiet"].audio_rms_dbfs is None and i["bad"].error_code == "INVALID_AUDIO"
    fr = wav.frame_rows(f)
    n = {r.path: r["count"] for r in fr.where("error_code is null").groupBy("path").count().collect()}
    assert n == {"ok": 99, "quiet": 99} and fr.where("error_code is not null").count() == 1  # 240 samples give no frame
    assert fr.where("path = 'ok'").agg({"f0_hz": "avg"}).first()[0] == pytest.approx(200, abs=4)
    with pytest.raises(wav.AudioError):
        wav._mono(sound(x), 3)


def test_models(spark):
    from voxtide import adapters

    t = np.arange(16000) / 16000
    x = 0.5 * np.sin(2 * np.pi * 200 * t) * (t > 0.5)
    f = spark.createDataFrame([("a", bytearray(sound(x))), ("b", bytearray(b"no"))], "path string, content binary")
    r = {x.path: x for x in adapters.run("detector", "energy", f).collect()}
    assert abs(r["a"].start_ms - 500) <= 30 and r["a"].end_ms <= 1010 and r["b"].error_code == "INVALID_AUDIO"
    assert {x.error_code for x in adapters.run("asr", "nothing", f).collect()} == {"MODEL_UNAVAILABLE"}
    with pytest.raises(ValueError):
        adapters.register("other", "x", adapters.energy_detector)


def test_resample():
    z = wav.resample(np.sin(2 * np.pi * 440 * np.arange(44100) / 44100), 44100)
    assert len(z) == 16000 and np.abs(z[200:-200] - np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)[200:-200]).max() < 1e-4


def test_catalog(spark):
    fs = catalog.features()
    assert len({f.key for f in fs}) == len(fs) == 485
    assert [len(catalog.keys(p)) for p in catalog.PACKS] == [167, 183, 47, 88]
    assert catalog.table(spark, pack="motor_neuro").count() == 47
    with pytest.raises(ValueError):
        catalog.table(spark, domain="nope")
    with pytest.raises(ValueError):
        catalog.select("packs", catalog.PACKS, ["acoustic", "acoustic"])


def test_streams(spark, tmp_path):
    from voxtide.streaming.sessions import distinct_rows, word_sessions

    src = spark.createDataFrame([("r", 1, "2025-01-01 00:00:00.000"), ("r", 2, "2025-01-01 00:00:00.500"), ("r", 2, "2025-01-01 00:00:00.500"), ("r", 3, "2025-01-01 00:00:05.000")], "recording_id string, word_id int, t string").selectExpr("recording_id", "word_id", "cast(t as timestamp) aligned_at")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = word_sessions(stream).writeStream.format("memory").queryName("ses").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert sorted(r.words for r in spark.table("ses").collect()) == [1, 3]
    q = distinct_rows(stream, "word_id", "aligned_at").writeStream.format("memory").queryName("dis").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert spark.table("dis").count() == 3


@pytest.mark.parametrize(
    "said, roles, words",
    [
        ("ba ba [/] bà &-ừm (1.5) đi", "w r s w f s w", "0ba 3bà 6đi"),
        ("<con mèo> [: con chó] chạy .", "w w s s s w w", "0con 0chó 5chạy 6."),
        ("mèoo [: mèo] [: mèo con] ngủ", "w s s s s s w", "0mèo 0con 6ngủ"),
        ("một hai> [/] ba", "w r s w", "0một 3ba"),
        ("[= cười [x] y] XXX, [: a]", "s s s w u s s", "3y]"),
        ("đi [= nhanh quá] [//] chạy", "r s s s s w", "5chạy"),
        ("<a b> (.) [/] a b", "r r s s w w", "4a 5b"),
        ("[/] a &+uh &=x", "s w s s", "1a"),
        ("một [: hai ba", "w s s s", "0hai 0ba"),
    ],
)
def test_roles_and_words_of_tiers(spark, said, roles, words):
    names = {"w": "word", "r": "retraced", "s": "skip", "f": "filler", "u": "untranscribed"}
    t = tiers.tier_roles(spark.createDataFrame([("u", i, x) for i, x in enumerate(said.split())] + [("v", 0, "[/]")], "u string, tok_idx int, text string"), ["u"])
    assert [r.tier_role for r in t.where("u = 'u'").orderBy("tok_idx").collect()] == [names[x] for x in roles.split()]
    assert " ".join(f"{r.source}{r.surface}" for r in tiers.morphology_words(t, ["u"]).orderBy("source", "part").collect()) == words
