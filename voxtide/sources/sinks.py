"""Writing documents and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtide.sources.documents import Documents


def to_json(docs: Documents) -> DataFrame:
    """(recording_id, content): each document as JSON of version 2, fields in fixed order."""
    tok = docs.tok.select("recording_id", "utt_idx", "tok_idx", F.struct(F.col("token_id").alias("id"), "text", "kind", "start_s", "end_s", "word_id", "language", "dep_head", "dep_rel").alias("t"))
    ordered = lambda c, *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, c))), lambda x: x[c])
    t = tok.groupBy("recording_id", "utt_idx").agg(ordered("t", "tok_idx").alias("tokens"))
    u = docs.utt.join(t, ["recording_id", "utt_idx"], "left").select("recording_id", "utt_idx", F.struct(F.col("utterance_id").alias("id"), "speaker_id", "start_s", "end_s", F.coalesce("tokens", F.array().cast(t.schema["tokens"].dataType)).alias("tokens")).alias("u"))
    u = u.groupBy("recording_id").agg(ordered("u", "utt_idx").alias("utterances"))
    s = docs.speakers.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct(F.col("speaker_id").alias("id"), "name", "role"))).alias("speakers"))
    m = docs.media.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("id"), "kind", "path"))).alias("media"))
    value = F.when(F.col("s_val").isNotNull(), F.to_json(F.struct(F.col("s_val").alias("v")))).otherwise(F.to_json(F.struct(F.col("d_val").alias("v"))))
    entry = F.concat(F.regexp_replace(F.to_json(F.struct(F.col("token_id").alias("v"))), r'^\{"v":|\}$', ""), F.lit(":"), F.regexp_replace(value, r'^\{"v":|\}$', ""))
    a = docs.ann.groupBy("recording_id", "layer_pos", "layer", "source", "confidence").agg(F.concat_ws(",", F.array_sort(F.collect_list(entry))).alias("vals"))
    one = F.concat(F.regexp_replace(F.to_json(F.struct("layer", "source", "confidence")), r"\}$", ""), F.lit(',"values":{'), F.col("vals"), F.lit("}}"))
    a = a.groupBy("recording_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("layer_pos", one.alias("j")))), lambda x: x["j"])).alias("layers"))
    d = u.join(s, "recording_id", "left").join(m, "recording_id", "left").join(a, "recording_id", "left")
    part = lambda c: F.coalesce(F.to_json(c), F.lit("[]"))
    head = F.regexp_replace(F.to_json(F.struct(F.lit(2).alias("version"), F.col("recording_id").alias("document_id"), F.lit("vie").alias("language"))), r"\}$", "")
    body = F.concat(head, F.lit(',"media":'), part("media"), F.lit(',"speakers":'), part("speakers"), F.lit(',"utterances":'), part("utterances"), F.lit(',"annotations":['), F.coalesce("layers", F.lit("")), F.lit('],"raw_tiers":{}}'))
    return d.select("recording_id", body.alias("content"))


def to_chat(docs: Documents) -> DataFrame:
    """(recording_id, content): each document as CHAT text; kept tiers come back as they were, %mor and %gra from their layers.

    A document without media can't be written so and is left out.
    """
    num = lambda c: F.regexp_replace(F.format_string("%.3f", c), r"\.?0+$", "")
    line = lambda df, place, i, j, text: df.select("recording_id", F.lit(place).alias("place"), i.cast("long").alias("i"), F.lit(j).alias("j"), text.alias("line"))
    m = docs.media.groupBy("recording_id").agg(F.min("path").alias("path"), F.min("kind").alias("kind"))
    zero = F.lit(0)
    parts = [line(m, 0, zero, 0, F.lit("@Begin")), line(m, 0, zero, 1, F.lit("@Languages:\tvie")), line(m, 9, zero, 0, F.lit("@End")), line(m, 3, zero, 0, F.concat(F.lit("@Media:\t"), "path", F.lit(" | "), "kind"))]
    sp = docs.speakers.join(m, "recording_id", "left_semi")
    names = sp.groupBy("recording_id").agg(F.concat_ws(", ", F.array_sort(F.collect_list(F.concat_ws(" ", "speaker_id", "name")))).alias("p"))
    parts += [line(names, 1, zero, 0, F.concat(F.lit("@Participants:\t"), "p")), line(sp, 2, F.dense_rank().over(_by("recording_id", "speaker_id")), 0, F.concat_ws("|", F.lit("@ID:\tvie"), "speaker_id", "name", "role", F.lit("")))]
    text = docs.tok.groupBy("recording_id", "utt_idx").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "text"))), lambda x: x["text"])).alias("text"))
    u = docs.utt.join(m, "recording_id").join(text, ["recording_id", "utt_idx"], "left")
    parts.append(line(u, 4, F.col("utt_idx"), 0, F.concat(F.lit("*"), "speaker_id", F.lit(":\t"), F.coalesce("text", F.lit("")))))
    parts.append(line(u.where("start_s is not null and end_s is not null"), 4, F.col("utt_idx"), 1, F.concat(F.lit("%xaud:\t"), "path", F.lit(" "), num("start_s"), F.lit(" "), num("end_s"))))
    layer = docs.ann.where("layer in ('wor', 'mor', 'gra') and s_val is not null").join(docs.tok.select("recording_id", "token_id", "utt_idx", "tok_idx"), ["recording_id", "token_id"]).join(m, "recording_id", "left_semi")
    tiers = layer.groupBy("recording_id", "utt_idx", "layer").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "s_val"))), lambda x: x["s_val"])).alias("text"))
    j = F.when(F.col("layer") == "wor", 2).when(F.col("layer") == "mor", 3).otherwise(4)
    parts.append(tiers.select("recording_id", F.lit(4).alias("place"), F.col("utt_idx").cast("long").alias("i"), j.alias("j"), F.concat(F.lit("%"), "layer", F.lit(":\t"), "text").alias("line")))
    parts.append(line(docs.raw.join(m, "recording_id", "left_semi"), 8, F.col("line_no"), 0, F.col("line")))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("recording_id").agg(F.concat(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("place", "i", "j", "line"))), lambda x: x["line"])), F.lit("\n")).alias("content"))


def _by(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)


def write_bundle(spark: SparkSession, bundle, folder: str, force: bool = False) -> None:
    """recordings, utterances and issues as CSV folders, and provenance.json; refuses to overwrite unless forced."""
    mode = "overwrite" if force else "errorifexists"
    for name in ("recordings", "utterances", "issues"):
        getattr(bundle, name).write.mode(mode).option("header", True).csv(f"{folder}/{name}.csv")
    spark.createDataFrame([(bundle.provenance,)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/provenance.json")
