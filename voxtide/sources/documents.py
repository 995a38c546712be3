"""Transcript documents as relations: JSON of both versions and CHAT text.

A document that is not valid becomes a row of ``errors`` and none elsewhere, so
one bad file never stops a batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxtide.sources.tiers import item_kind, tier_roles

# Token kinds of both formats, and the language that documents may have.
KINDS = ("word", "filler", "fragment", "noise", "retracing", "revision", "error")
LANGUAGE = "vie"


@dataclass
class Documents:
    """``utt`` (recording_id, utt_idx, utterance_id, speaker_id, start_s, end_s), ``tok`` (.., tok_idx, token_id, text, norm,
    kind, start_s, end_s, word_id, language, dep_head, dep_rel), ``ann`` (recording_id, layer_pos, layer, source, confidence,
    token_id, s_val, d_val), ``speakers`` (recording_id, speaker_id, name, role), ``media`` (recording_id, path, kind),
    ``warnings`` (recording_id, code, tier, line), ``raw`` (recording_id, tier, line_no, line) and ``errors`` (recording_id, code, message)."""

    utt: DataFrame
    tok: DataFrame
    ann: DataFrame
    speakers: DataFrame
    media: DataFrame
    warnings: DataFrame
    raw: DataFrame
    errors: DataFrame


def _texts(f: Callable[[str], str]) -> Callable[[Column | str], Column]:
    """A text function as an Arrow-batched column function."""

    def apply(c: Column | str) -> Column:
        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series([None if x is None else f(x) for x in b], dtype=object)

        return run(F.col(c) if isinstance(c, str) else c)

    return apply


#: Composed form, and composed form without case: the normalizations that SQL lacks.
nfc = _texts(lambda x: unicodedata.normalize("NFC", x))
normalized = _texts(lambda x: unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).casefold()))


_TOKEN = "struct<id:string,text:string,kind:string,start_s:double,end_s:double,word_id:string,language:string,dep_head:string,dep_rel:string>"
_UTT = f"struct<id:string,speaker_id:string,speaker:string,start_s:double,end_s:double,tokens:array<{_TOKEN}>>"
JSON_SCHEMA = (
    "version int, document_id string, transcript_id string, language string, media array<struct<id:string,kind:string,path:string,sha256:string>>, "
    f"speakers array<struct<id:string,name:string,role:string>>, utterances array<{_UTT}>, annotations array<struct<layer:string,source:string,confidence:double,values:map<string,variant>>>, raw_tiers map<string,string>"
)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def sniff(content: Column, path: Column) -> Column:
    """'chat' or 'json', by suffix, else by what the content begins with."""
    return F.when(path.endswith(".cha"), "chat").when(path.endswith(".json"), "json").when(F.ltrim(content).startswith("{"), "json").when(content.rlike(r"\A﻿?@"), "chat")


def _first_error(rules: dict[str, Column]) -> Column:
    """The message of the first rule that holds."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in rules.items()))


def read_json(files: DataFrame) -> Documents:
    """Documents of version 2, and of version 1 with positional ids (u0001, u0001_t0001), from (path, content)."""
    spark = files.sparkSession
    d = files.withColumn("d", F.from_json("content", JSON_SCHEMA)).select("path", "d.*")
    v1 = F.col("version") == 1
    d = d.withColumn("recording_id", F.when(v1, F.coalesce("transcript_id", F.lit("document"))).otherwise(F.col("document_id")))
    d = d.withColumn("utterances", F.when(v1, F.transform("utterances", lambda u, i: u.withField("id", F.format_string("u%04d", i + 1)).withField("speaker_id", u["speaker"]).withField(
        "tokens", F.transform(F.coalesce(u["tokens"], F.array().cast(f"array<{_TOKEN}>")), lambda t, j: t.withField("id", F.format_string("u%04d_t%04d", i + 1, j + 1)))))).otherwise(F.col("utterances")))
    d = d.withColumn("speakers", F.when(v1, F.transform(F.array_distinct(F.transform("utterances", lambda u: u["speaker_id"])), lambda s: F.struct(s.alias("id"), s.alias("name"), F.lit("").alias("role")))).otherwise(F.col("speakers")))
    d = d.withColumn("language", F.when(v1, F.lit(LANGUAGE)).otherwise(F.col("language")))
    none = lambda c, f: F.exists(F.coalesce(c, F.array()), f)
    uniq = lambda a: F.size(F.array_distinct(a)) != F.size(a)
    us, ss = F.col("utterances"), F.col("speakers")
    toks = F.flatten(F.transform(us, lambda u: F.coalesce(u["tokens"], F.array().cast(f"array<{_TOKEN}>"))))
    bad_num = lambda x: F.isnan(x) | x.isin(float("inf"), float("-inf"))
    rules = {
        "document is not valid JSON of a known version": F.col("version").isNull() | ~F.col("version").isin(1, 2),
        "document_id must be a non-empty string": F.col("recording_id").isNull() | (F.col("recording_id") == ""),
        f"language must be '{LANGUAGE}'": ~F.col("language").eqNullSafe(LANGUAGE),
        "document must contain utterances": us.isNull(),
        "speaker ids must be unique and not empty": none(ss, lambda s: s["id"].isNull() | (s["id"] == "")) | uniq(F.transform(ss, lambda s: s["id"])),
        "utterance ids must be unique and not empty": none(us, lambda u: u["id"].isNull() | (u["id"] == "")) | uniq(F.transform(us, lambda u: u["id"])),
        "utterance references unknown speaker": F.size(F.array_except(F.transform(us, lambda u: u["speaker_id"]), F.coalesce(F.transform(ss, lambda s: s["id"]), F.array().cast("array<string>")))) > 0,
        "utterance times must be finite and in order": none(us, lambda u: u["start_s"].isNull() | u["end_s"].isNull() | bad_num(u["start_s"]) | bad_num(u["end_s"]) | (u["end_s"] < u["start_s"])),
        "token kind is unknown": F.exists(toks, lambda t: ~F.coalesce(t["kind"], F.lit("word")).isin(list(KINDS))),
        "token ids must be unique and not empty": F.exists(toks, lambda t: t["id"].isNull() | (t["id"] == "")) | uniq(F.transform(toks, lambda t: t["id"])),
        "token times outside utterance or out of order": none(us, lambda u: F.exists(F.coalesce(u["tokens"], F.array().cast(f"array<{_TOKEN}>")), lambda t: F.coalesce((t["start_s"] < u["start_s"]) | (t["end_s"] > u["end_s"]) | (t["end_s"] < t["start_s"]), F.lit(False)))),
        "token dep_head references unknown token": F.size(F.array_except(F.filter(F.transform(toks, lambda t: t["dep_head"]), lambda h: h.isNotNull()), F.transform(toks, lambda t: t["id"]))) > 0,
        "annotation confidence must be in [0, 1]": none(F.col("annotations"), lambda a: (a["confidence"] < 0) | (a["confidence"] > 1)),
        "annotation references unknown token": none(F.col("annotations"), lambda a: F.size(F.array_except(F.map_keys(a["values"]), F.transform(toks, lambda t: t["id"]))) > 0),
        "annotation layer must be a non-empty string": none(F.col("annotations"), lambda a: a["layer"].isNull() | (a["layer"] == "")),
    }
    d = d.withColumn("message", _first_error(rules))
    errors = d.where("message is not null").select(F.coalesce("recording_id", "path").alias("recording_id"), F.lit("INVALID_DOCUMENT").alias("code"), "message")
    ok = d.where("message is null")
    u = ok.select("recording_id", F.posexplode("utterances").alias("utt_idx", "u"))
    utt = u.select("recording_id", "utt_idx", F.col("u.id").alias("utterance_id"), F.col("u.speaker_id").alias("speaker_id"), F.col("u.start_s").alias("start_s"), F.col("u.end_s").alias("end_s"))
    t = u.select("recording_id", "utt_idx", F.col("u.speaker_id").alias("speaker_id"), F.posexplode("u.tokens").alias("tok_idx", "t")).select("recording_id", "utt_idx", "speaker_id", "tok_idx", F.col("t.id").alias("token_id"), nfc(F.coalesce("t.text", F.lit(""))).alias("text"), normalized(F.coalesce("t.text", F.lit(""))).alias("norm"), F.coalesce("t.kind", F.lit("word")).alias("kind"), *(F.col(f"t.{c}").alias(c) for c in ("start_s", "end_s", "word_id", "language", "dep_head", "dep_rel")))
    a = ok.select("recording_id", F.posexplode("annotations").alias("layer_pos", "a")).select("recording_id", "layer_pos", "a.layer", "a.source", F.coalesce("a.confidence", F.lit(1.0)).alias("confidence"), F.explode("a.values").alias("token_id", "v"))
    kind = F.schema_of_variant("v")
    number = F.when(~kind.isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get("v", "$", "double"))
    ann = a.select("recording_id", "layer_pos", "layer", "source", "confidence", "token_id", F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).alias("s_val"), number.alias("d_val"))
    speakers = ok.select("recording_id", F.explode("speakers").alias("s")).select("recording_id", F.col("s.id").alias("speaker_id"), nfc(F.coalesce("s.name", F.lit(""))).alias("name"), F.coalesce("s.role", F.lit("")).alias("role"))
    media = ok.select("recording_id", F.explode("media").alias("m")).select("recording_id", F.coalesce("m.path", F.lit("")).alias("path"), F.coalesce("m.kind", F.lit("audio")).alias("kind"))
    raw = ok.select("recording_id", F.explode("raw_tiers").alias("tier", "line")).select("recording_id", "tier", F.lit(0).alias("line_no"), "line")
    warnings = spark.createDataFrame([], "recording_id string, code string, tier string, line string")
    return Documents(utt, t, ann, speakers, media, warnings, raw, errors)


# --- CHAT ---


def read_chat(files: DataFrame, require_timing: bool = True) -> Documents:
    """CHAT texts as relations, from (path, content): tiers are lines, told apart and put together by windows over line numbers.

    Continuation lines join the line before them.  A tier that this subset doesn't know is kept as it is, with a warning;
    a %wor tier that doesn't fit its words, or whose times don't rise inside the utterance, is kept but not believed.
    """
    bullet = r"[\x15•](\d+)_(\d+)[\x15•]"
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r"\A﻿", ""), r"\r\n?", "\n"), r"\n[ \t]+", " ")
    lines = files.select(F.col("path").alias("recording_id"), F.posexplode(F.split(body, r"\n")).alias("line_no", "line")).where(F.trim("line") != "")
    begin = F.min(F.when(F.col("line") == "@Begin", F.col("line_no")))
    w = Window.partitionBy("recording_id")
    lines = lines.withColumns({"b": begin.over(w), "last": F.max("line_no").over(w)}).where("b is null or line_no >= b")
    running = Window.partitionBy("recording_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(F.col("line").startswith("*"), "main").when(F.col("line").startswith("%"), "dep").when(F.col("line").startswith("@"), "head").otherwise("other")
    lines = lines.withColumn("kind", kind).withColumn("utt_idx", F.sum((F.col("kind") == "main").cast("int")).over(running) - 1)
    lines = lines.withColumns({"name": F.regexp_extract("line", r"^([@%*][^:\t ]*)", 1), "rest": F.trim(F.regexp_replace("line", r"^[^:]*:?[ \t]*", ""))})
    head = lines.where("kind = 'head'")
    part = head.where("name = '@Participants'").select("recording_id", F.explode(F.split("rest", r"\s*,\s*")).alias("p")).where("trim(p) <> ''").select("recording_id", F.regexp_extract("p", r"^(\S+)", 1).alias("speaker_id"), F.trim(F.regexp_replace("p", r"^\S+", "")).alias("name"))
    ids = head.where("name = '@ID'").select("recording_id", F.split("rest", r"\s*\|\s*").alias("f"))
    far = (F.size("f") >= 4) & F.get("f", F.lit(2)).rlike("^[A-Z]{3}$")
    ids = ids.select("recording_id", F.when(far, F.get("f", F.lit(2))).otherwise(F.get("f", F.lit(1))).alias("speaker_id"), F.when(far, F.coalesce(F.nullif(F.get("f", F.lit(7)), F.lit("")), F.get("f", F.lit(3)))).otherwise(F.get("f", F.lit(2))).alias("id_name"), F.when(far, F.coalesce(F.nullif(F.get("f", F.lit(8)), F.lit("")), F.get("f", F.lit(3)))).otherwise(F.get("f", F.lit(3))).alias("role"))
    speakers = part.join(ids, ["recording_id", "speaker_id"], "left").select("recording_id", "speaker_id", F.coalesce(F.nullif("id_name", F.lit("")), "name").alias("name"), F.coalesce("role", F.lit("")).alias("role")).dropDuplicates(["recording_id", "speaker_id"])
    sep = F.when(F.col("rest").contains("|"), F.split("rest", r"\s*\|\s*")).otherwise(F.split("rest", r"\s*,\s*"))
    media = head.where("name = '@Media'").select("recording_id", sep.alias("m")).select("recording_id", F.get("m", F.lit(0)).alias("path"), F.coalesce(F.nullif(F.get("m", F.lit(1)), F.lit("")), F.lit("audio")).alias("kind"))

    main = lines.where("kind = 'main'").select("recording_id", "utt_idx", F.substring("name", 2, 99).alias("speaker_id"), "rest", "line_no")
    xaud = lines.where("kind = 'dep' and name = '%xaud'").withColumn("parts", F.split("rest", r"\s+"))
    floats = F.filter("parts", lambda x: x.rlike(r"^-?\d+(\.\d+)?$"))
    xaud = xaud.where(F.size("parts") == 3).groupBy("recording_id", "utt_idx").agg(F.first(floats).alias("x"))
    ms = lambda g: F.nullif(F.regexp_extract("rest", bullet, g), F.lit("")).cast("double") / 1000
    main = main.join(xaud, ["recording_id", "utt_idx"], "left").withColumns({"start_s": F.coalesce(F.get("x", F.lit(0)).cast("double"), ms(1)), "end_s": F.coalesce(F.get("x", F.lit(1)).cast("double"), ms(2))})
    main = main.withColumn("items", F.filter(F.split(F.trim(F.regexp_replace("rest", bullet, " ")), r"\s+"), lambda x: x != ""))
    main = main.withColumn("utterance_id", F.format_string("u%04d", F.col("utt_idx") + 1))
    tok = main.select("recording_id", "utt_idx", "utterance_id", "speaker_id", F.posexplode("items").alias("tok_idx", "text"))
    tok = tier_roles(tok, ["recording_id", "utt_idx"]).drop("opened").withColumn("token_id", F.format_string("%s_t%04d", "utterance_id", F.col("tok_idx") + 1)).withColumn("kind", item_kind(F.col("text")))

    # Dependent tiers: the convention whose size fits, words alone or with fillers and retraced words, numbers the members.
    chunks = F.regexp_extract_all("rest", F.lit(r"\S+(?:\s+[\x15•]\d+_\d+[\x15•])?"), F.lit(0))
    tiers = lines.where("kind = 'dep'").where(F.col("name").isin("%wor", "%mor", "%gra")).select("recording_id", "utt_idx", F.substring("name", 2, 3).alias("layer"), F.when(F.col("name") == "%wor", chunks).otherwise(F.split("rest", r"\s+")).alias("entries"))
    conventions = {"w": ["word"], "f": ["word", "filler", "retraced"], "x": ["word", "filler", "retraced", "untranscribed"]}
    order = Window.partitionBy("recording_id", "utt_idx").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, 0)
    content = F.col("kind").isin("word", "filler", "fragment")
    numbered = tok.withColumns({c: F.when(F.col("tier_role").isin(r), F.sum(F.col("tier_role").isin(r).cast("int")).over(order)) for c, r in conventions.items()}).withColumn("c", F.when(content, F.sum(content.cast("int")).over(order)))
    sizes = numbered.groupBy("recording_id", "utt_idx").agg(*(F.max(c).alias(f"n_{c}") for c in "wfxc"))
    n = F.size("entries")
    pick = F.when(F.col("layer") != "wor", F.when(n == F.col("n_w"), "w").when(n == F.col("n_c"), "c")).otherwise(F.when(n == F.col("n_f"), "f").when(n == F.col("n_x"), "x").when(n == F.col("n_c"), "c"))
    fitted = tiers.join(sizes, ["recording_id", "utt_idx"], "left").withColumn("conv", pick)
    placed = fitted.where("conv is not null").select("recording_id", "utt_idx", "layer", "conv", F.posexplode("entries").alias("i", "entry"))
    at = F.coalesce(*(F.when(F.col("conv") == c, F.col(c)) for c in "wfxc"))
    member = numbered.join(placed, ["recording_id", "utt_idx"]).where(at == F.col("i") + 1)
    surface = lambda c: F.regexp_replace(F.regexp_replace(c, r"^<+|>+$", ""), r"^&-", "")
    wor = member.where("layer = 'wor'").join(main.select("recording_id", "utt_idx", F.col("start_s").alias("us"), F.col("end_s").alias("ue")), ["recording_id", "utt_idx"])
    wor = wor.withColumns({"ws": F.nullif(F.regexp_extract("entry", bullet, 1), F.lit("")).cast("double") / 1000, "we": F.nullif(F.regexp_extract("entry", bullet, 2), F.lit("")).cast("double") / 1000})
    before = F.max("we").over(Window.partitionBy("recording_id", "utt_idx").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, -1))
    said = surface(F.regexp_extract("entry", r"^(\S+)", 1)) == surface(F.col("text"))
    rising = F.col("ws").isNull() | ((F.col("ws") >= F.coalesce(before, F.col("us"))) & (F.col("ws") < F.col("we")) & (F.col("we") <= F.col("ue")))
    trust = wor.withColumn("ok", said & F.coalesce(rising, F.lit(False))).groupBy("recording_id", "utt_idx").agg(F.bool_and("ok").alias("ok"))
    times = wor.join(trust.where("ok"), ["recording_id", "utt_idx"]).select("recording_id", "token_id", F.col("ws").alias("start_s"), F.col("we").alias("end_s"))
    tok = tok.join(times, ["recording_id", "token_id"], "left").select("recording_id", "utt_idx", "speaker_id", "tok_idx", "token_id", nfc("text").alias("text"), normalized("text").alias("norm"), "kind", "start_s", "end_s", *(F.lit(None).cast("string").alias(c) for c in ("word_id", "language", "dep_head", "dep_rel")))
    layer_pos = F.when(F.col("layer") == "wor", 0).when(F.col("layer") == "mor", 1).otherwise(2)
    ann = member.join(trust.where("not ok").select("recording_id", "utt_idx", F.lit("wor").alias("layer")), ["recording_id", "utt_idx", "layer"], "left_anti").select("recording_id", layer_pos.alias("layer_pos"), "layer", F.lit("chat").alias("source"), F.lit(1.0).alias("confidence"), "token_id", F.col("entry").alias("s_val"), F.lit(None).cast("double").alias("d_val"))

    known = ["@Begin", "@End", "@Languages", "@Participants", "@ID", "@Media", "%xaud", "%wor", "%mor", "%gra"]
    odd = lines.where(F.col("kind").isin("head", "dep") & ~F.col("name").isin(known))
    distrusted = trust.where("not ok").select("recording_id", "utt_idx").unionByName(fitted.where("layer = 'wor' and conv is null").select("recording_id", "utt_idx"))
    warnings = odd.select("recording_id", F.lit("UNSUPPORTED_CHAT_TIER").alias("code"), F.col("name").alias("tier"), "line").unionByName(distrusted.select("recording_id", F.lit("UNTRUSTED_CHAT_WOR").alias("code"), F.lit("%wor").alias("tier"), F.lit("").alias("line")))
    raw = odd.select("recording_id", F.col("name").alias("tier"), "line_no", "line")

    per = lines.groupBy("recording_id").agg(
        F.sum((F.col("line") == "@Begin").cast("int")).alias("begins"), F.sum((F.col("line") == "@End").cast("int")).alias("ends"), F.max_by("line", "line_no").alias("final"), F.max(F.when(F.col("name") == "@Languages", F.col("rest"))).alias("lang"),
        F.max(F.col("name") == "@Participants").alias("has_p"), F.max(F.col("name") == "@Media").alias("has_m"), F.max((F.col("kind") == "dep") & (F.col("utt_idx") < 0)).alias("loose"), F.max(F.col("kind") == "other").alias("other"),
    )
    unknown = main.where("speaker_id <> ''").join(part, ["recording_id", "speaker_id"], "left_anti").select("recording_id").distinct().withColumn("stranger", F.lit(True))
    untimed = main.where("start_s is null").select("recording_id").distinct().withColumn("untimed", F.lit(True))
    misfit = fitted.where("layer <> 'wor' and conv is null").select("recording_id").distinct().withColumn("misfit", F.lit(True))
    j = files.select(F.col("path").alias("recording_id")).join(per, "recording_id", "left").join(unknown, "recording_id", "left").join(untimed, "recording_id", "left").join(misfit, "recording_id", "left")
    rules = {
        "CHAT file must start with @Begin": F.coalesce("begins", F.lit(0)) == 0, "duplicate @Begin header": F.col("begins") > 1, "CHAT file must end with exactly one @End": (F.col("ends") != 1) | (F.col("final") != "@End"),
        f"@Languages must be '{LANGUAGE}'": F.col("lang") != LANGUAGE, "missing @Participants header": ~F.col("has_p"), "missing @Media header": ~F.col("has_m"), "dependent tier without a speaker tier": F.col("loose"),
        "unexpected line": F.col("other"), "speaker tier references unknown speaker": F.col("stranger"), "incompatible tier alignment": F.col("misfit"),
    }
    if require_timing:
        rules["speaker tier has no media bullet"] = F.col("untimed")
    errors = j.withColumn("message", _first_error(rules)).where("message is not null").select("recording_id", F.lit("INVALID_CHAT").alias("code"), "message")
    utt = main.select("recording_id", "utt_idx", "utterance_id", "speaker_id", "start_s", "end_s")
    keep = lambda df: df.join(errors.select("recording_id"), "recording_id", "left_anti")
    return Documents(*(keep(x) for x in (utt, tok, ann, speakers, media, warnings, raw)), errors)
