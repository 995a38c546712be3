"""Parts of speech, dependency structure and clauses per recording and speaker, gated on complete layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxtide.functions.exprs import count_if, ratio, sd
from voxtide.functions.streams import each_group
from voxtide.operators.annotations import binary, complete

KEY = ["recording_id", "speaker_id"]
# The universal tags, and the relations of each dependency group.
UPOS = ("ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X")
CONTENT = ("ADJ", "ADV", "NOUN", "PROPN", "VERB")
FUNCTION = ("ADP", "AUX", "CCONJ", "DET", "PART", "PRON", "SCONJ")
DEP_GROUPS = {
    "root": ("root",),
    "subject": ("nsubj", "nsubj:pass", "csubj", "csubj:pass"),
    "object": ("obj", "iobj"),
    "nominal_modifier": ("amod", "nmod", "nmod:poss", "appos", "compound"),
    "adverbial_modifier": ("advmod", "obl", "obl:agent", "dislocated"),
    "clausal_complement": ("ccomp", "xcomp", "advcl", "acl", "acl:relcl"),
    "coordination": ("conj", "cc"),
    "function": ("case", "mark", "det", "aux", "aux:pass", "cop", "clf"),
}
CLAUSE_HEADS = ("root", "ccomp", "xcomp", "advcl", "acl", "acl:relcl", "csubj", "csubj:pass")


def tag_ratios(words: DataFrame) -> DataFrame:
    """Share of each tag and of content and function words; all null unless every word has a valid tag."""
    tag = F.upper("upos")
    n, ok = F.count("*"), complete(tag.isin(list(UPOS)))
    has = lambda tags: count_if(tag.isin(list(tags)))
    cols = {f"morph_upos_{t.lower()}_ratio": ratio(has([t]), n) for t in UPOS} | {
        "morph_content_word_ratio": ratio(has(CONTENT), n), "morph_function_word_ratio": ratio(has(FUNCTION), n),
        "morph_noun_verb_ratio": ratio(has(["NOUN", "PROPN"]), has(["VERB"])), "morph_pronoun_noun_ratio": ratio(has(["PRON"]), has(["NOUN", "PROPN"])),
    }
    return words.groupBy(*KEY).agg(*(F.when(ok, e).alias(k) for k, e in cols.items()))


def binary_means(words: DataFrame, layers: dict[str, str]) -> DataFrame:
    """Mean of complete 0/1 layers, by feature name."""
    return words.groupBy(*KEY).agg(*(F.when(complete(binary(c)), F.avg(c)).alias(k) for k, c in layers.items()))


def code_switching(words: DataFrame, language: str) -> DataFrame:
    """Share of words in another language than the document's; null unless every word has one."""
    ok = complete(F.length("language") > 0)
    return words.groupBy(*KEY).agg(F.when(ok, ratio(count_if(F.col("language") != language), F.count("*"))).alias("morph_code_switch_ratio"))


def _trees(key: tuple, rows: list[dict]) -> list[dict]:
    """Depths and edge lengths of one utterance; a single row that says so where it is no tree."""
    at = {r["token_id"]: i for i, r in enumerate(rows)}
    rel = lambda r: (r["dep_rel"] or "").strip().casefold()
    words = [r for r in rows if r["is_word"]]
    base = dict(zip(("recording_id", "speaker_id", "utt_idx"), key))
    bad = [base | {"valid": False, "depth": None, "edge": None, "rel": None}]
    roots = [r for r in words if rel(r) == "root"]
    if not words:
        return []
    if len(roots) != 1 or any(not rel(r) for r in words) or roots[0]["dep_head"] not in (None, roots[0]["token_id"]):
        return bad
    root = roots[0]["token_id"]
    out = []
    for r in words:
        depth, here, seen = 0, r, {r["token_id"]}
        while here["dep_head"] not in (None, here["token_id"]):
            i = at.get(here["dep_head"])
            if i is None or rows[i]["token_id"] in seen:
                return bad
            here = rows[i]
            seen.add(here["token_id"])
            depth += 1
        if here["token_id"] != root:
            return bad
        edge = None if r["token_id"] == root else abs(at[r["token_id"]] - at[r["dep_head"]])
        out.append(base | {"valid": True, "depth": depth, "edge": edge, "rel": rel(r)})
    return out


def dependencies(tok: DataFrame, utterances: DataFrame) -> DataFrame:
    """Relation groups, edge lengths, depths and clauses; all null where an utterance of the speaker is no single tree.

    ``tok`` has dep_head, dep_rel and is_word (true for word representatives); trees are walked utterance by utterance.
    """
    cols = ["recording_id", "speaker_id", "utt_idx", "tok_idx", "token_id", "dep_head", "dep_rel", "is_word"]
    t = each_group(tok.select(*cols), [*KEY, "utt_idx"], ["tok_idx"], _trees, "recording_id string, speaker_id string, utt_idx int, valid boolean, depth long, edge long, rel string")
    ok = complete(F.col("valid"))
    known = [r for rs in DEP_GROUPS.values() for r in rs]
    groups = {g: F.col("rel").isin(list(rs)) for g, rs in DEP_GROUPS.items()} | {"other": ~F.col("rel").isin(known)}
    clause = F.col("rel").isin(list(CLAUSE_HEADS))
    sub = clause & (F.col("rel") != "root")
    n_utt = utterances.groupBy(*KEY).agg(F.count("*").alias("n_utt"))
    out = t.groupBy(*KEY).agg(
        *(F.when(ok, ratio(count_if(c), F.count("*"))).alias(f"morph_dep_{g}_ratio") for g, c in groups.items()),
        F.when(ok, F.avg("edge")).alias("morph_dependency_length_mean_tokens"), F.when(ok, sd("edge")).alias("morph_dependency_length_sd_tokens"),
        F.when(ok, F.avg("depth")).alias("morph_tree_depth_mean"), F.when(ok, F.max("depth")).alias("morph_tree_depth_max"),
        F.when(ok, count_if(clause)).alias("morph_clause_count"), F.when(ok, count_if(sub)).alias("morph_subordinate_clause_count"),
    ).join(n_utt, KEY)
    return out.withColumns({"morph_clause_rate_per_utterance": ratio("morph_clause_count", "n_utt"), "morph_subordination_ratio": ratio("morph_subordinate_clause_count", "morph_clause_count")}).drop("n_utt")
