"""Study of processing arms: gates, pooled and macro rates, and the arm to choose, from one row per session and arm.

``sessions``: participant, session, arm, split, edits, ref_count, reference_ms, retained_ms, utterances,
retained_utterances, vectors, valid_vectors, failed (boolean), runtime_s, audio_s, expects_vad (boolean).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from voxtide.functions.exprs import ratio
from voxtide.operators.evaluation import complete_rate, gate, paired_difference, pooled_and_macro, select_arm

#: Arms and splits of a study are few: a report of more rows is refused.
MAX_REPORT = 10_000


def gates(sessions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per arm: each check (null where it can't apply), the shares behind it, and whether all that apply hold.

    A check without evidence fails; retention doesn't apply to an arm that expects no detector.  Shares are compared as whole numbers.
    """
    s = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    vad = F.max(F.col("expects_vad"))
    judged = lambda a, b: F.coalesce(gate(s(a), s(b)), F.lit(False))
    g = sessions.groupBy(*groups, "arm").agg(
        F.when(vad, judged("retained_ms", "reference_ms")).alias("duration_retention"), F.when(vad, judged("retained_utterances", "utterances")).alias("utterance_retention"), judged("valid_vectors", "vectors").alias("feature_validity"),
        (F.sum(F.coalesce(F.col("failed"), F.lit(True)).cast("int")) == 0).alias("no_failed_session"), ratio(s("retained_ms"), s("reference_ms")).alias("duration_share"), ratio(s("retained_utterances"), s("utterances")).alias("utterance_share"),
        (s("utterances") - s("retained_utterances")).alias("missed_utterances"), complete_rate(F.col("runtime_s"), F.col("audio_s") / 3600).alias("runtime_s_per_audio_hour"), F.count_distinct("session").alias("sessions"),
    )
    checks = [F.coalesce(F.col(c), F.lit(True)) for c in ("duration_retention", "utterance_retention", "feature_validity", "no_failed_session")]
    return g.withColumn("passed", checks[0] & checks[1] & checks[2] & checks[3])


def choose(sessions: DataFrame, baseline: str, candidates: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """The chosen arm of each group: passed its gates, no worse than the baseline in macro rate, lowest; within one point
    fewer missed utterances win, then the shorter runtime (a missing one loses), then the order of ``candidates``.  No row if none."""
    g = list(groups) or ["__all"]
    sessions = sessions if groups else sessions.withColumn("__all", F.lit(1))
    rates = pooled_and_macro(sessions, "participant", "edits", "ref_count", [*g, "arm"]).select(*g, "arm", "macro_rate", "pooled_rate", "participants")
    base = rates.where(F.col("arm") == baseline).select(*g, F.col("macro_rate").alias("baseline_rate"))
    j = rates.where(F.col("arm").isin(list(candidates))).join(gates(sessions, g), [*g, "arm"]).join(base, g)
    order = F.array_position(F.array(*map(F.lit, candidates)), F.col("arm"))
    return select_arm(j, g, "macro_rate", "baseline_rate", "passed", [F.col("missed_utterances"), F.col("runtime_s_per_audio_hour").asc_nulls_last(), order]).drop("__all")


def report(sessions: DataFrame, baseline: str, candidates: Sequence[str]) -> str:
    """The study as JSON: gates, rates and differences of each arm, and the choice; names of participants and sessions stay out."""
    per = sessions.groupBy("arm", "participant").agg(ratio(F.sum("edits"), F.sum("ref_count")).alias("rate"))

    def rows(df: DataFrame) -> list[dict]:
        got = df.limit(MAX_REPORT + 1).collect()
        if len(got) > MAX_REPORT:
            raise ValueError(f"a report of more than {MAX_REPORT} rows")
        return sorted((r.asDict() for r in got), key=lambda r: str(r.get("arm")))

    chosen = rows(choose(sessions, baseline, candidates))
    return json.dumps(
        {"gates": rows(gates(sessions)), "rates": rows(pooled_and_macro(sessions, "participant", "edits", "ref_count", ["arm"])), "differences": rows(paired_difference(per, "arm", baseline, "participant", "rate")), "selected": chosen[0]["arm"] if chosen else None}, sort_keys=True, indent=1
    )


def markdown(text: str) -> str:
    """A report's gates and rates as a Markdown table."""
    r = json.loads(text)
    rates = {x["arm"]: x for x in r["rates"]}
    share = lambda x: "-" if x is None else f"{x:.3f}"
    lines = ["| arm | macro rate | pooled rate | retention | passed |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {g['arm']} | {share(rates[g['arm']]['macro_rate'])} | {share(rates[g['arm']]['pooled_rate'])} | {share(g['duration_share'])} | {'yes' if g['passed'] else 'no'} |" for g in r["gates"]]
    return "\n".join([*lines, "", f"Selected: {r['selected'] or 'none'}"]) + "\n"
