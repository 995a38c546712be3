"""DuckDB SQL that must give the same rows as the query of the same name."""

_LABELS = "participant|patient|par|bệnh nhân|người nói|investigator|inv|examiner|người hỏi|khám viên|(?:speaker|cluster|spk|s)[ _-]?[0-9]+"
# \\x15 marks times; RE2 writes it as \x15.
_MARKS = [
    r"<\|[^|]*\|>", r"\x15[^\x15]*\x15", r"\([0-9.]+s\)", r"\[[0-9]+:[0-9:.]+\]",
    r"[0-9][0-9]:[0-9][0-9]:[0-9][0-9](?:\.[0-9]+)?(?: *--> *)?",
]
_SOUNDS = [r"\(\([^()]*\)\)", r"&=[^ ]+", r"♪[^♪]*♪", r"\*[^* :]+(?: [^* :]+)*\*", r"\[[^\[\]]*\]", r"\([^()]*\)", r"<[^<>]*>", r"\{[^{}]*\}"]


def _without(x: str, patterns: list[str]) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return x


_HEAD = rf"^[ >]*(?:\*?({_LABELS}) ?(?::|>| -)|[\[(<{{] ?({_LABELS}) ?[\])>}}]:?)"
# Segments once each, in composed form, without case and with single spaces; label; spoken pieces.
_CLEAN = f"""
raw AS (SELECT DISTINCT ON (segment_id) segment_id, recording_id, segment_no, start_ms, end_ms,
          trim(regexp_replace(lower(nfc_normalize(text)), '[\\s\\x{{00A0}}]+', ' ', 'g')) AS t FROM asr_segment WHERE text IS NOT NULL),
untimed AS (SELECT * EXCLUDE t, trim(regexp_replace({_without('t', _MARKS)}, ' +', ' ', 'g')) AS t FROM raw),
headed AS (SELECT *, regexp_extract(t, '{_HEAD}', 1) || regexp_extract(t, '{_HEAD}', 2) AS head, regexp_replace(t, '{_HEAD}', ' ') AS body FROM untimed),
forms AS (SELECT '^(?:' || string_agg(regexp_replace(nfc_normalize(form), '(.)', '\\1+', 'g'), '|') || ')$' AS fillers FROM nonword_form),
bare AS (SELECT * EXCLUDE (t, body), string_split(trim(regexp_replace({_without('body', _SOUNDS)}, ' +', ' ', 'g')), ' ') AS pieces FROM headed),
clean AS (SELECT * EXCLUDE (pieces, fillers), list_filter(pieces, lambda p: regexp_matches(p, '[\\p{{L}}\\p{{N}}]')
            AND NOT regexp_matches(regexp_replace(p, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'), fillers)) AS words
          FROM bare, forms)"""

_P1 = f"""WITH {_CLEAN},
seg AS (SELECT * EXCLUDE words, words, len(words) AS n FROM clean WHERE len(words) > 0),
res AS (SELECT DISTINCT ON (recording_id) recording_id, utterance_speakers, cluster_to_role FROM speaker_result),
labels AS (SELECT lower(nfc_normalize(label)) AS label, any_value(speaker_role) AS speaker_role FROM speaker_label GROUP BY 1),
said AS (
  SELECT s.*, r.cluster_to_role AS roles,
         regexp_replace(trim(lower(r.utterance_speakers[s.segment_no + 1])), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS entry
  FROM seg s LEFT JOIN res r USING (recording_id)),
num AS (
  SELECT *, regexp_extract(head, '^(?:speaker|cluster|spk|s)[ _-]?([0-9]+)$', 1) AS head_no, regexp_extract(entry, '^(?:speaker|cluster|spk|s)?[ _-]?([0-9]+)$', 1) AS entry_no FROM said),
heard AS (
  SELECT n.segment_id, arg_max(c, len_ms * 100 - c) AS c FROM (
    SELECT s.segment_id, regexp_extract(t.cluster_id, '([0-9]+)$', 1)::INT AS c, sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) AS len_ms
    FROM seg s JOIN (SELECT DISTINCT ON (turn_id) * FROM diarization_turn WHERE end_ms > start_ms AND cluster_id IS NOT NULL) t
      ON t.recording_id = s.recording_id AND t.start_ms < s.end_ms AND t.end_ms > s.start_ms
    GROUP BY ALL) n GROUP BY ALL),
told AS (
  SELECT n.*, coalesce(l.speaker_role,
      CASE WHEN head_no <> '' THEN element_at(roles, head_no::INT::VARCHAR)[1] END,
      e.speaker_role,
      CASE WHEN entry_no <> '' THEN element_at(roles, entry_no::INT::VARCHAR)[1] END,
      element_at(roles, h.c::VARCHAR)[1]) AS speaker
  FROM num n LEFT JOIN labels l ON l.label = n.head LEFT JOIN labels e ON e.label = n.entry LEFT JOIN heard h USING (segment_id)),
runs AS (
  SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY segment_no, segment_id ROWS UNBOUNDED PRECEDING) AS turn FROM (
    SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY recording_id ORDER BY segment_no, segment_id) THEN 0 ELSE 1 END AS new
    FROM told WHERE speaker IS NOT NULL))
"""

SQL = {
    "p1_found": _P1 + "SELECT recording_id, turn::INT AS turn_no, any_value(speaker) AS speaker, min(segment_no) AS first_segment_no, max(segment_no) AS last_segment_no, sum(n)::INT AS n_words FROM runs GROUP BY recording_id, turn",
    "p1_turns": _P1 + "SELECT recording_id, turn::INT AS turn_no, row_number() OVER (PARTITION BY recording_id, turn ORDER BY segment_no // 4096)::INT AS part_no, any_value(speaker) AS speaker, min(min(segment_no)) OVER w AS first_segment_no, max(max(segment_no)) OVER w AS last_segment_no, (sum(sum(n)) OVER w)::INT AS n_words, string_agg(array_to_string(words, ' '), ' ' ORDER BY segment_no, segment_id) AS text FROM runs GROUP BY recording_id, turn, segment_no // 4096 WINDOW w AS (PARTITION BY recording_id, turn)",
    "p3_found": r"""WITH RECURSIVE canon AS (
  SELECT DISTINCT manifest_id, CASE WHEN p NOT IN ('', 'n/a', 'none', 'unknown', 'tbd', '?') THEN p END AS p, CASE WHEN s NOT IN ('', 'n/a', 'none', 'unknown', 'tbd', '?') THEN s END AS s, nullif(x, '') AS x
  FROM (SELECT manifest_id, regexp_replace(lower(participant_id), '[\s_-]+', '', 'g') AS p, regexp_replace(lower(session_id), '[\s_-]+', '', 'g') AS s, regexp_replace(lower(split), '[\s_-]+', '', 'g') AS x FROM manifest_row)),
links AS (SELECT DISTINCT a.manifest_id AS a, b.manifest_id AS b FROM canon a JOIN canon b ON a.p = b.p OR a.s = b.s),
reach(a, b) AS (SELECT manifest_id, manifest_id FROM canon UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
grp AS (SELECT a AS manifest_id, min(b) AS group_id FROM reach GROUP BY a)
SELECT manifest_id, group_id FROM grp WHERE group_id IN (SELECT group_id FROM grp JOIN canon USING (manifest_id) GROUP BY group_id HAVING count(DISTINCT x) > 1)""",
}
_NEAR = """WITH w AS (SELECT DISTINCT word_id, recording_id, start_ms AS t FROM word_timing WHERE start_ms IS NOT NULL),
d AS (SELECT DISTINCT turn_id, recording_id, start_ms, end_ms FROM diarization_turn WHERE end_ms > start_ms),
near AS (
  SELECT word_id, turn_id, row_number() OVER (PARTITION BY word_id ORDER BY greatest(start_ms - t, t - end_ms, 0), abs(start_ms - t), turn_id) AS k
  FROM w JOIN d ON d.recording_id = w.recording_id AND d.start_ms <= w.t + 500 AND d.end_ms >= w.t - 500)
"""
SQL["p5_found"] = _NEAR + "SELECT word_id, turn_id FROM near WHERE k = 1"
SQL["p5_words"] = _NEAR + "SELECT word_id, turn_id FROM w LEFT JOIN (SELECT * FROM near WHERE k = 1) USING (word_id)"

_P6 = f"""WITH {_CLEAN},
w AS (SELECT segment_id, list_transform(words, lambda p: regexp_replace(p, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) AS words FROM clean),
grams AS (SELECT segment_id, unnest(generate_series(1, len(words) - 2)) AS i, words FROM w WHERE len(words) > 2),
run AS (SELECT segment_id, i, i > min(i) OVER (PARTITION BY segment_id, words[i], words[i + 1], words[i + 2]) AS again FROM grams),
marked AS (SELECT segment_id, count(DISTINCT k) AS n FROM (SELECT segment_id, unnest([i, i + 1, i + 2]) AS k FROM run WHERE again) GROUP BY 1),
share AS (SELECT segment_id, len(words)::INT AS n_words, coalesce(n, 0)::INT AS repeated_words FROM w LEFT JOIN marked USING (segment_id))
"""
SQL["p6_found"] = _P6 + "SELECT segment_id FROM share WHERE n_words > 0 AND repeated_words * 3 >= n_words"
SQL["p6_share"] = (
    _P6 + "SELECT r.segment_id, coalesce(n_words, 0) AS n_words, coalesce(repeated_words, 0) AS repeated_words, coalesce(round(repeated_words / nullif(n_words, 0), 9), 0.0) AS share "
    "FROM (SELECT DISTINCT segment_id FROM asr_segment) r LEFT JOIN share USING (segment_id)"
)

# What must hold whatever is drawn, hashed or packed.
SQL["p3_whole"] = "SELECT count(DISTINCT manifest_id) AS records, 0::BIGINT AS without_split, 0::BIGINT AS groups_in_two_splits FROM manifest_row WHERE manifest_id IS NOT NULL"
SQL["p7_whole"] = "SELECT spec_name, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS holes_or_overlaps, 0::BIGINT AS cut_without_need FROM (SELECT DISTINCT spec_name FROM container_spec)"
SQL["p8_whole"] = "SELECT source, true AS within_cap, true AS copies_without_holes, true AS near_target FROM (SELECT DISTINCT source FROM mix_target)"
