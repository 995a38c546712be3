"""The catalog of feature keys by pack, level and domain."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

PACKS = ("acoustic", "adult_neuro", "motor_neuro", "standardized_acoustic")
LEVELS = ("recording", "utterance")
DOMAINS = {
    "audio": "quality", "time": "timing", "voice": "phonation", "spectral": "spectrum", "lex": "lexical", "disfluency": "disfluency", "morph": "morphosyntax", "semantic": "semantics",
    "discourse": "discourse", "task": "task", "artic": "articulation", "rhythm": "rhythm", "resp": "respiration", "egemaps": "standardized",
}


@dataclass(frozen=True)
class Feature:
    key: str
    pack: str
    level: str
    domain: str
    unit: str


# The keys of each pack, one block a domain.
ACOUSTIC = (
    # quality
    "audio_duration_s audio_dc_offset audio_clipping_ratio audio_rms_dbfs "
    # timing
    "time_speech_s time_speech_ratio time_speech_segment_count time_speech_segment_rate_per_min time_speech_segment_median_s time_speech_segment_iqr_s "
    "time_speech_segment_cv time_speech_segment_max_s time_response_latency_s time_overlap_s time_words_per_min time_syllables_per_min "
    "time_articulation_rate_syllables_per_s time_max_local_speech_rate_wpm time_voiced_segment_mean_s time_voiced_segment_sd_s time_pause_count "
    "time_pause_rate_per_min time_pause_mean_s time_pause_sd_s time_pause_max_s time_pause_total_s time_pause_median_s time_pause_iqr_s time_pause_cv "
    "time_pause_proportion time_long_pause_count time_between_utterance_pause_proportion time_timing_event_rate_per_min time_timing_event_entropy "
    "time_timing_acceleration_per_min2 time_syllable_duration_mean_s time_syllable_duration_sd_s time_syllable_duration_cv time_syllable_duration_npvi "
    # phonation
    "voice_f0_mean_hz voice_f0_median_hz voice_f0_sd_hz voice_f0_cv voice_f0_iqr_hz voice_f0_range_5_95_hz voice_f0_slope_hz_per_s voice_f0_abs_change_hz "
    "voice_f0_range_semitones voice_f0_mad_semitones voice_voiced_ratio voice_intensity_mean_dbfs voice_intensity_median_dbfs voice_intensity_sd_db "
    "voice_intensity_iqr_db voice_intensity_slope_db_per_s voice_intensity_range_db voice_intensity_cv voice_hnr_mean_db voice_hnr_median_db "
    "voice_hnr_sd_db voice_hnr_iqr_db voice_cpp_mean_db voice_cpp_median_db voice_cpp_sd_db voice_cpp_iqr_db voice_nhr_mean_db voice_jitter_local "
    "voice_jitter_rap voice_jitter_ppq5 voice_jitter_ddp voice_shimmer_local voice_shimmer_apq3 voice_shimmer_apq5 voice_shimmer_apq11 voice_shimmer_dda "
    "voice_break_count voice_break_rate_per_min voice_break_proportion voice_pitch_period_entropy voice_rpde voice_dfa voice_correlation_dimension "
    # spectrum
    "spectral_centroid_mean_hz spectral_centroid_sd_hz spectral_spread_mean_hz spectral_spread_sd_hz spectral_slope_mean_db_per_hz "
    "spectral_slope_sd_db_per_hz spectral_rolloff_85_mean_hz spectral_rolloff_85_sd_hz spectral_flux_mean spectral_flux_sd spectral_flatness_mean "
    "spectral_flatness_sd spectral_entropy_mean spectral_entropy_sd spectral_energy_mean_db spectral_energy_sd_db spectral_skewness_mean "
    "spectral_skewness_sd spectral_kurtosis_mean spectral_kurtosis_sd spectral_low_high_energy_ratio_db spectral_f1_mean_hz spectral_f1_sd_hz "
    "spectral_f2_mean_hz spectral_f2_sd_hz spectral_f3_mean_hz spectral_f3_sd_hz spectral_b1_mean_hz spectral_b1_sd_hz spectral_b2_mean_hz "
    "spectral_b2_sd_hz spectral_b3_mean_hz spectral_b3_sd_hz spectral_mfcc_1_mean spectral_mfcc_1_sd spectral_mfcc_1_skewness spectral_mfcc_1_kurtosis "
    "spectral_mfcc_2_mean spectral_mfcc_2_sd spectral_mfcc_2_skewness spectral_mfcc_2_kurtosis spectral_mfcc_3_mean spectral_mfcc_3_sd "
    "spectral_mfcc_3_skewness spectral_mfcc_3_kurtosis spectral_mfcc_4_mean spectral_mfcc_4_sd spectral_mfcc_4_skewness spectral_mfcc_4_kurtosis "
    "spectral_mfcc_5_mean spectral_mfcc_5_sd spectral_mfcc_5_skewness spectral_mfcc_5_kurtosis spectral_mfcc_6_mean spectral_mfcc_6_sd "
    "spectral_mfcc_6_skewness spectral_mfcc_6_kurtosis spectral_mfcc_7_mean spectral_mfcc_7_sd spectral_mfcc_7_skewness spectral_mfcc_7_kurtosis "
    "spectral_mfcc_8_mean spectral_mfcc_8_sd spectral_mfcc_8_skewness spectral_mfcc_8_kurtosis spectral_mfcc_9_mean spectral_mfcc_9_sd "
    "spectral_mfcc_9_skewness spectral_mfcc_9_kurtosis spectral_mfcc_10_mean spectral_mfcc_10_sd spectral_mfcc_10_skewness spectral_mfcc_10_kurtosis "
    "spectral_mfcc_11_mean spectral_mfcc_11_sd spectral_mfcc_11_skewness spectral_mfcc_11_kurtosis spectral_mfcc_12_mean spectral_mfcc_12_sd "
    "spectral_mfcc_12_skewness spectral_mfcc_12_kurtosis spectral_mfcc_13_mean spectral_mfcc_13_sd spectral_mfcc_13_skewness spectral_mfcc_13_kurtosis "
).split()
ADULT_NEURO = (
    # lexical
    "lex_utterance_count lex_token_count lex_word_count lex_syllable_count lex_character_count lex_unique_token_count lex_mlu_words lex_mlu_syllables "
    "lex_token_length_mean_characters lex_token_length_sd_characters lex_word_length_mean_syllables lex_word_length_sd_syllables lex_token_ttr "
    "lex_token_mattr_20 lex_token_mtld lex_token_hdd_42 lex_token_hapax_ratio lex_token_brunet_w lex_token_honore_r lex_token_entropy lex_lemma_ttr "
    "lex_lemma_mattr_20 lex_lemma_mtld lex_lemma_hdd_42 lex_lemma_hapax_ratio lex_lemma_brunet_w lex_lemma_honore_r lex_lemma_entropy lex_frequency_mean "
    "lex_log_frequency_mean lex_familiarity_mean lex_age_of_acquisition_mean lex_imageability_mean lex_concreteness_mean "
    # disfluency
    "disfluency_filler_count disfluency_filler_ratio disfluency_fragment_count disfluency_fragment_ratio disfluency_immediate_repetition_count "
    "disfluency_immediate_repetition_ratio disfluency_retracing_count disfluency_retracing_ratio disfluency_revision_count disfluency_revision_ratio "
    "disfluency_maze_count disfluency_maze_ratio disfluency_annotated_error_count disfluency_annotated_error_ratio disfluency_phonemic_error_count "
    "disfluency_phonemic_error_ratio disfluency_phonetic_error_count disfluency_phonetic_error_ratio disfluency_semantic_error_count "
    "disfluency_semantic_error_ratio disfluency_visual_error_count disfluency_visual_error_ratio disfluency_morphological_error_count "
    "disfluency_morphological_error_ratio disfluency_inflectional_error_count disfluency_inflectional_error_ratio disfluency_syntactic_error_count "
    "disfluency_syntactic_error_ratio disfluency_closed_class_error_count disfluency_closed_class_error_ratio disfluency_neologism_error_count "
    "disfluency_neologism_error_ratio disfluency_perseveration_error_count disfluency_perseveration_error_ratio disfluency_circumlocution_error_count "
    "disfluency_circumlocution_error_ratio disfluency_indefinite_term_error_count disfluency_indefinite_term_error_ratio "
    "disfluency_word_finding_error_count disfluency_word_finding_error_ratio "
    # morphosyntax
    "morph_upos_adj_ratio morph_upos_adp_ratio morph_upos_adv_ratio morph_upos_aux_ratio morph_upos_cconj_ratio morph_upos_det_ratio morph_upos_intj_ratio "
    "morph_upos_noun_ratio morph_upos_num_ratio morph_upos_part_ratio morph_upos_pron_ratio morph_upos_propn_ratio morph_upos_punct_ratio "
    "morph_upos_sconj_ratio morph_upos_sym_ratio morph_upos_verb_ratio morph_upos_x_ratio morph_content_word_ratio morph_function_word_ratio "
    "morph_noun_verb_ratio morph_pronoun_noun_ratio morph_classifier_ratio morph_particle_ratio morph_code_switch_ratio morph_dep_root_ratio "
    "morph_dep_subject_ratio morph_dep_object_ratio morph_dep_nominal_modifier_ratio morph_dep_adverbial_modifier_ratio morph_dep_clausal_complement_ratio "
    "morph_dep_coordination_ratio morph_dep_function_ratio morph_dep_other_ratio morph_dependency_length_mean_tokens morph_dependency_length_sd_tokens "
    "morph_tree_depth_mean morph_tree_depth_max morph_yngve_depth_mean morph_yngve_depth_max morph_clause_count morph_clause_rate_per_utterance "
    "morph_subordinate_clause_count morph_subordination_ratio morph_sentence_count morph_words_per_sentence morph_t_unit_count morph_words_per_t_unit "
    "morph_words_per_clause morph_clauses_per_sentence morph_embedding_count morph_dependent_clause_ratio morph_coordinate_phrase_count "
    "morph_complex_nominal_count morph_verb_phrase_count morph_well_formed_sentence_ratio morph_incomplete_sentence_ratio morph_reduced_sentence_ratio "
    # semantics
    "semantic_idea_density semantic_proposition_density "
    # discourse
    "discourse_turn_count discourse_turn_length_mean_words discourse_turn_length_sd_words discourse_turn_length_mean_syllables "
    "discourse_turn_length_sd_syllables discourse_examiner_prompt_ratio discourse_response_latency_mean_s discourse_response_latency_sd_s "
    "discourse_overlap_s discourse_overlap_ratio discourse_referential_cohesion_ratio discourse_temporal_cohesion_ratio discourse_causal_cohesion_ratio "
    "discourse_correct_pronoun_ratio discourse_local_lexical_coherence discourse_global_coherence_ratio discourse_topic_maintenance_ratio "
    "discourse_marker_ratio discourse_relevant_detail_ratio discourse_irrelevant_detail_ratio discourse_microproposition_count "
    "discourse_macroproposition_count discourse_information_unit_count discourse_content_accuracy_ratio discourse_information_efficiency_per_min "
    # task
    "task_picture_concept_coverage task_picture_concept_density task_picture_repeat_ratio task_picture_entity_coverage task_picture_action_coverage "
    "task_recall_idea_coverage task_recall_idea_density task_recall_repeat_ratio task_recall_order_score task_fluency_response_count "
    "task_fluency_valid_count task_fluency_valid_unique task_fluency_repeats task_fluency_intrusions task_fluency_first_half_valid "
    "task_fluency_second_half_valid task_fluency_production_change task_fluency_rate task_fluency_clusters task_fluency_cluster_size_mean "
    "task_fluency_switches "
).split()
# Its keys of utterances.
UTTERANCES = ("discourse_turn_word_count discourse_turn_syllable_count discourse_response_latency_s discourse_turn_overlap_s").split()
MOTOR_NEURO = (
    # articulation
    "artic_vowel_space_area_hz2 artic_vowel_articulation_index artic_formant_centralization_ratio artic_f1_within_vowel_sd_hz artic_f2_within_vowel_sd_hz "
    "artic_formant_transition_slope_mean_hz_s artic_resonance_attenuation_mean_db artic_vowel_dispersion_mean_hz artic_vowel_dispersion_sd_hz "
    "artic_vot_mean_s artic_vot_sd_s artic_stop_gap_mean_s artic_stop_gap_sd_s artic_consonant_duration_mean_s artic_consonant_duration_sd_s "
    "artic_fricative_m1_mean artic_fricative_m2_mean artic_fricative_m3_mean artic_fricative_m4_mean "
    # rhythm
    "rhythm_percent_vocalic rhythm_varco_v rhythm_rpvi_v rhythm_npvi_v rhythm_varco_c rhythm_rpvi_c rhythm_npvi_c "
    # task
    "task_ddk_rate_syllables_s task_ddk_inter_onset_mean_s task_ddk_inter_onset_median_s task_ddk_inter_onset_sd_s task_ddk_inter_onset_cv "
    "task_ddk_instability_s task_ddk_acceleration_syllables_s2 task_ddk_decay_ratio task_ddk_voiced_interval_mean_s task_ddk_sequential_alternating_ratio "
    "task_max_phonation_time_s "
    # respiration
    "resp_breath_group_count resp_breath_group_mean_s resp_breath_group_sd_s resp_rate_per_min resp_pauses_per_breath resp_relative_loudness_db "
    # phonation
    "voice_gaping_interval_rate_per_min voice_subharmonic_interval_proportion voice_sustained_f0_sd_semitones voice_sustained_power_sd_db "
).split()
STANDARDIZED_ACOUSTIC = (
    # standardized
    "egemaps_f0semitonefrom27_5hz_sma3nz_amean egemaps_f0semitonefrom27_5hz_sma3nz_stddevnorm egemaps_f0semitonefrom27_5hz_sma3nz_percentile20_0 "
    "egemaps_f0semitonefrom27_5hz_sma3nz_percentile50_0 egemaps_f0semitonefrom27_5hz_sma3nz_percentile80_0 egemaps_f0semitonefrom27_5hz_sma3nz_pctlrange0_2 "
    "egemaps_f0semitonefrom27_5hz_sma3nz_meanrisingslope egemaps_f0semitonefrom27_5hz_sma3nz_stddevrisingslope "
    "egemaps_f0semitonefrom27_5hz_sma3nz_meanfallingslope egemaps_f0semitonefrom27_5hz_sma3nz_stddevfallingslope egemaps_loudness_sma3_amean "
    "egemaps_loudness_sma3_stddevnorm egemaps_loudness_sma3_percentile20_0 egemaps_loudness_sma3_percentile50_0 egemaps_loudness_sma3_percentile80_0 "
    "egemaps_loudness_sma3_pctlrange0_2 egemaps_loudness_sma3_meanrisingslope egemaps_loudness_sma3_stddevrisingslope "
    "egemaps_loudness_sma3_meanfallingslope egemaps_loudness_sma3_stddevfallingslope egemaps_jitterlocal_sma3nz_amean egemaps_jitterlocal_sma3nz_stddevnorm "
    "egemaps_shimmerlocaldb_sma3nz_amean egemaps_shimmerlocaldb_sma3nz_stddevnorm egemaps_hnrdbacf_sma3nz_amean egemaps_hnrdbacf_sma3nz_stddevnorm "
    "egemaps_logrelf0_h1_h2_sma3nz_amean egemaps_logrelf0_h1_h2_sma3nz_stddevnorm egemaps_logrelf0_h1_a3_sma3nz_amean "
    "egemaps_logrelf0_h1_a3_sma3nz_stddevnorm egemaps_f1frequency_sma3nz_amean egemaps_f1frequency_sma3nz_stddevnorm egemaps_f1bandwidth_sma3nz_amean "
    "egemaps_f1bandwidth_sma3nz_stddevnorm egemaps_f1amplitudelogrelf0_sma3nz_amean egemaps_f1amplitudelogrelf0_sma3nz_stddevnorm "
    "egemaps_f2frequency_sma3nz_amean egemaps_f2frequency_sma3nz_stddevnorm egemaps_f2bandwidth_sma3nz_amean egemaps_f2bandwidth_sma3nz_stddevnorm "
    "egemaps_f2amplitudelogrelf0_sma3nz_amean egemaps_f2amplitudelogrelf0_sma3nz_stddevnorm egemaps_f3frequency_sma3nz_amean "
    "egemaps_f3frequency_sma3nz_stddevnorm egemaps_f3bandwidth_sma3nz_amean egemaps_f3bandwidth_sma3nz_stddevnorm egemaps_f3amplitudelogrelf0_sma3nz_amean "
    "egemaps_f3amplitudelogrelf0_sma3nz_stddevnorm egemaps_mfcc1v_sma3nz_amean egemaps_mfcc1v_sma3nz_stddevnorm egemaps_mfcc2v_sma3nz_amean "
    "egemaps_mfcc2v_sma3nz_stddevnorm egemaps_mfcc3v_sma3nz_amean egemaps_mfcc3v_sma3nz_stddevnorm egemaps_mfcc4v_sma3nz_amean "
    "egemaps_mfcc4v_sma3nz_stddevnorm egemaps_spectralfluxv_sma3nz_amean egemaps_spectralfluxv_sma3nz_stddevnorm egemaps_alpharatiov_sma3nz_amean "
    "egemaps_alpharatiov_sma3nz_stddevnorm egemaps_hammarbergindexv_sma3nz_amean egemaps_hammarbergindexv_sma3nz_stddevnorm "
    "egemaps_slopev0_500_sma3nz_amean egemaps_slopev0_500_sma3nz_stddevnorm egemaps_slopev500_1500_sma3nz_amean egemaps_slopev500_1500_sma3nz_stddevnorm "
    "egemaps_spectralflux_sma3_amean egemaps_spectralflux_sma3_stddevnorm egemaps_mfcc1_sma3_amean egemaps_mfcc1_sma3_stddevnorm egemaps_mfcc2_sma3_amean "
    "egemaps_mfcc2_sma3_stddevnorm egemaps_mfcc3_sma3_amean egemaps_mfcc3_sma3_stddevnorm egemaps_mfcc4_sma3_amean egemaps_mfcc4_sma3_stddevnorm "
    "egemaps_alpharatiouv_sma3nz_amean egemaps_hammarbergindexuv_sma3nz_amean egemaps_slopeuv0_500_sma3nz_amean egemaps_slopeuv500_1500_sma3nz_amean "
    "egemaps_spectralfluxuv_sma3nz_amean egemaps_loudnesspeakspersec egemaps_voicedsegmentspersec egemaps_meanvoicedsegmentlengthsec "
    "egemaps_stddevvoicedsegmentlengthsec egemaps_meanunvoicedsegmentlength egemaps_stddevunvoicedsegmentlength egemaps_equivalentsoundlevel_dbp "
).split()


def _unit(key: str) -> str:
    ends = {"_per_min2": "1/min2", "_per_min": "1/min", "_wpm": "words/min", "_db_per_hz": "dB/Hz", "_hz2": "Hz2", "_hz_s": "Hz/s", "_hz_per_s": "Hz/s", "_db_per_s": "dB/s", "_dbfs": "dBFS", "_db": "dB", "_hz": "Hz", "_semitones": "semitones", "_syllables_s2": "1/s2", "_syllables_s": "1/s", "_syllables_per_s": "1/s", "_s": "s", "_count": "count", "_ratio": "ratio", "_coverage": "ratio", "_proportion": "ratio"}
    return next((u for e, u in ends.items() if key.endswith(e)), "1")


def features() -> list[Feature]:
    """All features in order of key."""
    packs = {"acoustic": ACOUSTIC, "adult_neuro": ADULT_NEURO + UTTERANCES, "motor_neuro": MOTOR_NEURO, "standardized_acoustic": STANDARDIZED_ACOUSTIC}
    out = [Feature(k, p, "utterance" if k in UTTERANCES or p == "standardized_acoustic" else "recording", DOMAINS[k.split("_")[0]], _unit(k)) for p, ks in packs.items() for k in ks]
    return sorted(out, key=lambda f: f.key)


def keys(pack: str, level: str | None = None) -> list[str]:
    return [f.key for f in features() if f.pack == pack and (level is None or f.level == level)]


def select(kind: str, known: Iterable[str], wanted: Iterable[str] | None) -> list[str]:
    """The wanted names in the known order; None is all.  Empty, repeated and unknown ones are errors."""
    known = list(known)
    if wanted is None:
        return known
    if isinstance(wanted, str) or not (w := list(wanted)):
        raise ValueError(f"{kind} must be a non-empty list")
    if len(set(w)) != len(w) or (bad := [x for x in w if x not in known]):
        raise ValueError(f"{kind} must be distinct and known: {w}")
    del bad
    return [x for x in known if x in w]


def table(spark: SparkSession, *, pack: str | None = None, level: str | None = None, domain: str | None = None) -> DataFrame:
    """The catalog as a table, filtered; an unknown filter value is an error."""
    for value, known, kind in ((pack, PACKS, "pack"), (level, LEVELS, "level"), (domain, tuple(DOMAINS.values()), "domain")):
        if value is not None and value not in known:
            raise ValueError(f"unknown {kind}: {value}")
    df = spark.createDataFrame([tuple(vars(f).values()) for f in features()], "key string, pack string, level string, domain string, unit string")
    for c, v in (("pack", pack), ("level", level), ("domain", domain)):
        df = df.where(F.col(c) == v) if v is not None else df
    return df.orderBy("key")
