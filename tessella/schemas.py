"""Schemas of the label tables. Readers use these and never infer."""

from __future__ import annotations

SAMPLE = "position long, dataset string, image_name string, image_path string, coarse_path string, feature_path string"
COMPONENTS = "struct<area_agreement: double, centroid_agreement: double, component_agreement: double, region_iou: double, semantic_margin: double>"
COHORT_SAMPLE = f"struct<index: long, dataset: string, image_name: string, route: string, localization_reliability: double, localization_components: {COMPONENTS}, area_ratio: double, component_count: long, is_empty: boolean, selection_reasons: array<string>>"
COHORT = f"cohort_size long, dataset_counts map<string, long>, generated_without_gt boolean, samples array<{COHORT_SAMPLE}>"
SELECTED = "struct<prompt_name: string, mask_index: long, sam_score: double, quality: double, q_semantic: double, q_stability: double, q_edge: double, q_safety: double, valid: boolean, area: long, area_ratio: double, centroid_xy: array<double>, component_count: long>"
STRUCTURE = "struct<backbone_ratio: double, cleanup: struct<component_count_before: long, component_count_after: long, removed_area_ratio: double, removed_component_count: long, risk_detected: boolean>, pre_fallback_effective_component_growth: long>"
PROMPT = "struct<name: string, positive_points: array<array<long>>, negative_points: array<array<long>>, box_xyxy: array<long>>"
AUDIT = f"dataset string, image_name string, index long, image_size array<long>, route string, localization_reliability double, localization_components {COMPONENTS}, prompt_count long, candidate_count long, valid_candidate_count long, prompts array<{PROMPT}>, selected {SELECTED}, structure {STRUCTURE}, fallback_reason string, band_ratio double, band_radius long, changed_ratio double, changed_ratio_0_01 double, changed_ratio_0_05 double, changed_ratio_0_10 double, coarse_mean double, refined_mean double, confidence_mean double, confidence_max double, mean_absolute_change double, far_background_ratio double, foreground_core_ratio double, component_count_before long, component_count_after long, component_count_growth long"
SEED_RESULT = "group string, seed long, dataset string, E_MEAN double, F_MAX double, SMeasure double, MAE double, WFM double"
RASTER = "struct<h: int, w: int, data: binary>"
CANDIDATE = "image_name string, prompt_name string, mask_index long, score double, h int, w int, mask binary"
LEGACY_STATS = "map<string, struct<S_score: double, IoU_ori: double, EdgeAlign: double, IoU_pred: double, gate_decision: string, LocalSAM_triggered: boolean, coarse_area_ratio: double, coarse_centroid: array<double>, selected_mask_idx: long, image_shape: array<long>>>"
