"""Explicit schemas of the canonical tables; scans never infer."""

from __future__ import annotations

import re

# Field names of the files that are read.
SEGMENT = "index int, start_s double, end_s double, frequency double, label string, weight double, removal_score double, drop double"
RESPONSE = "decision string, confidence double, evidence string, rationale string, raw_output string, logit_yes double, logit_no double, logit_skip double, logit_confidence double, logit_p_skip double"
ANNOTATION = (
    "video_id string, video_path string, action_label string, timestamp string, "
    "summary struct<total_segments:bigint,important_count:bigint,unimportant_count:bigint,important_ratio:double,unimportant_ratio:double>, "
    f"segments array<struct<{', '.join(c.replace(' ', ':') for c in SEGMENT.split(', '))}>>, "
    "mss_result struct<mss_runs:array<struct<kept_indices:array<int>,oracle_calls:int,terminated_reason:string>>, inclusion_frequencies:map<string,double>, "
    "total_oracle_calls:int, precheck_passed:boolean, precheck_vote_yes:double, "
    f"precheck_responses:array<struct<{', '.join(c.replace(' ', ':') for c in RESPONSE.split(', '))}>>>, metadata map<string,string>, elapsed_s double"
)
RECORD = (
    "video_id string, ground_truth string, ground_truth_id int, condition string, kept_segments array<array<double>>, selector_failed boolean, selector_failure_reason string, "
    "top5_label_ids array<int>, top5_labels array<string>, top5_probs array<double>, top1_correct boolean, top5_correct boolean, recognizer string, run_seed bigint, elapsed_fwd_batch_s double"
)
#: As ANNOTATION, with the summary as text: prose, or the counts as JSON.
SIDECAR = re.sub(r"summary struct<.*?>", "summary string", ANNOTATION).replace("precheck_vote_yes:double", "precheck_vote_yes:double, scores_recovered_from_raw_output:boolean")
CORRUPT = "_corrupt"
