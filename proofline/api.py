"""The public names, in one place: what a caller needs to audit outputs without knowing the modules."""

from proofline.functions.gates import assert_no_labels, gate_one, gate_two, render, resolve_strategy, withheld
from proofline.functions.settings import BadSetting, resolve
from proofline.functions.taxonomy import BadTaxonomy, Taxonomy, check_digest, health, migration, parse
from proofline.operators.assigned import abstention_rate, cross_field_agreement, drift, label_collapse, label_in_taxonomy, label_shares, nearest_labels, valid_leaf, vocabulary
from proofline.operators.copied import ambiguous, grounding_rate, parse_date, parse_number, value_in_source, value_matches_human, value_shape
from proofline.operators.evidence import bootstrap_ci, calibrated_risk, compare_strategies, cross_fitted, defect_agreement, metric_deltas, parse_claims
from proofline.operators.free_text import boilerplate, copy_ratio, length_in_bounds, longest_shared_run, rare_tokens, specificity
from proofline.operators.guardrails import cannot_tell, estimates, fingerprint, gate_one_rows, gate_two_rows, health_flags, version_check
from proofline.operators.judging import TASKS, ask, by_rules, collect_run, over_http, questions, regenerate, verdicts
from proofline.operators.metrics import accuracy, annotator_agreement, buckets, confusion, effective_votes, grain_rates, judge_direction, majority, pairwise_agreement, per_label, screen
from proofline.operators.ranking import auc, bootstrap_auc, build_target, calibration_quality, gated_plan, platt, raw_confidence, recall_at_budget, reliability, risk_rows
from proofline.operators.runs import budget, cache_keys, changes, distribution_shift, plan, stability
from proofline.plans.audit import Field, audit, suspicious
from proofline.plans.project import analyse, compare, load, run, triage_eval
from proofline.sources.readers import BadInput, read_items, read_labels, read_outputs, read_source
from proofline.sources.writers import append_verdicts, latest_run, run_name

__all__ = sorted(n for n in dir() if not n.startswith("_"))
