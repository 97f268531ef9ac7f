"""Schemas of the engine's inputs (never inferred: answers mix numbers and text)."""

LOGIC_RAW = "`premises-NL` array<string>, `premises-FOL` array<string>, questions array<string>, answers array<string>, explanation array<string>, idx array<array<int>>"
PHYSICS_RAW = "id string, question string, answer string, unit string, cot string"
SAMPLES = "prompt array<struct<role:string,content:string>>, answer string, cot string, explanation string, type string"
SCORED = "config_id int, config_name string, correct boolean, subject string, question string, prediction string, raw_output string, ground_truth string, retry_count int, seed int"
REQUESTS = "query_id string, type string, query string, premises array<string>, options array<string>"
RESPONSES = "query_id string, answer string, unit string, explanation string, premises_used array<int>, reasoning struct<type:string,steps:array<string>>"
ABLATION = "config_id int, config_name string, description string, accuracy_overall double, accuracy_physics double, accuracy_logic double, n_total int, n_physics int, n_logic int, n_correct int, per_retry map<string,int>, elapsed_min double, seed int"
ANNOTATIONS = "idx int, subject string, question string, prediction string, ground_truth string, rule_label string, manual_label string, notes string, raw_snippet string"
GRADED = "query_id string, type string, answer string, unit string, premises_used string, latency_s double, status int, query string"
NOTATION = "canonical_latex string, meaning string, your_notation string"
