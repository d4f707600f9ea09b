"""Fixed schemas of the data model. Nothing is inferred from files."""

from __future__ import annotations

LORA = "struct<rank:int,lora_alpha:int,dropout:double,target_modules:array<string>,alpha:double,beta:double>"
PRIVACY = "struct<epsilon:double,delta:double,noise_multiplier:double,clip:double>"
REF = "struct<name:string,version:int,kind:string,cluster_id:string>"
PROVENANCE = "struct<cluster_name:string,cluster_version:int,client_name:string,client_version:int,alpha:double,beta:double,base_model:string>"
IN_PROJECT = "struct<edit_similarity:double,exact_match:double,perplexity:double,n_examples:int>"
GUARD = "struct<benchmark:string,pass_at_k:map<string,double>>"

CORPUS_RECORD = (
    "file_id string, cluster_id string, project_label string, relative_path string, language string, num_lines int, num_code_lines int, num_bytes int, content_sha256 string, license string, source_url string, source_ref string, content string"
)
PARTITION_MANIFEST = (
    "manifest_version string, strategy string, seed bigint, corpus_sha256 string, num_clients int, shards array<struct<client_id:string,cluster_id:string,project_label:string,num_files:int,num_lines:int,"
    "num_code_lines:int,total_bytes:bigint,files_path:string,content_sha256:string>>"
)
TASK_OUTCOME = "task_id string, benchmark string, completions array<string>, passed array<boolean>, error string, latency_ms double"
SAMPLE = "task_id string, solution string, completion string"
ADAPTER_METADATA = f"ref {REF}, hparams {LORA}, privacy {PRIVACY}, round int, source_clients array<string>, sha256 string, num_bytes bigint, composed_from {PROVENANCE}"
DECISION = f"adapter {REF}, action string, active_version_after int, reason string, timestamp string"
EVAL_RESULT = f"adapter {REF}, in_project {IN_PROJECT}, guard array<{GUARD}>, baseline_in_project {IN_PROJECT}, baseline_noise_band double"
TENSORS = "adapter_id string, layer int, module string, part string, rows int, cols int, data array<double>"
AUDIT = "timestamp string, event string, actor string, resource string, success boolean, ip string, metadata map<string,string>"
RUN = "experiment string, run_id string, status string, point map<string,string>, gpu_hours_actual double"
