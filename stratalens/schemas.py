"""Schemas of the tables the engine reads and writes, as DDL."""

from .constants import METRICS

WORK_ITEM = (
    "model_size string, checkpoint string, layer int, status string, "
    "worker_id string, result_path string, error string"
)
SCORES = (
    "model_family string, model_size string, revision string, layer int, task string, "
    "main_score double, all_scores string, task_name string, mteb_version string, "
    "evaluation_time string, output_dir string, result_file string"
)
MARKER = (
    "status string, model_family string, model_id string, model_size string, revision string, "
    "layer int, task string, num_shards int, shard_id int, timestamp string, error string"
)
SWEEP_PROGRESS = (
    "timestamp timestamp, model_size string, revision string, layer string, task string, "
    "status string, elapsed_sec double, output_dir string, error string"
)
BANDIT_PROGRESS = (
    "timestamp timestamp, model_size string, arm_checkpoint string, arm_layer int, task string, "
    "raw_score double, reward double, aggregated_reward double, status string"
)
METRIC_CHUNK = (
    "map<string,struct<checkpoint:string,layer:int,"
    + ",".join(f"{name}:double" for name in METRICS)
    + ">>"
)
