"""Configuration: 46 keys in 12 groups, overlaid on defaults."""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass, replace
from pathlib import Path

DAY = 86_400


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    # storage
    journal_sync: str = "batch"
    journal_max_ops: int = 2048
    audit_log: bool = False
    # logging
    log_path: str | None = None
    log_level: str = "info"
    log_max_size_kb: int = 5120
    log_max_files: int = 3
    log_sync: bool = False
    # curator
    curator_model_path: str = ""
    curator_ctx: int = 4096
    curator_threads: int = 4
    instruction_path: str | None = None
    # embedding
    embed_model_path: str = ""
    embed_dim: int = 384
    query_prefix: str = ""
    passage_prefix: str = ""
    # budgets
    identity_tokens: int = 400
    context_tokens: int = 600
    project_tokens: int = 800
    # injection
    token_estimator: str = "curator"
    template_path: str | None = None
    # retrieval
    k_context: int = 6
    k_project: int = 8
    min_similarity: float = 0.25
    w_similarity: float = 0.70
    w_relevance: float = 0.20
    w_recency: float = 0.10
    # curation
    turn_batch: int = 4
    idle_flush: int = 30
    max_ops_per_cycle: int = 8
    dup_threshold: float = 0.92
    transcript_tokens: int = 1200
    event_queue_max: int = 256
    identity_confirm_window: int = 7 * DAY
    maintenance_interval: int = DAY
    review_batch: int = 16
    # recall
    recall_k: int = 12
    recall_answer_tokens: int = 160
    recall_timeout: int = 10
    # decay
    context_half_life: int = 30 * DAY
    project_half_life: int = 90 * DAY
    prune_threshold: float = 0.15
    purge_after: int = 60 * DAY
    # limits
    identity_max_records: int = 64
    content_max_chars: int = 500
    # projects
    autocreate: bool = True

    def kind(self, field: str) -> str:
        return type(self).__annotations__[field]


#: group.key -> field, where the two differ; all other keys are named like their fields.
RENAMED = {
    "logging.path": "log_path", "logging.level": "log_level", "logging.max_size_kb": "log_max_size_kb", "logging.max_files": "log_max_files", "logging.sync": "log_sync",
    "curator.model_path": "curator_model_path", "curator.ctx": "curator_ctx", "curator.threads": "curator_threads",
    "embedding.model_path": "embed_model_path", "embedding.dim": "embed_dim",
    "recall.k": "recall_k", "recall.answer_tokens": "recall_answer_tokens", "recall.timeout": "recall_timeout",
}
PLAIN = {
    "storage": "journal_sync journal_max_ops audit_log",
    "curator": "instruction_path",
    "embedding": "query_prefix passage_prefix",
    "budgets": "identity_tokens context_tokens project_tokens",
    "injection": "token_estimator template_path",
    "retrieval": "k_context k_project min_similarity w_similarity w_relevance w_recency",
    "curation": "turn_batch idle_flush max_ops_per_cycle dup_threshold transcript_tokens event_queue_max identity_confirm_window maintenance_interval review_batch",
    "decay": "context_half_life project_half_life prune_threshold purge_after",
    "limits": "identity_max_records content_max_chars",
    "projects": "autocreate",
}
KEYS = RENAMED | {f"{g}.{k}": k for g, ks in PLAIN.items() for k in ks.split()}
CHOICES = {"journal_sync": ("batch", "always", "never"), "log_level": ("error", "warn", "info", "debug"), "token_estimator": ("curator", "heuristic")}
DURATIONS = {"idle_flush", "identity_confirm_window", "maintenance_interval", "recall_timeout", "context_half_life", "project_half_life", "purge_after"}
_DURATION = re.compile(r"P(?:(\d{1,12})W|(?:(\d{1,12})D)?(?:T(?=\d)(?:(\d{1,12})H)?(?:(\d{1,12})M)?(?:(\d{1,12})S)?)?)")


def duration_seconds(text: str) -> int | None:
    """Seconds of an ISO 8601 duration in weeks, or days to seconds; None for anything else."""
    m = _DURATION.fullmatch(text)
    if not m or len(text) < 3:
        return None
    return sum(int(n or 0) * s for n, s in zip(m.groups(), (604_800, DAY, 3600, 60, 1)))


def _value(key: str, field: str, v):
    kind = Config.__annotations__[field]
    if field in DURATIONS:
        n = duration_seconds(v) if isinstance(v, str) else None
        if not n:
            raise ConfigError(f"{key}: a duration above zero is needed")
        return n
    if field in CHOICES:
        if v not in CHOICES[field]:
            raise ConfigError(f"{key}: one of {', '.join(CHOICES[field])} is needed")
        return v
    if kind == "bool" and isinstance(v, bool):
        return v
    if kind == "int" and isinstance(v, int) and not isinstance(v, bool) and v >= 1:
        return v
    if kind == "float" and isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1:
        return float(v)
    if kind.startswith("str") and (isinstance(v, str) or v is None and "None" in kind):
        return v
    raise ConfigError(f"{key}: {v!r} is not allowed")


def overlay(groups: dict, base: Config | None = None) -> Config:
    """Defaults with the given groups on top; unknown keys warn, wrong values raise."""
    out: dict = {}
    for group, keys in groups.items():
        if not isinstance(keys, dict):
            warnings.warn(f"unknown setting {group}", stacklevel=2)
            continue
        for k, v in keys.items():
            if (field := KEYS.get(f"{group}.{k}")) is None:
                warnings.warn(f"unknown setting {group}.{k}", stacklevel=2)
            else:
                out[field] = _value(f"{group}.{k}", field, v)
    return replace(base or Config(), **out)


def load(path: str | None = None) -> Config:
    """From a JSON file of groups; no path means defaults, a path that is missing raises."""
    if path is None:
        return Config()
    try:
        groups = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(groups, dict):
        raise ConfigError(f"{path}: an object of groups is needed")
    return overlay(groups)
