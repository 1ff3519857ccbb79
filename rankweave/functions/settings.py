"""Settings of rerankers and of their training: known keys with defaults and rules; unknown keys are kept as they are."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from rankweave.functions.scoring import ARCHITECTURES

# The keys of settings files and their defaults.
RERANKER: dict[str, Any] = {
    "model_name": None,
    "adapter_path": None,
    "device": "cuda",
    "dtype": "bfloat16",
    "trust_remote_code": False,
    "max_length": 4096,
    "prompt_template": "marker",
    "span_start_token": "[SPAN]",
    "span_end_token": "[/SPAN]",
    "item_start_token": "[ITEM]",
    "item_end_token": "[/ITEM]",
    "attention_mask": "block",
    "position_ids": "shared",
    "span_causal": True,
    "interaction": "none",
    "interaction_dim": 256,
    "interaction_hidden_dim": 512,
    "interaction_dropout": 0.1,
    "interaction_score_scale": 0.1,
    "candidate_pooling": "mean",
}
TRAINING: dict[str, Any] = {
    "seed": 42,
    "train_num_permutations": 1,
    "eval_num_permutations": 10,
    "val_perms_deterministic": True,
    "gradient_accumulation_steps": 16,
    "learning_rate": 5e-5,
    "weight_decay": 0.0,
    "max_grad_norm": 1.0,
    "lambda_rank": 1.0,
    "lambda_perm": 0.0,
    "permutation_loss": "kl",
    "num_epochs": None,
    "total_optimizer_steps": 500,
    "save_every_steps": None,
    "lora_r": 16,
    "lora_alpha": 32,
    "lora_dropout": 0.05,
    "lora_target_modules": ["q_proj", "k_proj", "v_proj", "o_proj"],
}
#: Older names of keys; the newer one counts if both are there.
RENAMED = {"max_seq_length": "max_length"}
MARKS = ["span_start_token", "span_end_token", "item_start_token", "item_end_token"]
#: Which kind of prompt a way of scoring reads.
PROMPT_OF = {"generation": "list", "marker_logprob": "marker"}

Rule = tuple[str, Callable[[Mapping[str, Any]], bool]]


def _one_of(key: str, *values: str) -> Rule:
    return f"{key} is one of {', '.join(values)}", lambda s: s[key] in values


def _from(least: float, *keys: str) -> Rule:
    return f"{', '.join(keys)}: {least} or more", lambda s: all(s[k] >= least for k in keys)


RERANKER_RULES: list[Rule] = [
    _from(1, "max_length", "interaction_dim", "interaction_hidden_dim"),
    _from(0, "interaction_score_scale"),
    ("interaction_dropout is from 0 to below 1", lambda s: 0 <= s["interaction_dropout"] < 1),
    _one_of("attention_mask", "block", "causal"),
    _one_of("position_ids", "shared", "standard"),
    _one_of("interaction", "none", "relational"),
    _one_of("candidate_pooling", "mean"),
    ("an interaction needs a block mask and shared positions", lambda s: s["interaction"] == "none" or (s["attention_mask"], s["position_ids"]) == ("block", "shared")),
    ("markers are different texts, none empty", lambda s: all(s[m] for m in MARKS) and len({s[m] for m in MARKS}) == len(MARKS)),
]
TRAINING_RULES: list[Rule] = [
    _from(1, "train_num_permutations", "eval_num_permutations", "gradient_accumulation_steps"),
    _from(0, "lambda_rank", "lambda_perm"),
    ("learning_rate is above 0", lambda s: s["learning_rate"] > 0),
    _one_of("permutation_loss", "kl", "jeffreys"),
    ("one of the losses has a weight", lambda s: s["lambda_rank"] > 0 or s["lambda_perm"] > 0),
    ("a permutation loss needs two permutations or more", lambda s: s["lambda_perm"] == 0 or s["train_num_permutations"] >= 2),
    ("num_epochs or total_optimizer_steps is set", lambda s: s["num_epochs"] is not None or s["total_optimizer_steps"] is not None),
]


def _checked(defaults: Mapping[str, Any], rules: list[Rule], given: Mapping[str, Any] | None) -> dict[str, Any]:
    said = dict(given or {})
    for old, new in RENAMED.items():
        if old in said and new in defaults and new not in said:
            said[new] = said.pop(old)
    out = {**defaults, **said}
    if broken := [text for text, holds in rules if not holds(out)]:
        raise ValueError("; ".join(broken))
    return out


def reranker_settings(given: Mapping[str, Any] | None = None, architecture: str | None = None) -> dict[str, Any]:
    """Defaults, what is given over them, and a named architecture's mask, positions and interaction over both."""
    preset: dict[str, Any] = {}
    if architecture is not None:
        named = {name: parts for parts, name in ARCHITECTURES.items()}
        if architecture not in named:
            raise ValueError(f"no such architecture: {architecture}; there are {', '.join(sorted(named))}")
        preset = dict(zip(("attention_mask", "position_ids", "interaction"), named[architecture], strict=True)) | {"prompt_template": "marker"}
    return _checked(RERANKER, RERANKER_RULES, {**(given or {}), **preset})


def training_settings(given: Mapping[str, Any] | None = None) -> dict[str, Any]:
    out = _checked(TRAINING, TRAINING_RULES, given)
    return out | {"lora_target_modules": list(out["lora_target_modules"])}


def check_prompt(scoring: str, prompt: str) -> None:
    """A way of scoring reads one kind of prompt only."""
    if scoring not in PROMPT_OF:
        raise ValueError(f"no such scoring: {scoring}; there are {', '.join(sorted(PROMPT_OF))}")
    if PROMPT_OF[scoring] != prompt:
        raise ValueError(f"{scoring} reads a {PROMPT_OF[scoring]} prompt, not {prompt}")
