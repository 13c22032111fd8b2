"""Settings and task files on the driver."""

from __future__ import annotations

import json
import os

VERBS = {"analyze": {"input", "force", "no_cache"}, "corpus": {"inputs", "policy"}, "export": {"source", "format"}, "diff": {"a", "b"}}


def env_values(*paths: str) -> dict[str, str]:
    """KEY=VALUE lines of the files that exist, later files first in rank; '#' begins a comment line."""
    out: dict[str, str] = {}
    for p in paths:
        if os.path.isfile(p):
            for line in open(p, encoding="utf-8"):
                key, sep, value = line.strip().partition("=")
                if sep and not key.startswith("#"):
                    out[key.strip()] = value.strip().strip("'\"")
    return out


def script_tasks(path: str) -> list[dict]:
    """Tasks of a JSON or YAML file: a list of {command, options}. Unknown commands or options are refused."""
    text = open(path, encoding="utf-8").read()
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML task files need a YAML library; JSON files do not") from e
        tasks = yaml.safe_load(text)
    else:
        tasks = json.loads(text)
    if isinstance(tasks, dict):
        tasks = tasks.get("tasks")
    if not isinstance(tasks, list):
        raise ValueError("no list of tasks")
    for t in tasks:
        verb, options = t.get("command"), t.get("options", {})
        if verb not in VERBS or set(options) - VERBS[verb]:
            raise ValueError(f"unknown command or option: {t}")
    return tasks
