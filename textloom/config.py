"""Layered configuration: deep merge, levels and routing. Driver-side, plain dictionaries."""

from __future__ import annotations

import logging
from pathlib import Path
from typing import Any


def deep_merge(base: dict, over: dict) -> dict:
    """Later wins; mappings merge, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_yaml(path: Path) -> dict:
    """The mapping in a YAML (or JSON) file; {} if there is no file."""
    if not path.exists():
        return {}
    text = path.read_text(encoding="utf-8")
    try:
        import yaml

        data = yaml.safe_load(text) or {}
    except ImportError:
        import json

        data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return data


def yaml_name(name: str) -> str:
    return name if name.endswith(".yaml") else f"{name}.yaml"


def stacked(root: Path, script: str, action: str, name: str | None = None, extra: tuple[str, ...] = ()) -> dict:
    """The merged layers, from general to particular: at each of four levels the file of the name, then each extra one.

    Without a name the action's stands for it. Extra files may be given with or without their suffix.
    """
    name = name or action
    files = [yaml_name(x) for x in (name, *extra)]
    out: dict = {}
    for level in (root, root / script, root / script / action, root / script / action / name):
        for file in files:
            out = deep_merge(out, load_yaml(level / file))
    return out


def route(config: dict, sections: dict[str, set[str]]) -> dict[str, dict[str, Any]]:
    """Keys by section: a nested section first, then flat keys that are its fields and not nested in it, the rest to `extra`."""
    out: dict = {s: dict(config.get(s) or {}) for s in sections}
    out["extra"] = {}
    for k, v in config.items():
        if k not in sections:
            home = next((s for s, fields in sections.items() if k in fields and k not in out[s]), None)
            out[home or "extra"][k] = v
    return out


def run_name(dataset: str, short: str, batch: int, lr: float | str) -> str:
    return f"{dataset}.{short}.b{batch}.lr{lr}"


def run_dirs(root: Path, action: str | None = None, name: str | None = None) -> dict[str, dict[str, Path]]:
    """Folders of a run: the base ones, which are made, and those of the action and the name, made by what uses them."""
    base = {"tmp": root / "tmp", "log": root / "log", "result": root / "result", "data": root / "result" / "data"}
    for p in base.values():
        p.mkdir(parents=True, exist_ok=True)
    out = {"base": base}
    for part in dict.fromkeys(x for x in (action, name) if x):
        out[part] = {"tmp": base["tmp"] / part, "result": base["result"] / part, "data": base["data"] / part}
    return out


def logger(name: str, folder: Path, level: str = "INFO") -> logging.Logger:
    """A logger to the console and to a file of its own."""
    log = logging.getLogger(f"textloom.{name}")
    log.setLevel(level)
    log.propagate = False
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    for h in (logging.StreamHandler(), logging.FileHandler(folder / f"{name}.log", encoding="utf-8")):
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
    return log
