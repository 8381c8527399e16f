"""Configurations: YAML or JSON files, defaults < entry < command line, with checks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

MODES = ("binary", "structured", "both")
KINDS = ("a", "b", "c")


def load_config(path: str) -> dict:
    """A mapping from a .yaml, .yml or .json file."""
    p = Path(path)
    text = p.read_text(encoding="utf-8")
    if p.suffix.lower() in (".yaml", ".yml"):
        import yaml

        out = yaml.safe_load(text)
    elif p.suffix.lower() == ".json":
        out = json.loads(text)
    else:
        raise ValueError(f"no configuration format for {p.suffix!r}")
    if not isinstance(out, dict):
        raise ValueError("the top level of a configuration is a mapping")
    return out


def load_runs(path: str) -> dict:
    out = load_config(path)
    if not isinstance(out.get("runs"), list) or not out["runs"]:
        raise ValueError("an evaluation configuration has a list `runs`")
    return out


@dataclass
class Preparation:
    kind: str = ""
    root: str = ""
    output_dir: str = ""
    mode: str = "binary"
    train_ratio: float = 0.7
    seed: int = 42
    max_per_class: int | None = None
    metadata: str | None = None
    folds: str | None = None
    preview: int = 20
    dry_run: bool = False
    extra: dict = field(default_factory=dict)

    def checked(self) -> Preparation:
        for name in ("kind", "root", "output_dir"):
            if not getattr(self, name):
                raise ValueError(f"{name} is required")
        if self.kind not in KINDS:
            raise ValueError(f"unknown corpus kind {self.kind!r}")
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        if not 0 < self.train_ratio < 1:
            raise ValueError("train_ratio is between 0 and 1")
        if self.max_per_class is not None and self.max_per_class < 1:
            raise ValueError("max_per_class is at least 1")
        return self


def layered(kind: type, *layers: dict):
    """A dataclass from layers of settings, later ones over earlier ones, checked.

    Values that are None don't override; names that it doesn't know go to its `extra`."""
    merged = {k: v for layer in layers for k, v in layer.items() if v is not None}
    known = {f.name for f in fields(kind)} - {"extra"}
    return replace(kind(**{k: v for k, v in merged.items() if k in known}), extra={k: v for k, v in merged.items() if k not in known}).checked()


def resolve(defaults: dict, entry: dict, command_line: dict) -> Preparation:
    return layered(Preparation, defaults, entry, command_line)


def selected(runs: list[dict], only: list[str] | str | None) -> list[dict]:
    """The runs named by `only` (separated by commas or spaces), all without it; none left is an error."""
    words = only.split() if isinstance(only, str) else list(only or [])
    names = list(dict.fromkeys(n for w in words for n in w.replace(",", " ").split()))
    out = [r for r in runs if not names or r.get("name") in names]
    if not out:
        raise ValueError(f"no run is named {names}")
    return out


def join_output(root: str, name: str) -> str:
    """With a slash where the root is written with slashes."""
    return f"{root.rstrip('/')}/{name}" if "/" in root and "\\" not in root else str(Path(root) / name)


@dataclass
class Evaluation:
    """A run of an evaluation: where its samples are, which back end scores them, and where its bundle goes."""

    name: str = ""
    jsonl: str = ""
    output_dir: str = ""
    output_root: str = ""
    dataset: str = ""
    adapter_path: str = ""
    backend: str = "logits"
    batch: int = 8
    max_samples: int | None = None
    extra: dict = field(default_factory=dict)

    def checked(self) -> Evaluation:
        if not self.output_dir and self.output_root and self.name:
            self.output_dir = join_output(self.output_root, self.name)
        lost = [k for k in ("name", "jsonl", "output_dir") if not getattr(self, k)]
        if lost:
            raise ValueError(f"a run needs {lost}")
        if self.batch < 1 or (self.max_samples is not None and self.max_samples < 0):
            raise ValueError("batch is at least 1, max_samples at least 0")
        return self


def evaluations(config: dict, command_line: dict, only: list[str] | str | None = None) -> list[Evaluation]:
    """The selected runs of a configuration, each with its `defaults` below it and the command line above it."""
    return [layered(Evaluation, config.get("defaults", {}), run, command_line) for run in selected(config["runs"], only)]
