"""Packs: declarations in YAML or JSON files, loaded with a digest; every fault in them is fatal."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame

from sarraf.operators.rules import Rule

try:
    import yaml
except ImportError:  # JSON files alone then
    yaml = None

BUILT_IN = Path(__file__).resolve().parent.parent / "packs"


class PackError(ValueError):
    """A pack that can't be used, with the file and what is wrong in it."""


def load_pack(folder: str | Path) -> tuple[dict[str, dict], str]:
    """The declarations of a folder by file name, and a SHA-256 digest of names and contents. A small folder on the driver."""
    found, digest = {}, hashlib.sha256()
    for path in sorted(p for p in Path(folder).iterdir() if p.suffix in (".yaml", ".yml", ".json")):
        content = path.read_bytes()
        digest.update(f"{path.name}\0{len(content)}\0".encode() + content)
        try:
            parsed = json.loads(content) if path.suffix == ".json" else _yaml(path, content)
        except ValueError as wrong:
            raise PackError(f"{path.name}: {wrong}") from wrong
        if not isinstance(parsed, dict):
            raise PackError(f"{path.name}: not a mapping")
        found[path.stem] = parsed
    if not found:
        raise PackError(f"no declarations in {folder}")
    return found, digest.hexdigest()


def _yaml(path: Path, content: bytes):
    if yaml is None:
        raise PackError(f"{path.name}: no YAML reader here")
    try:
        return yaml.safe_load(content)
    except yaml.YAMLError as wrong:
        raise PackError(f"{path.name}: {wrong}") from wrong


def load_rules(folder: str | Path, rows: DataFrame | None = None) -> list[Rule]:
    """The rules of a pack, each bound against the columns of `rows` if given; runs no job.

    Fatal are: an unknown or missing field, a value of another type, a bad or repeated code,
    an expression that does not resolve, a template that names a field outside the evidence.
    """
    known, rules = {f.name for f in fields(Rule)}, []
    for name, content in load_pack(folder)[0].items():
        for entry in content.get("rules", []):
            if not isinstance(entry, dict) or not {"code", "predicate"} <= entry.keys() or entry.keys() - known:
                raise PackError(f"{name}: a rule needs code and predicate, and of {sorted(known)} only: {entry}")
            if not all(isinstance(v, list if k == "evidence" else str) for k, v in entry.items()):
                raise PackError(f"{name}: {entry['code']}: a value has another type")
            rule = Rule(**entry)
            if rule.code in {r.code for r in rules}:
                raise PackError(f"{name}: {rule.code} is there twice")
            strange = set(re.findall(r"\{(\w+)", rule.template)) - set(rule.evidence)
            if strange:
                raise PackError(f"{name}: {rule.code}: {sorted(strange)} in the template are no evidence")
            if rows is not None:
                try:
                    rule.validate(rows)
                except Exception as wrong:  # whatever the analyser says is fatal
                    raise PackError(f"{name}: {rule.code}: {wrong}") from wrong
            rules.append(rule)
    return rules
