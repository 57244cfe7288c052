"""Policies: which files, which rules, which plans, and how far a run may go."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from ..errors import ConfigError
from ..operators import filters, rules
from ..schema import ENUMS
from .planner import TYPES


@dataclass
class Scope:
    include_drives: list[str] = field(default_factory=list)
    exclude_drives: list[str] = field(default_factory=list)
    include_paths: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)


@dataclass
class PlanSpec:
    type: str
    description: str | None = None
    source_drive: str | None = None
    target_drive: str | None = None
    category_filter: str | None = None
    duplicate_group: int | None = None
    original_file: int | None = None


@dataclass
class Safety:
    require_approval: bool = False
    max_bytes_per_run: str | None = None
    dry_run_only: bool = False


@dataclass
class Schedule:
    cron: str | None = None
    timezone: str | None = None


@dataclass
class Policy:
    version: str
    name: str
    description: str | None = None
    scope: Scope = field(default_factory=Scope)
    default_priority: str | None = None
    rules: list[rules.Rule] = field(default_factory=list)
    plans: dict[str, PlanSpec] = field(default_factory=dict)
    safety: Safety = field(default_factory=Safety)
    schedule: Schedule = field(default_factory=Schedule)

    def validate(self) -> None:
        if not self.version.strip():
            raise ConfigError("a policy needs a version")
        if not self.name.strip():
            raise ConfigError("a policy needs a name")
        if self.default_priority is not None and self.default_priority not in ENUMS["priority"]:
            raise ConfigError(f"{self.default_priority!r} is no priority")
        for name, plan in self.plans.items():
            if plan.type not in TYPES:
                raise ConfigError(f"plan {name!r}: {plan.type!r} is none of {', '.join(TYPES)}")
        if self.safety.max_bytes_per_run is not None:
            size_of(self.safety.max_bytes_per_run)


def _some(kind, table: dict):
    known = set(kind.__dataclass_fields__)
    try:
        return kind(**{k: v for k, v in table.items() if k in known})
    except TypeError as e:
        raise ConfigError(f"policy: {e}") from e


def from_toml(text: str) -> Policy:
    try:
        x = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"policy can't be read: {e}") from e
    for needed in ("version", "name"):
        if not isinstance(x.get(needed), str):
            raise ConfigError(f"a policy needs a {needed}")
    return Policy(
        x["version"], x["name"], x.get("description"), _some(Scope, x.get("scope", {})), x.get("classification", {}).get("default_priority"),
        rules.ordered([rules.from_table(n, t) for n, t in x.get("rules", {}).items()]), {n: _some(PlanSpec, t) for n, t in x.get("plans", {}).items()},
        _some(Safety, x.get("safety", {})), _some(Schedule, x.get("schedule", {})),
    )


def from_file(path: str) -> Policy:
    try:
        return from_toml(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise ConfigError(f"policy can't be read: {e}") from e


def effective(policy_path: str, user_rules: str | None = None, mount: str | None = None, drive_rules: str = ".stratafile/rules.toml") -> tuple[Policy, list[rules.Rule]]:
    """The policy, and its rules over those of the drive over those of the user; files that aren't there count as empty."""
    policy = from_file(policy_path)
    files = [user_rules, str(Path(mount, drive_rules)) if mount else None]
    sets = [rules.from_file(f) for f in files if f and Path(f).is_file()]
    return policy, rules.merged(*sets, policy.rules)


def size_of(text: str) -> int:
    """Bytes of 1.5 MB and the like, for arguments; formats.parse_size is the same for columns."""
    import re

    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([KMGT]?B)?\s*", text, re.I)
    if not m:
        raise ConfigError(f"{text!r} is no size")
    return int(float(m[1]) * 1024 ** ("BKMGT".index(m[2][0].upper()) if m[2] else 0))


def scoped(files: DataFrame, drives: DataFrame, scope: Scope) -> DataFrame:
    """The files in scope; labels that no drive has are ignored, but if only such are included nothing is."""
    ids = {r["label"]: r["id"] for r in drives.where(drives.label.isin(*scope.include_drives, *scope.exclude_drives)).select("label", "id").collect()} if scope.include_drives or scope.exclude_drives else {}
    include = [ids[x] for x in scope.include_drives if x in ids]
    if scope.include_drives and not include:
        return files.limit(0)
    return filters.in_scope(files, include, [ids[x] for x in scope.exclude_drives if x in ids], scope.include_paths, scope.exclude_paths)
