"""Pipelines from files: YAML documents and SQL files with "-- quern:" lines; ${NAME} is replaced from the environment.

Checks stand in a step (checks, audits, or quality: {assertions, audits}), in SQL lines "-- quern:assert: not_null(id)" and
"-- quern:audit: ...", in a file NAME.quality.yaml beside the step's, or in a file of a folder named quality (its `step` field, or its
stem, names the step). Such files hold a list of assertions, or a mapping with `assertions` and `audits`.
"""

from __future__ import annotations

import os
import re
import warnings
from pathlib import Path
from typing import Any

import yaml

from quern.operators.checks import TYPES
from quern.plans.graph import Pipeline, PipelineError, Step

_VAR = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")
#: Parts of names that hold credentials.
CREDENTIALS = ("password", "secret", "token", "key", "credential")


def substitute(value: Any, env: dict[str, str], strict: bool = True) -> Any:
    """${NAME} and ${NAME:-default} in all strings; an unset name is an error, or stays as it is when not strict."""
    if isinstance(value, dict):
        return {k: substitute(v, env, strict) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env, strict) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is not None:
            return m[2]
        if strict:
            raise PipelineError("UNSET_VARIABLE", m[1])
        return m[0]

    return _VAR.sub(one, value)


def parse_check(text: str) -> dict[str, Any]:
    """not_null(a, b), row_count(min=1), accepted_values(column=s, values=[a, b])."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", text, re.S)
    if not m:
        raise PipelineError("BAD_CHECK", text)
    out: dict[str, Any] = {"type": m[1]}
    for part in re.findall(r"(?:[^,\[\]]|\[[^\]]*\])+", m[2] or ""):
        key, eq, value = part.partition("=")
        if eq and re.fullmatch(r"\s*\w+\s*", key) and m[1] != "expression":
            out[key.strip()] = yaml.safe_load(value.strip())
        elif m[1] == "expression":
            out["expression"] = (m[2] or "").strip()
        else:
            out.setdefault("columns", []).append(part.strip())
    return out


def check_of(entry: Any, phase: str = "assertion") -> dict[str, Any]:
    if isinstance(entry, str):
        entry = parse_check(entry)
    if not isinstance(entry, dict) or "type" not in entry:
        raise PipelineError("BAD_CHECK", f"a check is a mapping with a type: {entry!r}")
    if entry["type"] not in TYPES:
        raise PipelineError("BAD_CHECK", f"unknown check {entry['type']!r}")
    return {**entry, "phase": entry.get("phase", phase)}


def sections(data: Any, where: str) -> list[dict[str, Any]]:
    """Checks of a list of assertions, or of a mapping with assertions and audits."""
    if isinstance(data, list):
        data = {"assertions": data}
    if not isinstance(data, dict) or not {"assertions", "audits"} & set(data):
        raise PipelineError("BAD_CHECK", f"{where}: a list of checks, or assertions and audits, are wanted")
    for name in ("assertions", "audits"):
        if not isinstance(data.get(name) or [], list):
            raise PipelineError("BAD_CHECK", f"{where}: {name} must be a list")
    return [check_of(c, phase) for name, phase in (("assertions", "assertion"), ("audits", "audit")) for c in data.get(name) or []]


def plain_credentials(data: Any, path: str = "") -> list[str]:
    """Places of strings under names of credentials that aren't a ${NAME}."""
    if isinstance(data, dict):
        own = [f"{path}.{k}".lstrip(".") for k, v in data.items() if isinstance(v, str) and any(c in str(k).lower() for c in CREDENTIALS) and not _VAR.fullmatch(v)]
        return own + [x for k, v in data.items() for x in plain_credentials(v, f"{path}.{k}")]
    if isinstance(data, list):
        return [x for i, v in enumerate(data) for x in plain_credentials(v, f"{path}[{i}]")]
    return []


def _profiles(place: Path) -> dict[str, dict[str, Any]]:
    """Of profiles.yaml, or of a folder `profiles` with a file for each."""
    if (f := place / "profiles.yaml").is_file():
        return {k: v or {} for k, v in (yaml.safe_load(f.read_text()) or {}).items()}
    if (d := place / "profiles").is_dir():
        return {f.stem: yaml.safe_load(f.read_text()) or {} for f in sorted(d.iterdir()) if f.suffix in (".yaml", ".yml")}
    return {}


def _over(low: Any, high: Any) -> Any:
    """Mappings joined name by name; anything else of high replaces low's."""
    return {k: _over(low[k], high[k]) if k in low and k in high else high.get(k, low.get(k)) for k in {**low, **high}} if isinstance(low, dict) and isinstance(high, dict) else high


def load_profile(folder: str | Path, name: str | None = None, env: dict[str, str] | None = None, home: str | Path | None = None, strict: bool = True) -> dict[str, Any]:
    """A profile (catalogs, default, settings): the user's own (~/.quern) under the project's, then the environment's values.

    Without a name: `default`, or the only one there is. A credential written out gives a warning.
    """
    own, shared = _profiles(Path(folder)), _profiles(Path(home or Path.home()) / ".quern")
    names = sorted({*own, *shared})
    if not names:
        return {}
    chosen = name or ("default" if "default" in names else names[0] if len(names) == 1 else None)
    if chosen not in names:
        raise PipelineError("NO_PROFILE", f"{chosen or 'a name is wanted'}: there are {', '.join(names)}")
    merged = _over(shared.get(chosen, {}), own.get(chosen, {}))
    for place in plain_credentials(merged):
        warnings.warn(f"profile {chosen}: credential written out at {place}; use ${{NAME}}", stacklevel=2)
    return substitute(merged, dict(os.environ) if env is None else env, strict)


def step_of(spec: dict[str, Any], base: Path) -> Step:
    fields = {f for f in Step.__dataclass_fields__}
    s = dict(spec)
    s["checks"] = [check_of(c) for c in s.get("checks") or []] + [check_of(c, "audit") for c in s.pop("audits", None) or []]
    if "quality" in s:
        s["checks"] += sections(s.pop("quality"), f"{s.get('name')}: quality")
    if isinstance(s.get("write"), dict):
        w = dict(s.pop("write"))
        s["strategy"], s["strategy_options"] = w.pop("strategy", "replace"), w
    if unknown := set(s) - fields:
        raise PipelineError("UNKNOWN_FIELD", f"{s.get('name')}: {', '.join(sorted(unknown))}")
    if s.get("path") and "://" not in s["path"] and not os.path.isabs(s["path"]):
        s["path"] = str(base / s["path"])
    return Step(**s)


def load_file(path: str | Path, env: dict[str, str] | None = None, strict: bool = True) -> list[Step]:
    """Steps of one .yaml (a list, or a mapping with `steps`) or .sql file."""
    path, env = Path(path), dict(os.environ) if env is None else env
    text = path.read_text()
    base = path.parent
    if path.suffix == ".sql":
        marked = re.findall(r"^\s*--\s*quern:(assert|audit):\s*(.*?)\s*$", text, re.M)
        notes = "\n".join(m[1] for m in re.finditer(r"^\s*--\s*quern:(?!assert:|audit:)[ ]?(.*)$", text, re.M))
        spec = substitute(yaml.safe_load(notes) or {}, env, strict)
        spec["checks"] = [*(spec.get("checks") or []), *(check_of(c, "audit" if kind == "audit" else "assertion") for kind, c in marked)]
        body = re.sub(r"^\s*--\s*quern:.*$\n?", "", text, flags=re.M)
        return [step_of({"name": path.stem, "kind": "sql", **spec, "sql": substitute(body, env, strict)}, base)]
    data = substitute(yaml.safe_load(text) or [], env, strict)
    return [step_of(s, base) for s in (data.get("steps", []) if isinstance(data, dict) else data)]


def _quality(f: Path) -> tuple[str, list[dict[str, Any]]]:
    data = yaml.safe_load(f.read_text())
    named = data.get("step") if isinstance(data, dict) else None
    return named or re.sub(r"(\.quality)?\.ya?ml$", "", f.name), sections(data, str(f))


def load(folder: str | Path, env: dict[str, str] | None = None, strict: bool = True) -> Pipeline:
    """All .yaml, .yml and .sql files below a folder, by name; profiles, tests and quality files are read apart."""
    root = Path(folder)
    hidden = lambda p: any(x.startswith(".") for x in p.relative_to(root).parts)
    files = [root] if root.is_file() else sorted(p for p in root.rglob("*") if p.suffix in (".yaml", ".yml", ".sql") and not hidden(p))
    inner = lambda p: p.relative_to(root).parts[:-1] if root.is_dir() else ()
    apart = [p for p in files if p.suffix != ".sql" and (p.name.endswith((".quality.yaml", ".quality.yml")) or "quality" in inner(p))]
    skipped = {p for p in files if p.name.endswith((".test.yaml", ".test.yml")) or p.name == "profiles.yaml" or "profiles" in inner(p)}
    pipeline = Pipeline(s for f in files if f not in skipped and f not in apart for s in load_file(f, env, strict))
    steps = pipeline.steps
    for f in apart:
        name, checks = _quality(f)
        if name not in steps:
            raise PipelineError("UNKNOWN_STEP", f"{f}: {name}")
        steps[name].checks += checks
    return pipeline
