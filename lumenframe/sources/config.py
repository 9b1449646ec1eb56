"""De-identification settings in JSON, with comments, trailing commas and inheritance by "$extends"."""

from __future__ import annotations

import json
import re
from typing import Any

from ..dims import DEID_OPTIONS, KEYWORD, t
from ..operators.deid import DateShift, DeidOptions

PRESETS: dict[str, dict[str, Any]] = {
    "basic": {"options": []},
    "research": {"options": ["rpat", "rmod", "cdesc"], "dateShift": {"strategy": "per_patient", "low": -365, "high": 365}},
    "clinical-trial": {"options": ["rpat", "rdev", "rmod"], "dateShift": {"strategy": "remove_time", "days": -100}},
    "teaching": {"options": ["cdesc", "cgraph"]},
}
_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])', re.S)
ACTION_NAMES = {"DUMMY": "D", "EMPTY": "Z", "ZERO": "Z", "REMOVE": "X", "KEEP": "K", "CLEAN": "C", "REMAP": "U", "REMAPUID": "U", "UID": "U"}


def loads(text: str) -> dict[str, Any]:
    """JSON in which comments and trailing commas may stand."""
    return json.loads(_TOKEN.sub(lambda m: m[0] if m[0][0] == '"' else "", text))


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Lists are united in order, objects merged, anything else replaced."""
    out = dict(base)
    for k, v in over.items():
        if isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = list(dict.fromkeys([*out[k], *v]))
        elif isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merge(out[k], v)
        else:
            out[k] = v
    return out


def resolve(config: dict[str, Any], named: dict[str, dict[str, Any]] | None = None, seen: tuple[str, ...] = ()) -> dict[str, Any]:
    """A config with all it extends merged below it."""
    known = PRESETS | (named or {})
    parent = config.get("$extends")
    own = {k: v for k, v in config.items() if k != "$extends"}
    if parent is None:
        return own
    if parent in seen:
        raise ValueError(f"configs extend each other: {' -> '.join((*seen, parent))}")
    if parent not in known:
        raise ValueError(f"no such config: {parent}")
    return merge(resolve(known[parent], named, (*seen, parent)), own)


def parse_tag(text: str, keywords: dict[str, int] | None = None) -> int:
    m = re.fullmatch(r"\(?([0-9A-Fa-f]{4}),?([0-9A-Fa-f]{4})\)?", text.strip())
    if m:
        return t(f"{m[1]},{m[2]}")
    for k, tag in {**KEYWORD, **(keywords or {})}.items():
        if k.lower() == text.strip().lower():
            return tag
    raise ValueError(f"no such tag: {text}")


def parse_action(text: str) -> str:
    up = text.strip().upper()
    return ACTION_NAMES.get(up.replace("_", ""), up)


def options(config: dict[str, Any] | str, named: dict[str, dict[str, Any]] | None = None, keywords: dict[str, int] | None = None) -> DeidOptions:
    """The options that a config stands for; keywords adds those of a loaded dictionary."""
    c = resolve(loads(config) if isinstance(config, str) else config, named)
    unknown = set(c.get("options", [])) - set(DEID_OPTIONS)
    if unknown:
        raise ValueError(f"no such option: {sorted(unknown)}")
    out = DeidOptions().retain(*c.get("options", []))
    for name, action in c.get("overrides", {}).items():
        out = out.with_override(parse_tag(name, keywords), parse_action(action))
    if c.get("safePrivateCreators"):
        out = out.with_safe_creators(*c["safePrivateCreators"])
    shift = c.get("dateShift")
    return out.with_shift(DateShift(**shift)) if shift else out
