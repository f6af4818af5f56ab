"""Policies: the text that says where files belong, read and checked once on the driver.

A policy has a folder, defaults and rules in order of precedence. Unknown keys
are errors; what is allowed but looks wrong becomes a warning.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from stowage.functions import matching
from stowage.functions.grammar import Interval, parse_duration, parse_size
from stowage.functions.templates import Template

#: The attributes of a file, by the tier of reading that gives them.
TIERS = ("stat", "head", "meta", "whole")
ATTRIBUTES = {"name": "stat", "stem": "stat", "ext": "stat", "parent": "stat", "path": "stat", "size": "stat", "mtime": "stat", "source": "stat", "now": "stat", "mime": "head", "exif": "meta", "hash": "whole"}
CHOICES = {
    "mode": ("observe", "suggest", "enforce"),
    "symlinks": ("ignore", "as-file", "follow-within"),
    "on_conflict": ("skip", "quarantine", "replace", "rename"),
    "on_duplicate": ("keep", "skip", "link", "trash", "quarantine", "newest", "oldest", "largest", "ask"),
}


class PolicyError(ValueError):
    pass


@dataclass(frozen=True)
class Match:
    ext: tuple[str, ...] = ()
    mime: tuple[str, ...] = ()
    glob: tuple[str, ...] = ()
    regex: str | None = None
    size: Interval | None = None
    age: Interval | None = None
    #: Names that the pattern captures, with their groups' numbers.
    captures: tuple[tuple[str, int], ...] = ()

    def subsumes(self, later: Match) -> bool:
        """Whether every file that ``later`` matches is matched by this. False where patterns can't be compared."""
        if self.glob or self.regex:
            return False
        return (
            (not self.ext or bool(later.ext) and set(later.ext) <= set(self.ext))
            and (not self.mime or bool(later.mime) and all(any(p in ("*", q) or p.endswith("/*") and q.startswith(p[:-1]) for p in self.mime) for q in later.mime))
            and (not self.size or bool(later.size) and self.size.subsumes(later.size))
            and (not self.age or bool(later.age) and self.age.subsumes(later.age))
        )


@dataclass(frozen=True)
class Var:
    sources: tuple[str, ...]
    tz: str = "UTC"
    map: tuple[tuple[str, str], ...] | None = None
    bucket: tuple[Interval, ...] | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    path: Template
    match: Match = Match()
    vars: dict[str, Var] = field(default_factory=dict)
    rename: Template | None = None

    @property
    def tier(self) -> str:
        used = {"mime"} if self.match.mime else set()
        templates = self.path.names + (self.rename.names if self.rename else [])
        captured = {n for n, _ in self.match.captures}
        for n in templates:
            used |= set(self.vars[n].sources) if n in self.vars else {n} - captured
        return max((ATTRIBUTES.get(n.split(".")[0], "stat") for n in used), key=TIERS.index, default="stat")


@dataclass(frozen=True)
class Policy:
    name: str
    rules: tuple[Rule, ...]
    mode: str = "observe"
    inbox: str | None = None
    ignore: tuple[str, ...] = ()
    opaque: tuple[str, ...] = ()
    symlinks: str = "ignore"
    on_conflict: str = "rename"
    on_duplicate: str = "keep"
    cooldown: int = 30
    warnings: tuple[str, ...] = ()

    @property
    def tier(self) -> str:
        return max((r.tier for r in self.rules), key=TIERS.index, default="stat")


def _known(table: dict, keys: str, where: str) -> dict:
    extra = set(table) - set(keys.split())
    if extra:
        raise PolicyError(f"{where}: unknown key {sorted(extra)[0]!r}")
    return table


def _many(x) -> tuple[str, ...]:
    return () if x is None else (x,) if isinstance(x, str) else tuple(x)


def _choice(table: dict, key: str, default: str) -> str:
    value = table.get(key, default)
    if value not in CHOICES[key]:
        raise PolicyError(f"{key}: {value!r} is none of {', '.join(CHOICES[key])}")
    return value


def load(text: str) -> Policy:
    """A policy from its TOML text."""
    try:
        raw = _known(tomllib.loads(text), "folder defaults rule", "policy")
    except tomllib.TOMLDecodeError as error:
        raise PolicyError(str(error)) from error
    if "folder" not in raw:
        raise PolicyError("policy: a folder is needed")
    folder = _known(raw["folder"], "name mode inbox ignore opaque symlinks", "folder")
    defaults = _known(raw.get("defaults", {}), "on_duplicate on_conflict cooldown", "defaults")
    try:
        rules = tuple(_rule(r) for r in raw.get("rule", []))
        for p in (*folder.get("ignore", ()), *folder.get("opaque", ())):
            matching.glob_regex(p)
        cooldown = parse_duration(defaults.get("cooldown", "30s"))
    except PolicyError:
        raise
    except ValueError as error:
        raise PolicyError(str(error)) from error
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise PolicyError("two rules share a name")
    warnings = [f"rule {b.name!r} never applies: {a.name!r} matches all of it first" for k, b in enumerate(rules) for a in rules[:k] if a.match.subsumes(b.match)]
    return Policy(folder["name"], rules, _choice(folder, "mode", "observe"), folder.get("inbox"), _many(folder.get("ignore")), _many(folder.get("opaque")), _choice(folder, "symlinks", "ignore"), _choice(defaults, "on_conflict", "rename"), _choice(defaults, "on_duplicate", "keep"), cooldown, tuple(warnings))


def _rule(raw: dict) -> Rule:
    where = f"rule {raw.get('name')!r}"
    _known(raw, "name path match vars rename", where)
    m = _known(raw.get("match", {}), "ext mime glob regex size age", where)
    pattern, groups = matching.regex(m["regex"]) if "regex" in m else (None, {})
    for p in _many(m.get("glob")):
        matching.glob_regex(p)
    match = Match(
        tuple(x.lower() for x in _many(m.get("ext"))), _many(m.get("mime")), _many(m.get("glob")), pattern,
        Interval.parse(m["size"], parse_size) if "size" in m else None, Interval.parse(m["age"], parse_duration) if "age" in m else None, tuple(groups.items()),
    )
    variables = {n: _var(n, v, groups) for n, v in raw.get("vars", {}).items()}
    rule = Rule(raw["name"], Template.parse(raw["path"]), match, variables, Template.parse(raw["rename"]) if "rename" in raw else None)
    for n in rule.path.names + (rule.rename.names if rule.rename else []):
        if n not in variables and n not in groups and not _attribute(n):
            raise PolicyError(f"{where}: nothing is called {n!r}")
    return rule


def _attribute(name: str) -> bool:
    return name in ATTRIBUTES and name != "exif" or name.startswith("exif.") and len(name) > 5


def _var(name: str, raw: dict, groups: dict[str, int]) -> Var:
    _known(raw, "from tz map bucket", f"var {name!r}")
    sources = _many(raw["from"])
    for s in sources:
        if s not in groups and not _attribute(s):
            raise PolicyError(f"var {name!r}: nothing is called {s!r}")
    if "map" in raw and "bucket" in raw:
        raise PolicyError(f"var {name!r}: either a map or a bucket")
    bucket = tuple(Interval.parse(b) for b in raw["bucket"]) if "bucket" in raw else None
    return Var(sources, raw.get("tz", "UTC"), tuple(raw["map"].items()) if "map" in raw else None, bucket)
