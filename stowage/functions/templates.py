"""Templates of paths and names: text with ``{name:format|filter|…}`` in it, compiled to a column."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.functions.grammar import wall

#: Date directives and the patterns that Spark calls them by.
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "B": "MMMM", "b": "MMM", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}
DEFAULT_DATE = "%Y-%m-%d"


class TemplateError(ValueError):
    """A template that can't be read, with the place of the trouble."""

    def __init__(self, message: str, start: int, end: int):
        super().__init__(f"{message} (at {start}..{end})")
        self.start, self.end = start, end


@dataclass(frozen=True)
class Value:
    """A placeholder's value as a column, and what kind it is: text, size, instant (zoned) or civil (never zoned)."""

    column: Column
    kind: str = "text"
    zone: str | None = None

    def text(self, form: str | None) -> Column:
        if self.kind in ("instant", "civil"):
            column = self.column
            if self.kind == "instant" and self.zone:
                column = wall(column, self.zone)
            return F.date_format(column, java_pattern(form or DEFAULT_DATE))
        column = self.column.cast("string")
        if form is None:
            return column
        if not form.isdigit():
            raise ValueError(f"{form!r} is no length")
        return F.substring(column, 1, int(form))


def java_pattern(form: str) -> str:
    """A strftime pattern in Spark's letters."""
    out, literal = "", ""

    def flush() -> str:
        return "'" + literal.replace("'", "''") + "'" if literal else ""

    k = 0
    while k < len(form):
        if form[k] == "%":
            d = form[k + 1 : k + 2]
            if d == "%":
                literal += "%"
            elif d in DIRECTIVES:
                out += flush() + DIRECTIVES[d]
                literal = ""
            else:
                raise ValueError(f"unknown date directive %{d}")
            k += 2
        else:
            literal += form[k]
            k += 1
    return out + flush()


FILTERS: dict[str, Callable[..., Column]] = {
    "lower": lambda c: F.lower(c),
    "upper": lambda c: F.upper(c),
    "slug": lambda c: paths.slug(c),
    "sanitize": lambda c: paths.sanitize(c),
    "trunc": lambda c, n: paths.trunc(c, int(n)),
    "pad": lambda c, n: paths.pad(c, int(n)),
    "hash": lambda c, n="8": paths.digest(c, int(n)),
}


@dataclass(frozen=True)
class Placeholder:
    name: str
    form: str | None
    filters: tuple[tuple[str, str | None], ...]
    start: int
    end: int

    @property
    def default(self) -> str | None:
        return next((a for f, a in self.filters if f == "default"), None)


@dataclass(frozen=True)
class Template:
    source: str
    parts: tuple[str | Placeholder, ...]

    @classmethod
    def parse(cls, source: str) -> Template:
        parts: list[str | Placeholder] = []
        k, literal = 0, ""
        while k < len(source):
            two = source[k : k + 2]
            if two in ("{{", "}}"):
                literal, k = literal + two[0], k + 2
            elif source[k] == "{":
                end = _closing(source, k)
                if literal:
                    parts.append(literal)
                literal = ""
                parts.append(_placeholder(source, k, end))
                k = end
            elif source[k] == "}":
                raise TemplateError("a lone closing brace", k, k + 1)
            else:
                literal, k = literal + source[k], k + 1
        if literal:
            parts.append(literal)
        return cls(source, tuple(parts))

    @property
    def names(self) -> list[str]:
        return [p.name for p in self.parts if isinstance(p, Placeholder)]

    def render(self, resolve: Callable[[str], Value]) -> Column:
        """The text; null if a placeholder without a default has no value."""
        out = [F.lit(p) if isinstance(p, str) else self._one(p, resolve) for p in self.parts]
        return F.concat(*out) if out else F.lit("")

    def missing(self, resolve: Callable[[str], Value]) -> Column:
        """The name of the first placeholder without a value and default; null if all have one."""
        tests = [F.when(resolve(p.name).column.isNull(), F.lit(p.name)) for p in self.parts if isinstance(p, Placeholder) and p.default is None]
        return F.coalesce(*tests) if tests else F.lit(None).cast("string")

    @staticmethod
    def _one(p: Placeholder, resolve: Callable[[str], Value]) -> Column:
        out = resolve(p.name).text(p.form)
        for f, argument in p.filters:
            if f == "default":
                out = F.coalesce(out, F.lit(argument))
            else:
                out = FILTERS[f](out) if argument is None else FILTERS[f](out, argument)
        return out


def _closing(source: str, start: int) -> int:
    quoted = False
    for k in range(start + 1, len(source)):
        if source[k] == '"':
            quoted = not quoted
        elif source[k] == "}" and not quoted:
            return k + 1
    raise TemplateError("a brace that is never closed", start, len(source))


def _placeholder(source: str, start: int, end: int) -> Placeholder:
    pieces = re.split(r'\|(?=(?:[^"]*"[^"]*")*[^"]*$)', source[start + 1 : end - 1])
    head, _, form = pieces[0].partition(":")
    if not re.fullmatch(r"[A-Za-z_][\w.]*", head.strip()):
        raise TemplateError("a placeholder without a name", start, end)
    filters = []
    for piece in pieces[1:]:
        f, colon, argument = piece.strip().partition(":")
        if f not in FILTERS and f != "default":
            raise TemplateError(f"unknown filter {f!r}", start, end)
        argument = argument.strip().strip('"')
        if f in ("trunc", "pad", "default") and not colon or f in ("trunc", "pad", "hash") and colon and not argument.isdigit():
            raise TemplateError(f"{f} needs its argument", start, end)
        filters.append((f, argument if colon else None))
    return Placeholder(head.strip(), form or None, tuple(filters), start, end)
