"""Names and paths as columns.

A path is relative, with ``/`` between segments and none at its ends. All
functions take and give columns and stay within code generation where the
built-in functions do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that some systems keep for devices.
DEVICES = ["CON", "PRN", "AUX", "NUL", *(f"COM{k}" for k in range(1, 10)), *(f"LPT{k}" for k in range(1, 10))]
#: Directories that hold set-aside files and the engine's own notes; nothing in them is ever touched.
RESERVED = (".stowage", ".stowage-quarantine")
QUARANTINE = RESERVED[1]
_DOTTED = r"(?s)^(.+)\.([^.]*)$"


def trimmed(path: Column) -> Column:
    return F.regexp_replace(path, r"^/+|/+$", "")


def name(path: Column) -> Column:
    return F.element_at(F.split(trimmed(path), "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(trimmed(path), r"(?s)^(.*)/[^/]*$", 1)


def stem(of_name: Column) -> Column:
    """What precedes the last dot; a name whose only dot comes first is all stem."""
    return F.when(of_name.rlike(_DOTTED), F.regexp_extract(of_name, _DOTTED, 1)).otherwise(of_name)


def ext(of_name: Column) -> Column:
    """What follows the last dot, in its own case; empty without one."""
    return F.regexp_extract(of_name, _DOTTED, 2)


def joined(directory: Column, of_name: Column) -> Column:
    return F.when(directory == "", of_name).otherwise(F.concat(directory, F.lit("/"), of_name))


def relocated(path: Column, directory: Column) -> Column:
    """The path of the same name in another directory."""
    return joined(directory, name(path))


def ancestors(path: Column) -> Column:
    """Every directory above a path, shallow first."""
    parts = F.split(trimmed(path), "/")
    n = F.size(parts) - 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def depth(path: Column) -> Column:
    return F.size(F.split(trimmed(path), "/")) - 1


def path_order(path: Column) -> list[Column]:
    """Shallow, then short, then by bytes."""
    return [depth(path), F.octet_length(path), path]


def key(path: Column, case_sensitive: bool | Column) -> Column:
    """What two paths share if they are one place on their volume."""
    if isinstance(case_sensitive, bool):
        return path if case_sensitive else F.lower(path)
    return F.when(case_sensitive, path).otherwise(F.lower(path))


def inside(path: Column, directory: str) -> Column:
    return (path == directory) | path.startswith(directory + "/")


def is_reserved(path: Column) -> Column:
    out = F.lit(False)
    for directory in RESERVED:
        out = out | inside(path, directory)
    return out


def is_partial(path: Column) -> Column:
    """Whether a path is that of a transfer not yet finished."""
    return path.rlike(r"(?s)\.stowage-[0-9]+\.part$")


def sanitize(text: Column) -> Column:
    """A name that every common file system takes."""
    plain = F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f\x7f]', "_"), r"[. ]+$", "")
    device = F.upper(F.element_at(F.split(plain, r"\."), 1)).isin(DEVICES)
    return F.when(device, F.concat(F.lit("_"), plain)).otherwise(plain)


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits, anything between them one hyphen."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-|-$", "")


def trunc(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def pad(text: Column, n: int) -> Column:
    """Zeros on the left up to ``n`` characters; longer text stays whole."""
    return F.when(F.length(text) < n, F.lpad(text, n, "0")).otherwise(text)


def digest(text: Column, n: int | None = None) -> Column:
    """Hex of the content's digest, or its first ``n`` characters."""
    full = F.sha2(text, 256)
    return full if n is None else F.substring(full, 1, n)


def canonical(path: Column) -> Column:
    """A path that cannot leave its root: segments trimmed and sanitised, empty ones and dots dropped."""
    parts = F.transform(F.split(path, r"[/\\]"), lambda s: F.trim(s))
    parts = F.filter(parts, lambda s: ~s.isin("", ".", ".."))
    return F.array_join(F.filter(F.transform(parts, sanitize), lambda s: s != ""), "/")


def destination(directory: Column, of_name: Column) -> Column:
    """Where a file goes: slashes in its name become underscores, a name without anything left is one."""
    clean = sanitize(F.regexp_replace(of_name, r"[/\\]", "_"))
    return joined(canonical(directory), F.when(clean == "", "_").otherwise(clean))


def numbered(path: Column, n: Column) -> Column:
    """The same name with ``-n`` before its extension."""
    of_name = name(path)
    tail = F.when(ext(of_name) == "", "").otherwise(F.concat(F.lit("."), ext(of_name)))
    return joined(parent(path), F.concat(stem(of_name), F.lit("-"), n.cast("string"), tail))


def named_after(path: Column, member: Column) -> Column:
    """``clip (member).mp4`` for ``clip.mp4``."""
    of_name = name(path)
    tail = F.when(ext(of_name) == "", "").otherwise(F.concat(F.lit("."), ext(of_name)))
    return joined(parent(path), F.concat(stem(of_name), F.lit(" ("), member, F.lit(")"), tail))


def parked(path: Column) -> Column:
    return F.concat(F.lit(QUARANTINE + "/"), path)


def is_numbered(candidate: Column, wanted: Column) -> Column:
    """Whether a path is the wanted one or a numbered variant of it."""
    same_ext = ext(name(candidate)) == ext(name(wanted))
    a, b = joined(parent(candidate), stem(name(candidate))), joined(parent(wanted), stem(name(wanted)))
    tail = F.substring(a, F.length(b) + 1, F.length(a))
    return (candidate == wanted) | (same_ext & a.startswith(b) & tail.rlike("^-[0-9]+$"))


def wildcard(text: Column, pattern: str) -> Column:
    """``*`` stands for any run, case does not matter."""
    import re

    return F.lower(text).rlike("(?s)^" + ".*".join(re.escape(p) for p in pattern.lower().split("*")) + "$")


#: Kinds of files by extension.
KINDS = {
    "picture": "jpg jpeg png gif webp bmp tif tiff heic avif svg",
    "video": "mp4 mov mkv avi webm m4v",
    "audio": "mp3 flac wav ogg m4a aac opus",
    "document": "pdf doc docx odt txt md rtf html",
    "table": "csv tsv xls xlsx ods parquet",
    "archive": "zip gz tar 7z rar xz zst",
    "code": "py rs js ts c h cpp java go sh sql json toml yaml",
}


def kind(extension: Column) -> Column:
    """The drawer a file belongs in; ``other`` for unknown extensions."""
    pairs = [F.lit(x) for k, exts in KINDS.items() for e in exts.split() for x in (e, k)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(extension)), F.lit("other"))
