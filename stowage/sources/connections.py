"""Settings of connections: what they lack, what they send unencrypted, options as text, keys of remote paths."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

#: Which settings a scheme can't do without, and which schemes read an option.
NEEDS = {"fs": ("root",), "ftp": ("host",), "ftps": ("host",), "sftp": ("host", "user"), "smb": ("host", "user", "share"), "s3": ("bucket",), "webdav": ("endpoint",)}
READ_BY = {"bucket": ("s3",), "region": ("s3",), "endpoint": ("s3", "webdav"), "encryption": ("smb",), "host_key": ("sftp",), "key": ("sftp",)}
#: What crosses the network readably: for FTP always, for SMB unless encryption is required, else by plain http.
EXPOSED = {"ftp": "password and files", "smb": "files", "s3": "files", "webdav": "password and files"}


@dataclass(frozen=True)
class Settings:
    scheme: str
    root: str = ""
    host: str | None = None
    username: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def option(self, key: str) -> str:
        return (self.options.get(key) or "").strip()


def share_of(root: str) -> str | None:
    """The first part of a root that is not blank."""
    return next((part for part in re.split(r"[/\\]", root) if part.strip()), None)


def problems(settings: Settings) -> list[tuple[str, str]]:
    """(problem, what) of settings that can't work, in order: needs, bad_endpoint, bad_value, unused. Unknown options are none."""
    given = {
        "root": settings.root.strip(), "host": (settings.host or "").strip(), "user": (settings.username or "").strip(), "share": share_of(settings.root),
        "bucket": settings.option("bucket"), "endpoint": settings.option("endpoint"),
    }
    if settings.scheme not in NEEDS:
        return [("unknown_scheme", settings.scheme)]
    out = [("needs", what) for what in NEEDS[settings.scheme] if not given[what]]
    endpoint, encryption = given["endpoint"], settings.option("encryption")
    if settings.scheme in READ_BY["endpoint"] and endpoint and not re.match(r"(?i)https?://", endpoint):
        out.append(("bad_endpoint", endpoint))
    if settings.scheme == "smb" and encryption not in ("", "required"):
        out.append(("bad_value", "encryption"))
    return out + [("unused", key) for key, schemes in READ_BY.items() if settings.option(key) and settings.scheme not in schemes]


def in_the_clear(settings: Settings) -> str | None:
    """What anybody on the network can read; None if nothing."""
    plain = settings.option("endpoint").lower().startswith("http://")
    open_ = {"ftp": True, "smb": settings.option("encryption").lower() != "required", "s3": plain, "webdav": plain}
    return EXPOSED[settings.scheme] if open_.get(settings.scheme) else None


def encode_options(options: dict[str, str]) -> str:
    return json.dumps(options, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def decode_options(text: str | None) -> dict[str, str]:
    """Options from their text; none where a newer program wrote something else."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return {}
    return found if isinstance(found, dict) and all(isinstance(v, str) for v in found.values()) else {}


def remote_key(path: str) -> str:
    """The key of a relative path below a connection's root; a path that begins at a root or leaves it has none."""
    if path.startswith("/") or re.match(r"[A-Za-z]:", path):
        raise ValueError(f"{path!r} is not relative")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if ".." in parts:
        raise ValueError(f"{path!r} leaves the root")
    return "/".join(parts)
