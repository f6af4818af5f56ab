"""Seven layouts to start from, as policies."""

from __future__ import annotations

import json

#: Names that apps give their files, kinds by extension, sizes and names that no layout touches.
APPS = {
    "whatsapp": ("WhatsApp", r"-WA[0-9]+\."),
    "telegram": ("Telegram", r"^(photo|video)_[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    "screenshots": ("Screenshots", r"^(Screenshot|Screen Shot|Bildschirmfoto)[ _-]"),
    "camera": ("Camera", r"^(IMG|DSC|DSCN|DJI|GOPR|PXL)[-_]?[0-9]+"),
}
WRITING = ["doc", "docx", "odt", "rtf", "txt", "md", "pages"]
SHEETS = ["xls", "xlsx", "csv", "ods", "numbers"]
ARCHIVES = ["zip", "tar", "gz", "bz2", "7z", "rar", "dmg", "pkg"]
INSTALLERS = ["exe", "msi", "deb", "rpm", "appimage"]
BANDS = ["<100MB", "100MB-500MB", "500MB-1GB", ">1GB"]
PASSING = [".DS_Store", "Thumbs.db", "*.part"]
DOWNLOADING = [*PASSING, "*.crdownload"]
TAKEN = ["exif.DateTimeOriginal", "mtime"]


def _value(x) -> str:
    if isinstance(x, dict):
        return "{ " + ", ".join(f"{k} = {_value(v)}" for k, v in x.items()) + " }"
    return json.dumps(x, ensure_ascii=False)


def written(folder: dict, defaults: dict, rules: list[dict]) -> str:
    """The TOML of a policy; a rule's variables are under ``vars``."""
    lines = ["[folder]", *(f"{k} = {_value(v)}" for k, v in folder.items())]
    if defaults:
        lines += ["", "[defaults]", *(f"{k} = {_value(v)}" for k, v in defaults.items())]
    for rule in rules:
        lines += ["", "[[rule]]", *(f"{k} = {_value(v)}" for k, v in rule.items() if k != "vars")]
        lines += [f"vars.{k} = {_value(v)}" for k, v in rule.get("vars", {}).items()]
    return "\n".join(lines) + "\n"


def _rule(name: str, path: str, match: dict, date=None, band: bool = False) -> dict:
    out = {"name": name, "path": path, "match": match}
    variables = ({"date": {"from": date}} if date else {}) | ({"band": {"from": "size", "bucket": BANDS}} if band else {})
    return out | ({"vars": variables} if variables else {})


def _downloads() -> list[dict]:
    media = [_rule(n, place, {"mime": f"{kind}/*"}) for n, place, kind in (("images", "Images", "image"), ("video", "Video", "video"), ("audio", "Audio", "audio"))]
    by_ext = [("documents", ["pdf", *WRITING]), ("spreadsheets", SHEETS), ("archives", ARCHIVES), ("installers", INSTALLERS)]
    return media + [_rule(n, n.capitalize(), {"ext": exts}) for n, exts in by_ext]


def _media() -> list[dict]:
    shape = "{{date:%Y}}/{}/{}/{{ext}}/{{band}}"
    out = []
    for app, (place, pattern) in APPS.items():
        for word, kind, start in (("photos", "image", "photo"), ("video", "video", "video")):
            if app == "screenshots":  # a picture without a camera's date, whatever it is of
                if kind == "image":
                    out.append(_rule(app, shape.format(place, "Photo"), {"mime": "image/*", "regex": pattern}, "mtime", True))
                continue
            # Whatever no app has named is taken for a camera's.
            match = {"mime": f"{kind}/*"} | ({"regex": pattern.replace("(photo|video)", start)} if app != "camera" else {})
            out.append(_rule(f"{app}-{word}", shape.format(place, start.capitalize()), match, TAKEN, True))
    return out


RENAMING = {"cooldown": "30s", "on_conflict": "rename"}
#: Folder, defaults and rules of each layout by its name.
LAYOUTS = {
    "downloads": ({"inbox": "Other", "ignore": [*DOWNLOADING, "*.download"], "opaque": ["*.app"]}, RENAMING, _downloads()),
    "photos": (
        {"ignore": DOWNLOADING, "opaque": ["*.photoslibrary", "*.app"]}, {"cooldown": "30s", "on_conflict": "quarantine"},
        [_rule("photos", "{date:%Y}/{date:%m}", {"mime": "image/*"}, TAKEN), _rule("videos", "Videos/{date:%Y}", {"mime": "video/*"}, "mtime")],
    ),
    "documents": (
        {"inbox": "Unsorted", "ignore": PASSING}, RENAMING,
        [_rule(n, place + "/{date:%Y}", {"ext": exts}, "mtime") for n, place, exts in (("pdfs", "PDF", "pdf"), ("writing", "Writing", WRITING), ("sheets", "Sheets", SHEETS))],
    ),
    "media": ({"ignore": [*DOWNLOADING, "*.download"], "opaque": ["*.photoslibrary", "*.app"]}, RENAMING, _media()),
    "by-date": ({"ignore": DOWNLOADING}, RENAMING, [_rule("everything", "{date:%Y}/{date:%m}", {"glob": ["**"]}, TAKEN)]),
    "by-source": ({"ignore": DOWNLOADING}, RENAMING, [_rule(n, place, {"regex": pattern}) for n, (place, pattern) in APPS.items()]),
    "by-type": ({"inbox": "No extension", "ignore": PASSING}, {}, [_rule("by-extension", "{ext|upper}", {"regex": r"\."})]),
}


def names() -> list[str]:
    return list(LAYOUTS)


def layout(name: str) -> str:
    """The text of a layout's policy."""
    if name not in LAYOUTS:
        raise KeyError(f"{name!r} is none of {', '.join(LAYOUTS)}")
    folder, defaults, rules = LAYOUTS[name]
    return written({"name": name} | folder, defaults, rules)
