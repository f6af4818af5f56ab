"""Personal data: patterns, and a character tagger that adds what they miss.

``base_spans`` finds e-mail addresses, IP addresses, card and phone numbers by
fixed patterns, in time linear in the text. The tagger (``tagger.py``), trained
on labelled texts, reads every character of the whole text and adds spans of
the same kinds in other forms, of any length; what it adds must still have the
digits or parts of its kind (``_plausible``) and must not lie inside a base span
or overlap one, unless it goes on from one of its kind without a blank. Base
spans always stay.

The tagger is fitted on the driver at its first use in a session, by a fixed
seed (about 15 seconds); ``fitted`` keeps its weights in a file for later ones.

* Null and empty texts have no spans. Positions count code points.
* Spans of different kinds may overlap; of equal ones a span is given once.
* Repeated rows get equal answers, an empty table none; only doc_id and text
  are read, whatever other columns are named.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import tagger
from stowage.llm.batches import map_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match that could begin within a run of digits could begin at the run's start as well.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Left to right by the signs @, since what precedes one is a run without it: no run is read twice."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str | None) -> list[Span]:
    """All spans of the patterns, by start, then kind."""
    if not text:
        return []
    out = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = "".join(_DIGITS.findall(m[0]))
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _plausible(kind: str, value: str) -> bool:
    """Whether a tagged value has what its kind needs."""
    digits = "".join(_DIGITS.findall(value))
    if kind == "email":
        return len(value) >= 6 and bool(re.search(r"[^\s@]\s?(@|[\[(]at[\])]|\bat\b)\s?[^\s@]+(\s?(\.|[\[(]dot[\])]|\bdot\b)\s?)[A-Za-z]{2,}", value))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(int(p) <= 255 for p in parts if len(p) < 4) and all(len(p) < 4 for p in parts) and not re.search(r"[A-Za-z]", value)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    # A phone number without its country's sign must at least be grouped.
    return 9 <= len(digits) <= 15 and len(re.findall(r"[0-9]+", value)) >= 3 and not re.search(r"[A-Za-z]", value)


def added_spans(text: str, base: list[Span], tagged: list[tuple[int, int, int]]) -> list[Span]:
    """What the tagger's spans add: trimmed, plausible, and not inside a base span."""
    out = []
    for k, a, b in tagged:
        while a < b and not (text[a].isalnum() or text[a] in "+(["):
            a += 1
        while a < b and not (text[b - 1].isalnum() or text[b - 1] in ")]"):
            b -= 1
        kind = KINDS[k]
        # Where a base span is only a part of it, the rest must go on without a blank.
        if _plausible(kind, text[a:b]) and not any(x < b and a < y and not (kind == own and a <= x and y <= b and b - a > y - x and not any(map(str.isspace, text[a:x] + text[y:b]))) for own, x, y in base):
            out.append((kind, a, b))
    return out


# Labelled texts to learn from


def examples(n: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Made-up lines with labelled personal data in many forms, and with numbers that are none."""
    rng = random.Random(seed)
    letters = "aeiounrstlhdcmpgbfvwkyzjxq"
    weights = [14 - k // 2 for k in range(len(letters))]

    def word(capital: bool = False) -> str:
        w = "".join(rng.choices(letters, weights, k=rng.randint(1, 11)))
        if rng.random() < 0.12:
            w = w.replace("e", rng.choice("éèüöñçó"), 1)
        return w.capitalize() if capital else w

    def number(k: int) -> str:
        return "".join(rng.choices("0123456789", k=k))

    def name() -> str:
        return rng.choice([word() + "." + word(), word() + number(2), word() + "_" + word(), word() + "." + number(2), word() + "-" + word() + number(1), word() + "+" + word()])

    def domain() -> str:
        return rng.choice([word() + number(1), word(), word() + "-" + word()]) + "." + rng.choice(["com", "org", "net", "example.com", "example.org", "co.uk", "de", "fr", "io"])

    def card() -> str:
        digits = number(rng.choice([13, 14, 15, 15, 15, 15, 17]))
        digits += next(str(c) for c in range(10) if luhn(digits + str(c)))
        sep = rng.choice(["", "", "", " ", "-"])
        return sep.join(digits[k : k + 4] for k in range(0, len(digits), 4))

    def personal() -> tuple[str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            a, b = name(), domain()
            return kind, rng.choice([f"{a}@{b}"] * 4 + [f"{a} @ {b}", f"{a} at {b.replace('.', ' dot ')}", f"{a} (at) {b}", f"{a}[at]{b.replace('.', '[dot]')}", f"{a}(at){b.replace('.', '(dot)')}"])
        if kind == "ip":
            p = [str(rng.randint(0, 255)) for _ in range(4)]
            return kind, rng.choice([".".join(p)] * 5 + [" . ".join(p), "[.]".join(p)])
        if kind == "card":
            return kind, card()
        a, b, c = number(3), number(3), number(4)
        return kind, rng.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) 555-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+44 {number(2)} {c} {number(4)}", f"+49 {a} {number(7)}", f"+33 {number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", f"0{number(2)} {c} {number(4)}", f"1-{a}-{b}-{c}"])

    def harmless() -> str:
        return rng.choice([
            str(rng.randint(1, 2030)), f"{rng.randint(0, 99)}.{number(2)}", f"{number(2)}:{number(2)}", f"{rng.randint(1900, 2030)}-{number(2)}-{number(2)}", f"${number(3)},{number(3)}", f"v{number(1)}.{number(1)}.{number(1)}", f'token = "{rng.randbytes(20).hex()}"', f"#{number(6)}", f"{number(3)}%", f"({number(2)})", f"{word()}/{word()}", f"{word()}.{word(True)}", f"{number(9)}", f"{number(5)}-{number(1)}", "| " + word() + " |", word().upper() + "!!", word() + rng.choice(["%%%", "***", "$$$", "&&&", "###"]), f"@ {word()}", "at " + word() + " dot", f"{number(1)} - {number(2)} ({number(2)})", f"ISBN 97{rng.choice('89')}-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"no. {number(4)}-{number(2)}-{number(3)}",
        ])

    out = []
    for _ in range(n):
        text, spans, style = "", [], rng.random()
        sep = " | " if style < 0.06 else " "
        while len(text) < rng.choice([60, 90, 90, 130]):
            x = rng.random()
            if x < 0.11:
                kind, value = personal()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            elif x < 0.2:
                text += harmless()
            else:
                w = word(rng.random() < 0.12)
                text += w.upper() + "!!" if style > 0.96 else w + rng.choice(["%%%", "***"]) if style > 0.93 else w
            text += rng.choices([sep, ", ", ". ", ".\n", "\n"], [40, 3, 3, 2, 1])[0]
        out.append((text, spans))
    return out


@cache
def default_model() -> tagger.Model:
    """The tagger that the queries use: trained once in a session, on made-up labelled texts only."""
    return tagger.train(examples(9600), KINDS)


def fitted(spark: SparkSession, path: str) -> tagger.Model:
    """The default model from a file that Spark's file systems reach; fitted and written there where it is missing."""
    if not _exists(spark, path):
        spark.createDataFrame([(default_model().saved(),)], "weights binary").coalesce(1).write.parquet(path)
    return tagger.Model.loaded(spark.read.schema("weights binary").parquet(path).first().weights)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def find(texts: list[str | None], model: tagger.Model) -> list[tuple[list[Span], list[Span]]]:
    """Of each text its base spans and all its spans."""
    out = []
    for text, tagged in zip(texts, model.decode([x or "" for x in texts]), strict=True):
        base = base_spans(text)
        out.append((base, ordered(base + added_spans(text, base, tagged)) if tagged else base))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, model: tagger.Model) -> DataFrame:
    """doc_id, the numbers of base spans by kind, base_sha256, spans of every row."""
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find(batch.column("text").to_pylist(), model)
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
        digests = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, pa.array([listed(every) for _, every in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema, remember=False)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with <KIND> in place of each span; overlapping spans become one, named by the first."""
    if not text or not spans:
        return text
    out, done, merged = [], 0, []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, model: tagger.Model) -> DataFrame:
    """The rows of ``docs`` with personal data replaced in ``text``, and ``n_chars``, if there is one, brought up to date."""
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        new = [redacted(x, every) for x, (_, every) in zip(texts, find(texts, model), strict=True)]
        columns = {n: batch.column(k) for k, n in enumerate(names)}
        columns["text"] = pa.array(new, batch.schema.field("text").type)
        if "n_chars" in columns:
            old = columns["n_chars"]
            lengths = [n if x == y else len(y) for n, x, y in zip(old.to_pylist(), texts, new, strict=True)]
            columns["n_chars"] = pa.array(lengths, old.type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names)

    return map_batches(docs, run, docs.schema, remember=False)
