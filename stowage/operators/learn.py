"""The layout that a tree already has, found from its paths, and what would suit it better."""

from __future__ import annotations

import re
from itertools import chain, count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.functions.grammar import wall
from stowage.plans import layouts

#: Shares and numbers from which suggestions are made.
AGREE, LOPSIDED, CROWDED, VERY_CROWDED, DATED, THIN, LEAVES, THIN_SHARE = (4, 5), 95, 150, 1000, 90, 2, 8, 75
#: Words for kinds of files, and the media class that each goes with.
KIND_WORDS = {"photo": "image", "photos": "image", "pictures": "image", "image": "image", "images": "image", "video": "video", "videos": "video", "movies": "video", "audio": "audio", "music": "audio", "text": "text", "documents": "text"}
#: Segments that can be years; other numbers are names, even if they are a file's own year.
YEARS = "^(19|20)[0-9]{2}$|^2100$"


def levels(inventory: DataFrame, years: str = YEARS, months_below: str = YEARS) -> DataFrame:
    """path, level, segment, guess for every directory above every file: year, month, ext, kind, size or name.

    ``years`` matches segments that can be years, ``months_below`` those below which months are looked for.
    """
    of_name = paths.name(F.col("path"))
    files = inventory.where(~of_name.startswith("."))
    rows = files.select("path", F.year(wall(F.col("mtime"))).alias("year"), F.month(wall(F.col("mtime"))).alias("month"), F.lower(paths.ext(of_name)).alias("ext"), F.split(F.col("mime"), "/")[0].alias("class"), F.posexplode(F.split(paths.parent(F.col("path")), "/")).alias("at", "segment"), F.split(paths.parent(F.col("path")), "/").alias("all"))
    rows = rows.where("segment <> ''")
    before = F.when(F.col("at") > 0, F.get(F.col("all"), F.col("at") - 1))
    word = F.element_at(F.create_map(*[F.lit(x) for k, v in KIND_WORDS.items() for x in (k, v)]), F.lower("segment"))
    guess = (
        F.when(F.col("segment").rlike(years) & (F.col("segment") == F.col("year").cast("string")), "year")
        .when(F.coalesce(before.rlike(months_below), F.lit(False)) & F.col("segment").rlike("^(0[1-9]|1[0-2])$") & (F.col("segment") == F.lpad(F.col("month").cast("string"), 2, "0")), "month")
        .when((F.lower("segment") == F.col("ext")) & (F.col("ext") != ""), "ext")
        .when(F.coalesce(word == F.col("class"), F.lit(False)), "kind")
        .when(F.lower("segment").rlike("^(under|over|from|up-to)-[0-9.]+ ?([kmgt]i?b?)?$"), "size")
        .otherwise("name")
    )
    return rows.select("path", (F.col("at") + 1).alias("level"), "segment", guess.alias("guess"))


def depth_mode(inventory: DataFrame) -> DataFrame:
    """One row: depth, files of the depth that most files have; of equals the deepest."""
    counts = inventory.where(~paths.name(F.col("path")).startswith(".")).groupBy(paths.depth(F.col("path")).alias("depth")).agg(F.count(F.lit(1)).alias("files"))
    return counts.agg(F.max(F.struct("files", "depth")).alias("m")).select("m.depth", "m.files")


def settled_levels(inventory: DataFrame, years: str = YEARS, months_below: str = YEARS) -> DataFrame:
    """level, meaning, agree, of: what each level means, if four in five of its files agree; else named. Years and months as for ``levels``."""
    tally = levels(inventory, years, months_below).groupBy("level", "guess").agg(F.count(F.lit(1)).alias("n"))
    best = tally.groupBy("level").agg(F.max(F.struct("n", "guess")).alias("best"), F.sum("n").alias("of"))
    wins = F.col("best.n") * AGREE[1] >= F.col("of") * AGREE[0]
    return best.select("level", F.when(wins & (F.col("best.guess") != "name"), F.col("best.guess")).otherwise("named").alias("meaning"), F.col("best.n").alias("agree"), "of")


def branches(inventory: DataFrame) -> DataFrame:
    """directory, files of each directory that holds files."""
    return inventory.where(~paths.name(F.col("path")).startswith(".")).groupBy(paths.parent(F.col("path")).alias("directory")).agg(F.count(F.lit(1)).alias("files"), F.count("mtime").alias("dated"))


def suggestions(inventory: DataFrame) -> DataFrame:
    """suggestion, place, count, of: what would make the tree easier to live in, with the numbers that say so."""
    leaves = branches(inventory)
    totals = leaves.agg(F.sum("files").alias("total"), F.count(F.lit(1)).alias("leaves"), F.count_if(F.col("files") <= THIN).alias("thin"), F.max(F.struct("files", "directory")).alias("top"))
    dated = F.col("dated") * 100 >= F.col("files") * DATED
    crowded = leaves.where((F.col("files") > CROWDED) & dated).select(F.when(F.col("files") > VERY_CROWDED, "split_by_month").otherwise("split_by_year").alias("suggestion"), F.col("directory").alias("place"), F.col("files").alias("count"), F.col("dated").alias("of"))
    lopsided = totals.where((F.col("top.files") * 100 >= F.col("total") * LOPSIDED) & (F.col("leaves") > 1)).select(F.lit("barely_sorts").alias("suggestion"), F.col("top.directory").alias("place"), F.col("top.files").alias("count"), F.col("total").alias("of"))
    thin = totals.where((F.col("leaves") >= LEAVES) & (F.col("thin") * 100 >= F.col("leaves") * THIN_SHARE)).select(F.lit("drop_level").alias("suggestion"), F.lit("").alias("place"), F.col("thin").alias("count"), F.col("leaves").alias("of"))
    return crowded.unionByName(lopsided).unionByName(thin)


def at_usual_depth(inventory: DataFrame) -> DataFrame:
    """The files below directories that are as deep as most of these are; of equals the deepest."""
    files = inventory.where(~paths.name(F.col("path")).startswith(".") & (paths.parent(F.col("path")) != ""))
    depths = files.groupBy(paths.depth(F.col("path")).alias("depth")).agg(F.count(F.lit(1)).alias("files"))
    usual = depths.agg(F.max(F.struct("files", "depth")).alias("m")).select(F.col("m.depth").alias("_depth"))
    return files.join(F.broadcast(usual), paths.depth(F.col("path")) == F.col("_depth")).drop("_depth")


def named_branches(inventory: DataFrame, meanings: list[str]) -> DataFrame:
    """branch of every combination of names that occurs: an array with the segments of levels that are names or kinds, null for others."""
    of = F.split(paths.parent(F.col("path")), "/")
    kept = [F.get(of, F.lit(k)) if m in ("named", "kind") else F.lit(None).cast("string") for k, m in enumerate(meanings)]
    return inventory.select(F.array(*kept).alias("branch")).distinct()


#: How a level is written in a rule's path, where it isn't by the segment itself.
WRITTEN = {"year": "{date:%Y}", "month": "{date:%m}", "ext": "{ext}", "size": "{band}"}


def learn(inventory: DataFrame, most_branches: int = 1000) -> str:
    """The text of a policy that keeps the tree as it is: a rule for each branch of names.

    Names can't be told from files, so they are matched on where files are; all
    else is read off the files. A policy is a document for people: a tree with
    more branches than ``most_branches`` raises ValueError rather than lose some.
    """
    deep = at_usual_depth(inventory)
    meanings = [r.meaning for r in settled_levels(deep).orderBy("level").collect()]  # as many as a path has levels
    branches_ = [r.branch for r in named_branches(deep, meanings).limit(most_branches + 1).collect()] if meanings else []
    if len(branches_) > most_branches:
        raise ValueError(f"the tree has more than {most_branches} branches")
    rules, used = [], set()
    for branch in sorted(branches_, key=lambda b: [x or "" for x in b]):
        names = [x for x, m in zip(branch, meanings, strict=True) if m == "named"]
        kind = next((KIND_WORDS.get(x.lower()) for x, m in zip(branch, meanings, strict=True) if m == "kind"), None)
        match = {"mime": f"{kind}/*"} if kind else {}
        if names:
            # Loose below its names, or where it is by all of its levels.
            match["glob"] = list(dict.fromkeys(("/".join(names) + "/*", "/".join([x or "*" for x in branch] + ["*"]))))
        word = re.sub("[^a-z0-9]+", "-", "-".join(x for x in branch if x).lower()).strip("-") or "everything"
        name = next(n for n in chain([word], (f"{word}-{k}" for k in count(2))) if n not in used)
        used.add(name)
        variables = ({"date": {"from": layouts.TAKEN}} if {"year", "month"} & set(meanings) else {}) | ({"band": {"from": "size", "bucket": layouts.BANDS}} if "size" in meanings else {})
        path = "/".join(WRITTEN.get(m) or x for x, m in zip(branch, meanings, strict=True))
        rules.append({"name": name, "path": path, "match": match or {"glob": ["**"]}} | ({"vars": variables} if variables else {}))
    return layouts.written({"name": "learned", "ignore": layouts.DOWNLOADING}, layouts.RENAMING, rules)
