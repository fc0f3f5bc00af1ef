"""URL filters: a tree of path templates for each host, and verdicts from rules and from labelled pages.

*Grow.* A place of the tree is a host and the start of a template. A path segment that is a number becomes `*`. Where at
least `KINDS` different segments follow at one place, alike in whether anything lies below them, they become `*` too,
except those whose labels set them apart from the others. Page rows, repeated pages and the number of pages below a
segment decide nothing, so a site that grows keeps its templates. Segments that all paths of a place share are passed
in one round, and a place with fewer than `KINDS` paths cannot vary any more, so the rounds follow the branching of
the tree and not the length of paths; there is no deepest level.
*Merge.* Templates of a host that differ in one fixed segment, whichever, are siblings. A template joins the siblings
at the segment where most labels meet, of those where its labels do not set it apart. One without labels stays by
itself, so that its host alone speaks for it.
*Apart* is a likelihood-ratio test of good and bad labels against those of the others, at `DOUBT` over the number of
siblings, so that many siblings do not make chance findings.
*Judge.* A template's purity is its share of good labels, smoothed by that of its host, which is smoothed by that of
the whole table. Templates below `PURE` are rejected.

Counts are kept by different path, then by template, so a host with very many pages is only ever summed up.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import Workspace, worked_out

KINDS = 10  # a place with fewer different segments keeps them
PURE = 0.5
WEIGHT = 4.0  # labels that the smoothing counts for
DOUBT = 0.05  # chance that any of a place's segments is set apart by accident
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty if it is null or has no `://`."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(rules: Iterable[tuple[str, str]] = RULES, host: str = "host", path: str = "path") -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else nulls; of equally long ones the first in text order.

    A rule is a host and the start of a path; it fits the host and all its subdomains.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):  # later ones win
        name, slash, start = rule.partition("/")
        fits = ((F.col(host) == name) | F.endswith(F.col(host), F.lit("." + name))) & F.startswith(F.col(path), F.lit(slash + start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def masked(path: str = "path") -> Column:
    """The segments after a path's first slash, numbers as `*`; without a slash none."""
    parts = F.split(F.col(path), "/")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.when(p.rlike(r"^[0-9]+([._-].*)?$"), F.lit("*")).otherwise(p))


def _joined(parts: Column, first: Column, count: Column) -> Column:
    """`/a/b` of `count` segments from the 0-based `first`."""
    return F.array_join(F.transform(F.slice(parts, first + 1, F.greatest(count, F.lit(0))), lambda p: F.concat(F.lit("/"), p)), "")


def _set_apart(good: Column, bad: Column, all_good: Column, all_bad: Column, siblings: Column) -> Column:
    """Whether (good, bad) differ from the rest of (all_good, all_bad): twice the log likelihood ratio against its bound."""
    def part(seen: Column, of: Column, share: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (of * share))).otherwise(F.lit(0.0))

    own, total = good + bad, all_good + all_bad
    rest = total - own
    ratio = part(good, own, all_good / total) + part(bad, own, all_bad / total) \
        + part(all_good - good, rest, all_good / total) + part(all_bad - bad, rest, all_bad / total)
    return F.when((own > 0) & (rest > 0), ratio > F.log(siblings / F.lit(DOUBT))).otherwise(F.lit(False))


def templates(work: Workspace, paths: DataFrame) -> DataFrame:
    """paths (host, parts, good, bad), one row for each host and parts, with the template of each."""
    active = paths.withColumns({"template": F.lit(""), "at": F.lit(0)})
    done: list[DataFrame] = []
    place = ["host", "template"]
    size = F.size("parts")
    while True:
        # Where few paths are left no place below can vary: the rest is taken as it is.
        left = F.concat(_joined(F.col("parts"), F.col("at"), size - F.col("at")), F.lit("/"))
        places = active.groupBy(*place).agg(F.count(F.lit(1)).alias("paths"), F.min(left).alias("low"), F.max(left).alias("high"))
        low, high = F.split("low", "/"), F.split("high", "/")
        differ = F.array_position(F.transform(F.arrays_zip(low.alias("a"), high.alias("b")), lambda z: z["a"].eqNullSafe(z["b"])), False)
        # Both begin with an empty text and end with one, which are no segments.
        shared = F.when(F.col("low") == F.col("high"), F.size(low) - 2).otherwise(F.least(differ.cast("int") - 2, F.size(low) - 2))
        here = active.join(places.withColumn("shared", F.greatest(shared, F.lit(0))).drop("low", "high"), place)
        few = F.col("paths") < KINDS
        taken = F.when(few, size - F.col("at")).otherwise(F.col("shared"))
        here = work.keep(here.withColumns({"template": F.concat("template", _joined(F.col("parts"), F.col("at"), taken)), "at": F.col("at") + taken})
                         .drop("paths", "shared"), "place")
        ended = F.col("at") >= size
        done.append(here.where(ended).drop("at"))
        here = here.where(~ended).withColumns({"part": F.get("parts", F.col("at")), "inner": size > F.col("at") + 1})
        if here.isEmpty():
            return reduce(DataFrame.unionByName, done)
        children = here.groupBy(*place, "part").agg(F.max("inner").alias("inner"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        kinds = children.where("part <> '*'")
        sums = kinds.groupBy(*place, "inner").agg(F.count(F.lit(1)).alias("kinds"), F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
        alone = _set_apart(*[F.col(c) for c in ("good", "bad", "all_good", "all_bad", "kinds")])
        varying = kinds.join(sums.where(F.col("kinds") >= KINDS), [*place, "inner"]).where(~alone).select(*place, "part", F.lit("*").alias("shown"))
        active = work.keep(here.join(varying, [*place, "part"], "left").select(
            "host", "parts", "good", "bad", F.concat("template", F.lit("/"), F.coalesce("shown", "part")).alias("template"),
            (F.col("at") + 1).alias("at")), "level")


def _families(template: str) -> Column:
    """For each fixed segment of a template, its place and two hashes of the template without it.

    A template's hash is the exclusive or of its segments' hashes, so one pass gives all.
    """
    parts = F.split(template, "/")

    def code(salt: int) -> Column:
        return F.transform(parts, lambda p, i: F.xxhash64(F.lit(salt), i, p))

    def without(salt: int, i: Column) -> Column:
        whole = F.aggregate(code(salt), F.size(parts).cast("long"), lambda x, h: x.bitwiseXOR(h))
        return whole.bitwiseXOR(F.xxhash64(F.lit(salt), i, F.get(parts, i)))

    fixed = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: (i > 0) & (F.get(parts, i) != "*"))
    return F.transform(fixed, lambda i: F.struct(i.alias("i"), without(1, i).alias("a"), without(2, i).alias("b")))


def judged(counted: DataFrame, overall: float) -> DataFrame:
    """Templates (host, template, good, bad) with group (merged siblings), purity and rejected."""
    own = F.col("good") + F.col("bad")
    family = ["host", "family"]
    places = counted.where(own > 0).select("host", "template", "good", "bad", F.explode(_families("template")).alias("family"))
    sums = places.groupBy(*family).agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.count(F.lit(1)).alias("siblings")).where("siblings > 1")
    alone = _set_apart(*[F.col(c) for c in ("good", "bad", "all_good", "all_bad", "siblings")])
    chosen = places.join(sums, family).where(~alone).groupBy("host", "template").agg(
        F.max_by("family", F.struct(F.col("all_good") + F.col("all_bad"), -F.col("family.i"))).alias("family"))
    host = counted.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("bad").alias("hb"))
    # A template without labels is like no other by any evidence: it is judged by its host alone.
    rows = counted.join(chosen, ["host", "template"], "left").withColumn(
        "group", F.when(F.col("family").isNull(), F.col("template")).otherwise(F.concat_ws(":", "family.i", "family.a", "family.b")))
    merged = rows.groupBy("host", "group").agg(F.sum("good").alias("gg"), F.sum("bad").alias("gb"))
    site = (F.col("hg") + WEIGHT * overall) / (F.col("hg") + F.col("hb") + WEIGHT)
    purity = (F.col("gg") + WEIGHT * site) / (F.col("gg") + F.col("gb") + WEIGHT)
    return rows.join(host, "host").join(merged, ["host", "group"]).withColumn("purity", purity).select(
        "host", "template", "group", "purity", (F.col("purity") < PURE).alias("rejected"))


def filtered(pages: DataFrame, labels: DataFrame, rules: Iterable[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url",
             label_key: str = "page_id", good: str = "good") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page.

    labels holds whether a page is good; each different label of a page counts once, null ones and null ids do not. The
    verdict is the longest fitting rule's, else block if the page's template is rejected, else allow. A url that is
    null or has no `://` has an empty host and path. Repeated rows and null ids give their own rows; other columns
    are not read; without labels everything is as pure as not known (1), and an empty table gives an empty result.
    """
    spark = pages.sparkSession

    def build(work: Workspace) -> DataFrame:
        host, path = host_and_path(url)
        parsed = work.keep(pages.select(F.col(key).cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("parts", masked()), "parsed")
        is_good = F.col(good).cast("int")
        marks = labels.where(F.col(good).isNotNull() & F.col(label_key).isNotNull()).select(
            F.col(label_key).cast("long").alias("page_id"), is_good.alias("good"), (1 - is_good).alias("bad")).distinct()
        place = ["host", "parts"]
        known = parsed.join(marks, "page_id").select("page_id", *place, "good", "bad").distinct().drop("page_id")
        every = parsed.select(*place, F.lit(0).alias("good"), F.lit(0).alias("bad")).unionByName(known)
        paths = work.keep(every.groupBy(*place).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "paths")
        grown = work.keep(templates(work, paths), "templates")
        sums = grown.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        total = sums.agg(F.sum("good"), F.sum("bad")).first()
        labelled = (total[0] or 0) + (total[1] or 0)
        verdicts = judged(sums, (total[0] / labelled) if labelled else 1.0)
        found = work.keep(grown.select(*place, "template").join(verdicts, ["host", "template"]), "verdicts")
        rows = parsed.withColumn("r", ruled(rules)).join(found, place)
        verdict = F.coalesce("r.verdict", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
        return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
    return worked_out(spark, "urls", build)


def document_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good) of pages whose path holds the number of a labelled document: good quality and not toxic."""
    host, path = host_and_path("url")
    named = pages.select("page_id", F.regexp_extract(path, r"/([0-9]{1,18})(?:[/.]|$)", 1).alias("number")).where("number <> ''")
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    return named.withColumn("doc_id", F.col("number").cast("long")).join(labels.select("doc_id", good.alias("good")), "doc_id").select("page_id", "good")
