"""URL filters: host and path rules, and link-graph propagation where no rule decides.

Hosts are linked by the absolute and protocol-relative addresses in their pages and by their
domain hierarchy (a host and the nearest enclosing host that has pages).  Trust is a
personalised PageRank from hosts with allowed pages along links; distrust starts from hosts with
blocked pages and runs against the links, to who links there.  Each host's share of distrust is
held against a threshold.  Pages are reduced to host sums and host pairs first, so a hot host is one
row; nothing is collected.

Defined results: a null url, or one without ``://``, has an empty host and path and takes the
method's verdict for the empty host (allow: it has no seeds); rules of equal length that fit are decided by the greater
rule text, then verdict; null html has no links; repeated rows
get equal results; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (host, path, verdict), as host + path with the path from its slash on.
DEFAULT_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINKED_HOST = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'>\s]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): empty where the url is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    fits = [
        F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def host_links(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts of ``hosts``; pages: (host, html)."""
    named = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINKED_HOST), F.lit(1)))).alias("dst"))
    named = named.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").count()
    known = hosts.select(F.col("host").alias("dst"))
    named = named.join(known, "dst", "left_semi").select("src", "dst", F.col("count").cast("double").alias("weight"))
    labels = F.split("host", r"\.")
    enclosing = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    nested = hosts.where(F.size(labels) > 1).select(F.col("host").alias("src"), F.posexplode(enclosing).alias("level", "dst"))
    nested = nested.join(known, "dst", "left_semi").groupBy("src").agg(F.min_by("dst", "level").alias("dst"))
    up = nested.select("src", "dst", F.lit(1.0).alias("weight"))
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return named.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(hosts: DataFrame, links: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-3, most_rounds: int = 500) -> DataFrame:
    """(host, trust, distrust) from seeds (host, good, bad: masses that sum to 1 each or are all 0).

    The series of what flows from the seeds is summed until a round carries less than ``tolerance`` of the mass.
    Mass that reaches a host without links onward returns to the seeds in proportion, so sums are scaled to 1.
    """
    out = links.groupBy("src").agg(F.sum("weight").alias("out"))
    into = links.groupBy("dst").agg(F.sum("weight").alias("into"))
    shares = links.join(out, "src").join(into, "dst")
    along = shares.select(F.col("src").alias("from"), F.col("dst").alias("to"), (damping * F.col("weight") / F.col("out")).alias("w_t"), F.lit(0.0).alias("w_d"))
    against = shares.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("w_t"), (damping * F.col("weight") / F.col("into")).alias("w_d"))
    steps = materialize(along.unionByName(against).groupBy("from", "to").agg(F.sum("w_t").alias("w_t"), F.sum("w_d").alias("w_d")))
    zero, names = F.lit(0.0), ["host", "trust", "distrust", "t", "d"]
    state = materialize(hosts.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"), F.col("good").alias("t"), F.col("bad").alias("d")))
    for _ in range(most_rounds):
        flow = state.where("t > 0 or d > 0").join(steps, F.col("host") == F.col("from")).select(F.col("to").alias("host"), zero.alias("trust"), zero.alias("distrust"), (F.col("t") * F.col("w_t")).alias("t"), (F.col("d") * F.col("w_d")).alias("d"))
        sums = flow.unionByName(state.withColumns({"t": zero, "d": zero})).groupBy("host").agg(*[F.sum(c).alias(c) for c in names[1:]])
        state = materialize(sums.select("host", (F.col("trust") + F.col("t")).alias("trust"), (F.col("distrust") + F.col("d")).alias("distrust"), "t", "d"))
        moved, trust, distrust = state.agg(F.coalesce(F.greatest(F.sum("t"), F.sum("d")), zero), F.coalesce(F.sum("trust"), zero), F.coalesce(F.sum("distrust"), zero)).first()
        if moved < tolerance:
            return state.select("host", (F.col("trust") / (trust or 1.0)).alias("trust"), (F.col("distrust") / (distrust or 1.0)).alias("distrust"))
    raise RuntimeError(f"trust did not settle in {most_rounds} rounds")


def filter_urls(pages: DataFrame, *, rules=DEFAULT_RULES, threshold: float = 0.5, damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """page_id, host, path, rule, verdict, distrust (the host's share, 0 to 1) of every page."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html"))
    rows = rows.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    hosts = rows.groupBy("host").agg(F.count_if(F.col("hit.verdict") == "allow").alias("good"), F.count_if(F.col("hit.verdict") == "block").alias("bad"))
    hosts = materialize(hosts)
    total = hosts.agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)).alias(a)
    seeds = materialize(hosts.crossJoin(F.broadcast(total)).select("host", share("good", "all_good"), share("bad", "all_bad")))  # one row of sums
    state = propagate(seeds, materialize(host_links(rows.select("host", "html"), seeds)), damping=damping, tolerance=tolerance)
    mass = F.col("trust") + F.col("distrust")
    judged = state.select(F.col("host").alias("h2"), F.round(F.when(mass > 0, F.col("distrust") / mass).otherwise(0.0), 9).alias("distrust"))
    out = rows.drop("html").join(materialize(judged), F.col("host") == F.col("h2"))
    own = F.when(F.col("distrust") > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", own).alias("verdict"), "distrust")
