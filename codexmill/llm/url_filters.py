"""URL filters: host and path rules, and link-graph propagation for everything else.

Rules decide the urls they fit. For the other urls the host decides: trust flows from
hosts that the allow rules favour along host edges, distrust flows from hosts that
the block rules hit along the reversed edges (who links to a bad host is suspect),
both as personalised PageRank, repeated until what is still to come can turn no host's
verdict. A host is blocked when its distrust outweighs its trust.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, on_hot

#: (verdict, host and path) of the rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING = 0.85
#: Rounds of a stretch, after which scores are written out and verdicts looked at.
STRETCH = 4
#: Scores are taken as equal within this share of them, and mass below it, of 1 in all, as nothing.
EQUAL = 1e-12
#: Edges that a task of a round takes in, about; there are no more tasks than the shuffle's width.
TASK_EDGES = 50_000
#: Blocked when distrust is over this multiple of trust.
RATIO = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, ties to the smaller text; null if none fits."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        at, _, under = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + under)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def links(pages: DataFrame) -> DataFrame:
    """Host edges (src, dst) with counts: hyperlinks to other hosts, and each host with the domain above it.

    Domains above a host are tied in both directions, since one owner speaks through
    both; a relative link stays on its host and makes no edge.
    """
    targets = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"""(?i)<a\s[^<>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""), 1)
    named = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).withColumn("dst", F.translate("dst", UPPER, LOWER))
    own = pages.select("host").distinct()
    above = own.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("dst"))
    tied = above.unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = named.unionByName(tied).filter((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != ""))
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def keyed(kind: Column, host: Column) -> Column:
    """Both kinds share one table and one key; t before a host is trust, d distrust."""
    return F.concat(F.when(kind == "trust", "t").otherwise("d"), host)


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING, ratio: float = RATIO) -> DataFrame:
    """(kind, host, score) of a personalised PageRank for each kind of seed.

    edges: kind, src, dst, w with the weights of each src summing to 1 at most. seeds:
    kind, host, share summing to 1 for each kind. Scores grow from nothing towards their
    limit: each round adds what has come one edge further, by one join (by merging:
    scores grow with the hosts, so none are broadcast) and one sum with map-side
    combining. After each stretch scores are written out, and rounds end when no verdict
    is open (``still_open``). A number of rounds is for comparisons alone.
    """
    e = edges.select(keyed(F.col("kind"), F.col("src")).alias("s"), keyed(F.col("kind"), F.col("dst")).alias("key"), (damping * F.col("w")).alias("w"))
    e = cut(e)
    # Each round is a shuffle of its own; one with as many files as partitions costs more than the few rows in them.
    tasks = max(1, math.ceil(e.count() / TASK_EDGES))
    base = cut(seeds.select(keyed(F.col("kind"), F.col("host")).alias("key"), ((1 - damping) * F.col("share")).alias("score")).coalesce(tasks))
    e = e.coalesce(tasks)
    written = base.withColumn("step", F.col("score"))
    k, settled, shrink = 1, False, {}
    while k != rounds and not settled:
        rank = written.select("key", "score")
        for _ in range(min(STRETCH, rounds - k) if rounds else STRETCH):
            k += 1
            moved = e.join(rank.select(F.col("key").alias("s"), "score").hint("merge"), "s").select("key", (F.col("w") * F.col("score")).alias("score"))
            rank = moved.unionByName(base).coalesce(tasks).groupBy("key").agg(F.sum("score").alias("score"))
        now = rank.select("key", "score", F.lit(0.0).alias("was"), F.lit(0.0).alias("before"))
        then = written.select("key", F.lit(0.0).alias("score"), F.col("score").alias("was"), F.col("step").alias("before"))
        both = now.unionByName(then).coalesce(tasks).groupBy("key").agg(F.sum("score").alias("score"), F.sum("was").alias("was"), F.sum("before").alias("before"))
        grown = F.col("score") - F.col("was")
        step = F.when(grown > EQUAL / 1000 * F.col("score"), grown).otherwise(0.0)  # less is rounding
        written = cut(both.select("key", "score", step.alias("step"), "before").coalesce(tasks))
        settled, shrink = (False, {}) if rounds else still_open(written, shrink, damping**STRETCH, ratio)
    return written.select(F.when(F.col("key").startswith("t"), "trust").otherwise("distrust").alias("kind"), F.expr("substring(key, 2)").alias("host"), "score")


def still_open(scores: DataFrame, shrink: dict[str, float], rate: float, ratio: float) -> tuple[bool, dict[str, float]]:
    """Whether all verdicts are settled, and by kind the factor by which steps shrink.

    scores: key, score, its last step and the step before (each over a stretch). What
    moves is a linear map of what moved before that knows no negative numbers; so if, for
    a kind, no host's step was over c times its step before, c < 1, none ever will be
    again: then a host gets c / (1 - c) times its last step at most, and a host without
    a step gets nothing. Until such a c is found (as long as hosts are reached for the
    first time there is none), any host, known or not, may get all that is still to
    come: rate / (1 - rate) times the kind's last steps in all, the 1-norm.

    A verdict is settled if what may come turns no sign; margins within EQUAL of the
    scores are ties, and rounds end at last when next to nothing moves.
    """
    kind = F.substring("key", 1, 1)
    growth = F.when(F.col("step") == 0, 0.0).when(F.col("before") == 0, float("inf")).otherwise(F.col("step") / F.col("before"))
    per_kind = {r["kind"]: r for r in scores.groupBy(kind.alias("kind")).agg(F.max(growth).alias("growth"), F.sum("step").alias("mass")).collect()}
    found = {k: min(r["growth"], shrink.get(k, float("inf"))) for k, r in per_kind.items()}
    mass = {k: r["mass"] * rate / (1 - rate) for k, r in per_kind.items()}
    known = {k: found[k] < 1 for k in per_kind}
    if all(m <= EQUAL for m in mass.values()):
        return True, found
    if not all(known[k] or mass[k] <= EQUAL for k in per_kind):  # hosts not reached yet are open
        return False, found
    more = F.lit(0.0)
    for k in per_kind:
        more = F.when(kind == k, F.least(F.lit(mass[k]), F.col("step") * (found[k] / (1 - found[k]) if known[k] else float("inf")))).otherwise(more)
    more = F.when(F.col("step") == 0, 0.0).otherwise(more)
    own = lambda k, c: F.coalesce(F.sum(F.when(kind == k, c)), F.lit(0.0))
    hosts = scores.groupBy(F.expr("substring(key, 2)").alias("host")).agg(own("t", F.col("score")).alias("t"), own("d", F.col("score")).alias("d"), own("t", more).alias("dt"), own("d", more).alias("dd"))
    margin, slack = F.col("d") - ratio * F.col("t"), EQUAL * (F.col("d") + ratio * F.col("t"))
    turns = F.when(margin > slack, margin - ratio * F.col("dt") <= slack).otherwise((margin + F.col("dd") > slack) & (F.col("dd") > slack))
    return hosts.filter(turns).isEmpty(), found


def host_scores(pages: DataFrame, rounds: int | None = None, damping: float = DAMPING, ratio: float = RATIO) -> DataFrame:
    """host, trust, distrust; pages: host, rule_verdict, html."""
    edges = links(pages)
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("_all")).withColumnsRenamed({"kind": "_kind", "src": "_src"})
    weighted = both.join(out, (F.col("kind") == F.col("_kind")) & (F.col("src") == F.col("_src"))).select("kind", "src", "dst", (F.col("n") / F.col("_all")).alias("w"))
    hits = pages.filter(F.col("rule_verdict").isNotNull() & (F.col("host") != "")).groupBy(F.when(F.col("rule_verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n"))
    total = hits.groupBy("kind").agg(F.sum("n").alias("_total")).withColumnRenamed("kind", "_kind")
    seeds = hits.join(total, F.col("kind") == F.col("_kind")).select("kind", "host", (F.col("n") / F.col("_total")).alias("share"))
    rank = propagate(weighted, seeds, rounds, damping, ratio)
    side = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(side("trust"), side("distrust"))


def blocked(trust: Column, distrust: Column, ratio: float) -> Column:
    return distrust - ratio * trust > EQUAL * (distrust + ratio * trust)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, ratio: float = RATIO, rounds: int | None = None) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, trust, distrust.

    * A null url or one without :// has empty host and path, fits no rule and, being
      unknown to the graph, is allowed.
    * Where no rule fits, the host is blocked if distrust > ratio * trust, by more than
      EQUAL of both; hosts that nothing reaches have both 0 and are allowed.
    * Repeated rows are judged alike, each on its own; null html has no links; an
      empty table gives no rows.
    """
    verdicts = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)])
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("rule_verdict", verdicts[F.col("rule")])
    per_host = rows.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("_n"))
    scores = host_scores(rows, rounds, ratio=ratio).withColumnRenamed("host", "_scored")
    summary = cut(per_host.join(scores, F.col("_host") == F.col("_scored"), "left").select("_host", "_n", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    judged = on_hot(rows.drop("html", "url"), "host", summary, "_host", "_n", summary.agg(F.sum("_n")).first()[0] or 0)
    trust, distrust = F.col("trust"), F.col("distrust")
    verdict = F.coalesce(F.col("rule_verdict"), F.when(blocked(trust, distrust, ratio), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


