"""URL filters (operator 6): rules, and for the rest trust and distrust
propagated over the host graph.

DataFrame functions only. Host edges are counted links: every absolute ``href``
of a page to another host, and one link each way between a host and its parent
domain (the host without its first label), so that a site's subdomains hang
together. Seeds are weighted by pages: a host's allowed pages make it trusted,
its blocked pages blocked. Trust is a personalised PageRank from the trusted
hosts along the links; distrust the same from the blocked hosts along the
reversed links, for a host that links to bad hosts is itself suspect. A host is
blocked if its distrust is more than ``THRESHOLD`` of both together; hosts that
neither reaches are allowed. Mass of hosts without links is not passed on. The
rounds go on until trust and distrust together change by less than
``TOLERANCE`` (each has a mass of 1) and reach no further host.

Every step groups sums (partial before the shuffle) and joins written tables,
so AQE can split the rows of a hot host. Defined cases: null urls and urls
without ``://`` have empty host and path, fit no rule and are allowed; null html
has no links; repeated rows count repeatedly and are judged each; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The rules of the contract, (verdict, host and path).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.5
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null: none fits)."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, tail = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, html, host, path, rule, verdict (null without a rule)."""
    p = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return p.withColumn("rule", rule).withColumn("verdict", verdict)


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts."""
    links = pages.where("html is not null and host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    up = hosts.where(F.size(F.split("host", r"\.")) > 2).select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst"))
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.unionByName(both).where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust when settled; ``seeds``: host, good, bad (each summing to 1, or 0)."""
    out = edges.groupBy("src").agg(F.sum("n").alias("n_out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("n_in"))
    walk = edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("n_out")).alias("p"), (F.col("n") / F.col("n_in")).alias("q"))
    # one row per direction: mass moves from ``at`` to ``to``, trust by p or distrust by q
    zero = F.lit(0.0)
    moves = materialize(
        walk.select(F.col("src").alias("at"), F.col("dst").alias("to"), "p", zero.alias("q"))
        .unionByName(walk.select(F.col("dst").alias("at"), F.col("src").alias("to"), zero.alias("p"), "q"))
    )
    seeds = materialize(seeds)
    back = seeds.select("host", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust"), zero.alias("t0"), zero.alias("d0"))
    now = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    sums = [F.sum(c).alias(c) for c in ("trust", "distrust", "t0", "d0")]
    while True:
        moved = moves.join(now, moves["at"] == now["host"]).select(
            F.col("to").alias("host"), (F.col("trust") * F.col("p") * damping).alias("trust"), (F.col("distrust") * F.col("q") * damping).alias("distrust"),
            zero.alias("t0"), zero.alias("d0"))
        before = now.select("host", zero.alias("trust"), zero.alias("distrust"), F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        step = materialize(moved.unionByName(back).unionByName(before).groupBy("host").agg(*sums))
        reached = ((F.col("trust") > 0) & (F.col("t0") == 0)) | ((F.col("distrust") > 0) & (F.col("d0") == 0))
        change, new = step.agg(F.sum(F.abs(F.col("trust") - F.col("t0")) + F.abs(F.col("distrust") - F.col("d0"))), F.sum(reached.cast("long"))).first()
        now = step.select("host", "trust", "distrust")
        if (change or 0.0) < tolerance and not new:
            return now


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of ``pages`` (page_id, url, html)."""
    seen = judged(pages, rules)
    good, bad = (F.sum((F.col("verdict") == v).cast("long")) for v in ("allow", "block"))
    hosts = materialize(seen.groupBy("host").agg(F.coalesce(good, F.lit(0)).alias("good"), F.coalesce(bad, F.lit(0)).alias("bad")))
    total = hosts.agg(F.sum("good"), F.sum("bad")).first()
    g, b = (float(x or 0) or 1.0 for x in total)
    seeds = hosts.where("host <> ''").select("host", (F.col("good") / g).alias("good"), (F.col("bad") / b).alias("bad"))
    ranks = propagate(materialize(host_edges(seen, hosts.where("host <> ''"))), seeds)
    ranks = ranks.withColumnRenamed("host", "_host")
    out = seen.drop("html").join(ranks, seen["host"] == ranks["_host"], "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(distrust > threshold * (trust + distrust), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Contract query: one row per page."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def brute_force(pages, rules=RULES, tolerance: float = 1e-12, damping: float = DAMPING, threshold: float = THRESHOLD) -> dict:
    """Direct form for tests: page_id -> (host, path, rule, verdict)."""
    import re
    from collections import Counter, defaultdict

    seen, edges, good, bad = {}, Counter(), Counter(), Counter()
    low = str.maketrans(_UPPER, _LOWER)
    for page_id, url, html in pages:
        host, path = "", ""
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = host.translate(low)
        fits = [(len(r), r, v) for v, r in rules
                if (host + "/").endswith(("." + r.split("/")[0] + "/")) or host == r.split("/")[0] if path.startswith("/" + r.split("/", 1)[1])]
        _, rule, verdict = max(fits, default=(0, None, None))
        seen[page_id] = (host, path, rule, verdict)
        if host:
            good[host] += verdict == "allow"
            bad[host] += verdict == "block"
            for dst in re.findall(_HREF, html or ""):
                if dst.translate(low) != host:
                    edges[host, dst.translate(low)] += 1
    for host in good:
        if host.count(".") > 1:
            up = host.split(".", 1)[1]
            for e in ((host, up), (up, host)):
                if "" not in e:
                    edges[e] += 1
    n_out, n_in = Counter(), Counter()
    for (a, b), n in edges.items():
        n_out[a] += n
        n_in[b] += n
    g, b_ = sum(good.values()) or 1, sum(bad.values()) or 1
    trust, distrust = {h: n / g for h, n in good.items()}, {h: n / b_ for h, n in bad.items()}
    while True:
        t, d = defaultdict(float), defaultdict(float)
        for h in good:
            t[h] += (1 - damping) * good[h] / g
            d[h] += (1 - damping) * bad[h] / b_
        for (a, b), n in edges.items():
            t[b] += damping * trust.get(a, 0) * n / n_out[a]
            d[a] += damping * distrust.get(b, 0) * n / n_in[b]
        pairs = [(old.get(h, 0), x) for old, new in ((trust, t), (distrust, d)) for h, x in new.items()]
        trust, distrust = t, d
        if sum(abs(x - o) for o, x in pairs) < tolerance and not any(x and not o for o, x in pairs):
            break

    def method(h):
        t, d = trust.get(h, 0), distrust.get(h, 0)
        return "block" if d > threshold * (t + d) else "allow"

    return {p: (h, path, r, v or method(h)) for p, (h, path, r, v) in seen.items()}
