"""URL filter by propagation over the graph of hosts (operator 8).

Nodes are the hosts of pages and of the absolute links in them. Edges:

- from the host of a page to each other host that it links to, weighted by links;
- between a host and its site, the host without a leading www., m. or blog.: one link each way, as one owner runs both.

Trust is personalised PageRank from the trusted seeds along edges; distrust is the same from the blocked seeds along reversed
edges, so that whoever links to a blocked host is held to account. Both walk, restarting with probability 1 - DAMPING, until a
round changes the values of each by no more than TOLERANCE in all. Where a host has no edge to follow the walk ends; that
scales all values alike, and they are scaled to sum to 1.

Seeds are a table (host, blocked) where one is given, else the hosts that two patterns match; a host that is both is blocked.

A host goes if it is a blocked seed, or if its distrust is above its trust and at least MAX_DISTRUST times the mean.

A round is one join and one partial aggregation of hosts, both directions at once; every FEW rounds the values are written to
the shared folder, where the change is read off. A row from each host to itself carries its restart and its last values along.
Once, after JUMP rounds, power extrapolation (Haveliwala, Kamvar and others, 2003) takes out what decays as +-DAMPING: a pair of
hosts that link to each other alone swings so. The rounds after it end at the same values, only sooner.
Page text is read once, and only host pairs, counted within each task first, leave that scan.

Cases: a page whose URL is null or has no host has null host and values and is kept; null or empty html has no links; ports,
users and case do not distinguish hosts; links within a host are no edges; without seeds of a kind its values are 0; repeated
pages count their links each and are judged each; very long pages are read whole; equal trust and distrust keep a host; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morsel.llm.common import Scratch

DAMPING, TOLERANCE, FEW, JUMP, MAX_DISTRUST = 0.85, 1e-9, 4, 8, 0.5
#: Seeds, as patterns of hosts, for those who have no table of them.
TRUSTED = r"(^|\.)[a-z0-9-]+\.(edu|gov|org)$"
BLOCKED = r"(^|[.-])(casino|poker|bets?|betting|pills|viagra|adserver|ads|porn|xxx|warez)([.-]|$)"
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([A-Za-z0-9._-]+)"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""
SITE = r"^(?:www|m|blog)\.(?=[^.]+\.)"


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight) of the links between hosts; src null: a host (dst) that has a page."""
    p = pages.select(host_of(pages[url_col].cast("string")).alias("src"), pages[html_col].cast("string").alias("html")).filter("src is not null")
    # each page gives its own host once, as a node
    ends = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), host_of))
    x = p.select("src", F.posexplode(ends).alias("at", "dst")).filter("at = 0 or dst <> src")
    return x.select(F.when(F.col("at") > 0, F.col("src")).alias("src"), F.when(F.col("at") > 0, F.col("dst")).otherwise(F.col("src")).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def steps(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hosts, and (kind, src, dst, share): kind 0 forwards, 1 backwards; shares of a src sum to 1."""
    hosts = edges.select(F.col("dst").alias("host")).unionByName(edges.filter("src is not null").select(F.col("src").alias("host"))).distinct()
    site = hosts.select("host", F.regexp_replace("host", SITE, "").alias("site")).filter("host <> site")
    hosts = scratch.write(hosts.unionByName(site.select(F.col("site").alias("host"))).distinct(), "all_hosts")
    both = edges.filter("src is not null").unionByName(site.select(F.col("host").alias("src"), F.col("site").alias("dst"), F.lit(1).cast("long").alias("weight"))).unionByName(site.select(F.col("site").alias("src"), F.col("host").alias("dst"), F.lit(1).cast("long").alias("weight")))
    both = both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    ways = both.select(F.lit(0).alias("kind"), "src", "dst", "weight").unionByName(both.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    total = ways.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    return hosts, scratch.write(ways.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "steps")


def seeds_of(hosts: DataFrame, seeds: DataFrame | None, trusted: str, blocked: str) -> DataFrame:
    """(host, kind): the hosts that are seeds, kind 0 trusted, 1 blocked."""
    if seeds is None:
        x = hosts.select("host", F.col("host").rlike(blocked).alias("bad"), F.col("host").rlike(trusted).alias("good")).filter("good or bad")
        return x.select("host", F.col("bad").cast("int").alias("kind"))
    named = seeds.select(F.lower(F.col("host").cast("string")).alias("host"), F.coalesce(F.col("blocked").cast("boolean"), F.lit(False)).alias("bad")).groupBy("host").agg(F.max("bad").cast("int").alias("kind"))
    return hosts.join(named, "host")


def propagate(scratch: Scratch, hosts: DataFrame, ways: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(kind, host, value) of hosts that a walk reaches; the values of a kind sum to 1."""
    n = seeds.groupBy("kind").agg(F.count("*").alias("n"))
    start = scratch.write(seeds.join(F.broadcast(n), "kind").select("kind", "host", (F.lit(1.0) / F.col("n")).alias("value")), "seeds")
    kinds = hosts.select("host", F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"))
    own = kinds.join(start, ["kind", "host"], "left").select("kind", F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(0.0).alias("share"), (F.coalesce("value", F.lit(0.0)) * (1 - damping)).alias("restart"), F.lit(True).alias("own"))
    ways = scratch.write(ways.select("kind", "src", "dst", "share", F.lit(0.0).alias("restart"), F.lit(False).alias("own")).unionByName(own), "ways")
    # seeds are reached from the start, so every round meets their restarts
    rank = start.select("kind", F.col("host").alias("src"), "value", F.lit(0.0).alias("last"), F.lit(0.0).alias("older"))
    k = 0
    while True:
        k += 1
        carry = lambda c: F.sum(F.when(F.col("own"), F.col(c)).otherwise(0.0))
        step = F.sum(F.col("value") * F.col("share") * damping + F.col("restart"))
        rank = ways.join(rank, ["kind", "src"]).groupBy("kind", "dst").agg(step.alias("next"), carry("value").alias("last"), carry("last").alias("older")).select("kind", F.col("dst").alias("src"), F.col("next").alias("value"), "last", "older")
        if k % FEW:
            continue
        rank = scratch.write(rank, f"rank{k}")
        if k > FEW:
            scratch.drop(f"rank{k - FEW}")
        change = rank.groupBy("kind").agg(F.sum(F.abs(F.col("value") - F.col("last"))).alias("change")).agg(F.max("change")).first()[0]
        if change is None or change <= tolerance:
            break
        if k == JUMP:
            rank = rank.withColumn("value", (F.col("value") - damping**2 * F.col("older")) / (1 - damping**2))
    for name in ("edges", "steps", "ways", "seeds"):
        scratch.drop(name)
    total = rank.groupBy("kind").agg(F.sum("value").alias("total"))
    return rank.join(F.broadcast(total), "kind").select("kind", F.col("src").alias("host"), (F.col("value") / F.col("total")).alias("value"))


def judge_hosts(pages: DataFrame, trusted: str = TRUSTED, blocked: str = BLOCKED, max_distrust: float = MAX_DISTRUST, tolerance: float = TOLERANCE, url_col: str = "url", html_col: str = "html", seeds: DataFrame | None = None) -> DataFrame:
    """(host, trust, distrust, keep) of every host. seeds: (host, blocked); None: those that the patterns match."""
    scratch = Scratch(pages.sparkSession, "hosts")
    hosts, ways = steps(scratch, scratch.write(host_edges(pages, url_col, html_col), "edges"))
    known = scratch.write(seeds_of(hosts, seeds, trusted, blocked), "seed_hosts")
    rank = propagate(scratch, hosts, ways, known, tolerance)
    rank = rank.unionByName(known.filter("kind = 1").select(F.lit(2).alias("kind"), "host", F.lit(1.0).alias("value")))
    value = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0.0)).alias(c) for k, c in ((0, "trust"), (1, "distrust"), (2, "seed"))]
    x = hosts.join(rank, "host", "left").groupBy("host").agg(*value).crossJoin(F.broadcast(hosts.agg(F.count("*").alias("n"))))
    bad = (F.col("seed") > 0) | ((F.col("distrust") > F.col("trust")) & (F.col("distrust") * F.col("n") >= max_distrust))
    return x.select("host", "trust", "distrust", (~bad).alias("keep"))


def judge_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """(page_id, url, host, trust, distrust, keep) of every page; values to 9 places."""
    hosts = judge_hosts(pages, url_col=url_col, **options)
    x = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), host_of(pages[url_col].cast("string")).alias("host"))
    return x.join(hosts, "host", "left").select("page_id", "url", "host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"), F.coalesce("keep", F.lit(True)).alias("keep"))


def oracle_sql(trusted: str = TRUSTED, blocked: str = BLOCKED, max_distrust: float = MAX_DISTRUST, rounds: int = 200) -> str:
    """judge_pages() as DuckDB SQL: plain rounds, as many as leave less than DAMPING ** rounds of the walk."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    host = lambda x: f"nullif(lower(regexp_extract({x}, {q(HOST)}, 1)), '')"
    site = "regexp_replace(host, '^(www|m|blog)[.]([^.]+[.])', '\\2')"
    return f"""WITH RECURSIVE p AS (SELECT page_id, url, {host('url')} AS host, coalesce(html, '') AS html FROM pages),
    l AS (SELECT host AS src, {host('x')} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, {q(LINK)}, 1)) AS x FROM p WHERE host IS NOT NULL)),
    links AS (SELECT src, dst, count(*) AS weight FROM l WHERE dst <> src GROUP BY src, dst),
    h0 AS (SELECT host FROM p WHERE host IS NOT NULL UNION SELECT dst FROM links),
    s AS (SELECT host, {site} AS site FROM h0 WHERE host <> {site}),
    hosts AS (SELECT host FROM h0 UNION SELECT site FROM s),
    e AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT host, site, 1 FROM s UNION ALL SELECT site, host, 1 FROM s) GROUP BY src, dst),
    w AS (SELECT 0 AS kind, src, dst, weight FROM e UNION ALL SELECT 1, dst, src, weight FROM e),
    seeds AS (SELECT CASE WHEN regexp_matches(host, {q(blocked)}) THEN 1 ELSE 0 END AS kind, host FROM hosts WHERE regexp_matches(host, {q(blocked)}) OR regexp_matches(host, {q(trusted)})),
    r0 AS MATERIALIZED (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS value FROM seeds),
    ways AS MATERIALIZED (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) * {DAMPING} AS share, 0.0::DOUBLE AS restart FROM w UNION ALL SELECT kind, host, host, 0, value * (1 - {DAMPING}) FROM r0),
    walk(k, kind, host, value) AS (SELECT 0, kind, host, value FROM r0
        UNION ALL SELECT r.k + 1, w.kind, w.dst, sum(r.value * w.share + w.restart) FROM walk r JOIN ways w ON w.kind = r.kind AND w.src = r.host WHERE r.k < {rounds} GROUP BY r.k, w.kind, w.dst),
    v AS (SELECT kind, host, value / sum(value) OVER (PARTITION BY kind) AS value FROM walk WHERE k = {rounds}),
    j AS (SELECT h.host, coalesce(sum(value) FILTER (kind = 0), 0.0) AS trust, coalesce(sum(value) FILTER (kind = 1), 0.0) AS distrust FROM hosts h LEFT JOIN v ON h.host = v.host GROUP BY h.host)
    SELECT p.page_id, p.url, p.host, round(trust, 9) AS trust, round(distrust, 9) AS distrust,
        coalesce(NOT (regexp_matches(p.host, {q(blocked)}) OR (distrust > trust AND distrust * (SELECT count(*) FROM hosts) >= {max_distrust})), true) AS keep
    FROM p LEFT JOIN j ON p.host = j.host"""
