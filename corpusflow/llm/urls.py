"""Host reputation for URL filters by empirical Bayes.

Labelled page outcomes are counted per host. The share of bad outcomes is shrunk down a tree: the table's mean is the
prior of each suffix (last label), a suffix that of its registered domains (last two labels), a domain that of its
hosts. The strength of each prior comes from the spread of the children's shares around their parents, by the moments
of the beta-binomial. A host is blocked where the lower bound of its posterior share exceeds a limit.
Fixed rules (host, path prefix) come first; the longest that fits wins.

Defined results: a null URL or one without ``://`` has an empty host and path, belongs to the empty host and is allowed
unless that host's outcomes say otherwise; hosts without outcomes get their domain's share; repeated pages count each;
null outcomes count for nothing; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.tables import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
HOT_SHARE = 1000     # a key with more than a thousandth of the rows is hot; there are fewer than a thousand such keys
Z = 1.645            # the bound leaves one in twenty below
MAX_BAD = 0.5        # share of bad outcomes above which a host is blocked
MIN_RHO, MAX_RHO = 0.001, 0.999


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null for none."""
    text = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer rules override
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _with_parent(facts: DataFrame, dim: DataFrame, key: str, rows: str, total: float, unique: Column) -> DataFrame:
    """``facts`` with the columns of ``dim``, which has one row per ``key`` and the number of facts in ``rows``.

    Keys that hold more than a thousandth of all facts are fewer than a thousand: only those are broadcast. The other
    facts are joined by a shuffle; facts that are done already are dealt evenly by ``unique``.
    """
    value = [c for c in dim.columns if c not in (key, rows)]
    hot = F.broadcast(dim.where(F.col(rows) * HOT_SHARE > total).select(F.col(key).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in value)))
    cold = dim.where(F.col(rows) * HOT_SHARE <= total).select(F.concat(F.lit("k"), key).alias("_cold"), *(F.col(c).alias(f"_cold_{c}") for c in value))
    first = facts.join(hot, F.col(key) == F.col("_hot"), "left")
    first = first.withColumn("_key", F.when(F.col("_hot").isNull(), F.concat(F.lit("k"), key)).otherwise(F.concat(F.lit("h"), unique.cast("string"))))
    both = first.join(cold, F.col("_key") == F.col("_cold"), "left")
    return both.select(*facts.columns, *(F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in value))


def strength(level: DataFrame, n: str, bad: str, prior: str) -> float:
    """Prior strength (a + b of the beta) of a level, by moments.

    The squared distance of a child with n outcomes from its prior m, (y - nm)^2 / n, is m(1-m)(1 + (n-1) rho) in the mean.
    """
    v = F.col(prior) * (1 - F.col(prior))
    s, a, b = level.where(F.col(n) > 0).agg(F.sum(F.pow(F.col(bad) - F.col(n) * F.col(prior), 2) / F.col(n)), F.sum(v), F.sum((F.col(n) - 1) * v)).first()
    rho = (s - a) / b if b else MAX_RHO if s is None else MIN_RHO
    return 1 / min(MAX_RHO, max(MIN_RHO, rho)) - 1


def reputation(hosts: DataFrame, unique: Column | None = None) -> DataFrame:
    """Posterior share of bad outcomes of every host.

    ``hosts``: one row per ``host`` with ``n_pages``, ``n`` outcomes and ``bad`` among them. Only three strengths and a total
    come to the driver.
    """
    hosts = hosts.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("children")), "url-domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("children"), F.sum("children").alias("hosts")), "url-suffixes")
    n, bad, n_domains, n_hosts = suffixes.agg(F.sum("n"), F.sum("bad"), F.sum("children"), F.sum("hosts")).first()
    root = ((bad or 0) + 1) / ((n or 0) + 2)
    suffixes = suffixes.withColumn("prior", F.lit(root))
    k = strength(suffixes, "n", "bad", "prior")
    up = suffixes.select("suffix", F.col("children").alias("_rows"), ((F.col("bad") + k * F.col("prior")) / (F.col("n") + k)).alias("prior"))
    domains = stored(_with_parent(domains, up, "suffix", "_rows", n_domains or 0, F.xxhash64("domain")), "url-domain-priors")
    k = strength(domains, "n", "bad", "prior")
    up = domains.select("domain", F.col("children").alias("_rows"), ((F.col("bad") + k * F.col("prior")) / (F.col("n") + k)).alias("prior"))
    found = stored(_with_parent(hosts, up, "domain", "_rows", n_hosts or 0, F.xxhash64("host")), "url-host-priors")
    k = strength(found, "n", "bad", "prior")
    size = F.col("n") + k
    mean = (F.col("bad") + k * F.col("prior")) / size
    return found.select("host", "n_pages", F.col("n").alias("outcomes"), mean.alias("bad_share"),
                        F.greatest(F.lit(0.0), mean - Z * F.sqrt(mean * (1 - mean) / (size + 1))).alias("lower_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, id_column: str, url_column: str, rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """Verdict per page. ``outcomes``: rows (``document``, ``bad`` 0 or 1); a page's document is the number that ends its path."""
    host, path = host_and_path(F.col(url_column))
    seen = pages.select(F.col(id_column).alias("_id"), host.alias("host"), path.alias("path"))
    document = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    counted = seen.withColumn("document", F.when(document != "", document.cast("long"))).groupBy("host", "document").agg(F.count("*").alias("n_pages"))
    known = outcomes.where(F.col("bad").isNotNull()).groupBy("document").agg(F.max("bad").alias("_bad"))
    # pages without a number are dealt by their host, not all by null
    keyed = counted.withColumn("_k", F.coalesce(F.col("document").cast("string"), F.concat(F.lit("-"), "host")))
    joined = keyed.join(known.select(F.col("document").cast("string").alias("_k"), "_bad"), "_k", "left")
    hosts = joined.groupBy("host").agg(F.sum("n_pages").alias("n_pages"), F.sum(F.when(F.col("_bad").isNotNull(), F.col("n_pages")).otherwise(0)).alias("n"),
                                       F.sum(F.when(F.col("_bad") > 0, F.col("n_pages")).otherwise(0)).alias("bad"))
    scores = reputation(stored(hosts, "url-hosts"))
    scores = stored(scores, "url-reputation")
    total = scores.agg(F.sum("n_pages")).first()[0] or 0
    found = _with_parent(seen, scores, "host", "n_pages", total, F.xxhash64("_id", "path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    return found.select(F.col("_id").alias(id_column), "host", "path", rule.alias("rule"),
                        F.coalesce(verdict, F.when(F.col("lower_bound") > max_bad, "block").otherwise("allow")).alias("verdict"),
                        F.round("bad_share", 6).alias("bad_share"), F.round("lower_bound", 6).alias("lower_bound"))


def bad_documents(labels: DataFrame) -> DataFrame:
    """Outcomes from the labels table: a document is bad if its quality is 0 or it is toxic; unlabelled rows have none."""
    quality, toxic = F.col("quality"), F.col("toxic")
    return labels.select(F.col("doc_id").alias("document"), F.when((quality == 0) | (toxic == 1), 1).when(quality.isNotNull() | toxic.isNotNull(), 0).alias("bad"))


def oracle() -> str:
    """The same in DuckDB SQL, for the default parameters."""
    rule = "null"
    verdict = "null"
    for kind, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
        rule, verdict = f"case when {fits} then '{h + p}' else {rule} end", f"case when {fits} then '{kind}' else {verdict} end"

    def kappa(level: str) -> str:
        return f"""(select 1 / least({MAX_RHO}, greatest({MIN_RHO}, (sum(power(bad - n * prior, 2) / n) - sum(prior * (1 - prior))) / nullif(sum((n - 1) * prior * (1 - prior)), 0))) - 1
                    from {level} where n > 0)"""

    return f"""
with seen as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
  from (select page_id, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end, '') rest from pages)),
known as (
  select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) bad from labels where quality is not null or toxic is not null group by doc_id),
hosts as (
  select host, regexp_extract(host, '[^.]*(\\.[^.]*)?$') domain, regexp_extract(host, '[^.]*$') suffix, count(*) n_pages, count(k.bad) n, coalesce(sum(k.bad), 0) bad
  from seen left join known k on k.doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(\\.html)?/?$', 1), '') as bigint) group by 1, 2, 3),
d0 as (select domain, suffix, sum(n) n, sum(bad) bad from hosts group by 1, 2),
s0 as (select suffix, sum(n) n, sum(bad) bad, (select (sum(bad) + 1) / (sum(n) + 2) from hosts) prior from d0 group by 1),
s1 as (select suffix, (bad + k * prior) / (n + k) prior from s0, (select {kappa('s0')} k)),
d1 as (select d0.*, s1.prior from d0 join s1 using (suffix)),
d2 as (select domain, (bad + k * prior) / (n + k) prior from d1, (select {kappa('d1')} k)),
h1 as (select hosts.*, d2.prior from hosts join d2 using (domain)),
h2 as (select host, n + k size, (bad + k * prior) / (n + k) mean from h1, (select {kappa('h1')} k)),
scored as (select host, mean, greatest(0.0, mean - {Z} * sqrt(mean * (1 - mean) / (size + 1))) lower_bound from h2)
select page_id, host, path, {rule} rule, coalesce({verdict}, case when lower_bound > {MAX_BAD} then 'block' else 'allow' end) verdict,
  round(mean, 6) bad_share, round(lower_bound, 6) lower_bound
from seen join scored using (host)"""
