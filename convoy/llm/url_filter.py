"""URL filtering by a ratio of character language models, in DataFrame operations only.

URLs that a host/path rule decides are the labelled set.  Four fifths of them
train two variable-order Markov models (accepted, rejected): a character's
probability after its ``ORDER`` predecessors interpolates all shorter contexts,
``p_k = (n(context, char) + M * p_(k-1)) / (n(context) + M)``, down to the uniform
one.  A URL's score is the mean log-likelihood difference per character; the
threshold is calibrated on the last fifth, where the two error rates' sum is
least.  URLs without a rule are judged by the score.

Models live as a table of distinct character windows with one log ratio each; it
is broadcast if its counted size allows, else only its frequent windows are, and the
others joined by shuffle.  So are the counts of the shortest contexts, which all
windows share.  Scores are kept per distinct URL, so that repeated URLs meet in
pre-aggregated rows.

Null URLs, and those without ``://``, have empty host and path; a null URL is
blocked, an empty one is scored.  With labels of one kind only, the threshold
is 0 and an untrained model is uniform.  Repeated rows are each judged.  Columns of
the operator's own names are replaced, all others kept.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.llm.shared import settled, table

ORDER = 3
#: Weight of the shorter context, in observations.
PRIOR = 4.0
ALPHABET = 256.0
#: Distinct windows up to which their table is broadcast.
BROADCAST_WINDOWS = 300_000
#: Longest contexts whose counts are broadcast in any case that allows it.
SHARED = 1
#: Width of the calibration's score bins.
BIN = 0.01

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A host (with all its subdomains) and a path prefix; written ``host/path``."""

    text: str
    allow: bool

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


RULES = (Rule("com/en/", False), Rule("example.com/en/7", True), Rule("net/de/", True), Rule("example.net/de/8", False), Rule("org/es/", False))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.text)).otherwise(out)
    return out


def trains(url: Column) -> Column:
    """Whether a labelled URL trains the models (four in five) or calibrates the threshold."""
    return F.conv(F.left(F.md5(url.cast("binary")), F.lit(6)), 16, 10).cast("bigint") % 5 > 0


def _windows(url: Column) -> Column:
    """Every run of ``ORDER + 1`` characters of the URL between its end marks."""
    marked = F.concat(F.lit("\x02" * ORDER), url, F.lit("\x03"))
    chars = F.filter(F.split(marked, ""), lambda c: c != "")
    return F.transform(F.sequence(F.lit(1), F.size(chars) - ORDER), lambda i: F.array_join(F.slice(chars, i, ORDER + 1), ""))


def _suffixes(window: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), F.right(window, F.lit(k + 1)).alias("gram"), F.left(F.right(window, F.lit(k + 1)), F.lit(k)).alias("context")) for k in range(ORDER + 1)])


def window_ratios(windows: DataFrame, trained: DataFrame) -> DataFrame:
    """Log ratio of each distinct window.

    windows: ``window``; trained: ``window``, ``yes``, ``no`` (how often accepted and
    rejected training URLs hold it).
    """
    grams = trained.select("yes", "no", F.explode(_suffixes(F.col("window"))).alias("s")).select("yes", "no", "s.*")
    counts = grams.groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    totals = grams.groupBy("k", "context").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    rows = windows.select("window", F.explode(_suffixes(F.col("window"))).alias("s")).select("window", "s.*")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    low = F.col("k") <= SHARED  # contexts so short that very many windows have them
    parts = []
    for rank, grams_of in ((low, F.length("gram") <= SHARED + 1), (~low, F.length("gram") > SHARED + 1)):
        own = rows.where(rank)
        for table, on in ((counts.where(grams_of), ["gram"]), (totals.where(rank), ["k", "context"])):
            few = rank is low and settled(table, "url-contexts").count() <= BROADCAST_WINDOWS
            own = own.join(F.broadcast(table) if few else table, on, "left")
        parts.append(own)
    seen = parts[0].unionByName(parts[1]).select("window", "k", *[zero(c) for c in ("yes", "no", "all_yes", "all_no")])
    levels = seen.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("k", "yes", "no", "all_yes", "all_no"))).alias("levels"))

    def probability(n: str, total: str) -> Column:
        return F.aggregate("levels", F.lit(1 / ALPHABET), lambda p, x: (x[n] + PRIOR * p) / (x[total] + PRIOR))

    return levels.select("window", (F.log(probability("yes", "all_yes")) - F.log(probability("no", "all_no"))).alias("ratio"))


def scores(urls: DataFrame, label: str = "label", fold: str = "train") -> DataFrame:
    """Distinct URLs with their score; urls: ``url``, a label (true: accepted, null: unknown) and whether it trains."""
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # distinct URLs are few bytes and much work: they are dealt to as many tasks as shuffles have, not to as few as their size asks for
    rows = urls.groupBy("url").agg(F.count("*").alias("n"), F.max(label).alias("label"), F.max(fold).alias("train")).repartition(parts)
    cut = rows.select("url", F.explode(_windows(F.col("url"))).alias("window"), F.when(F.col("train") & F.col("label"), F.col("n")).otherwise(0).alias("yes"), F.when(F.col("train") & ~F.col("label"), F.col("n")).otherwise(0).alias("no"))
    counted = settled(cut.groupBy("window").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.count("*").alias("n")), "url-windows")
    ratios = window_ratios(counted.select("window"), counted.where("yes + no > 0"))
    size = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size[0] <= BROADCAST_WINDOWS:
        found = cut.join(F.broadcast(ratios), "window")
    else:  # windows of so many occurrences that there are few of them
        often = F.broadcast(counted.where(F.col("n") > size[1] // BROADCAST_WINDOWS).select("window"))
        ratios = settled(ratios, "url-ratios")
        some = F.broadcast(ratios.join(often, "window", "left_semi"))
        found = cut.join(some, "window").unionByName(cut.join(some.select("window"), "window", "left_anti").join(ratios, "window"))
    return found.groupBy("url").agg(F.avg("ratio").alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the score from which URLs are accepted; scored: ``score``, ``label`` of the calibration rows."""
    bins = scored.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count_if("label").alias("yes"), F.count_if(~F.col("label")).alias("no"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    lost = F.coalesce(F.sum("yes").over(below), F.lit(0)) / F.sum("yes").over(whole)
    caught = F.coalesce(F.sum("no").over(below), F.lit(0)) / F.sum("no").over(whole)
    both = bins.where("yes + no > 0").withColumn("_all_yes", F.sum("yes").over(whole)).withColumn("_all_no", F.sum("no").over(whole)).where("_all_yes > 0 AND _all_no > 0")
    best = both.select("bin", (lost + 1 - caught).alias("error")).agg(F.min(F.struct("error", F.abs("bin"), "bin")).alias("best"))
    return best.select(F.coalesce(F.col("best.bin") * BIN, F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds host, path, rule, verdict and score to every row."""
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns])  # apart from the operator's own columns, whatever its columns are called
    parts = pages.select(row.alias("_row"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parts = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allowed = F.col("rule").isin([r.text for r in rules if r.allow])
    labelled = parts.where("url IS NOT NULL").select("url", F.when(F.col("rule").isNotNull(), allowed).alias("label"), trains(F.col("url")).alias("train"))
    scored = settled(scores(labelled), "url-scores")
    held = labelled.where("NOT train AND label IS NOT NULL").distinct().join(scored, "url")
    judged = parts.join(scored, "url", "left").crossJoin(F.broadcast(threshold(held)))
    accepted = F.when(F.col("rule").isNotNull(), allowed).otherwise(F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))
    own = ["host", "path", "rule", "verdict", "score"]
    kept = [F.col(f"_row.`{c}`").alias(c) for c in pages.columns if c not in own]
    return judged.withColumn("verdict", F.when(accepted, "allow").otherwise("block")).select(*kept, *own)


def op1_character_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql_rule() -> str:
    arms = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in sorted(RULES, key=lambda r: (len(r.text), r.text), reverse=True)]
    return f"CASE {' '.join(arms)} END"


def _sql_probability(counts: str) -> str:
    p = f"(1 / CAST({ALPHABET} AS DOUBLE))"
    for k in range(ORDER + 1):
        p = f"((coalesce(c{k}.{counts}, 0) + {PRIOR} * {p}) / (coalesce(t{k}.{counts}, 0) + CAST({PRIOR} AS DOUBLE)))"
    return p


_ALLOWED = ", ".join(f"'{r.text}'" for r in RULES if r.allow)
_GRAMS = " UNION ALL ".join(f"SELECT {k} AS k, right(w, {k + 1}) AS gram, left(right(w, {k + 1}), {k}) AS context, yes, no FROM trained" for k in range(ORDER + 1))
_JOINS = " ".join(f"LEFT JOIN counts c{k} ON c{k}.gram = right(x.w, {k + 1}) LEFT JOIN totals t{k} ON t{k}.k = {k} AND t{k}.context = left(right(x.w, {k + 1}), {k})" for k in range(ORDER + 1))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '{_PARTS}', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages),
r AS (SELECT *, {_sql_rule()} AS rule FROM p),
u AS (SELECT url, count(*) AS n, any_value(CASE WHEN rule IS NOT NULL THEN rule IN ({_ALLOWED}) END) AS label, CAST('0x' || left(md5(url), 6) AS BIGINT) % 5 > 0 AS train FROM r WHERE url IS NOT NULL GROUP BY url),
s AS (SELECT url, n, label, train, substr(m, i, {ORDER + 1}) AS w FROM (SELECT *, unnest(range(1, length(m) - {ORDER - 1})) AS i FROM (SELECT *, repeat(chr(2), {ORDER}) || url || chr(3) AS m FROM u))),
trained AS (SELECT w, sum(CASE WHEN train AND label THEN n ELSE 0 END) AS yes, sum(CASE WHEN train AND NOT label THEN n ELSE 0 END) AS no FROM s GROUP BY w),
g AS ({_GRAMS}),
counts AS (SELECT gram, sum(yes) AS yes, sum(no) AS no FROM g GROUP BY gram),
totals AS (SELECT k, context, sum(yes) AS yes, sum(no) AS no FROM g GROUP BY k, context),
ratios AS (SELECT x.w, ln({_sql_probability("yes")}) - ln({_sql_probability("no")}) AS ratio FROM trained x {_JOINS}),
scored AS (SELECT url, avg(ratio) AS score FROM s JOIN ratios USING (w) GROUP BY url),
bins AS (SELECT floor(score / CAST({BIN} AS DOUBLE)) AS bin, count_if(label) AS yes, count_if(NOT label) AS no FROM scored JOIN u USING (url) WHERE NOT train AND label IS NOT NULL GROUP BY 1),
errors AS (SELECT bin, coalesce(sum(yes) OVER b, 0) / sum(yes) OVER () + 1 - coalesce(sum(no) OVER b, 0) / sum(no) OVER () AS error, sum(yes) OVER () AS all_yes, sum(no) OVER () AS all_no FROM bins WINDOW b AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT bin * CAST({BIN} AS DOUBLE) FROM errors WHERE all_yes > 0 AND all_no > 0 ORDER BY error, abs(bin), bin LIMIT 1), 0) AS threshold)
SELECT page_id, host, path, rule, CASE WHEN CASE WHEN rule IS NOT NULL THEN rule IN ({_ALLOWED}) ELSE coalesce(score >= threshold, false) END THEN 'allow' ELSE 'block' END AS verdict
FROM r LEFT JOIN scored USING (url), cut
"""
