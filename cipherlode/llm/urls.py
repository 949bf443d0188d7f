"""URL filters: longest matching rule, else logistic regression on hashed character n-grams. DataFrame functions only."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (action, rule); a rule is a host, fitting its subdomains too, and the start of a path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Hash buckets for host and for path n-grams, each; characters in an n-gram; training rounds and step.
BUCKETS, GRAM, ROUNDS, STEP, SHRINK = 256, 3, 300, 4.0, 0.002
#: The labelled URL table that the classifier learns from (1: block).
LABELLED = [(0, u) for u in (
    "https://www.library.org/en/catalogue/12", "https://news.town.net/2024/05/report.html", "http://blog.garden.org/de/roses", "https://docs.project.org/fr/guide/7",
    "https://en.wiki.org/history", "https://m.weather.net/es/today", "https://school.edu/en/courses/341", "http://museum.org/fr/rooms/22.html",
    "https://www.transport.net/de/lines/5", "https://forum.reader.org/en/topic/889", "https://science.org/en/papers/640?page=2", "https://recipes.net/en/bread/33",
    "https://shop.books.org/es/title/71", "http://www.city.org/en/council/450", "https://blog.teacher.net/en/533", "https://code.tools.org/en/issues/90",
)] + [(1, u) for u in (
    "http://cheap-pills.net/en/buy/1", "https://www.cheap-meds.org/order?ref=x", "https://spam-farm.net/links/9", "http://free-casino.org/en/bonus", "https://best-poker-spam.net/win",
    "https://pills-online.org/discount/50", "http://spam-links.org/en/seo/3", "https://win-money-fast.net/lottery", "https://adult-cams.net/free/18", "http://cracked-warez.org/download/serial",
    "https://replica-watches.net/cheap/7", "https://www.viagra-pills.org/en/cheap", "https://link-farm.net/en/728", "http://casino-spam.org/slots/25", "https://payday-loans-cheap.net/apply", "https://free-iphone-winner.net/claim",
)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where url is null or has no '://'."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _grams(text: Column, offset: int) -> Column:
    """Bucket of each n-gram of ^text$: its characters' codes as digits of base 31."""
    framed = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    codes = F.transform(F.filter(framed, lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(codes) - (GRAM - 1), F.lit(1))),
        lambda i: (sum((F.coalesce(F.try_element_at(codes, i + j), F.lit(0)) * (31 ** (GRAM - 1 - j)) for j in range(GRAM)), F.lit(0)) % BUCKETS + offset).cast("int"),
    )


def features(host: Column, path: Column) -> Column:
    """Buckets of the host's and the path's n-grams."""
    return F.concat(_grams(host, 0), _grams(path, BUCKETS))


def train(spark: SparkSession, labelled: list[tuple[int, str]] | None = None) -> list[float]:
    """Weights, the bias last. Full gradient steps over the labelled table (a few dozen rows by its nature), one Spark expression."""
    rows = spark.createDataFrame(labelled or LABELLED, "y int, url string")
    grams = rows.select("y", "url", features(*host_and_path(F.col("url"))).alias("g"))
    dense = grams.select("url", F.col("y").cast("double").alias("y"), F.transform(F.sequence(F.lit(0), F.lit(2 * BUCKETS)), lambda j: F.when(j == 2 * BUCKETS, 1.0).otherwise(F.size(F.filter("g", lambda g: g == j)) / F.size("g"))).alias("x"))
    table = dense.agg(F.sort_array(F.collect_list(F.struct("url", "y", "x"))).alias("t"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)

    def step(w: Column, _: Column) -> Column:
        def moved(acc: Column, e: Column) -> Column:
            pull = (e["y"] - 1 / (1 + F.exp(-dot(w, e["x"])))) * (STEP / F.size("t"))
            return F.transform(F.array(pull), lambda r: F.zip_with(acc, e["x"], lambda p, v: p + v * r))[0]  # the array binds r: it is computed once

        return F.aggregate("t", F.transform(w, lambda v: v * (1 - SHRINK)), moved)

    return table.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.array_repeat(F.lit(0.0), 2 * BUCKETS + 1), step)).first()[0]


def verdicts(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str]] | None = None, weights: list[float] | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, score) for every row.

    The longest rule that fits decides; without one, the classifier blocks from a
    score of 0.5. A null url, or one without '://', has an empty host and path
    and only the classifier's bias and frame n-grams. Repeated rows and null keys
    are judged like others; an empty table gives no rows; other columns are left
    out. Everything is a projection of the scan: no shuffle.
    """
    weights = weights or train(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(RULES if rules is None else rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((F.col("host") == text[:at]) | F.col("host").endswith("." + text[:at])) & F.col("path").startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    table = F.array(*map(F.lit, weights[:-1]))
    grams = features(F.col("host"), F.col("path"))
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(table, g)) / F.size(grams) + weights[-1]
    out = split.select("key", "host", "path", rule.alias("rule"), verdict.alias("said"), (1 / (1 + F.exp(-total))).alias("score"))
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("score")


def _plain_weights() -> np.ndarray:
    """The same training in numpy, for the SQL below."""
    labelled = sorted((u, y) for y, u in LABELLED)
    x, y = np.zeros((len(labelled), 2 * BUCKETS + 1)), np.array([float(b) for _, b in labelled])
    for k, (url, _) in enumerate(labelled):
        rest = url.partition("://")[2]
        cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
        host, path = rest[:cut].lower(), rest[cut:].partition("?")[0].partition("#")[0]
        rows = [(s, o) for t, o in ((host, 0), (path, BUCKETS)) for s in (f"^{t}$"[i : i + 3] for i in range(max(1, len(t))))]
        for s, o in rows:
            s = (s + "\0\0\0")[:3]
            x[k, (ord(s[0]) * 961 + ord(s[1]) * 31 + ord(s[2])) % BUCKETS + o] += 1 / len(rows)
    x[:, -1] = 1
    w = np.zeros(2 * BUCKETS + 1)
    for _ in range(ROUNDS):
        w = w * (1 - SHRINK) + STEP / len(y) * ((y - 1 / (1 + np.exp(-x @ w))) @ x)
    return w


def oracle() -> str:
    w = _plain_weights()
    gram = lambda t, o: f"list_transform(range(1, greatest(length({t}), 1) + 1), lambda i: (coalesce(unicode(substr('^' || {t} || '$', i, 1)), 0) * 961 + (CASE WHEN length({t}) + 2 >= i + 1 THEN unicode(substr('^' || {t} || '$', i + 1, 1)) ELSE 0 END) * 31 + (CASE WHEN length({t}) + 2 >= i + 2 THEN unicode(substr('^' || {t} || '$', i + 2, 1)) ELSE 0 END)) % {BUCKETS} + {o})"
    fits = lambda r: f"(host = '{r[: r.index('/')]}' OR ends_with(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/') :]}')"
    best = sorted(RULES, key=lambda r: -len(r[1]))
    return f"""
WITH w AS (SELECT {[float(v) for v in w[:-1]]} AS w),
a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, list_concat({gram("host", 0)}, {gram("path", BUCKETS)}) AS g FROM b),
d AS (SELECT page_id, host, path, list_sum(list_transform(g, lambda i: w.w[CAST(i AS BIGINT) + 1])) / len(g) + {float(w[-1])!r} AS z,
  CASE {" ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in best)} END AS rule FROM c, w)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{a}'" for a, r in best)} WHEN z >= 0 THEN 'block' ELSE 'allow' END AS verdict FROM d"""
