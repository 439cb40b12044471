"""Judge URLs: by rules on host and path, else by gradient-boosted trees on lexical features.

The trees see lengths, depth, digit ratios, entropy, counts of parameters and marks, and
statistics of suffixes: how often labelled URLs with the same host suffix (of one, two or
three labels) or the same first path segment were blocked.  Suffixes are hashed to a fixed
number of buckets, so the statistics are a table of bounded size; they are counted over all
labelled URLs.  A labelled URL is described without the labels of its own fold, as a new
URL would be; otherwise the trees would learn to trust statistics that hold the answer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with its own.
Rule = tuple[str, str, str]
BUCKETS = 4096
FOLDS = 5
PRIOR = 4.0  # labelled URLs that the overall share of blocked ones counts as, in each statistic
LEVELS = ("suffix1", "suffix2", "suffix3", "segment")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host behind the first ``://``, A-Z lower-cased, and path; both empty without it."""
    rest = F.when(F.instr(url, F.lit("://")) > 0, F.substring_index(url, "://", 1))
    rest = F.coalesce(F.substr(url, F.length(rest) + 4), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    The list is part of the plan: it is meant for rules written by hand, up to some hundreds.
    """
    whens = None
    for verdict, own, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(start))
        found = F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))
        whens = F.when(fits, found) if whens is None else whens.when(fits, found)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if whens is None else whens


def entropy(text: Column) -> Column:
    """Bits a character of the text's own distribution."""
    def bound(t: Column) -> Column:
        letters, n = F.array_distinct(F.split(t, "")), F.length(t)
        share = lambda c: (n - F.length(F.replace(t, c, F.lit("")))) / n
        return F.aggregate(letters, F.lit(0.0), lambda s, c: F.when(c == "", s).otherwise(s - share(c) * F.log2(share(c))))

    return F.when(text == "", 0.0).otherwise(F.transform(F.array(text), bound)[0])


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that the URL's characters alone give; a null URL is an empty one."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda text, what: F.regexp_count(text, F.lit(what)).cast("double")
    ratio = lambda text: count(text, "[0-9]") / F.greatest(F.length(text), F.lit(1))
    return {
        "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": count(path, "[^/]+"), "labels": count(host, "[^.]+"), "digit_ratio": ratio(url), "host_digit_ratio": ratio(host),
        "path_digits": count(path, "[0-9]"), "hyphens": count(host, "-"), "entropy": entropy(url), "host_entropy": entropy(host),
        "parameters": count(query, "[^&]+"), "query_length": F.length(query).cast("double"), "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(url, F.lit("https:")).cast("double"), "extension": count(path, r"\.[A-Za-z0-9]{1,5}$"), "slash_at_end": F.endswith(path, F.lit("/")).cast("double"),
        "marks": count(url, "[%_~=@:;,]"),
    }


def buckets(host: Column, path: Column) -> dict[str, Column]:
    """Bucket of each suffix of the host and of the first path segment."""
    keys = {f"suffix{n}": F.substring_index(host, ".", -n) for n in (1, 2, 3)}
    keys["segment"] = F.regexp_extract(path, "^/*([^/]*)", 1)
    return {level: F.pmod(F.xxhash64(F.lit(level), key), F.lit(BUCKETS)).cast("int") for level, key in keys.items()}


def described(rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``url`` as struct ``row``, with host, path, features and buckets."""
    host, path = host_and_path(F.col("url"))
    rows = rows.select(F.struct("*").alias("row"), F.col("url"), host.alias("host"), path.alias("path"))
    columns = lexical(F.col("url"), F.col("host"), F.col("path")) | {f"b_{k}": v for k, v in buckets(F.col("host"), F.col("path")).items()}
    return rows.withColumns(columns).drop("url")


@dataclass
class Model:
    """``trees`` (none if labels were missing or all alike), ``statistics`` (level, bucket, n, blocked, folds), ``share`` of blocked URLs."""

    trees: GBTClassificationModel | None
    statistics: DataFrame
    share: float


def with_statistics(rows: DataFrame, statistics: DataFrame, share: float, fold: Column | None = None) -> DataFrame:
    """Share of blocked URLs and logarithm of their number in each bucket; without those of ``fold``."""
    for level in LEVELS:
        # a row for each bucket: at most BUCKETS of them
        own = F.broadcast(statistics.where(F.col("level") == level).select(F.col("bucket").alias("k"), F.struct("n", "blocked", "folds").alias(f"s_{level}")))
        rows = rows.join(own, F.col(f"b_{level}") == F.col("k"), "left").drop("k")
        s = F.col(f"s_{level}")
        n, blocked = F.coalesce(s["n"], F.lit(0)), F.coalesce(s["blocked"], F.lit(0))
        if fold is not None:
            out = F.coalesce(F.try_element_at(s["folds"], fold), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("blocked")))
            n, blocked = n - out["n"], blocked - out["blocked"]
        rows = rows.withColumns({f"rate_{level}": (blocked + PRIOR * share) / (n + PRIOR), f"count_{level}": F.log1p(n.cast("double"))}).drop(f"s_{level}")
    return rows


def features(rows: DataFrame) -> list[str]:
    wanted = [*lexical(F.lit(""), F.lit(""), F.lit("")), *[f"{kind}_{level}" for level in LEVELS for kind in ("rate", "count")]]
    return [c for c in rows.columns if c in wanted]


def fit(labelled: DataFrame, sample: int = 50_000, trees: int = 12, depth: int = 4, seed: int = 5) -> Model:
    """Learn from rows with ``url`` and ``blocked`` (boolean; null rows teach nothing).

    Statistics count every labelled row; the trees are fitted to about ``sample`` rows,
    chosen by a hash of their URL, so their cost does not grow with the corpus.  Repeated
    URLs count as often as they come, and lie in one fold.
    """
    spark = labelled.sparkSession
    scratch = Scratch(spark, "urls")
    fold = F.pmod(F.xxhash64(F.coalesce(F.col("row.url"), F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold")
    rows = described(labelled.where("blocked IS NOT NULL").select("url", "blocked"))
    rows = rows.select("*", fold, F.col("row.blocked").cast("int").alias("label"))
    level = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"b_{x}").alias("bucket")) for x in LEVELS])).alias("at")
    counts = rows.select("fold", "label", level).groupBy("at.level", "at.bucket", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
    folds = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "blocked"))))  # FOLDS entries
    counts = counts.groupBy("level", "bucket").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), folds.alias("folds"))
    counts = scratch.keep(counts, "statistics")
    n, blocked = counts.where(F.col("level") == LEVELS[0]).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    share = blocked / n if n else 0.0
    if blocked in (0, n):
        return Model(None, counts, share)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("row.url"), F.lit(""))), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, sample / n)))
    chosen = with_statistics(rows.where(draw), counts, share, F.col("fold"))
    inputs = features(chosen)
    chosen = VectorAssembler(inputCols=inputs, outputCol="features").transform(chosen).select("features", F.col("label").cast("double"))
    chosen = scratch.keep(chosen.coalesce(2), "sample")  # some 250 bytes a row
    if chosen.agg(F.count_distinct("label")).first()[0] < 2:
        return Model(None, counts, share)
    learner = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.4, seed=seed)
    return Model(learner.fit(chosen), counts, share)


def judge(pages: DataFrame, model: Model, rules: list[Rule] = ()) -> DataFrame:
    """row (all columns of ``pages`` as a struct), host, path, rule, verdict, score.

    ``verdict`` is the rule's, else ``block`` where the trees' probability ``score`` is
    above a half.  Null URLs and those without ``://`` have an empty host and path, fit no
    rule and are judged by their characters.  A model without trees gives the share of
    blocked labels.  Repeated rows are judged alike, an empty table gives no rows.
    """
    rows = with_statistics(described(pages), model.statistics, model.share)
    if model.trees is None:
        rows = rows.withColumn("score", F.lit(float(model.share)))
    else:
        rows = VectorAssembler(inputCols=features(rows), outputCol="__features").transform(rows)
        trees = model.trees.copy().setFeaturesCol("__features").setRawPredictionCol("").setPredictionCol("").setProbabilityCol("__p")
        rows = trees.transform(rows).withColumn("score", vector_to_array("__p")[1])
    rows = rows.select("row", "host", "path", rule_of(F.col("host"), F.col("path"), list(rules)).alias("found"), "score")
    learned = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return rows.select("row", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", learned).alias("verdict"), "score")


def labelled_by(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """url and blocked of the pages that a rule fits: what the rules say about their own URLs."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("url", host.alias("host"), path.alias("path"))
    found = rule_of(F.col("host"), F.col("path"), rules)["verdict"]
    return rows.select("url", (found == "block").alias("blocked")).where("blocked IS NOT NULL")
