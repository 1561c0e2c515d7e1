"""URL filters: path rules, then gradient-boosted trees over lexical features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import LOWER, UPPER

#: Labelled rows that the trees are fitted on at most, taken by hash; every page is judged.
TRAIN_ROWS = 20_000
#: Folds of the labelled rows: a row's suffix rate comes from the others.
FOLDS = 5
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Host words whose pages count as labelled block in the query, all others as labelled allow. Fixed values.
BLOCK_WORDS = ("spam", "pills", "casino", "adult", "bets", "ads-track")
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "host_entropy", "entropy", "parameters", "fragment", "suffix_rate", "suffix_rows")
#: Rules that stand in the plan itself; more are joined. Both ways give the same rows.
IN_PLAN = 200


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def _rest(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = _rest(url)
    return F.regexp_extract(F.substring(rest, F.length(F.regexp_extract(rest, "^[^/?#]*", 0)) + 1, F.length(rest)), "^[^?#]*", 0)


def _in_plan(sites: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return sites.withColumns({"rule": rule, "ruled": verdict})


def _joined(sites: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Each distinct host and path meets, by equality, the rules of its host's suffixes whose paths are beginnings of its own."""
    split = F.instr("rule", "/")
    listed = sites.sparkSession.createDataFrame(sorted(set(rules)), "ruled string, rule string")
    listed = listed.select(F.substring("rule", 1, split - 1).alias("name"), F.substring("rule", split, F.length("rule")).alias("start"), "rule", "ruled")
    lengths = listed.groupBy("name").agg(F.collect_set(F.length("start")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = sites.select("host", "path").distinct().withColumn("name", F.explode(suffix)).join(lengths, "name")
    met = met.withColumn("length", F.explode("lengths")).where(F.col("length") <= F.length("path")).withColumn("start", F.substring("path", F.lit(1), F.col("length")))
    best = met.join(listed, ["name", "start"]).groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "ruled")).alias("best"))
    return sites.join(best, ["host", "path"], "left").select(*sites.columns, F.col("best.rule").alias("rule"), F.col("best.ruled").alias("ruled"))


def ruled(sites: DataFrame, rules: tuple = RULES) -> DataFrame:
    """sites (host, path, ...) with rule and ruled, the verdict, of the longest rule that fits, else nulls.

    rules: any number of (verdict, host and path). A rule's host fits itself and its subdomains, its path what starts
    with it; of equally long ones the greater text wins. A rule without a slash is an error.
    """
    if any("/" not in text for _, text in rules):
        raise ValueError("a rule is a host and a path that starts with a slash")
    return _in_plan(sites, list(rules)) if len(rules) <= IN_PLAN else _joined(sites, list(rules))


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(F.lit(0.0))


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("double")


def _parameters(url: Column) -> Column:
    """Non-empty pieces of the query, from the first ? to # or the end, cut at &."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.size(F.filter(F.split(query, "&"), lambda p: p != ""))


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the lexical features; needs url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url)
    found = {
        "length": n, "host_length": F.length("host"), "path_length": F.length("path"), "depth": _count(F.col("path"), "/"), "labels": _count(F.col("host"), "."), "hyphens": _count(F.col("host"), "-"),
        "digit_ratio": F.when(n > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / n).otherwise(0.0), "host_entropy": _entropy(F.col("host")), "entropy": _entropy(url), "parameters": _parameters(url), "fragment": F.contains(url, F.lit("#")),
    }
    pages = pages.withColumns({k: v.cast("double") for k, v in found.items()})
    return pages.withColumn("suffix", F.substring_index("host", ".", -1))


def _rates(labelled: DataFrame, prior: float) -> DataFrame:
    """Smoothed share of blocks and rows of each suffix; at most a row for each labelled row."""
    return labelled.groupBy("suffix").agg(_rate(F.sum("label"), F.count("*"), prior).alias("suffix_rate"), F.log1p(F.count("*")).alias("suffix_rows"))


def _rate(blocks: Column, rows: Column, prior: float) -> Column:
    return (blocks + 10 * prior) / (rows + 10)


def _out_of_fold(labelled: DataFrame, prior: float) -> DataFrame:
    """The training rows with rates from the other folds, so that no row's own label is among its features.

    Sums of each suffix and fold are taken first: at most suffixes times FOLDS rows meet in a window.
    """
    rows = labelled.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    sums = rows.groupBy("suffix", "fold").agg(F.sum("label").alias("blocks"), F.count("*").alias("n"))
    whole = W.partitionBy("suffix")
    others = F.sum("n").over(whole) - F.col("n")
    rates = sums.select("suffix", "fold", _rate(F.sum("blocks").over(whole) - F.col("blocks"), others, prior).alias("suffix_rate"), F.log1p(others).alias("suffix_rows"))
    return rows.join(F.broadcast(rates), ["suffix", "fold"])


def _with_rates(pages: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    return pages.join(F.broadcast(suffixes), "suffix", "left").fillna({"suffix_rate": prior, "suffix_rows": 0.0})


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple = RULES, train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block) for each row of pages (page_id, url).

    labelled: url, label (1 block, 0 allow); null labels are left out; if it has one class only, that is the
    verdict where no rule fits, and without labels it is allow. Of the labelled rows `train_rows` at most are used, those of least hash.
    The suffixes' figures come from the same rows, so the broadcast tables have no more rows than that.
    A null url, or one without ://, has an empty host and path and goes to the trees. Repeated rows each get their verdict;
    urls of any length are taken whole; an empty table gives an empty result; other columns of pages, whatever their
    names, are not read.
    """
    sites = lambda df, *more: df.select(*more, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    sample = labelled.where("label is not null").select("url", F.col("label").cast("double").alias("label"))
    sample = sample.orderBy(F.xxhash64("url"), "url", "label").limit(train_rows)
    sample = lexical(sites(sample, "label")).cache()
    n, blocks = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    found = sites(pages, "page_id")
    if 0 < blocks < n:
        prior = blocks / n
        suffixes = _rates(sample, prior)
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        fit = assemble.transform(_out_of_fold(sample, prior)).select("features", "label")
        model = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.3, seed=11).fit(fit)
        scored = model.transform(assemble.transform(_with_rates(lexical(found), suffixes, prior)))
        found = scored.withColumn("score", vector_to_array("probability")[1])
    else:
        found = found.withColumn("score", F.lit(float(n and blocks / n)))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    found = ruled(found.select("page_id", "host", "path", "score"), rules)
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.round("score", 6).alias("score"))


def weak_labels(pages: DataFrame, words: tuple = BLOCK_WORDS) -> DataFrame:
    """(url, label) from words in the host."""
    host = host_of(F.col("url"))
    hit = F.lit(False)
    for w in words:
        hit |= F.contains(host, F.lit(w))
    return pages.where("url is not null").select("url", hit.cast("int").alias("label"))
