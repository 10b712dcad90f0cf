"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

Everything is DataFrame expressions. Statistics of host suffixes are learned from the labelled urls, a row's own label left out while
the trees learn. Training grows each level of a tree from one aggregation of gradients by node, feature and bin; what comes back is
bounded by nodes x features x bins. The trees are scored as nested conditions that Catalyst compiles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import staged


@dataclass(frozen=True)
class Rule:
    """A rule fits host, its subdomains, and paths that start with path. host may be a bare suffix such as com."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


RULES = (
    Rule("com", "en/", False), Rule("example.com", "en/7", True), Rule("net", "de/", True), Rule("example.net", "de/8", False),
    Rule("org", "es/", False),
)


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path, the path from its first slash on."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def matched(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule (host and path together) that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith("/" + r.path) for r in ordered]
    chain = lambda values: reduce(lambda c, x: c.when(*x), zip(fits[1:], values[1:], strict=True), F.when(fits[0], values[0]))
    return chain([F.lit(r.name) for r in ordered]), chain([F.lit("allow" if r.allow else "block") for r in ordered])


def lexical_features() -> dict[str, Column]:
    """Features of url, host and path: lengths, depth, digits, entropy, parameters and suffix."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")).cast("double")
    share = lambda a, n: a / F.greatest(F.lit(1.0), n)
    length = F.length(host).cast("double")
    chars = F.split(host, "")
    part = lambda c: F.size(F.filter(chars, lambda x: x == c)) / length
    entropy = F.when(length > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - part(c) * F.log2(part(c)))).otherwise(0.0)
    labels = F.size(F.split(host, r"\."))
    name = F.element_at(F.split(host, r"\."), -2)
    return {
        "url_length": F.length(url).cast("double"),
        "host_length": length,
        "path_length": F.length(path).cast("double"),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
        "digit_ratio": share(digits(url), F.length(url).cast("double")),
        "host_digits": digits(host),
        "hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
        "labels": labels.cast("double"),
        "entropy": entropy,
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "query_length": F.length(query).cast("double"),
        "https": url.startswith("https").cast("double"),
        "fragment": url.contains("#").cast("double"),
        "suffix_length": F.length(F.regexp_extract(host, r"([^.]*)$", 1)).cast("double"),
        "name_length": F.coalesce(F.length(F.when(labels > 1, name)), F.lit(0)).cast("double"),
        "first_length": F.length(F.regexp_extract(path, r"^/([^/]*)", 1)).cast("double"),
        "last_number": F.coalesce(F.regexp_extract(path, r"/([0-9]+)[^/0-9]*/?$", 1).try_cast("double"), F.lit(-1.0)),
    }


@dataclass
class Node:
    value: float = 0.0
    feature: str = ""
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def column(self) -> Column:
        if self.low is None:
            return F.lit(self.value)
        return F.when(F.col(self.feature) <= F.lit(self.cut), self.low.column()).otherwise(self.high.column())


@dataclass
class Boosted:
    base: float
    trees: list[Node] = field(default_factory=list)

    def logit(self) -> Column:
        return reduce(lambda a, b: a + b, [t.column() for t in self.trees], F.lit(self.base))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.logit()))


#: Endings of the host that statistics are learned of: its last label, and its last two.
SUFFIXES = {"suffix": 1, "site": 2}


def suffix(labels: int) -> Column:
    return F.substring_index("host", ".", -labels)


#: While the trees learn, a row's statistics come from the other folds of the labelled urls.
FOLDS = 4


def fold() -> Column:
    return F.pmod(F.xxhash64("url", F.lit(11)), F.lit(FOLDS)).cast("int")


@dataclass
class Suffixes:
    """How many labelled urls, and blocked ones, each ending has in each fold: tables of bounded size. mean: the share of blocked ones in
    all; weight: that it has in an ending's share."""

    tables: dict[str, DataFrame]
    mean: float
    weight: float = 10.0

    def rates(self, df: DataFrame, learning: bool = False) -> DataFrame:
        """df(url, host) with the smoothed share of blocked urls for each kind of ending; learning: less the row's own fold."""
        for kind, table in self.tables.items():
            ending = table.select(F.col(kind).alias("__e"), F.col("n").alias("__n"), F.col("y").alias("__y"))
            df = df.join(F.broadcast(ending), suffix(SUFFIXES[kind]) == F.col("__e"), "left")
            total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
            n, y = (F.coalesce(total(c) - (F.element_at(c, fold() + 1) if learning else F.lit(0.0)), F.lit(0.0)) for c in ("__n", "__y"))
            df = df.withColumn(f"{kind}_rate", (y + self.weight * self.mean) / (n + self.weight)).drop("__e", "__n", "__y")
        return df


def learn_suffixes(labelled: DataFrame, mean: float, most: int = 1000) -> Suffixes:
    """labelled(url, host, y). Of more endings than most, those with most urls are known; others have the mean."""
    tables = {}
    for kind, labels in SUFFIXES.items():
        by_fold = lambda c: F.array(*[F.sum(F.when(fold() == k, c).otherwise(0.0)) for k in range(FOLDS)])
        counts = labelled.groupBy(suffix(labels).alias(kind)).agg(by_fold(F.lit(1.0)).alias("n"), by_fold(F.col("y")).alias("y"), F.count(F.lit(1)).alias("all"))
        tables[kind] = staged(counts.orderBy(F.desc("all"), kind).limit(most), "url-endings")
    return Suffixes(tables, mean)


def train(labelled: DataFrame, names: list[str], trees: int = 8, depth: int = 3, bins: int = 16, rate: float = 0.4, ridge: float = 1.0) -> Boosted:
    """labelled(names..., y in 0, 1), of a bounded number of rows -> trees.

    Cuts are quantiles. Each level is one query; its rows are at most 2 ** depth x features x bins.
    """
    rows = labelled.select(*names, F.col("y").cast("double").alias("y")).persist()
    try:
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), *[F.percentile_approx(c, [i / bins for i in range(1, bins)], 1000).alias(c) for c in names]).first()
        if not total.n:
            return Boosted(0.0)
        mean = min(0.999, max(0.001, total.y / total.n))
        cuts = {c: sorted(set(total[c])) for c in names}
        model = Boosted(math.log(mean / (1 - mean)))
        # The bin of a value is the number of cuts below it.
        below = lambda c: reduce(lambda a, b: a + b, [(F.col(c) > F.lit(float(x))).cast("int") for x in cuts[c]], F.lit(0))
        binned = rows.select("y", *names, *[below(c).alias("bin_" + c) for c in names]).persist()
        for _ in range(trees):
            p = model.probability()
            root = Node()
            for _ in range(depth):
                stats = binned.select(
                    leaf_numbers(root).alias("leaf"), (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"),
                    F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col("bin_" + c).alias("b")) for i, c in enumerate(names)])).alias("x"),
                ).groupBy("leaf", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
                if not grow(root, stats, names, cuts, rate, ridge):
                    break
            model.trees.append(root)
            if root.low is None and abs(root.value) < 1e-9:
                break
        binned.unpersist()
        return model
    finally:
        rows.unpersist()


def all_leaves(node: Node) -> list[Node]:
    return [node] if node.low is None else all_leaves(node.low) + all_leaves(node.high)


def leaf_numbers(root: Node) -> Column:
    number = {id(x): i for i, x in enumerate(all_leaves(root))}

    def column(node: Node) -> Column:
        if node.low is None:
            return F.lit(number[id(node)])
        return F.when(F.col(node.feature) <= F.lit(node.cut), column(node.low)).otherwise(column(node.high))

    return column(root)


def grow(root: Node, stats: list, names: list[str], cuts: dict[str, list], rate: float, ridge: float) -> list[Node]:
    """Splits each leaf where the gain is largest, and sets leaves' values. Returns the leaves that were split."""
    leaves = all_leaves(root)
    by: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
    for r in stats:
        by.setdefault((r.leaf, r.f), {})[r.b] = (r.g, r.h)
    gain_of = lambda g, h: g * g / (h + ridge)
    split = []
    for i, leaf in enumerate(leaves):
        if (i, 0) not in by:
            continue
        g, h = (sum(x[k] for x in by[i, 0].values()) for k in (0, 1))
        leaf.value = rate * g / (h + ridge)
        best = (1e-6 * (1 + h), None)
        for f, c in enumerate(names):
            a = b = 0.0
            for k, cut in enumerate(cuts[c]):
                x, y = by[i, f].get(k, (0.0, 0.0))
                a, b = a + x, b + y
                gain = gain_of(a, b) + gain_of(g - a, h - b) - gain_of(g, h)
                if b > 0.5 and h - b > 0.5 and gain > best[0]:
                    best = (gain, (c, cut, a, b))
        if best[1]:
            c, cut, a, b = best[1]
            leaf.feature, leaf.cut = c, float(cut)
            leaf.low, leaf.high = Node(rate * a / (b + ridge)), Node(rate * (g - a) / (h - b + ridge))
            split.append(leaf)
    return split


def sampled(labelled: DataFrame, sample: int, *keys: str) -> DataFrame:
    """About sample rows of labelled at most, those with the lowest hashes of keys: a filter, so no task gathers them."""
    n = labelled.count()
    return labelled if n <= sample else labelled.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int(sample / n * (1 << 40)))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None, threshold: float = 0.5, sample: int = 100_000, folds: int = 5) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, score (probability of block), held_out.

    The rule's verdict holds where one fits; else the trees'. labelled(url, y: 1 for block) trains them; without it the urls that
    a rule decides are the labelled ones. One in folds urls, by hash, is held out of training, so that scores of those tell how well
    the trees do. sample bounds the labelled rows that are learned from (about so many are taken by the hash of url and page_id);
    statistics of suffixes come from the same rows.

    Null and empty urls, and those without ://, have an empty host and path, fit no rule, and are scored by the same trees; a null
    url is not held out. Repeated rows are each judged, equal urls alike. Very long urls are judged whole. An empty table trains nothing
    and gives no rows; other columns are not read. No shuffle but in training.
    """
    features = lexical_features()
    rule, verdict = matched(rules)
    held_out = F.coalesce(F.pmod(F.xxhash64("url", F.lit(7)), F.lit(folds)) == 0, F.lit(False)) & F.col("url").isNotNull()
    parts = with_parts(pages.select("page_id", "url")).withColumns({"rule": rule, "ruled": verdict, "held_out": held_out})
    if labelled is None:
        known = parts.where("ruled is not null").withColumn("y", (F.col("ruled") == "block").cast("double"))
    else:
        known = with_parts(labelled.select("url", F.col("y").cast("double").alias("y"), F.lit(None).cast("long").alias("page_id"))).withColumn("held_out", held_out)
    known = staged(sampled(known.where(~F.col("held_out")).select("url", "page_id", "host", "path", "y"), sample, "url", "page_id"), "labelled-urls")
    mean = known.agg(F.avg("y")).first()[0]
    endings = learn_suffixes(known, 0.5 if mean is None else mean)
    names = [*features, *[f"{k}_rate" for k in SUFFIXES]]
    model = train(endings.rates(known, learning=True).select("y", *[c.alias(n) for n, c in features.items()], *names[len(features) :]), names)
    used = {n for t in model.trees for n in names_in(t)}
    scored = endings.rates(parts).withColumns({n: c for n, c in features.items() if n in used}).withColumn("score", model.probability())
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score", "held_out")


def names_in(node: Node) -> set[str]:
    return set() if node.low is None else {node.feature} | names_in(node.low) | names_in(node.high)
