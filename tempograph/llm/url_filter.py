"""URL filter: host and path rules, and a logistic regression on hashed character n-grams for all other URLs.

The regression is fitted by gradient descent on a small labelled URL table (at most MAX_LABELLED rows reach the driver); its
features are made by the same Catalyst expressions that score the pages. Scoring is a projection: n-grams of the host and of the
path are hashed into BUCKETS weights, which are a literal of the plan. No shuffle, no Python.

A null url, or one without ://, has an empty host and path and is scored like any other (by the bias alone). A null page_id is
passed on; repeated rows give equal rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .quality_rules import let

#: Rules: (rule, verdict); host up to the first slash.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Buckets of n-grams, labelled rows at most, and lengths of n-grams.
BUCKETS, MAX_LABELLED, WIDTHS = 1 << 15, 5000, (3, 4, 5)
#: Words of the labelled table by subject; the first table's subjects are blocked, the second's allowed.
BAD = {
    "gambling": "casino gamble gambling poker slots roulette betting bets wager jackpot lotto lottery bookmaker blackjack",
    "adult": "porn porno xxx sex sexy nude naked escort hookup hardcore adult webcam erotic fetish",
    "pharmacy": "viagra cialis pills pharma tramadol xanax steroids slimming weightloss painkiller",
    "credit": "payday loans cashadvance fastcash quickloan debtfree instantcredit getrich forex binaryoption",
    "piracy": "torrent warez keygen crack cracked nulled serialkey freemovies fullmovie streamrip",
    "fraud": "replica fakewatch spam phishing malware clickbait giveaway freeprize winner claimnow",
    "ads": "ads adserver adclick tracker tracking popunder popup banner affiliate redirect",
}
GOOD = {
    "learning": "school university academy college library education lecture course tutorial textbook student",
    "news": "news journal magazine gazette weather daily report press editorial bulletin",
    "science": "science research physics biology chemistry astronomy geology laboratory archive statistics",
    "public": "city council government museum hospital parliament ministry police court embassy",
    "home": "garden kitchen recipes bakery furniture carpenter painting plumbing family cooking",
    "leisure": "travel music cinema theatre football bicycle hiking camera camping festival",
    "technology": "software computer network database hardware developer engineering robotics electronics internet",
    "nature": "forest river mountain ocean animals flowers climate energy farming harvest",
    "trade": "market insurance accounting transport logistics consulting factory printing textile packaging",
}
#: How two words of a subject, or a word and one that says nothing, make a name.
NAMES = ["{0}{1}", "{0}-{1}", "{0}-{2}", "{2}-{0}", "my{0}{2}", "{0}{2}", "the-{0}", "{0}24", "{2}{0}", "{0}-{2}-{1}", "{0}-{3}", "{3}-{0}", "{0}{3}", "{3}{0}", "{3}-{0}-{2}", "{0}"]
NEUTRAL = "shop online top world hub zone club store site plus pro direct live center place point base house group team".split()
#: How URLs go on: by subjects of either kind, or so that nothing is said.
PATHS = {1: ["/bonus/free-spins", "/signup/vip-offer", "/buy-now/discount-pack", "/click/out/9", "/download-full-free", "/hot-videos/12", "/win/claim", "/cheap/order-online"], 0: ["/about/history", "/articles/2024/03/report-9", "/docs/manual.html", "/courses/intro", "/events/calendar", "/research/papers/7", "/contact/staff", "/exhibition/opening-hours"]}
PLAIN = ["", "/", "/index.html", "/en/12", "/de/345.html", "/fr/88#top", "/es/7?page=2", "/item/4/"]


#: Invented names among the allowed ones: what no word speaks against is allowed.
INVENTED, SEED = 200, 23


def invented(words: list[str], n: int = INVENTED, seed: int = SEED) -> list[str]:
    """Names whose letters follow each other as in the words, two by two."""
    rng, after = np.random.default_rng(seed), {}
    for w in words:
        for a, b in zip("^" + w, w + "$"):
            after.setdefault(a, []).append(b)
    out: list[str] = []
    while len(out) < n:
        name, at = "", "^"
        while len(name) < 14 and (at := after[at][rng.integers(len(after[at]))]) != "$":
            name += at
        if len(name) >= 5:
            out.append(name)
    return out


def labelled_urls(spark: SparkSession, bad: dict[str, str] = BAD, good: dict[str, str] = GOOD) -> DataFrame:
    """url, label (1: block), word: each word in all forms of names, with other words of its subject; ends of hosts say nothing, and of the paths every second."""
    rows = []
    for label, subjects in ((1, bad), (0, good)):
        for words in map(str.split, subjects.values()):
            for i, word in enumerate(words):
                for k, form in enumerate(NAMES):
                    other, *neutral = words[(i + 1 + k * 2) % len(words)], *(NEUTRAL[(a * i + b * k) % len(NEUTRAL)] for a, b in ((7, 3), (11, 9)))
                    front, end = ("", "www.", "m.", "blog.")[(i + k) % 4], ("com", "net", "org", "example.com", "example.org")[(i + 2 * k) % 5]
                    path = PATHS[label][(i + k) % len(PATHS[label])] if (i + k) % 2 else PLAIN[(3 * i + k) % len(PLAIN)]
                    rows.append((f"https://{front}{form.format(word, other, *neutral)}.{end}{path}", label, word))
    for i, name in enumerate(invented([w for words in good.values() for w in words.split()]) if good else []):
        rows.append((f"https://{('', 'www.', 'm.', 'blog.')[i % 4]}{name}.{('com', 'net', 'org', 'example.com', 'example.org')[i % 5]}{PLAIN[i % len(PLAIN)]}", 0, name))
    return spark.createDataFrame(rows, "url string, label int, word string")


def with_parts(df: DataFrame) -> DataFrame:
    """df with host and path of url."""
    at = F.instr(F.col("url"), "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    df = df.withColumn("rest", F.coalesce(rest, F.lit("")))
    upper = "".join(map(chr, range(65, 91)))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    after = F.expr("substring(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1)")
    return df.withColumn("host", F.translate(host, upper, upper.lower())).withColumn("path", F.regexp_extract(after, r"^[^?#]*", 0)).drop("rest")


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of the host and, apart from these, of the path."""

    def of_width(t: Column, n: int) -> Column:
        places = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(t, i, F.lit(n)))

    def grams(t: Column) -> Column:
        return F.concat(*[of_width(t, n) for n in WIDTHS])

    bucket = lambda g: (F.crc32(g.cast("binary")) % BUCKETS).cast("int")
    of_host = let(F.concat(F.lit("^"), F.regexp_replace(host, r"^www\.", ""), F.lit("$")), grams)
    of_path = let(F.concat(F.regexp_replace(path, "[0-9]+", "0"), F.lit("$")), grams)
    return F.array_distinct(F.concat(F.transform(of_host, bucket), F.transform(of_path, lambda g: bucket(F.concat(F.lit("\t"), g)))))


def fit(labelled: DataFrame, rounds: int = 200, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of the buckets and bias of the logistic regression, by AdaGrad steps over all labelled rows."""
    rows = with_parts(labelled).select("url", "label", features(F.col("host"), F.col("path")).alias("f")).orderBy("url", "label").limit(MAX_LABELLED).collect()
    w, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return w, bias
    n = np.array([len(f) for _, _, f in rows])
    used, place = np.unique(np.array([i for _, _, f in rows for i in f], int), return_inverse=True)
    of = np.repeat(np.arange(len(rows)), n)
    y, own, seen = np.array([float(label) for _, label, _ in rows]), np.zeros(len(used)), np.full(len(used), 1e-12)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))  # both labels count the same
    for _ in range(rounds):
        d = weight * (y - 1 / (1 + np.exp(-(bias + np.bincount(of, own[place], len(rows))))))
        bias += rate * d.mean()
        step = np.bincount(place, d[of], len(used)) / len(rows) - decay * own
        seen += step**2
        own += rate * step / np.sqrt(seen)
    w[used] = own
    return w, float(bias)


def rule_of(host: Column, path: Column, rules: list) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        its_host, _, its_path = name.partition("/")
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith("/" + its_path)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: list = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of block by the regression)."""
    weights, bias = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    table = F.lit(weights)  # one literal of BUCKETS numbers
    df = with_parts(pages.select("page_id", F.col("url").cast("string").alias("url"))).withColumn("f", features(F.col("host"), F.col("path")))
    logit = bias + F.aggregate("f", F.lit(0.0), lambda s, i: s + F.get(table, i))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.withColumn("score", 1 / (1 + F.exp(-logit))).withColumn("rule", rule)
    return df.withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))
