"""URL verdicts by stated rules, and by logistic regression on hashed n-grams; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.llm.common import fresh_name

#: Lengths of n-grams, and hashed features.
SIZES, FEATURES = (3, 4, 5), 1 << 15
#: Weight of the squared coefficients when fitting.
REGULARISATION = 0.001

# The rules of the registered query (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

# The small labelled table that the registered query learns from is made of these words by `labelled_urls`.
UNWANTED = (
    "porn xxx sex nude erotic escort camgirl hentai milf fetish stripper webcam casino poker roulette "
    "blackjack jackpot slots betting bookmaker gambling bingo lottery viagra cialis xanax steroid pharmacy "
    "pills payday loans replica backlink spam warez keygen cracked torrent adserver adclick popunder "
    "clickbait doubler giveaway adult bets affiliate sexcam spambot gambler"
).split()
# Everyday words, and words that share letters with unwanted ones.
WANTED = (
    "news library docs wiki archive school museum weather science history travel recipes garden "
    "music gazette courier review research university hospital council railway theatre chess "
    "nature physics poetry kitchen village harbour mountain river forest bakery cinema painting "
    "football cycling biology geology economics parliament cathedral mathematics insurance "
    "contact about products support calendar members gallery download index article post "
    "essex analysis specialist therapist pillar alphabet diabetes timetable racetrack address admin "
    "farmers window winter cashmere popcorn acorn unicorn sextant poetic sloth plots camera campus "
    "betterment tourists torrential spanish loaned casing casual escarpment bookshop bookkeeper lottie "
    "corner pokemon steroscope pharmacology clicker giving cracker server router exchange"
).split()
#: Words that stand beside either kind, so that they say nothing.
_BESIDE = "online best free cheap hot live top royal club hub world city zone now my 24 365 shop".split()
_TAILS = "com net org info tv io ru de biz xyz".split()


def _names(word: str, at: int) -> list[str]:
    """A word alone, and with some others before and after it, joined and hyphenated."""
    beside = [_BESIDE[(at * 5 + step) % len(_BESIDE)] for step in range(4)]
    return [word, beside[0] + word, word + beside[1], f"{beside[2]}-{word}", f"{word}-{beside[3]}", f"{word}{at % 9 + 1}"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 for addresses to block. A word's names stand in short and long hosts, and in paths of
    hosts that say nothing; both kinds have the same endings, languages and numbers."""
    rows = []
    for label, words in ((1.0, UNWANTED), (0.0, WANTED)):
        for at, word in enumerate(words):
            for nth, name in enumerate(_names(word, at)):
                tail, other = (_TAILS[(at + nth * step) % len(_TAILS)] for step in (1, 3))
                neutral = f"site{at % 7}.example.{other}"
                rows += [
                    (f"http://{name}.{tail}/", label),
                    (f"https://www.{name}.example.{other}/en/{1000 + at}", label),
                    (f"https://{neutral}/{name}", label),
                    (f"http://m.{neutral}/2021/{name}.html?page=2", label),
                ]
    return spark.createDataFrame(rows, "url string, label double")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _ngrams(mark: str, part: Column, size: int) -> Column:
    """n-grams of a part, marked by whose they are; a shorter part has none."""
    ended = F.concat(F.lit("^"), part, F.lit("$"))
    count = F.length(ended) - size + 1
    places = F.when((F.length(part) > 0) & (count >= 1), F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda at: F.concat(F.lit(mark), F.substr(ended, at, F.lit(size))))


def _featured(urls: DataFrame, host: Column, path: Column, into: str) -> DataFrame:
    grams = F.concat(*[_ngrams(m, p, n) for m, p in (("h:", host), ("p:", path)) for n in SIZES])
    names = f"{into}_grams"
    hashing = HashingTF(inputCol=names, outputCol=into, numFeatures=FEATURES, binary=True)
    return hashing.transform(urls.withColumn(names, grams)).drop(names)


def train(labelled: DataFrame, url: str = "url", label: str = "label") -> LogisticRegressionModel:
    """Logistic regression on a small labelled table: label 1 blocks; other labels and NULLs are left out.

    The table is small by contract, so it is fitted in one partition, which also makes the
    model the same every time. Both labels weigh the same, however many rows each has.
    """
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        F.col(url).alias("url"), F.col(label).cast("double").alias("label")
    )
    rows = rows.coalesce(1).sortWithinPartitions("label", "url")
    count = rows.agg(F.count("*").alias("all"), F.sum("label").alias("blocked")).first()
    own = F.when(F.col("label") == 1, F.lit(count["blocked"] or 0.0)).otherwise(F.lit(count["all"] - (count["blocked"] or 0.0)))
    featured = _featured(rows, host_of(F.col("url")), path_of(F.col("url")), "features").withColumn("weight", 1 / own)
    regression = LogisticRegression(regParam=REGULARISATION, maxIter=50, standardization=False, weightCol="weight")
    return regression.fit(featured.select("features", "label", "weight"))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else NULL.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    Rules are a short stated list, so they are one expression and not a join.
    """
    longest_first = sorted(rules, key=lambda r: -len(r[1]))
    fitting = []
    for verdict, rule in longest_first:
        own_host, slash, rest = rule.partition("/")
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(slash + rest)
        fitting.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fitting) if fitting else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge(
    urls: DataFrame, model: LogisticRegressionModel, rules: Sequence[tuple[str, str]] = RULES, url: str = "url"
) -> DataFrame:
    """All columns of `urls`, and `host`, `path`, `rule`, `verdict` and `score` (the model's, of blocking).

    A taken name gets an underscore. A NULL url or one without `://` has an empty host and
    path, no rule, and the model's verdict on nothing. Repeated rows are judged alike.
    """
    host, path, rule, verdict, score = (fresh_name(urls, n) for n in ("host", "path", "rule", "verdict", "score"))
    fitting, features = fresh_name(urls, "fitting"), fresh_name(urls, "features")
    parts = urls.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    featured = _featured(parts, F.col(host), F.col(path), features)
    scorer = model.copy().setFeaturesCol(features).setPredictionCol("").setRawPredictionCol("")
    probability = fresh_name(urls, "probability")
    scored = scorer.setProbabilityCol(probability).transform(featured)
    block = F.when(F.col(score) >= 0.5, "block").otherwise("allow")
    return (
        scored.withColumn(score, vector_to_array(F.col(probability))[1])
        .withColumn(fitting, rule_for(F.col(host), F.col(path), rules))
        .withColumns({rule: F.col(fitting)["rule"], verdict: F.coalesce(F.col(fitting)["verdict"], block)})
        .select(*urls.columns, host, path, rule, verdict, score)
    )
