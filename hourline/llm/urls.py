"""URL filters: host and path rules, and for the rest a logistic regression on hashed character n-grams.

The model is Spark ML's, fitted on a small labelled URL table (``labelled_urls()`` unless given); its features are the 3-
to 5-grams of ``^host$`` and of the path, hashed. All stays in the JVM. It knows themes by their words: of a theme that the
table lacks it blocks little.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the
end. A null url or one without ``://`` has both empty and is judged by the model like any other. A rule fits its host
and all subdomains if the path starts with the rule's path; the longest rule wins, of equal ones the first given.
Repeated rows are judged each, urls are read whole at any length, an empty table gives an empty one. Columns other than the
named are dropped.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourline.llm.common import let, local_table, table

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

# Everyday words of unwanted hosts by theme, words of hosts that inform, words of such hosts that hold pieces of
# unwanted ones, and words that stand in hosts of either kind.
UNWANTED = {
    "gambling": ("casino", "poker", "slots", "bets", "betting", "jackpot", "roulette", "gambling", "blackjack", "bingo", "lotto", "wager"),
    "medicines": ("pills", "viagra", "cialis", "pharma", "meds", "tablets", "steroids", "xanax", "tramadol", "diet-pill"),
    "adult": ("adult", "porn", "xxx", "sexy", "sexcam", "escort", "nude", "erotic", "fetish", "milf"),
    "advertising": ("ads", "adserver", "adtrack", "tracker", "adclick", "popunder", "affiliate", "adbanner", "adnetwork"),
    "spam": ("spam", "backlinks", "linkfarm", "freegift", "prizedraw", "clickbait", "bulkmail", "giveaway", "seo-links"),
    "piracy": ("warez", "crack", "keygen", "torrents", "serialz", "nulled", "cracked", "pirated", "fullrip"),
    "loans": ("payday", "quickcash", "fastloan", "cashadvance", "debtfix", "badcredit", "easyloan", "instantcash"),
    "malware": ("malware", "phishing", "trojan", "keylogger", "ransomware", "botnet", "spyware", "hacktool", "stealer"),
    "replicas": ("replica", "counterfeit", "knockoff", "fakeid", "fakewatch", "fakepassport"),
    "schemes": ("getrich", "ponzi", "moneymaker", "cryptodouble", "binaryoptions", "easymoney", "hyip"),
}
INFORMING = (
    "city", "library", "garden", "weather", "museum", "recipes", "history", "school", "harbour", "railway", "forest", "science", "music", "poetry",
    "compiler", "market", "health", "travel", "news", "press", "weekly", "times", "gazette", "field", "sports", "football", "cinema", "theatre",
    "bakery", "university", "college", "village", "river", "mountain", "bicycle", "software", "kitchen", "clinic", "hospital", "council", "parish",
    "law", "farm", "orchard", "hotel", "insurance", "bank", "docs", "wiki", "forum", "physics", "chess",
)
ALIKE = (
    "farmers", "hotels", "winnipeg", "trackandfield", "windows", "freedom", "freepress", "roads", "heads", "broads", "adsorption", "adulthood",
    "alphabets", "better", "essex", "sussex", "pharmacology", "medicine", "campus", "camshaft", "nutcracker", "crackers", "timeslots", "torrential",
    "serials", "seoul", "nobelprize", "specialist", "socialist", "caterpillars", "spills", "traffic", "banners", "popupbooks", "loanword", "credits",
    "hotline", "photos", "winter", "wine", "freelance", "discounting", "bonnet", "clicker", "tracking", "racetrack", "prizes", "sextant", "casimir",
    "pokemon", "stable", "wagner", "replication", "escorial", "nuance",
)
EITHER = (
    "online", "world", "shop", "club", "best", "my", "fast", "royale", "live", "download", "web", "hub", "zone", "direct", "home", "central", "24",
    "365", "super", "mega", "king", "star", "win", "free", "cheap", "bonus", "hot", "top", "discount", "deals", "pro", "group", "media", "x", "farm",
    "track", "buy", "new", "the", "one",
)
ONSETS, VOWELS, CODAS = ("", "b", "br", "d", "f", "g", "gr", "h", "k", "l", "m", "n", "p", "r", "s", "sh", "st", "t", "th", "v", "w"), ("a", "e", "i", "o", "u", "ea", "ou"), ("", "", "n", "r", "l", "s", "nt", "st", "th", "ng", "m", "d")
SECTIONS = ("", "en/", "de/", "fr/", "es/", "news/", "article/", "item/", "about/")
_SUBDOMAINS = ("", "www.", "blog.", "m.", "news.")
_DOMAINS = ("com", "net", "org", "biz", "info", "io", "example.com", "example.net", "example.org", "co.uk", "de")


def labelled_hosts() -> list[tuple[str, float, str, str]]:
    """Host, 1 if unwanted, theme and partner of the labelled table's hosts.

    A word stands alone, with words of its own theme, and before and behind fourteen words that stand in hosts of either kind,
    with and without a hyphen; so these partners tell nothing. Wanted words partner with each other, too, and there are
    4,000 made-up names of two to four syllables.
    """
    out = []

    def hosts(words: tuple[str, ...], label: float, theme: str, at: int) -> None:
        for i, w in enumerate(words):
            out.append((w, label, theme, ""))
            for j in range(14):
                p = EITHER[((i + at) * 7 + j * 3) % len(EITHER)]
                out.append(((f"{w}-{p}", f"{p}-{w}", f"{w}{p}", f"{p}{w}")[j % 4], label, theme, p))
            out.extend((f"{w}{'-' * (k % 2)}{words[(i + k) % len(words)]}", label, theme, "") for k in (1, 2, 3))

    for n, (theme, words) in enumerate(UNWANTED.items()):
        hosts(words, 1.0, theme, n)
    hosts(INFORMING, 0.0, "informing", 3)
    hosts(ALIKE, 0.0, "alike", 5)
    out.extend((f"{w}{'-' * (i % 2)}{INFORMING[(i * 5 + k) % len(INFORMING)]}", 0.0, "alike", "") for i, w in enumerate(ALIKE) for k in (0, 2))
    syllables = [o + v + c for o in ONSETS for v in VOWELS for c in CODAS]
    out.extend(("".join(syllables[(i * 7919 + k * (i + 3) * 104729) % len(syllables)] for k in range(2 + i % 3)), 0.0, "made up", "") for i in range(4000))
    return out


def labelled_urls(hosts: list[tuple[str, float, str, str]] | None = None) -> list[tuple[str, float]]:
    """The small labelled table: (url, 1 if unwanted).

    Subdomains, domains and paths are dealt to both classes alike, so that they tell nothing. Wanted hosts also stand with
    unwanted words in the path, which makes them unwanted.
    """
    hosts = labelled_hosts() if hosts is None else hosts
    path = lambda i: f"/{SECTIONS[i * 7 % 9]}{i * 7919 % 10007 if i % 4 else ''}"
    urls = [(f"https://{_SUBDOMAINS[i % 5]}{h}.{_DOMAINS[i // 5 % 11]}{path(i)}", label) for i, (h, label, _, _) in enumerate(hosts)]
    bad = sorted({h for h, label, _, partner in hosts if label and not partner})
    good = [h for h, label, _, _ in hosts if not label][::5]
    return urls + [(f"https://{h}.{_DOMAINS[i % 11]}{path(i).rstrip('/')}/{bad[i * 5 % len(bad)]}", 1.0) for i, h in enumerate(good) if bad]


DIM = 1 << 17


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(text: Column, mark: str, sizes: tuple[int, ...] = (3, 4, 5), piece: int = 256) -> Column:
    """The character n-grams of a string, each with a mark in front.

    Taken from overlapping pieces, since a substring is found by walking there from the start of its string.
    """
    def of(s: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1)))
        return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(s, i, n)))

    def all_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)), F.lit(piece))
        return F.flatten(F.transform(F.transform(starts, lambda i: F.substring(text, i, piece + n - 1)), lambda s: of(s, n)))

    return F.concat(*[all_of(n) for n in sizes])


def rule_of(host_col: Column, path_col: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host_col == at) | host_col.endswith(f".{at}")) & path_col.startswith(f"/{rest}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _featured(urls: DataFrame, dim: int) -> DataFrame:
    marked = urls.withColumn("tokens", F.concat(let(F.concat(F.lit("^"), F.col("host"), F.lit("$")), lambda h: grams(h, "h")), let(F.col("path"), lambda p: grams(p, "p"))))
    return HashingTF(inputCol="tokens", outputCol="features", numFeatures=dim).transform(marked).drop("tokens")


def fit(labelled: DataFrame, dim: int = DIM) -> LogisticRegressionModel:
    """The model of a labelled table of url and label (1 is block)."""
    known = labelled.select("label", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return LogisticRegression(regParam=1e-4, standardization=False, maxIter=60, probabilityCol="p", predictionCol="block").fit(_featured(known, dim).coalesce(1))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: DataFrame | None = None, dim: int = DIM, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of every row; labelled: url, label (1 is block)."""
    model = fit(labelled or local_table(pages.sparkSession, labelled_urls(), "url string, label double"), dim)
    model.setThreshold(threshold)
    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = model.transform(_featured(rows, dim)).withColumn("p_block", F.get(vector_to_array("p"), 1))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("block") == 1, "block").otherwise("allow")).alias("verdict"), "p_block")


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
