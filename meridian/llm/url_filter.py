"""URL filters: rules by host and path, and logistic regression on hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import by_bytes, table

BUCKETS, SIZES = 1 << 15, (3, 4, 5)
#: Bytes of hosts, and of paths, that a task scores at a time: n-grams take some hundred times that.
BATCH_BYTES = 1 << 18
#: Fixed values. Rules as (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Fixed values. The labelled URL table that the model is trained from: words of hosts and paths by label.
#: They are of general kinds, written without looking at any pages that are to be judged.
BLOCKED_URLS = (
    "royal-casino.net/play/roulette", "casino-bonus-club.com/free-spins", "online-casino-vip.org/slots/jackpot", "bestcasinos.info/no-deposit-bonus", "luckyslots.biz/jackpot", "megaslots777.com/spin", "vegas-poker-room.com/texas-holdem",
    "pokerbonuses.net/freeroll", "bet-sports-now.com/odds/football", "betting-tips-pro.net/sure-win", "free-bets-daily.com/bookmakers", "lottery-results-winner.info/claim-prize", "bingo-cash.com/join", "blackjack-strategy.biz/play-for-money",
    "xxx-tube-videos.com/watch/2231", "free-porn-clips.net/category/amateur", "hot-adult-cams.com/live", "adult-dating-tonight.com/register", "sexy-webcam-girls.net/chat", "nude-celebs-pics.com/gallery", "escort-service-city.com/girls", "milf-hookups.net/join",
    "cheap-viagra-online.com/order", "buy-cialis-generic.net/no-prescription", "discount-pharmacy-meds.com/pills", "online-pills-shop.biz/buy-xanax", "weight-loss-miracle.com/diet-pills", "male-enhancement-pills.org/buy-now", "canadian-drugstore-rx.com/order-tramadol",
    "payday-loan-fast.com/apply-now", "instant-cash-loans.net/bad-credit", "debt-relief-quick.com/consolidate", "replica-rolex-watches.com/buy", "fake-designer-bags.net/outlet", "cheap-seo-backlinks.net/buy-links", "buy-twitter-followers.com/instagram-likes",
    "crack-keygen-download.com/serial", "warez-full-version.net/torrent", "free-movie-torrents.org/download", "hacked-accounts-dump.com/leak", "secure-login-verify-account.com/update", "paypal-account-confirm.net/signin", "bank-alert-verify.info/password",
    "win-free-iphone.com/survey", "claim-your-gift-card.net/winner", "you-are-the-winner.biz/prize", "get-rich-quick-now.com/make-money", "bitcoin-doubler.io/invest", "crypto-profit-robot.com/signup", "forex-signals-guaranteed.com/profit",
    "ad-tracker-network.com/pixel", "click-ads-server.net/banner", "popunder-ads.com/redirect", "tracking-pixel-ads.net/click", "spam-mailer-bulk.com/send", "spammy-link-directory.info/submit", "malware-download.net/setup.exe", "free-registry-cleaner.com/install.exe",
)
ALLOWED_URLS = (
    "docs.python.org/3/library/re.html", "en.wikipedia.org/wiki/History_of_science", "news.bbc.co.uk/2/hi/europe/1234567.stm", "www.nasa.gov/missions/mars", "www.gutenberg.org/ebooks/1342", "library.university.edu/catalog/book/12", "www.school.edu/courses/math",
    "research.institute.org/papers/2020.pdf", "github.com/project/readme", "forum.linux.org/thread/882", "www.cooking-recipes.com/soup/tomato", "travel.guide.com/cities/paris", "weather.service.gov/forecast/today", "www.museum-of-art.org/exhibitions",
    "health.gov/vaccines/info", "www.city.gov/services/permits", "law.review.edu/articles/17", "www.bookshop.com/item/9921", "sports.daily.com/football/results", "music.review.net/albums/2019", "garden.tips.net/roses/pruning", "history.archive.org/letters/1890",
    "science.magazine.com/physics/quantum", "blog.author.net/2015/03/post", "www.company.com/about/team", "support.software.com/faq/install", "maps.city.org/streets/main", "film.critic.com/reviews/drama", "www.theater.org/program", "www.railways.co.uk/timetable/london",
    "astronomy.club.org/meetings", "birdwatching.net/species/heron", "chess.openings.info/sicilian", "www.knitting-patterns.com/scarf", "bicycle.repair.net/brakes", "www.hospital.org/departments/cardiology", "opera.house.at/spielplan", "www.zeitung.de/politik/artikel/42",
    "lemonde.fr/culture/article/2019", "elpais.es/internacional/2018", "www.bundestag.de/dokumente", "bibliotheque.fr/livres/881", "biblioteca.es/libros/33", "universitaet.de/studium/physik", "www.ayuntamiento.es/servicios", "mairie.fr/demarches",
    "harbor.example.org/en/page/2", "notes.meadow.info/fr/7712", "www.riverstone.net/de/4410.html", "kettle.info/es/2218.html", "lantern.net/en/733", "m.orchard.info/fr/1402?page=3", "blog.willow.net/de/31009.html", "www.pebble.org/es/187/", "cinder.info/en/17203/", "maple.net/fr/9021.html",
)


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[\s\S]*?://([\s\S]*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[\s\S]*?://([\s\S]*)$", 1)
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram of the texts' UTF-8 bytes, in numpy over the whole batch."""
    parts = [b"^" + t.encode("utf-8", "replace") + b"$" for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    rows, buckets = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + data[k : len(data) - n + 1 + k]
        h ^= h >> np.uint64(31)
        inside = of[: len(h)] == of[n - 1 :]
        rows.append(of[: len(h)][inside])
        buckets.append((h[inside] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *buckets])


def train(blocked=BLOCKED_URLS, allowed=ALLOWED_URLS, rounds: int = 400, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Weights by bucket, the bias last; full-batch gradient descent on a small table, n-grams averaged by URL."""
    texts = [*blocked, *allowed]
    y = np.array([1.0] * len(blocked) + [0.0] * len(allowed))
    x = np.zeros((len(texts), BUCKETS + 1))
    np.add.at(x, grams(texts), 1.0)
    x[:, :-1] /= np.sqrt(np.maximum(x[:, :-1].sum(axis=1, keepdims=True), 1))
    x[:, -1] = 1
    w = np.zeros(BUCKETS + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= rate * (x.T @ (p - y) / len(y) + decay * w)
    return w


def scores(texts: list[str], w: np.ndarray) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    rows, buckets = grams(texts)
    total = np.bincount(rows, w[buckets], minlength=len(texts))
    n = np.bincount(rows, minlength=len(texts))
    return 1 / (1 + np.exp(-(total / np.sqrt(np.maximum(n, 1)) + w[-1])))


def filter_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    weights: np.ndarray | None = None,
    block_at: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, score) of each url.

    The longest rule that fits decides (host and all its subdomains, path by prefix); without one the model blocks
    at a score of block_at. Host: after the first ://, up to /, ? or #, A-Z lower-cased; path: from there up to ?
    or #. Null urls and urls without :// have both empty, no rule, and the model's score of the empty text; long
    urls are read whole. Repeated rows are judged each; other columns are ignored; an empty table gives no rows.
    A narrow job over the two columns; rules and weights (bounded by BUCKETS) go to the tasks.
    """
    weights = (train() if weights is None else weights).astype(np.float64)

    def run(batches):
        for batch in batches:
            for part in (y for x in by_bytes(batch, 1, BATCH_BYTES) for y in by_bytes(x, 2, BATCH_BYTES)):
                hosts, paths = part.column(1).to_pylist(), part.column(2).to_pylist()
                s = scores([h + p for h, p in zip(hosts, paths, strict=True)], weights)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, "score"])

    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, said = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    url = F.coalesce(F.col(url_col), F.lit(""))
    parsed = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    scored = parsed.mapInArrow(run, f"id {pages.schema[id_col].dataType.simpleString()}, host string, path string, score double")
    judged = scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(said, F.when(F.col("score") >= block_at, "block").otherwise("allow")))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "score")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return filter_urls(table(spark, sf_dir, "pages"))
