"""URL filter: path rules first, then logistic regression on hashed character n-grams.

The classifier is trained on the driver from a small labelled URL table (by default LABELLED) and
scores host and path; its weights are one array of `buckets` doubles, whatever the input.

Defined results: a null url or one without '://' has an empty host and path, no rule, and the
classifier's verdict on the empty string, which is its verdict without evidence: allow, by the default
table; repeated rows are answered alike; an empty table gives an
empty result. Only page_id and url are read, so extra columns cannot clash.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import arrow_schema, in_batches

#: The contract's rules (host and path prefix, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Hosts of well-known ordinary sites, and of sites that public filter lists block (gambling, adult, advertising
#: and tracking, piracy, drugs, spam and fraud).
_KNOWN = "wikipedia.org stackoverflow.com github.com nytimes.com bbc.co.uk theguardian.com washingtonpost.com reuters.com elpais.com lemonde.fr spiegel.de zeit.de corriere.it asahi.com cnn.com npr.org nature.com science.org arxiv.org nih.gov nasa.gov who.int europa.eu un.org mit.edu stanford.edu ox.ac.uk harvard.edu python.org apache.org mozilla.org kernel.org debian.org w3.org ietf.org microsoft.com apple.com google.com amazon.com ebay.com etsy.com ikea.com walmart.com target.com nike.com lego.com spamhaus.org booking.com airbnb.com tripadvisor.com expedia.com lufthansa.com deutschebahn.com bahn.de sncf.fr maersk.com dhl.com fedex.com ups.com paypal.com visa.com hsbc.co.uk barclays.co.uk allianz.de axa.fr imdb.com rottentomatoes.com spotify.com soundcloud.com vimeo.com youtube.com netflix.com twitch.tv reddit.com quora.com medium.com wordpress.com blogspot.com tumblr.com pinterest.com flickr.com linkedin.com twitter.com facebook.com instagram.com whatsapp.com slack.com zoom.us dropbox.com adobe.com oracle.com ibm.com intel.com samsung.com sony.com siemens.com bosch.de basf.com bayer.com pfizer.com mayoclinic.org webmd.com healthline.com goodreads.com gutenberg.org archive.org britannica.com merriam-webster.com khanacademy.org coursera.org edx.org duolingo.com allrecipes.com epicurious.com bonappetit.com espn.com fifa.com uefa.com nba.com olympics.com chess.com weather.com accuweather.com zillow.com craigslist.org indeed.com glassdoor.com"
_LISTED = "bet365.com betfair.com betway.com bwin.com unibet.com paddypower.com williamhill.com ladbrokes.com 888casino.com casino.com mrgreen-casino.com leovegas-casino.com royalcasino.net onlinecasino.de slotomania.com freeslots.com pokerstars.com partypoker.com fulltiltpoker.com roulette77.us jackpotcity.com lottoland.com sportsbetting.ag freebets.com oddschecker-bets.net pornhub.com xvideos.com xnxx.com xhamster.com youporn.com redtube.com adultfriendfinder.com adultwork.com adult-empire.com livejasmin.com chaturbate.com camsoda.com escortdirectory.com eros-escorts.com sexshop69.com freesexcams.net nudevista.com doubleclick.net adnxs.com adsrvr.org adform.net adroll.com adcolony.com ads-twitter.com googleadservices.com amazon-adsystem.com serving-sys.com outbrain-ads.com popads.net propellerads.com exoclick.com trafficjunky.net adserver.org adtracker.com tracking202.com clicktracker.net scorecardresearch.com quantserve-tracking.com statcounter-track.net thepiratebay.org 1337x-torrents.to kickasstorrents.cr rarbg-torrent.net warez-bb.org crackwatch.net keygenguru.com serialz-keygen.net viagra-online.com buycialis.net rxpills.com dietpills.org pills24.biz steroids4u.net replicawatches.ru spamlists.info spambot.biz spamgang.biz bulkspam.ru spam4u.net spam-offers.info webspam.net phishingkit.net getrichquick.biz paydayloans247.com quickcash-loans.net malwarehub.net clickbait24.info"
#: Words of the same kinds of listed sites.
_WORDS = "casino poker roulette jackpot blackjack betting gambling lottery porn xxx sexcams escort erotic adult viagra cialis pills steroids adserver ads adclick popunder tracking clickbait malware trojan spyware phishing keylogger scam spam payday warez torrent keygen pirated"
_BOTH = "best top free online my the new world club hub zone store shop center home now live land point win pro mega city euro"
_TOP = ("com", "net", "info", "biz", "de", "co.uk", "fr", "io")
_PATHS = ("/", "/index.html", "/en/%d", "/de/%d", "/fr/%d", "/es/%d", "/about", "/login", "/2024/05/%d", "/shop/item-%d.html", "/category/page/%d", "/p?id=%d")


def labelled_urls(seed: int = 11) -> list[tuple[str, int]]:
    """The default small labelled table: (url, 1 to block).

    Known hosts of either kind and words of listed ones, as they are and with another ending, a subdomain, or a common
    or invented word beside their name; twice as many invented names, since a name that means nothing is no ground to block. All have the
    same endings, subdomains and paths.
    """
    rng = random.Random(seed)
    both = _BOTH.split()

    def invented() -> str:
        said = "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice(("a", "e", "i", "o", "u", "ea", "ou", "an", "er", "in")) for _ in range(rng.randint(2, 4)))
        return said + rng.choice(("", "", "s", "n", f"-{rng.choice(both)}"))

    def varied(host: str) -> str:
        name = host.partition(".")[0]
        whole = host if "." in host else f"{host}.{rng.choice(_TOP)}"
        return rng.choice((whole, f"{name}{invented()}.{rng.choice(_TOP)}", f"{name}.{rng.choice(_TOP)}", f"{name}-{rng.choice(both)}.{rng.choice(_TOP)}", f"{rng.choice(both)}{rng.choice(('', '-'))}{name}.{rng.choice(_TOP)}", f"{name}.{invented()}.{rng.choice(_TOP)}"))

    def url(host: str) -> str:
        sub = rng.choice(("", "", "www.", "m.", "blog.", "cdn."))
        return f"http{rng.choice(('', 's'))}://{sub}{host}{rng.choice(_PATHS).replace('%d', str(rng.randint(1, 9999)))}"

    listed, known = [*_LISTED.split(), *_WORDS.split()], _KNOWN.split()
    rows = [(url(varied(host)), label) for hosts, label in ((listed, 1), (known, 0)) for host in hosts for _ in range(12)]
    return rows + [(url(f"{invented()}.{rng.choice(_TOP)}"), 0) for _ in range(24 * len(listed))]


_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def rule_for(host: str, path: str, rules: Sequence[tuple[str, str]]) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict."""
    best: tuple[str | None, str | None] = (None, None)
    for rule, verdict in rules:
        of, slash, rest = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith(slash + rest) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return best


class UrlModel:
    """Logistic regression on hashed n-grams (3 to 5 characters) of the host's labels and of the path.

    Host and path are scaled apart: the host's n-grams by a constant, so that further labels take nothing from
    what one says, the path's by their number and less, so that it takes many labelled paths to outweigh a host.
    """

    def __init__(self, labelled: Sequence[tuple[str, int]], buckets: int = 1 << 16, steps: int = 400, decay: float = 6e-5):
        self.buckets = buckets
        rows = [(*self.features(*split_url(url)), label) for url, label in labelled]
        labels = np.array([y for _, _, y in rows], float)
        which = np.repeat(np.arange(len(rows)), [len(x) for x, _, _ in rows])
        flat, size = (np.concatenate([x[k] for x in rows]) if rows else np.zeros(0) for k in (0, 1))
        flat = flat.astype(np.int64)

        def times(weights: np.ndarray) -> np.ndarray:
            return np.bincount(which, weights[flat] * size, len(rows)) + weights[-1]

        def back(values: np.ndarray) -> np.ndarray:
            return np.append(np.bincount(flat, values[which] * size, buckets), values.sum()) / max(1, len(rows))

        # Accelerated gradient steps as long as the curvature allows; the last place is the bias, which doesn't decay.
        keep = np.append(np.full(buckets, decay), 0.0)
        now = ahead = np.zeros(buckets + 1)
        bend = np.ones(buckets + 1)
        for _ in range(20 if rows else 0):
            bend = back(times(bend / np.linalg.norm(bend)))
        for step in range(steps if rows else 0):
            gap = 1 / (1 + np.exp(-times(ahead))) - labels
            before, now = now, ahead - (back(gap) + keep * ahead) / (1.1 * np.linalg.norm(bend) / 4 + decay)
            ahead = now + step / (step + 3) * (now - before)
        self.weights, self.bias = now[:-1], float(now[-1])

    def features(self, host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets, with a size each."""

        def grams(kind: str, text: str) -> set[str]:
            return {f"{kind}{text[i : i + n]}" for n in (3, 4, 5) for i in range(len(text) - n + 1)}

        found = [sorted(grams(kind, text)) for kind, text in (("h", "".join(f"^{x}$" for x in host.split("."))), ("p", f"^{path}$"))]
        places = [xxhash.xxh64_intdigest(g.encode()) % self.buckets for part in found for g in part]
        return np.array(places, np.int64), np.repeat([0.25, 0.05 / max(1, len(found[1])) ** 0.5], [len(part) for part in found])

    def score(self, host: str, path: str) -> float:
        found, size = self.features(host, path)
        return float(1 / (1 + np.exp(-((self.weights[found] * size).sum() + self.bias))))


@cache
def default_model() -> UrlModel:
    """The model of the default table, fitted once a session."""
    return UrlModel(labelled_urls())


def filter_urls(spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's block_score of every url."""
    held = spark.sparkContext.broadcast(default_model() if labelled is None else UrlModel(labelled))
    ddl = "page_id bigint, host string, path string, rule string, verdict string, block_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, schema = held.value, arrow_schema(ddl)

        def judge(page, url):
            host, path = split_url(url)
            rule, verdict = rule_for(host, path, rules)
            score = model.score(host, path)
            return page, host, path, rule, verdict or ("block" if score >= 0.5 else "allow"), score

        for batch in batches:
            rows = zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True)
            yield from in_batches((judge(*row) for row in rows), schema)

    return pages.select("page_id", "url").mapInArrow(run, ddl)
