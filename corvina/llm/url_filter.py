"""URL filter: allow and block rules, and a logistic regression for the rest.

The model sees hashed character n-grams of host and path, kept apart by a prefix,
and is trained from a small labelled table of URLs on the driver; where its log-odds
are zero is fitted by folds.  Rules come
before the model: a rule fits its host and all subdomains if the path starts with
the rule's path, and the longest fitting rule decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import mapped

SIZES = (3, 4, 5)
BUCKETS = 1 << 16
#: N-grams in more than this share of the labelled URLs (endings, prefixes) tell nothing and keep no weight.
COMMON = 0.08
NUMBER = re.compile("[0-9]+")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The labelled table, URLs as they stand on the web (scheme left out), wanted and unwanted.
WANTED = """
en.wikipedia.org/wiki/River  de.wikipedia.org/wiki/Fluss  www.bbc.co.uk/news/world-europe-66212  www.theguardian.com/books/2021/may/14/review  www.nytimes.com/2020/03/11/science/moon.html  www.lemonde.fr/culture/article/2019/10/02
www.spiegel.de/wissenschaft/natur  elpais.com/cultura/2018-04-22  www.nature.com/articles/d41586-020-0031  arxiv.org/abs/1706.03762  www.ncbi.nlm.nih.gov/pmc/articles/PMC3531190  stackoverflow.com/questions/11227809  github.com/apache/spark
docs.python.org/3/library/re.html  spark.apache.org/docs/latest/sql-ref.html  developer.mozilla.org/en-US/docs/Web/HTML  www.gutenberg.org/files/1342/1342-h.htm  plato.stanford.edu/entries/kant  www.britannica.com/animal/otter  www.loc.gov/collections
www.nasa.gov/missions/webb  www.usgs.gov/volcanoes  www.weather.gov/forecast  www.metoffice.gov.uk/weather/learn-about  www.nhs.uk/conditions/asthma  www.mayoclinic.org/diseases-conditions/flu  www.who.int/news-room/fact-sheets  ec.europa.eu/eurostat
www.allrecipes.com/recipe/23600/lasagna  www.bbcgoodfood.com/recipes/bread  smittenkitchen.com/2012/11/apple-cider-caramels  www.seriouseats.com/best-chili  cooking-at-home.blogspot.com/2010/06/soup.html  gardenweb.org/forum/tomatoes  www.rhs.org.uk/plants/roses
www.lonelyplanet.com/italy/rome  www.nationalparks.org/explore/yosemite  trails.example.org/hikes/ridge  www.railwaymuseum.org.uk/visit  citybus.example.com/timetable/12  www.seat61.com/Germany.htm  harbour-walks.net/maps  www.bikeforums.net/touring
www.imdb.com/title/tt0111161  www.goodreads.com/book/show/2657  www.discogs.com/artist/3840  pitchfork.com/reviews/albums  www.moma.org/collection/works/79802  www.louvre.fr/en/explore  www.poetryfoundation.org/poems/44644  www.theparisreview.org/interviews
www.espn.com/soccer/team/results  www.cyclingnews.com/races/tour-de-france  www.chess.com/openings  boardgamegeek.com/boardgame/13/catan  www.birdwatching.co.uk/features  photo.stackexchange.com/questions/1942  www.dpreview.com/reviews/nikon
www.khanacademy.org/math/algebra  ocw.mit.edu/courses/mathematics  www.coursera.org/learn/machine-learning  school.example.net/pupils/news  www.cs.cmu.edu/~adam/papers  adulteducation.gov.uk/evening-classes  learning.example.org/adults/literacy
www.ikea.com/us/en/p/billy-bookcase  www.etsy.com/listing/5551/handmade-mug  www.oldmill-bakery.co.uk/menu  joesplumbing.com/contact  www.riverside-hotel.de/zimmer  townhall.example.com/council/minutes  www.barrelhouse-brewing.com/visit  crackersandcheese.co.uk/shop
www.adobe.com/products/reader  downloads.example.com/printer/driver  sourceforge.net/projects/audacity  www.videolan.org/vlc  support.microsoft.com/en-us/help/4026  www.debian.org/releases/stable  wiki.archlinux.org/title/Installation_guide  addons.mozilla.org/firefox
www.bankofengland.co.uk/monetary-policy  www.studentloans.gov/repay  www.mortgageadvice.org.uk/first-home  www.consumerreports.org/cars  www.etymonline.com/word/loan  www.dictionary.com/browse/alphabet  www.betterhomes.com/kitchen  www.alphabetbooks.com
www.essex.ac.uk/departments/history  www.middlesexcounty.org/libraries  www.sussexwildlife.org/reserves  scunthorpe.example.org/parks  www.pokertownhistory.example.net/archive  www.freedomtrail.org/sites  www.windows-and-doors.co.uk/prices  trackandfield.example.com/results
adamsmith.org/blog  adirondackexplorer.org/stories  readersdigest.co.uk/food-drink  www.madrid.es/portal  laradio.example.fr/podcasts  www.zeit.de/gesellschaft/2017-09  www.elmundo.es/ciencia  www.marmiton.org/recettes  www.chefkoch.de/rezepte/181
blog.example.com/2014/02/on-writing  news.example.org/en/10234  forum.example.net/viewtopic.php  www.example.com/about  example.org/fr/20994  shop.example.de/produkte/lampe
meadow.example.net/en/31207  www.thornhill.example.net/de/8817.html  blog.northwind.example.net/es/4406/  m.thewanderer.example.net/fr/19022  lighthouse.example.com/en/7782.html  www.tanners.example.com/es/12093/
m.thimble.example.com/de/30771  oatfield.example.org/fr/9034.html  www.hearth.example.org/en/551/  blog.ratherton.example.org/es/27760  therapy-centre.example.net/en/6120  tinsmith.example.net/fr/14410.html  m.others.example.net/de/2907/  www.these-days.example.com/fr/883
""".split()
UNWANTED = """
www.bet365.com/sports  1xbet.com/en/line  www.betfair.com/exchange  betway.com/bonus  www.bwin.com/betting  sportsbet.io/live  freebets-online.net/offers  www.888casino.com/play  casino-bonus-24.com/free-spins  www.pokerstars.com/poker/download  bestonlinepoker.biz/win
slots-jackpot.net/mega  luckyslots777.xyz/register  royal-vegas-casino.info/spin  www.partypoker.com/freeroll  bingo-cash-prize.com/claim
www.pornhub.com/view_video.php  xhamster.com/videos/hot  www.xvideos.com/video4211  xnxx.com/search/teen  www.redtube.com/8812  youporn.com/watch/551  onlyfans.com/hotgirl  chaturbate.com/couple-cams  livejasmin.com/en/girls  sexcams-live.net/chat
adultfriendfinder.com/hookup  free-xxx-tube.org/milf  hot-sex-videos.xyz/amateur  escort-girls-vip.com/london  nude-celebs.info/gallery  hentai-porn.net/manga  adult-cams24.com/join  brazzers.com/scenes
ad.doubleclick.net/click  www.criteo.net/delivery/ck.php  cdn.taboola.com/libtrc  widgets.outbrain.com/ads.js  adserver.example.com/banner.gif  ads.pubmatic.com/AdServer  pixel.quantserve.com/pixel.gif  track.adform.net/serving  googlesyndication.com/pagead/ads
ib.adnxs.com/getuid  adclick-tracker.info/redirect  popads.net/pop.js  popunder-network.biz/serve  clicktrack.example.net/click?id  cdn.adsafeprotected.com/track  banner-exchange.ru/show  ads-delivery.xyz/impression  propellerads.com/campaign
cheap-viagra-pills.com/buy  buy-cialis-online.biz/order  canadian-pharmacy24.net/no-prescription  onlinepharmacy-rx.info/pills  weightloss-miracle-pills.com/free-trial  replica-watches-cheap.cn/rolex  cheap-louis-vuitton-outlet.us/bags
payday-loans-fast.net/apply  instant-cash-loan-usa.com/bad-credit  quick-loans-no-check.biz  make-money-fast-now.info/rich  earn-bitcoin-free.xyz/double  win-free-iphone.club/claim-prize  you-are-winner.top/gift  free-gift-cards.win/survey
crack-keygen-download.com/serial  warez-bb.org/full-version  nulled-scripts.net/free  torrent-movies-free.xyz/download  thepiratebay.example.net/top/201  serial-keys-crack.info/windows  activator-kms-crack.net/exe  mod-apk-hack.biz/unlimited-coins
update-flash-player.xyz/install.exe  secure-login-paypal.verify-account.tk/signin  bank0famerica-login.ml/confirm  virus-alert-support.club/call-now  malware-scanner-free.info/setup.exe  link-farm-seo.biz/directory  cheap-backlinks-seo.net/buy  essay-writing-cheap.biz/order-now
spam-links-farm.example.org/en/2231  www.spamfarm-directory.com/de/881.html  adult-x-tube.example.com/en/5512/  adult-dating-x.net/fr/77  free-bets-club.example.net/es/9921  www.freebet-offers.com/en/310  cheap-pills-shop.example.net/de/3310/  cheap-meds-pills.org/en/12
casino-win-big.example.net/es/450  m.casinowin-online.com/fr/3308  ads-track-network.example.com/en/771  adtrack-serve.com/es/1804.html
""".split()


def labelled_table() -> list[tuple[str, str, int]]:
    """(host, path, 1 if unwanted)."""
    return [(host, slash + path, unwanted) for unwanted, urls in enumerate((WANTED, UNWANTED)) for host, slash, path in (u.partition("/") for u in urls)]


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, how many each URL has).  Bytes of UTF-8, with marks around host and path; any number in a path is 0."""
    parts = [f"\x02{h}\x03".encode() for h in hosts], [f"\x04{NUMBER.sub('0', p)}\x05".encode() for p in paths]
    grams, owners = [], []
    for salt, texts in enumerate(parts):
        flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), lengths)
        for n in SIZES:
            if len(flat) < n:
                continue
            h = np.full(len(flat) - n + 1, salt * 7919 + n, np.uint64)
            for k in range(n):
                h = (h * np.uint64(0x100000001B3)) ^ flat[k : len(flat) - n + 1 + k]
            whole = owner[: len(h)] == owner[n - 1 :]
            h = h * np.uint64(0x9E3779B97F4A7C15)
            grams.append((h[whole] >> np.uint64(48)).astype(np.int64) % BUCKETS)
            owners.append(owner[: len(h)][whole])
    if not grams:
        return np.zeros(0, np.int64), np.zeros(len(hosts), np.int64)
    owners, grams = np.concatenate(owners), np.concatenate(grams)
    order = owners.argsort(kind="stable")
    return grams[order], np.bincount(owners, minlength=len(hosts))


def scores(hosts: list[str], paths: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds that a URL is unwanted; n-grams count by their share of the URL's."""
    grams, counts = features(hosts, paths)
    total = np.bincount(np.repeat(np.arange(len(hosts)), counts), weights=weights[grams], minlength=len(hosts))
    return total / np.sqrt(np.maximum(counts, 1)) + bias


def fit(rows: list[tuple[str, str, int]], folds: int = 5) -> tuple[np.ndarray, float]:
    """Weights from all rows, and the bias that tells rows best which the weights haven't seen.

    Each fold is scored by a model of the others; of the log-odds at which both classes
    are told best on average, the middle one becomes zero.
    """
    weights, bias = train(rows)
    y, out = np.array([r[2] for r in rows], bool), np.zeros(len(rows))
    if y.all() or not y.any():
        return weights, bias
    for k in range(folds):
        left = np.arange(len(rows)) % folds == k
        if left.any() and not left.all():
            w, b = train([r for r, l in zip(rows, left, strict=True) if not l])
            out[left] = scores(*([r[c] for r, l in zip(rows, left, strict=True) if l] for c in (0, 1)), w, b)
    cuts = np.sort(out)
    told = np.array([(out[y] > c).mean() + (out[~y] <= c).mean() for c in cuts])
    best = cuts[told == told.max()]
    return weights, bias - float(best[len(best) // 2])


def train(rows: list[tuple[str, str, int]], rounds: int = 600, rate: float = 20.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent from zero, no randomness; both classes weigh
    alike; weights shrink, the bias doesn't."""
    grams, counts = features([r[0] for r in rows], [r[1] for r in rows])
    y = np.array([r[2] for r in rows], float)
    owner, scale = np.repeat(np.arange(len(rows)), counts), 1 / np.sqrt(np.maximum(counts, 1))
    weights, bias = np.zeros(BUCKETS), 0.0
    seen = np.bincount(np.unique(owner * BUCKETS + grams) % BUCKETS, minlength=BUCKETS)
    telling = seen <= COMMON * len(rows)
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))  # both classes weigh alike
    for _ in range(rounds):
        z = np.bincount(owner, weights=weights[grams], minlength=len(rows)) * scale + bias
        error = (1 / (1 + np.exp(-z)) - y) * share
        bias -= error.mean()
        weights -= rate * telling * (np.bincount(grams, weights=(error * scale)[owner], minlength=BUCKETS) / len(rows) + decay * weights)
    return weights, bias


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in small letters) and path of a URL; both empty without "://"."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return tuple(F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule of (verdict, "host/path") pairs, as struct(rule, verdict); null if none fits."""
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        cases.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """`page_id, host, path, rule, verdict, p_block` for every row of `page_id, url`.

    A null url or one without "://" has an empty host and path and is judged by the
    model alone; of equally long rules the first in order decides; repeated rows come
    out each; other columns are ignored; an empty table gives no rows.  The model's
    size is fixed, so it travels with the task.
    """
    weights, bias = fit(labelled or labelled_table())
    weights = weights.astype(np.float32)
    host, path = parts(F.col("url").cast("string"))
    split = pages.select("page_id", F.translate(host, CAPITALS, SMALL).alias("host"), path.alias("path"))
    kind = dict(split.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = scores(batch.column("host").to_pylist(), batch.column("path").to_pylist(), weights, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], ["page_id", "host", "path", "p_block"])

    scored = mapped(split, run, f"page_id {kind}, host string, path string, p_block double").withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "p_block")
