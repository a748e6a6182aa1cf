"""URL filters: rules by host and path, and for the rest a logistic regression on hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights are hashed to 2 to this power, n-grams have these lengths in bytes.
BITS, GRAMS = 15, (3, 4, 5)
#: What share of urls is thought to be of the kinds to block.
BLOCKED_SHARE = 0.4
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: The small labelled table: addresses of kinds that corpora leave out (gambling, advertising, adult, pills, loans,
#: fakes, pirated files, doorway pages) and of kinds that they keep, written by hand from what such addresses look like.
BLOCKED = """
http://www.best-online-casino-bonus.win/slots/free-spins.php?aff=2231
http://luckyjackpot777.org/register?ref=88120
https://royalslots-casino.bet/en/welcome-bonus
http://www.livebetting24.info/odds/football?partner=91
http://poker-vip-room.xyz/download/poker.exe
http://free-bets-today.top/claim-now
https://sportsbook-offers.xyz/bets/free-bet-10
http://spin2win-slots.ru/play/
http://megabingo-bonus.online/signup.html?clickid=aa91
http://adserver.trackpixel.win/click?cid=99182&pub=71
http://ads.popunder-media.com/serve/banner.js?zone=1821
https://track.clickbank-offers.xyz/redirect?aff_id=1182&offer=77
http://cdn.adsyndicate.net/ads/728x90.gif?rnd=88271
http://pixel.retarget-ads.net/collect?uid=81723
http://www.affiliate-clicks.top/out/jump.php?u=8817
http://tracker.leadgen-ads.biz/c/1827/redirect
http://banner-exchange.bid/ads/show?slot=9
http://go.push-notify-ads.com/subscribe?zoneid=77
http://doubleclix.online/adclick.php?bannerid=22
http://www.hot-adult-cams.xxx/live/rooms
http://xxx-free-tube.com/videos/9912.html
http://sexy-webcam-girls.top/cams/room12
http://free-porn-clips.xyz/watch/88231
http://nude-celebs-leaked.com/gallery/1
http://www.escorts-in-town.info/girls/list.php
http://naughty-hookup.click/signup
http://milf-tube-hd.click/xxx/video-2219
http://adultfriend-chat.online/adult/chat?ref=1
http://cheap-pills-rx.com/buy-viagra-online
http://www.canadian-pharmacy-meds.win/cialis/order.php
http://buy-cheap-meds-noprescription.top/viagra.html
http://generic-cialis-shop.biz/pills/cheap
http://weightloss-miracle-pills.info/order-now
http://order-tramadol-online.info/rx/tramadol
http://keto-diet-gummies-sale.click/lp/1?clickid=7
http://www.steroids4u.biz/shop/buy
http://hairgrowth-secret.top/offer/?sub=812
http://payday-loans-fast-cash.online/apply?aff=3
http://instant-loan-approved.top/bad-credit
http://www.quick-cash-advance.biz/payday/loan
http://double-your-bitcoin.top/invest?ref=881
http://crypto-profit-robot.xyz/signup/?clickid=8
http://forex-millionaire-secret.info/lp/video
http://earn-money-from-home.xyz/make-5000-a-day
http://binary-options-signals.top/profit
http://debt-relief-now.online/free-quote?sub=9
http://free-iphone-giveaway.net/claim?uid=2231
http://you-won-prize.click/winner/claim.php
http://www.gift-card-generator.xyz/free-gift-cards
http://account-verify-secure-login.ru/paypal/update.php
http://signin-appleid-verify.tk/login.php
http://bank-security-alert.info/verify/account?id=81
http://microsoft-support-alert.click/call-now
http://netflix-billing-update.top/login/card.php
http://replica-watches-outlet.biz/rolex-cheap
http://www.cheap-designer-bags.top/outlet/sale
http://fake-diploma-online.ru/buy-degree
http://discount-sneakers-outlet.com/cheap-jordans
http://louis-handbags-replica.xyz/buy
http://www.crackedsoftware-keygen.info/download/photoshop-crack.exe
http://warez-full-download.top/serial-keys
http://free-movies-stream-hd.top/watch-online-free
http://torrent-moviez.click/download/torrent/8812
http://game-cheats-hack.win/free-coins-generator
http://apk-mod-unlimited.top/download.php?id=92
http://mp3-download-free.click/get/1882.html
http://flash-player-update.click/install.exe
http://pc-speedup-cleaner.info/setup/download.exe
http://free-antivirus-scan.org/alert/infected?aff=1
http://cheap-seo-backlinks.biz/buy-links
http://article-spinner-links.xyz/seo/page-9182.html
http://best-deals-4-you-online.info/cheap-buy-best-price/8817
http://x7d82k1.top/a/b1/?q=cheap+insurance
http://www.cheap-car-insurance-quotes.click/free-quote
http://followers-likes-buy.biz/instagram/buy-followers
http://psychic-reading-free.top/love-spell?ref=2
http://get-rich-blog.xyz/?p=88213
http://domain-parking-ads.info/?domain=kjhsd
http://cbd-oil-gummies.click/buy?sub=71
http://vape-juice-sale.net/cheap
http://hotsingles-nearby.win/meet?clickid=99
http://poker-casino-nights.org/tables
http://online-casino-guide.net/bets
http://betsandodds.org/football/bets
http://adultvideo-portal.net/free
http://pills-express.org/order
http://adsnetwork-media.org/ads/serve
""".split()
ALLOWED = """
https://en.wikipedia.org/wiki/Photosynthesis
https://de.wikipedia.org/wiki/Bodensee
https://fr.wikipedia.org/wiki/R%C3%A9volution_fran%C3%A7aise
https://www.bbc.co.uk/news/science-environment-48964736
https://www.theguardian.com/books/2019/jul/12/a-novel-of-the-sea
https://www.nytimes.com/2018/05/14/science/ocean-currents.html
https://www.lemonde.fr/sciences/article/2020/03/02/les-oiseaux_6031.html
https://www.spiegel.de/wissenschaft/natur/wald-im-sommer-a-1281.html
https://elpais.com/cultura/2019/10/21/actualidad/la-historia.html
https://www.reuters.com/article/harvest-report-idUSKBN1
https://www.nature.com/articles/s41586-020-2649-2
https://arxiv.org/abs/1706.03762
https://www.jstor.org/stable/2265412
https://plos.org/plosone/article/journal.pone.0200303
https://www.ncbi.nlm.nih.gov/pmc/articles/PMC29193/
https://www.nasa.gov/mission_pages/station/main/index.html
https://www.noaa.gov/weather/forecast
https://www.usgs.gov/natural-hazards/earthquake-hazards/maps
https://www.loc.gov/collections/maps/about-this-collection
https://www.gutenberg.org/files/1342/1342-h/1342-h.htm
https://archive.org/details/historyofengland01
https://openlibrary.org/works/OL45804W/Walden
https://www.britannica.com/science/volcano
https://plato.stanford.edu/entries/kant-moral/
https://ocw.mit.edu/courses/mathematics/linear-algebra/lecture-notes
https://www.cam.ac.uk/research/news/medieval-manuscripts
https://www.ox.ac.uk/admissions/undergraduate/courses
https://www.uni-heidelberg.de/de/studium/alle-studienfaecher
https://www.sorbonne-universite.fr/formation/licences
https://www.harvard.edu/about/history
https://math.berkeley.edu/people/faculty/teaching.html
https://docs.python.org/3/library/itertools.html
https://developer.mozilla.org/en/docs/Web/HTML/Element
https://github.com/apache/spark/blob/master/README.md
https://stackoverflow.com/questions/11227809/why-is-sorted-array-faster
https://spark.apache.org/docs/latest/sql-programming-guide.html
https://www.postgresql.org/docs/current/tutorial.html
https://doc.rust-lang.org/book/ch04-00-understanding-ownership.html
https://www.kernel.org/doc/html/latest/process/howto.html
https://wiki.archlinux.org/title/Installation_guide
https://www.who.int/news-room/fact-sheets/detail/measles
https://www.nhs.uk/conditions/asthma/treatment
https://www.mayoclinic.org/diseases-conditions/migraine/symptoms
https://europa.eu/european-union/about/history_en
https://www.parliament.uk/business/committees/reports
https://www.un.org/en/sections/history/index.html
https://www.bundestag.de/dokumente/protokolle
https://www.service-public.fr/particuliers/vosdroits
https://www.boe.es/diario_boe/2020/06/10
https://www.city.springfield.gov/council/minutes/2019-04
https://www.metmuseum.org/art/collection/search/436535
https://www.louvre.fr/oeuvres-notices/la-joconde
https://www.nationalgallery.org.uk/paintings/turner
https://www.museodelprado.es/coleccion/obra-de-arte/las-meninas
https://www.smithsonianmag.com/history/the-long-road-1802
https://www.nationalgeographic.com/animals/mammals/wolf
https://www.rspb.org.uk/birds-and-wildlife/bird-a-z/robin
https://www.kew.org/plants/oak-tree
https://www.bbcgoodfood.com/recipes/lentil-soup
https://www.allrecipes.com/recipe/16354/easy-bread
https://cooking.nytimes.com/recipes/1018684-apple-pie
https://www.chefkoch.de/rezepte/kartoffelsuppe.html
https://www.marmiton.org/recettes/recette_ratatouille
https://www.lonelyplanet.com/portugal/lisbon
https://www.bahn.de/service/fahrplan
https://www.nationaltrust.org.uk/stourhead/features/garden
https://www.gardenersworld.com/how-to/grow-plants/tomatoes
https://www.cyclinguk.org/route/coast-to-coast
https://www.chess.com/article/view/the-sicilian-defence
https://www.imdb.com/title/tt0050083/
https://www.allmusic.com/artist/miles-davis
https://www.goodreads.com/book/show/2657
https://www.poetryfoundation.org/poems/44272/the-road-not-taken
https://www.classical.net/music/comp.lst/bach.html
https://oldmaps.library.cornell.edu/maps/rivers
https://forum.woodworking.org/viewtopic.php?t=2811
https://blog.mountain-walks.org.uk/2016/09/autumn-hills
https://annes-kitchen.blogspot.com/2014/11/plum-cake.html
https://teacherjones.wordpress.com/2017/02/fractions-lesson
https://www.villageschool.sch.uk/parents/newsletter
https://www.stmarys-church.org/history/tower
https://www.riverside-bakery.com/about-us
https://www.hofladen-mueller.de/unser-hof
https://www.libreria-central.es/novedades
https://www.harbour-museum.ca/visit/opening-hours
https://www.local-history-society.org/journal/issue12
https://physics.info/motion-equations/
https://mathworld.wolfram.com/PrimeNumber.html
https://www.timeanddate.com/moon/phases
http://oakfield.org/about.html
http://lindenpress.net/products/notebooks
http://marina-sailing.net/cours/debutants
http://deltachor.org/konzerte/archiv
http://northshorepost.net/stories/ferry-returns
http://stonebridge-blog.org/entradas/el-puente
http://penwright.net/index.html
http://harrowmuseum.org/exhibits
http://tamarind-tea.net/shop/green
http://kettleandcup.net/tee.html
http://fernhill.org/
http://lanterna.net/noticias/el-faro
http://silversmith.net/rings/repairs
http://heronwatch.net/sightings/march
http://valeriano.org/biographie
http://thornburychoir.net/members
http://castello-wines.net/vineyards
http://rosewaterclinic.org/doctors
http://bluedoor.net/contact.html
http://quarrylane.org/parking
""".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table; 1 is block."""
    return [(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].encode().lower().decode(), m[2]) if m else ("", "")


def features(parts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, slot) of every n-gram of every host and path, by rolling arithmetic over all bytes at once.

    Hosts start with ^ and end with $, so that grams at their ends differ; hosts and paths have slots of their own.
    """
    owners, slots = [], []
    for which in (0, 1):
        raws = [b"^" + p[which].encode() + b"$" for p in parts]
        a = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
        for n in GRAMS:
            if len(a) < n:
                continue
            h = np.full(len(a) - n + 1, 2 * n + which + 1, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) ^ a[k : len(a) - n + 1 + k]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
            inside = owner[: len(h)] == owner[n - 1 :]
            owners.append(owner[: len(h)][inside])
            slots.append(h[inside].astype(np.int64))
    return (np.concatenate(owners), np.concatenate(slots)) if owners else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def scores(self, parts: list[tuple[str, str]]) -> np.ndarray:
        """Log-odds of block: the mean weight of the n-grams, times the square root of their number, and the bias."""
        owner, slot = features(parts)
        n = np.maximum(np.bincount(owner, minlength=len(parts)), 1)
        return np.bincount(owner, weights=self.weights[slot], minlength=len(parts)) / np.sqrt(n) + self.bias


def fit(table: list[tuple[str, int]], rounds: int = 1000, rate: float = 10.0, decay: float = 1e-5, blocked: float = BLOCKED_SHARE) -> UrlModel:
    """Logistic loss over the labelled table, by gradient steps with momentum on weights and bias; the same table gives
    the same model. Urls to block weigh `blocked` of the whole, whatever their number."""
    owner, slot = features([split_url(u) for u, _ in table])
    y = np.array([label for _, label in table], float)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(table)), 1))
    even = np.where(y > 0, blocked / max(y.sum(), 1), (1 - blocked) / max((1 - y).sum(), 1))
    weights, bias = np.zeros(1 << BITS), 0.0
    speed, drift = np.zeros(1 << BITS), 0.0
    for _ in range(rounds):
        z = np.bincount(owner, weights=weights[slot], minlength=len(table)) * scale + bias
        g = (1 / (1 + np.exp(-z)) - y) * even
        speed = 0.9 * speed + np.bincount(slot, weights=(g * scale)[owner], minlength=1 << BITS) + decay * weights
        drift = 0.9 * drift + g.sum()
        weights, bias = weights - rate * speed, bias - rate * drift / 10
    return UrlModel(weights, bias)


@lru_cache(maxsize=1)
def default_model() -> UrlModel:
    return fit(labelled_urls())


class Rules:
    """rules: (host + path, verdict). The longest that fits wins; of equal ones that fit, the first given."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        longest, at = -1, 0
        while at >= 0:
            for start, rule, verdict in self.by_host.get(host[at:], ()):
                if len(rule) > longest and path.startswith(start):
                    best, longest = (rule, verdict), len(rule)
            at = host.find(".", at) + 1 or -1
        return best


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, model: UrlModel | None = None, threshold: float = 0.0, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict (allow or block), score (log-odds of block).

    Rules go to every task: their number is bounded by who writes them. No row meets another, so nothing is shuffled.

    Defined cases: a null url, or one without ://, has an empty host and path, fits no rule and is judged by the
    model. Very long urls are read whole. Null ids and repeated rows pass through. Other columns are ignored. An empty table gives an empty result.
    """
    model, known = model or default_model(), Rules(tuple(rules))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, max(1, len(b)), 2000):
                part = b.iloc[at : at + 2000]
                parts = [split_url(u) for u in part["url"]]
                found = [known.find(*p) for p in parts]
                scores = model.scores(parts)
                verdicts = [v or ("block" if s > threshold else "allow") for (_, v), s in zip(found, scores, strict=True)]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": [r for r, _ in found], "verdict": verdicts, "score": scores})

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInPandas(run, f"id {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("id", id_col)
