"""URL filter: rules by host and path, and logistic regression on hashed character n-grams, in DataFrame functions only.

The model is trained on a small labelled table of URLs (a parameter, at most MAX_LABELLED rows) before the job starts; its weights
are whole numbers, SLOTS of them whatever the corpus, and go into the plan as one literal. Judging is one projection
without an exchange.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 10_000
SLOTS = 1 << 15  # hashed features, about ten for each n-gram of the labelled table, so that unknown n-grams rarely meet a weight
GRAMS = (3, 4)
SCALE = 10_000  # weights are whole multiples of 1 / SCALE, so that sums don't depend on their order

# The labelled URLs that the model is trained on unless others are given; none is of a host of the tables here.
BLOCKED = (
    "http://blog.royal-casino-bonus.shop/en/12 https://www.casinos-online24.biz/de/slots http://poker-jackpot.info/fr/9 https://m.slots-and-casino.top/es/77 "
    "http://betting-odds-now.club/en/341 https://sure-bets.win/de/tips http://livebets365.top/en/5 https://viagra-cialis-pills.shop/en/buy "
    "http://blog.generic-pills.store/fr/order/8 https://discount-pharmacy-meds.biz/es/21 http://www.diet-pills-fast.info/en/640 "
    "https://cheap-replica-watches.shop/en/3 http://cheap-handbags-outlet.store/de/52 https://www.cheap-tramadol.biz/fr/118 "
    "http://free-iphone-winner.club/en/claim https://get-free-gift-cards.win/es/6 http://m.free-ringtones.top/de/440 https://adult-cams-live.xyz/en/71 "
    "http://hot-adult-dating.club/fr/2 https://xxx-movies.xyz/es/930 http://porn-tube-hd.xyz/en/15 https://www.sexy-singles.club/de/8 "
    "http://blog.spam-links-seo.info/en/4 https://buy-backlinks-spam.biz/fr/99 http://seo-link-farms.top/en/215 https://www.content-farm-articles.info/es/7 "
    "http://m.ads-popunder.click/en/1 https://www.click-track-ads.click/go/33 http://banner-ads-server.click/fr/0 https://track-redirect.click/de/613 "
    "http://payday-loans-instant.biz/en/70 https://crypto-doubler-win.top/en/44 http://win-lottery-prizes.club/es/300 "
    "https://warez-keygen-crack.xyz/de/81 http://get-rich-quick.win/fr/19 https://miracle-weight-loss.shop/en/26 "
).split()
ALLOWED = (
    "https://www.citylibrary.gov/en/catalogue http://gardening-notes.net/de/12 https://museum-of-glass.org/fr/visit/9 "
    "http://weather.islandradio.net/es/77 https://docs.compiler-guide.dev/en/install http://blog.mountainhut.org/de/341 "
    "https://m.recipes-of-the-north.net/en/5 http://school-orchestra.edu/fr/8 https://chess-club-vienna.org/es/21 "
    "http://www.riverboat-history.net/en/640 https://astronomy.college.edu/en/3 http://birdwatch-journal.org/de/52 https://www.townhall-news.net/fr/118 "
    "http://volcano-research.edu/en/reports https://m.traintimes.net/es/6 http://wooden-toys-workshop.org/de/440 https://poetry-in-translation.net/en/71 "
    "http://blog.sailors-diary.org/fr/2 https://law-review.edu/es/930 http://beekeeping.farmers-union.org/en/15 https://www.children-hospital.org/de/8 "
    "http://theatre-archive.net/en/4 https://m.mathematics-of-maps.edu/fr/99 http://old-bridges.net/en/215 https://bakery-on-the-hill.net/es/7 "
    "http://linguistics.institute.edu/en/1 https://www.running-club.org/en/33 http://forum.home-brewers.net/fr/0 https://photography-basics.net/de/613 "
    "http://city-tram-museum.org/en/70 https://www.wetlands-trust.org/en/44 http://blog.teachers-lounge.net/es/300 https://m.northern-lights.org/de/81 "
    "http://stamp-collectors.net/fr/19 https://ceramics-studio.org/en/26 http://www.hiking-in-the-alps.net/en/853 "
).split()
LABELLED: tuple[tuple[str, int], ...] = (*((u, 1) for u in BLOCKED), *((u, 0) for u in ALLOWED))
# Rules (verdict, host, path).
RULES: tuple[tuple[str, str, str], ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_AFTER = r"^[\s\S]*?://"


@dataclass(frozen=True)
class Model:
    weights: tuple[int, ...]
    bias: int


def _parts(url: str) -> tuple[str, str]:
    _, mark, rest = url.partition("://")
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
    path = rest[end:]
    return (host, path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]) if mark else ("", "")


def _slots(host: str, path: str) -> list[int]:
    text = f"^{host}{path}$"
    return [int(hashlib.md5(text[i : i + n].encode()).hexdigest()[:8], 16) % SLOTS for n in GRAMS for i in range(len(text) - n + 1)]


@lru_cache
def train(labelled: tuple[tuple[str, int], ...] = LABELLED, rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Weights of a logistic regression on mean n-gram counts, by gradient descent over the labelled table."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled table may hold {MAX_LABELLED} rows at most")
    rows = []
    for url, label in labelled:
        slots = _slots(*_parts(url))
        count: dict[int, float] = {}
        for s in slots:
            count[s] = count.get(s, 0.0) + 1.0 / max(1, len(slots)) ** 0.5
        rows.append((count, label))
    w, bias = [0.0] * SLOTS, 0.0
    for _ in range(rounds):
        for count, label in rows:
            z = bias + sum(w[s] * v for s, v in count.items())
            miss = label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for s, v in count.items():
                w[s] += rate * (miss * v - decay * w[s])
            bias += rate * 0.1 * miss
    return Model(tuple(round(x * SCALE) for x in w), round(bias * SCALE))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, _AFTER + r"([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _AFTER + r"[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null; equally long ones in their given order."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def score(host: Column, path: Column, model: Model) -> Column:
    """The model's sum over a URL's n-grams and its bias times the root of their number, on the scale of the weights.

    The sign is the logistic regression's decision; the sum of whole numbers is exact.
    """
    text = F.concat(F.lit("^"), host, path, F.lit("$"))
    weights = F.split(F.lit(",".join(map(str, model.weights))), ",").cast("array<int>")  # folded into one literal

    chars = F.split(text, "")  # n-grams are put together from characters: a substring would be counted from the start each time

    def of_length(n: int) -> Column:
        count = F.greatest(F.lit(0), F.length(text) - (n - 1))
        grams = F.arrays_zip(*(F.slice(chars, k + 1, count).alias(f"c{k}") for k in range(n)))

        def add(total: Column, gram: Column) -> Column:
            digits = F.substring(F.md5(F.encode(F.concat(*(gram[f"c{k}"] for k in range(n))), "UTF-8")), 1, 8)
            return total + F.get(weights, F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(SLOTS)).cast("int"))

        return F.aggregate(grams, F.lit(0).cast("long"), add)

    return sum((of_length(n) for n in GRAMS), F.lit(0).cast("long"))


def n_grams(host: Column, path: Column) -> Column:
    size = F.length(host) + F.length(path) + 2
    return sum((F.greatest(F.lit(0), size - (n - 1)) for n in GRAMS), F.lit(0))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: tuple[tuple[str, int], ...] = LABELLED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row's URL.

    A null URL, or one without `://`, has an empty host and path, fits no rule and gets the model's verdict on the empty text.
    Ids may be null or repeated; other columns aren't read. `score` is the sum of weights; the verdict is block where
    score + bias * sqrt(n-grams) is above zero, which is the sign of the regression on counts over the root of their number.
    """
    model = train(labelled)
    cols = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    cols = cols.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", score(F.col("host"), F.col("path"), model))
    model_says = F.when(F.col("score") + F.floor(F.lit(model.bias) * F.sqrt(n_grams(F.col("host"), F.col("path")).cast("double"))) > 0, "block").otherwise("allow")
    return cols.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce("by_rule.verdict", model_says).alias("verdict"), "score")


def judge_sql(rules: Sequence[tuple[str, str, str]] = RULES, labelled: tuple[tuple[str, int], ...] = LABELLED) -> str:
    """The same rows in DuckDB SQL; the trained weights are written into it."""
    model = train(labelled)
    cases = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{v} {h}{p}'" for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])))
    grams = " union all ".join(f"select rid, unnest(list_transform(range(1, length(t) - {n - 2}), lambda i: substr(t, i, {n}))) as g from parts" for n in GRAMS)
    size = " + ".join(f"greatest(0, length(host) + length(path) + 2 - {n - 1})" for n in GRAMS)
    weights = ", ".join(f"({i}, {w})" for i, w in enumerate(model.weights) if w) or "(0, 0)"
    return rf"""
with split as (select row_number() over () as rid, page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, '^' || host || path || '$' as t from split),
grams as ({grams}),
weights(slot, w) as (values {weights}),
sums as (select rid, coalesce(sum(w), 0)::bigint as score from grams left join weights on slot = ('0x' || substr(md5(g), 1, 8))::bigint % {SLOTS} group by rid),
ruled as (select rid, page_id, host, path, case {cases} end as found from parts)
select page_id, host, path, substr(found, strpos(found, ' ') + 1) as rule,
  coalesce(split_part(found, ' ', 1), case when coalesce(score, 0) + floor({model.bias} * sqrt(({size})::double)) > 0 then 'block' else 'allow' end) as verdict, coalesce(score, 0) as score
from ruled left join sums using (rid)"""
