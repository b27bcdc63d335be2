"""URL verdicts: host and path rules, and beneath them logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled URL table, in plain arithmetic; its
weights, rounded to integers, are one array literal.  Scoring is DataFrame expressions only,
in the scan, without a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMS = (3, 4)
BINS = 4096
#: Weights are stored as integers of this unit, so that sums don't depend on their order.
UNIT = 1e-6

#: Words of hosts in the labelled URL table.
UNWANTED_WORDS = "ads adult bait bets bitcoin-double bonus casino cheap click coupon crack dating deals diet-pill discount-meds farm fast-cash free free-money gamble jackpot keygen link-farm loan lotto malware meds payday pharma phish pills poker porn prize promo ringtone scam seo-boost slots spam spin sweepstake torrent track viagra warez webcam win xxx".split()
WANTED_WORDS = "academy archive art atlas biology blog books bridge city climate college community council culture data design docs economy energy forum garden geography gov health history index institute journal kitchen law library map market math media museum music nature news notes ocean park physics press project recipe research review school science society sport story studio teacher theatre times travel union university village weather wiki works".split()
TOPS, LANGUAGES = ("example.com", "example.net", "example.org"), ("de", "en", "es", "fr")


#: Wanted hosts are mostly names that mean nothing to the model: those of the table are pairs and triples of these.
SYLLABLES = "an at da de ed en er es ha in is ka la ma nd on or ou ra re sh st te th ti to wh".split()
FRONTS = ("", "www.", "blog.", "m.")


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 for unwanted), some hundreds of rows made from the words by a rule."""
    n = len(SYLLABLES)
    made = ["".join(SYLLABLES[(i * k + j * j) % n] for j, k in enumerate((1, 5, 11)[: 2 + i % 2])) for i in range(9 * n)]
    hosts = [(w, 0) for w in made]
    for label, words in ((1, UNWANTED_WORDS), (0, WANTED_WORDS)):
        for i, w in enumerate(words):
            hosts += [(w, label), (f"{w}-{words[(7 * i + 3) % len(words)]}", label), (f"{words[(5 * i + 1) % len(words)]}-{w}", label)]
            hosts += [(f"{w}-{SYLLABLES[i % n]}{SYLLABLES[(3 * i + 1) % n]}", label)]
    return [
        (f"{FRONTS[i % 4]}{h}.{TOPS[(i // 4) % 3]}", f"/{LANGUAGES[(i // 3) % 4]}/{(37 * i) % 1000}" + ("", ".html", "/")[i % 3], label)
        for i, (h, label) in enumerate(hosts)
    ]


def _bins(host: str, path: str) -> list[int]:
    return [int(hashlib.md5(f"{part}{text[i : i + n]}".encode()).hexdigest()[:3], 16) for part, text in (("h", f"^{host}$"), ("p", path)) for n in GRAMS for i in range(len(text) - n + 1)]


@functools.lru_cache(maxsize=1)
def trained(rounds: int = 60, rate: float = 0.15, decay: float = 1e-4) -> tuple[int, tuple[int, ...]]:
    """Bias and weights by stochastic gradient descent over the labelled table, in units of UNIT."""
    rows = [(_bins(h, p), y) for h, p, y in labelled_urls()]
    weights, bias = [0.0] * BINS, 0.0
    for r in range(rounds):
        for k in range(len(rows)):
            bins, y = rows[(k * 101 + r) % len(rows)]
            z = bias + sum(weights[b] for b in bins)
            step = rate / (1 + 0.1 * r) * (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            bias += step
            for b in bins:
                weights[b] += step / 8 - decay * weights[b]
    return round(bias / UNIT), tuple(round(w / UNIT) for w in weights)


def _letters(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return _letters(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _sum(weights: Column, part: str, value: Column, n: int) -> Column:
    """Sum of the weights of all ``n``-grams; the text is taken apart into an array of characters once, so time is linear in its length."""

    def over(chars: Column) -> Column:
        last = F.size(chars) - (n - 1)
        places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        digest = lambda i: F.substring(F.md5(F.concat(F.lit(part), *(F.element_at(chars, i + j) for j in range(n))).cast("binary")), 1, 3)
        return F.aggregate(places, F.lit(0).cast("long"), lambda total, i: total + F.element_at(weights, F.conv(digest(i), 16, 10).cast("int") + 1))

    # As a lambda's argument the array is made once, not for every gram.
    return F.element_at(F.transform(F.array(F.split(value, "")), over), 1)


def logit(host: Column, path: Column) -> Column:
    """The model's logit in units of UNIT; over 0 is unwanted."""
    bias, w = trained()
    weights = F.expr(f"array({','.join(f'{x}L' for x in w)})")
    parts = [_sum(weights, "h", F.concat(F.lit("^"), host, F.lit("$")), n) for n in GRAMS] + [_sum(weights, "p", path, n) for n in GRAMS]
    return functools.reduce(Column.__add__, parts, F.lit(bias).cast("long"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, logit) for each row of ``pages`` (key, url, anything else).

    ``rules`` are (host, path, verdict), a stated list.  A rule fits its host and all
    subdomains if the path starts with the rule's; the longest (host and path together) wins,
    of equals the one with the longer host.  Without a rule the model decides.  A null url,
    or one without ``://``, has an empty host and path and is left to the model.  Rows are
    judged one by one: repeated rows and keys stay.
    """
    rows = pages.select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    listed = F.array(*(F.struct(F.lit(len(h + p)).alias("size"), F.lit(len(h)).alias("hosts"), F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules)) if rules else None
    if listed is not None:
        fits = F.filter(listed, lambda r: ((F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))) & F.col("path").startswith(r["path"]))
        rows = rows.withColumn("best", F.array_max(fits))
        rule, said = F.concat("best.host", "best.path"), F.col("best.verdict")
    else:
        rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    rows = rows.withColumn("logit", logit(F.col("host"), F.col("path")))
    return rows.select(key, "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("logit") > 0, "block").otherwise("allow")).alias("verdict"), "logit")


def judged_sql(rules: Sequence[tuple[str, str, str]]) -> str:
    """The same over a DuckDB view ``pages``."""
    bias, w = trained()
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def total(part: str, text: str, n: int) -> str:
        return f"coalesce(list_sum(list_transform(range(1, length({text}) - {n - 2}), lambda i: w[('0x' || substr(md5('{part}' || substr({text}, i, {n})), 1, 3))::INT + 1])), 0)"

    sums = " + ".join([total("h", "('^' || host || '$')", n) for n in GRAMS] + [total("p", "path", n) for n in GRAMS])
    listed = ", ".join(f"{{'size': {len(h + p)}, 'hosts': {len(h)}, 'host': '{h}', 'path': '{p}', 'verdict': '{v}'}}" for h, p, v in rules)
    return f"""
WITH m AS MATERIALIZED (SELECT [{', '.join(map(str, w))}]::BIGINT[] AS w),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{upper.lower()}') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, list_sort(list_filter([{listed}], lambda r: (host = r.host OR ends_with(host, '.' || r.host)) AND starts_with(path, r.path)), 'DESC')[1] AS best,
             ({bias} + {sums})::BIGINT AS logit FROM u, m)
SELECT page_id, host, path, best.host || best.path AS rule,
       coalesce(best.verdict, CASE WHEN logit > 0 THEN 'block' ELSE 'allow' END) AS verdict, logit FROM r
"""
