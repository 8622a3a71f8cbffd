"""Operator 5. URL filter with a weighted vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in one pass over a URL. A hit counts only between
boundaries: the characters before and after it are not ASCII letters or digits. One strict term rejects a URL,
and so do several soft terms whose weights, each distinct term once, reach a limit that none reaches alone. Host
rules are looked at first; the longest that fits decides. The vocabulary may also come from a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The vocabulary, its limit and the rules. Soft terms of 12 name goods or acts that are seldom named
# without a motive to sell them; those of 7 are words of advertising, of which three make a case.
STRICT = (
    "adultcam", "bdsm", "bestiality", "blackjackonline", "botnet", "casino", "casinos", "cialis", "cracks", "creampie", "cumshot", "escort",
    "escorts", "gangbang", "hentai", "hotsluts", "jackpot", "keygen", "levitra", "livesex", "malware", "milf", "onlinecasino", "phishing",
    "porn", "porno", "pornhub", "ransomware", "sexcam", "slots777", "spyware", "tramadol", "viagra", "warez", "xanax", "xxx",
)
SOFT = {
    "adult": 12, "baccarat": 12, "bet": 12, "bets": 12, "betting": 12, "blackjack": 12, "crack": 12, "dating": 12, "detox": 12, "diet": 12,
    "erotic": 12, "fetish": 12, "forex": 12, "gamble": 12, "gambling": 12, "hookup": 12, "lingerie": 12, "loan": 12, "loans": 12, "lottery": 12,
    "mortgage": 12, "nude": 12, "payday": 12, "pharmacy": 12, "pills": 12, "poker": 12, "replica": 12, "roulette": 12, "serial": 12, "sex": 12,
    "sexy": 12, "singles": 12, "slots": 12, "spam": 12, "steroids": 12, "strip": 12, "torrent": 12, "weightloss": 12, "wager": 12, "webcam": 12,
    "ad": 7, "ads": 7, "bonus": 7, "buy": 7, "cash": 7, "cheap": 7, "click": 7, "coupon": 7, "deal": 7, "deals": 7,
    "discount": 7, "earn": 7, "farm": 7, "free": 7, "gift": 7, "hot": 7, "instant": 7, "limited": 7, "money": 7, "now": 7,
    "offer": 7, "offers": 7, "order": 7, "prize": 7, "promo": 7, "rich": 7, "sale": 7, "track": 7, "tracker": 7, "win": 7,
}
SOFT_LIMIT = 19
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WITHIN = frozenset(_LOWER + "0123456789")
_FOLD = str.maketrans(_UPPER, _LOWER)


#: Terms that a table of them may have; the automaton travels to every worker.
MOST_TERMS = 1_000_000


def vocabulary_of(terms: DataFrame) -> tuple[tuple[str, ...], dict[str, int]]:
    """Strict terms and soft ones with their weights from ``terms(term, weight)``: a null weight is strict. Terms
    are put in lower case; of several weights of a term the greatest counts, and a strict one above all."""
    folded = terms.where(F.length("term") > 0).select(F.translate("term", _UPPER, _LOWER).alias("term"), "weight")
    found = folded.groupBy("term").agg(F.max("weight").alias("weight"), F.max(F.col("weight").isNull()).alias("strict")).limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return tuple(sorted(r["term"] for r in found if r["strict"])), {r["term"]: r["weight"] for r in found if not r["strict"]}


class Vocabulary:
    def __init__(self, strict=STRICT, soft=None, limit: int = SOFT_LIMIT):
        import ahocorasick

        self.soft, self.limit = dict(SOFT if soft is None else soft), limit
        self.automaton = ahocorasick.Automaton()
        for term in self.soft:
            self.automaton.add_word(term, (term, False))
        for term in strict:
            self.automaton.add_word(term, (term, True))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, url: str | None) -> tuple[int, int]:
        """Distinct strict terms, and the weights of the distinct soft terms."""
        if not url or not len(self.automaton):
            return 0, 0
        text = url.translate(_FOLD)
        found = set()
        for end, (term, strict) in self.automaton.iter(text):
            begin = end - len(term)
            if (begin < 0 or text[begin] not in _WITHIN) and (end + 1 == len(text) or text[end + 1] not in _WITHIN):
                found.add((term, strict))
        return sum(s for _, s in found), sum(self.soft[t] for t, s in found if not s)

    def rejects(self, strict: int, soft: int) -> bool:
        return strict > 0 or soft >= self.limit


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is this one or a domain above it and whose path begins this one; else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=None, limit: int = SOFT_LIMIT) -> DataFrame:
    """Judges every row of ``pages(page_id, url)``.

    Result: page_id, host, path, rule, verdict (allow or block), strict_hits, soft_weight. A null URL has an empty
    host and path, no rule and no hits, and is allowed. Repeated rows are judged each; other columns are not
    carried; no rows give no rows.
    """
    parsed = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), "url")
    verdicts = dict(rules)
    schema = f"page_id {dict(ruled.dtypes)['page_id']}, host string, path string, rule string, verdict string, strict_hits int, soft_weight int"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(strict, soft, limit)
        for batch in batches:
            hits = [vocabulary.hits(u) for u in batch.column(4).to_pylist()]
            verdict = [verdicts[r] if r is not None else "block" if vocabulary.rejects(*h) else "allow" for r, h in zip(batch.column(3).to_pylist(), hits, strict=True)]
            counts = [pa.array([h[i] for h in hits], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict, pa.string()), *counts], ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_weight"])

    return ruled.mapInArrow(judge, schema)


def op5_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _sql() -> str:
    def has(term: str) -> str:
        return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"

    soft = " + ".join(f"CAST({has(t)} AS INTEGER) * {w}" for t, w in SOFT.items())
    strict = " + ".join(f"CAST({has(t)} AS INTEGER)" for t in STRICT)
    rule = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'"
        for r, _ in sorted(RULES, key=lambda r: -len(r[0]))
        for h, _, p in [r.partition("/")]
    )
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)
    return f"""
WITH a AS (
  SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS u,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (
  SELECT page_id, host, path, CASE {rule} END AS rule, {strict} AS strict_hits, {soft} AS soft_weight FROM b)
SELECT page_id, host, path, rule,
       CASE {verdict} WHEN strict_hits > 0 OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_weight AS INTEGER) AS soft_weight
FROM c"""


OP5_SQL = _sql()
