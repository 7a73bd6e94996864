"""URL filters: host and path rules first, then a weighted vocabulary of strict and soft terms."""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ascii_lower, ship

# Terms that reject a URL alone, and terms of which several different ones do.
STRICT = (
    "blackjack", "bukkake", "camgirl", "camgirls", "camsex", "casino", "casinos", "cialis", "crackz", "cumshot", "cuckold", "deepfake", "escort", "escorts", "fetish", "gangbang", "gore", "hardcore", "hentai",
    "hookup", "hookups", "incest", "keygen", "levitra", "malware", "milf", "nude", "nudes", "nudity", "onlyfans", "phishing", "porn", "porno", "pornstar", "roulette", "sexcam", "sexchat", "sextape", "shemale", "spam",
    "sportsbook", "striptease", "swinger", "swingers", "tramadol", "upskirt", "viagra", "voyeur", "warez", "webcamsex", "xanax", "xxx",
)
SOFT = (
    "ads", "adult", "adserver", "affiliate", "amateur", "babes", "banner", "bet", "bets", "betting", "bikini", "bingo", "bonus", "casual", "cheap", "click", "coupon", "coupons", "crack", "credit", "dating", "debt", "deals",
    "diet", "discount", "drugs", "erotic", "forex", "free", "gambling", "girls", "hot", "insurance", "jackpot", "lingerie", "loan", "loans", "lottery", "mature", "mortgage", "payday", "pharmacy", "pills", "pixel",
    "poker", "popup", "promo", "replica", "rx", "sex", "sexy", "singles", "slot", "slots", "steroids", "sweepstakes", "teen", "torrent", "track", "tracker", "tracking", "weightloss", "win", "winner",
)
SOFT_HITS = 2
#: Terms of a vocabulary that is read from a table, at most.
MOST_TERMS = 1_000_000


def parts(url):
    """(host, path): what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, and from there up to ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def ruled(host, path, rules: list[tuple[str, str, str]]):
    """The longest of the (verdict, host, path) rules that fits: its host or a subdomain, and a path that starts with its own."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) terms of a table (term, strict) of at most MOST_TERMS rows; a term that is listed as both is strict. Null and empty
    terms mean nothing."""
    rows = terms.select(F.lower("term").alias("term"), "strict").where("term <> ''").groupBy("term").agg(F.coalesce(F.bool_or("strict"), F.lit(False)).alias("strict")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return tuple(sorted(r.term for r in rows if r.strict)), tuple(sorted(r.term for r in rows if not r.strict))


def term_hits(urls: DataFrame, strict=STRICT, soft=SOFT) -> DataFrame:
    """Adds n_strict and n_soft: how many different terms stand in url between characters that are no letters or digits. Where the url
    has percent signs, terms that stand in it once it is decoded count as well."""
    ship(urls.sparkSession)
    weight = {**{t.lower(): False for t in soft}, **{t.lower(): True for t in strict}}
    place = urls.columns.index("url")

    def each(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, is_strict in weight.items():
            machine.add_word(term, (term, is_strict))
        machine.make_automaton()
        for batch in batches:
            hard, easy = [], []
            for url in batch.column(place).to_pylist():
                plain, seen = url or "", set()
                for text in {plain.lower(), unquote(plain).lower()} if "%" in plain else (plain.lower(),):
                    for end, found in machine.iter(text) if weight else ():
                        start = end - len(found[0]) + 1
                        if not (start and text[start - 1].isalnum()) and not text[end + 1 : end + 2].isalnum():
                            seen.add(found)
                hard.append(sum(s for _, s in seen))
                easy.append(sum(not s for _, s in seen))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hard, pa.int32()), pa.array(easy, pa.int32())], [*batch.schema.names, "n_strict", "n_soft"])

    columns = ", ".join(f"`{n}` {t}" for n, t in urls.dtypes)
    return urls.mapInArrow(each, f"{columns}, n_strict int, n_soft int")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    A rule decides if one fits, the longest first. Else the URL is blocked if one strict term or ``soft_hits`` different soft
    terms stand in it as whole words. A null url, or one without ``://``, has an empty host and path and fits no rule; its
    terms still count. Rows are judged one by one: repeats alike, null ids kept. Only page_id and url are read. An empty table gives no
    rows; without terms only the rules decide.
    """
    host, path = parts(F.col("url"))
    hits = term_hits(pages.select("page_id", "url"), strict, soft)
    named = hits.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "n_strict", "n_soft")
    by_term = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_hits), "block").otherwise("allow")
    found = named.withColumn("found", ruled(F.col("host"), F.col("path"), rules))
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_term).alias("verdict"))


def oracle_sql(rules: list[tuple[str, str, str]], strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS) -> str:
    plain, decoded = "coalesce(url, '')", "CASE WHEN contains(url, '%') THEN coalesce(TRY(url_decode(url)), '') ELSE '' END"

    def hits(terms):
        stands = lambda text, t: f"regexp_matches(lower({text}), '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])')"
        return " + ".join(f"CAST({stands(plain, t)} OR {stands(decoded, t)} AS INTEGER)" for t in terms)

    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in order]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, order, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, order, strict=True)) + f" WHEN {hits(strict)} >= 1 OR {hits(soft)} >= {soft_hits} THEN 'block' ELSE 'allow' END"
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    split = f"SELECT page_id, url, translate(coalesce(regexp_extract({rest}, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages"
    return f"SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM ({split}) t"
