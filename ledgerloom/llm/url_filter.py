"""URL filtering: explicit rules, and a character language-model ratio for the URLs that no rule fits.

**Rules.** ``(host, path, verdict)``: a rule fits its host and all subdomains when the URL's path starts with the rule's; the longest wins.

**Model.** Host and path are written in a 35-letter alphabet (A-Z lower-cased, every digit ``0``, anything unusual ``*``, with ``^^`` before
and ``$`` after). For the URLs that rules accept and for those that rules reject, trigram counts give a variable-order Markov model:
Witten-Bell smoothing backs off from two letters of context to one, to none, to uniform. A URL's score is the mean over its letters of
``ln P(accepted) - ln P(rejected)``, in whole millionths so that sums are exact. A fifth of the ruled URLs (page_id divisible by 5) is kept out of
the counts and calibrates the threshold: the point equally many standard deviations from the mean scores of either kind.

The tables of the model have at most one row for each trigram of the alphabet, whatever the input, so they may be broadcast.
Everything is DataFrame functions; URLs are only shuffled as one partial sum each.

**Edge cases.** A null URL, or one without ``://``, has an empty host and path and is scored like any other. Without accepted or without
rejected examples the other kind's verdict holds for all; without either it is ``allow``. Rows that repeat a page_id stay separate rows. An
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialise

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LETTERS = 34  # that can follow: 26 letters, 0 . / _ % - * and the end mark


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits; null without one."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for h, p, _ in ordered]
    values = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ordered]
    return F.coalesce(*[F.when(f, v) for f, v in zip(fits, values, strict=True)])


def letters(host: Column, path: Column) -> Column:
    text = F.translate(F.concat(host, path), _UPPER + "123456789", _LOWER + "0" * 9)
    return F.concat(F.lit("^^"), F.regexp_replace(text, r"[^a-z0./_%\-]", "*"), F.lit("$"))


def _smoothed(kind: str) -> Column:
    """P(third letter | first two) of one kind, from the joined count columns."""
    count = lambda name: F.coalesce(F.col(f"{kind}_{name}"), F.lit(0)).cast("double")
    p1 = (count("n1") + 1) / (count("n") + _LETTERS)
    p2 = F.when(count("c2") > 0, (count("n2") + count("k2") * p1) / (count("c2") + count("k2"))).otherwise(p1)
    return F.when(count("c3") > 0, (count("n3") + count("k3") * p2) / (count("c3") + count("k3"))).otherwise(p2)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every row; ``score`` is the mean log-likelihood difference."""
    kinds = ("allow", "block")
    parsed = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    parsed = parsed.select("row", "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = materialise(parsed.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("row", "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled")), "urls")
    kept_out = F.coalesce(F.col("page_id") % 5 == 0, F.lit(False))
    sides = parsed.where("ruled IS NOT NULL").groupBy("ruled").agg(F.count_if(kept_out).alias("out"), F.count_if(~kept_out).alias("used")).collect()  # two rows
    # page ids may leave a kind without examples on one side of the split: then all ruled rows are counted, and all calibrate
    split = all(r["out"] and r["used"] for r in sides)
    counted, calibrating = (~kept_out, kept_out) if split else (F.lit(True), F.lit(True))
    grams = parsed.select("row", "page_id", "host", "path", "rule", "ruled", F.explode(F.regexp_extract_all(letters(F.col("host"), F.col("path")), F.lit("(?=(...))"), F.lit(1))).alias("gram"))

    learned = grams.groupBy("gram").agg(*[F.count_if((F.col("ruled") == k) & counted).alias(f"{k}_n3") for k in kinds])
    n3 = materialise(learned, "url-grams")
    total = lambda table, key, old, new: table.groupBy(key).agg(*[F.sum(f"{k}_{old}").alias(f"{k}_{new}") for k in kinds])
    contexts = lambda table, key, old, c, k_: table.groupBy(key).agg(*[e for k in kinds for e in (F.sum(f"{k}_{old}").alias(f"{k}_{c}"), F.count_if(F.col(f"{k}_{old}") > 0).alias(f"{k}_{k_}"))])
    n3 = n3.withColumns({"ab": F.substring("gram", 1, 2), "bc": F.substring("gram", 2, 2)})
    n2 = total(n3, "bc", "n3", "n2").withColumns({"b": F.substring("bc", 1, 1), "c": F.substring("bc", 2, 1)})
    n1 = total(n2, "c", "n2", "n1")
    model = n3.join(contexts(n3, "ab", "n3", "c3", "k3"), "ab").join(n2, "bc").join(contexts(n2, "b", "n2", "c2", "k2"), "b").join(n1, "c")
    sizes = n1.agg(*[F.coalesce(F.sum(f"{k}_n1"), F.lit(0)).alias(f"{k}_n") for k in kinds]).first()  # two numbers
    model = model.withColumns({f"{k}_n": F.lit(sizes[f"{k}_n"]) for k in kinds})
    weight = F.round((F.log(_smoothed("allow")) - F.log(_smoothed("block"))) * 1e6).cast("long")
    model = materialise(model.select("gram", weight.alias("weight")), "url-model")

    scored = grams.join(F.broadcast(model), "gram").groupBy("row", "page_id", "host", "path", "rule", "ruled").agg((F.sum("weight") / F.count("*") / 1e6).alias("score"))
    scored = materialise(scored, "url-scores")
    stats = {r["ruled"]: r for r in scored.where(F.col("ruled").isNotNull() & calibrating).groupBy("ruled").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("spread")).collect()}  # two rows
    if sizes["allow_n"] and sizes["block_n"]:
        if len(stats) == 2:
            a, b = stats["allow"], stats["block"]
            spread = a["spread"] + b["spread"]
            threshold = (a["mean"] * b["spread"] + b["mean"] * a["spread"]) / spread if spread else (a["mean"] + b["mean"]) / 2
        else:
            threshold = 0.0
        guessed = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    else:
        guessed = F.lit("block" if sizes["block_n"] else "allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", guessed).alias("verdict"), "score")


def oracle(rules=RULES) -> str:
    """The same verdicts in DuckDB SQL (for tables in which both kinds have calibrating examples)."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fit = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in ordered]
    case = lambda pick: "CASE " + " ".join(f"WHEN {f} THEN '{pick(r)}'" for f, r in zip(fit, ordered, strict=True)) + " END"
    sums = lambda old, new: ", ".join(f"sum({k}_{old}) AS {k}_{new}" for k in ("a", "b"))
    ctx = lambda old, c, t: ", ".join(f"sum({k}_{old}) AS {k}_{c}, count(*) FILTER ({k}_{old} > 0) AS {k}_{t}" for k in ("a", "b"))

    def smoothed(k: str) -> str:
        p1 = f"(({k}_n1 + 1.0::DOUBLE) / ({k}_n + {_LETTERS}))"
        p2 = f"(CASE WHEN {k}_c2 > 0 THEN ({k}_n2 + {k}_k2 * {p1}) / ({k}_c2 + {k}_k2) ELSE {p1} END)"
        return f"(CASE WHEN {k}_c3 > 0 THEN ({k}_n3 + {k}_k3 * {p2}) / ({k}_c3 + {k}_k3) ELSE {p2} END)"

    return f"""
WITH parts AS (
  SELECT row_number() OVER () AS r, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
ruled AS (SELECT *, {case(lambda r: r[0] + r[1])} AS rule, {case(lambda r: r[2])} AS ruled,
    '^^' || regexp_replace(translate(host || path, '{_UPPER}123456789', '{_LOWER}000000000'), '[^a-z0./_%-]', '*', 'g') || '$' AS s FROM parts),
grams AS (SELECT r, page_id, host, path, rule, ruled, s[i:i+2] AS gram FROM (SELECT *, unnest(generate_series(1, len(s) - 2)) AS i FROM ruled)),
n3 AS (SELECT gram, gram[1:2] AS ab, gram[2:3] AS bc, (count(*) FILTER (ruled = 'allow' AND page_id % 5 <> 0))::DOUBLE AS a_n3, (count(*) FILTER (ruled = 'block' AND page_id % 5 <> 0))::DOUBLE AS b_n3 FROM grams GROUP BY gram),
c3 AS (SELECT ab, {ctx("n3", "c3", "k3")} FROM n3 GROUP BY ab),
n2 AS (SELECT bc, bc[1:1] AS b, bc[2:2] AS c, {sums("n3", "n2")} FROM n3 GROUP BY bc),
c2 AS (SELECT b, {ctx("n2", "c2", "k2")} FROM n2 GROUP BY b),
n1 AS (SELECT c, {sums("n2", "n1")} FROM n2 GROUP BY c),
n0 AS (SELECT {sums("n1", "n")} FROM n1),
model AS (SELECT gram, round((ln({smoothed("a")}) - ln({smoothed("b")})) * 1e6)::BIGINT AS weight
  FROM n3 JOIN c3 USING (ab) JOIN n2 USING (bc) JOIN c2 USING (b) JOIN n1 USING (c) CROSS JOIN n0),
scored AS (SELECT r, page_id, host, path, rule, ruled, sum(weight)::DOUBLE / count(*) / 1e6 AS score FROM grams JOIN model USING (gram) GROUP BY ALL),
stats AS (SELECT avg(score) FILTER (ruled = 'allow') AS ma, stddev_pop(score) FILTER (ruled = 'allow') AS sa, avg(score) FILTER (ruled = 'block') AS mb, stddev_pop(score) FILTER (ruled = 'block') AS sb
  FROM scored WHERE page_id % 5 = 0)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= (ma * sb + mb * sa) / (sa + sb) THEN 'allow' ELSE 'block' END) AS verdict
FROM scored, stats"""
