"""Host-level quality rules, in DataFrame functions only.

Every document is measured by fixed rules.  The failures of each rule are
counted by host, the hosts' rates are shrunk by a beta prior fitted to all
hosts, and hosts whose shrunk rate of any rule exceeds a limit lose all their
documents, on top of the documents that fail a base rule themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
HOST_LIMIT = 0.5
MAX_STRENGTH = 1e6

# rule -> condition; "short" and "repeats" are the base rules
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "n_dup_lines > 0 AND 10 * n_dup_lines > n_words",
}


def document_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Words are runs of characters that are not ASCII white space.  A null text
    has none.  Input columns with these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, BLANKS, -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_words", words).withColumn("_lines", lines)
    df = df.withColumn("_keys", F.transform("_words", lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(0), F.size("_keys") - WINDOW)
    grams = F.transform(starts, lambda i: F.xxhash64(*(F.get(F.col("_keys"), i + k) for k in range(WINDOW))))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_grams", F.when(F.size("_keys") >= WINDOW, grams).otherwise(none))
    # only texts with an equal pair of windows pay for sorting them
    ranked = F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    again = F.size(F.array_distinct("_grams")) < F.size("_grams")
    df = df.withColumn("_sorted", F.when(again, ranked))
    same = lambda s, k: F.coalesce(F.get(F.col("_sorted"), k)["g"] == s["g"], F.lit(False))
    twice = F.filter("_sorted", lambda s, k: same(s, k - 1) | same(s, k + 1))
    df = df.withColumn("_twice", F.sort_array(F.transform(twice, lambda s: s["i"])))
    # a window from p covers the words p..p+4 that the last one left
    covered = F.aggregate("_twice", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
                          lambda a: a["n"])
    df = (df.withColumn("n_words", F.size("_words").cast("long"))
          .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
          .withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"))
          .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
          .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
          .drop("_words", "_lines", "_keys", "_grams", "_sorted", "_twice"))
    return df.withColumn("base_failed", F.expr(f"{RULES['short']} OR {RULES['repeats']}"))


def prior(hosts: int, docs: float | None, squares: float | None, failed: float | None, spread: float | None) -> tuple[float, float]:
    """Mean and strength of the beta prior from sums over hosts: documents n, n^2, failures k and k^2 / n."""
    if not docs:
        return 0.0, MAX_STRENGTH
    m = failed / docs
    chance, room = m * (1 - m), docs - squares / docs - (hosts - 1)
    if chance <= 0 or room <= 0:
        return m, MAX_STRENGTH
    alike = ((spread - failed * m) / chance - (hosts - 1)) / room  # correlation of the documents of a host
    return m, min(max(1 / alike - 1, 0.0), MAX_STRENGTH) if alike > 0 else MAX_STRENGTH


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """host, docs, one shrunk failure rate per rule, host_rejected: one row a host (a null host is one too).

    The prior of a rule is the beta distribution of a beta-binomial model, by moments: its mean is the
    rate of all documents, its strength follows from how much more the rates of hosts differ, weighted by
    documents, than chance lets rates of their sizes differ.  If they do not differ more, or no host has two
    documents, all hosts have the mean.  Six numbers a rule reach the driver.
    """
    counts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("docs"), *(F.sum(F.expr(f"cast({c} AS long)")).alias(r) for r, c in RULES.items()))
    hosts = stage(counts, "hosts")
    n = F.col("docs").cast("double")
    moments = hosts.agg(F.count("*").alias("hosts"), F.sum(n).alias("docs"), F.sum(n * n).alias("squares"),
                        *(f(F.col(r).cast("double")).alias(f"{r}_{name}") for r in RULES
                          for name, f in (("k", F.sum), ("q", lambda k: F.sum(k * k / n))))).first()
    rates = {}
    for r in RULES:
        m, strength = prior(moments["hosts"], moments["docs"], moments["squares"], moments[f"{r}_k"], moments[f"{r}_q"])
        rates[r] = (F.col(r) + F.lit(m * strength)) / (F.col("docs") + F.lit(strength))
    return hosts.select("host", "docs", *(c.alias(f"{r}_rate") for r, c in rates.items()),
                        F.greatest(*rates.values()).__gt__(limit).alias("host_rejected"))


def apply_verdicts(measured: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """``measured`` with host_rejected and kept; rows and extra columns stay as they are."""
    v = verdicts.select(F.col("host").alias("_host"), F.col("host_rejected").alias("_rejected"))
    joined = measured.drop("host_rejected", "kept").join(v, F.col(host).eqNullSafe(F.col("_host")), "left")
    rejected = F.coalesce("_rejected", F.lit(False))
    return (joined.withColumn("host_rejected", rejected).withColumn("kept", ~F.col("base_failed") & ~rejected)
            .drop("_host", "_rejected"))


ORACLE = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS r(i)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) AS q WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, range(0, 5) AS r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, cast(len(ws) AS bigint) AS n_words, cast(length(array_to_string(ws, '')) AS bigint) AS word_chars,
        cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
        cast(len(ls) - len(list_distinct(ls)) AS bigint) AS n_dup_lines, cast(coalesce(c.n, 0) AS bigint) AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS docs, {counts} FROM f GROUP BY source),
z AS (SELECT sum(docs) AS n, sum(docs * docs) AS nn, count(*) AS hosts FROM h),
p AS (SELECT {moments} FROM h, z GROUP BY n, nn, hosts),
s AS (SELECT {strengths} FROM p),
v AS (SELECT source, greatest({rates}) > {limit} AS host_rejected FROM h, s)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT host_rejected AS kept, host_rejected
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


def oracle() -> str:
    each = lambda text: ", ".join(text.format(r=r, c=c, top=MAX_STRENGTH) for r, c in RULES.items())
    fill = {
        "{counts}": each("sum(cast({c} AS integer)) AS k_{r}"),
        "{moments}": each("sum(k_{r}) / n AS m_{r}, CASE WHEN sum(k_{r}) BETWEEN 1 AND n - 1 AND n - nn / n > hosts - 1 THEN "
                          "((sum(k_{r} * k_{r} / docs) - sum(k_{r}) * (sum(k_{r}) / n)) / (sum(k_{r}) / n * (1 - sum(k_{r}) / n)) "
                          "- (hosts - 1)) / (n - nn / n - (hosts - 1)) END AS a_{r}"),
        "{strengths}": each("CASE WHEN a_{r} > 0 THEN least(greatest(1 / a_{r} - 1, 0), {top}) ELSE {top} END AS s_{r}, m_{r}"),
        "{rates}": each("(k_{r} + m_{r} * s_{r}) / (docs + s_{r})"),
        "{limit}": str(HOST_LIMIT),
    }
    sql = ORACLE
    for k, v in fill.items():
        sql = sql.replace(k, v)
    return sql
