"""Secret scans: base patterns, and character Markov models of random strings and ordinary identifiers.

Everything is DataFrame expressions. ``scan`` makes one pass over the texts: each match of a base pattern, and each candidate
(a run of ``MIN_CANDIDATE`` or more characters of ``ALPHABET``), becomes a row with the length of the text since the match
before it. Places are running sums of those lengths per document, and which candidates touch no base span shows in running
extremes of the base spans' ends before and starts after them; so a text costs the sorting of its matches and no more.

``train`` counts character transitions of labelled strings (1 random, 0 ordinary)
and returns the table of log-likelihood ratios, start and end included. In
the query values that a base pattern has found are 1, and so are ``GENERATED`` digests
each in base 64 and in hex; words of a sample of ``TRAIN_DOCS`` documents, the base spans
cut out and too short to be candidates, are 0. ``TRAIN_SECRETS`` and ``TRAIN_DOCS`` bound the samples, chosen by hash order of the
value or id.
A candidate is a secret if its log-likelihood ratio is ``MIN_RATIO`` nats per
transition or more.

Defined results: null and empty texts have no spans; every text is scanned whole, however long; repeated rows are scanned
each; ties of start are ordered as the kinds are listed; a null doc_id stays null; without samples of one label its model is
flat; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import materialise

#: Fixed patterns of the base, Java syntax; letters of the first group in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0 is before and after
MIN_CANDIDATE = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}"
WORDS = r"[A-Za-z0-9+/_=-]{6,}"
TRAIN_SECRETS = 4096
TRAIN_DOCS = 512
MIN_RATIO = 2.0
PRIOR = 0.5
BACK_OFF = 5.0
GENERATED = 256


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Each match, left to right, with the length of what stands before it, back to the match before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.split(text, pattern, -1), matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")))
    one = lambda x, n: F.struct(F.lit(KINDS.index(kind)).alias("kind"), n.alias("n"), x["gap"].alias("gap"), x["value"].alias("value"))
    none = F.array().cast("array<struct<kind:int,n:int,gap:int,value:string>>")
    return F.when(text.rlike(pattern), F.transform(F.filter(both, lambda x: x["value"].isNotNull()), one)).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, stop, value), written once: base spans and free candidates; a document without either has one row of nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*[_matches(text, k, p) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True)])
    each = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found"))
    each = each.select("row", "doc_id", F.explode_outer("found").alias("m")).select("row", "doc_id", "m.*")
    along = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    long = F.length("value")
    each = each.withColumn("stop", F.sum(F.col("gap") + long).over(along).cast("int")).withColumn("start", F.col("stop") - long)
    each = each.filter(F.col("kind").isNull() | (F.col("kind") > 0) | (F.length(F.regexp_extract("value", ASSIGN, 2)) >= MIN_VALUE) | (F.col("n") == 0))
    short = (F.col("kind") == 0) & (F.length(F.regexp_extract("value", ASSIGN, 2)) < MIN_VALUE)
    each = each.withColumn("kind", F.when(~short, F.col("kind")))  # a document's first match stays as its row, as nothing
    base = F.col("kind") < KINDS.index("markov")
    order = Window.partitionBy("row").orderBy("start", "kind")
    ended = F.max(F.when(base, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"))  # a running minimum from the end
    begins = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(ended, F.lit(0)) <= F.col("start")) & (begins.isNull() | (begins >= F.col("stop")))
    each = each.withColumn("kind", F.when(base | free, F.col("kind")))
    blank = lambda c: F.when(F.col("kind").isNotNull(), F.col(c)).alias(c)
    return materialise(each.select("row", "doc_id", "kind", blank("start"), blank("stop"), blank("value")))


def labelled(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(value, label) from the base's own finds and from words around them."""
    own = F.when(F.col("kind") == 0, F.regexp_extract("value", ASSIGN, 2)).otherwise(F.col("value"))
    secrets = found.filter(F.col("kind") < KINDS.index("markov")).select(own.alias("value")).distinct()
    secrets = secrets.orderBy(F.xxhash64("value"), "value").limit(TRAIN_SECRETS).select("value", F.lit(1).alias("label"))
    n = docs.sparkSession.range(GENERATED).select(F.concat(F.lit("sample:"), F.col("id").cast("string")).alias("s"))
    made = n.select(F.explode(F.array(F.translate(F.base64(F.unhex(F.sha2("s", 256))), "=", ""), F.sha1("s"))).alias("value"), F.lit(1).alias("label"))
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # TRAIN_DOCS ids
    plain = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, pattern, " ")
    words = some.select(F.explode(F.regexp_extract_all(plain, F.lit(WORDS), F.lit(0))).alias("value"), F.lit(0).alias("label"))
    words = words.filter(F.length("value") < MIN_CANDIDATE)  # a candidate's label is what is asked
    return secrets.unionByName(made).unionByName(words)


def _transitions(value: Column) -> Column:
    """Cells (row of the state before, column of the state after) of a string's transitions, its ends included."""
    state = lambda i: F.call_function("instr", F.lit(ALPHABET), F.call_function("substring", value, i, F.lit(1)))
    n = F.length(value)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, F.lit(0)).otherwise(state(i)) * STATES + F.when(i == n, F.lit(0)).otherwise(state(i + 1)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of random over ordinary, STATES * STATES of them, from (value, label)."""
    counts = samples.filter("value is not null and value <> ''").select("label", F.explode(_transitions(F.col("value"))).alias("cell")).groupBy("label", "cell").count()
    seen = {1: [0] * STATES**2, 0: [0] * STATES**2}
    for r in counts.collect():  # 2 * STATES ** 2 rows at most
        seen[r["label"]][r["cell"]] += r["count"]

    def logs(n: list[int]) -> list[float]:
        """Transitions, smoothed towards how often the label has each character at all."""
        total = sum(n)
        alone = [(sum(n[c::STATES]) + PRIOR) / (total + PRIOR * STATES) for c in range(STATES)]
        rows = [sum(n[k * STATES : (k + 1) * STATES]) for k in range(STATES)]
        return [math.log((n[c] + BACK_OFF * alone[c % STATES]) / (rows[c // STATES] + BACK_OFF)) for c in range(STATES**2)]

    return [a - b for a, b in zip(logs(seen[1]), logs(seen[0]), strict=True)]


def ratio(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per transition."""
    table = F.expr("array(" + ",".join(f"{x!r}D" for x in model) + ")")
    total = F.aggregate(_transitions(value), F.lit(0.0), lambda acc, c: acc + F.get(table, c))
    return total / (F.length(value) + 1)


def secrets(docs: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): arrays of (start, kind, stop) in order; ``spans`` has what the models add as well."""
    found = scan(docs)
    model = train(labelled(found, docs))
    added = KINDS.index("markov")
    kept = found.withColumn("kind", F.when((F.col("kind") < added) | (ratio(F.col("value"), model) >= min_ratio), F.col("kind")))
    span = F.struct("start", "kind", "stop")
    count = lambda k: F.count_if(F.col("kind") == KINDS.index(k)).alias(f"n_{k}")
    arrays = [F.sort_array(F.collect_list(F.when(c, span))).alias(n) for n, c in (("base", F.col("kind") < added), ("spans", F.col("kind").isNotNull()))]
    return kept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[count(k) for k in KINDS[:3]], *arrays).drop("row")


def joined(c: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op3_secret_markov(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
