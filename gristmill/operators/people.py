"""Resolving people and things that go by several names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T

#: Fixed groups of given names that stand for each other.
DIMINUTIVES = (
    ("pip", "philippa"), ("edd", "ed", "edward", "ted"), ("jim", "jimmy", "james"), ("bob", "rob", "robert"), ("bill", "will", "william"),
    ("dick", "richard"), ("jack", "john", "jonathan"), ("harry", "henry"), ("betty", "liz", "beth", "elizabeth"),
    ("kate", "katie", "katharine", "katherine", "kathryn"), ("meg", "megsy", "megan"), ("tony", "anthony"), ("mike", "michael"),
    ("chris", "christopher"), ("dave", "david"), ("steve", "stephen", "steven"), ("matt", "matthew"), ("nick", "nic", "nicolas", "nicholas"),
    ("sam", "samuel"), ("alex", "alexander"), ("ben", "benjamin"), ("dan", "danny", "daniel"), ("joe", "joseph"), ("tom", "thomas"),
    ("andy", "andrew"), ("pete", "peter"), ("greg", "gregory"), ("jess", "jessica"), ("cece", "cecilia"), ("lav", "lavanya"), ("don", "donald"), ("jo", "joanna", "joanne"),
)

#: Fixed groups of city spellings.
CITIES = (("sf", "san francisco", "san fran", "sanfrancisco"), ("nyc", "ny", "new york", "new york city", "brooklyn"), ("la", "los angeles"), ("sea", "seattle"), ("chi", "chicago"))

#: Fixed patterns of answers in a sign-up sheet, asked in this order.
NOT_COMING = r"(?i)\bnot\s+attending\b|^no\b|^n$|^0$"
MAYBE_COMING = r"(?i)50/50|maybe|hopeful|probably|unlikely|tbd|\?"
COMING = r"(?i)100%|^y(?:e+s+|ep|up)|^y$|confident|^iwbly$|lolyes|obvi"


def _groups() -> Column:
    return F.array(*[F.array(*[F.lit(n) for n in g]) for g in DIMINUTIVES])


def split_name(full: Column) -> Column:
    """struct(first, last, nickname): the nickname stands in quotes; tokens without a letter or digit are decoration."""
    quote = "['\"“”‘’]([^'\"“”‘’]+)['\"“”‘’]"
    nick = F.trim(F.regexp_extract(full, quote, 1))
    plain = F.trim(F.regexp_replace(full, quote, " "))
    parts = F.filter(F.split(plain, r"\s+"), lambda p: T.ascii_norm(p) != "")
    return F.struct(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("first"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ").alias("last"), nick.alias("nickname"))


def email_or_empty(s: Column) -> Column:
    t = F.lower(F.trim(s))
    return F.when(t.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), t).otherwise("")


def status_of(raw: Column, default: str) -> Column:
    """not, then maybe, then yes; free text."""
    s = F.trim(raw)
    return (
        F.when(s.isNull() | (s == ""), F.lit(default))
        .when(s.rlike(NOT_COMING), F.lit("not"))
        .when(s.rlike(MAYBE_COMING), F.lit("maybe"))
        .when(s.rlike(COMING), F.lit("attending"))
        .otherwise(F.lit(default))
    )


def confirms(raw: Column) -> Column:
    """A number above zero, or a word that says so."""
    digits = F.regexp_replace(raw, r"[^0-9.\-]", "")
    number = digits.rlike(r"^-?\d+(?:\.\d+)?$")
    return F.coalesce(F.when(number, digits.try_cast("double") > 0).otherwise(F.trim(raw).rlike(r"(?i)^(?:y|yes|paid|venmo|cash|done|✓|✔)(?!\w)")), F.lit(False))


def first_alternatives(name: Column) -> Column:
    return F.filter(F.transform(F.split(name, "[/&]"), T.ascii_norm), lambda x: x != "")


def first_names_agree(a: Column, b: Column) -> Column:
    """A shared alternative, one a prefix (two letters or more) of the other, or one group of diminutives."""
    x, y = first_alternatives(a), first_alternatives(b)
    prefix = F.exists(x, lambda p: F.exists(y, lambda q: (F.length(p) >= 2) & (F.length(q) >= 2) & (F.startswith(p, q) | F.startswith(q, p))))
    group = F.exists(_groups(), lambda g: F.arrays_overlap(g, x) & F.arrays_overlap(g, y))
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.arrays_overlap(x, y) | prefix | group)


def surnames_agree(a: Column, b: Column) -> Column:
    """Equal; one letter for the other's first; or up to three letters for the initials of several words."""
    x, y = T.ascii_norm(a), T.ascii_norm(b)
    initials = lambda n: F.array_join(F.transform(F.split(n, " "), lambda w: F.substring(w, 1, 1)), "")
    several = lambda n: F.size(F.split(n, " ")) > 1
    short = lambda s, n: (F.length(s) <= 3) & several(n) & (s == initials(n))
    return (x != "") & (y != "") & ((x == y) | (((F.length(x) == 1) | (F.length(y) == 1)) & (F.substring(x, 1, 1) == F.substring(y, 1, 1))) | short(x, y) | short(y, x))


def city_key(city: Column) -> Column:
    n, chain = T.letter_norm(city), F
    for g in CITIES:
        chain = chain.when(n.isin(*g), F.lit(g[0]))
    return chain.otherwise(n)


def block_keys(first: Column) -> Column:
    """Keys such that agreeing first names share one: two leading letters of each alternative, and diminutive groups."""
    x = first_alternatives(first)
    letters = F.transform(x, lambda p: F.concat(F.lit("l:"), F.substring(p, 1, 2)))
    groups = F.transform(F.filter(_groups(), lambda g: F.arrays_overlap(g, x)), lambda g: F.concat(F.lit("g:"), F.get(g, F.lit(0))))
    return F.array_distinct(F.concat(letters, groups))


def first_keys(first: Column) -> tuple[Column, Column]:
    """(whole, cut) keys: first names agree if, and only if, a whole key of one is a whole or a cut key of the other. Whole keys are the
    alternatives and their diminutive groups, cut ones their beginnings of two letters or more."""
    x = first_alternatives(first)
    groups = F.transform(F.filter(_groups(), lambda g: F.arrays_overlap(g, x)), lambda g: F.concat(F.lit("g:"), F.get(g, F.lit(0))))
    whole = F.concat(F.transform(F.filter(x, lambda p: p != ""), lambda p: F.concat(F.lit("l:"), p)), groups)
    shorter = lambda p: F.when(F.length(p) > 2, F.transform(F.sequence(F.lit(2), F.length(p) - 1), lambda n: F.concat(F.lit("l:"), F.call_function("left", p, n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(whole), F.array_distinct(F.flatten(F.transform(x, shorter)))


def last_keys(last: Column) -> tuple[Column, Column]:
    """(whole, cut) keys of surnames in the same way: the surname; its first letter, and the initials of several words, up to three."""
    n = T.ascii_norm(last)
    ws = F.split(n, " ")
    initials = F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")
    some = lambda *keys: F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull() & (k != "")))
    return some(n), some(F.substring(n, 1, 1), F.when((F.size(ws) > 1) & (F.length(initials) <= 3), initials))


def meeting(keys: tuple[Column, Column], other: bool) -> Column:
    """Keys of one side (or the ``other``) of an equi-join where whole keys meet whole and cut ones, and cut ones never meet each other."""
    whole, cut = keys
    tag = lambda t, ks: F.transform(ks, lambda k: F.concat(F.lit(t), k))
    return F.concat(tag("ww ", whole), tag("cw " if other else "wc ", whole), tag("wc " if other else "cw ", cut))


def met_by_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share their exploded keys. No side is ever broadcast: keys are many times their table's size on disk, which is what Spark
    would judge them by."""
    return a.hint("merge").join(b.hint("merge"), keys)


def name_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id) whose first names and surnames agree, met through keys that are equal where they agree; both have id, first, last."""
    side = lambda rows, k, other: rows.select(F.col("id").alias(k), F.explode(meeting(first_keys(F.col("first")), other)).alias("key"), "last").select(k, "key", F.explode(meeting(last_keys(F.col("last")), other)).alias("last_key"))
    met = met_by_keys(side(a, "a_id", False), side(b, "b_id", True), ["key", "last_key"])
    return met.select("a_id", "b_id").distinct()


def duplicate_names(people: DataFrame) -> DataFrame:
    """(person_id, survivor): rows of one normalised name give way to the one with most messages."""
    key = F.lower(T.squeeze(F.regexp_replace(F.regexp_replace("name", r"^~\s*", ""), r"\s*\S+@\S+$", "")))
    w = Window.partitionBy(key).orderBy(F.desc("messages"), "person_id")
    return people.select("person_id", F.first("person_id").over(w).alias("survivor"), key.alias("key"))


def repoint(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """References to lost ids become references to survivors."""
    m = mapping.select(F.col("person_id").alias(column), "survivor")
    return rows.join(m, column, "left").withColumn(column, F.coalesce("survivor", column)).select(rows.columns)


def deletions(word: Column) -> Column:
    """The word and all strings with one character gone: words within one edit share one of them."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.call_function("left", word, i - 1), F.call_function("substring", word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 0, cut).otherwise(F.array().cast("array<string>"))))


def near_spellings(a: DataFrame, b: DataFrame, least: int = 8) -> DataFrame:
    """(a_id, b_id): names of ``least`` letters or more within one edit, met through deletion keys.

    Different names meet, however many rows bear them, and rows join their pairs after that. No side is ever broadcast: keys are many times
    their table's size on disk, which is what Spark would judge them by.
    """
    x, y = a.filter(F.length("name") >= least).select("id", "name").distinct(), b.filter(F.length("name") >= least).select("id", "name").distinct()
    pairs = near_names(x, y)
    met = x.select(F.col("id").alias("a_id"), F.col("name").alias("a_name")).join(pairs.hint("merge"), "a_name").join(y.select(F.col("id").alias("b_id"), F.col("name").alias("b_name")).hint("merge"), "b_name")
    met = met.filter(F.col("a_id") != F.col("b_id")).select("a_id", "b_id")
    once = all(rows.groupBy("id").count().filter("count > 1").isEmpty() for rows in ([x] if a is b else [x, y]))
    return met if once else met.distinct()


def near_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_name, b_name): different pairs of names of both within one edit, equal ones included."""
    keyed = lambda rows, c: rows.select(F.col("name").alias(c)).distinct().select(c, F.explode(deletions(F.col(c))).alias("key"))
    met = keyed(a, "a_name").join(keyed(b, "b_name").hint("merge"), "key").filter(F.levenshtein("a_name", "b_name") <= 1)
    return met.select("a_name", "b_name").distinct()


def unique_matches(pairs: DataFrame) -> DataFrame:
    """Pairs of which the left side has exactly one."""
    one = pairs.groupBy("a_id").agg(F.count("*").alias("n"), F.first("b_id").alias("b_id")).filter("n = 1")
    return one.select("a_id", "b_id")


def connected(edges: DataFrame, shared_dir: str) -> DataFrame:
    """(node, root) with the smallest reachable node as root: nodes give way to a neighbour, and the graph shrinks.

    In each round a node is replaced by the first, in a random order, of itself and its neighbours; edges that become loops or equal go, so
    a round works on what is left of the one before, and a chain of n takes about log(n) of them. Then the rounds are followed back to
    the nodes, each with the smallest node that was replaced by the last. Every round is written to ``shared_dir``.
    """
    import uuid

    spark = edges.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = f"{shared_dir}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    once = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = written(once(edges.filter("a is not null and b is not null")))  # loops stay here: they name nodes
    rounds, low = [], None
    while not left.isEmpty():
        at = lambda c: F.xxhash64(c, F.lit(len(rounds)))  # noqa: B023, E731
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(at("b").alias("h"), F.col("b").alias("n"))).alias("m"))
        up = written(first.select(F.col("a").alias("node"), F.least(F.struct(at("a").alias("h"), F.col("a").alias("n")), "m")["n"].alias("up")))
        named = up.withColumn("low", F.col("node")) if low is None else up.join(low, "node")
        low = written(named.groupBy(F.col("up").alias("node")).agg(F.min("low").alias("low")))
        rounds.append((up, low))
        a, b = up.toDF("a", "ua"), up.toDF("b", "ub")
        left = written(once(left.filter("a <> b").join(a, "a").join(b, "b").filter("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b"))))
    roots = None
    for up, low in reversed(rounds):
        known = low.toDF("up", "root")
        if roots is not None:
            known = known.join(roots.toDF("up", "further"), "up", "left").select("up", F.coalesce("further", "root").alias("root"))
        roots = written(up.join(known, "up").select("node", "root"))
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def cliques(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(root, size, clique): whether all pairs of a component are linked."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    n = labels.groupBy("root").agg(F.count("*").alias("size"))
    k = e.join(labels, e["a"] == labels["node"]).groupBy("root").agg(F.count("*").alias("links"))
    return n.join(k, "root", "left").select("root", "size", (F.coalesce("links", F.lit(0)) == F.col("size") * (F.col("size") - 1) / 2).alias("clique"))


def nearest_term(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, term): the closest term within one edit (five letters or fewer) or two, or with the same consonants; three edits never. Met through deletion keys of two deletions and skeletons."""
    two = lambda c: F.array_distinct(F.flatten(F.transform(deletions(c), deletions)))
    keys = lambda c: F.concat(F.transform(two(c), lambda k: F.concat(F.lit("d:"), k)), F.array(F.concat(F.lit("s:"), T.skeleton(c))))
    x = tokens.select("token").distinct().select("token", F.explode(keys(F.col("token"))).alias("key"))
    y = vocabulary.select("term").distinct().select("term", F.explode(keys(F.lower("term"))).alias("key"))
    d = F.levenshtein("token", F.lower("term"))
    ok = (d <= F.when(F.length("token") <= 5, 1).otherwise(2)) | ((T.skeleton(F.col("token")) == T.skeleton(F.col("term"))) & (d <= 3))
    met = x.join(y, "key").select("token", "term").distinct().filter(ok).withColumn("d", d)
    return met.groupBy("token").agg(F.min_by("term", F.struct("d", "term")).alias("term"))
