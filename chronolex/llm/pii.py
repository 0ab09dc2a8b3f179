"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base: four kinds of identifiers by pattern, each leftmost and without overlap, then tested (address parts, Luhn,
number of digits). A failing match is dropped and not retried.

Bootstrap: the base finds are the seed entities. The two words before a seed, whatever their length, and its shape, digits and
case levelled, are its lexical pattern; before the first word of a text stands `^`. Instances are all tokens of the corpus that look
like identifiers (an at sign, or four digits and more). Patterns and instances form a bipartite graph that is scored in rounds:

    score(pattern)  = (sum of the scores of its distinct instances + 1/2) / (number of them + 1)
    score(instance) = 1 for seeds, else 1 - product over its patterns of (1 - score(pattern))

A pattern of at least `support` distinct instances whose score reaches `confidence` is kept; the tokens that it
introduces and that are no base find become spans of kind `context`. Base finds always stay. Ten seeds and nothing else score
0.955, so such a pattern is kept by the defaults.

Edge cases: null and empty texts have no spans: counts 0, the hash of nothing, an empty list; repeated rows each
return a row; offsets are code points; very long texts are searched whole; extra columns are ignored or, with keep_text, kept
(but for such as are named base or spans); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

# The patterns are those of the contract. A run of characters that failed from its start fails from inside as
# well, so a match may only begin where a run begins or the last match ended; loops are possessive wherever
# nothing after them could take back what they took. Both keep very long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot hold the kind, which spares most texts the pattern.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
SPAN = "array<struct<kind: string, start: int, stop: int>>"
#: Tokens that look like identifiers: an at sign, or four digits and more.
TOKEN = r"(?<!\S)(?=\S*?@|(?:[^\s0-9]*+[0-9]){4})\S++"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, less nine where that exceeds nine; the sum ends in zero."""
    digit = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, digit(c)).otherwise(digit(c) * 2 - F.when(digit(c) > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) < 4) & F.forall(F.split(found, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        digits = _digits(found)
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


#: Matches whose places are summed up together: arrays grow by appending, so a text's matches are taken in such groups.
GROUP = 64


def _bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _placed(text: Column, pattern: str, kind: Column, holds) -> Column:
    """The matches that hold, with their offsets: the pieces between matches give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")))

    def step(a: Column, p: Column) -> Column:
        start, stop = a["at"] + p["g"], a["at"] + p["g"] + p["n"]
        span = F.struct(kind.alias("kind"), start.alias("start"), stop.alias("stop"), p["m"].alias("m"))
        return F.struct(stop.alias("at"), F.when(holds(p["m"]), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    def grouped(p: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / GROUP).cast("int")), lambda k: F.slice(p, k * GROUP + 1, F.lit(GROUP)))
        sizes = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda a, x: a + x["g"] + x["n"]))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        pieces = _bound(F.struct(groups.alias("g"), starts.alias("s")), lambda b: F.zip_with(b["g"], F.slice(b["s"], 1, F.size(b["g"])), lambda g, s: F.aggregate(g, F.struct(s.alias("at"), _none().alias("out")), step, lambda a: a["out"])))
        return F.when(F.size(p) > 0, F.flatten(pieces)).otherwise(_none())

    return _bound(pairs, grouped)


def _none() -> Column:
    return F.array().cast("array<struct<kind: string, start: int, stop: int, m: string>>")


def base_spans(text: Column) -> Column:
    """All base finds of a text: kind, start, stop and the match, by kind and then by start."""
    return F.concat(*(F.when(text.rlike(NEEDS[k]), _placed(text, p, F.lit(k), lambda m, k=k: _holds(k, m))).otherwise(_none()) for k, p in PATTERNS.items()))


def _levelled(word: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(word, F.lit("^"))), "[0-9]+", "0")


def _mentions(text: Column) -> Column:
    """Tokens that look like identifiers: start, stop, m and pattern, the two words before and the shape (digits as 0, letters as a)."""
    shape = lambda w: F.regexp_replace(F.regexp_replace(w, "[0-9]+", "0"), r"\p{L}+", "a")
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))

    def patterns(w: Column) -> Column:
        each = F.transform(w, lambda x, i: F.when(x.rlike("^" + TOKEN), F.concat_ws(" ", _levelled(F.get(w, i - 2)), _levelled(F.get(w, i - 1)), shape(x))))
        return F.filter(each, lambda x: x.isNotNull())

    tokens = _placed(text, TOKEN, F.lit("token"), lambda m: F.lit(True))
    return F.zip_with(tokens, _bound(words, patterns), lambda t, p: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), t["m"].alias("m"), p.alias("pattern")))


def learn_patterns(mentions: DataFrame, rounds: int = 3, support: int = 10, confidence: float = 0.95) -> DataFrame:
    """High-confidence patterns of (pattern, instance, seed boolean), one column `pattern`."""
    graph = mentions.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    # A pattern of a single instance never reaches its support, and one without any seed stays at nothing unless a
    # round lifts an instance of it; both leave at once, which keeps the graph small.
    enough = graph.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    graph = materialise(graph.join(enough, "pattern"), "pattern-graph")
    scores = graph.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"), F.max("seed").alias("known"))
    patterns = None
    for _ in range(rounds):
        patterns = graph.join(scores, "instance").groupBy("pattern").agg(((F.sum("score") + 0.5) / (F.max("n") + 1)).alias("weight"))
        patterns = materialise(patterns, "patterns")
        lifted = graph.join(patterns, "pattern").groupBy("instance").agg(F.max("seed").alias("known"), (1 - F.exp(F.sum(F.log1p(-F.least("weight", F.lit(0.999)))))).alias("lifted"))
        scores = lifted.select("instance", F.when(F.col("known"), 1.0).otherwise(F.col("lifted")).alias("score"))
    return patterns.where(F.col("weight") >= confidence).select("pattern")


#: Pairs of a mention and a base find of one text that are looked at one by one.
PAIRS = 4096


def with_seeds(looked: DataFrame) -> DataFrame:
    """row, t, seed for each mention t of (row, base, mentions): it is a seed where a base find covers some of it.

    Texts with few of both are settled in place. Of the others, mentions and finds are rows in one order: a mention, at its end, is covered
    if the farthest end of the finds that begin before reaches past its start. So a long text costs what sorting its finds does."""
    few = F.size("mentions").cast("long") * F.size("base") <= PAIRS
    marked = F.transform("mentions", lambda t: F.struct(t.alias("t"), F.exists("base", lambda b: (b["start"] < t["stop"]) & (b["stop"] > t["start"])).alias("seed")))
    short = looked.where(few).select("row", F.explode(marked).alias("e")).select("row", "e.t", "e.seed")
    many = looked.where(~few).dropDuplicates(["row"])  # rows equal in id and text are told apart by nothing
    kind = looked.schema["mentions"].dataType.elementType
    finds = many.select("row", F.explode("base").alias("b")).select("row", F.col("b.start").alias("at"), F.lit(1).alias("side"), F.col("b.stop").alias("past"), F.lit(None).cast(kind).alias("t"))
    tokens = many.select("row", F.explode("mentions").alias("t")).select("row", F.col("t.stop").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("past"), "t")
    before = Window.partitionBy("row").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = finds.unionByName(tokens).withColumn("past", F.max("past").over(before)).where("side = 0")
    return short.unionByName(ordered.select("row", "t", F.coalesce(F.col("past") > F.col("t.start"), F.lit(False)).alias("seed")))


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 10, confidence: float = 0.95, keep_text: bool = False) -> DataFrame:
    """The documents' id with `base` and `spans`, arrays of kind, start and stop, base first; keep_text: all other columns too."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"))
    found = docs.select("id", "row", "text", base_spans(text).alias("base"))

    looked = found.select("id", "row", "base", F.when(text.rlike("@|[0-9]"), _mentions(text)).alias("mentions"))
    looked = materialise(looked, "mentions")

    each = with_seeds(looked)
    mentions = each.select(F.col("t.pattern").alias("pattern"), F.xxhash64("t.m").alias("instance"), "seed")
    trusted = learn_patterns(mentions, rounds, support, confidence)
    new = each.where(~F.col("seed")).select("row", "t.start", "t.stop", "t.pattern").distinct().join(trusted, "pattern", "left_semi")
    added = new.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.lit("context").alias("kind"), "start", "stop"))).alias("added"))
    plain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["stop"].alias("stop")))
    spans = [plain.alias("base"), F.concat(plain, F.coalesce("added", F.array().cast(SPAN))).alias("spans")]
    result = looked.join(added, "row", "left").select(F.col("id").alias(id_col), "row", *spans)
    if not keep_text:
        return result.drop("row")
    # Rows equal in id and text have equal spans; texts without any need not wait for the join.
    marked = result.where(F.size("spans") > 0).select("row", "base", "spans").dropDuplicates(["row"])
    given = documents.drop("base", "spans")
    whole = given.select(F.struct(*given.columns).alias("given"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"))
    return whole.join(marked, "row", "left").select("given.*", *(F.coalesce(c, F.array().cast(SPAN)).alias(c) for c in ("base", "spans")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with every span as its kind in angle brackets; of overlapping spans the earlier one stays."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    masked = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["stop"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("out")),
        ).otherwise(a),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, masked).otherwise(text)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, PATTERNS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

