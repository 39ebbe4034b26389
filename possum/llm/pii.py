"""PII: base patterns, and contextual extraction bootstrapped from what they find.

Base entities (email, ip, card, phone) are seeds. The words around a seed make
lexical patterns: the two words before it, and the word before with the word
after; one of them holds a letter. What else stands at a pattern's place is an
instance of it, if it is more than a plain word: a token with a digit, with a
sign between letters ("johndoe_at_mail"), or a group of digits ("078 05 1120").
A pattern's score is the share of its distinct instances that are known; well
supported patterns of high score are good. An instance becomes known if enough
of its places in the whole corpus are at good patterns, so that a number that
once stands at such a place stays a number. Rounds go on until nothing is
added. DataFrame and SQL functions only.

Positions come from splitting a text at the matches: the lengths of the pieces
between and of the matches before add up to the start, and their blanks to the
place of the match among the words of the text, where its context is read: the
whole words before and after, for seeds and tokens alike. The patterns carry
lookbehinds and possessive repeats that leave the matches as they are and keep
the matching linear on long runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from possum.llm.common import Scratch, doc_key, packed

KINDS = ("email", "ip", "card", "phone")
FOUND = "context"  # kind of a span that a pattern discovered
_EMAIL_CHARS = "[A-Za-z0-9._%+-]"
_SIGN = r"\p{L}[_.@/:#~&=+|\\-]++\p{L}"
# A match may start where the last one ended or where its first run starts.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_EMAIL_CHARS})){_EMAIL_CHARS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # the maximal runs of 14 to 19 digits; others are matches that fail
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # for the instances: neighbouring groups of digits, a token with a digit, a token with a sign between letters
    "token": r"(?<![^\x20\x09-\x0D])(?:[(+]?[0-9][0-9().+-]*+(?![\p{L}\p{N}])(?:\x20\(?[0-9][0-9().+-]*+(?![\p{L}\p{N}]))++"
    rf"|[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+|[^\x20\x09-\x0D]*?{_SIGN}[^\x20\x09-\x0D]*+)",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_SPACE = r"[\x20\x09-\x0D]+"
MIN_SUPPORT, MIN_SCORE = 3, 0.5
LEAD, TAIL = r"^(?!\+[0-9]|\([0-9]+\)[^\p{L}\p{N}]*[0-9])[^\p{L}\p{N}]*", r"[^\p{L}\p{N}]*$"  # punctuation around an instance
ROUNDS = 200  # in which nothing more must be found at last; more are an error


def _breaks(piece: Column) -> Column:
    return F.size(F.split(piece, _SPACE, -1)) - 1


def _pieces(text: Column, kind: str, worth: Column) -> Column:
    """Array of (kind, i, gap, breaks, value) for the matches of a kind; nulls none."""
    pattern = F.lit(PATTERNS[kind])
    matches, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    n = F.size(matches)
    # zipped outside the lambda, so a text is split once and not for every match
    zipped = F.arrays_zip(matches, F.slice(gaps, 1, n))
    one = lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(x["1"]).alias("gap"), _breaks(x["1"]).alias("breaks"), x["0"].alias("value"),
    )
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,breaks:int,value:string>>")
    return F.when(worth, F.transform(zipped, one)).otherwise(none)


def _valid() -> Column:
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    luhn = F.expr(
        "aggregate(transform(sequence(1, length(regexp_replace(value, '[^0-9]', ''))), "
        "i -> int(substr(regexp_replace(value, '[^0-9]', ''), -i, 1)) * if(i % 2 = 0, 2, 1)), 0, (s, v) -> s + if(v > 9, v - 9, v)) % 10 = 0"
    )
    return (
        F.when(F.col("kind") == "ip", F.col("value").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(F.col("kind") == "card", luhn)
        .when(F.col("kind") == "phone", n.between(10, 15))
        .otherwise(F.lit(True))
    )


def _rank() -> Column:
    return reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), -1)).otherwise(len(KINDS))


KEY = ["k_id", "k_text"]


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *doc_key(F.col(id_col), text))


def _spans(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, keys), and the rows (keys, kind, start, end, value, two, one, following) of valid matches and free tokens."""
    scratch = Scratch(df.sparkSession, "pii")
    docs, text = _documents(df, id_col, text_col), F.col("text")
    digit, at, plus = text.rlike("[0-9]"), F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    worth = {"email": at, "ip": F.col("digit") & F.contains(text, F.lit(".")), "card": F.col("digit"), "phone": F.col("digit") & plus, "token": F.col("digit") | text.rlike(_SIGN)}
    found = docs.withColumn("digit", digit)
    found = found.select("doc_id", *KEY, "text", *(_pieces(text, k, w).alias(k) for k, w in worth.items()))
    found = found.select("doc_id", *KEY, "text", F.concat(*worth).alias("found"))
    # only the texts with a match are kept, and meet their matches again in a join
    found = scratch.save(found.withColumn("text", F.when(F.size("found") > 0, F.col("text"))))
    # equal rows (same id and text) would double the running sums: one of them is enough
    rows = found.where("size(found) > 0").select(*KEY, "found").dropDuplicates(KEY).select(*KEY, F.inline("found"))
    so_far = Window.partitionBy(*KEY, "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("value")).over(so_far)
    # a match begins and ends with a character of a word, so no break spans two pieces
    last = F.sum(F.col("breaks") + _breaks(F.col("value"))).over(so_far)
    rows = rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("value"))
    rows = rows.withColumn("last", last.cast("int")).withColumn("first", F.col("last") - _breaks(F.col("value")))
    # an instance is a token without the punctuation around it
    lead, tail = (F.length(F.regexp_extract("value", p, 0)) for p in (LEAD, TAIL))
    cut = lambda n: F.when(F.col("kind") == "token", n).otherwise(0)
    rows = rows.withColumns({"start": F.col("start") + cut(lead), "end": F.col("end") - cut(tail)})
    rows = rows.withColumn("value", F.substr("value", cut(lead) + 1, (F.col("end") - F.col("start")).cast("int")))
    rows = rows.where(_valid())
    # a token that overlaps a base span is that span, not an instance of its own
    base = F.col("kind") != "token"
    order = Window.partitionBy(*KEY).orderBy("start", "end")
    reach = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    next_ = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(F.col("reach"), F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("next"), F.lit(2**62)) >= F.col("end"))
    rows = rows.withColumn("reach", reach).withColumn("next", next_).where(base | free)
    return found.select("doc_id", *KEY), scratch.save(_contexts(rows, found.where("text is not null")))


def _contexts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(keys, kind, start, end, value, two, one, following): with the second and the first word before, and the word after; null or empty at the ends of a text."""
    by_doc = rows.groupBy(*KEY).agg(F.collect_list(F.struct("kind", "start", "end", "value", "first", "last")).alias("found"))
    texts = docs.select(*KEY, "text").dropDuplicates(KEY)
    # a lambda's variable holds the words, so a text is split once and not for every match
    word = lambda words, i: F.when(i >= 0, F.get(words, i))
    near = lambda words: F.transform(
        F.col("found"),
        lambda x: F.struct(
            *(x[c].alias(c) for c in ("kind", "start", "end", "value")),
            word(words, x["first"] - 2).alias("two"), word(words, x["first"] - 1).alias("one"), word(words, x["last"] + 1).alias("following"),
        ),
    )
    words = F.array(F.split("text", _SPACE, -1))
    return by_doc.join(texts, KEY).select(*KEY, F.inline(F.flatten(F.transform(words, near))))


def _patterns() -> Column:
    """Lexical patterns around a match; only contexts with the words they need."""
    two, one, following = (F.lower(c) for c in ("two", "one", "following"))
    left = F.when((two != "") & (one != ""), F.concat(F.lit("l:"), two, F.lit(" "), one))
    around = F.when((one != "") & (following != ""), F.concat(F.lit("a:"), one, F.lit(" _ "), following))
    return F.filter(F.array_compact(F.array(left, around)), lambda p: F.substr(p, F.lit(3)).rlike(r"\p{L}"))


def _discover(rows: DataFrame, min_support: int, min_score: float, rounds: int) -> DataFrame:
    """(value): instances that high-confidence patterns make known, from the pattern-instance graph.

    ``rows`` hold all places of all values. Raises if the known values still
    grow in the last of ``rounds`` rounds.
    """
    scratch = Scratch(rows.sparkSession, "pii-graph")
    seed = F.col("kind") != "token"
    numbered = rows.select(F.lower("value").alias("value"), seed.alias("seed"), _patterns().alias("patterns"))
    # (pattern, value, seed), and for the tokens the sets of patterns of their places, equal places counted
    edges = scratch.save(numbered.select(F.explode("patterns").alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    tokens = numbered.where("not seed").groupBy("value", "patterns").agg(F.count(F.lit(1)).alias("n"))
    tokens = scratch.save(tokens.withColumn("set", F.xxhash64("value", "patterns")))
    total = tokens.groupBy("value").agg(F.sum("n").alias("total"))
    known = scratch.save(edges.where("seed").select("value").distinct())
    open_ = total.join(known, "value", "left_anti")
    n = known.count()
    for _ in range(rounds):
        marked = edges.select("pattern", "value").join(known.withColumn("known", F.lit(1)), "value", "left")
        scores = marked.groupBy("pattern").agg(F.count("known").alias("support"), F.count(F.lit(1)).alias("n"))
        good = scores.where((F.col("support") >= min_support) & (F.col("support") >= min_score * F.col("n"))).select("pattern")
        at_good = tokens.select("value", "set", "n", F.explode("patterns").alias("pattern")).join(good, "pattern", "left_semi")
        counts = at_good.select("value", "set", "n").distinct().groupBy("value").agg(F.sum("n").alias("good"))
        fresh = open_.join(counts, "value").where(F.col("good") >= min_score * F.col("total")).select("value")
        known = scratch.save(known.union(fresh).distinct())
        before, n = n, known.count()
        if n == before:
            return open_.select("value").join(known, "value", "left_semi")
    raise RuntimeError(f"patterns still found new values in round {rounds}")


def _joined(spans: DataFrame, where: Column, name: str) -> Column:
    item = F.struct("start", _rank().alias("rank"), "kind", "end")
    text = lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(where, item))), text), ",").alias(name)


def all_spans(rows: DataFrame, min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE, rounds: int = ROUNDS, min_digits: int = 0, min_length: int = 1) -> DataFrame:
    """Base spans and discovered ones: (keys, kind, start, end). ``min_digits`` and ``min_length``: of a discovered instance."""
    fits = (F.length(F.regexp_replace("value", "[^0-9]", "")) >= min_digits) & (F.length("value") >= min_length)
    rows = rows.where((F.col("kind") != "token") | fits)
    found = _discover(rows, min_support, min_score, rounds)
    tokens = rows.where("kind = 'token'").withColumn("low", F.lower("value"))
    new = tokens.join(found.withColumnRenamed("value", "low"), "low", "left_semi").select(*KEY, F.lit(FOUND).alias("kind"), "start", "end")
    return rows.where("kind <> 'token'").select(*KEY, "kind", "start", "end").unionByName(new)


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE, rounds: int = ROUNDS,
                       min_digits: int = 0, min_length: int = 1) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context) for every row.

    Spans are ``kind:start:end`` in code points with the end exclusive. A null
    or empty text has none: counts 0, an empty ``spans``, the digest of the
    empty string. Repeated rows get equal results and count once as evidence;
    other columns are ignored; an empty table gives an empty result. A
    discovered instance is marked wherever it stands.
    """
    docs, rows = _spans(df, id_col, text_col)
    spans = all_spans(rows, min_support, min_score, rounds, min_digits, min_length)
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    base = F.col("kind") != FOUND
    by_doc = spans.groupBy(*KEY).agg(*(count(k).alias(f"n_{k}") for k in (*KINDS, FOUND)), _joined(spans, base, "base"), _joined(spans, F.lit(True), "spans"))
    zero = lambda k: F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}")
    return docs.join(by_doc, KEY, "left").select(
        "doc_id", *map(zero, KINDS), F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero(FOUND)
    )


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The rows of ``df`` with every span replaced by its kind in brackets, all other columns as they are.

    Of spans that overlap the later one is cut to what the earlier ones leave.
    A null or empty text stays as it is, repeated rows are all rewritten
    alike, an empty table gives an empty one. ``count_col`` names a column that gets the new
    length of the changed texts.
    """
    _, rows = _spans(df, id_col, text_col)
    spans = all_spans(rows)
    order = Window.partitionBy(*KEY).orderBy("start", _rank(), "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    apart = spans.withColumn("from", F.greatest("start", reach)).where("end > from")
    cuts = apart.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("from", "end", "kind"))).alias("k_cuts"))
    joined = packed(df, id_col, text_col).join(cuts, KEY, "left")
    text, all_ = F.col("row")[text_col], F.col("k_cuts")
    gap = lambda x, i: F.substr(text, F.coalesce(F.get(all_, i - 1)["end"], F.lit(0)) + 1, x["from"] - F.coalesce(F.get(all_, i - 1)["end"], F.lit(0)))
    parts = F.transform(all_, lambda x, i: F.concat(gap(x, i), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    whole = F.concat(F.array_join(parts, ""), F.substr(text, F.element_at(all_, -1)["end"] + 1))
    row = F.col("row").withField(text_col, F.when(all_.isNull(), text).otherwise(whole))
    if count_col:
        n = F.when(all_.isNull(), F.col("row")[count_col]).otherwise(F.length(whole))
        row = row.withField(count_col, n.cast(df.schema[count_col].dataType))
    return joined.select(row.alias("row")).select("row.*")
