"""Secret scans as column expressions, with multipart credentials linked across a text.

Base kinds are matched leftmost and without overlap: `split` gives the texts between matches, `regexp_extract_all` the
matches, and running sums of their lengths the code-point positions. The linking step looks for the parts of one
credential (access identifiers, long opaque secrets, endpoints) and joins them by interval within a scope: all parts in
reach of each other. A weak candidate (a bare opaque string or an endpoint alone says nothing) is reported only
where the complementary parts are there.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "opaque", "endpoint")

#: Parts of a multipart credential, candidates only.
OPAQUE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?"
#: Characters within which the parts of a credential lie.
SCOPE = 400
#: Matches that are put together at once, and characters of a piece of a text.
CHUNK, PIECE = 128, 1024
SPANS = "array<struct<start:long,end:long,kind:int>>"


def _held(value: Column, use) -> Column:
    """use(value), with the value worked out once: inside a lambda it would be for every element."""
    return F.transform(F.array(value), use)[0]


def _running(rows: Column, measure, join, step, kind: str) -> Column:
    """The arrays (of `kind`) that step(at, row) gives for each row, put together; at: what the rows before measure, joined from 0.

    Appending copies what is there, so rows are taken in chunks of CHUNK: chunks' measures are joined first, then each
    chunk goes from what was before it. The work grows with the rows, but for one copy in CHUNK squared of them.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast(kind)

    def parts(r):
        chunks = F.sequence(F.lit(0), F.floor((F.size(r) - 1) / CHUNK).cast("int"))
        part = lambda i: F.slice(r, i * CHUNK + 1, F.lit(CHUNK))
        totals = F.transform(chunks, lambda i: F.aggregate(part(i), zero, lambda t, x: join(t, measure(x).cast("long"))))
        first = F.struct(zero.alias("at"), F.array().cast("array<long>").alias("out"))
        before = F.aggregate(totals, first, lambda a, t: F.struct(join(a["at"], t).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

        def chunk(x):
            begin = F.struct(x["at"].alias("at"), none.alias("out"))
            return F.aggregate(x["rows"], begin, lambda a, y: F.struct(join(a["at"], measure(y).cast("long")).alias("at"), F.concat(a["out"], step(a["at"], y)).alias("out")))["out"]

        return _held(before, lambda at: F.flatten(F.transform(F.transform(chunks, lambda i: F.struct(F.get(at, i).alias("at"), part(i).alias("rows"))), chunk)))

    return _held(rows, lambda r: F.when(F.size(r) > 0, parts(r)).otherwise(none))


def spans(text: Column, pattern: str, kind: str, at_least: int = 0, group: int = 0) -> Column:
    """array<struct<start, end, kind>> of the matches whose group has at least so many code points."""
    between = F.split(text, pattern, -1)
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("whole"), part.alias("part"))
    rows = F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), F.length(x["part"]).alias("part")))
    empty = _no_spans()

    def step(at, x):
        begin = (at + x["gap"]).cast("long")
        span = F.struct(begin.alias("start"), (begin + x["whole"]).cast("long").alias("end"), F.lit(KINDS.index(kind)).alias("kind"))
        return F.when(x["part"] >= at_least, F.array(span)).otherwise(empty)

    found = _running(rows, lambda x: x["gap"] + x["whole"], lambda a, b: a + b, step, SPANS)
    return F.when(text.rlike(pattern), found).otherwise(empty)


def base_spans(text: Column) -> Column:
    return F.concat(spans(text, ASSIGN, "assign", 6, 2), spans(text, ACCESS, "access", 20), spans(text, HEX, "hex"))


def linked_parts(found: DataFrame) -> DataFrame:
    """(key, more): per row key, the weak candidates that lie within SCOPE of complementary parts.

    found: (key, base, weak) with span arrays. An opaque string needs an access identifier or an endpoint near it; an
    endpoint needs a secret (opaque or assigned) and an access identifier. Parts lie in all buckets of SCOPE characters
    that they touch, weak ones look in all that their reach touches, so that each is joined with the buckets near it only.
    """
    part = lambda column: found.filter(F.size(column) > 0).select("key", F.explode(column).alias("s")).select("key", "s.*")
    weak = part("weak")
    near = weak.select("key").distinct()
    parts = part("base").join(near, "key", "left_semi").union(weak).distinct()
    buckets = lambda low, high: F.explode(F.sequence(F.floor(low / SCOPE), F.floor(high / SCOPE)))
    touched = parts.withColumn("bucket", buckets(F.col("start"), F.col("end")))
    counted = touched.groupBy("key", "bucket", "kind").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("at")
    )
    left = weak.withColumn("bucket", buckets(F.col("start") - SCOPE, F.col("end") + SCOPE))
    right = counted.filter(~F.col("kind").isin(KINDS.index("hex"))).select("key", "bucket", F.col("kind").alias("other"), "at")
    close = F.exists("at", lambda p: (p["start"] < F.col("end") + SCOPE) & (p["end"] > F.col("start") - SCOPE))
    seen = left.join(right, ["key", "bucket"]).filter("kind <> other").filter(close)
    has = lambda k: F.max((F.col("other") == KINDS.index(k)).cast("int")) == 1
    judged = seen.groupBy("key", "start", "end", "kind").agg(
        has("assign").alias("assigned"), has("access").alias("accessed"), has("opaque").alias("opaqued"), has("endpoint").alias("ended")
    )
    ok = F.when(F.col("kind") == KINDS.index("opaque"), F.col("accessed") | F.col("ended"))
    ok = ok.otherwise((F.col("opaqued") | F.col("assigned")) & F.col("accessed"))
    return judged.filter(ok).groupBy("key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("more"))


def render(found: Column) -> Column:
    """kind:start:end, comma-joined, by start and then by kind."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(ordered, one), ",")


def row_key(doc_id: Column, text: Column) -> Column:
    return F.concat_ws(":", doc_id.cast("string"), F.sha2(text, 256))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, weak) of every row of docs: span arrays, weak ones are candidates only. One scan of the texts.

    Null and empty texts have no spans. The key, null without weak candidates, tells rows apart by doc_id and text, so
    parts link within one text only.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    weak = F.when(_hinted(text), F.concat(spans(text, OPAQUE, "opaque"), spans(text, ENDPOINT, "endpoint"))).otherwise(_no_spans())
    key = F.when(_hinted(text), row_key(doc_id, text))
    return cut(docs.select(doc_id.alias("doc_id"), key.alias("key"), base_spans(text).alias("base"), weak.alias("weak")))


def _no_spans() -> Column:
    return F.array().cast(SPANS)


def _hinted(text: Column) -> Column:
    """Whether a text has any weak candidate."""
    return text.rlike(f"{OPAQUE}|{ENDPOINT}")


def _redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by a mark, of overlapping ones the first. It is cut into pieces of PIECE characters once, so
    that what stands between two spans is found without counting from the beginning."""
    kinds = F.array(*map(F.lit, KINDS))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(cut_up, low, high):
        """Characters [low, high)."""
        numbers = F.sequence(F.floor(low / PIECE), F.floor((high - 1) / PIECE))
        one = lambda k: F.substr(F.get(cut_up, k.cast("int")), (F.greatest(low - k * PIECE, F.lit(0)) + 1).cast("int"), (F.least(high - k * PIECE, F.lit(PIECE)) - F.greatest(low - k * PIECE, F.lit(0))).cast("int"))
        return F.when(high > low, F.array_join(F.transform(numbers, one), "")).otherwise("")

    def marked(cut_up):
        def step(at, s):
            mark = F.concat(between(cut_up, at, s["start"]), F.lit("[SECRET:"), F.element_at(kinds, s["kind"] + 1), F.lit("]"))
            return F.when(s["start"] >= at, F.array(mark)).otherwise(F.array().cast("array<string>"))

        ordered = F.array_sort(found)
        out = _running(ordered, lambda s: s["end"], F.greatest, step, "array<string>")
        last = F.aggregate(found, F.lit(0).cast("long"), lambda m, s: F.greatest(m, s["end"]))
        return F.concat(F.array_join(out, ""), _held(F.struct(last.alias("low"), F.length(text).cast("long").alias("high")), lambda x: between(cut_up, x["low"], x["high"])))

    return F.when(F.size(found) > 0, _held(pieces, marked)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span (base or linked) of its text replaced by [SECRET:kind]; overlapping spans become one.

    Texts without a weak candidate are redacted where they are read; only the others are joined with their links.
    """
    names = docs.schema.names
    # the other columns stay together under one name, whatever theirs are
    rest = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row")
    held = docs.select(rest, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hinted = F.coalesce(_hinted(F.col("text")), F.lit(False))
    plain = held.filter(~hinted).select("row", _redacted(F.col("text"), base_spans(F.col("text"))).alias("text"))
    some = held.filter(hinted)
    found = with_links(find_secrets(some)).select("key", F.concat("base", "more").alias("found")).dropDuplicates(["key"])
    keyed = some.withColumn("key", row_key(F.col("doc_id"), F.col("text"))).join(found, "key")
    every = plain.union(keyed.select("row", _redacted(F.col("text"), F.col("found")).alias("text")))
    return every.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in names])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs (doc_id, text; other columns are ignored)."""
    found = with_links(find_secrets(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.concat("base", "more")).alias("spans"),
    )


def with_links(found: DataFrame) -> DataFrame:
    """found with more, the reported weak candidates (an empty array where there are none).

    Links are decided on rows with both a weak candidate and another part; all others pass by the join.
    """
    some = F.size("weak") > 0
    linkable = some & (F.size("weak") + F.size(F.filter("base", lambda s: s["kind"] != KINDS.index("hex"))) > 1)
    none = _no_spans()
    plain = found.filter(~linkable).withColumn("more", none)
    rest = found.filter(linkable)
    joined = rest.join(linked_parts(rest.select("key", "base", "weak")), "key", "left").withColumn("more", F.coalesce("more", none))
    return plain.unionByName(joined)
