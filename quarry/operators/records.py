"""Transcripts, bundles, segments from elsewhere, and what is derived from recorded events."""

import base64
import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.operators.ordered import with_previous

# The tools that name an edited file, and the characters of a turn.
EDITORS = ("Edit", "MultiEdit", "Write", "NotebookEdit")
LONGEST_TURN = 16_000
BLOCKS = "array<struct<type:string,text:string,name:string,input:struct<file_path:string,notebook_path:string>>>"


def transcript_turns(lines: DataFrame) -> DataFrame:
    """(session, turn, body, ts) of the assistant's turns in JSONL rows (session, pos, line).

    Side chains are left out; a typed message of the user begins a new turn, a tool's result doesn't. A turn is its texts
    with an empty line between, cut at LONGEST_TURN characters, with the files that it edited, and its last time.
    """
    get = lambda path: F.get_json_object("line", path)
    rows = lines.select("session", "pos", get("$.type").alias("type"), get("$.isSidechain").alias("side"), get("$.timestamp").alias("at"), get("$.message.content").alias("content"))
    rows = rows.filter(F.coalesce("side", F.lit("false")) != "true").withColumn("blocks", F.from_json("content", BLOCKS))
    listed = F.ltrim("content").startswith("[")
    typed = (F.col("type") == "user") & F.col("content").isNotNull() & (~listed | F.exists("blocks", lambda b: b["type"] == "text"))
    unit = F.sum(F.coalesce(typed, F.lit(False)).cast("int")).over(Window.partitionBy("session").orderBy("pos"))
    said = rows.withColumn("unit", unit).filter("type = 'assistant'")
    texts = F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & (F.trim(b["text"]) != "")), lambda b: F.trim(b["text"]))
    path = lambda b: F.coalesce(b["input"]["file_path"], b["input"]["notebook_path"])
    edits = F.transform(F.filter("blocks", lambda b: (b["type"] == "tool_use") & b["name"].isin(*EDITORS) & path(b).isNotNull()), path)
    one = F.struct("pos", F.coalesce(texts, F.array().cast("array<string>")).alias("texts"), F.coalesce(edits, F.array().cast("array<string>")).alias("edits"))
    turns = said.groupBy("session", "unit").agg(F.array_sort(F.collect_list(one)).alias("r"), F.max_by(iso_millis(F.col("at")), F.when(F.col("at").isNotNull(), F.col("pos"))).alias("ts"))
    text = F.array_join(F.flatten(F.col("r.texts")), "\n\n")
    edited = F.array_distinct(F.flatten(F.col("r.edits")))
    body = F.concat(
        F.when(F.length(text) > LONGEST_TURN, F.concat(F.substring(text, 1, LONGEST_TURN), F.lit("…"))).otherwise(text),
        F.when(F.size(edited) > 0, F.concat(F.lit("\n\n[edited: "), F.array_join(edited, ", "), F.lit("]"))).otherwise(""),
    )
    return turns.filter(text != "").select("session", F.col("unit").alias("turn"), body.alias("body"), "ts")


def iso_millis(text: Column) -> Column:
    """Milliseconds of an ISO-8601 time with a zone; null for what isn't one."""
    return F.unix_millis(F.try_to_timestamp(text))


def complete_lines(text: Column) -> Column:
    """The lines of a file that may still be written: what follows the last line end is left for later."""
    return F.slice(F.split(text, "\n"), 1, F.greatest(F.size(F.split(text, "\n")) - 1, F.lit(0)))


def bundle_rows(chain: DataFrame, prompts: DataFrame, nodes: DataFrame, links: DataFrame, notes: DataFrame, scope: DataFrame) -> DataFrame:
    """(part, id, row) of a bundle, rows as JSON: the scope's events (seq), their prompts, the links and nodes that hold them, their notes."""
    pack = lambda df, part, key: df.select(F.lit(part).alias("part"), F.col(key).cast("string").alias("id"), F.to_json(F.struct(*df.schema.names), {"ignoreNullFields": "false"}).alias("row"))
    events = chain.join(scope, "seq", "left_semi")
    held = links.join(scope.select(F.col("seq").alias("id")), "id", "left_semi")
    of = nodes.join(held.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    marked = notes.join(scope.select(F.col("seq").alias("target")), "target", "left_semi")
    said = prompts.join(scope.select(F.col("seq").alias("id")), "id", "left_semi")
    return pack(events, "event", "seq").union(pack(said, "prompt", "id")).union(pack(of, "node", "id")).union(pack(held, "link", "id")).union(pack(marked, "note", "id"))


def verify_bundle(events: DataFrame) -> DataFrame:
    """(chain, checked, bad, full_chain, ok): each event's hash; where the numbers follow each other from the first, the links and
    the beginning too. place: an event's number in its chain."""
    rows = with_previous(events, ["chain", "place"], ["chain", "place", "entry_hash"])
    follows = F.coalesce(F.col("before.chain") == F.col("chain"), F.lit(False))
    wrong = F.sha2(graph.event_body(), 256) != F.col("entry_hash")
    gap = follows & (F.col("place") - F.col("before.place") != 1)
    broken = follows & (F.col("before.entry_hash") != F.col("prev_hash"))
    rows = rows.withColumn("wrong", wrong).withColumn("gap", gap).withColumn("broken", broken & ~gap)
    by = rows.groupBy("chain").agg(
        F.count("*").alias("checked"), F.count_if("wrong").alias("bad"), F.max("gap").alias("gaps"), F.max("broken").alias("breaks"),
        F.min_by("prev_hash", "place").alias("begin"), F.min("place").alias("low"),
    )
    full = ~F.col("gaps") & (F.col("low") == 0)
    ok = (F.col("bad") == 0) & ~F.col("breaks") & (~full | (F.col("begin") == graph.GENESIS))
    return by.select("chain", "checked", "bad", full.alias("full_chain"), ok.alias("ok"))


def import_verdicts(known: DataFrame, segment: DataFrame) -> DataFrame:
    """(chain, verdict) of segments (chain, seq, prev_hash, entry_hash) against what is known of their chains: fork, where a
    known row differs; gap, where the first new row isn't next; unlinked, where it doesn't name the last known hash; overlap,
    where known rows come again; else new."""
    both = segment.join(known.select("chain", "seq", F.col("entry_hash").alias("known")), ["chain", "seq"], "left")
    by = both.groupBy("chain").agg(
        F.max(F.coalesce(F.col("known") != F.col("entry_hash"), F.lit(False))).alias("fork"), F.max(F.col("known").isNotNull()).alias("overlap"),
        F.min(F.when(F.col("known").isNull(), F.struct("seq", "prev_hash"))).alias("first"),
    )
    heads = known.groupBy("chain").agg(F.max("seq").alias("last"), F.max_by("entry_hash", "seq").alias("head"))
    joined = by.join(heads, "chain", "left")
    gap = F.col("first").isNotNull() & (F.col("first.seq") != F.coalesce(F.col("last") + 1, F.lit(0)))
    unlinked = F.col("first").isNotNull() & (F.col("first.prev_hash") != F.coalesce("head", F.lit(graph.GENESIS)))
    verdict = F.when(F.col("fork"), "fork").when(gap, "gap").when(unlinked, "unlinked").when(F.col("overlap"), "overlap").otherwise("new")
    return joined.select("chain", verdict.alias("verdict"))


def upsert_foreign(target: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of target and those of rows (chain, seq, text, tombstoned) it lacks, tombstones kept; and (chain, head_seq) of all."""
    fresh = rows.join(target.select("chain", "seq"), ["chain", "seq"], "left_anti").dropDuplicates(["chain", "seq"])
    every = target.unionByName(fresh)
    return every, every.groupBy("chain").agg(F.max("seq").alias("head_seq"))


def deflate(text: Column) -> Column:
    """Raw deflate of UTF-8, in base 64."""

    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            return base64.b64encode(c.compress(t.encode()) + c.flush()).decode()

        return texts.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def inflate(packed: Column, sha256: Column) -> Column:
    """The text again; null where its hash isn't the one given."""

    def run(packs: pd.Series) -> pd.Series:
        return packs.map(lambda p: zlib.decompress(base64.b64decode(p), -15).decode("utf-8", "replace"), na_action="ignore")

    text = F.pandas_udf(run, "string")(packed)
    return F.when(F.sha2(text, 256) == sha256, text)


def first_object(text: str | None, key: str) -> str | None:
    """The first balanced {...} of a text that is JSON and has the key, as compact JSON."""
    decoder, at = json.JSONDecoder(), -1
    while (at := (text or "").find("{", at + 1)) >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except ValueError:
            continue
        if key in found:
            return json.dumps(found, ensure_ascii=False)
    return None


def extract_object(text: Column, key: str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: first_object(t, key))

    return F.pandas_udf(run, "string")(text)


PROPOSAL = (
    "op string, parent_id string, sub_class string, target_kind string, target_id string, note string, title string, node_id string, new_parent_id string,"
    " into array<struct<title:string,link_ids:array<bigint>>>, node_ids array<string>, summary string, cite_seqs array<bigint>, old_seq string, new_seq string, rationale string"
)


def proposals(replies: DataFrame, body: str) -> DataFrame:
    """replies with one row for each valid proposal in the object with `proposals` in a reply: column p, its op's fields checked."""
    listed = F.from_json(extract_object(F.col(body), "proposals"), f"proposals array<struct<{', '.join(c.replace(' ', ':', 1) for c in PROPOSAL.split(', '))}>>")
    rows = replies.withColumn("p", F.explode(listed["proposals"]))
    given = lambda *c: F.concat(*[F.coalesce(F.trim(f"p.{x}"), F.lit("")) for x in c]) if len(c) == 1 else None
    has = lambda *c: _every(given(x) != "" for x in c)
    old, new = F.col("p.old_seq").try_cast("long"), F.col("p.new_seq").try_cast("long")
    rule = {
        "file": has("parent_id", "target_kind", "target_id"), "create": has("parent_id", "title"), "promote": has("node_id"),
        "split": has("node_id") & (F.size("p.into") > 0), "merge": F.size("p.node_ids") >= 2, "collapse": has("node_id", "summary"),
        "supersede": (old > 0) & (new > 0) & (old < new),
    }
    ok = F.lit(False)
    for op, test in rule.items():
        ok = ok | ((F.trim("p.op") == op) & F.coalesce(test, F.lit(False)))
    return rows.filter(ok)


def _every(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def supersede_verdicts(replies: DataFrame, body: str, least: float = 0.8) -> DataFrame:
    """replies with v, the verdicts of a reply, and accepted: to be applied, with enough confidence."""
    listed = F.from_json(extract_object(F.col(body), "verdicts"), "verdicts array<struct<proposalId:bigint,apply:boolean,confidence:double,reason:string>>")
    rows = replies.withColumn("v", F.explode(listed["verdicts"])).filter("v.proposalId IS NOT NULL")
    return rows.withColumn("accepted", F.coalesce(F.col("v.apply"), F.lit(False)) & (F.coalesce(F.col("v.confidence"), F.lit(0.0)) >= least))
