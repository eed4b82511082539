"""Quotation linking: messages that quote others, put in the order of their replies and freed of the quotes."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scourframe.llm import common

#: Marks at the beginning of a line, one for each level of quotation.
MARKS = re.compile(r"^(?:[ \t]?>)+[ \t]?")


def key_of(passage: str) -> str | None:
    """Digest of a passage in lower case with single spaces; none for a passage of white space."""
    words = " ".join(passage.lower().split())
    return hashlib.md5(words.encode("utf-8", "surrogatepass")).hexdigest() if words else None


def parsed(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """What a message says itself, and its quoted passages: runs of lines of one level, with their levels."""
    own, quoted = [], []
    last = 0
    for line in (text or "").split("\n"):
        marks = MARKS.match(line)
        level = marks.group().count(">") if marks else 0
        if not level:
            own.append(line)
        elif level == last:
            quoted[-1][1].append(line[marks.end():])
        else:
            quoted.append((level, [line[marks.end():]]))
        last = level
    return "\n".join(own).strip("\n"), [(level, "\n".join(lines)) for level, lines in quoted]


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Put messages into the order of their replies, without quotes.

    Returns conv_col, turn_col, `own_text` (lines that are not quoted), `n_quotes` (quoted passages), `n_linked` (those found in
    an earlier message of the conversation), `n_foreign` (those found in other conversations only), `reply_to` (turn answered), `root`
    (first turn of the thread), `depth` (replies between), `position` (place in the conversation, from 0).

    A passage is known by the digest of its normalised text. It belongs to the first message that says it itself, as its whole text
    or as one of its lines. A quoted passage that is nobody's as a whole is looked up by its lines. A message answers the
    message whose passage it quotes at the lowest level, ties to the earliest; it must be an earlier turn. Positions go by
    thread, depth and turn, so that a message never stands before the one it answers. Threads are followed by doubling, in which
    only messages that have not reached their first one take part, and written in between. Keys are digests with the conversation, folded before the exchange; one
    conversation may be spread over all tasks.

    A null or empty text quotes nothing and is quoted by nobody. No row is lost: of rows that repeat a conversation and turn the one of
    the smallest text (null first) takes part, and the others, like rows without conversation or turn, are returned with null links and
    a null position. An empty table gives no rows. Other columns are not read.
    """
    rows = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text"))
    keyed = chosen(rows, "conv", "turn", "text")

    def parse(batches):
        for batch in batches:
            own_texts, said, quotes, counts = [], [], [], []
            for text in batch.column(2).to_pylist():
                own, quoted = parsed(text)
                own_texts.append(own)
                said.append(sorted({k for k in map(key_of, [own, *own.split("\n")]) if k}))
                found = []
                for n, (level, passage) in enumerate(quoted):
                    lines = passage.split("\n")
                    found += [{"passage": n, "level": level, "part": part, "key": k} for part, k in enumerate(map(key_of, [passage, *(lines if len(lines) > 1 else [])])) if k]
                quotes.append(found)
                counts.append(len({f["passage"] for f in found}))
            kind = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("part", pa.int32()), ("key", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(own_texts, pa.string()), pa.array(said, pa.list_(pa.string())), pa.array(quotes, kind), pa.array(counts, pa.int32())],
                ["conv", "turn", "main", "own_text", "said", "quotes", "n_quotes"])

    every = common.settled(keyed.mapInArrow(parse, "conv long, turn long, main boolean, own_text string, said array<string>, quotes array<struct<passage:int,level:int,part:int,key:string>>, n_quotes int"), "messages")
    read = every.filter("main").drop("main")
    said = read.select("conv", "turn", F.explode("said").alias("key"))
    here = said.groupBy("conv", "key").agg(F.min("turn").alias("origin"))
    anywhere = said.groupBy("key").agg(F.min("conv").alias("first_conv"), F.max("conv").alias("last_conv"))
    asked = read.select("conv", "turn", F.explode("quotes").alias("q")).select("conv", "turn", "q.*")
    found = asked.join(here, ["conv", "key"], "left").join(anywhere, "key", "left")
    local = F.when(F.col("origin") < F.col("turn"), F.struct("part", "origin"))
    foreign = (F.col("first_conv") != F.col("conv")) | (F.col("last_conv") != F.col("conv"))
    passages = found.groupBy("conv", "turn", "passage", "level").agg(F.min(local).alias("near"), F.max(F.coalesce(foreign, F.lit(False))).alias("far"))
    links = passages.groupBy("conv", "turn").agg(
        F.min(F.when(F.col("near").isNotNull(), F.struct("level", F.col("near.origin").alias("origin"))))["origin"].alias("reply_to"),
        F.count("near").cast("int").alias("n_linked"), F.count_if(F.col("near").isNull() & F.col("far")).cast("int").alias("n_foreign"))
    nodes = common.settled(read.select("conv", "turn", "n_quotes").join(links, ["conv", "turn"], "left"), "replies")

    answers = F.col("reply_to").isNotNull()
    state = nodes.select("conv", "turn", F.coalesce("reply_to", "turn").alias("root"), answers.cast("long").alias("depth"), (~answers).alias("ended"))
    state = common.settled(state, "threads")
    while not state.filter("not ended").isEmpty():
        above = state.select("conv", F.col("turn").alias("root"), F.col("root").alias("top"), F.col("depth").alias("more"), F.col("ended").alias("over"))
        moved = state.filter("not ended").join(above, ["conv", "root"])
        moved = moved.select("conv", "turn", F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("over").alias("ended"))
        following = common.settled(state.filter("ended").unionByName(moved), "threads")
        common.dropped(state)
        state = following
    state = state.drop("ended")

    spread = parts or int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["root", "depth", "turn"]
    placed = common.numbered(state.repartitionByRange(spread, "conv", *order), "conv", order, "position")
    joined = read.select("conv", "turn", "own_text").join(nodes, ["conv", "turn"]).join(placed, ["conv", "turn"])
    result = joined.select(
        "conv", "turn", "own_text", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("n_foreign", F.lit(0)).alias("n_foreign"), "reply_to", "root", "depth", "position")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    alone = every.filter("not main").select(
        "conv", "turn", "own_text", "n_quotes", null("int", "n_linked"), null("int", "n_foreign"), null("long", "reply_to"), null("long", "root"), null("long", "depth"), null("long", "position"))
    return result.unionByName(alone).withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def chosen(rows: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """The rows, with `main`: whether a row is the one of its conversation and turn that takes part. Repeats are found by their keys alone, and
    only they are folded; equal texts count before they are dealt, so that a row repeated very often is no hot group."""
    whole = F.col(conv).isNotNull() & F.col(turn).isNotNull()
    rows = common.settled(rows.select(conv, turn, text), "rows")
    often = rows.filter(whole).groupBy(conv, turn).agg(F.count("*").alias("n")).filter("n > 1").select(conv, turn)
    single = rows.filter(whole).join(often, [conv, turn], "left_anti").withColumn("main", F.lit(True))
    texts = rows.join(often, [conv, turn]).groupBy(conv, turn, text).agg(F.count("*").cast("int").alias("n"))
    first = texts.groupBy(conv, turn).agg(F.min(F.struct(F.col(text).isNotNull().alias("there"), F.col(text).alias("text"))).alias("first"))
    repeats = texts.join(first, [conv, turn]).withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    repeats = repeats.select(conv, turn, text, ((F.col("copy") == 1) & F.col(text).eqNullSafe(F.col("first.text"))).alias("main"))
    return single.unionByName(repeats).unionByName(rows.filter(~whole).withColumn("main", F.lit(False)))


def marked(text: Column, mark: str) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(F.lit(mark), line)), "\n")


def as_mail(conversations: DataFrame) -> DataFrame:
    """Conversations as mail would have them: each turn quotes the turn before it, and in that the turn before that. Every row becomes a mail;
    of a turn that is repeated the row of the smallest text is quoted, and a row without conversation or turn quotes nothing."""
    own = common.settled(chosen(conversations.select("conv_id", "turn", "text"), "conv_id", "turn", "text"), "turns")
    quoted = own.filter("main")
    one = quoted.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    two = quoted.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("earlier"))
    joined = own.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", F.concat_ws("\n", marked(F.col("earlier"), ">> "), marked(F.col("before"), "> "), F.col("text")).alias("text"))


def op1_quotation_linking(spark, sf_dir: str) -> DataFrame:
    """All turns of `conversations`, written as mail that quotes the two turns before; quotes found, threads, order, own text."""
    linked = link_quotes(as_mail(common.table(spark, sf_dir, "conversations")))
    return linked.select("conv_id", "turn", "n_quotes", "n_linked", "reply_to", "root", "depth", "position", F.md5(F.col("own_text").cast("binary")).alias("own_md5"))


OP1_SQL = r"""
WITH RECURSIVE every AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, trim(lower(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS whole,
         conv_id IS NOT NULL AND turn IS NOT NULL AND row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST) = 1 AS main
  FROM conversations
), m AS (
  SELECT * FROM every WHERE main
), said AS (
  SELECT conv_id, turn, whole AS key FROM m WHERE whole <> ''
  UNION
  SELECT conv_id, turn, trim(lower(regexp_replace(line, '\s+', ' ', 'g'))) FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM m)
), origin AS (
  SELECT conv_id, key, min(turn) AS origin FROM said WHERE key <> '' GROUP BY ALL
), replies AS (
  SELECT m.conv_id, m.turn, m.text, CAST((coalesce(b.whole, '') <> '')::INT + (coalesce(e.whole, '') <> '')::INT AS INTEGER) AS n_quotes,
         coalesce(ob.origin, oe.origin) AS reply_to
  FROM m LEFT JOIN m b ON b.conv_id = m.conv_id AND b.turn = m.turn - 1 LEFT JOIN m e ON e.conv_id = m.conv_id AND e.turn = m.turn - 2
  LEFT JOIN origin ob ON ob.conv_id = m.conv_id AND ob.key = b.whole LEFT JOIN origin oe ON oe.conv_id = m.conv_id AND oe.key = e.whole
), threads AS (
  SELECT conv_id, turn, turn AS root, CAST(0 AS BIGINT) AS depth FROM replies WHERE reply_to IS NULL
  UNION ALL
  SELECT r.conv_id, r.turn, t.root, t.depth + 1 FROM replies r JOIN threads t ON t.conv_id = r.conv_id AND t.turn = r.reply_to
)
SELECT conv_id, turn, n_quotes, n_quotes AS n_linked, reply_to, root, depth,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY root, depth, turn) - 1 AS BIGINT) AS position, md5(trim(text, chr(10))) AS own_md5
FROM replies JOIN threads USING (conv_id, turn)
UNION ALL
SELECT x.conv_id, x.turn, CAST((coalesce(b.whole, '') <> '')::INT + (coalesce(e.whole, '') <> '')::INT AS INTEGER), NULL, NULL, NULL, NULL, NULL, md5(trim(x.text, chr(10)))
FROM every x LEFT JOIN m b ON b.conv_id = x.conv_id AND b.turn = x.turn - 1 LEFT JOIN m e ON e.conv_id = x.conv_id AND e.turn = x.turn - 2
WHERE NOT x.main
"""
