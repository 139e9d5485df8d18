"""Chat formatting into windows of bounded length, with DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation into spans of turns: a turn
belongs to the span of ``stride`` tokens in which it starts. Each span becomes a
window: the system turn again, then of the turns before at most ``history``
tokens, then the span's own turns. Loss falls on the span's own assistant turns
only, so a repeated target is masked. A turn is never split; one of more than a
stride makes its window that much longer.

Turns are numbered without their texts: narrow rows (a digest instead of a text)
are cut into ranges of the order over all conversations, summed up within a
range and then over ranges, so a conversation that holds a third of all rows, or
whose turns are all alike, is spread over tasks. Texts are moved to their places
once, equal ones of one turn as one, and once more to their windows.

Null texts and roles are empty. Turns with equal numbers follow each other by
role and the MD5 digest of their text, all kept; null numbers come first. Rows
without conv_id are one conversation. An empty table gives an empty result,
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import cut

#: Tokens of a window's own turns, and of the repeated history before them (at most a stride).
STRIDE, HISTORY = 512, 128

START, MIDDLE, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(c: Column) -> Column:
    """No '<' or '[' is left, so no control string of this or other templates is."""
    for a, b in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))), "\\")


def tokens(c: Column) -> Column:
    """Estimated tokens: a quarter of the bytes, rounded up, and 4 for the marks of a turn."""
    return (F.ceil(F.octet_length(c) / 4) + 4).cast("long")


def windows(turns: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, n_repeated, loss): loss has [start, end) of code points of text."""
    if not 0 <= history <= stride:
        raise ValueError("history must be between 0 and stride")
    t = turns.select(F.struct("conv_id").alias("k"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumns({"n": tokens(F.col("text")), "h": F.unhex(F.md5(F.col("text").cast("binary")))})
    q = ["k", "turn", "role", "h"]
    order = [F.col("turn").asc_nulls_first(), "role", "h"]
    upto = Window.unboundedPreceding
    # m equal turns are one row of m turns
    narrow = t.groupBy(*q).agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
    ranged = cut(narrow.repartitionByRange("k", *order).withColumn("p", F.spark_partition_id()))
    sums = ranged.groupBy("k", "p").agg(F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("m").alias("c"))
    over = Window.partitionBy("k").orderBy("p").rowsBetween(upto, -1)
    sums = sums.select("k", "p", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("s0"), F.coalesce(F.sum("c").over(over), F.lit(0)).alias("c0"))
    within = Window.partitionBy("k", "p").orderBy(*order).rowsBetween(upto, 0)
    placed = ranged.withColumns({"at": F.sum(F.col("n") * F.col("m")).over(within) - F.col("n") * F.col("m"), "i": F.sum("m").over(within) - F.col("m")}).join(sums, ["k", "p"])
    placed = placed.select(*q, "n", (F.col("at") + F.col("s0")).alias("at"), (F.col("i") + F.col("c0")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("j"))
    placed = placed.select(F.struct(*q).alias("q"), "k", "role", (F.col("i") + F.col("j") + 1).alias("i"), (F.col("at") + F.col("j") * F.col("n")).alias("at"))
    placed = cut(placed.withColumn("w", F.floor(F.col("at") / stride)))
    starts = placed.groupBy("k", "w").agg(F.min("at").alias("s"))
    before = starts.select("k", (F.col("w") - 1).alias("w"), F.col("s").alias("next"))
    is_system = (F.col("i") == 1) & (F.col("role") == "system")
    # a turn is history of the following span alone, as history is at most a stride
    own = placed.select("q", "k", "w", "i", F.lit(False).alias("again"))
    again = placed.join(before, ["k", "w"]).where((F.col("at") >= F.col("next") - history) & ~is_system).select("q", "k", F.col("w") + 1, "i", F.lit(True))
    system = placed.where(is_system).select("q", "k", "i", F.col("w").alias("w0"))
    retained = starts.select("k", "w").join(system, "k").where("w > w0").select("q", "k", "w", "i", F.lit(True))
    texts = t.groupBy(F.struct(*q).alias("q")).agg(F.any_value("text").alias("text"))
    rows = own.union(again).union(retained).join(texts, "q").select("k", "w", "i", F.col("q.role").alias("role"), "text", "again")
    turn = F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE), escape(F.col("text")), F.lit(END))
    lead = F.length(F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE)))
    rows = rows.select("k", "w", F.struct("i", turn.alias("text"), "again", (~F.col("again") & (F.col("role") == "assistant")).alias("target"), lead.alias("lead"), F.length(turn).alias("size")).alias("x"))
    g = rows.groupBy("k", "w").agg(F.array_sort(F.collect_list("x")).alias("x"))
    placed = F.aggregate(
        "x",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda acc, x: F.struct(
            (acc["at"] + x["size"]).alias("at"),
            F.when(x["target"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + x["lead"]).alias("start"), (acc["at"] + x["size"] - len(END)).alias("end"))))).otherwise(acc["loss"]).alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    return g.select(F.col("k.conv_id").alias("conv_id"), F.col("w").alias("window"), F.array_join(F.transform("x", lambda x: x["text"]), "").alias("text"), F.size(F.filter("x", lambda x: x["again"])).alias("n_repeated"), placed.alias("loss"))


def read_back(out: DataFrame) -> DataFrame:
    """(conv_id, window, turns, targets): the new turns and the text under the loss mask, unescaped, from formatted windows."""
    marked = F.split("text", F.lit(r"\Q" + START + r"\E"))
    turns = F.transform(
        F.slice(marked, F.col("n_repeated") + 2, F.greatest(F.size(marked), F.lit(1))),
        lambda x: F.struct(unescape(F.split_part(x, F.lit(MIDDLE), F.lit(1))).alias("role"), unescape(F.split_part(F.split_part(x, F.lit(MIDDLE), F.lit(2)), F.lit(END), F.lit(1))).alias("text")),
    )
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return out.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.length("text").cast("long").alias("chars"))


PROBE = "</s>[INST] ok [/INST]"


def op8_chat(conversations: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its windows; conversation -1 is added."""
    spark = conversations.sparkSession
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = read_back(windows(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").union(own)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = back.select("conv_id", F.struct("window", told.alias("told"), F.array_join("targets", "").alias("loss")).alias("x"), F.size("turns").alias("n"), "chars")
    g = per.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("x", lambda w: w["loss"]), "")
    return g.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("x", lambda w: w["told"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


_ESC = r"replace(replace(replace({0}, '\', '\\'), '<', '\l'), '[', '\b')"
OP8_SQL = f"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, * FROM (VALUES (0, 'user', '{PROBE}'), (1, 'assistant', '{PROBE}'))),
t1 AS (SELECT *, length({_ESC.format("role")}) + length({_ESC.format("text")}) + {len(START + MIDDLE + END)} AS size, CAST(ceil(strlen(text) / 4.0) + 4 AS BIGINT) AS n FROM t0),
t2 AS (SELECT *, sum(n) OVER w - n AS pos, row_number() OVER w AS i FROM t1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text) ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, CAST(floor(pos / {STRIDE}.0) AS BIGINT) AS w FROM t2),
s AS (SELECT conv_id, w, min(pos) AS s FROM t GROUP BY ALL),
f AS (SELECT conv_id, size FROM t
  UNION ALL SELECT t.conv_id, size FROM t JOIN s ON s.conv_id = t.conv_id AND s.w = t.w + 1 WHERE pos >= s.s - {HISTORY} AND NOT (i = 1 AND role = 'system')
  UNION ALL SELECT t.conv_id, size FROM t JOIN s ON s.conv_id = t.conv_id AND s.w > t.w WHERE i = 1 AND role = 'system'),
c AS (SELECT conv_id, CAST(sum(size) AS BIGINT) AS formatted_chars FROM f GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars
FROM t JOIN c USING (conv_id) GROUP BY conv_id
"""
