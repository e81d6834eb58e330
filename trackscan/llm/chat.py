"""Chat formatting by multi-party perspective rotation (operator 2), in DataFrame functions only.

For every participant (distinct role) of a conversation the dialogue is rendered once with that speaker
as the assistant and the others as named users. Masks are the character spans that the assistant said,
its turn end included. A dialogue is rendered in parts of PART turn numbers, and a part in which one turn
number is on more than HOT rows in slices of at most about HOT rows, so that a conversation of any length
never meets in one task. Where a part starts is a running sum of lengths over rows without texts, first within
blocks of parts, then over blocks; texts are shuffled once, to their part.

Defined results: a null role speaks as `unknown`, a null text says nothing, a null turn sorts before
all others and opens part 0; rows of a null conversation are one conversation; rows that repeat a turn
are rendered each, ordered by role and text (by slice before that, where a turn is on more than HOT rows);
empty and very long texts are rendered whole; other columns aren't looked at, whatever their names; an empty
table gives no rows. Markers inside a text are kept as they are: only the offsets tell markup from speech.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turn numbers in one part of a rendered dialogue; rows of one turn number in a slice, about; parts in a block.
PART, HOT, BLOCK = 64, 4096, 1024
#: Copies of one row that a slice renders at most.
COPIES = 64
ASSISTANT, USER, CLOSE, END = "<|assistant|>\n", "<|user name=", "|>\n", "<|end|>\n"
SPANS = "array<struct<start:bigint,end:bigint>>"
#: What names a slice of a part: the turn (null where the part is whole), a bucket of its rows, and of their copies.
SLICE = ["turn", "bucket", "copy"]


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """a joined with b on keys, of which null equals null."""
    renamed = b.withColumnsRenamed({k: f"{k}_b" for k in keys})
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in keys))
    return a.join(renamed, same, how).drop(*(f"{k}_b" for k in keys))


def _slices(own: DataFrame, hot: int) -> DataFrame:
    """c, part, SLICE, n, who, said and m, the number of equal rows that stand here."""
    many = own.groupBy("c", "part", "n").agg(F.count("*").alias("rows")).where(F.col("rows") > hot)
    # a part has no more than PART turn numbers and null
    crowded = many.groupBy("c", "part").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce(F.col("n").cast("string"), F.lit("")), F.ceil(F.col("rows") / hot)))).alias("many"))
    marked = _met(own, crowded, ["c", "part"]).withColumn("buckets", F.try_element_at("many", F.coalesce(F.col("n").cast("string"), F.lit(""))))
    split, whole = F.col("buckets").isNotNull(), F.col("many").isNull()
    bucket = F.when(split, F.pmod(F.xxhash64("who", "said"), F.col("buckets"))).otherwise(0).cast("long")
    placed = marked.select("c", "part", (~whole).alias("cut"), F.when(~whole, F.col("n")).alias("turn"), bucket.alias("bucket"), split.alias("split"), "n", "who", "said")
    plain = placed.where("NOT split").select("c", "part", "cut", "turn", "bucket", F.lit(0).cast("long").alias("copy"), "n", "who", "said", F.lit(1).cast("long").alias("m"))
    # equal rows are counted before they meet, and come back by COPIES
    counted = placed.where("split").groupBy("c", "part", "cut", "turn", "bucket", "n", "who", "said").agg(F.count("*").alias("rows"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / COPIES))))
    return plain.unionByName(each.withColumn("m", F.least(F.lit(COPIES).cast("long"), F.col("rows") - F.col("copy") * COPIES)).drop("rows"))


def _starts(rows: DataFrame) -> DataFrame:
    """c, part, cut, SLICE, participant and start: where each slice begins in each perspective. No texts move."""
    place = ["c", "part", "cut", *SLICE]
    named = F.length(F.concat(F.lit(USER), F.col("who"), F.lit(CLOSE)))
    by = rows.groupBy(*place, "who").agg(
        F.sum(F.col("m") * (named + F.length("said") + len(END))).alias("size"),
        F.sum(F.col("m") * (named - len(ASSISTANT))).alias("less"),
    )
    people = by.select("c", F.col("who").alias("participant")).distinct()
    grid = _met(by.groupBy(*place).agg(F.sum("size").alias("size")), people, ["c"], "inner")
    sized = _met(grid, by.select(*place, F.col("who").alias("participant"), "less"), [*place, "participant"])
    sized = sized.withColumns({"size": F.col("size") - F.coalesce("less", F.lit(0)), "block": F.floor(F.col("part") / BLOCK)}).drop("less")
    blocks = sized.groupBy("c", "participant", "block").agg(F.sum("size").alias("whole"))
    ahead = Window.partitionBy("c", "participant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("c", "participant", "block", F.coalesce(F.sum("whole").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("c", "participant", "block").orderBy("part", *SLICE).rowsBetween(Window.unboundedPreceding, -1)
    inner = sized.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return _met(inner, before, ["c", "participant", "block"], "inner").select(*place, "participant", (F.col("base") + F.col("within")).cast("long").alias("start"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART, hot: int = HOT) -> DataFrame:
    """conv, participant, part, slice (null where the part is whole), n_turns, rendered, masks (array of structs start, end), start."""
    own = turns.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("unknown")).alias("who"), F.coalesce(F.col(text), F.lit("")).alias("said"))
    rows = _slices(own.withColumn("part", F.coalesce(F.floor(F.col("n") / part), F.lit(0)).cast("long")), hot)
    place = ["c", "part", "cut", *SLICE]
    # one row for each part or slice: its turns in order
    parts = rows.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("n", "who", "said", "m"))).alias("turns"))
    each = _met(_starts(rows), parts, place, "inner")

    def shape(t: Column) -> Column:
        mine = t["who"] == F.col("participant")
        head = F.when(mine, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), t["who"], F.lit(CLOSE)))
        return F.struct(head.alias("head"), F.concat(t["said"], F.lit(END)).alias("body"), mine.alias("own"), t["m"].alias("m"))

    shaped = each.withColumn("t", F.transform("turns", shape))
    shaped = shaped.withColumn("rendered", F.array_join(F.transform("t", lambda x: F.call_function("repeat", F.concat(x["head"], x["body"]), x["m"].cast("int"))), ""))
    zero = F.struct(F.col("start").alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        head, body = F.length(x["head"]).cast("long"), F.length(x["body"]).cast("long")
        spans = F.transform(F.sequence(F.lit(0).cast("long"), x["m"] - 1), lambda i: F.struct((acc["at"] + i * (head + body) + head).alias("start"), (acc["at"] + (i + 1) * (head + body)).alias("end")))
        return F.struct((acc["at"] + x["m"] * (head + body)).alias("at"), F.when(x["own"], F.concat(acc["spans"], spans)).otherwise(acc["spans"]).alias("spans"))

    masks = F.aggregate("t", zero, step, lambda acc: acc["spans"])
    n_turns = F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["m"])
    piece = F.when(F.col("cut"), F.struct(*SLICE))
    return shaped.select(F.col("c").alias(conv), "participant", "part", piece.alias("slice"), n_turns.alias("n_turns"), "rendered", masks.alias("masks"), "start")


def query(turns: DataFrame) -> DataFrame:
    """Every part of every perspective; masks as text, start:end of each span."""
    done = rotate(turns)
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return done.select("conv_id", "participant", "part", "n_turns", "rendered", spans.alias("masks"), "start")


ORACLE_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, turn AS n, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said,
         coalesce(CAST(floor(turn / {PART}e0) AS BIGINT), 0) AS part
  FROM conversations
), people AS (SELECT DISTINCT c, who AS participant FROM own),
each AS (
  SELECT o.c, p.participant, o.part, o.n, o.who, o.said,
         CASE WHEN o.who = p.participant THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || o.who || '|>' || chr(10) END AS head,
         o.said || '<|end|>' || chr(10) AS body
  FROM own o JOIN people p ON o.c IS NOT DISTINCT FROM p.c
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY c, participant ORDER BY part, n NULLS FIRST, who, said
                ROWS UNBOUNDED PRECEDING) AS high
  FROM each
)
SELECT c AS conv_id, participant, part, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY n NULLS FIRST, who, said) AS rendered,
       coalesce(string_agg(CAST(CAST(high - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(high AS BIGINT) AS VARCHAR), ',' ORDER BY n NULLS FIRST, who, said)
         FILTER (who = participant), '') AS masks,
       CAST(min(high - length(head) - length(body)) AS BIGINT) AS start
FROM placed GROUP BY c, participant, part
"""
