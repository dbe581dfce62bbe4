"""Views that give the star-schema tables the columns of evidence tables, in Spark and in SQL.

Each view is defined once here in both forms; operators take column names, so queries run on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.operators import evidence
from cuelake.sources.shared import checkpointed


#: So many rows a task at most, where a view is dealt by key: memory of a task stays the same as tables grow.
ROWS_A_TASK = 500_000


class Tables:
    """The tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dealt(self, rows: DataFrame, name: str, key: str) -> DataFrame:
        """``rows`` of a table dealt by ``key`` in as many partitions as its number of rows (from the footers) asks for; fewer, larger ones are what Spark would make of narrow rows."""
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.read(name).count() // ROWS_A_TASK))
        return rows.repartition(tasks, key)

    def log(self) -> DataFrame:
        e = self.read("events")
        kind = F.when(F.col("event_type") == "error", "attempt").when(F.col("event_type") == "signup", "decision").otherwise("revision")
        status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "approved")
        author = F.when(F.col("event_type") == "view", "ocr").when(F.col("event_type") == "click", "human").when(F.col("event_type") == "purchase", "translation")
        return e.select(
            (F.col("user_id") * 100 + F.dayofmonth("ts")).cast("bigint").alias("cue_id"), F.col("event_id").alias("append_seq"), "user_id", kind.alias("kind"), status.alias("status"), author.alias("author"), "event_type",
            F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 1000").alias("at_ms"), "value", "props",
        )

    def revisions(self) -> DataFrame:
        return self.log().where("kind = 'revision'").select("cue_id", "append_seq", "author", "user_id", F.concat_ws(":", "author", F.col("append_seq").cast("string")).alias("document"))

    def deleted_log(self) -> DataFrame:
        """The log after revisions were deleted, others appended and some deleted again.

        What is appended is written, as a store would: else its numbers are looked for in the log before whenever the log after is read.
        """
        log = self.log().select("user_id", "cue_id", "append_seq", "kind", "status", "author", F.lit(None).cast("bigint").alias("revision_seq"))
        append = lambda log, rows: log.unionByName(checkpointed(rows), allowMissingColumns=True)
        log = append(log, evidence.delete_from_log(log, F.col("append_seq") % 7 == 0, project="user_id"))
        again = checkpointed(evidence.live_revisions(log).where("cue_id % 3 = 0").select("user_id", "cue_id", F.lit("revision").alias("kind")).distinct())
        log = append(log, evidence.append_revisions(again, log, "human", keys=["cue_id"], project="user_id").drop("review_status"))
        return append(log, evidence.delete_from_log(log, F.col("append_seq") % 5 == 0, project="user_id"))

    def cues(self) -> DataFrame:
        c = self.read("conversations")
        return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("cue_id"), F.col("conv_id").alias("track_id"), F.col("turn").alias("cue_index"), "role", "text", (F.col("turn") * 2000).alias("start_ms"), (F.col("turn") * 2000 + 1500).alias("end_ms"))

    def lines(self) -> DataFrame:
        d = self.read("documents")
        return d.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", "lang", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")

    def geometry(self) -> DataFrame:
        return self.read("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 1900).alias("x"), (F.col("l_suppkey") * 97 % 1060).alias("y"), (F.col("l_quantity").cast("bigint") * 10).alias("w"),
            (F.col("l_linenumber") * 12).cast("bigint").alias("h"), F.lit(1920).cast("bigint").alias("cw"), F.lit(1080).cast("bigint").alias("ch"),
        )

    def positions(self) -> DataFrame:
        return self.read("events").select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 60000000").alias("pos")).distinct()

    def spans(self) -> DataFrame:
        order = Window.partitionBy("line").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        ruby = F.col("l_quantity").cast("bigint") % 10 == 0
        said = F.concat(F.col("l_linestatus"), F.col("l_linenumber").cast("string"))
        style = F.when(F.col("l_returnflag") == "R", F.array(F.lit("bold"))).when(F.col("l_returnflag") == "A", F.array(F.lit("italic"))).otherwise(F.array().cast("array<string>"))
        note = F.array(F.struct(F.lit("n").alias("text"), F.lit("over").alias("position")))
        rows = self.dealt(self.read("lineitem").withColumnRenamed("l_orderkey", "line"), "lineitem", "line")  # once: the window and all that goes by line follow it
        return rows.select("line", F.row_number().over(order).cast("bigint").alias("ord"), F.when(ruby, "ruby").otherwise("text").alias("type"), F.when(~ruby, said).alias("text"), F.when(ruby, said).alias("base"), F.when(ruby, note).alias("annotations"), style.alias("styles"), F.lit(None).cast("string").alias("color"))

    def diagnostics(self) -> DataFrame:
        level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warning").otherwise("info")
        return self.log().select(F.col("user_id").alias("session_id"), F.col("append_seq").alias("sequence"), level.alias("level"), F.col("event_type").alias("phase"), F.col("event_type").alias("source"), (F.col("user_id") % 10).alias("operation"), "at_ms", F.col("props").alias("details"))

    def terms(self) -> DataFrame:
        return self.read("benchmark").select(F.concat_ws(" ", F.slice(F.split("text", " "), 1, 2)).alias("term"), "item_id").groupBy("term").agg(F.min("item_id").alias("item_id"))

    def blocks(self) -> DataFrame:
        """Cues with a nested document: a block for the text, a second one for every third cue, styles by turn."""
        styles = F.when(F.col("cue_index") % 4 == 0, F.array(F.lit("bold"), F.lit("italic"))).when(F.col("cue_index") % 4 == 1, F.array(F.lit("superscript"))).otherwise(F.array().cast("array<string>"))
        color = F.when(F.col("cue_index") % 5 == 0, F.lit("#FF0000"))
        span = F.struct(F.when(F.col("cue_index") % 6 == 0, "ruby").otherwise("text").alias("type"), F.col("text"), F.col("text").alias("base"), F.array(F.struct(F.lit("n").alias("text"), F.lit("over").alias("position"))).alias("annotations"), styles.alias("styles"), color.alias("color"))
        line = F.struct(F.col("text"), F.array(span).alias("spans"))

        def block(mode, position):
            return F.struct(mode.alias("writing_mode"), F.lit(position).alias("position"), F.array(line).alias("lines"))

        mode = F.when(F.col("cue_index") % 7 == 0, F.lit("vertical_rl")).otherwise(F.lit("horizontal_tb"))
        first, second = block(F.lit("horizontal_tb"), "bottom-center"), block(mode, "top-center")
        return self.cues().withColumn("blocks", F.when(F.col("cue_index") % 3 == 0, F.array(first, second)).otherwise(F.array(first)))


def _deletions(log: str, by: int) -> str:
    """Deletion rows for the live revisions of a log whose number ``by`` divides, where one is left to the cue."""
    return f"""select user_id, cue_id, 'deletion' as kind, append_seq as revision_seq, m + row_number() over (partition by user_id order by cue_id, append_seq) as append_seq from
        (select *, count(*) over (partition by cue_id) as n, count(*) filter (append_seq % {by} = 0) over (partition by cue_id) as k from {log} where kind = 'revision' and (cue_id, append_seq) not in (select (cue_id, revision_seq) from {log} where kind = 'deletion'))
        join (select user_id, max(append_seq) as m from {log} group by 1) using (user_id) where append_seq % {by} = 0 and n > k"""


VIEWS = {
    "v_log": """select user_id * 100 + day(ts) as cue_id, event_id as append_seq, user_id, event_type,
        case event_type when 'error' then 'attempt' when 'signup' then 'decision' else 'revision' end as kind,
        case event_type when 'error' then 'failed' when 'signup' then 'approved' end as status,
        case event_type when 'view' then 'ocr' when 'click' then 'human' when 'purchase' then 'translation' end as author,
        (epoch_us(ts) - 1704067200000000) // 1000 as at_ms, value, props from events""",
    "v_revisions": "select cue_id, append_seq, author, user_id, author || ':' || cast(append_seq as varchar) as document from v_log where kind = 'revision'",
    "v_effective": "select * from v_revisions qualify row_number() over (partition by cue_id order by append_seq desc) = 1",
    "v_decisions": """select * from (select *, last_value(case when kind = 'revision' then append_seq end ignore nulls) over (partition by cue_id order by append_seq
        rows between unbounded preceding and 1 preceding) as revision_seq from v_log) where kind = 'decision'""",
    "v_log0": "select user_id, cue_id, append_seq, kind, status, author, cast(null as bigint) as revision_seq from v_log",
    "v_log1": f"select * from v_log0 union all by name ({_deletions('v_log0', 7)})",
    "v_log2": """select * from v_log1 union all by name (select user_id, cue_id, 'revision' as kind, 'human' as author, m + row_number() over (partition by user_id order by cue_id) as append_seq from
        (select user_id, cue_id from v_log1 where kind = 'revision' and (cue_id, append_seq) not in (select (cue_id, revision_seq) from v_log1 where kind = 'deletion') and cue_id % 3 = 0 group by 1, 2) join (select user_id, max(append_seq) as m from v_log1 group by 1) using (user_id))""",
    "v_log3": f"select * from v_log2 union all by name ({_deletions('v_log2', 5)})",
    "v_live": "select * from v_log3 where kind = 'revision' and (cue_id, append_seq) not in (select (cue_id, revision_seq) from v_log3 where kind = 'deletion')",
    "v_cues": "select conv_id * 1000 + turn as cue_id, conv_id as track_id, turn as cue_index, role, text, turn * 2000 as start_ms, turn * 2000 + 1500 as end_ms from conversations",
    "v_lines": "select doc_id, lang, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as line from documents where text is not null",
    "v_geometry": "select l_orderkey, l_linenumber, l_partkey, l_partkey % 1900 as x, (l_suppkey * 97) % 1060 as y, cast(l_quantity as bigint) * 10 as w, cast(l_linenumber * 12 as bigint) as h, cast(1920 as bigint) as cw, cast(1080 as bigint) as ch from lineitem",
    "v_positions": "select distinct user_id, (epoch_us(ts) - 1704067200000000) // 60000000 as pos from events",
    "v_spans": """select l_orderkey as line, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ord,
        case when cast(l_quantity as bigint) % 10 = 0 then 'ruby' else 'text' end as type, l_linestatus || cast(l_linenumber as varchar) as said,
        case l_returnflag when 'R' then 'bold' when 'A' then 'italic' else '' end as style from lineitem""",
    "v_placed": "select *, sum(length(said)) over (partition by line order by ord) as sp_end, sum(length(said)) over (partition by line order by ord) - length(said) as sp_start from v_spans",
    "v_diag": """select user_id as session_id, append_seq as sequence, case event_type when 'error' then 'error' when 'signup' then 'warning' else 'info' end as level,
        event_type as phase, event_type as source, user_id % 10 as operation, at_ms, props as details from v_log""",
    "v_terms": "select array_to_string(string_split(text, ' ')[1:2], ' ') as term, min(item_id) as item_id from benchmark group by 1",
}
NEEDS = {"v_log0": ["v_log"], "v_log1": ["v_log0"], "v_log2": ["v_log1"], "v_log3": ["v_log2"], "v_live": ["v_log3"], "v_revisions": ["v_log"], "v_effective": ["v_revisions"], "v_decisions": ["v_log"], "v_placed": ["v_spans"], "v_diag": ["v_log"]}


def sql(body: str) -> str:
    """The query with the views it names in front."""
    wanted: list[str] = []

    def need(view: str) -> None:
        for v in NEEDS.get(view, []):
            need(v)
        if view not in wanted:
            wanted.append(view)

    for view in VIEWS:
        if view in body:
            need(view)
    return ("with " + ", ".join(f"{v} as ({VIEWS[v]})" for v in wanted) + " " + body) if wanted else body
