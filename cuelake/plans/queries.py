"""Registered queries: every operator on the views of ``adapters``, with the same result in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions import geometry as G
from cuelake.functions import text as X
from cuelake.operators import diagnostics, editing, evidence, export, ingest, jobs, layout, recognition, search, survey, translation
from cuelake.plans.adapters import Tables, sql
from cuelake.sources import readers, store
from cuelake.sources.shared import own_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(body: str | None = None):
    """Registers a function of ``Tables`` under its name, with its SQL if there is one."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if body:
            SQL[f.__name__] = sql(body)
        return f

    return put


def long(c: str) -> F.Column:
    return F.col(c).cast("bigint").alias(c)


# evidence log


@query("select cue_id, append_seq, author from v_effective")
def effective_revision(t: Tables) -> DataFrame:
    return evidence.effective_revision(t.revisions()).select("cue_id", "append_seq", "author")


@query("select cue_id, append_seq, document from v_effective")
def effective_revision_ids_first(t: Tables) -> DataFrame:
    return evidence.winners_then_payload(t.revisions(), ["document"])


@query("select cue_id, append_seq from v_revisions where author = 'ocr' qualify row_number() over (partition by cue_id order by append_seq desc) = 1")
def latest_recognition(t: Tables) -> DataFrame:
    return evidence.latest_recognition(t.revisions()).select("cue_id", "append_seq")


@query("select cue_id, append_seq, author from v_revisions where author <> 'translation' qualify row_number() over (partition by cue_id order by append_seq desc) = 1")
def translation_source(t: Tables) -> DataFrame:
    return evidence.translation_source(t.revisions()).select("cue_id", "append_seq", "author")


@query("""select c.cue_id, coalesce(r.document, o.document) as document, case when r.cue_id is not null then 'revision' when o.cue_id is not null then 'recognition' end as origin
    from (select distinct cue_id from v_log) c
    left join (select cue_id, document from v_revisions where author <> 'ocr' qualify row_number() over (partition by cue_id order by append_seq desc) = 1) r using (cue_id)
    left join (select cue_id, document from v_revisions where author = 'ocr' qualify row_number() over (partition by cue_id order by append_seq desc) = 1) o using (cue_id)""")
def effective_document(t: Tables) -> DataFrame:
    r = t.revisions()
    return evidence.effective_document(t.log().select("cue_id").distinct(), r.where("author <> 'ocr'"), r.where("author = 'ocr'")).select("cue_id", "document", "origin")


@query("select cue_id, count(*) as revisions from v_revisions group by 1")
def revision_counts(t: Tables) -> DataFrame:
    return evidence.revision_counts(t.revisions())


@query("select cue_id, append_seq, author from v_revisions")
def revision_history(t: Tables) -> DataFrame:
    """The history of every cue, asked for with as many ids that no cue has."""
    ids = t.log().select("cue_id")
    return evidence.revision_history(t.revisions(), ids, ids.unionByName(ids.select((-F.col("cue_id") - 1).alias("cue_id"))))[0].select("cue_id", "append_seq", "author")


@query("select distinct -cue_id - 1 as cue_id from v_log")
def unknown_cues(t: Tables) -> DataFrame:
    ids = t.log().select("cue_id")
    return evidence.revision_history(t.revisions(), ids, ids.unionByName(ids.select((-F.col("cue_id") - 1).alias("cue_id"))))[1]


@query("""select cue_id, append_seq, case when not hit then 'kept' when n - k >= 1 then 'deleted' else 'refused' end as outcome from
    (select *, append_seq % 7 = 0 as hit, count(*) over (partition by cue_id) as n, count(*) filter (append_seq % 7 = 0) over (partition by cue_id) as k from v_revisions)""")
def guarded_delete(t: Tables) -> DataFrame:
    return evidence.delete_revisions(t.revisions(), F.col("append_seq") % 7 == 0).select("cue_id", "append_seq", "outcome")


@query("""select user_id, cue_id, coalesce(m, 0) + row_number() over (partition by user_id order by cue_id) as append_seq, 'human' as author, 'unreviewed' as review_status
    from (select user_id, cue_id from v_effective) left join (select user_id, max(append_seq) as m from v_log group by 1) using (user_id)""")
def append_revisions(t: Tables) -> DataFrame:
    documents = evidence.effective_revision(t.revisions()).select("user_id", "cue_id")
    return evidence.append_revisions(documents, t.log(), "human", keys=["cue_id"], project="user_id").select("user_id", "cue_id", "append_seq", "author", "review_status")


@query("select cue_id, cue_id * 10 as start_ms, cue_id * 10 + 5 as end_ms, document, 'human' as author from v_revisions where author = 'ocr' qualify row_number() over (partition by cue_id order by append_seq desc) = 1")
def restore_to_ocr(t: Tables) -> DataFrame:
    cues = t.log().select("cue_id").distinct().withColumns({"start_ms": F.col("cue_id") * 10, "end_ms": F.col("cue_id") * 10 + 5})
    return evidence.restore_to_ocr(cues, t.revisions()).select("cue_id", "start_ms", "end_ms", "document", "author")


@query("select cue_id, append_seq as restored_from, 'human' as author from v_revisions")
def restore_revision(t: Tables) -> DataFrame:
    return evidence.restore_revision(t.revisions(), t.log().select("cue_id", "append_seq"))[0].select("cue_id", "restored_from", "author")


@query("select cue_id, append_seq from v_log where kind <> 'revision'")
def restore_refused(t: Tables) -> DataFrame:
    """Entries that are no revision of their cue."""
    return evidence.restore_revision(t.revisions(), t.log().select("cue_id", "append_seq"))[1]


@query("select cue_id, append_seq as replaces, restores from (select *, lag(append_seq) over w as restores, row_number() over (partition by cue_id order by append_seq desc) as k from v_revisions window w as (partition by cue_id order by append_seq)) where k = 1 and restores is not null")
def undo_target(t: Tables) -> DataFrame:
    return evidence.undo_target(t.revisions())


@query("select cue_id, append_seq, revision_seq from v_decisions")
def bind_decisions(t: Tables) -> DataFrame:
    return evidence.bind_decisions(t.log()).select("cue_id", "append_seq", "revision_seq")


@query("select d.cue_id, d.append_seq, e.append_seq as revision_seq, nullif(trim(d.props), '') as note from v_log d join v_effective e using (cue_id) where d.kind = 'decision'")
def append_decisions(t: Tables) -> DataFrame:
    reviews = t.log().where("kind = 'decision'").select("cue_id", "append_seq", F.col("props").alias("note"))
    return evidence.append_decisions(reviews, t.revisions())[0].select("cue_id", "append_seq", "revision_seq", "note")


@query("select cue_id, append_seq, status from v_log where kind = 'decision' qualify row_number() over (partition by cue_id order by append_seq desc) = 1")
def latest_decision(t: Tables) -> DataFrame:
    return evidence.latest_decision(t.log().where("kind = 'decision'")).select("cue_id", "append_seq", "status")


@query("""select d.cue_id, d.append_seq, d.revision_seq from (select * from v_decisions qualify row_number() over (partition by cue_id order by append_seq desc) = 1) d
    join v_effective e on e.cue_id = d.cue_id and e.append_seq = d.revision_seq where d.status = 'approved'""")
def valid_approvals(t: Tables) -> DataFrame:
    return evidence.valid_approvals(evidence.bind_decisions(t.log()), t.revisions()).select("cue_id", "append_seq", "revision_seq")


@query("""select cue_id, case when count(*) filter (kind = 'attempt') > 0 then 'failed' else 'pending' end as ocr_status,
    coalesce(arg_max(case kind when 'decision' then status else 'unreviewed' end, append_seq) filter (kind in ('decision', 'revision')), 'unreviewed') as review_status from v_log group by 1""")
def cue_state(t: Tables) -> DataFrame:
    return evidence.cue_state(t.log())


@query("""select cue_id // 100 as project_id, count(*) as cues, count(*) filter (o = 'succeeded') as succeeded, count(*) filter (r = 'approved') as approved from
    (select cue_id, arg_max(case event_type when 'error' then 'failed' else 'succeeded' end, append_seq) filter (event_type in ('error', 'view')) as o,
    arg_max(case kind when 'decision' then status else 'unreviewed' end, append_seq) filter (kind in ('decision', 'revision')) as r from v_log group by 1) group by 1""")
def project_statistics(t: Tables) -> DataFrame:
    log = t.log()
    attempts = log.where("event_type = 'view'").withColumns({"kind": F.lit("attempt"), "status": F.lit("succeeded")})
    # a recognition writes an attempt and a revision
    states = evidence.cue_state(log.unionByName(attempts).withColumn("append_seq", F.col("append_seq") * 2 - (F.col("kind") == "attempt").cast("int")))
    return evidence.project_statistics(states.withColumn("project_id", F.floor(F.col("cue_id") / 100).cast("bigint")))


@query("select l_orderkey, l_linenumber, count(*) as occurrences from lineitem group by 1, 2 having count(*) > 1")
def check_uniques(t: Tables) -> DataFrame:
    return evidence.check_uniques(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("select l_orderkey, l_partkey, l_extendedprice from lineitem l anti join (select * from orders where o_orderkey % 50 <> 0) o on l.l_orderkey = o.o_orderkey where l_orderkey is not null")
def check_references(t: Tables) -> DataFrame:
    return evidence.check_references(t.read("lineitem"), t.read("orders").where("o_orderkey % 50 <> 0"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_partkey", "l_extendedprice")


@query("select l_orderkey, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)) group by 1")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.read("orders").join(t.read("customer").where("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return evidence.cascade_delete(t.read("lineitem"), gone, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("select d.cue_id, d.append_seq, d.status, r.append_seq as revision_seq from v_decisions d left join (select append_seq from v_revisions where append_seq % 3 <> 0) r on r.append_seq = d.revision_seq")
def unlink_deleted(t: Tables) -> DataFrame:
    return evidence.unlink_deleted(evidence.bind_decisions(t.log()), t.revisions().where("append_seq % 3 <> 0")).select("cue_id", "append_seq", "status", "revision_seq")


@query("select o_orderkey, case when o_orderkey % 4 <> 2 then 'schema version ' || cast(o_orderkey % 4 as varchar) || ', expected 2' end as error from orders")
def gate_schema_version(t: Tables) -> DataFrame:
    return evidence.gate_schema_version(t.read("orders").withColumn("schema_version", (F.col("o_orderkey") % 4).cast("int"))).select("o_orderkey", "error")


@query("""select 'cues' as kind, o_custkey + 1000000 as project_id, o_orderkey as row_id, null as name, null as origin from orders where o_custkey = 77
    union all select 'projects', c_custkey + 1000000, c_nationkey, 'copy', c_custkey from customer where c_custkey = 77""")
def fork_project(t: Tables) -> DataFrame:
    tables = {"cues": t.read("orders").select(F.col("o_custkey").cast("bigint").alias("project_id"), "o_orderkey"), "projects": t.read("customer").select(F.col("c_custkey").cast("bigint").alias("project_id"), F.col("c_name").alias("name"), "c_nationkey")}
    out = evidence.fork_project(tables, 77, 1000077, "copy")
    cues = out["cues"].select(F.lit("cues").alias("kind"), F.col("project_id").cast("bigint").alias("project_id"), F.col("o_orderkey").cast("bigint").alias("row_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("origin"))
    return cues.unionByName(out["projects"].select(F.lit("projects").alias("kind"), F.col("project_id").cast("bigint").alias("project_id"), F.col("c_nationkey").cast("bigint").alias("row_id"), "name", F.col("origin.project_id").cast("bigint").alias("origin")))


@query("""select c.c_custkey as project_id, coalesce(o.n, 0) as orders, coalesce(o.s, '') as first_order, coalesce(l.n, 0) as lines from customer c
    left join (select o_custkey, count(*) as n, cast(min(o_orderkey) as varchar) as s from orders group by 1) o on o.o_custkey = c.c_custkey
    left join (select o_custkey, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by 1) l on l.o_custkey = c.c_custkey""")
def project_document(t: Tables) -> DataFrame:
    o = t.read("orders").withColumn("project_id", F.col("o_custkey"))
    lines = t.read("lineitem").join(o.select("o_orderkey", "project_id"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = evidence.project_document(t.read("customer").select(F.col("c_custkey").alias("project_id")), {"orders": (o, ["o_orderkey", "o_orderstatus"]), "lines": (lines, ["l_orderkey", "l_linenumber"])})
    return d.select("project_id", F.size("orders").cast("bigint").alias("orders"), F.coalesce(F.try_element_at("orders", F.lit(1)).o_orderkey.cast("string"), F.lit("")).alias("first_order"), F.size("lines").cast("bigint").alias("lines"))


@query("""select project_id, doc_id, source, case when count(*) over (partition by project_id) > 500 then 'more than 500 mappings'
    when length(source) not between 1 and 200 or length(translation) not between 1 and 200 or regexp_matches(source, '[\\x00-\\x1f\\x7f-\\x9f]') then 'not 1 to 200 visible characters'
    when row_number() over (partition by project_id, source order by doc_id) > 1 then 'mapped more than once' end as error
    from (select doc_id % 40 as project_id, doc_id, regexp_replace(coalesce(split_part(text, ' ', 1), ''), '^\\s+|\\s+$', '', 'g') as source, coalesce(lang, '') as translation from documents)""")
def normalize_settings(t: Tables) -> DataFrame:
    d = t.read("documents").select((F.col("doc_id") % 40).alias("project_id"), "doc_id", F.coalesce(F.split_part("text", F.lit(" "), F.lit(1)), F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("translation"))
    return evidence.normalize_settings(d, order="doc_id").select("project_id", "doc_id", "source", "error")


# ingest


@query("""select user_id, set_no, (pts * 1000 + 45000) // 90000 as start_ms, (coalesce(nxt, pts + 450000) * 1000 + 45000) // 90000 as end_ms, nxt is null as inferred_end from
    (select user_id, append_seq as set_no, at_ms * 90 as pts, lead(at_ms * 90) over (partition by user_id order by at_ms, append_seq) as nxt, event_type from v_log) where event_type <> 'error'""")
def cue_timing(t: Tables) -> DataFrame:
    sets = t.log().select("user_id", F.struct("at_ms", "append_seq").alias("o"), F.col("append_seq").alias("set_no"), (F.col("at_ms") * 90).alias("pts"), (F.col("event_type") != "error").alias("drawn"))
    return ingest.cue_timing(sets, path="user_id", order="o").select("user_id", "set_no", "start_ms", "end_ms", "inferred_end")


@query("select user_id, append_seq, row_number() over (partition by user_id order by append_seq) as cue_index, 'assets/cues/' || cast(user_id as varchar) || '/' || lpad(cast(row_number() over (partition by user_id order by append_seq) as varchar), 6, '0') || '.png' as image_path from v_log")
def cue_numbering(t: Tables) -> DataFrame:
    return ingest.number_cues(t.log(), track="user_id", order="append_seq").select("user_id", "append_seq", long("cue_index"), "image_path")


@query("select l_orderkey, l_linenumber, l_partkey, case when e > 0 then (n * d + e - 1) // e end as estimated_total from (select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as bigint) as n, l_suppkey as d, (l_partkey % 5000) // 1000 as e from lineitem)")
def estimated_total(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("count"), F.col("l_suppkey").alias("duration_seconds"), (F.col("l_partkey") % 5000).alias("end_ms"))
    return ingest.estimate_total(rows).select("l_orderkey", "l_linenumber", "l_partkey", "estimated_total")


_RGB = "cast(greatest(0, least(255, round({}))) as bigint)"


@query(f"""select l_partkey, l_suppkey, l_linenumber, l_orderkey, case when hd then {_RGB.format('l + 1.792741::double * v')} else {_RGB.format('l + 1.596027::double * v')} end as r,
    case when hd then {_RGB.format('l - 0.213249::double * u - 0.532909::double * v')} else {_RGB.format('l - 0.391762::double * u - 0.812968::double * v')} end as g,
    case when hd then {_RGB.format('l + 2.112402::double * u')} else {_RGB.format('l + 2.017232::double * u')} end as b from
    (select *, 1.164383::double * (l_partkey % 256 - 16) as l, l_suppkey % 256 - 128 as u, (l_orderkey * 7) % 256 - 128 as v, l_linenumber % 2 = 0 as hd from lineitem)""")
def palette_rgba(t: Tables) -> DataFrame:
    rgba = G.palette_rgba(F.col("l_partkey") % 256, F.col("l_orderkey") * 7 % 256, F.col("l_suppkey") % 256, F.lit(255), F.when(F.col("l_linenumber") % 2 == 0, 1080).otherwise(480))
    rows = t.read("lineitem").withColumn("c", rgba)
    return rows.select("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey", "c.r", "c.g", "c.b")


@query("select doc_id, sha256(text) as image_sha256 from documents")
def image_digest(t: Tables) -> DataFrame:
    return ingest.image_digest(t.read("documents").withColumn("image", F.col("text").cast("binary"))).select("doc_id", "image_sha256")


_TITLES = "select o_orderkey as source_id, 0 as title_index, cast(o_custkey % 4 as bigint) as pgs_tracks from orders where o_orderkey % 10 <> 0"


def _titles(t: Tables) -> DataFrame:
    return t.read("orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("source_id"), F.lit(0).alias("title_index"), (F.col("o_custkey") % 4).alias("pgs_tracks"), F.array(F.lit("jpn"), F.lit("kor")).alias("pgs_languages"))


def _streams(t: Tables) -> DataFrame:
    return t.read("lineitem").select(F.col("l_orderkey").alias("source_id"), F.lit(0).alias("title_index"), (F.col("l_linenumber") % 5).cast("bigint").alias("stream_index"), "l_partkey")


@query(f"""select r.source_id, r.stream_index, r.l_partkey, case when t.source_id is null then 'title not found' when r.stream_index >= t.pgs_tracks then 'stream not found' when d.source_id is not null then 'already extracted' end as error
    from (select l_orderkey as source_id, cast(l_linenumber % 5 as bigint) as stream_index, l_partkey from lineitem) r left join ({_TITLES}) t using (source_id)
    left join (select distinct l_orderkey as source_id, cast(l_linenumber % 5 as bigint) as stream_index from lineitem where l_partkey % 3 = 0) d on d.source_id = r.source_id and d.stream_index = r.stream_index""")
def reject_extracted(t: Tables) -> DataFrame:
    requests = _streams(t)
    return ingest.reject_extracted(requests, _titles(t), requests.where("l_partkey % 3 = 0")).select("source_id", "stream_index", "l_partkey", "error")


@query(f"select r.source_id, r.stream_index, r.l_partkey, case when t.source_id is not null then case r.stream_index when 0 then 'jpn' when 1 then 'kor' end end as language from (select l_orderkey as source_id, cast(l_linenumber % 5 as bigint) as stream_index, l_partkey from lineitem) r left join ({_TITLES}) t using (source_id)")
def attach_language(t: Tables) -> DataFrame:
    return ingest.attach_language(_streams(t), _titles(t)).select("source_id", "stream_index", "l_partkey", "language")


@query("select l_orderkey as path, count(*) as cues from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_partkey % 20 = 0) group by 1")
def quarantine_failed_tracks(t: Tables) -> DataFrame:
    cues = t.read("lineitem").select(F.col("l_orderkey").alias("path"), F.when(F.col("l_partkey") % 20 == 0, "broken").alias("error"))
    return ingest.quarantine_failed_tracks(t.read("orders").select(F.col("o_orderkey").alias("path")), cues)[0].groupBy("path").agg(F.count("*").alias("cues"))


@query("select l_orderkey, case when count(*) filter (l_linenumber = 1) > 0 then concat_ws(':', 'bdmv', cast(count(*) as varchar), lpad(cast(arg_min(l_partkey, (l_partkey, l_suppkey)) filter (l_linenumber = 1) as varchar), 5, '0'), cast(arg_min(l_suppkey, (l_partkey, l_suppkey)) filter (l_linenumber = 1) as varchar), '2') end as fingerprint from lineitem group by 1")
def source_fingerprint(t: Tables) -> DataFrame:
    title = F.struct(F.col("l_linenumber").alias("index"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("duration_seconds"), F.lpad(F.col("l_partkey").cast("string"), 5, "0").alias("playlist"), F.lit(2).alias("pgs_tracks"))
    discs = t.read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(title)).alias("titles")).withColumn("main_title_index", F.lit(1))
    return ingest.source_fingerprint(discs).select("l_orderkey", "fingerprint")


@query(f"""select t.source_id, coalesce(min(s.i) filter (d.source_id is null), 0) as first_available from ({_TITLES}) t
    left join (select unnest(range(0, 4)) as i) s on s.i < t.pgs_tracks left join (select distinct l_orderkey as source_id, cast(l_linenumber % 5 as bigint) as i from lineitem where l_partkey % 3 = 0) d on d.source_id = t.source_id and d.i = s.i group by 1""")
def available_streams(t: Tables) -> DataFrame:
    return ingest.available_streams(_titles(t), _streams(t).where("l_partkey % 3 = 0"))[1].select("source_id", long("first_available"))


# geometry and layout


@query("""select l_orderkey, l_linenumber, l_partkey, ['top-left', 'top-center', 'top-right', 'middle-left', 'middle-center', 'middle-right', 'bottom-left', 'bottom-center', 'bottom-right']
    [(case when 3 * (2 * y + h) < 2 * ch then 0 when 3 * (2 * y + h) < 4 * ch then 1 else 2 end) * 3 + (case when 3 * (2 * x + w) < 2 * cw then 0 when 3 * (2 * x + w) < 4 * cw then 1 else 2 end) + 1] as position from v_geometry""")
def nine_grid(t: Tables) -> DataFrame:
    return t.geometry().select("l_orderkey", "l_linenumber", "l_partkey", G.nine_grid("x", "y", "w", "h", "cw", "ch").alias("position"))


@query("select l_orderkey, l_linenumber, l_partkey, greatest(0, x - greatest(0, w + 32 - w) // 2) + 16 as cx, greatest(0, y - greatest(0, h - 3 - h) // 2) + 4 as cy from v_geometry")
def canvas_bounds(t: Tables) -> DataFrame:
    g = t.geometry()
    return g.select("l_orderkey", "l_linenumber", "l_partkey", G.canvas_origin("x", F.col("w") + 32, "w", F.lit(16)).alias("cx"), G.canvas_origin("y", F.col("h") - 3, "h", F.lit(4)).alias("cy"))


@query("select l_orderkey, l_linenumber, l_partkey, greatest(0.0::double, x - greatest(0, w + 15 - w) / 2.0::double) as left_edge from v_geometry")
def cue_image_placement(t: Tables) -> DataFrame:
    return t.geometry().select("l_orderkey", "l_linenumber", "l_partkey", G.cue_image_origin("x", F.col("w") + 15, "w").alias("left_edge"))


@query("select l_orderkey, y, count(*) filter (w > 100) as ink from v_geometry group by 1, 2 having count(*) filter (w > 100) >= greatest(2, max(cw) // 600)")
def axis_activity(t: Tables) -> DataFrame:
    return layout.axis_activity(t.geometry(), cue="l_orderkey", axis="y", ink=F.col("w") > 100, span=F.col("cw"))


_BANDS = """(select user_id, min(pos) as start, max(pos) + 1 as end_, count(*) as positions from
    (select *, sum(s) over (partition by user_id order by pos) as band from (select *, case when pos - lag(pos) over (partition by user_id order by pos) - 1 <= 720 then 0 else 1 end as s from v_positions)) group by user_id, band)"""


@query(f'select user_id, start, end_ as "end", positions from {_BANDS}')
def gap_bands(t: Tables) -> DataFrame:
    return layout.gap_cluster(t.positions(), by="user_id", position="pos", max_gap=720)


@query("select l_orderkey, min(x) as x, min(y) as y, max(x) - min(x) + 1 as width, max(y) - min(y) + 1 as height from v_geometry where w > 200 group by 1")
def tight_bounds(t: Tables) -> DataFrame:
    return layout.tight_bounds(t.geometry(), cue="l_orderkey", x="x", y="y", ink=F.col("w") > 200)


@query(f"""select user_id, len(e) as bands, list_sort(e)[len(e) // 2 + 1] as median_extent, coalesce(list_sort(g)[len(g) // 2 + 1], 0) as median_gap, list_max(e) as max_extent from
    (select user_id, list(end_ - start) as e, list(gap) filter (gap is not null) as g from (select *, start - lag(end_) over (partition by user_id order by start) as gap from {_BANDS}) group by 1)""")
def median_gap(t: Tables) -> DataFrame:
    found = layout.band_stats(layout.gap_cluster(t.positions(), by="user_id", position="pos", max_gap=720), by="user_id")
    return found.select("user_id", long("bands"), "median_extent", "median_gap", "max_extent")


@query(f'select user_id, start, end_ as "end" from {_BANDS} qualify (end_ - start) * 100 >= max(end_ - start) over (partition by user_id) * 72')
def main_bands(t: Tables) -> DataFrame:
    bands = layout.gap_cluster(t.positions(), by="user_id", position="pos", max_gap=720)
    return layout.main_bands(bands, by="user_id", extent=F.col("end") - F.col("start")).select("user_id", "start", "end")


@query("select l_orderkey, greatest(1, case when count(distinct y) <= count(distinct x) then max(h) else max(w) end) as em from v_geometry group by 1")
def bootstrap_em(t: Tables) -> DataFrame:
    rows = t.geometry().groupBy("l_orderkey").agg(F.countDistinct("y").alias("r"), F.countDistinct("x").alias("c"), F.max("h").alias("a"), F.max("w").alias("b"))
    return rows.select("l_orderkey", G.bootstrap_em(F.col("r"), F.col("a"), F.col("c"), F.col("b")).alias("em"))


@query("""select line, first, second, overlap from (select l_orderkey as line, o as first, lead(o) over w as second, case when least(y + h, lead(y + h) over w) <= greatest(y, lead(y) over w) then 0
    else (least(y + h, lead(y + h) over w) - greatest(y, lead(y) over w)) * 1000 // least(h, lead(h) over w) end as overlap from (select *, row_number() over (partition by l_orderkey order by y, x, w, h, l_partkey, l_linenumber) as o from v_geometry)
    window w as (partition by l_orderkey order by o)) where second is not null and overlap between 400 and 600""")
def ambiguous_neighbours(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    g = t.geometry().withColumn("o", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("y", "x", "w", "h", "l_partkey", "l_linenumber")).cast("bigint"))
    return layout.ambiguous_neighbours(g, cue="l_orderkey", order="o", y="y", height="h").withColumnRenamed("l_orderkey", "line")


@query("""select l_orderkey, l_linenumber, l_partkey, case when a >= 2000 then 'horizontal_tb' when a <= 500 then 'vertical_rl' when c = 1 and r > 1 then 'vertical_rl' else 'horizontal_tb' end as mode,
    case when a >= 2000 or a <= 500 then 'aspect' when c = 1 and r > 1 then 'single_column' when r = 1 and c > 1 then 'single_row' else 'fallback' end as rule
    from (select l_orderkey, l_linenumber, l_partkey, w * 1000 // (h * 3) as a, l_linenumber % 3 as r, l_partkey % 3 as c from v_geometry)""")
def writing_mode(t: Tables) -> DataFrame:
    g = t.geometry().withColumn("m", G.writing_mode(G.milli_ratio("w", F.col("h") * 3), F.col("l_linenumber") % 3, F.col("l_partkey") % 3))
    return g.select("l_orderkey", "l_linenumber", "l_partkey", "m.mode", "m.rule")


@query("select l_orderkey, case when count(*) between 1 and 8 then count(*) end as units from lineitem group by 1")
def count_units(t: Tables) -> DataFrame:
    return t.read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).select("l_orderkey", G.count_units("n").alias("units"))


@query("select l_orderkey, l_linenumber, l_partkey, greatest(1, (w + l_linenumber + greatest(1, h - 11) // 2) // greatest(1, h - 11)) as glyphs from v_geometry")
def expected_glyphs(t: Tables) -> DataFrame:
    em = F.greatest(F.lit(1), F.col("h") - 11)
    return t.geometry().select("l_orderkey", "l_linenumber", "l_partkey", G.expected_glyphs("w", em, F.col("l_linenumber")).alias("glyphs"))


@query("select l_orderkey, l_linenumber, l_partkey, case when l_linenumber = 7 then 2.0 else greatest(1.5, least(8.0, l_quantity / 4)) end as separation from lineitem")
def clamp_tuning(t: Tables) -> DataFrame:
    value = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity") / 4)
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", G.clamp_tuning(value, *G.TUNING["separation_em"]).alias("separation"))


@query("select l_orderkey, case when count(*) filter (l_linenumber = 5) > 0 then null else sum(l_linenumber) end::bigint as units from lineitem group by 1")
def total_units(t: Tables) -> DataFrame:
    rows = t.read("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_linenumber") != 5, F.col("l_linenumber").cast("bigint")).alias("units"))).alias("b"))
    return rows.select("l_orderkey", G.total_units(F.col("b")).alias("units"))


@query("select n as blocks, count(*) as cues from (select l_orderkey, count(*) as n from lineitem group by 1) group by 1")
def survey_hist(t: Tables) -> DataFrame:
    return survey.survey_hist(t.read("lineitem"), "l_orderkey", F.count("*"))


def _layout(t: Tables) -> DataFrame:
    """Layouts made of order lines: a block a line, vertical for returned ones, a doubt for a ship year of 1996 or later."""
    block = F.struct(F.when(F.col("l_returnflag") == "R", "vertical_rl").otherwise("horizontal_tb").alias("writing_mode"), F.when(F.col("l_linenumber") == 7, "whole_cue").otherwise("detected").alias("source"), F.struct(F.col("l_partkey").cast("int").alias("x"), F.lit(3).alias("y"), F.lit(20).alias("width"), F.lit(10).alias("height")).alias("bounds"))
    doubt = F.when(F.col("l_quantity") > 45, F.struct(F.when(F.col("l_linestatus") == "O", "ambiguous_writing_mode").otherwise("tiny_block_merged").alias("code")))
    rows = t.read("lineitem").groupBy(F.col("l_orderkey").alias("cue_id")).agg(F.collect_list(block).alias("blocks"), F.collect_list(doubt).alias("doubts"))
    return rows.withColumn("error", F.when(F.col("cue_id") % 40 == 0, "broken"))


@query("select case l_returnflag when 'R' then 'vertical_rl' else 'horizontal_tb' end as writing_mode, count(*) as blocks from lineitem group by 1")
def survey_writing_modes(t: Tables) -> DataFrame:
    return survey.survey_writing_modes(_layout(t))


@query("select case l_linestatus when 'O' then 'ambiguous_writing_mode' else 'tiny_block_merged' end as code, count(*) as doubts from lineitem where l_quantity > 45 group by 1")
def survey_doubts(t: Tables) -> DataFrame:
    return survey.survey_doubts(_layout(t))


_CUE = "(select l_orderkey, l_orderkey % 40 = 0 as failed, bool_or(l_returnflag = 'R') as v, bool_or(l_returnflag <> 'R') as h, bool_or(l_linenumber = 7) as d, count(*) as n, count(*) filter (l_quantity > 45) as q, min(l_partkey) as low from lineitem group by 1)"


@query(f"select count(*) as cues, count(*) filter (failed) as failed, count(*) filter (v) as vertical, count(*) filter (v and h) as mixed, count(*) filter (d) as degraded from {_CUE}")
def survey_flags(t: Tables) -> DataFrame:
    return survey.survey_flags(_layout(t))


@query(f"select l_orderkey as cue_id, n as blocks, q as doubts, greatest(0, 10 - 16) + low as first_x from {_CUE} where failed or not (n = 1 and q = 0 and h and not d)")
def survey_notable(t: Tables) -> DataFrame:
    geometry = t.read("orders").select(F.col("o_orderkey").alias("cue_id"), F.struct(*[F.lit(v).alias(n) for n, v in (("x", 10), ("y", 10), ("width", 100), ("height", 50), ("image_width", 132), ("image_height", 82))]).alias("geometry"))
    found = survey.survey_notable(_layout(t), geometry)
    return found.select("cue_id", F.size("blocks").cast("bigint").alias("blocks"), F.size("doubts").cast("bigint").alias("doubts"), F.array_min(F.transform("blocks", lambda b: b.x)).alias("first_x"))


@query("""select m::double as max_gap, (select count(distinct user_id) from v_positions) as cues, sum(n)::bigint as bands, count(*) filter (n = 1) as single, count(*) filter (n > 4) as capped from
    (select m, user_id, 1 + count(*) filter (gap > m) as n from (select user_id, pos - lag(pos) over (partition by user_id order by pos) - 1 as gap from v_positions), (select unnest(range(0, 40000, 97)) as m) group by 1, 2) group by 1""")
def survey_sweep(t: Tables) -> DataFrame:
    """Four hundred thresholds in one pass."""
    return survey.survey_sweep(t.positions(), t.spark.range(0, 40_000, 97).withColumnRenamed("id", "max_gap"), by="user_id", position="pos", most_bands=4)


@query("select threshold, count(*) as rows, count(*) filter (l_quantity > threshold) as above from lineitem, (select unnest([1.5, 2.0, 10.0, 40.0])::double as threshold) group by 1")
def threshold_sweep(t: Tables) -> DataFrame:
    return survey.threshold_sweep(t.read("lineitem"), [1.5, 2.0, 10.0, 40.0], F.col("l_quantity"))


# recognition


@query("select track_id, cue_id from v_cues where role is distinct from 'assistant'")
def select_cues(t: Tables) -> DataFrame:
    cues = t.cues().withColumn("ocr_status", F.when(F.col("role") == "assistant", "succeeded").otherwise("pending"))
    return recognition.select_cues(cues, cues.select("cue_id"))[0].select("track_id", "cue_id")


@query("""select doc_id, code as language_code, case when code = 'jpn' then 'right_to_left' when code is not null then 'left_to_right' end as reading_order, case when code is null then 'language profile is not supported: ' || coalesce(lang, '') end as error from
    (select doc_id, lang, case lower(trim(lang)) when 'en' then 'eng' when 'fr' then 'fra' when 'de' then 'deu' when 'es' then 'spa' when 'it' then 'ita' when 'ja' then 'jpn' when 'ko' then 'kor' end as code from (select doc_id, case when doc_id % 9 = 0 then 'xx' when doc_id % 8 = 0 then ' JA ' else lang end as lang from documents))""")
def resolve_language(t: Tables) -> DataFrame:
    d = t.read("documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "xx").when(F.col("doc_id") % 8 == 0, " JA ").otherwise(F.col("lang")).alias("language"))
    return recognition.resolve_language(d).select("doc_id", "language_code", "reading_order", "error")


@query("""select cue_id, '{"stage":"main_text","language":"' || case when role = 'user' then 'eng' else 'jpn' end || '","writing_mode":"' || m || '","instructions":"read"}' as stable,
    case when cue_index % 3 <> 0 then 'exactly ' || cast(cue_index % 3 as varchar) || ' ' || u else 'unknown number of ' || u end || chr(10) || 'about [' || cast(length(coalesce(text, '')) as varchar) || '] characters' as variable
    from (select *, case when cue_index % 2 = 0 then 'vertical_rl' else 'horizontal_tb' end as m, case when cue_index % 2 = 0 then 'columns' else 'rows' end as u from v_cues)""")
def build_requests(t: Tables) -> DataFrame:
    presets = t.spark.createDataFrame([("eng", "main_text", "read"), ("jpn", "main_text", "read")], "language string, stage string, instructions string")
    blocks = t.cues().select("cue_id", F.when(F.col("role") == "user", "eng").otherwise("jpn").alias("language_code"), F.when(F.col("cue_index") % 2 == 0, "vertical_rl").otherwise("horizontal_tb").alias("writing_mode"), F.when(F.col("cue_index") % 3 != 0, F.col("cue_index") % 3).alias("units"), F.array(F.length(F.coalesce("text", F.lit("")))).alias("expected_glyphs"), F.lit(None).cast("string").alias("correction"))
    return recognition.build_requests(blocks, presets).select("cue_id", "stable", "variable")


@query("""select append_seq, case when append_seq % 5 = 0 then null else cast(json_extract_string(props, '$.k') as bigint) end as k, case when append_seq % 5 = 0 then 'model did not return valid JSON' end as error from v_log""")
def parse_model_json(t: Tables) -> DataFrame:
    fenced = F.concat(F.lit("  ```json\n"), F.col("props"), F.lit("\n```\nmore"))
    content = F.when(F.col("append_seq") % 5 == 0, F.lit("```\n{broken\n```")).when(F.col("append_seq") % 2 == 0, fenced).otherwise(F.concat(F.lit("\n "), F.col("props"), F.lit(" ")))
    return recognition.parse_model_json(t.log().withColumn("content", content), "k bigint").select("append_seq", F.col("parsed.k").alias("k"), "error")


@query("""select doc_id, case when n is null then 'main text has no lines' when doc_id % 3 <> 0 and n <> doc_id % 3 then 'bitmap analysis found ' || cast(doc_id % 3 as varchar) || ' large main-text ' || case when doc_id % 2 = 0 then 'columns' else 'rows' end || ' in this block, but the response returned ' || cast(n as varchar)
    when e then 'main text line is empty' end as error from (select doc_id, len(string_split(text, chr(10))) as n, list_contains(string_split(text, chr(10)), '') as e from documents)""")
def validate_lines(t: Tables) -> DataFrame:
    d = t.read("documents").select("doc_id", F.split("text", "\n").alias("lines"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3).alias("expected_units"), F.when(F.col("doc_id") % 2 == 0, "vertical_rl").otherwise("horizontal_tb").alias("writing_mode"))
    return recognition.validate_lines(d).select("doc_id", "error")


@query("""select doc_id, line_no, case when len(p) > 3 then len(p[1]) + len(p[2]) + len(p[3]) + 4 end as at from (select doc_id, line_no, string_split(line, 'on') as p from v_lines)""")
def nth_occurrence(t: Tables) -> DataFrame:
    return t.lines().select("doc_id", "line_no", X.nth_occurrence(F.col("line"), F.lit("on"), F.lit(3)).alias("at"))


_NOTES = """(select doc_id, line_no, line, 1 as i, case when line_no % 11 = 0 then 9 else 1 end as line_index, split_part(line, ' ', 2) as base, 1 + line_no % 2 as occurrence, case when line_no % 13 = 0 then '' else 'n' end as note, case when line_no % 17 = 0 then 'beside' else 'over' end as position from v_lines
    union all select doc_id, line_no, line, 2, 1, case when line_no % 3 = 0 then split_part(line, ' ', 2) else substr(line, 3, 6) end, 1, 'n', 'under' from v_lines
    union all select doc_id, line_no, line, 3, 1, 'no such base', (line_no % 2), 'n', 'over' from v_lines where line_no % 19 = 0)"""


@query(f"""select doc_id, line_no, arg_min(error, (case when error = 'ruby ranges overlap' then 10 else 0 end) + i) filter (error is not null) as error from (
    select *, case when line_index <> 1 or occurrence < 1 or position = 'beside' then 'annotation placement is invalid' when note = '' or base = '' then 'annotation text and base must not be empty'
        when s is null then 'annotation base was not found: ' || base when s < be and not (s = bs and s + length(base) = be) then 'ruby ranges overlap' end as error from (
    select *, lag(s) over w as bs, lag(s + length(base)) over w as be from (
    select *, case when line_index = 1 and base <> '' and occurrence >= 1 and len(p) > occurrence then list_sum(list_transform(p[1:occurrence], lambda x: length(x)))::bigint + (occurrence - 1) * length(base) end as s from (select *, string_split(line, base) as p from {_NOTES}))
    window w as (partition by doc_id, line_no, line_index order by s nulls first, s + length(base) nulls first, i))) group by 1, 2""")
def validate_annotations(t: Tables) -> DataFrame:
    """Notes that hit every rule: placed, misplaced, empty, not found, overlapping and equal ranges."""
    rows = t.lines().withColumn("block_id", F.struct("doc_id", "line_no"))
    no = F.col("line_no")
    second = F.split_part("line", F.lit(" "), F.lit(2))

    def note(i: int, line_index, base, occurrence, text, position, which=None):
        out = rows if which is None else rows.where(which)
        return out.select("block_id", F.lit(i).alias("annotation_index"), line_index.cast("int").alias("line_index"), base.alias("base"), occurrence.cast("int").alias("base_occurrence"), text.alias("text"), position.alias("position"))

    one, n = F.lit(1), F.lit("n")
    notes = note(1, F.when(no % 11 == 0, 9).otherwise(1), second, 1 + no % 2, F.when(no % 13 == 0, "").otherwise("n"), F.when(no % 17 == 0, "beside").otherwise("over"))
    notes = notes.unionByName(note(2, one, F.when(no % 3 == 0, second).otherwise(F.substring("line", 3, 6)), one, n, F.lit("under"))).unionByName(note(3, one, F.lit("no such base"), no % 2, n, F.lit("over"), no % 19 == 0))
    lines = rows.select("block_id", F.lit(1).alias("line_index"), "line", F.lit("horizontal_tb").alias("writing_mode"))
    return recognition.validate_annotations(recognition.place_annotations(notes, lines)).select("block_id.doc_id", "block_id.line_no", "error")


@query("""select append_seq, case when m = 'horizontal_tb' and v = 'over' or m = 'vertical_rl' and v = 'right' then 'over' when m = 'horizontal_tb' and v = 'under' or m = 'vertical_rl' and v = 'left' then 'under' end as position from
    (select append_seq, case when append_seq % 2 = 0 then 'vertical_rl' else 'horizontal_tb' end as m, ['over', 'under', 'left', 'right', 'top'][append_seq % 5 + 1] as v from v_log)""")
def ruby_position(t: Tables) -> DataFrame:
    value = F.element_at(F.array(*[F.lit(v) for v in ("over", "under", "left", "right", "top")]), (F.col("append_seq") % 5 + 1).cast("int"))
    return t.log().select("append_seq", X.ruby_position(F.when(F.col("append_seq") % 2 == 0, "vertical_rl").otherwise("horizontal_tb"), value).alias("position"))


_NAMES = ("default", "black", "red", "orange", "yellow", "green", "cyan", "blue", "magenta", "pink")


@query(f"""select append_seq, case n when 'black' then '#000000' when 'red' then '#FF0000' when 'orange' then '#FF8000' when 'yellow' then '#FFFF00' when 'green' then '#00FF00' when 'cyan' then '#00FFFF' when 'blue' then '#0000FF' when 'magenta' then '#FF00FF' end as code,
    case n when 'pink' then 'unsupported recognized text color: pink' end as error from (select append_seq, {list(_NAMES)}[append_seq % 10 + 1] as n from v_log)""")
def colour_code(t: Tables) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("append_seq") % 10 + 1).cast("int"))
    return t.log().select("append_seq", X.colour_code(name).alias("c")).select("append_seq", "c.code", "c.error")


_MISMATCH = "(select doc_id, list_filter(range(1, len(l) + 1), lambda i: abs(100 - len(l[i])) > 1)[1] as unit, l from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null))"


@query(f"select doc_id, unit, len(l[unit]) as actual from {_MISMATCH} where unit is not null")
def glyph_mismatch(t: Tables) -> DataFrame:
    d = t.read("documents").select("doc_id", F.split("text", "\n").alias("l")).withColumn("m", X.glyph_mismatch(F.col("l"), F.transform("l", lambda x: F.lit(100))))
    return d.where("m is not null").select("doc_id", F.col("m.unit").cast("bigint").alias("unit"), F.col("m.actual").cast("bigint").alias("actual"))


@query(f"""select d.doc_id, case when unit is not null then 'Bitmap analysis measured about 100 characters in ' || case when d.doc_id % 2 = 0 then 'column ' else 'row ' end || cast(unit as varchar) || ', but ' || cast(len(l[unit]) as varchar) || ' were transcribed.' end as message,
    cast(unit is not null as bigint) + cast(d.doc_id % 2 = 0 as bigint) as issues, unit is not null as needs_review from documents d left join {_MISMATCH} m on m.doc_id = d.doc_id""")
def soft_issues(t: Tables) -> DataFrame:
    d = t.read("documents").select("doc_id", F.split("text", "\n").alias("lines"), F.when(F.col("doc_id") % 2 == 0, "vertical_rl").otherwise("horizontal_tb").alias("writing_mode"), F.lit(0).alias("block_index")).withColumn("expected_glyphs", F.transform("lines", lambda x: F.lit(100)))
    found = recognition.soft_issues(d)
    return found.select("doc_id", F.try_element_at(F.filter("issues", lambda i: i.severity == "warning"), F.lit(1)).message.alias("message"), F.size("issues").cast("bigint").alias("issues"), "needs_review")


_OLD = "replace(replace(line, 'é', 'e' || chr(769)), '.', '...')"


def _decomposed(t: Tables) -> DataFrame:
    return t.lines().withColumn("text", F.replace(F.replace("line", F.lit("é"), F.lit("é")), F.lit("."), F.lit("...")))


_SYMBOLS = (X.ASCII_SYMBOLS + X.HALF_MARKS).replace("'", "''")
_WIDE = "".join(chr(ord(x) + 0xFEE0) for x in X.ASCII_SYMBOLS) + X.FULL_MARKS
_S1 = f"nfc_normalize({_OLD})"
_S2 = f"regexp_replace({_S1}, '(?:\\.|．){{3,}}|…+', '⋯', 'g')"
_S3 = f"translate({_S2}, '{X.LONG_MARKS}', 'ーーー')"
_S4 = f"translate({_S3}, '{_SYMBOLS}', '{_WIDE}')"


@query(f"select doc_id, line_no, case when doc_id % 2 = 0 then {_S4} else {_S1} end as normalized from v_lines")
def normalize_text(t: Tables) -> DataFrame:
    return recognition.normalize_text(_decomposed(t), japanese=F.col("doc_id") % 2 == 0).select("doc_id", "line_no", "normalized")


@query(f"""select rule, count(*) as changes, sum(length(before)) as length_before, sum(length(after)) as length_after from (
    select 'unicode-nfc' as rule, {_OLD} as before, {_S1} as after from v_lines union all select 'japanese-centered-ellipsis-v1', {_S1}, {_S2} from v_lines
    union all select 'japanese-prolonged-sound-mark-v1', {_S2}, {_S3} from v_lines union all select 'japanese-fullwidth-symbol-v1', {_S3}, {_S4} from v_lines) where before <> after group by 1""")
def normalization_log(t: Tables) -> DataFrame:
    log = recognition.normalization_log(_decomposed(t), ["doc_id", "line_no"])
    return log.groupBy("rule").agg(F.count("*").alias("changes"), F.sum(F.length("before")).cast("bigint").alias("length_before"), F.sum(F.length("after")).cast("bigint").alias("length_after"))


@query("""select doc_id, case when c < 32 or c between 127 and 159 then 'U+' || upper(lpad(hex(c), 4, '0')) when contains(text, chr(10)) then 'U+000A' end as codepoint
    from (select doc_id, coalesce(text, '') as text, (doc_id % 170)::int as c from documents) where c < 32 or c between 127 and 159 or contains(text, chr(10))""")
def control_rejects(t: Tables) -> DataFrame:
    """Every control character in turn in front of a text."""
    texts = t.read("documents").select("doc_id", F.concat(F.decode(F.unhex(F.lpad(F.hex(F.col("doc_id") % 170), 8, "0")), "UTF-32"), F.coalesce("text", F.lit(""))).alias("text"))
    return recognition.reject_controls(texts).select("doc_id", "codepoint")


@query("""select doc_id, line_no, cast(row_number() over (partition by doc_id, line_no order by a) - 1 as bigint) as ord, type, said from (
    select doc_id, line_no, 0 as a, 'text' as type, w || ' ' as said from (select *, split_part(line, ' ', 1) as w from v_lines) where contains(line, ' ') and split_part(line, ' ', 2) <> ''
    union all select doc_id, line_no, 1, 'ruby', split_part(line, ' ', 2) from v_lines where contains(line, ' ') and split_part(line, ' ', 2) <> ''
    union all select doc_id, line_no, 2, 'text', substr(line, length(split_part(line, ' ', 1)) + length(split_part(line, ' ', 2)) + 2) from v_lines where contains(line, ' ') and split_part(line, ' ', 2) <> '' and length(line) > length(split_part(line, ' ', 1)) + length(split_part(line, ' ', 2)) + 1
    union all select doc_id, line_no, 0, 'text', line from v_lines where not (contains(line, ' ') and split_part(line, ' ', 2) <> '')) where type = 'ruby' or said <> '' or a = 0 and said = ''""")
def assemble_spans(t: Tables) -> DataFrame:
    rows = t.lines().withColumn("line_id", F.struct("doc_id", "line_no"))
    first, second = F.split_part("line", F.lit(" "), F.lit(1)), F.split_part("line", F.lit(" "), F.lit(2))
    placed = rows.where(F.col("line").contains(" ")).where(second != "").select("line_id", (F.length(first) + 1).alias("start"), (F.length(first) + 1 + F.length(second)).alias("end"), F.lit("n").alias("text"), F.lit("over").alias("position"), F.lit(1).alias("annotation_index"))
    out = recognition.assemble_spans(rows, placed)
    return out.select("line_id.doc_id", "line_id.line_no", long("ord"), "type", F.coalesce("text", "base").alias("said"))


@query("select track_id, string_agg(coalesce(text, ''), '|' order by cue_index) as said, bool_or(role = 'user' and cue_index % 4 = 0) as unreadable, coalesce(arg_min(role, cue_index) filter (cue_index % 2 = 1), 'none') as model from v_cues group by 1")
def assemble_documents(t: Tables) -> DataFrame:
    blocks = t.cues().select("track_id", F.col("cue_index").alias("block_no"), F.coalesce("text", F.lit("")).alias("line"), ((F.col("role") == "user") & (F.col("cue_index") % 4 == 0)).alias("unreadable"), F.when(F.col("cue_index") % 2 == 1, F.col("role")).alias("model"), F.lit("none").alias("configured_model"))
    out = recognition.assemble_documents(blocks, cue="track_id", columns=("line",))
    return out.select("track_id", F.array_join(F.transform("blocks", lambda b: b.line), "|").alias("said"), "unreadable", "model")


@query("""select append_seq, case when append_seq % 4 < 2 then event_type end as content, case append_seq % 4 when 2 then 'response has no content' when 3 then 'status 500: ' || b end as error from
    (select *, '{"choices":[{"message":{"content":"' || event_type || '"}}]}' as b from v_log)""")
def parse_completions(t: Tables) -> DataFrame:
    one = F.concat(F.lit('{"choices":[{"message":{"content":"'), F.col("event_type"), F.lit('"}}]}'))
    two = F.concat(F.lit('{"content":[{"type":"thinking","text":"no"},{"type":"text","text":"'), F.col("event_type"), F.lit('"}]}'))
    k = F.col("append_seq") % 4
    rows = t.log().select("append_seq", F.when(k == 1, two).when(k == 2, F.lit("{}")).otherwise(one).alias("body"), F.when(k == 3, 500).otherwise(200).alias("http_status"))
    return recognition.parse_completions(rows).select("append_seq", "content", "error")


@query("select append_seq, case when append_seq % 2 = 0 then k end as input_tokens, case when append_seq % 2 = 1 then k end as output_tokens, case when append_seq % 3 = 0 then k end as cache_read_input_tokens from (select append_seq, cast(json_extract_string(props, '$.k') as bigint) as k from v_log)")
def usage_summary(t: Tables) -> DataFrame:
    return recognition.usage_summary(_usage(t)).select("append_seq", "input_tokens", "output_tokens", "cache_read_input_tokens")


def _usage(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    name = F.when(F.col("append_seq") % 4 == 0, "input_tokens").when(F.col("append_seq") % 4 == 2, "prompt_tokens").when(F.col("append_seq") % 4 == 1, "output_tokens").otherwise("completion_tokens")
    cached = F.when(F.col("append_seq") % 3 == 0, F.concat(F.lit(', "prompt_tokens_details": {"cached_tokens": '), k, F.lit("}"))).otherwise(F.lit(""))
    return t.log().withColumn("usage", F.concat(F.lit('{"'), name, F.lit('": '), k, cached, F.lit("}")))


@query("""select event_type as stage, count(*) as requests, coalesce(sum(k) filter (append_seq % 2 = 0), 0)::bigint as input_tokens, coalesce(sum(k) filter (append_seq % 2 = 1), 0)::bigint as output_tokens, coalesce(sum(k) filter (append_seq % 3 = 0), 0)::bigint as cache_read_tokens,
    (coalesce(sum(k) filter (append_seq % 3 = 0), 0) * 1000 // coalesce(sum(k) filter (append_seq % 2 = 0), 0))::bigint as cache_milli from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from v_log) group by 1""")
def usage_by_stage(t: Tables) -> DataFrame:
    return recognition.usage_by_stage(recognition.usage_summary(_usage(t)).withColumnRenamed("event_type", "stage"), ("stage",))


@query("""select stage, provider, model, (3 - bit_count(grouping(stage, provider, model)))::int as level, count(*) as requests, coalesce(sum(k) filter (append_seq % 2 = 0), 0)::bigint as input_tokens, coalesce(sum(k) filter (append_seq % 2 = 1), 0)::bigint as output_tokens,
    coalesce(sum(k) filter (append_seq % 3 = 0), 0)::bigint as cache_read_tokens, (coalesce(sum(k) filter (append_seq % 3 = 0), 0) * 1000 // nullif(coalesce(sum(k) filter (append_seq % 2 = 0), 0), 0))::bigint as cache_milli
    from (select *, event_type as stage, case when user_id % 5 > 0 then user_id % 3 end as provider, cue_id % 7 as model, cast(json_extract_string(props, '$.k') as bigint) as k from v_log) group by rollup(stage, provider, model)""")
def usage_rollup(t: Tables) -> DataFrame:
    rows = recognition.usage_summary(_usage(t)).withColumns({"stage": F.col("event_type"), "provider": F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 3), "model": F.col("cue_id") % 7})
    return recognition.usage_rollup(rows)


@query("select cue_id, case when role = 'system' then 'failed' when cue_index % 2 = 0 then 'succeeded_with_warning' else 'succeeded' end as status, case when role <> 'system' then text end as candidate from v_cues")
def append_attempts(t: Tables) -> DataFrame:
    results = t.cues().select("cue_id", F.lit("r").alias("run_id"), (F.col("cue_index") % 2 == 0).alias("needs_review"), F.when(F.col("role") == "system", "timeout").alias("error"), F.col("text").alias("document"), "start_ms", "end_ms")
    return recognition.append_attempts(results)[0].select("cue_id", "status", "candidate")


@query("select page_id, 'p:' || rtrim(url, '/') || ':m' as identity, cast(null as varchar) as api_key from pages where url is not null")
def redact_profiles(t: Tables) -> DataFrame:
    rows = t.read("pages").where("url is not null").select("page_id", F.lit("p").alias("provider"), F.col("url").alias("base_url"), F.lit("m").alias("model"), F.lit("secret").alias("api_key"))
    return recognition.redact_profiles(rows).select("page_id", "identity", "api_key")


# structured text


@query("""select cue_id, case when cue_index % 11 = 0 then 'the cue end time must be later than its start time' when coalesce(text, '') = '' or regexp_matches(text, '[\\x00-\\x1f\\x7f-\\x9f]') then 'subtitle ' || l || ' is empty or contains control characters'
    when cue_index % 6 = 5 then 'subtitle ' || l || ' contains an invalid text color' when cue_index % 6 = 4 then 'subtitle ' || l || ' contains duplicate text styles' when cue_index % 6 = 3 then 'subtitle ' || l || ' contains conflicting baseline styles' when cue_index % 6 = 2 then 'subtitle ' || l || ' does not match its structured spans' end as error
    from (select *, case when cue_index % 3 = 0 then 'block 1 line 1' else 'line 1' end as l from v_cues)""")
def validate_edit(t: Tables) -> DataFrame:
    k = F.col("cue_index") % 6
    styles = F.when(k == 4, F.array(F.lit("bold"), F.lit("bold"))).when(k == 3, F.array(F.lit("superscript"), F.lit("subscript"))).otherwise(F.array(F.lit("bold")))
    span = F.struct(F.lit("text").alias("type"), F.when(k == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"), F.lit(None).cast("string").alias("base"), F.lit(None).cast(editing.ANNOTATIONS).alias("annotations"), styles.alias("styles"), F.when(k == 5, "red").otherwise("#00ff00").alias("color"))
    block = F.struct(F.array(F.struct(F.col("text"), F.array(span).alias("spans"))).alias("lines"))
    rows = t.cues().withColumns({"blocks": F.when(F.col("cue_index") % 3 == 0, F.array(block, block)).otherwise(F.array(block)), "end_ms": F.when(F.col("cue_index") % 11 == 0, F.col("start_ms")).otherwise(F.col("end_ms"))})
    return editing.validate_edit(rows).select("cue_id", "error")


_RUNS = "(select *, sum(s) over (partition by line order by ord) as run from (select *, case when type = 'text' and lag(type) over w = 'text' and style = lag(style) over w then 0 else 1 end as s from {} window w as (partition by line order by ord)))"


@query(f"select line, run::bigint as ord, any_value(type) as type, string_agg(said, '' order by ord) as said, any_value(style) as styles from {_RUNS.format('v_spans')} group by line, run")
def coalesce_spans(t: Tables) -> DataFrame:
    return editing.coalesce_spans(t.spans()).select("line", "ord", "type", F.coalesce("text", "base").alias("said"), F.array_join("styles", ",").alias("styles"))


@query("select append_seq, case append_seq % 3 when 0 then 'bold,italic' when 1 then 'underline,subscript' else '' end as styles from v_log")
def canonical_styles(t: Tables) -> DataFrame:
    given = F.when(F.col("append_seq") % 3 == 0, F.array(F.lit("italic"), F.lit("bold"), F.lit("italic"))).when(F.col("append_seq") % 3 == 1, F.array(F.lit("subscript"), F.lit("blink"), F.lit("underline"))).otherwise(F.array().cast("array<string>"))
    return t.log().select("append_seq", F.array_join(X.canonical_styles(given), ",").alias("styles"))


@query("select append_seq, case append_seq % 4 when 0 then '#00FFA0' when 1 then null when 2 then null else '#ABCDEF' end as color from v_log")
def canonical_colour(t: Tables) -> DataFrame:
    given = F.element_at(F.array(F.lit("#00ffa0"), F.lit("#fFfFfF"), F.lit("blue"), F.lit("#ABCDEF")), (F.col("append_seq") % 4 + 1).cast("int"))
    return t.log().select("append_seq", X.canonical_colour(given).alias("color"))


@query("select cue_id, case when cue_index % 3 = 0 then text || chr(10) || chr(10) || text else text end as plain from v_cues where text is not null")
def plain_text(t: Tables) -> DataFrame:
    return t.blocks().where("text is not null").select("cue_id", X.plain_text(F.col("blocks")).alias("plain"))


@query("select cue_id, case when cue_index % 3 = 0 then 2 else 1 end as line_count, case when cue_index % 3 = 0 then text || '|' || text else text end as lines, 'bottom-center' as position from v_cues where text is not null")
def document_shape(t: Tables) -> DataFrame:
    rows = t.blocks().where("text is not null").select("cue_id", X.document_shape(F.col("blocks")).alias("s"))
    return rows.select("cue_id", F.col("s.line_count").alias("line_count"), F.array_join("s.lines", "|").alias("lines"), F.col("s.position").alias("position"))


def _lines(t: Tables) -> DataFrame:
    return t.read("lineitem").select(F.col("l_orderkey").alias("line")).distinct()


_SELECTION = "(select distinct line, line % 4 as sel_start, line % 4 + 5 as sel_end from v_spans)"


@query(f"select line, count(*) as spans, case when min(style) = max(style) then min(style) else '' end as styles from v_placed join {_SELECTION} using (line) where sel_start < sp_end and sel_end > sp_start group by 1")
def span_overlap(t: Tables) -> DataFrame:
    spans = t.spans()
    selections = _lines(t).select("line", F.lit(1).alias("selection"), (F.col("line") % 4).alias("sel_start"), (F.col("line") % 4 + 5).alias("sel_end"))
    return editing.span_overlap(spans, selections).select("line", "spans", F.array_join("styles", ",").alias("styles"))


@query(f"""select line, run::bigint as ord, any_value(type) as type, string_agg(said, '' order by ord) as said, any_value(style) as styles from {_RUNS.format('''(
    select line, ord * 4 + k as ord, type, case when type = 'ruby' then said else substr(said, cast(a + 1 as bigint), cast(b - a as bigint)) end as said,
    case when inside and all_bold then replace(replace(style, 'bold', ''), ',', '') when inside and style = 'italic' then 'bold,italic' when inside then 'bold' else style end as style from (
    select line, ord, type, said, style, all_bold, k, case when type = 'ruby' then 0 else a end as a, case when type = 'ruby' then length(said) else b end as b, hit and (type = 'ruby' or k = 1) as inside from (
    select p.*, s.sel_start < sp_end and s.sel_end > sp_start as hit, o.all_bold, k, case k when 0 then 0 when 1 then least(greatest(s.sel_start - sp_start, 0), length(said)) else least(greatest(s.sel_end - sp_start, 0), length(said)) end as a,
    case k when 0 then least(greatest(s.sel_start - sp_start, 0), length(said)) when 1 then least(greatest(s.sel_end - sp_start, 0), length(said)) else length(said) end as b
    from v_placed p join ''' + _SELECTION + ''' s using (line) left join (select line, bool_and(style = 'bold') as all_bold from v_placed join ''' + _SELECTION + ''' using (line) where sel_start < sp_end and sel_end > sp_start group by 1) o using (line), (select unnest([0, 1, 2]) as k)
    ) where (type = 'text' and b > a) or (type = 'ruby' and k = 1)))''')} group by line, run""")
def restyle_ranges(t: Tables) -> DataFrame:
    spans = t.spans()
    edits = _lines(t).select("line", (F.col("line") % 4).alias("sel_start"), (F.col("line") % 4 + 5).alias("sel_end"), F.lit("bold").alias("style"), F.lit(False).alias("set_color"), F.lit(None).cast("string").alias("color_value"))
    return editing.restyle_ranges(spans, edits).select("line", "ord", "type", F.coalesce("text", "base").alias("said"), F.array_join("styles", ",").alias("styles"))


@query("""select line, run::bigint as ord, any_value(type) as type, string_agg(said, '' order by ord) as said, any_value(style) as styles from """ + _RUNS.format("(select line, ord, case when ord <= 2 then 'text' else type end as type, said, style from v_spans)") + " group by line, run")
def remove_annotations(t: Tables) -> DataFrame:
    spans = t.spans()
    ranges = editing.with_offsets(spans).where("ord <= 2").select("line", "start", "end")
    return editing.remove_annotations(spans, ranges).select("line", "ord", "type", F.coalesce("text", "base").alias("said"), F.array_join("styles", ",").alias("styles"))


@query("""select append_seq, lpad(cast(at_ms // 3600000 as varchar), cast(greatest(2, length(cast(at_ms // 3600000 as varchar))) as int), '0') || ':' || lpad(cast(at_ms // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast(at_ms // 1000 % 60 as varchar), 2, '0') || '.' || lpad(cast(at_ms % 1000 as varchar), 3, '0') as said, at_ms as back from v_log""")
def timestamps(t: Tables) -> DataFrame:
    return t.log().select("append_seq", X.format_timestamp("at_ms").alias("said")).withColumn("back", X.timestamp_ms("said"))


# translation


@query("select cue_id, append_seq as source_seq from v_revisions r where author <> 'translation' and cue_id not in (select cue_id from v_effective where author = 'translation') qualify row_number() over (partition by cue_id order by append_seq desc) = 1")
def select_translation(t: Tables) -> DataFrame:
    return translation.select_translation(t.log().select("cue_id").distinct(), t.revisions())[0].select("cue_id", "source_seq")


@query("select track_id, cue_index, lag(said) over w as previous_context, lead(said) over w as next_context from (select *, case when cue_index % 5 <> 0 then text end as said from v_cues) window w as (partition by track_id order by cue_index)")
def neighbour_context(t: Tables) -> DataFrame:
    cues = t.cues()
    return translation.neighbour_context(cues, cues.where("cue_index % 5 <> 0").select("cue_id", "text")).select("track_id", "cue_index", "previous_context", "next_context")


@query("""select cue_id, '{"task":"translate_subtitle_cue","source_language":"eng","target_language":"kor","proper_noun_mappings":' || case when track_id % 10 = 0 then '[{"source":"a","translation":"b"}]' else '[]' end || '}' as stable, case when cue_index % 3 = 0 then 2 else 1 end as blocks from v_cues""")
def translation_requests(t: Tables) -> DataFrame:
    cues = t.blocks().withColumns({"project_id": F.col("track_id") % 10, "source_language": F.lit("eng"), "target_language": F.lit("kor"), "previous_context": F.lit(None).cast("string"), "next_context": F.lit("n")})
    glossary = t.spark.createDataFrame([(0, "a", "b")], "project_id long, source string, translation string")
    out = translation.translation_requests(cues, glossary)
    return out.select("cue_id", "stable", F.size(F.from_json("variable", "blocks array<struct<block_index:int>>").blocks).alias("blocks"))


@query("""select track_id, case when k = 1 then 'expected ' || cast(n as varchar) || ' lines, received ' || cast(n + 1 as varchar) when k = 2 then 'line mapping is empty or duplicated' when k = 3 then 'block index is out of range' when k = 4 then 'expected 1 blocks, received 0' end as error
    from (select track_id, count(*) as n, case when track_id % 5 = 3 then 5 else track_id % 5 end as k from v_cues group by 1)""")
def validate_translation(t: Tables) -> DataFrame:
    c = t.cues().select("track_id", F.lit(1).alias("block_index"), F.row_number().over(_by_track()).alias("line_index"))
    k = F.col("track_id") % 5
    got = c.withColumn("text", F.when((k == 2) & (F.col("line_index") == 1), F.lit("  ")).otherwise(F.lit("x"))).where(k != 4)
    more = c.where((k == 1) & (F.col("line_index") == 1)).withColumn("text", F.lit("again"))
    return translation.validate_translation(c, got.unionByName(more), cue="track_id")


def _by_track():
    from pyspark.sql.window import Window

    return Window.partitionBy("track_id").orderBy("cue_index")


@query("select cue_id, 'T' || cast(cue_id as varchar) as said, case when cue_index % 4 = 0 then 'bold,italic' when cue_index % 4 = 1 then 'superscript' else '' end as styles from v_cues where text is not null")
def apply_translation(t: Tables) -> DataFrame:
    cues = t.blocks().where("text is not null")
    received = cues.select("cue_id", F.posexplode("blocks").alias("b", "x")).select("cue_id", (F.col("b") + 1).alias("block_index"), F.lit(1).alias("line_index"), F.concat(F.lit(" T"), F.col("cue_id").cast("string")).alias("text"))
    out = translation.apply_translation(cues.select("cue_id", "blocks"), received).withColumn("line", F.get(F.get("blocks", F.lit(0))["lines"], F.lit(0)))
    return out.select("cue_id", F.col("line.text").alias("said"), F.array_join(F.get("line.spans", F.lit(0)).styles, ",").alias("styles"))


@query("select doc_id, line_no, term from v_lines join v_terms on contains(line, term)")
def glossary_hits(t: Tables) -> DataFrame:
    return translation.glossary_hits(t.lines(), t.terms(), keys=("doc_id", "line_no"), text="line", term="term")


# jobs


@query("select append_seq, user_id, row_number() over (order by append_seq desc) as place from v_log")
def list_jobs(t: Tables) -> DataFrame:
    return jobs.list_jobs(t.log()).select("append_seq", "user_id", long("place"))


@query("select user_id as job_id, arg_max(event_type, append_seq) as phase, max(append_seq) as current, count(distinct cue_id) filter (event_type = 'purchase') as completed from v_log group by 1")
def job_progress(t: Tables) -> DataFrame:
    e = t.log().select(F.col("user_id").alias("job_id"), "append_seq", F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type")).alias("phase"), F.col("append_seq").alias("current"), "cue_id")
    return jobs.job_progress(e).withColumn("phase", F.when(F.col("phase") == "completed", "purchase").otherwise(F.col("phase")))


@query("select append_seq, case event_type when 'click' then 'interrupted' when 'view' then 'interrupted' else 'completed' end as status, event_type in ('click', 'view') as changed from v_log")
def recover_interrupted(t: Tables) -> DataFrame:
    e = t.log().select("append_seq", F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "paused").otherwise("completed").alias("status"))
    return jobs.recover_interrupted(e).select("append_seq", "status", "changed")


@query("select distinct user_id as job_id, cue_id from v_log where cue_id not in (select cue_id from v_log where event_type = 'purchase')")
def remaining_work(t: Tables) -> DataFrame:
    e = t.log().withColumnRenamed("user_id", "job_id")
    return jobs.remaining_work(e, e.where("event_type = 'purchase'"))


@query("select user_id as job_id, arg_max(status, append_seq) as status, max(append_seq) as append_seq from (select user_id, append_seq, case event_type when 'view' then 'queued' when 'click' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' end as status from v_log) where status is not null group by 1")
def job_state(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("odd")
    return jobs.job_state(t.log().withColumnRenamed("user_id", "job_id").withColumn("status", status))[0]


# export


@query("""select project_id, case when n = 1 then track_id end as track_id, case when n is null then 'no track has cues' when n > 1 then 'a track must be named' end as error from (select distinct o_custkey as project_id from orders) left join
    (select o_custkey as project_id, count(*) as n, min(o_orderkey) as track_id from orders where o_orderkey in (select l_orderkey from lineitem where l_linenumber = 1) group by 1) using (project_id)""")
def select_track(t: Tables) -> DataFrame:
    tracks = t.read("orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("track_id"))
    return export.select_track(tracks, t.read("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("track_id")))


_APPROVED = "(select cue_id, arg_max(case kind when 'decision' then status else 'unreviewed' end, append_seq) filter (kind in ('decision', 'revision')) as review_status from v_log group by 1)"


@query(f"select s.cue_id, e.author from {_APPROVED} s join v_effective e using (cue_id) where review_status = 'approved'")
def export_cues(t: Tables) -> DataFrame:
    return export.export_cues(evidence.cue_state(t.log()), t.revisions(), "approved").select("cue_id", "author")


@query(f"select s.cue_id // 100 as track_id, count(*) - count(e.cue_id) filter (review_status = 'approved') as skipped from {_APPROVED} s left join v_effective e using (cue_id) group by 1")
def skipped_cues(t: Tables) -> DataFrame:
    cues = evidence.cue_state(t.log()).withColumn("track_id", F.floor(F.col("cue_id") / 100).cast("bigint"))
    return export.skipped_cues(cues, export.export_cues(cues, t.revisions(), "approved"))


_CLOCK = "lpad(cast({0} // 3600000 as varchar), 2, '0') || ':' || lpad(cast({0} // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast({0} // 1000 % 60 as varchar), 2, '0') || ',' || lpad(cast({0} % 1000 as varchar), 3, '0')"


@query(f"select l_orderkey, l_linenumber, l_partkey, {_CLOCK.format('(l_partkey * 9973)')} as said from lineitem")
def srt_timestamp(t: Tables) -> DataFrame:
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.srt_timestamp(F.col("l_partkey") * 9973).alias("said"))


_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_TAGGED = f"case when cue_index % 4 = 0 then '<b><i>' || {_ESCAPED} || '</i></b>' else {_ESCAPED} end"


@query(f"select cue_id, {_TAGGED} as said from v_cues where text is not null")
def srt_line(t: Tables) -> DataFrame:
    return t.blocks().where("text is not null").select("cue_id", X.srt_line(F.get(F.get("blocks", F.lit(0))["lines"], F.lit(0))).alias("said"))


@query(f"""select track_id, cue_index, seq, cast(seq as varchar) || chr(10) || {_CLOCK.format('start_ms')} || ' --> ' || {_CLOCK.format('end_ms')} || chr(10) || case when cue_index % 3 = 0 then said || chr(10) || said else said end || chr(10) || chr(10) as entry
    from (select *, row_number() over (partition by track_id order by start_ms, end_ms, cue_index) as seq, {_TAGGED} as said from v_cues where text is not null)""")
def srt_cues(t: Tables) -> DataFrame:
    return export.render_srt(t.blocks().where("text is not null")).select("track_id", "cue_index", long("seq"), "entry")


_LOSSES = """(select cue_id, track_id, cue_index, unnest([case when cue_index % 3 = 0 then 'multiple_blocks_flattened' end, case when cue_index % 21 = 0 then 'vertical_writing_lost' end, case when cue_index % 3 = 0 then 'block_position_lost' end,
    case when cue_index % 6 = 0 then 'ruby_flattened' end, case when cue_index % 5 = 0 then 'text_color_omitted' end, case when cue_index % 4 = 1 then 'baseline_styles_omitted' end]) as code from v_cues)"""


@query(f"select cue_id, code, 'Cue ' || cast(cue_index as varchar) || ' ' || m as message from {_LOSSES} join (values {', '.join(str(x) for x in export.LOSSES)}) l(code, m) using (code)")
def export_warnings(t: Tables) -> DataFrame:
    return export.export_warnings(t.blocks()).select("cue_id", "code", "message")


@query(f"select track_id, code, count(*) as cues from {_LOSSES} where code is not null group by 1, 2")
def warning_summary(t: Tables) -> DataFrame:
    return export.warning_summary(export.export_warnings(t.blocks(), track="track_id"))


@query("""select track_id, '{"format":"subtitle-evidence","version":2,"track_id":' || cast(track_id as varchar) || ',"cues":[' || string_agg('{"start_ms":' || cast(start_ms as varchar) || ',"end_ms":' || cast(end_ms as varchar) || ',"cue_index":' || cast(cue_index as varchar) || ',"role":"' || role || '"}', ',' order by start_ms, end_ms, cue_index, role) || ']}' as document from v_cues group by 1""")
def canonical_json(t: Tables) -> DataFrame:
    return export.canonical_documents(t.cues(), more=("role",))


@query("select page_id, regexp_replace(trim(url), '[/\\\\:*?\"<>|]', '_', 'g') as stem, regexp_replace(trim(url), '[/\\\\:*?\"<>|]', '_', 'g') || '.und' as base from pages where url is not null")
def safe_stem(t: Tables) -> DataFrame:
    return t.read("pages").where("url is not null").select("page_id", X.safe_stem("url").alias("stem"), X.base_name(F.lit(" "), F.col("url"), F.lit(None).cast("string")).alias("base"))


@query("select l_orderkey, string_agg(f, ',' order by o) as formats from (select l_orderkey, f, min(o) as o from (select line as l_orderkey, ord as o, substr(said, 1, 1) as f from v_spans) group by 1, 2) group by 1")
def unique_formats(t: Tables) -> DataFrame:
    rows = t.spans().groupBy(F.col("line").alias("l_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.substring(F.coalesce("text", "base"), 1, 1).alias("f")))), lambda s: s.f).alias("a"))
    return rows.select("l_orderkey", F.array_join(X.unique_formats(F.col("a")), ",").alias("formats"))


@query("""select r.cue_id, r.author, case when a.cue_id is not null then 'approved' else 'open' end as state, r.append_seq from v_effective r left join (select d.cue_id from (select * from v_decisions qualify row_number() over (partition by cue_id order by append_seq desc) = 1) d
    join v_effective e on e.cue_id = d.cue_id and e.append_seq = d.revision_seq where d.status = 'approved') a using (cue_id)""")
def approved_revisions(t: Tables) -> DataFrame:
    approved = evidence.valid_approvals(evidence.bind_decisions(t.log()), t.revisions()).select("cue_id", F.lit(True).alias("ok"))
    rows = evidence.effective_revision(t.revisions()).join(approved, "cue_id", "left")
    return rows.select("cue_id", "author", F.when(F.col("ok"), "approved").otherwise("open").alias("state"), "append_seq")


# the log after deletions


@query("select user_id, cue_id, append_seq, revision_seq from v_log3 where kind = 'deletion'")
def deletion_rows(t: Tables) -> DataFrame:
    return t.deleted_log().where("kind = 'deletion'").select("user_id", "cue_id", "append_seq", "revision_seq")


@query("select cue_id, append_seq, author from v_live qualify row_number() over (partition by cue_id order by append_seq desc) = 1")
def live_effective(t: Tables) -> DataFrame:
    return evidence.effective_revision(evidence.live_revisions(t.deleted_log())).select("cue_id", "append_seq", "author")


@query("""select cue_id, count(*) as revisions, max(append_seq) filter (author = 'ocr') as recognised, max(append_seq) filter (author <> 'translation') as source from v_live group by 1""")
def live_sources(t: Tables) -> DataFrame:
    """How many revisions are left of each cue, its newest recognition and what a translation would start from."""
    live = evidence.live_revisions(t.deleted_log())
    recognised = evidence.latest_recognition(live).select("cue_id", F.col("append_seq").alias("recognised"))
    source = evidence.translation_source(live).select("cue_id", F.col("append_seq").alias("source"))
    return evidence.revision_counts(live).join(recognised, "cue_id", "left").join(source, "cue_id", "left")


@query("select cue_id, replaces, restores from (select cue_id, append_seq as replaces, lag(append_seq) over w as restores, row_number() over (partition by cue_id order by append_seq desc) as r from v_live window w as (partition by cue_id order by append_seq)) where r = 1 and restores is not null")
def live_undo(t: Tables) -> DataFrame:
    return evidence.undo_target(evidence.live_revisions(t.deleted_log()))


@query("""select cue_id, case when count(*) filter (kind = 'attempt') > 0 then 'failed' else 'pending' end as ocr_status,
    coalesce(arg_max(case kind when 'decision' then status else 'unreviewed' end, append_seq) filter (kind in ('decision', 'revision', 'deletion')), 'unreviewed') as review_status from v_log3 group by 1""")
def live_state(t: Tables) -> DataFrame:
    return evidence.cue_state(t.deleted_log())


@query("""select d.cue_id, d.append_seq, d.revision_seq from (select * from v_decisions qualify row_number() over (partition by cue_id order by append_seq desc) = 1) d
    join (select * from v_live qualify row_number() over (partition by cue_id order by append_seq desc) = 1) e on e.cue_id = d.cue_id and e.append_seq = d.revision_seq where d.status = 'approved'""")
def live_approvals(t: Tables) -> DataFrame:
    """Approvals that name what is effective once deletions count."""
    return evidence.valid_approvals(evidence.bind_decisions(t.log()), evidence.live_revisions(t.deleted_log())).select("cue_id", "append_seq", "revision_seq")


@query("""select r.cue_id, r.author, case when a.cue_id is not null then 'approved' else 'open' end as state, r.append_seq from v_effective r left join (select d.cue_id from (select * from v_decisions qualify row_number() over (partition by cue_id order by append_seq desc) = 1) d
    join v_effective e on e.cue_id = d.cue_id and e.append_seq = d.revision_seq where d.status = 'approved') a using (cue_id) where r.cue_id // 100 % 4 = 1""")
def approved_in_store(t: Tables) -> DataFrame:
    """``approved_revisions`` of one project from a bucketed store that the log was appended to in two parts."""
    table = stored_log(t)
    return store_approvals(store.read_bucketed(t.spark, table).where("project_id = 1"))


def stored_log(t: Tables) -> str:
    table = f"cue_log_{uuid.uuid4().hex}"
    log, folder = t.log().select("cue_id", "append_seq", "kind", "status", "author", F.expr("cue_id div 100 % 4").alias("project_id")), own_folder(t.spark, "store")
    for part in (log.where("append_seq % 2 = 0"), log.where("append_seq % 2 = 1")):
        store.append_bucketed(part, table, buckets=8, path=folder)
    return table


def store_approvals(log: DataFrame) -> DataFrame:
    revisions = log.where("kind = 'revision'")
    approved = evidence.valid_approvals(evidence.bind_decisions(log), revisions).select("cue_id", F.lit(True).alias("ok"))
    rows = evidence.effective_revision(revisions).join(approved, "cue_id", "left")
    return rows.select("cue_id", "author", F.when(F.col("ok"), "approved").otherwise("open").alias("state"), "append_seq")


# diagnostics and search


@query("""select append_seq, '{"k":' || k || ',"api-key":"[REDACTED]","nested":{"Authorization":"[REDACTED]","ok":' || k || '}}' as details from (select append_seq, json_extract_string(props, '$.k') as k from v_log)""")
def redact_keys(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    details = F.concat(F.lit('{"k":'), k, F.lit(',"api-key":"s3","nested":{"Authorization":["a","b"],"ok":'), k, F.lit("}}"))
    return diagnostics.redact_details(t.log().select("append_seq", details.alias("details")))


@query("""select append_seq, '{"k":' || k || ',"password": "[REDACTED]"}' as details from (select append_seq, json_extract_string(props, '$.k') as k from v_log)""")
def redact_flat(t: Tables) -> DataFrame:
    details = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"password": "a\\"b"}'))
    return t.log().select("append_seq", X.redact_flat_json(details).alias("details"))


@query("""select doc_id, case when doc_id % 2 = 0 then '{"redacted":"base64_data","estimated_byte_length":' || cast(strlen(text) * 3 // 4 as varchar) || '}' else text end as said from documents where text is not null""")
def redact_base64(t: Tables) -> DataFrame:
    rows = t.read("documents").where("text is not null")
    return rows.select("doc_id", X.redact_base64(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), F.col("text"))).otherwise(F.col("text"))).alias("said"))


@query("select doc_id, md5(replace(replace(text, 'token', '[REDACTED]'), 'password', '[REDACTED]')) as said from documents")
def redact_text(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.md5(X.redact_secrets("text", ["token", "password", ""])).alias("said"))


@query("select session_id, sequence from v_diag where level = 'error' and contains(lower(phase || chr(10) || details), '7')")
def filter_log(t: Tables) -> DataFrame:
    return diagnostics.filter_log(t.diagnostics(), level="error", query="7", columns=("phase", "details")).select("session_id", "sequence")


@query("select distinct source from v_diag")
def log_sources(t: Tables) -> DataFrame:
    return diagnostics.log_sources(t.diagnostics())


@query("select session_id, sequence from v_diag where session_id in (select distinct session_id from v_diag order by session_id desc limit 5)")
def retain_sessions(t: Tables) -> DataFrame:
    return diagnostics.retain_sessions(t.diagnostics()).select("session_id", "sequence")


@query("select session_id, sequence from v_diag qualify row_number() over (partition by session_id order by sequence desc) <= 10")
def tail_entries(t: Tables) -> DataFrame:
    return diagnostics.tail_entries(t.diagnostics(), 10).select("session_id", "sequence")


@query("select page_id, regexp_replace(url, '[?#].*$', '') as url from pages")
def sanitize_url(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", X.sanitize_url("url").alias("url"))


@query("select doc_id, substr(text, 1, 1000) as excerpt, case when lang is not null then 'x-lang=' || lang else '' end as headers from documents")
def safe_headers(t: Tables) -> DataFrame:
    headers = F.when(F.col("lang").isNotNull(), F.create_map(F.lit("X-Lang"), F.col("lang"), F.lit("Cookie"), F.lit("s"))).otherwise(F.create_map(F.lit("Cookie"), F.lit("s")))
    kept = F.map_entries(X.safe_headers(headers, ["x-lang"]))
    return t.read("documents").select("doc_id", X.error_excerpt("text").alias("excerpt"), F.array_join(F.transform(kept, lambda e: F.concat_ws("=", F.lower(e.key), e.value)), ",").alias("headers"))


@query("select session_id * 100 + operation as correlation_id, count(*) as entries, min(at_ms) as started_ms, max(at_ms) - min(at_ms) as duration_ms, arg_max(phase, sequence) as outcome from v_diag group by 1")
def correlate(t: Tables) -> DataFrame:
    return diagnostics.correlate(t.diagnostics().withColumn("correlation_id", F.col("session_id") * 100 + F.col("operation")), at="at_ms")


@query("select operation, level as model, count(*) filter (phase = 'view') as n_view, count(*) filter (phase = 'error') as n_error, count(*) filter (phase = 'purchase') as n_purchase from v_diag group by 1, 2")
def stage_outcomes(t: Tables) -> DataFrame:
    return diagnostics.stage_outcomes(t.diagnostics().withColumnRenamed("level", "model"), ["view", "error", "purchase"])


@query("select to_json(struct_pack(session_id := session_id, sequence := sequence, level := level, phase := phase, source := source, operation := operation, at_ms := at_ms, details := details))::varchar as value from v_diag where session_id = 7")
def export_session(t: Tables) -> DataFrame:
    return diagnostics.export_session(t.diagnostics(), 7)


@query("select track_id, cue_index from v_cues where contains(lpad(cast(cue_index as varchar), 6, '0'), 'the') or contains(lower(text), 'the')")
def search_cues(t: Tables) -> DataFrame:
    return search.search_cues(t.cues(), "  THE ").select("track_id", "cue_index")


@query("select cue_index, start_ms, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text, case when role = 'user' then 'approved' when cue_index % 2 = 0 then 'recognised' else 'pending_failed' end as display from v_cues")
def cue_list(t: Tables) -> DataFrame:
    rows = t.cues().withColumns({"review_status": F.when(F.col("role") == "user", "approved").otherwise("unreviewed"), "ocr_status": F.when(F.col("cue_index") % 2 == 0, "succeeded").otherwise("failed")})
    return search.cue_list_rows(rows)


# sources


def _listings(t: Tables) -> DataFrame:
    """A disc listing for each conversation: a title a turn, languages under every other one, main titles of every kind, none for some."""
    i, n = F.col("cue_index"), F.col("track_id")
    title = F.format_string("index: %d  duration: %02d:%02d:%02d  chapters: %d  angles: 1  clips: %d  (playlist: %d.mpls)  V:1 A:%d PG:%d", i, i % 3, i % 60, (i * 7) % 60, i + 1, i % 2, i + 800, i % 4, i % 5)
    listed = t.cues().groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("cue_index", F.concat(title, F.when(i % 2 == 0, "\n    PG : eng jpn").otherwise("")).alias("said")))).alias("titles"))
    body = F.when(n % 7 == 0, "nothing to play").otherwise(F.array_join(F.transform("titles", lambda x: x.said), "\r\n"))
    main = F.when(n % 5 == 0, "").when(n % 5 == 1, "\nMain title: first").when(n % 5 == 2, "\nMain title: 999999").otherwise(F.concat(F.lit("\n Main title: "), F.array_min(F.transform("titles", lambda x: x.cue_index)).cast("string")))
    return listed.select(n.alias("path"), F.concat(F.lit("using: a disc\n"), body, main).alias("value"))


@query("""select path, case m when '' then null when 'first' then null else m::int end as main_title_index, case when m = '' then 'main title is missing' when m = 'first' then 'main title is not a number'
    when path % 7 = 0 then 'no playable titles were reported' when m = '999999' then 'main title was not listed' end as error
    from (select track_id as path, case track_id % 5 when 0 then '' when 1 then 'first' when 2 then '999999' else min(cue_index)::varchar end as m from v_cues group by track_id)""")
def title_listings(t: Tables) -> DataFrame:
    return readers.parse_title_listings(_listings(t))[1]


@query("""select track_id as path, cue_index::int as index, lpad((cue_index + 800)::varchar, 5, '0') as playlist, cue_index % 3 * 3600 + cue_index % 60 * 60 + cue_index * 7 % 60 as duration_seconds, (cue_index + 1)::int as chapters, 1 as angles, (cue_index % 2)::int as clips,
    1 as video_tracks, (cue_index % 4)::int as audio_tracks, (cue_index % 5)::int as pgs_tracks, case when cue_index % 2 = 0 then 'eng,jpn' else '' end as languages from v_cues where track_id % 7 <> 0""")
def listed_titles(t: Tables) -> DataFrame:
    titles = readers.parse_title_listings(_listings(t))[0]
    return titles.withColumn("languages", F.array_join("pgs_languages", ",")).drop("pgs_languages")


@query("select append_seq, cast(json_extract_string(props, '$.k') as bigint) as k from v_log where event_type <> 'error'")
def decode_documents(t: Tables) -> DataFrame:
    rows = t.log().withColumn("job", F.when(F.col("event_type") == "error", "unknown").otherwise("ocr"))
    good, _ = readers.decode_typed_documents(rows.select("append_seq", "props", "job"), "props", "k bigint", enums={"job": "job_kind"})
    return good.select("append_seq", F.col("decoded.k").alias("k"))


@query("select c_custkey as id, c_name as name, 'jpn' as ocr_language, case when c_custkey % 2 = 0 then 'eng' else 'kor' end as target_language from customer")
def project_metadata(t: Tables) -> DataFrame:
    settings = F.when(F.col("c_custkey") % 2 == 0, F.lit(',"settings":{"ocr_language":"jpn","target_language":"eng","proper_nouns":[]}')).otherwise(F.lit(""))
    document = F.concat(F.lit('{"id":"'), F.col("c_custkey").cast("string"), F.lit('","schema_version":2,"name":"'), F.col("c_name"), F.lit('"'), settings, F.lit("}"))
    out = readers.decode_project_metadata(t.read("customer").select("c_custkey", document.alias("document")))
    return out.select(F.col("c_custkey").alias("id"), "name", F.col("settings.ocr_language").alias("ocr_language"), F.col("settings.target_language").alias("target_language"))


# operators with a backend, on segments and on listings


@query("select cue_id, role || ':' || length(coalesce(text, '')) as response from v_cues")
def score_batch(t: Tables) -> DataFrame:
    requests = t.cues().select("cue_id", F.col("role").alias("stable"), F.coalesce("text", F.lit("")).alias("variable"))
    return recognition.score_batch(requests, lambda b: b["stable"] + ":" + b["variable"].str.len().astype(str), columns=("cue_id",))


@query("""select cue_id as request_id, case n % 3 when 1 then '1|first' when 2 then '1|second' else '2|second' end as response, case when n % 3 = 0 then 'zero' end as error, case when n % 3 = 1 then 1 else 2 end as attempt
    from (select cue_id, length(coalesce(text, '')) as n from v_cues)""")
def retry_rounds(t: Tables) -> DataFrame:
    """A pure backend that answers by the length of what it is asked, so that some answers pass at once, some at the second attempt and some never."""
    requests = t.cues().select(F.col("cue_id").alias("request_id"), F.lit("s").alias("stable"), F.coalesce("text", F.lit("")).alias("variable"))

    def backend(batch):
        return (batch["variable"].str.len() % 3).astype(str) + batch["variable"].str.contains("It was rejected", regex=False).map({True: "|second", False: "|first"})

    judge = lambda df: df.withColumn("error", F.when(~F.col("response").startswith("1"), "zero"))
    return recognition.retry_rounds(requests, backend, judge)


@query("""select cue_id as request_id, 'combined:' || cue_id as combined, case when cue_id % 5 = 0 then 'failed' end as combined_error, case when cue_id % 5 <> 0 then 'style:' || cue_id end as style,
    case when cue_id % 5 <> 0 and cue_id % 7 = 0 then 'failed' end as style_error from v_cues""")
def two_phases(t: Tables) -> DataFrame:
    blocks = t.cues().select(F.col("cue_id").alias("request_id"), F.lit("eng").alias("language_code"), F.lit("horizontal_tb").alias("writing_mode"), F.lit(1).alias("units"), F.array(F.lit(3)).alias("expected_glyphs"), F.lit(None).cast("string").alias("correction"))
    presets = t.spark.createDataFrame([("eng", s, "read") for s in ("combined", "style")], "language string, stage string, instructions string")

    def run_stage(asked: DataFrame, stage: str) -> DataFrame:
        return asked.select("request_id", F.concat(F.lit(f"{stage}:"), "request_id").alias("response"), F.when(F.col("request_id") % (5 if stage == "combined" else 7) == 0, "failed").alias("error"))

    return recognition.recognise(blocks, presets, run_stage, ruby=False)


def _annotations(t: Tables) -> tuple[DataFrame, DataFrame]:
    spans = t.spans()
    no = F.col("line")
    edits = _lines(t).select("line", F.when(no % 10 == 3, no + 1).otherwise(no).alias("end_line"), (no % 4).alias("sel_start"), F.when(no % 6 == 1, no % 4).otherwise(no % 4 + 5).alias("sel_end"), F.lit("note").alias("annotation"), F.lit("over").alias("position"))
    unknown = edits.where("line % 9 = 0").select((-no - 1).alias("line"), (-no - 1).alias("end_line"), F.lit(0).cast("bigint").alias("sel_start"), F.lit(4).cast("bigint").alias("sel_end"), "annotation", "position")
    return editing.annotate_ranges(spans, edits.unionByName(unknown))


_EDITS = """(select line, line % 10 = 3 as wide, line % 4 as a, case when line % 6 = 1 then line % 4 else line % 4 + 5 end as b, string_agg(said, '' order by ord) as said,
    bool_or(type = 'ruby' and line % 4 < sp_end and (case when line % 6 = 1 then line % 4 else line % 4 + 5 end) > sp_start and not (line % 4 = sp_start and line % 4 + 5 = sp_end)) as cut from v_placed group by line)"""


@query(f"select line, substr(said, (a + 1)::bigint, (b - a)::bigint) as base from {_EDITS} where not wide and a < b and not cut and length(said) > a")
def annotate_ranges(t: Tables) -> DataFrame:
    return _annotations(t)[0].where("type = 'ruby' and annotations[0].text = 'note'").select("line", "base")


@query(f"""select line, case when wide then 'several lines' when a >= b then 'empty' else 'cuts a ruby span' end as reason from {_EDITS} where wide or a >= b or cut
    union all select distinct -line - 1, 'no such line' from v_spans where line % 9 = 0""")
def annotate_refused(t: Tables) -> DataFrame:
    return _annotations(t)[1].select("line", "reason")


@query("select o_custkey::bigint as project_id, case when o_orderkey % 2 = 0 then 'srt' else 'json' end as format, 'exports/' || o_orderkey as path, o_orderpriority as settings from orders where o_orderstatus <> 'F'")
def export_audit(t: Tables) -> DataFrame:
    artifacts = t.read("orders").select(F.col("o_custkey").cast("bigint").alias("project_id"), F.when(F.col("o_orderkey") % 2 == 0, "srt").otherwise("json").alias("format"), F.concat(F.lit("exports/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderpriority").alias("settings"), (F.col("o_orderstatus") != "F").alias("written"))
    return export.export_audit(artifacts).select("project_id", "format", "path", "settings")


@query("""select append_seq, '{"deep":' || case when d <= 11 then repeat('[', d) || '1' || repeat(']', d) else repeat('[', 12) || '"[TOO DEEP]"' || repeat(']', 12) end || ',"list":'
    || case when n > 256 then '{"redacted":"binary_data","byte_length":' || n || '}' else '[' || array_to_string(range(n), ',') || ']' end || '}' as details from (select append_seq, (append_seq % 16)::int as d, append_seq % 300 as n from v_log)""")
def bound_details(t: Tables) -> DataFrame:
    d, n = (F.col("append_seq") % 16).cast("int"), F.col("append_seq") % 300
    deep = F.concat(F.repeat(F.lit("["), d), F.lit("1"), F.repeat(F.lit("]"), d))
    listed = F.when(n > 0, F.array_join(F.sequence(F.lit(0).cast("bigint"), n - 1), ",")).otherwise("")
    log = t.dealt(t.log().select("append_seq"), "events", "append_seq")  # details are far longer than what the few scan tasks of the table read
    return diagnostics.redact_details(log.select("append_seq", F.concat(F.lit('{"deep":'), deep, F.lit(',"list":['), listed, F.lit("]}")).alias("details")))


@query("select l_orderkey as cue_id, case l_linestatus when 'O' then 'ambiguous_writing_mode' else 'tiny_block_merged' end as code from lineitem where l_quantity > 45")
def layout_doubts(t: Tables) -> DataFrame:
    return layout.layout_doubts(_layout(t))


def _segments(t: Tables) -> DataFrame:
    """Segments of a file a user: presentations by views and, without a state, by signups; some are too short."""
    kind = F.when(F.col("event_type").isin("view", "signup"), 22).when(F.col("event_type") == "click", 20).when(F.col("event_type") == "purchase", 21).otherwise(128)
    state = F.when(F.col("event_type") == "view", "80").otherwise("00")
    payload = F.when(F.col("append_seq") % 9 == 0, "0000").otherwise(F.concat(F.lit("00000000000000"), state, F.lit("000000")))
    return t.log().select(F.col("user_id").alias("path"), F.col("append_seq").alias("seg_no"), kind.alias("kind"), F.unhex(payload).alias("payload"), payload.alias("hex"), "at_ms")


@query("""select user_id as path, append_seq as seg_no, sum(case when event_type = 'view' and append_seq % 9 <> 0 then 1 else 0 end) over (partition by user_id order by append_seq)::bigint as epoch,
    coalesce(sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by append_seq rows between unbounded preceding and 1 preceding), 0)::bigint + 1 as set_no from v_log""")
def display_sets(t: Tables) -> DataFrame:
    return ingest.assemble_display_sets(_segments(t)).select("path", "seg_no", "epoch", "set_no")


@query("""select path, object_id, version, declared, rle, case when version = 0 then 'continuation for unknown object' when length(rle) > declared then 'object exceeds declared length' when length(rle) < declared then 'incomplete object' end as error from (
    select path, object_id, version, max(case when first then declared end) as declared, string_agg(event_type, '' order by append_seq) as rle from (
    select user_id as path, append_seq % 2 as object_id, append_seq, event_type, event_type = 'view' as first, 4 + append_seq % 3 * 5 as declared, sum(case when event_type = 'view' then 1 else 0 end) over (partition by user_id, append_seq % 2 order by append_seq)::bigint as version from v_log) group by 1, 2, 3)""")
def reassembled_objects(t: Tables) -> DataFrame:
    fragments = t.log().select(F.col("user_id").alias("path"), (F.col("append_seq") % 2).alias("object_id"), F.col("append_seq").alias("seg_no"), (F.col("event_type") == "view").alias("first"), (4 + F.col("append_seq") % 3 * 5).alias("declared"), F.encode("event_type", "UTF-8").alias("data"))
    return ingest.reassemble_objects(fragments, ("path", "object_id")).select("path", "object_id", "version", "declared", F.decode("rle", "UTF-8").alias("rle"), "error")


@query("""select user_id as path, row_number() over (partition by user_id order by append_seq) as seg_no, at_ms % 1000000 as pts, case event_type when 'view' then 22 when 'signup' then 22 when 'click' then 20 when 'purchase' then 21 else 128 end as kind,
    case when append_seq % 9 = 0 then '0000' else '00000000000000' || case when event_type = 'view' then '80' else '00' end || '000000' end as payload, null as error from v_log
    union all select user_id, count(*) + 1, 0, -1, '', 'truncated segment header' from v_log where user_id % 5 = 0 group by 1""")
def sup_segments(t: Tables) -> DataFrame:
    """Streams put together from events, every fifth broken off, and split again."""
    return said_segments(readers.segments_of(stream_files(t)))


def said_segments(segments: DataFrame) -> DataFrame:
    return segments.select(F.col("path").cast("bigint").alias("path"), "seg_no", "pts", "kind", F.lower(F.hex("payload")).alias("payload"), "error")


def stream_files(t: Tables) -> DataFrame:
    """(path, content) of a stream a user."""
    pts = F.lpad(F.hex(F.col("at_ms") % 1000000), 8, "0")
    one = F.concat(F.lit("5047"), pts, F.lit("00000000"), F.lpad(F.hex("kind"), 2, "0"), F.lpad(F.hex((F.length("hex") / 2).cast("bigint")), 4, "0"), F.col("hex"))
    files = _segments(t).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", one.alias("h")))), lambda x: x.h), "").alias("all"))
    content = F.unhex(F.concat("all", F.when(F.col("path") % 5 == 0, "504700").otherwise("")))
    return files.select(F.col("path").cast("string").alias("path"), content.alias("content"))


@query("select append_seq, user_id from v_log where kind = 'attempt' and status in ('interrupted', 'failed')")
def resumable_jobs(t: Tables) -> DataFrame:
    return jobs.resumable(t.log(), "attempt").select("append_seq", "user_id")
