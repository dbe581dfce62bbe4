"""The registered queries of the thirteen operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import bpe, clustering, jaccard, langid, mixing, quality, secrets, spelling, topk, urlfilter, vectors, warc, wordbpe
from cuelake.llm.workdir import Scratch

TOKENIZER, WORD_TOKENIZER = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: toxic 0, poor 1, good 2; kept are those that are good with probability 0.6 or more."""
    ratings = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + 1).alias("grade"))
    found = quality.grade_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ratings)
    return found.select("doc_id", "expected_grade", "tail_probability", "kept")


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long")
    base = secrets.joined_spans(F.filter("secrets", lambda s: s.base))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), secrets.joined_spans(F.col("secrets")).alias("spans"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "position").orderBy("position", "doc_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return digests(bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer))


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "archives") as scratch:
        folder = scratch.path("warc")
        warc.write_archives(table(spark, sf_dir, "pages"), folder)
        return scratch.keep(warc.catalogue(spark, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = wordbpe.WordTokenizer(spark, public_tokenizers.path(WORD_TOKENIZER))
    return digests(bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.word_counts(table(spark, sf_dir, "documents")))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


def rounds_sql(rounds: int) -> str:
    """One assignment and one move a round, each a table of its own."""
    near = """a{0} as materialized (select i, vec_id, v, c, d from (select x.i, x.vec_id, x.v, m.c, list_sum(list_transform(range(1, 65), lambda p: (x.v[p] - m.v[p]) * (x.v[p] - m.v[p])))::bigint as d from x, m{0} m) qualify row_number() over (partition by i order by d, c) = 1)"""
    move = """u{1} as (select c, p, sum(e)::bigint as s, count(*) as n from (select c, unnest(v) as e, unnest(range(1, 65)) as p from a{0}) group by c, p),
        w{1} as (select c, list((s - (((s % n) + n) % n)) // n order by p) as v from u{1} group by c), m{1} as materialized (select m.c, coalesce(w.v, m.v) as v from m{0} m left join w{1} w on w.c = m.c)"""
    return ",\n        ".join([*(f"{near.format(k)},\n        {move.format(k, k + 1)}" for k in range(rounds)), near.format(rounds)])


QUERIES = {f.__name__: f for f in (op1_ordinal_quality, op2_embedding_neardup, op3_secret_scan, op4_language_id, op5_ngram_jaccard, op6_source_mix, op7_url_filter, op8_byte_bpe, op9_exact_topk, op10_warc, op11_word_bpe, op12_spelling_variants, op13_centroid_clusters)}
SQL = {
    "op2_embedding_neardup": """
        with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
        n as (select vec_id, e, sqrt(list_inner_product(e, e)) as size from v where e is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
        links as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.95),
        reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
        parts as (select a, least(a, min(b)) as component_id from reach group by a), counts as (select a, count(*) as n_links from links group by a)
        select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
        from v left join counts c on c.a = vec_id left join parts p on p.a = vec_id""",
    "op5_ngram_jaccard": """
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
        s as (select doc_id, list_distinct(case when len(words) >= 4 then list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as shingles from w),
        r as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from s),
        links as (select a.doc_id as a, b.doc_id as b from r a join r b on a.shingle = b.shingle and a.doc_id <> b.doc_id and a.n * 100 >= b.n * 85 and b.n * 100 >= a.n * 85 group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach as (select a, b from links union select x.a, l.b from reach x join links l on x.b = l.a), parts as (select a, least(a, min(b)) as component_id from reach group by a)
        select doc_id, len(shingles)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id from s left join parts on a = doc_id""",
    "op6_source_mix": """
        with d as (select doc_id, source, md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as h, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
        s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
        w as (select *, [5.0::double, 2, 1][place % 3 + 1] as weight, [2.0::double, 1, 1][place % 3 + 1] as begin_, [1.0::double, 1, 3][place % 3 + 1] as finish from s),
        c as (select *, sum(source_size) over () as total, coalesce(sum(source_size) over (order by source_size / weight, place rows between unbounded preceding and 1 preceding), 0) as full_,
            sum(weight) over () - coalesce(sum(weight) over (order by source_size / weight, place rows between unbounded preceding and 1 preceding), 0) as open_ from w),
        l as (select *, (total::double * 1.5::double - full_::double * 2.0::double) / open_ as level from c), m as (select *, source_size * 2.0::double <= level * weight as stops from l),
        t as (select *, case when stops then source_size * 2.0::double else (select level from m where not stops order by source_size / weight, place limit 1) * weight end as target from m),
        p as (select d.doc_id, d.size, d.source, t.source_size, t.target, t.begin_, t.finish, coalesce(sum(d.size) over (partition by d.source order by h, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before_
            from d join t on d.source is not distinct from t.source),
        k as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as copies from p),
        x as (select *, copies * size + greatest(0, least(size, floor(target)::bigint - copies * source_size - before_)) as taken from k)
        select doc_id, size, source_size, target, taken::bigint as taken, source, case when taken > 0 then before_ / target * (begin_ + finish) / (begin_ + sqrt(begin_ * begin_ + (finish * finish - begin_ * begin_) * (before_ / target))) end as position from x""",
    # no page of the given tables has a canonical link, a refresh or a base, so that urls without a rule are allowed
    "op7_url_filter": """
        with u as (select page_id, coalesce(url, '') as url from pages),
        h as (select page_id, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from u),
        r as (select *, case when ('.' || host) like '%.example.net' and path like '/en/%' then 'example.net/en/' when ('.' || host) like '%.example.com' and path like '/de/%' then 'example.com/de/'
            when ('.' || host) like '%.org' and path like '/fr/%' then 'org/fr/' when ('.' || host) like '%.net' and path like '/%' then 'net/' end as rule from h)
        select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict, false as aliased from r""",
    "op9_exact_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)
        select q.vec_id as query_id, row_number() over (partition by q.vec_id order by list_inner_product(q.e, c.e) desc, c.vec_id)::int as rank, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
        from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e) qualify rank <= 5""",
    "op10_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
        f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from p)
        select page_id, payload_bytes, payload_digest, case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
        case when first is not null and page_id is distinct from first then first end as refers_to from f""",
    "op12_spelling_variants": """
        with recursive t as (select list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
        r as (select coalesce(cast(doc_id as varchar), '') as id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) as run from documents),
        g as (select id, run, count(*) as n from r group by id, run),
        b as (select *, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [(192 + (unicode(x) >> 6))::bigint, (128 + (unicode(x) & 63))::bigint] end)) as bytes from g),
        h as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, y: xor(c >> 8, t.t[(xor(c, y) & 255) + 1])), 4294967295) as h from b, t),
        c as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h),
        w as materialized (select word, sum(n)::bigint as n, translate(word, 'àáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~') as s from c where length(word) >= 6 group by word having sum(n) >= 5),
        l as (select a.word, a.n, b.word as near, b.n as near_n from w a join w b on a.word <> b.word and abs(length(a.s) - length(b.s)) <= 1 and levenshtein(a.s, b.s) = 1),
        f as (select word, count(*) as n_near, first(near order by near_n desc, near) as best, max(near_n) as best_n from l group by word),
        j as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 5 * w.n then best end as form, case when best_n >= 5 * w.n then best_n end as form_n from w left join f on f.word = w.word),
        e as (select word, word as root, form as further from j union all select e.word, j.word, j.form from e join j on j.word = e.further)
        select j.word, j.form, e.root, j.n, j.n_near, j.form_n from j join e on e.word = j.word and e.further is null""",
    "op13_centroid_clusters": f"""
        with x as materialized (select row_number() over () as i, vec_id, list_transform(embedding, lambda y: floor(1024 * y::double)::bigint) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda y: y is null or isnan(y) or isinf(y))) = 0),
        m0 as materialized (select row_number() over (order by sha256('3:' || vec_id), v) - 1 as c, v from x order by sha256('3:' || vec_id), v limit 8),
        {rounds_sql(10)}
        select vec_id, a.c::int as cluster, d as distance, sum(d) over (partition by a.c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia, sha256(array_to_string(m.v, ',')) as centroid_sha256 from a10 a join m10 m on m.c = a.c""",
}
