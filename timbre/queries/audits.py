"""Corpus audit, fingerprint, signal, listening and lineage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions.identity import digest_strings
from ..operators import corpus, lineage, listening, plan, signal, stats
from ..sources.fingerprints import BINS as BINS_OF_PRINTS
from ..sources.fingerprints import LEVELS, band_hashes
from .scoring import PLAN_SQL, _plan
from .views import DOCS_SQL, OBS_SQL, SIGNAL_SQL, documents, observations, rounded, table
from .views import signal as signal_view

# --- corpus ----------------------------------------------------------------------------------

KEY_SQL = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\p{Z}]+', ' ', 'g'))"


def _doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only digests travel: a normalised text is its sha256 from here on."""
    return documents(spark, sf_dir).select("doc_id", "split", "source", "lang", F.sha2(T.dedupe_key(F.col("text")), 256).alias("text_key"), F.sha2("text", 256).alias("content"))


def text_dup_cross_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.duplicates(_doc_rows(spark, sf_dir), "text_key", ["doc_id"], cross_split_only=True)
    return d.select("doc_id", "split", "first_doc_id", "first_split")


def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicates(_doc_rows(spark, sf_dir), "content", ["doc_id"]).select("doc_id", "first_doc_id", "group_rows")


def group_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a group of twenty documents first seen in another split; the groups cut across splits."""
    d = _doc_rows(spark, sf_dir).withColumn("group", F.concat(F.lit("g"), (F.col("doc_id") / 20).cast("long").cast("string")))
    return corpus.leakage(d, "group", ["doc_id"]).select("doc_id", "group", "split", "first_doc_id", "first_split")


def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("valid", F.length(F.trim("text")) > 0)
    return corpus.split_report(d, "source")


def url_group_regex_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host, taken from the url by a pattern of one group, as the group that must not cross splits."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://([^/?#]+)", 1).alias("host"), F.when(F.col("page_id") % 5 == 4, "test").otherwise("train").alias("split"))
    return corpus.leakage(p, "host", ["page_id"]).groupBy("host").agg(F.count("*").alias("rows"), F.min("first_page_id").alias("first_page_id"), F.min("first_split").alias("first_split"))


def audit_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over documents as manifest rows: counts by split and reason."""
    d = documents(spark, sf_dir)
    path = F.concat(F.col("source"), F.lit("/"), (F.col("doc_id") / 2).cast("long").cast("string"), F.lit(".wav"))
    rows = d.select("split", F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 31 > 0, path).alias("path"), F.sha2("text", 256).alias("sha256"), F.when(F.col("doc_id") % 37 > 0, F.concat_ws("/", "source", (F.col("doc_id") / 10).cast("long").cast("string"))).alias("group_id"))
    # only whether there is text travels: judged on the whole trimmed text
    return corpus.audit_stages(rows.withColumn("text", F.when(F.trim("text") != "", "text").otherwise(""))).groupBy("split", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as fingerprints of 8 bands of 8 bins."""
    sums = V.band_sums(F.col("embedding"), 8, 8)
    bands = F.array(*(F.concat(F.lit("e"), F.bround(s * 20, 0).cast("long").cast("string")) for s in sums))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("split"), "embedding", bands.alias("bands"))


def band_blocking_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.blocking_candidates(_prints(spark, sf_dir))


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _prints(spark, sf_dir)
    c = corpus.blocking_candidates(p)
    both = c.join(p.select(F.col("id").alias("left_id"), F.col("embedding").alias("l")), "left_id").join(p.select(F.col("id").alias("right_id"), F.col("embedding").alias("r")), "right_id")
    half = [F.slice(x, s, 32) for s in (1, 33) for x in ("l", "r")]
    return both.select("left_id", "right_id", "shared", F.round(V.fingerprint_distance(*half), 6).alias("distance"))


def fingerprint_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distances(spark, sf_dir)


def fingerprint_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 64 levels from 0 to 31, forwards for energy and backwards for crossings, and their band hashes."""
    level = F.transform("embedding", lambda x: F.least(F.lit(31.0), F.greatest(F.lit(0.0), F.bround((x.cast("double") + 0.5) * LEVELS, 0))))
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == BINS_OF_PRINTS).select("vec_id", level.alias("q")).withColumn("z", F.reverse("q"))
    return e.select("vec_id", F.array_join(band_hashes(F.col("q"), F.col("z")), "|").alias("bands"))


def candidate_cap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred candidates, right before left, and whether the cap was reached."""
    c = corpus.blocking_candidates(_prints(spark, sf_dir))
    return corpus.capped(c, 100, F.col("right_id"), F.col("left_id")).select("left_id", "right_id", "rank", "total", "reached")


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def multi_reference_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine to the three first vectors of the label."""
    e = table(spark, sf_dir, "embeddings")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    refs = e.withColumn("rank", rank).where("rank <= 3").select("label", F.col("embedding").alias("ref"))
    both = e.join(refs, "label").groupBy("vec_id").agg(F.avg(V.cosine(F.col("embedding"), F.col("ref"))).alias("mean_cosine"), F.count("*").alias("references"))
    return rounded(both, "mean_cosine")


# --- signals ---------------------------------------------------------------------------------

FRAME, HOP, BINS, PAUSE = 8, 4, 16, 2


def level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.level_stats(signal_view(spark, sf_dir)), "peak", "rms", "dc", "silence", "clipping")


def frame_rms_zcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.frames(signal_view(spark, sf_dir), FRAME, HOP), "rms", "zcr")


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.activity(signal.frames(signal_view(spark, sf_dir), FRAME, HOP).withColumn("rms", F.round("rms", 6)))


def pause_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.pauses(_active(spark, sf_dir), PAUSE).select("signal", "first", "last", "length")


def phrase_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variation of the lengths of phrases."""
    return rounded(signal.phrases(_active(spark, sf_dir), PAUSE).groupBy("signal").agg(*signal.spread("length")), "mean", "std", "cv")


def window_level_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = signal.windows(signal_view(spark, sf_dir), 10).withColumn("db", T.dbfs(F.col("level")))
    return rounded(w.groupBy("signal").agg(*signal.spread("db")), "mean", "std", "cv")


def envelope_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.envelope(signal_view(spark, sf_dir), BINS), "energy", "zcr")


def resample_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 values of each embedding stretched to 64 points: ends and sum."""
    r = V.resample(F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")), 64)
    e = table(spark, sf_dir, "embeddings").select("vec_id", r.alias("r"))
    total = F.aggregate("r", F.lit(0.0), lambda s, v: s + v)
    return rounded(e.select("vec_id", F.get("r", F.lit(0)).alias("head"), F.get("r", F.lit(31)).alias("middle"), F.get("r", F.lit(63)).alias("tail"), total.alias("total")), "head", "middle", "tail", "total", digits=5)


# --- listening -------------------------------------------------------------------------------

ROUTES = [("naturalness", "all_samples", []), ("accent", "categories", ["g1", "g3"]), ("names", "lexical_anchors", []), ("stress", "categories_or_lexical_anchors", ["g2"])]


def listening_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = spark.createDataFrame(ROUTES, "criterion string, selector string, wanted array<string>")
    return plan.route(_plan(spark, sf_dir).withColumn("anchored", F.col("prompt_id").endswith("ia")), routes)


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both labels of a document as two raters' scores."""
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return l.select("doc_id", "lang", "source", F.expr("stack(2, 'quality', cast(quality as double), 'toxic', cast(toxic as double)) as (rater_id, score)")).where("score is not null")


def missing_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the first sources that a rater has not rated."""
    expected = table(spark, sf_dir, "documents").select("doc_id").withColumn("rater_id", F.explode(F.array(F.lit("quality"), F.lit("toxic"))))
    return listening.missing_ratings(expected, _ratings(spark, sf_dir), ["doc_id", "rater_id"])


def listening_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(listening.aggregate(_ratings(spark, sf_dir), ["lang", "rater_id"]), "mean", "median")


def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.krippendorff_interval(_ratings(spark, sf_dir), "doc_id", "score", ["lang"]), "alpha")


def blind_labels_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listening.blind_labels(observations(spark, sf_dir).select("sample_id", "prompt_id"), 7, ["prompt_id"])


def _schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "nation").crossJoin(table(spark, sf_dir, "region")).select(F.col("n_nationkey").alias("block"), F.lower("r_name").alias("candidate_id"), F.col("r_regionkey").cast("int").alias("cand"))
    raters = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("rater_id"), F.col("s_suppkey").alias("rater"))
    return listening.schedule(items, raters, 11)


def counterbalanced_schedule_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schedule(spark, sf_dir)


def schedule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listening.schedule_audit(_schedule(spark, sf_dir))


# --- lineage ---------------------------------------------------------------------------------


def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", digest_strings(name=F.col("p_name"), brand=F.col("p_brand"), kind=F.col("p_type")).alias("sha256"))


def tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return lineage.tree_digest(p, ["p_brand"], F.concat_ws(" ", F.col("p_partkey").cast("string"), F.sha2("p_name", 256)))


def _lineages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("role-"), k.cast("string")).alias("role"), k, F.sha2("p_name", 256).alias("sha256"), F.col("p_size").cast("long").alias("bytes"))
    return p.where(k % 7 > 0), p.where(k % 5 > 0).withColumn("bytes", F.when(k % 3 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))


def lineage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.compare_roles(*_lineages(spark, sf_dir), "role", ["sha256", "bytes"])


def role_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage_diff(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    text_dup_cross_split, content_hash_dups, group_leakage, split_report, url_group_regex_leak, audit_stages, band_blocking_candidates, fingerprint_distance, fingerprint_bands, candidate_cap_flags, cosine_pairs, multi_reference_mean,
    level_stats, frame_rms_zcr, pause_islands, phrase_cv, window_level_std, envelope_bins, resample_64, listening_routing, missing_ratings, listening_aggregate, krippendorff_alpha, blind_labels_hash,
    counterbalanced_schedule_hash, schedule_audit, canonical_digest, tree_digest, lineage_diff, role_compare,
)}

_FIRST = "first_value(doc_id) over w first_doc_id, first_value(split) over w first_split"
_BANDS = "bands as (select vec_id, 's' || (vec_id % 3) split, b, 'e' || cast(round_even(20 * list_sum(list_transform(embedding[b*8+1:b*8+8], lambda x: cast(x as double))), 0) as bigint) h from embeddings, range(0, 8) t(b))"
_CANDS = f"with {_BANDS}, cands as (select l.vec_id left_id, r.vec_id right_id, count(*) shared from bands l join bands r on l.b = r.b and l.h = r.h and l.vec_id < r.vec_id and l.split <> r.split group by all having count(*) >= 3)"
_FRAMES = f"""with {SIGNAL_SQL}, f as (select signal, unnest(range(greatest(0, (i - {FRAME} + {HOP}) // {HOP}), i // {HOP} + 1)) frame, i, x from sig),
c as (select *, coalesce((lag(x) over (partition by signal, frame order by i) < 0) <> (x < 0), false)::int crossing from f),
frames as (select signal, cast(frame as int) frame, round(sqrt(avg(x * x)), 6) rms, round(sum(crossing) / {FRAME}, 6) zcr from c group by signal, frame having count(*) = {FRAME})"""
_ACTIVE = f"""{_FRAMES}, lv as (select signal, list_sort(list(rms)) v, max(rms) top from frames group by signal),
act as (select f.signal, frame, rms > greatest(power(10, -2.5), least(v[1 + least(len(v) - 1, cast(floor(len(v) * 0.2) as bigint))] * 3, top * 0.5), top * 0.04) active from frames f join lv using (signal)),
ch as (select *, case when active is distinct from lag(active) over (partition by signal order by frame) and lag(active) over (partition by signal order by frame) is not null then 1 else 0 end ch from act),
isl as (select *, sum(ch) over (partition by signal order by frame rows unbounded preceding) island from ch),
runs as (select signal, island, active, min(frame) f1, max(frame) f2, count(*) length from isl group by all)"""
_SPREAD = "count({0}) n, round(avg({0}), 6) mean, round(case when count({0}) >= 2 then stddev_pop({0}) end, 6) std, round(case when avg({0}) > 0 and count({0}) >= 2 then stddev_pop({0}) / avg({0}) end, 6) cv"
_RATINGS = "ratings as (select l.doc_id, d.lang, r rater_id, cast(case r when 'quality' then quality else toxic end as double) score from labels l join documents d using (doc_id), (values ('quality'), ('toxic')) t(r) where (case r when 'quality' then quality else toxic end) is not null)"
_SCHED = """with b as (select 'r' || s_suppkey rater_id, s_suppkey rater, n_nationkey block, row_number() over (partition by s_suppkey order by md5('11:r' || s_suppkey || ':' || n_nationkey), n_nationkey) - 1 place from supplier, nation),
t as (select rater_id, p pass, block, place, (p + rater + (select count(*) from nation n where n.n_nationkey < block)) % 5 cand from b, range(0, 5) x(p)),
sched as (select rater_id, cast(row_number() over (partition by rater_id order by pass, place) - 1 as int) "position", cast(pass as int) pass, block, lower(r_name) candidate_id from t join region on r_regionkey = cand)"""
_LINES = "with l as (select 'role-' || p_partkey as role, sha256(p_name) s, p_size b from part where p_partkey % 7 > 0), r as (select 'role-' || p_partkey as role, sha256(p_name) s, p_size + case when p_partkey % 3 = 0 then 1 else 0 end b from part where p_partkey % 5 > 0), x as (select coalesce(l.role, r.role) as role, case when r.role is null then 'missing' when l.role is null then 'unexpected' when l.s = r.s and l.b = r.b then 'exact' else 'differs' end status from l full join r on l.role = r.role)"

SQL = {
    "text_dup_cross_split": rf"with {DOCS_SQL}, k as (select doc_id, split, {KEY_SQL} key from docs where text is not null) select doc_id, split, first_doc_id, first_split from (select *, {_FIRST} from k window w as (partition by key order by doc_id)) where split <> first_split and doc_id <> first_doc_id",
    "content_hash_dups": "select doc_id, first_doc_id, group_rows from (select doc_id, min(doc_id) over w first_doc_id, count(*) over w group_rows from documents where text is not null window w as (partition by text)) where doc_id > first_doc_id",
    "group_leakage": f"with {DOCS_SQL} select doc_id, \"group\", split, first_doc_id, first_split from (select doc_id, 'g' || (doc_id // 20) as \"group\", split, {_FIRST} from docs window w as (partition by doc_id // 20 order by doc_id)) where split <> first_split",
    "split_report": f"with {DOCS_SQL} select split, count(*) as rows, count(*) filter (length(trim(text)) > 0) valid_rows, count(distinct source) as groups from docs group by split",
    "url_group_regex_leak": "with p as (select page_id, regexp_extract(url, '://([^/?#]+)', 1) host, case when page_id % 5 = 4 then 'test' else 'train' end split from pages), f as (select *, first_value(page_id) over w first_page_id, first_value(split) over w first_split from p window w as (partition by host order by page_id)) select host, count(*) as rows, min(first_page_id) first_page_id, min(first_split) first_split from f where split <> first_split group by host",
    "audit_stages": f"""with {DOCS_SQL}, r as (select split, doc_id, case when doc_id % 50 = 0 then '' else text end t, case when doc_id % 31 > 0 then source || '/' || (doc_id // 2) || '.wav' end p, sha256(text) s, case when doc_id % 37 > 0 then source || '/' || (doc_id // 10) end g from docs),
a as (select *, case when coalesce(trim(t), '') = '' then 'missing_text' when p is null then 'missing_audio_path' end r1 from r),
b as (select *, case when r1 is not null then r1 when row_number() over (partition by r1 is null, p order by doc_id) > 1 then 'duplicate_path' end r2 from a),
c as (select *, case when r2 is not null then r2 when row_number() over (partition by r2 is null, s order by doc_id) > 1 then 'duplicate_content' end r3 from b),
d as (select *, case when r3 is not null then r3 when g is null then 'missing_group' when first_value(split) over (partition by r3 is null, g order by doc_id) <> split then 'group_leakage' end r4 from c)
select split, coalesce(r4, 'valid') reason, count(*) n from d group by all""",
    "band_blocking_candidates": f"{_CANDS} select left_id, right_id, shared from cands",
    "fingerprint_distance": f"""{_CANDS} select left_id, right_id, shared, round(0.6 * list_sum(list_transform(range(1, 33), lambda i: abs(l.embedding[i]::double - r.embedding[i]::double))) / 32 + 0.4 * list_sum(list_transform(range(33, 65), lambda i: abs(l.embedding[i]::double - r.embedding[i]::double))) / 32, 6) distance
from cands join embeddings l on l.vec_id = left_id join embeddings r on r.vec_id = right_id""",
    "fingerprint_bands": """with q as (select vec_id, list_transform(embedding, lambda x: least(31, greatest(0, round_even((cast(x as double) + 0.5) * 31, 0)))) q from embeddings where len(embedding) = 64),
z as (select vec_id, q, list_reverse(q) z from q)
select vec_id, array_to_string(list_transform(range(0, 8), lambda b: 'e' || cast(round_even(list_sum(q[b*8+1:b*8+8]) / 8 / 4, 0) as int) || ':z' || cast(round_even(list_sum(z[b*8+1:b*8+8]) / 8 / 4, 0) as int)), '|') bands from z""",
    "candidate_cap_flags": f"{_CANDS} select left_id, right_id, cast(row_number() over (order by right_id, left_id) as int) \"rank\", (select count(*) from cands) total, (select count(*) from cands) >= 100 reached from cands order by right_id, left_id limit 100",
    "cosine_pairs": "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "multi_reference_mean": "with r as (select label, embedding from (select *, row_number() over (partition by label order by vec_id) n from embeddings) where n <= 3) select e.vec_id, round(avg(list_cosine_similarity(e.embedding::double[], r.embedding::double[])), 6) mean_cosine, count(*) as \"references\" from embeddings e join r using (label) group by e.vec_id",
    "level_stats": f"with {SIGNAL_SQL} select signal, count(*) n, round(max(abs(x)), 6) peak, round(sqrt(avg(x * x)), 6) rms, round(avg(x), 6) dc, round(avg((abs(x) <= 0.01)::int), 6) silence, round(avg((abs(x) >= 0.999)::int), 6) clipping from sig group by signal",
    "frame_rms_zcr": f"{_FRAMES} select signal, frame, rms, zcr from frames",
    "pause_islands": f"{_ACTIVE}, e as (select signal, min(frame) a, max(frame) b from act where active group by signal) select signal, f1 as first, f2 as last, length from runs join e using (signal) where not active and f1 > a and f2 < b and length >= {PAUSE}",
    "phrase_cv": f"""{_ACTIVE}, e as (select signal, min(frame) a, max(frame) b from act where active group by signal),
pz as (select signal, f1, f2 from runs join e using (signal) where not active and f1 > a and f2 < b and length >= {PAUSE}),
pf as (select signal, unnest(range(f1, f2 + 1)) frame from pz),
sp as (select act.signal, act.frame, frame - row_number() over (partition by act.signal order by frame) grp from act join e using (signal) where frame between a and b and (act.signal, act.frame) not in (select signal, frame from pf)),
ph as (select signal, grp, count(*) length from sp group by all)
select signal, {_SPREAD.format('length')} from ph group by signal""",
    "window_level_std": f"with {SIGNAL_SQL}, w as (select signal, i // 10 w, 20 * log10(greatest(sqrt(avg(x * x)), 1e-12)) db from sig group by all having count(*) * 2 >= 10) select signal, {_SPREAD.format('db')} from w group by signal",
    "envelope_bins": f"""with {SIGNAL_SQL}, s as (select *, sign(x) s, last_value(nullif(sign(x), 0) ignore nulls) over (partition by signal order by i rows between unbounded preceding and 1 preceding) b, count(*) over (partition by signal) n from sig)
select signal, cast(i * {BINS} // n as int) bin, round(sqrt(avg(x * x)), 6) energy, round(avg(case when s <> 0 and b is not null and s <> b then 1 else 0 end), 6) zcr from s group by all""",
    "resample_64": """with r as (select vec_id, list_transform(range(0, 64), lambda i: embedding[cast(floor(i * 31 / 63) as bigint) + 1]::double + (embedding[least(cast(floor(i * 31 / 63) as bigint) + 1, 31) + 1]::double - embedding[cast(floor(i * 31 / 63) as bigint) + 1]::double) * (i * 31 / 63 - floor(i * 31 / 63))) r from embeddings)
select vec_id, round(r[1], 5) head, round(r[32], 5) middle, round(r[64], 5) tail, round(list_sum(r), 5) total from r""",
    "listening_routing": f"with {PLAN_SQL} select sample_id, candidate_id, prompt_id, criterion from plan join (values ('naturalness', 'true'), ('accent', 'c'), ('names', 'a'), ('stress', 'ca')) t(criterion, kind) on kind = 'true' or (kind = 'c' and category in ('g1', 'g3')) or (kind in ('a', 'ca') and prompt_id like '%ia') or (kind = 'ca' and category = 'g2')",
    "missing_ratings": "select doc_id, r rater_id from documents, (values ('quality'), ('toxic')) t(r) where doc_id not in (select doc_id from labels)",
    "listening_aggregate": f"with {_RATINGS} select lang, rater_id, count(score) n, round(avg(score), 6) mean, round(median(score), 6) median, min(score) low, max(score) high from ratings group by all",
    "krippendorff_alpha": f"with {_RATINGS}, i as (select lang, doc_id, count(*) n, var_samp(score) v from ratings group by all), a as (select lang, var_samp(score) e from ratings group by lang) select lang, round(1 - (sum(n * v) filter (n >= 2) / sum(n) filter (n >= 2)) / any_value(e), 6) alpha from i join a using (lang) group by lang",
    "blind_labels_hash": f"with {OBS_SQL} select sample_id, prompt_id, 'sample-' || lpad((row_number() over (partition by prompt_id order by md5('7:' || sample_id), sample_id))::varchar, 4, '0') blind_id from obs",
    "counterbalanced_schedule_hash": f'{_SCHED} select rater_id, "position", pass, block, candidate_id from sched',
    "schedule_audit": f'{_SCHED}, a as (select *, lead("position") over (partition by rater_id, block order by "position") - "position" apart from sched), c as (select rater_id, pass, candidate_id, count(*) n from sched group by all), i as (select rater_id, max(n) - min(n) imbalance from c group by rater_id) select rater_id, count(*) items, count(distinct block) blocks, min(apart) least_apart, any_value(imbalance) imbalance from a join i using (rater_id) group by rater_id',
    "canonical_digest": """select p_partkey, sha256('{"brand":"' || p_brand || '","kind":"' || p_type || '","name":"' || p_name || '"}') sha256 from part""",
    "tree_digest": "with l as (select p_brand, p_partkey || ' ' || sha256(p_name) || chr(10) line from part) select p_brand, count(*) files, sha256(string_agg(line, '' order by line)) sha256 from l group by p_brand",
    "lineage_diff": f"{_LINES} select role, status from x",
    "role_compare": f"{_LINES} select status, count(*) n from x group by status",
}
