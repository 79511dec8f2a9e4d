"""One query for each operator over the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .license_scan import license_scan
from .line_dedup import MIN_CHARS, line_dedup
from .minhash_dedup import near_duplicates
from .mixing import mix_sources
from .packing import pack
from .substring_dedup import substring_dedup
from .topk_search import top_k
from .toxicity import toxicity
from .url_filter import url_filter

#: The rules of op1.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), RULES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "p_junk", "p_toxic", "rejected")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_epoch", "mix_block", "mix_tokens", "mix_weight")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=2, percent=80)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    return license_scan(docs.select("doc_id", path.alias("path"), "text"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_packing": op4_packing,
    "op5_topk": op5_topk,
    "op6_mixing": op6_mixing,
    "op7_minhash": op7_minhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_licenses": op10_licenses,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SQL = {
    # The tables hold no canonical links or refreshes that tie pages together beyond their own rules,
    # so classes are taken over link edges parsed the same way.
    "op1_url_filter": r"""
with p as (select page_id, url, html,
    coalesce(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')), '') host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') path,
    case when contains(url, '://') then lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')) || regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') end node
  from pages),
rules(action, rhost, rpath) as (values ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
tags as (select url, node, unnest(regexp_extract_all(html, '<link\b[^>]*canonical[^>]*>', 0, 'is')) tag from p),
edges as (select node a, lower(regexp_extract(t, '^.*?://([^/?#]*)', 1, 's')) || regexp_extract(t, '^.*?://[^/?#]*([^#]*)', 1, 's') b
  from (select node, regexp_extract(tag, 'href\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is') t from tags) where contains(t, '://')),
reach as (with recursive r(a, b) as (select node, node from p where node is not null union select r.a, case when e.a = r.b then e.b else e.a end from r join edges e on e.a = r.b or e.b = r.b) select a, b from r),
fit as (select p.page_id, p.url, r.rhost || r.rpath as rule, r.action,
    row_number() over (partition by p.page_id, p.url order by length(r.rhost) + length(r.rpath) desc, length(r.rhost) desc) k
  from p join rules r on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath)),
ruled as (select distinct p.page_id, p.url, p.node, f.rule, f.action from p left join fit f on f.page_id = p.page_id and f.url = p.url and f.k = 1),
classes as (select r.a, bool_or(x.action = 'block') b, bool_or(x.action = 'allow') w from reach r join ruled x on x.node = r.b group by 1)
select p.page_id, p.host, p.path, x.rule,
  coalesce(x.action, case when coalesce(c.b, false) and not coalesce(c.w, false) then 'block' else 'allow' end) verdict,
  x.action is null and coalesce(c.b, false) and not coalesce(c.w, false) via_alias
from p left join ruled x on x.page_id = p.page_id and x.url is not distinct from p.url left join classes c on c.a = p.node""",
    "op3_substring_dedup": rf"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
win as (select doc_id, unnest(range(1, len(w) - 11)) i, w from d where len(w) >= 13),
keyed as (select doc_id, i, array_to_string(w[i:i+12], ' ') k from win),
least as (select k, min(doc_id) m from keyed group by k having min(doc_id) < max(doc_id)),
hit as (select doc_id, list(i) starts from keyed join least using (k) where doc_id > m group by doc_id),
gone as (select doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 13)))) g from hit),
kept as (select d.doc_id, w, coalesce(g, []) g from d left join gone using (doc_id)),
words as (select doc_id, len(w) n, unnest(case when len(w) = 0 then [0] else range(1, len(w) + 1) end) i, w from d),
left_ as (select words.doc_id, n, words.i, w[words.i] word, x.i is not null removed from words left join (select doc_id, unnest(g) i from gone) x on x.doc_id = words.doc_id and x.i = words.i)
select doc_id, any_value(n) n_words, count(*) filter (removed) n_removed,
  sha256(coalesce(string_agg(word, ' ' order by i) filter (not removed and i > 0), '')) kept_sha256
from left_ group by doc_id""",
    "op5_topk": """
with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(range(1, 1 + least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])) as bigint) score
  from e q join e c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= 5""",
    "op7_minhash": rf"""
with d as (select doc_id, {_WORDS.format(_LOWER)} w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) when len(w) = 1 then [w[1]] else [] end) g from d),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
both_ as (select x, y from e union all select y, x from e),
reach as (with recursive r(a, b) as (select x, y from both_ union select r.a, e.y from r join both_ e on e.x = r.b) select a, min(b) m from r group by a)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) kept
from d left join n using (doc_id) left join reach on reach.a = d.doc_id""",
    "op8_exact_dedup": f"""
with d as (select doc_id, {_LOWER} t from documents)
select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id = max(doc_id) over w kept, sha256(t) text_sha256
from d window w as (partition by t)""",
    "op9_line_dedup": rf"""
with l as (select doc_id, unnest(string_split(text, chr(10))) ln, unnest(range(0, len(string_split(text, chr(10))))) i from documents where text is not null),
f as (select ln, min((doc_id, i)) pos, length(ln) n from l where regexp_matches(ln, '[^\x20\x09-\x0D]') group by ln),
k as (select ln, pos, n, unnest([(0, n, left(ln, (n - 1) // 2)), (0, n + 1, left(ln, n // 2)), (1, n, right(ln, (n - 1) // 2)), (1, n + 1, right(ln, n // 2))]) h from f where n >= {MIN_CHARS}),
pairs as (select distinct a.ln x, a.pos px, b.ln y, b.pos py from k a join k b using (h) where a.pos > b.pos and abs(a.n - b.n) <= 1),
near as (select x, min(py) py from pairs where
    len(list_filter(range(0, greatest(length(x), length(y))), lambda j: left(x, j) = left(y, j)
      and substr(x, cast(j + case when length(x) >= length(y) then 2 else 1 end as bigint)) = substr(y, cast(j + case when length(y) >= length(x) then 2 else 1 end as bigint)))) > 0 group by x),
g as (select l.doc_id, l.i from l join f using (ln) left join near on near.x = l.ln where f.pos < (l.doc_id, l.i) or near.py < (l.doc_id, l.i)),
t as (select l.doc_id, count(*) n_lines, count(g.i) n_removed, coalesce(string_agg(l.ln, chr(10) order by l.i) filter (g.i is null), '') kept
  from l left join g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, sha256(kept) kept_sha256 from documents d left join t using (doc_id)""",
}
