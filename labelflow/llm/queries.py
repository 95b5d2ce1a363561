"""The registered queries of the operators: thin digests of their results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import functions as F

from labelflow.llm import exact_dedup, html_main, line_dedup, near_dup, packing, pieces, quality, resampling, sharding, token_files, toxicity, warc, whitening
from labelflow.llm.common import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_sentencepiece")
def op1(spark, sf_dir):
    return pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: DuckDB has no base32 function: eight groups of 20 bits give four letters each
OP2_SQL = """
with t as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
g as (select *, min(page_id) over (partition by sha) as first_id from t)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(sha, (i // 4) * 5 + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as int) + 1, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from g"""


@query("op2_warc", OP2_SQL)
def op2(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_html_extraction")
def op3(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_main.extract_main(pages, html_main.fit_regions(pages))


OP4_SQL = """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.doc_id, k.line, k.pos, s.key is not null and k.doc_id <> s.keeper as gone from k left join s using (key))
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
  sha256(coalesce(string_agg(case when not gone then line end, chr(10) order by pos), '')) as kept_sha256
from j group by doc_id"""


@query("op4_line_dedup", OP4_SQL)
def op4(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")


#: DuckDB: group_size and the staying row per text without ASCII white space
OP6_SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) as n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
g as (select *, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size
      from t window w as (partition by text_sha256 order by n desc, doc_id nulls last))
select doc_id, keep_id, group_size, keep_id is not distinct from doc_id as kept, text_sha256 from g"""


@query("op6_exact_dedup", OP6_SQL)
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    g = exact_dedup.exact_groups(docs, locator=exact_dedup.locator_of(docs))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op7_packing")
def op7(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), window=2048, end_id=1)


@query("op8_quality_rules")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select("doc_id", *quality.COUNTS, "base_failed", "kept")


OP9_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
links as (select p.x, p.y from p join n nx on nx.doc_id = p.x join n ny on ny.doc_id = p.y where p.c * 5 >= 4 * (nx.n + ny.n - p.c)),
r(x, y) as (select x, y from links union select r.x, l.y from r join links l on r.y = l.x)
select d.doc_id, least(d.doc_id, coalesce((select min(y) from r where r.x = d.doc_id), d.doc_id)) as class_id,
  (select count(*) from links where links.x = d.doc_id) as n_links
from d"""


@query("op9_ngram_jaccard", OP9_SQL)
def op9(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query("op10_sharding")
def op10(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


@query("op11_direct_access_codes")
def op11(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"), token_files.JsonTokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), end_id=0)


@query("op12_embedding_whitening")
def op12(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


#: DuckDB has no CRC: it is linear, so a feature's CRC is the XOR of what each byte contributes at its distance from the end
#: (contrib, from the byte table by one step per zero byte behind it) and the CRC of as many zero bytes (zeros)
OP13_SQL = r"""
with recursive texts as (select true as doc, doc_id as id, text from documents union all select false, item_id, text from benchmark),
w as (select doc, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
f as (select doc, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
        || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as f from w),
c as (select doc, id, f, count(*) as n from f group by all),
bytes as materialized (select f, hex(encode(f)) as h, strlen(f) as len from (select distinct f from c)),
step as (select i as b, list_reduce(list_prepend(i, range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as t from range(256) r(i)),
contrib as (select 0 as k, b, t from step union all
            select k + 1, c.b, xor(c.t >> 8, s.t) from contrib c join step s on s.b = c.t & 255 where k < (select max(len) from bytes)),
zeros as (select 0 as len, cast(4294967295 as bigint) as z union all
          select len + 1, xor(z >> 8, s.t) from zeros join step s on s.b = z & 255 where len < (select max(len) from bytes)),
spread as (select f, len, unnest(range(len)) as i, h from bytes),
crc as (select f, xor(xor(bit_xor(t), any_value(z)), 4294967295) as crc from (select f, len, len - 1 - i as k, cast('0x' || substr(h, 2 * i + 1, 2) as bigint) as b from spread)
        join contrib using (k, b) join zeros using (len) group by f),
b as (select doc, id, crc % 10000 as bucket, n from c join crc using (f)),
s as (select bucket, sum(n) filter (doc) as s, sum(n) filter (not doc) as t from b group by bucket),
g as (select bucket, cast(floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select sum(s) from s) + 10000)::double)
        / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from s) + 10000)::double))) as bigint) as gain from s),
weights as (select id, cast(sum(n) as bigint) as n_features, cast(sum(n * gain) as bigint) as weight from b join g using (bucket) where doc group by id),
d as (select doc_id, len(w.w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
      from documents join w on w.doc and w.id = doc_id left join weights on weights.id = doc_id),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from d where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 5 * (select count(*) from r) // 100 then rank end as rank from d left join r using (doc_id)"""


@query("op13_importance_resampling", OP13_SQL)
def op13(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
